"""PII replaced by keyed surrogates of the same type, gender, script and format; DataFrame functions only.

One pattern finds the mentions of a text. Numbers of cards and accounts enter it
as they stand in the text, after all that could be one, overlapping or not, were
tried by their check digits, so one that fails takes nothing of its neighbours
along. Words of titled names are replaced where they stand without title, too.
A mention stands for one entity key
(kind and canonical value; a titled full name for two), so differently written
mentions of an entity share it. The surrogate of a key is drawn from the stream
HMAC-SHA-512(secret, key, attempt), shaped by its kind: phone numbers keep
their country code, cards their issuer and a valid check digit, IBANs
their country and check digits, secrets their alphabet, names their gender and
script, and punctuation and letter case are put back as they stood.

Collision check: the distinct keys of all texts are aggregated; a surrogate that
equals another's or a value met in the texts is drawn anew, until none is left.
Where the values of a format run out, later attempts are longer, so there always
is a free one. Only keys drawn more than once are looked up when texts are
rewritten. Mentions are found once: the pieces of all texts are written.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, staged, table

# Forms of address by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mademoiselle", "Señora", "Sra", "Госпожа", "Κυρία", "Lady", "Dame", "Fräulein", "Mlle", "Señorita", "Srta", "Doña", "Δεσποινίς")
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος", "Lord", "Herrn", "Don", "Κύριο", "Κυρίου")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Professeur", "Profesor", "Mx", "Доктор", "Профессор")
# Syllables that surrogate names are made of, by script.
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "sa", "te", "vi", "lo", "ra", "ne"),
    "cyrillic": ("ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "са", "те", "ви", "ло", "ра", "не"),
    "greek": ("βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πα", "ρε", "σα", "τε", "βι", "λο", "ρα", "νε"),
}
# Endings of given names by gender, and of family names.
ENDINGS = {
    "latin": {"f": ("lia", "nna", "ella", "ika", "ora", "ine", "etta", "eah"), "m": ("ton", "rik", "mas", "bert", "vin", "rus", "dan", "lof"), "n": ("den", "ley", "ren", "kai"), "": ("ner", "man", "son", "berg", "wood", "feld", "ard", "sky")},
    "cyrillic": {"f": ("лия", "нна", "рина", "ша"), "m": ("тон", "рик", "мир", "слав"), "n": ("ден", "рен"), "": ("нер", "ман", "берг", "ник")},
    "greek": {"f": ("λια", "ννα", "ρινη", "ω"), "m": ("τος", "νιος", "ρης", "κης"), "n": ("δης", "ρεν"), "": ("νης", "πουλος", "ιδης", "ακης")},
}
# Lengths of account numbers by country.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Cards: unbroken, or in the groups that issuers print, of one separator.
GROUPED = "|".join(rf"[0-9]{{4}}{x}(?:[0-9]{{4}}{x}[0-9]{{4}}{x}[0-9]{{4}}(?:{x}[0-9]{{3}})?|[0-9]{{6}}{x}[0-9]{{4,5}})" for x in " -")
UNBROKEN = "[0-9]{12,19}"
NAME = r"(?:\p{Lu}(?:\p{Ll}|-(?=\p{L})|['’](?!s(?!\p{L}))(?=\p{L})|(?<=[\p{Ll}'’-])(?!TITLE)\p{Lu}(?=\p{Ll})){1,24}|\p{Lu}{2,25})(?:(?!\p{L})|(?<=\p{Ll})(?=TITLE))"
# What may stand before a family name.
LEAD = r"(?:\p{Lu}\. ?|(?:van|von|vom|zu|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|al) ){0,3}"
# Country codes of one and two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Seven digits or more after a plus sign; three groups; a trunk prefix, in brackets or not, and six to eight digits after the area's.
SEVEN = r"(?=(?:[ .()-]{0,3}[0-9]){7})"
PHONE = "|".join((
    r"(?=[+(0-9])(?<![\p{L}\p{N}+.-])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])",
    rf"\+{SEVEN}[0-9](?:[ .-]?\(?[0-9]\)?){{6,14}}(?![\p{{L}}\p{{N}}]|[.-][0-9])",
    rf"\+{SEVEN}[0-9]{{1,3}}(?:[ .-]?\(?[0-9]{{1,5}}\)?){{2,5}}(?![\p{{L}}\p{{N}}])",
    r"(?=\(0\))(?<![\p{L}\p{N}])\(0\) ?[0-9]{2,5}[ .-]?[0-9]{4,8}(?![\p{L}\p{N}]|[.-][0-9])",
    r"(?=0[1-9])(?<![\p{L}\p{N}+.,/-])0[1-9][0-9]{1,3}[ /-](?=(?:[ -]?[0-9]){6,8}(?![ -]?[0-9]))[0-9]{2,8}(?:[ -][0-9]{2,4}){0,3}(?![\p{L}\p{N}]|[.,/-][0-9])",
))
TITLES = "|".join(sorted(FEMALE + MALE + NEUTRAL, key=len, reverse=True))
NAME = NAME.replace("TITLE", rf"(?:{TITLES})\. ")  # a title may follow a name without a blank
TITLE = rf"(?:(?:{TITLES})\.? )+"
#: The kinds of mentions and how they look, in order of precedence; a cheap look ahead saves the look behind at most places.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "key": r"(?=A)(?<![\p{L}\p{N}])(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_-]{8,200}+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?=[0-9])(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"(?=[0-9])(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "card": rf"(?=[0-9])(?<![\p{{L}}\p{{N}}.-])(?:{UNBROKEN}|{GROUPED})(?![\p{{L}}\p{{N}}])",
    "ip6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": PHONE,
    "name": rf"(?=\p{{Lu}})(?:(?<![\p{{L}}\p{{N}}])|(?<=\p{{Ll}})(?=(?:{TITLES})\. )){TITLE}{LEAD}{NAME}(?: {LEAD}{NAME})?(?!\p{{N}})",
}
# Ordinary words that are names as well; without title they are no names.
ORDINARY = (
    "abril", "amber", "april", "august", "autumn", "bach", "baker", "berg", "bill", "bishop", "black", "blanc", "brown", "butler", "carter", "christian", "clay", "cook", "cooper", "crystal",
    "cruz", "dawn", "day", "dean", "drew", "earl", "faith", "fisher", "flores", "forest", "fox", "frank", "fuchs", "gene", "grace", "grant", "gray", "green", "groß", "gross", "guy", "hall",
    "hill", "holly", "hope", "hunter", "iris", "ivy", "jack", "jay", "john", "joy", "jung", "june", "kaiser", "king", "klein", "knight", "koch", "könig", "kurz", "lang", "lane", "lee",
    "leblanc", "lily", "long", "luna", "major", "mark", "martin", "mason", "may", "meyer", "miles", "miller", "moon", "neumann", "nick", "noble", "norman", "olive", "page", "park", "parker",
    "pat", "paris", "pearl", "penny", "petit", "porter", "price", "ray", "reed", "reich", "reyes", "rich", "richter", "rob", "robin", "roman", "rosa", "rose", "ruby", "santa", "schmidt",
    "schneider", "schwarz", "shepherd", "short", "skip", "sky", "smart", "sommer", "stern", "stone", "sun", "sunny", "taylor", "turner", "victor", "violet", "wagner", "walker", "ward",
    "weber", "weiß", "west", "white", "will", "winter", "wolf", "wood", "woods", "young",
)
# Numbers of card issuers, by leading digits and length.
ISSUERS = (
    r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}"
    r"|35[0-9]{14,17}|3(?:0[0-59]|[689][0-9])(?:[0-9]{11}|[0-9]{13,16})|(?:6011|64[4-9][0-9]|65[0-9]{2}|62[0-9]{2}|81[0-9]{2})[0-9]{12,15}"
    r"|(?:50|5[6-9]|6[0-9])[0-9]{10,17})$"
)
#: Cards and accounts are tried by their check digits before they are sought.
CHECKED = ("iban", "card")
BEFORE = {k: p for k, p in list(KINDS.items())[:3]}
AFTER = {k: p for k, p in KINDS.items() if k not in BEFORE and k not in CHECKED}
NOT_IN_WORD, AFTER_NUMBER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Texts without any of these hold no mention.
GUARD = rf"[0-9@]|(?:{TITLES})\.? \p{{L}}|(?i:password|passwd|pwd|token|secret|api_?key)\s{{0,3}}[=:]"


@dataclass(frozen=True)
class Surrogates:
    """secret: what surrogates are keyed by, known to nobody who reads them; most:
    redrawn keys up to which they are looked up in one map; longer: draws after
    which surrogates of a fixed length grow."""

    secret: str
    most: int = 10_000
    longer: int = 6

    def __post_init__(self) -> None:
        if not self.secret:
            raise ValueError("surrogates need a secret")


#: The setting that holds the secret of a session's surrogates.
SECRET = "spark.locusweave.surrogates.secret"


def of_session(spark: SparkSession) -> Surrogates:
    """With the secret of the session's setting; where that is unset, it is set to a random one, which the session keeps."""
    if not spark.conf.get(SECRET, None):
        spark.conf.set(SECRET, secrets.token_hex(32))
    return Surrogates(spark.conf.get(SECRET))


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Sum of the digits of a number by the check-digit rule; a valid number's is divisible by ten."""
    def add(total: Column, x: Column) -> Column:
        twice = x["d"] * (1 + x["i"] % 2)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    numbered = F.transform(F.reverse(_chars(digits)), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add)


def mod97(text: Column) -> Column:
    """Remainder by 97 of a number whose letters count as 10 to 35."""
    def add(rest: Column, c: Column) -> Column:
        value = F.ascii(c) - F.when(c < "A", 48).otherwise(55)
        return (rest * F.when(c < "A", 10).otherwise(100) + value) % 97

    return F.aggregate(_chars(text), F.lit(0), add)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _is_card(surface: Column) -> Column:
    return _digits(surface).rlike(ISSUERS) & (luhn(_digits(surface)) % 10 == 0)


def _is_iban(surface: Column) -> Column:
    plain = F.regexp_replace(surface, " ", "")
    return mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1


def kind_of(surface: Column) -> Column:
    """The first kind that the whole mention looks like; numbers of no card issuer, or that fail their check digits, are none."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        # the borders around a mention held where it was found
        is_ = surface.rlike("^(?:" + pattern + ")$")
        if kind in CHECKED:
            is_ = is_ & (_is_card(surface) if kind == "card" else _is_iban(surface))
        found = F.when(is_, F.lit(kind)).otherwise(found)
    return found


def _candidates(text: Column, shape: str, border: str = NOT_IN_WORD) -> Column:
    """All places of a shape, overlapping ones too."""
    return F.regexp_extract_all(text, F.lit(f"{border}(?=({shape}){AFTER_NUMBER})"), F.lit(1))


def pattern_of(text: Column) -> Column:
    """The pattern of a text's mentions; its valid grouped numbers of cards (longer ones first) and accounts are alternatives as they stand."""
    none = F.array().cast("array<string>")
    sized = []
    for n, countries in IBANS.items():
        full, rest = divmod(n - 4, 4)
        sized.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{full}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    other = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
    ibans = F.concat(_candidates(text, "|".join(sized)), _candidates(text, other))
    ibans = F.when(text.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), F.filter(F.array_distinct(ibans), _is_iban)).otherwise(none)
    border = r"(?<![\p{L}\p{N}.-])"
    # a group that starts no card may be part of one, unlike a number that stands alone
    shapes = [rf"[0-9]{{4}}{x}{rest}" for x in " -" for rest in (rf"[0-9]{{4}}{x}[0-9]{{4}}{x}[0-9]{{4}}{x}[0-9]{{3}}", rf"[0-9]{{4}}{x}[0-9]{{4}}{x}[0-9]{{4}}", rf"[0-9]{{6}}{x}[0-9]{{5}}", rf"[0-9]{{6}}{x}[0-9]{{4}}")]
    cards = F.concat(*[_candidates(text, shape, border) for shape in shapes])
    cards = F.when(text.rlike(f"(?<![0-9])(?:{GROUPED})"), F.filter(F.array_distinct(cards), _is_card)).otherwise(none)

    def among(numbers: Column, border: str) -> Column:
        return F.when(F.size(numbers) > 0, F.concat(F.lit(f"(?:{border}(?:"), F.array_join(numbers, "|"), F.lit(f"){AFTER_NUMBER})|"))).otherwise(F.lit(""))

    joined = lambda kinds: "|".join(f"(?:{p})" for p in kinds.values())
    return F.concat(F.lit(joined(BEFORE) + "|"), _let(ibans, lambda x: among(x, NOT_IN_WORD)), _let(cards, lambda x: among(x, f"(?=[0-9]){border}")), F.lit(f"(?:(?=[0-9]){border}{UNBROKEN}{AFTER_NUMBER})|"), F.lit(joined(AFTER)))


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def name_words(surface: Column) -> Column:
    """The given and family name of a mention, or the family name only; no titles, initials and particles."""
    return F.regexp_extract_all(F.regexp_replace(surface, f"^{TITLE}", ""), F.lit(NAME), F.lit(0))


def _phone(surface: Column) -> Column:
    """A phone's digits; those of North America without country code, others that have one after a plus sign."""
    digits = F.regexp_replace(_digits(surface), "^1(?=[0-9]{10}$)", "")
    return F.when(surface.startswith("+") & ~_digits(surface).startswith("1"), F.concat(F.lit("+"), digits)).otherwise(digits)


SECRET_LEAD = r"^([^=:]*[=:]\s*[\"']?)"


def keys_of(surface: Column, kind: Column) -> Column:
    """The entity keys of a mention, kind and value joined by a colon."""
    words = name_words(surface)
    title = F.regexp_extract(surface, f"^{TITLE}", 0)
    of = lambda titles: title.rlike(rf"(?:^| )(?:{'|'.join(titles)})[. ]")
    gender = F.when(of(FEMALE), "f").when(of(MALE), "m").otherwise("n")
    given = F.concat(F.lit("given/"), gender, F.lit("/"), _script(words[0]), F.lit(":"), F.lower(words[0]))
    family = lambda w: F.concat(F.lit("family//"), _script(w), F.lit(":"), F.lower(w))
    value = F.regexp_replace(surface, SECRET_LEAD, "")
    one = (
        F.when(kind.isin("card", "ssn"), _digits(surface))
        .when(kind == "phone", _phone(surface))
        .when(kind.isin("email", "ip6"), F.lower(surface))
        .when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .when(kind == "secret", F.when(value.rlike("^[0-9a-fA-F]+$"), F.lower(value)).otherwise(value))
        .otherwise(surface)
    )
    names = F.when(F.size(words) > 1, F.array(given, family(F.element_at(words, 2)))).otherwise(F.array(family(words[0])))
    return F.when(kind.isNull(), F.array().cast("array<string>")).when(kind == "name", names).otherwise(F.array(F.concat(kind, F.lit(":"), one)))


def hmac(message: Column, secret: str) -> Column:
    """HMAC-SHA-512 in hex digits."""
    key = secret.encode()
    key = (hashlib.sha512(key).digest() if len(key) > 128 else key).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))), 512)


def _stream(key: Column, attempt: Column, secret: str) -> Column:
    """512 hex digits."""
    return F.concat(*[hmac(F.concat_ws("\x1f", key, attempt.cast("string"), F.lit(str(i))), secret) for i in range(4)])


def _byte(stream: Column, i: Column | int) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) % 256
    return F.conv(F.substr(stream, (2 * at + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), (number % len(alphabet) + 1).cast("int"), F.lit(1))


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _mapped(text: Column, stream: Column, lower: str = LOWER, upper: str = UPPER, skip: Column | int = 0) -> Column:
    """text with every digit and letter from place `skip` on drawn anew within its class."""
    skip = skip if isinstance(skip, Column) else F.lit(skip)

    def draw(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        new = F.when(c.rlike("[0-9]"), _pick(DIGITS, b)).when(c.rlike(r"\p{Lu}"), _pick(upper, b)).when(c.rlike(r"\p{L}"), _pick(lower, b)).otherwise(c)
        return F.when(i < skip, c).otherwise(new)

    return F.array_join(F.transform(_chars(text), draw), "")


def _spelt(syllables: tuple[str, ...], stream: Column, last: Column) -> Column:
    """Syllables drawn by the stream, up to number `last` from 0."""
    known = F.array(*[F.lit(x) for x in syllables])
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.element_at(known, _byte(stream, i) % len(syllables) + 1)), "")


def surrogate(kind: Column, value: Column, attempt: Column, stream: Column, domain_stream: Column, longer: int) -> Column:
    """The surrogate value of a key. Later attempts are longer: at once where values can be short, from `longer` on elsewhere."""
    n = F.length(value)
    drawn = _mapped(value, stream)
    late = F.greatest(attempt - (longer - 1), F.lit(0))
    digits = F.when(late > 0, F.substr(_mapped(F.repeat(F.lit("0"), 200), F.reverse(stream)), F.lit(1), late)).otherwise("")
    national = n - 10
    phone = F.when(national >= 0, F.concat(F.substr(value, F.lit(1), national), _pick("23456789", _byte(stream, 40)), F.substr(drawn, national + 2, F.lit(2)), _pick("23456789", _byte(stream, 41)), F.substr(drawn, national + 5))).otherwise(F.concat(F.substr(value, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(3))))
    code = F.length(F.regexp_extract(F.substr(value, F.lit(2)), COUNTRY, 0)) + 1
    abroad = F.concat(F.substr(value, F.lit(1), code), _pick("23456789", _byte(stream, 40)), F.substr(drawn, code + 2))
    phone = F.concat(F.when(value.startswith("+"), abroad).otherwise(phone), digits)
    issuer = F.when(value.startswith("4"), 1).otherwise(4)
    body = F.concat(F.substr(value, F.lit(1), issuer), F.substr(drawn, issuer + 1, n - 1 - issuer), digits)
    card = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    ssn = F.concat(F.lit("9"), F.substr(drawn, F.lit(2)), digits)
    octet = lambda i, low, count: (low + F.pmod(_byte(stream, i) + 256 * _byte(stream, i + 60), F.lit(count))).cast("string")
    ip = F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))
    hex_ = _mapped(value, stream, "abcdef")
    ip6 = F.when(late > 0, F.concat(F.lit("2001:db8"), F.regexp_replace(F.substr(stream, F.lit(200), F.lit(24)), "(.{4})", ":$1"))).otherwise(hex_)
    ip = F.when(late > 0, ip6).otherwise(ip)
    country = F.substr(value, F.lit(1), F.lit(2))
    bban = F.concat(_mapped(F.substr(value, F.lit(5)), stream), digits)
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0"), bban)
    more = F.when(attempt > 0, F.substr(_mapped(F.repeat(F.lit("a"), 200), F.reverse(stream)), F.lit(1), 4 * attempt)).otherwise("")
    domain = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: _pick(LOWER, _byte(domain_stream, i))), ""), F.lit(".example"))
    email = F.concat(_mapped(F.substring_index(value, "@", 1), stream), more, F.lit("@"), domain)
    secret = F.concat(F.when(value.rlike("^[0-9a-f]+$"), _mapped(value, stream, "abcdef")).otherwise(drawn), F.when(n < 12, more).otherwise(""))
    key = F.concat(F.substr(value, F.lit(1), F.lit(4)), _mapped(F.substr(value, F.lit(5)), stream))
    name = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        made = _spelt(syllables, stream, 4 + attempt)
        for gender, ending in ENDINGS[script].items():
            of = f"given/{gender}/{script}" if gender else f"family//{script}"
            endings = F.array(*[F.lit(x) for x in ending])
            name = F.when(kind == of, F.concat(made, F.element_at(endings, _byte(stream, 70) % len(ending) + 1))).otherwise(name)
    chosen = {"phone": phone, "ip6": ip6, "card": card, "ssn": ssn, "ip": ip, "iban": iban, "email": email, "secret": secret, "key": key}
    out = name
    for k, made in chosen.items():
        out = F.when(kind == k, made).otherwise(out)
    return out


def _kind(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def _value(key: Column) -> Column:
    return F.substr(key, F.length(_kind(key)) + 2)


def with_surrogates(keys: DataFrame, p: Surrogates) -> DataFrame:
    """keys (key, attempt) plus the surrogate's own key, `new`."""
    streams = keys.withColumn("stream", _stream(F.col("key"), F.col("attempt"), p.secret)).withColumn("domain", _stream(F.substring_index("key", "@", -1), F.lit(0), p.secret))
    new = surrogate(_kind(F.col("key")), _value(F.col("key")), F.col("attempt"), F.col("stream"), F.col("domain"), p.longer)
    return streams.withColumn("new", F.concat(_kind(F.col("key")), F.lit(":"), new)).drop("stream", "domain")


PIECE = "struct<surface:string,kind:string,keys:array<string>>"


def _cut(text: Column, pattern: Column, mention: Callable[[Column], Column]) -> Column:
    """The pieces of a text, mentions made by `mention` and what lies between."""
    none = F.array().cast("array<string>")
    plain = lambda s: F.struct(s.alias("surface"), F.lit(None).cast("string").alias("kind"), none.alias("keys"))
    made = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), mention)
    pairs = F.zip_with(F.split(text, pattern, -1), made, lambda a, b: F.array(plain(a), b))
    return F.filter(F.flatten(pairs), lambda x: F.coalesce(x["surface"], F.lit("")) != "")


def mentions(text: Column) -> Column:
    """array<struct<surface, kind, keys>> of the pieces of a text, in order; what is no mention has kind null and no keys."""
    keyed = lambda s, kind: F.struct(s.alias("surface"), kind.alias("kind"), keys_of(s, kind).alias("keys"))
    pieces = _let(pattern_of(text), lambda pattern: _cut(text, pattern, lambda s: _let(kind_of(s), lambda kind: keyed(s, kind))))
    return _let(pieces, _untitled)


def _untitled(pieces: Column) -> Column:
    """pieces with the words of titled names, in capitals too, and the digits of numbers found where they stand alone.

    A word that the text has in lower case as well, or that is an ordinary one, is
    no name without title.
    """
    # as one text each, as only those are made distinct by hashing
    one = lambda word, kind, key: F.concat_ws("\x1f", word, kind, key)
    spelt = lambda x: F.flatten(F.zip_with(name_words(x["surface"]), x["keys"], lambda w, k: F.array(one(w, x["kind"], k), one(F.when(F.length(w) > 2, F.upper(w)).otherwise(w), x["kind"], k))))
    apart = lambda found: F.transform(F.array_distinct(F.flatten(found)), lambda s: _let(F.split(s, "\x1f"), lambda x: F.struct(x[0].alias("word"), x[1].alias("kind"), x[2].alias("key"))))
    named = apart(F.transform(F.filter(pieces, lambda x: x["kind"] == "name"), spelt))

    def known(names: Column) -> Column:
        plain = F.flatten(F.transform(F.filter(pieces, lambda x: x["kind"].isNull()), lambda x: F.regexp_extract_all(x["surface"], F.lit(rf"{NOT_IN_WORD}\p{{Ll}}[\p{{Ll}}'’-]*{AFTER_NUMBER}"), F.lit(0))))
        low = F.transform(names, lambda n: F.lower(n["word"]))
        ordinary = F.concat(F.array_intersect(low, F.array(*map(F.lit, ORDINARY))), F.array_intersect(low, plain))
        return F.when(F.size(names) > 0, _let(ordinary, lambda x: F.filter(names, lambda n: ~F.array_contains(x, F.lower(n["word"]))))).otherwise(names)

    def digits(x: Column) -> Column:
        """A number's digits, and a North American one's with and without country code."""
        forms = lambda d: F.array(d, F.regexp_replace(d, "^1(?=[0-9]{10}$)", ""), F.concat(F.when((x["kind"] == "phone") & d.rlike("^[2-9][0-9]{9}$"), "1").otherwise(""), d))
        return F.transform(_let(_digits(x["surface"]), forms), lambda d: one(d, x["kind"], x["keys"][0]))

    numbers = apart(F.transform(F.filter(pieces, lambda x: x["kind"].isin("phone", "card", "ssn")), digits))

    def pattern(names: Column, begins: str) -> Column:
        longest = F.reverse(F.array_sort(F.array_distinct(F.transform(names, lambda n: n["word"]))))  # a word before its beginnings
        return F.when(F.size(names) > 0, F.concat(F.lit(f"(?={begins}){NOT_IN_WORD}(?:"), F.array_join(longest, "|"), F.lit(f"){AFTER_NUMBER}")))

    def found(names: Column, begins: str, pieces: Column) -> Column:
        of = lambda s: F.element_at(F.filter(names, lambda n: n["word"] == s), 1)
        mention = lambda s: _let(of(s), lambda n: F.struct(s.alias("surface"), n["kind"].alias("kind"), F.array(n["key"]).alias("keys")))
        each = lambda pattern: F.flatten(F.transform(pieces, lambda x: F.when(x["kind"].isNull() & x["surface"].rlike(begins), _cut(x["surface"], pattern, mention)).otherwise(F.array(x))))
        return F.when(F.size(names) > 0, _let(pattern(names, begins), each)).otherwise(pieces)

    with_names = _let(_let(named, known), lambda names: found(names, r"\p{Lu}", pieces))
    return _let(with_names, lambda pieces: _let(numbers, lambda numbers: found(numbers, "[0-9]", pieces)))


def redrawn(keys: DataFrame, p: Surrogates) -> DataFrame:
    """(key, attempt) of the keys whose first surrogate isn't free.

    Of keys with one surrogate the one drawn earliest keeps it, then the smallest;
    a surrogate that equals a value of the texts is nobody's.
    """
    parts = keys.sparkSession.sparkContext.defaultParallelism  # few bytes, but much work a row
    now = staged(with_surrogates(keys.withColumn("attempt", F.lit(0)).repartition(parts, "key"), p), "drawn")
    while True:
        first = F.row_number().over(Window.partitionBy("new").orderBy("attempt", "key"))
        met = keys.select(F.col("key").alias("new"), F.lit(True).alias("met"))
        judged = now.withColumn("place", first).join(met, "new", "left")
        clash = (F.col("place") > 1) | F.coalesce("met", F.lit(False))
        judged = staged(judged.select("key", "attempt", "new", clash.alias("clash")), "judged")
        again = judged.where("clash").select("key", (F.col("attempt") + 1).alias("attempt"))
        if again.isEmpty():
            return judged.where("attempt > 0").select("key", "attempt")
        now = staged(judged.where("NOT clash").select("key", "attempt", "new").unionByName(with_surrogates(again.repartition(parts, "key"), p)), "drawn")


def _woven(surface: Column, new: Column) -> Column:
    """new's letters and digits in the places of surface's, and what is left of new after them."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, c: Column) -> Column:
        takes = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(state["out"], F.when(takes, F.substr(new, state["at"], F.lit(1))).otherwise(c)).alias("out"), (state["at"] + takes.cast("int")).alias("at"))

    return F.aggregate(_chars(surface), start, step, lambda state: F.concat(state["out"], F.substr(new, state["at"])))


def _written(x: Column) -> Column:
    """A mention with its surrogates in its own format."""
    surface, kind = x["surface"], x["kind"]
    new = F.transform(x["new"], _value)
    upper = (surface == F.upper(surface)) & surface.rlike(r"\p{Lu}")
    cased = F.when(upper, F.upper(new[0])).otherwise(new[0])
    lead, title = F.regexp_extract(surface, SECRET_LEAD, 1), F.regexp_extract(surface, f"^{TITLE}", 0)
    rest = F.substr(surface, F.length(title) + 1)
    initial = F.upper(F.substr(new[0], F.lit(1), F.lit(1)))
    between = F.transform(F.split(rest, NAME, -1), lambda x: F.regexp_replace(x, F.lit(r"\p{Lu}(?=\.)"), initial))
    names = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(F.initcap(b), F.lit("")))), "")
    held = F.regexp_replace(surface, SECRET_LEAD, "")
    secret = F.when((held == F.upper(held)) & held.rlike("^[0-9A-F]+$"), F.upper(new[0])).otherwise(new[0])
    return (
        F.when(kind.isNull(), surface)
        .when(kind.isin("card", "ssn", "iban"), _woven(surface, new[0]))
        .when(kind == "phone", _woven(surface, F.concat(F.when(_digits(surface).rlike("^1[0-9]{10}$"), "1").otherwise(""), F.ltrim(new[0], F.lit("+")))))
        .when(kind.isin("email", "ip6"), cased)
        .when(kind == "secret", F.concat(lead, secret))
        .when(kind == "name", F.concat(title, F.when(rest.rlike(r"^\p{Lu}{3,}$"), F.upper(names)).otherwise(names)))
        .otherwise(new[0])
    )


def _rewritten(found: Column, attempt_of: Callable[[Column], Column], p: Surrogates) -> Column:
    """The text of pieces with its mentions replaced; each step of the work is one transform, so nothing is computed twice."""
    nothing = F.lit("0")
    drawn = F.transform(found, lambda x: F.struct(x["surface"].alias("surface"), x["kind"].alias("kind"), F.transform(x["keys"], lambda k: F.struct(k.alias("key"), attempt_of(k).alias("attempt"))).alias("keys")))
    streams = lambda k: F.struct(k["key"].alias("key"), k["attempt"].alias("attempt"), _stream(k["key"], k["attempt"], p.secret).alias("stream"), F.when(_kind(k["key"]) == "email", _stream(F.substring_index(k["key"], "@", -1), F.lit(0), p.secret)).otherwise(nothing).alias("domain"))
    drawn = F.transform(drawn, lambda x: F.struct(x["surface"].alias("surface"), x["kind"].alias("kind"), F.transform(x["keys"], streams).alias("keys")))
    new = lambda k: F.concat(_kind(k["key"]), F.lit(":"), surrogate(_kind(k["key"]), _value(k["key"]), k["attempt"], k["stream"], k["domain"], p.longer))
    drawn = F.transform(drawn, lambda x: F.struct(x["surface"].alias("surface"), x["kind"].alias("kind"), F.transform(x["keys"], new).alias("new")))
    return F.array_join(F.transform(drawn, _written), "")


def replaced(docs: DataFrame, p: Surrogates, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text column, and as last column `pii`, array<struct<kind, keys>> of what was replaced.

    All columns of docs stay, but for one named like `pii`, which is replaced. A
    null text stays null and has no mentions, nor has an empty one. Equal texts
    become equal texts, so repeated rows stay repeated. An empty table gives no
    rows. Order and number of rows don't change surrogates, unless they clash;
    then the smaller key keeps its first one.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "pii")])
    held = docs.select(rest.alias("row"), text.alias("text"))
    guarded = F.when(F.col("text").rlike(GUARD), mentions(F.col("text")))
    held = held.withColumn("found", F.coalesce(guarded, F.array().cast(f"array<{PIECE}>")))
    some = F.exists("found", lambda x: x["kind"].isNotNull())
    # a text with mentions is in its pieces
    slim = held.select("row", F.when(~some, F.col("text")).alias("text"), F.when(some, F.col("found")).otherwise(F.array().cast(f"array<{PIECE}>")).alias("found"))
    found = staged(slim.withColumn("at", F.monotonically_increasing_id()), "pieces", compression="zstd")
    keys = found.select(F.explode(F.flatten("found.keys")).alias("key")).distinct()
    again = staged(redrawn(staged(keys, "keys"), p), "redrawn")
    n = again.limit(p.most + 1).count()
    if n == 0:
        attempt_of = lambda k: F.lit(0)
    elif n <= p.most:
        known = F.map_from_arrays(*[F.array(*[F.lit(r[i]) for r in again.collect()]) for i in (0, 1)])
        attempt_of = lambda k: F.coalesce(F.element_at(known, k), F.lit(0))
    else:
        found, attempt_of = _with_attempts(found, again), lambda k: F.coalesce(F.element_at(F.col("attempts"), k), F.lit(0))
    done = F.when(F.size("found") > 0, _rewritten(F.col("found"), attempt_of, p)).otherwise(F.col("text"))
    pii = F.transform(F.filter("found", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["keys"].alias("keys")))
    columns = [done.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "pii"]
    return found.select(*columns, pii.alias("pii"))


def _with_attempts(found: DataFrame, again: DataFrame) -> DataFrame:
    """found plus `attempts`, a map of the redrawn keys of each text, by joins for any number of them."""
    used = found.select("at", F.explode(F.array_distinct(F.flatten("found.keys"))).alias("key"))
    met = looked_up(used, again, "key", "at").where("attempt IS NOT NULL")
    maps = met.groupBy("at").agg(F.map_from_entries(F.collect_set(F.struct("key", "attempt"))).alias("attempts"))
    return found.join(maps, "at", "left").withColumn("attempts", F.coalesce("attempts", F.create_map().cast("map<string,int>")))


def op8_surrogates(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates, and how many mentions of each were replaced."""
    done = replaced(table(spark, sf_dir, "documents"), of_session(spark))
    return done.select("doc_id", "text", F.size("pii").alias("mentions"), F.transform("pii", lambda x: x["kind"]).alias("kinds"))
