"""Scores of aligned residues, and how many alignments of a score chance gives."""

from __future__ import annotations

import math

import numpy as np

# Half-bit substitution scores, residues in the order of LETTERS, lower triangle by rows (the public BLOSUM62 matrix).
LETTERS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
# Gap costs; scale and factor of scores with such gaps; slope and intercept of the length that an alignment
# takes up by its score (all of the usual aligner's tables for this matrix and these costs).
GAP_OPEN, GAP_EXTEND = 11, 1
LAMBDA, KAPPA, ALPHA, BETA = 0.267, 0.041, 1.9, -30.0
# Usual frequencies of the residues of LETTERS in proteins, in 1/100,000.
USUAL = (7805, 5129, 4487, 5364, 1925, 4264, 6295, 7377, 2199, 5142, 9019, 5744, 2243, 3856, 5203, 7120, 5841, 1330, 3216, 6441)

#: The scale of a pair is never less than this share of the usual one.
LEAST_SCALE = 0.5
#: Residues of the usual shares that are added to a sequence's own.
PRIOR = 10
_USUAL = np.array([USUAL]) / sum(USUAL)


def scores() -> np.ndarray:
    """The matrix over bytes; unknown letters score -1."""
    out = np.full((256, 256), -1, np.int64)
    for i, line in enumerate(BLOSUM62.split("\n")[1:-1]):
        for j, x in enumerate(line.split()):
            a, b = ord(LETTERS[i]), ord(LETTERS[j])
            out[a, b] = out[b, a] = int(x)
    return out


SCORES = scores()
CODES = np.frombuffer(LETTERS.encode(), np.uint8)
#: All scores of two residues, and for each the pairs of residues that have it.
STEPS = np.unique(SCORES[CODES[:, None], CODES[None]])
HAVING = (SCORES[CODES[:, None], CODES[None]] == STEPS[:, None, None]).astype(float)


def residues(text: str) -> np.ndarray:
    """Codes of a sequence's letters in capitals, never 0; what is no byte counts as unknown."""
    codes = np.frombuffer(text.upper().encode("latin-1", "replace"), np.uint8)
    return np.where(codes == 0, ord("?"), codes).astype(np.uint8)


def composition(codes: np.ndarray) -> np.ndarray:
    """Shares of the twenty residues in a sequence and PRIOR residues of the usual shares, so that few residues tell little."""
    counts = np.bincount(codes, minlength=256)[CODES] + PRIOR * _USUAL[0]
    return counts / counts.sum()


def excess(scale: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean of exp(scale * score) over residues drawn from the compositions of each row, less 1: it is 0 at the scale of scores without gaps."""
    shares = np.einsum("pi,kij,pj->pk", a, HAVING, b, optimize=True)
    return (shares * np.exp(scale[:, None] * STEPS)).sum(1) - 1


def solved(a: np.ndarray, b: np.ndarray, low: float, high: float) -> np.ndarray:
    """The scale of scores without gaps of each row's compositions, by bisection; `low` or `high` if it lies outside."""
    under, over = (np.full(len(a), x) for x in (low, high))
    for _ in range(40):
        middle = (under + over) / 2
        more = excess(middle, a, b) >= 0
        under, over = np.where(more, under, middle), np.where(more, middle, over)
    return (under + over) / 2


UNGAPPED_LAMBDA = float(solved(_USUAL, _USUAL, 0.05, 1.0)[0])


def scales(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scale of scores with gaps for pairs of compositions: the usual one, times that without gaps over its usual value; never more than usual.

    Pairs of one-sided composition score high by chance, so their scale is less.
    """
    return LAMBDA * solved(a, b, LEAST_SCALE * UNGAPPED_LAMBDA, UNGAPPED_LAMBDA) / UNGAPPED_LAMBDA


def search_space(length: np.ndarray, letters: np.ndarray, sequences: np.ndarray) -> np.ndarray:
    """Places where an alignment of a query of `length` may begin among `sequences` of `letters` in all: each sequence counts less by the
    length that an alignment of a score expected once takes up, found by bisection."""
    m, n, count = (np.asarray(x, float) for x in (length, letters, sequences))
    # so much may be taken off that KAPPA times the space is no less than the longer side
    square, rest = m * count + n, m * n - np.maximum(m, n) / KAPPA
    top = np.where(rest > 0, 2 * rest / np.maximum(square + np.sqrt(np.maximum(square**2 - 4 * count * rest, 0)), 1), 0)
    under, over = np.zeros_like(top), top
    for _ in range(40):
        middle = (under + over) / 2
        wanted = ALPHA / LAMBDA * np.log(np.maximum(KAPPA * (m - middle) * (n - count * middle), 1e-9)) + BETA
        under, over = np.where(wanted >= middle, middle, under), np.where(wanted >= middle, over, middle)
    off = np.floor(under)
    return np.maximum(m - off, 1) * np.maximum(n - count * off, 1)


def least_score(space: float, scale: float, evalue: float) -> int:
    """The least score that chance gives at most `evalue` times."""
    return max(1, math.ceil(math.log(max(1.0, KAPPA * space / evalue)) / scale - 1e-9))


def bits_of(score: int, scale: float) -> float:
    """A score in bits, in which all scales are alike."""
    return (scale * score - math.log(KAPPA)) / math.log(2)
