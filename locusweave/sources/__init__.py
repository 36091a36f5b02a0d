"""Readers and writers of sequence, annotation, alignment and track files."""
