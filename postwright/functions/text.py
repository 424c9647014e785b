"""Text expressions: word runs, trimming, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_RUNS = "[A-Za-z0-9]+"
UNICODE_RUNS = r"[\p{L}\p{N}]+"


def runs(text: Column, unicode: bool = False) -> Column:
    """Maximal runs of letters and digits; the ASCII rule cuts words at accents."""
    return F.regexp_extract_all(text, F.lit(UNICODE_RUNS if unicode else ASCII_RUNS), F.lit(0))


def is_alphabetic(word: Column) -> Column:
    return word.rlike("^[A-Za-z]+$")


def trim_surface(word: Column) -> Column:
    """Without what is neither letter nor digit at both ends."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def with_prompt(text: Column, prompt: str) -> Column:
    return F.concat(F.lit(prompt), text)


def truncated(tokens: Column, most: int) -> Column:
    return F.slice(tokens, 1, most)
