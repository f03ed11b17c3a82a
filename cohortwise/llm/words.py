"""Shared column expressions for texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"


def text_of(c: Column | str) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, in order."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, counted without building them."""
    # After every white space becomes a blank, a word starts where a blank or the beginning precedes a non-blank.
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How often any of ``chars`` occurs, as long."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
