"""Text conventions that the operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that parts words; every other character belongs to a word.
SPACES = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(flat, " "), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def py_words(text: str | None) -> list[bytes]:
    """words() inside a task: bytes.split() parts at exactly the same six characters."""
    return (text or "").encode().split()


def py_lower_words(text: str | None) -> list[bytes]:
    """py_words() with A-Z lower-cased; bytes.lower() touches ASCII alone."""
    return (text or "").encode().lower().split()


#: What modules remember in a worker from task to task.
REMEMBERED: list[dict] = []


def forget() -> None:
    """Called where a worker begins other work: what was remembered for an earlier operator is given back."""
    for held in REMEMBERED:
        held.clear()
