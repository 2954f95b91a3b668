"""Keyword terms as literal regular expressions.

A term's regular expression runs only on rows whose lower-case text holds the term's
first word, which is a plain substring search.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..criteria import Keyword
from .text import flexible


def pattern_of(k: Keyword) -> str:
    body = flexible(k.term)
    body = f"(?<![A-Za-z0-9])(?:{body})(?![A-Za-z0-9])" if k.whole_word else f"(?:{body})"
    return body if k.case_sensitive else f"(?i:{body})"


def anchor(k: Keyword) -> str:
    """A lower-case text that every match holds: the term's first word."""
    return k.term.split()[0].lower()


def hits(words: list[Keyword], title: Column, text: Column, low_title: Column, low_text: Column) -> Column:
    """Array of the terms that occur, in the order of the criteria."""
    none = F.array().cast("array<string>")
    if not words:
        return none
    each = []
    for k in words:
        subject, low = (title, low_title) if k.match_scope == "title" else (text, low_text)
        each.append(F.when(low.contains(anchor(k)) & subject.rlike(pattern_of(k)), F.lit(k.term)))
    return F.array_compact(F.array(*each))
