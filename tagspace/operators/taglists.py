"""Posts whose text mentions a tag of a list.

By default each entry is a pattern and matches as a substring, as in the reference. ``literal``
takes entries as they are; ``whole_tag`` asks for a tag of the post that equals an entry. Literal lists
are matched by one Aho-Corasick automaton, whatever their length: a text is read once, and only the text
column goes to Python, in Arrow batches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspace.functions.predicates import text_mentions_any


class Matcher:
    """Whether a text holds ``#`` and an entry; with ``whole``, where no tag character follows."""

    def __init__(self, tags: Iterable[str], whole: bool):
        import ahocorasick
        self.whole = whole
        self.automaton = ahocorasick.Automaton()
        for tag in set(tags):
            if not whole or (tag and all(_in_tag(c) for c in tag)):  # others equal no tag
                self.automaton.add_word(f"#{tag}", len(tag) + 1)
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> bool:
        if not text or not len(self.automaton):
            return False
        return any(not self.whole or end + 1 == len(text) or not _in_tag(text[end + 1])
                   for end, _ in self.automaton.iter(text))


def _in_tag(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def text_matches_tags(posts: DataFrame, tags: Iterable[str], literal: bool = False, whole_tag: bool = False,
                      text: str = "text") -> DataFrame:
    """the posts that mention an entry of ``tags``; no column is added. A null text mentions
    nothing, and an empty list is mentioned by nothing."""
    tags = list(tags)
    if not tags:
        return posts.where(F.lit(False))
    if not (literal or whole_tag):
        return posts.where(text_mentions_any(tags, text))
    shared = posts.sparkSession.sparkContext.broadcast(tags)
    held: list[Matcher] = []

    @F.pandas_udf("boolean")
    def mentions(texts: pd.Series) -> pd.Series:
        if not held:  # built once in each task's copy of the function
            held.append(Matcher(shared.value, whole_tag))
        return texts.map(held[0].matches).astype(bool)

    return posts.where(mentions(F.col(text).cast("string")))
