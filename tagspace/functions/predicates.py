"""Named predicates (F1-F22) as Spark ``Column`` expressions.

Each can filter (``df.filter(p)``) or become a mask column
(``df.withColumn('keep', p)``). A NULL flag is not kept, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagspace.functions.hashing import keep_fraction
from tagspace.functions.text import ELLIPSIS

ELECTION_MODES = ("elected", "incumbent", "reelected", "newly_elected", "not_reelected")


def year_is(y: int, year: str = "year") -> Column:
    """F1."""
    return F.col(year) == F.lit(int(y))


def year_between(y0: int, y1: int, year: str = "year") -> Column:
    """inclusive range."""
    return F.col(year).between(int(y0), int(y1))


def month_between(m0: int, m1: int, ts: str = "created_at") -> Column:
    """F3 ``time``: inclusive month range."""
    return F.month(ts).between(int(m0), int(m1))


def elected() -> Column:
    """F4."""
    return F.col("elected") == 1


def incumbent() -> Column:
    """F5."""
    return F.col("incumbent") == 1


def reelected() -> Column:
    """F6."""
    return (F.col("elected") == 1) & (F.col("incumbent") == 1)


def newly_elected() -> Column:
    """F7."""
    return (F.col("elected") == 1) & (F.col("incumbent") == 0)


def not_reelected() -> Column:
    """F8."""
    return (F.col("elected") == 0) & (F.col("incumbent") == 1)


def content(text: str = "text") -> Column:
    """original content: no retweet, quote or reply, text not cut off."""
    return ((F.col("is_retweet") == 0) & (F.col("is_quoted") == 0) & (F.col("is_reply") == 0)
            & ~F.endswith(F.col(text), F.lit(ELLIPSIS)))


def no_tags(tags: str = "tags") -> Column:
    """F10."""
    return F.size(tags) == 0


def random_keep(fraction: float, seed: int, key: str = "post_id") -> Column:
    """independent Bernoulli(fraction) per post, from md5(seed:key)."""
    return keep_fraction(fraction, F.lit(int(seed)), F.col(key))


def random_keep_per_group(p_true: float = 0.5, seed: int = 0, key: str = "post_id",
                          group: str = "grp") -> Column:
    """the same draw, with the group in the hash input."""
    return keep_fraction(p_true, F.lit(int(seed)), F.col(group), F.col(key))


def has_tags(tags: str = "tags") -> Column:
    """F14."""
    return F.size(tags) > 0


def salience_rows(year, countryname: str = "Germany") -> Column:
    """F16: manifesto rows whose date text starts with the year, of one country."""
    return (F.startswith(F.col("date").cast("string"), F.lit(str(year)))
            & (F.col("countryname") == F.lit(countryname)))


def text_mentions_any(tags, text: str = "text", literal: bool = False) -> Column:
    """text matches any ``#tag`` as a substring regex (reference behaviour).

    ``literal=True`` quotes each tag so regex characters match themselves.
    """
    import re
    parts = [("#" + (re.escape(t) if literal else t)) for t in tags]
    return F.col(text).rlike("|".join(parts))


def full() -> Column:
    """no filter."""
    return F.lit(True)


def mode_predicate(mode: str, *, seed: int = 0, fraction: float = 1.0,
                   month_start: int = 1, month_end: int = 12) -> Column:
    """Predicate of a run mode (the mask of X1/X3)."""
    table = {
        "full": full,
        "elected": elected,
        "incumbent": incumbent,
        "reelected": reelected,
        "newly_elected": newly_elected,
        "not_reelected": not_reelected,
        "content": content,
        "no_hashtags": no_tags,
    }
    if mode == "random":
        return random_keep(fraction, seed)
    if mode == "time":
        return month_between(month_start, month_end)
    if mode not in table:
        raise ValueError(f"unknown mode {mode!r}")
    return table[mode]()
