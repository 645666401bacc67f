"""Token expressions. A document is one row, so its term counts need no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII white space that separates tokens.
WHITE_SPACE = " \t\n\x0b\f\r"


def token_body(text: Column) -> Column:
    """``text`` in lower case without trailing white space.

    No pattern with a repetition runs over the text, so long runs of white space cost linear time.
    """
    ends_open = reduce(lambda a, b: a | b, [F.endswith(text, F.lit(c)) for c in WHITE_SPACE])
    lower = F.lower(text)
    return F.when(ends_open, F.rtrim(lower, F.lit(WHITE_SPACE))).otherwise(lower)


def no_tokens() -> Column:
    """An empty array of strings that can't hold a null."""
    return F.array_remove(F.split(F.lit(""), ","), "")


def split_body(text: Column, body: Column) -> Column:
    """Tokens of ``text``, given its ``token_body`` as a column of an earlier projection.

    Inner empty tokens stay and trailing ones go; an empty text is one empty token, a text of
    white space alone is none.
    """
    return F.when((body == "") & (text != ""), no_tokens()).otherwise(F.split(body, r"\s"))


def run_starts(ordered: Column) -> Column:
    """Of a sorted token array without nulls: the 0-based positions at which a new term begins."""
    positions = F.sequence(F.lit(0), F.size(ordered) - 1)
    fresh = F.filter(
        positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
    )
    return F.when(F.size(ordered) > 0, fresh).otherwise(F.array().cast("array<int>"))


def run_lengths(ordered: Column, starts: Column) -> Column:
    """Distinct terms of a sorted token array with their counts, as ``array<struct<term, cnt>>``."""
    rest = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
    ends = F.concat(rest, F.array(F.size(ordered)))
    pairs = F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(F.get(ordered, a).alias("term"), (b - a).cast("long").alias("cnt")),
    )
    return F.when(F.size(starts) > 0, pairs)
