"""Tokens that a history rules out: those that would repeat an n-gram of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def banned_tokens(history: Column, n: int, vocabulary: int) -> Column:
    """The distinct tokens, in order, that would end an n-gram which ``history`` (an array of ids) holds already.

    With n = 1 these are all of its tokens. A history of fewer than n - 1 tokens bans none, and so does one that would
    ban the whole ``vocabulary``: then all tokens stay. Ids outside the vocabulary are no tokens. A row is judged
    alone; histories are held to a context, so that an array is the place for them.
    """
    if n < 0 or vocabulary < 1:
        raise ValueError("n must not be negative, nor the vocabulary empty")
    none = F.array().cast("array<int>")
    if n == 0:
        return none
    size = F.size(history)
    if n == 1:
        found = history
    else:
        # places of the tokens after which a whole n-gram follows, by its first n - 1 tokens
        suffix = F.slice(history, size - (n - 2), F.lit(n - 1))
        starts = F.filter(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.slice(history, i, F.lit(n - 1)) == suffix)
        found = F.transform(starts, lambda i: F.get(history, i + (n - 2)))
        found = F.when(size >= n, found).otherwise(none)
    known = F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 0) & (x < vocabulary))))
    return F.coalesce(F.when(F.size(known) < vocabulary, known), none)
