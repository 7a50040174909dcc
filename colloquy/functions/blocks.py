"""Matching blocks of two sequences, longest first, and alignments by least edits: small helpers and their column functions.

Blocks come from an index of the places of the second text's symbols, so a pair costs what its symbols meet. For edits, a table
of one text's symbols by the other's is filled a row at a time: one vector operation for each symbol of the first sequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def coded(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as numbers, equal for equal items."""
    number: dict = {}
    x, y = (np.fromiter((number.setdefault(t, len(number)) for t in s), np.int64, len(s)) for s in (a, b))
    return x, y


def matching_blocks(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the longest common run, and of those of what lies before it and behind it in both, in order. Of equal ones the first in a, then in b."""
    return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]


def ratio(a: Sequence, b: Sequence) -> float:
    """Twice the items in matching blocks over all items; 0 if a sequence is empty. Symbols that make up more than a hundredth of a b of 200 items and more begin no block."""
    return SequenceMatcher(None, a, b).ratio() if len(a) and len(b) else 0.0


def edit_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least edits between each prefix of a and each prefix of b."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), np.int32)
    places = np.arange(m + 1, dtype=np.int32)
    cost[0] = places
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (b != a[i - 1]))
        cost[i] = np.minimum.accumulate(row - places) + places  # insertions carry a cheap cell to the right
    return cost


def traced(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """A cheapest path from the ends of a and b back to their starts, as (kind, place in a, place in b): equal items match; else substitution goes before deletion before insertion."""
    cost = edit_costs(a, b)
    i, j = len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j, kind = i - 1, j - 1, "match"
        elif i and j and cost[i, j] == cost[i - 1, j - 1] + 1:
            i, j, kind = i - 1, j - 1, "substitution"
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i, kind = i - 1, "deletion"
        else:
            j, kind = j - 1, "insertion"
        yield kind, i, j


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters; 0 if a text is null or empty."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions")]))
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Edits that lead from one list of words to the other; nulls count as empty lists."""
    kinds = ("substitution", "deletion", "insertion")
    rows = []
    for r, h in zip(reference, hypothesis, strict=True):
        found = [kind for kind, _, _ in traced(*coded(list(r) if r is not None else [], list(h) if h is not None else []))]
        rows.append([found.count(k) for k in kinds])
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions"])


@pandas_udf(T.ArrayType(T.IntegerType()))
def aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    """For each item of a list the place of the equal item of the other one that it is aligned to by matching blocks, null for one that isn't; empty for a null list."""
    out = []
    for x, y in zip(a, b, strict=True):
        places: list[int | None] = [None] * (len(x) if x is not None else 0)
        for i, j, n in matching_blocks(list(x), list(y)) if x is not None and y is not None else ():
            places[i : i + n] = range(j, j + n)
        out.append(places)
    return pd.Series(out)
