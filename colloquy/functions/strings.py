"""String functions that built-in ones can't express, as Arrow-batched UDFs, and those on token lists that they can."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from colloquy.functions import text as tx
from colloquy.functions.blocks import sequence_ratio, word_edits  # noqa: F401

_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")


def text_similarity(a: Column, b: Column) -> Column:
    """The largest of the sequence ratio, the Jaccard of words and that of trigrams, of the normalised texts; 0 if one is empty."""
    x, y = tx.normalize(a), tx.normalize(b)
    words = tx.jaccard(F.array_distinct(tx.tokens(a)), F.array_distinct(tx.tokens(b)))
    grams = tx.jaccard(tx.char_ngrams(a), tx.char_ngrams(b))
    empty = (F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(F.greatest(sequence_ratio(x, y), words, grams))


def normalize_audit(text: Column) -> Column:
    """Lower case, ё as е, all but digits, Latin and Russian letters and _ + - as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), "[^0-9a-zа-я_+-]+", " "))


@pandas_udf(T.StringType())
def normalize_nfkc(text: pd.Series) -> pd.Series:
    """Words of the compatibility-composed, case-folded text, ё as е, joined by one space; null stays null."""
    return pd.Series([None if t is None else " ".join(_WORD.findall(unicodedata.normalize("NFKC", t).casefold().replace("ё", "е"))) for t in text])


@pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def display_token_spans(text: pd.Series) -> pd.Series:
    """Words in lower case with their places in the text, in code points, end exclusive."""
    return pd.Series([[{"token": m[0].lower(), "start": m.start(), "end": m.end()} for m in re.finditer(r"\w+(?:[-+/]\w+)*", t or "")] for t in text])


@pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two lists."""
    out = []
    for x, y in zip(a, b, strict=True):
        row = [0] * (len(y) + 1 if y is not None else 1)
        for t in x if x is not None and y is not None else ():
            last = row[:]
            for j, u in enumerate(y, 1):
                row[j] = last[j - 1] + 1 if t == u else max(last[j], row[j - 1])
        out.append(row[-1])
    return pd.Series(out, dtype="int32")


def suffix_prefix_fuzzy(a: Column, b: Column, most: int = 32, least: int = 3) -> Column:
    """The longest k from least to most so that the last k items of a are the first k of b; the last of them may be a prefix of two letters and more of a word of four and more. 0 if none."""
    limit = F.least(F.lit(most), F.size(a), F.size(b))

    def fits(k: Column) -> Column:
        tail, head = F.slice(a, F.size(a) - k + 1, k), F.slice(b, F.lit(1), k)
        x, y = F.element_at(tail, -1), F.element_at(head, -1)
        return (F.slice(tail, F.lit(1), k - 1) == F.slice(head, F.lit(1), k - 1)) & ((x == y) | ((F.length(x) >= 2) & (F.length(y) >= 4) & F.startswith(y, x)))

    ks = F.filter(F.sequence(F.lit(least), F.greatest(limit, F.lit(least))), lambda k: (k <= limit) & fits(F.least(k, F.greatest(limit, F.lit(1)))))
    return F.when(limit < least, 0).otherwise(F.coalesce(F.array_max(ks), F.lit(0)))


def fuzzy_suffix_contains(long: Column, short: Column) -> Column:
    """Whether a list ends with another one of three items and more, whose first item may be the end of a longer word, or the other way round by four letters."""
    n, m = F.size(long), F.size(short)
    k = F.greatest(m, F.lit(1))
    x, y = F.get(long, n - m), F.get(short, F.lit(0))
    ends = F.endswith(x, y) | F.endswith(y, F.right(x, F.lit(4)))
    rest = F.slice(long, F.greatest(n - m + 2, F.lit(1)), k) == F.slice(short, F.lit(2), k)
    return F.coalesce((m >= 3) & (n >= m) & rest & (F.length(x) >= 5) & (F.length(y) >= 4) & ends, F.lit(False))


def adjacent_repeat(a: Column, most: int = 16, least: int = 3) -> Column:
    """start and length of the longest block, of most to least items, that follows itself at once; of equal lengths the first. Null if none."""

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def repeat(lists: pd.Series) -> pd.Series:
        return pd.Series([_repeat(x, most, least) if x is not None else None for x in lists], dtype=object)

    found = repeat(a)
    return F.when(found.isNotNull(), F.struct(F.get(found, F.lit(0)).alias("start"), F.get(found, F.lit(1)).alias("length")))


def _repeat(items: Sequence, most: int, least: int) -> list[int] | None:
    number: dict = {}
    x = np.fromiter((number.setdefault(t, len(number)) for t in items), np.int64, len(items))
    for k in range(min(most, len(x) // 2), least - 1, -1):
        # how many of the items up to a place equal those k places on; a block repeats where k in a row do
        same = np.concatenate(([0], np.cumsum(x[:-k] == x[k:])))
        found = np.flatnonzero(same[k:] - same[:-k] == k)
        if len(found):
            return [int(found[0]), k]
    return None


def strip_fragments(text: Column, suffixes: list[str], credits: str, phrases: list[str]) -> Column:
    """The text up to the first of the suffix markers, without credits (a pattern) and known phrases (longest first), marks at its ends stripped."""
    at = F.array_min(F.filter(F.array(*[F.instr(F.lower(text), s.lower()) for s in suffixes]), lambda i: i > 0))
    out = F.when(at.isNotNull(), F.substring(text, F.lit(1), at - 1)).otherwise(text)
    out = F.regexp_replace(out, f"(?i){credits}", " ")
    for phrase in sorted(phrases, key=len, reverse=True):
        out = F.regexp_replace(out, f"(?i){re.escape(phrase)}", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[.!?, ]+|[.!?, ]+$", "")


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms that are words of the normalised text, in the order of the list."""
    return tx.once(tx.tokens(text), lambda own: F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(own, t)))


def term_overlap(a: Column, b: Column, terms: list[str]) -> Column:
    return tx.jaccard(terms_in(a, terms), terms_in(b, terms))


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and without spaces, nulls kept; text is not escaped beyond what JSON needs."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def stable_id(prefix: str, **fields: Column) -> Column:
    """prefix and sixteen hex digits of the SHA-256 of the canonical JSON."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(canonical_json(**fields), 256), 1, 16))


def parse_datetime(value: Column) -> Column:
    """ISO 8601 as a timestamp; no zone means UTC (the session's), anything else null."""
    iso = F.regexp_extract(value, r"^(\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?(?:Z|[+-]\d\d:?\d\d)?)?)$", 1)
    return F.try_to_timestamp(F.when(iso != "", iso))


def safe_number(value: Column, is_bool: Column | None = None) -> Column:
    """A number or a string of one as double; null for booleans and anything else."""
    number = value.try_cast("double")
    return F.when(~is_bool, number) if is_bool is not None else number
