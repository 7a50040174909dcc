"""Best-fit packing: documents become token pieces, pieces become full sequences.

Packing decisions depend on piece lengths alone, and there are at most `capacity` lengths. So Spark counts the pieces of
each length, the plan (a list of bin patterns with multiplicities, never longer than a small multiple of `capacity`) is
made from those counts, and a broadcast join of the plan's segments places every piece by its rank among pieces of its
length. Ranks come from salted groups, so that no length, however frequent, is ranked in one task.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, count, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.textarrays import parts, release_memory
from colloquy.storage import bound_batches, materialize

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Chunks whose ids a worker remembers; beyond that it starts anew, so memory stays bounded.
REMEMBERED_WORDS = 200_000
#: Pieces of one length that are ranked together.
RANKED_TOGETHER = 20_000
#: White space as the tokenizer's pattern means it, and what is encoded by itself: a run of it with what follows up to the next.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_SPACE = [c + " " for c in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def _key(chunk: str) -> str:
    """A chunk's key: what follows its only, leading space; other chunks stand behind a space."""
    return chunk[1:] if chunk[:1] == " " and " " not in chunk[1:] else " " + chunk


class WordIds:
    """Token ids of whole texts by the byte-level BPE, one remembered chunk at a time.

    The tokenizer's pattern never matches across a place where white space follows something else, and looks no further than
    the end of the white space, so a chunk (white space and the run after it) has the same ids in any text. Given the
    tokenizer's own file, texts that hold one of its added tokens are left to the tokenizer, which finds those tokens in
    text; without it they are ordinary text.
    """

    def __init__(self, ranks_path: str, pattern: str, tokenizer_path: str | None = None):
        import tiktoken

        lines = Path(ranks_path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        added = [re.escape(t["content"]) for t in json.loads(Path(tokenizer_path).read_text(encoding="utf-8"))["added_tokens"]] if tokenizer_path else []
        self.added, self.path = re.compile("|".join(added)) if added else None, tokenizer_path
        self.forget()

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.codes: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids: list[list[int]] = []

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, followed by the id 0 that ends a document."""
        if len(self.ids) > REMEMBERED_WORDS:
            self.forget()
        codes, code, ids, whole = [], self.codes.__getitem__, self.ids, {}
        for i, text in enumerate(texts):
            keys = []
            if self.added and self.added.search(text):
                whole[i] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
            elif any(pair in text for pair in _BEFORE_SPACE):
                keys = [_key(c) for c in _CHUNK.findall(text)]
            else:  # no run of white space holds a space but as its first character, so texts may be cut before every space
                keys = text.split(" ")
                keys[0] = _key(keys[0])
            codes.append(np.fromiter(map(code, keys), np.int64, len(keys)))
        new = islice(self.codes, len(ids), None)  # keys are numbered as they first come
        ids += [self.encode(k[1:] if k[:1] == " " else " " + k) for k in new]
        ends = np.cumsum([len(c) for c in codes])
        used, places = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_inverse=True)
        lists = [ids[c] for c in used]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        pool = np.fromiter(chain.from_iterable(lists), "<u4", int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        n = lengths[places]
        bounds = np.concatenate([[0], np.cumsum(n)])
        flat = pool[np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(starts[places], n)]
        out, begin = [], 0
        for i, end in enumerate(ends):
            out.append(whole[i] if i in whole else np.append(flat[bounds[begin] : bounds[end]], np.uint32(0)).astype("<u4"))
            begin = end
        return out


def token_pieces(docs: DataFrame, capacity: int, ranks_path: str, pattern: str, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece of at most capacity tokens; of a longer document only the first piece may be short."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(ranks_path, pattern, tokenizer_path)
        for batch in batches:
            for part, _ in parts(batch, 1):
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.texts([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    stop, piece, start = len(ids) % capacity or capacity, 0, 0
                    while start < len(ids):
                        rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                        piece, start, stop = piece + 1, stop, stop + capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
        encoder.forget()
        release_memory()

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin patterns (how many bins, [(length, how many in each)]) that use up counts.

    Each bin is filled greedily, longest first. Then its smallest piece gives way to the two unpacked pieces that fit the
    gap this opens more tightly, for as long as that helps. Equal bins are made at once: while every length of a pattern
    lasts, the next bin would be chosen alike.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left, reverse=True)
    patterns = []
    while order:
        used: dict[int, int] = {}
        gap = capacity
        for length in order:
            if length <= gap:
                used[length] = n = min(left[length], gap // length)
                gap -= n * length
                if not gap:
                    break
        while gap:
            smallest = min(used)
            room, free = gap + smallest, [x for x in order if left[x] > used.get(x, 0)]
            best, pair, j = smallest, None, len(free) - 1
            for i, a in enumerate(free):  # a falls, so the largest partner b that still fits grows
                while j > i and free[j - 1] + a <= room:
                    j -= 1
                k = max(i, j)
                while k < len(free) and (free[k] + a > room or k == i and left[a] - used.get(a, 0) < 2):
                    k += 1
                if k < len(free) and best < free[k] + a:
                    best, pair = free[k] + a, (a, free[k])
                if best == room:
                    break
            if pair is None:
                break
            used[smallest] -= 1
            if not used[smallest]:
                del used[smallest]
            for x in pair:
                used[x] = used.get(x, 0) + 1
            gap = room - best
        times = min(left[x] // n for x, n in used.items())
        patterns.append((times, sorted(used.items(), reverse=True)))
        for x, n in used.items():
            left[x] -= times * n
        order = [x for x in order if left[x]]
    return patterns


def _segments(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple]:
    """(length, first rank, end rank, pieces in a bin, first bin, offset in the bin) for all that the patterns place."""
    ranks: dict[int, int] = {}
    rows, bins = [], 0
    for times, used in patterns:
        offset = 0
        for length, n in used:
            begin = ranks.get(length, 0)
            ranks[length] = begin + times * n
            rows.append((length, begin, ranks[length], n, bins, offset))
            offset += n * length
        bins += times
    return rows


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, length <= capacity, ...). Reads pieces twice: materialize them first."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    salts = max(8, sum(counts.values()) // RANKED_TOGETHER)
    rows = _segments(best_two_fit(counts, capacity)) or [(0, 0, 0, 1, 0, 0)]
    plan = spark.createDataFrame(rows, "_length int, _begin long, _end long, _each int, _bin long, _at long")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(groups, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_begin")) & (F.col("_rank") < F.col("_end")))
    since = F.col("_rank") - F.col("_begin")
    return placed.select(
        *pieces.columns,
        (F.col("_bin") + F.floor(since / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(since, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k", encode_special_tokens: bool = True) -> DataFrame:
    """Packs docs(doc_id, text) into sequences of at most capacity tokens; other columns are ignored.

    A document is its ids and one id 0, so a null or empty text is one piece of length 1. A repeated doc_id is packed once
    for each row. An empty table gives no rows. encode_special_tokens is that of `tokenizers`: True encodes the literal of an
    added token, such as <|endoftext|>, as ordinary text, False gives it that token's id, as `tokenizers` does unless told
    otherwise; op3 and the pipeline use False. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    import public_tokenizers

    pieces = token_pieces(docs, capacity, public_tokenizers.path(f"{tokenizer}.tiktoken"), public_tokenizers.PATTERN, None if encode_special_tokens else public_tokenizers.path(f"{tokenizer}.json"))
    packed = pack(materialize(pieces, "pieces"), capacity)
    return packed.withColumn("length", F.col("length").cast("long"))
