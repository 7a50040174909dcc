"""Substring dedup: words of windows whose word sequence has been seen before go.

Every window of `window` words holds a phrase of `phrase` words with the least hash, and equal windows hold the same one. So
phrases, an eighth as many as windows, tell which windows can recur:

1. Phrases that occur twice anywhere are marked in a mask of bounded size.
2. Each batch streams its documents; passages around marked phrases go to the shard that owns the phrase. Of equal windows
   in a batch only the first is sent, so a passage that all documents share reaches its shard once for each batch.
3. A shard confirms which of its phrases recur, compiles these into an Aho-Corasick automaton and streams the passages
   through it. Where it locates a phrase, the windows around are compared with those at its other places, word by word
   (words are hashes of 48 bits).
4. Later windows are sent back to their documents, where the words that they cover go.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.textarrays import Block, blocks, mix, pack48, release_memory, unpack48
from colloquy.storage import bound_batches

WINDOW, PHRASE = 20, 8
MASK_BITS = 1 << 26
#: Phrases, or words of passages, that meet in one shard.
PHRASES_TOGETHER, WORDS_TOGETHER = 500_000, 200_000
_GAP = 256  # a symbol that no word has


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each width consecutive values; len(x) - width + 1 values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def _sums(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width codes from each start."""
    out = np.zeros(len(starts), np.uint64)
    for j, m in enumerate(mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)):
        out += codes[starts + j].astype(np.uint64) * m
    return mix(out)


class Windows:
    """The windows of a block: word position (in the block), text, and the least phrase hash in each."""

    def __init__(self, block: Block, window: int, phrase: int):
        starts, ends, self.bounds = block.words()
        self.words = block.word_hashes(starts, ends, lower=False)
        n, w = len(self.words), window - phrase + 1
        self.at = self.text = np.zeros(0, np.int64)
        self.least = self.phrases = np.zeros(0, np.uint64)
        if n < window:
            return
        self.phrases = _sums(self.words, np.arange(n - phrase + 1), phrase)
        least = _sliding(self.phrases, w, np.minimum)
        text = np.repeat(np.arange(block.n), np.diff(self.bounds))
        inside = text[: n - window + 1] == text[window - 1 :]
        self.at = np.flatnonzero(inside)
        self.text, self.least = text[self.at], least[self.at]
        known = np.where(inside, least, np.uint64(0))
        highest = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), known, np.zeros(w - 1, np.uint64)]), w, np.maximum)
        self.chosen = self.phrases[highest == self.phrases]  # phrases that are the least of some window


def recurring_mask(docs: DataFrame, window: int, phrase: int, shards: int) -> np.ndarray:
    """A bit for the hash of each phrase that is the least of windows at two places; other bits are seldom set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [w.chosen for w in (Windows(b, window, phrase) for b in blocks(batch.column(0))) if len(w.at)]
            if chosen:
                values, counts = np.unique(np.concatenate(chosen), return_counts=True)
                part = ((values >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # values are sorted, so parts are
                cuts = np.searchsorted(part, np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([values[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()), pa.array([(counts[cuts[i] : cuts[i + 1]] > 1).tobytes() for i in full], pa.binary())], names=["shard", "phrases", "twice"])

    def meet(table: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(table["phrases"].to_pylist()), np.uint64)
        twice = np.frombuffer(b"".join(table["twice"].to_pylist()), bool)
        found, place, counts = np.unique(values, return_inverse=True, return_counts=True)
        again = counts > 1
        again[place[twice]] = True
        bits = np.unique(found[again] % np.uint64(MASK_BITS)).astype(np.int64)
        release_memory()
        words, at = np.unique(bits >> 6, return_inverse=True)
        marks = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(marks, at, np.uint64(1) << (bits & 63).astype(np.uint64))
        return pa.table({"word": pa.array(words), "marks": pa.array(marks.view(np.int64))})

    rows = docs.select("text").mapInArrow(run, "shard int, phrases binary, twice binary").groupBy("shard").applyInArrow(meet, "word long, marks long")
    rows = rows.groupBy("word").agg(F.expr("bit_or(marks)").alias("marks")).toArrow()  # at most MASK_BITS / 64 rows
    mask = np.zeros(MASK_BITS // 64, np.int64)
    mask[rows["word"].to_numpy()] = rows["marks"].to_numpy()
    return mask.view(np.uint8)


def row_key() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64("doc_id", "text")


def later_windows(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, row_key and starts (little-endian 32-bit word numbers) of windows whose word sequence also starts earlier; several rows a document."""
    spark = docs.sparkSession
    bound_batches(spark, 16)  # repeats inside a batch are sent once
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held = spark.sparkContext.broadcast(recurring_mask(docs, window, phrase, max(64, size // 40 // PHRASES_TOGETHER)))
    shards = max(64, size // 10 // WORDS_TOGETHER)
    reach = window - phrase + 1

    def marked(values: np.ndarray) -> np.ndarray:
        bit = (values % np.uint64(MASK_BITS)).astype(np.int64)
        return (held.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            codes, at, row, start, least, phrase_at, total, done = [], [], [], [], [], [], [], 0
            for block in blocks(batch.column(1)):
                w = Windows(block, window, phrase)
                keep = marked(w.least)
                pos = w.at[keep]
                if len(pos):
                    around = w.phrases[pos[:, None] + np.arange(reach)] if len(pos) * reach < 4_000_000 else None
                    phrase_at.append(np.argmin(around, 1) if around is not None else np.array([np.argmin(w.phrases[p : p + reach]) for p in pos]))
                    total.append(_sums(w.words, pos, window))
                    at.append(pos + done)
                    row.append(w.text[keep] + block.first)
                    start.append(pos - w.bounds[w.text[keep]])
                    least.append(w.least[keep])
                codes.append(w.words >> np.uint64(16))
                done += len(w.words)
            if not at:
                continue
            codes, at, row, start, least, phrase_at, total = map(np.concatenate, (codes, at, row, start, least, phrase_at, total))
            doc, key = ids[row], keys[row]
            order = np.lexsort((start, doc, total))
            t, d, s = total[order], doc[order], start[order]
            new = np.concatenate([[True], t[1:] != t[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
            first = np.zeros(len(t), bool)
            first[order] = (d == d[head]) & (s == s[head])
            out = [(i % shards, *x, *[None] * 6) for i, x in enumerate(_by_document(doc[~first], key[~first], start[~first]))]
            at, row, start, least, phrase_at, doc, key = (x[first] for x in (at, row, start, least, phrase_at, doc, key))
            cut = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0) | (least[1:] != least[:-1])])
            head = np.flatnonzero(cut)
            long = np.diff(np.append(head, len(at)))
            shard = ((least[head] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            head, long, shard = head[by], long[by], shard[by]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                h, n = head[cuts[i] : cuts[i + 1]], long[cuts[i] : cuts[i + 1]]
                out.append((int(i), None, None, None, doc[h].astype("<i8").tobytes(), key[h].astype("<i8").tobytes(), start[h].astype("<u4").tobytes(), n.astype("<u4").tobytes(), phrase_at[h].astype("<u4").tobytes(), pack48(codes[_ranges(at[h], n + window - 1)])))
            del codes, at, row, start, least, phrase_at, doc, key, total, order
            release_memory()
            types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
            for i in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out[i : i + 2000]], k) for j, k in enumerate(types)], names=["shard", "doc_id", "row_key", "later", "docs", "keys", "starts", "longs", "phrases", "codes"])

    def meet(table: pa.Table) -> pa.Table:
        sent = table.filter(pc.is_valid(table["docs"]))
        local = table.filter(pc.is_valid(table["later"])).select(["doc_id", "row_key", "later"])
        if not sent.num_rows:
            return local
        doc, key, start, long, at = (np.frombuffer(b"".join(sent[c].to_pylist()), k) for c, k in (("docs", "<i8"), ("keys", "<i8"), ("starts", "<u4"), ("longs", "<u4"), ("phrases", "<u4")))
        codes = unpack48(b"".join(sent["codes"].to_pylist()))
        del sent, table
        start, long, at = start.astype(np.int64), long.astype(np.int64), at.astype(np.int64)
        words = long + window - 1
        offset = np.cumsum(words) - words
        run = np.repeat(np.arange(len(long)), long)
        pos = _ranges(offset, long)
        use = _located(codes, offset, words, at, window, phrase)[pos]
        release_memory()
        pos, run = pos[use], run[use]
        where = start[run] + pos - offset[run]
        total = _sums(codes, pos, window)
        order = np.lexsort((where, doc[run], total))
        t, d, s = total[order], doc[run][order], where[order]
        new = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
        later = (d != d[head]) | (s != s[head])
        rows = list(_by_document(d[later], key[run][order][later], s[later]))
        found = pa.table({"doc_id": pa.array([x[0] for x in rows], pa.int64()), "row_key": pa.array([x[1] for x in rows], pa.int64()), "later": pa.array([x[2] for x in rows], pa.binary())})
        return pa.concat_tables([local, found.cast(local.schema)])

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").select("doc_id", "text", row_key())
    sent = sent.mapInArrow(deal, "shard int, doc_id long, row_key long, later binary, docs binary, keys binary, starts binary, longs binary, phrases binary, codes binary")
    return sent.groupBy("shard").applyInArrow(meet, "doc_id long, row_key long, later binary")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of starts, as many as its length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def _by_document(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((key, doc))
    doc, key, start = doc[order], key[order], start[order]
    edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]), [True]])) if len(doc) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(doc[a]), int(key[a]), start[a:b].astype("<u4").tobytes()


def _located(codes: np.ndarray, offset: np.ndarray, words: np.ndarray, at: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """For each word of the passages, whether a window that starts there holds a phrase that an automaton locates.

    The automaton has those of the passages' phrases (at word `at` of each) that occur at two places. It reads a word as two
    symbols of 8 bits, so it may locate too much, but misses nothing; passages are set apart by a symbol that no word has.
    """
    begin = offset + at
    sums = _sums(codes, begin, phrase)
    different = np.unique(np.stack([sums, begin.astype(np.uint64)], 1), axis=0)[:, 0]
    found, times = np.unique(different, return_counts=True)
    recurring = np.flatnonzero(np.isin(sums, found[times > 1]))
    del sums, different, found, times
    passage = np.repeat(np.arange(len(words), dtype=np.int32), words)
    symbols = np.full((len(codes) + len(words), 2), _GAP, "<u2")
    place = np.arange(len(codes), dtype=np.int32) + passage
    symbols[place, 0], symbols[place, 1] = codes & np.uint64(255), codes >> np.uint64(8) & np.uint64(255)
    text = symbols.tobytes().decode("utf-16-le")
    del passage, place, symbols
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for b in (2 * (begin + np.arange(len(words))))[recurring].tolist():
        automaton.add_word(text[b : b + 2 * phrase], 0)
    holds = np.zeros(len(codes) + 1, np.int32)
    if len(automaton):
        automaton.make_automaton()
        at = (np.fromiter((end for end, _ in automaton.iter(text) if end & 1), np.int64) - 2 * phrase + 1) // 2
        first = at - (np.searchsorted(offset + np.arange(len(words)), at, "right") - 1)
        np.add.at(holds, np.maximum(first - (window - phrase), 0), 1)
        np.add.at(holds, first + 1, -1)
    return np.cumsum(holds[:-1]) > 0


def keep_first_windows(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of docs(doc_id, text); other columns are ignored.

    Words are runs without space and \\x09-\\x0D, compared as they are. A word goes if a window covers it whose words also
    start earlier: in a smaller doc_id, or earlier in its document. Rows with one doc_id and different texts are compared as
    well: windows of theirs that start at the same place aren't earlier than each other. A row with a null doc_id is neither compared nor changed. A null or empty text
    has no words; texts shorter than a window stay. An empty table gives no rows.
    """
    later = later_windows(docs, window, phrase).groupBy("doc_id", "row_key").agg(F.collect_list("later").alias("_later"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", row_key())
    joined = rows.join(later, ["doc_id", "row_key"], "left").select("doc_id", "text", "_later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2).to_pylist()
            for block in blocks(batch.column(1)):
                starts, ends, bounds = block.words()
                cover = np.zeros(len(starts) + 1, np.int64)
                for i in range(block.n):
                    for raw in marks[block.first + i] or ():
                        s = np.frombuffer(raw, "<u4").astype(np.int64) + bounds[i]
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                texts = _kept(block, starts, ends, bounds, gone)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _kept(block: Block, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """The words of each text that aren't gone, joined by one space."""
    size = len(block.data)
    edge = np.zeros(size + 1, np.int8)
    edge[starts[~gone]] += 1
    edge[ends[~gone]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    kept = np.flatnonzero(~gone)
    follows = np.zeros(len(kept), bool)  # another kept word of the text comes after it
    follows[:-1] = np.searchsorted(bounds, kept[1:], "right") == np.searchsorted(bounds, kept[:-1], "right")
    spaces = ends[kept[follows]]
    data = block.data.copy()
    data[spaces] = 32
    inside[spaces] = True
    cuts = np.concatenate([[0], np.cumsum(inside)])[block.offsets]
    raw = data[inside].tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of keep_first_windows."""
    kept = keep_first_windows(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
