"""Cross-tokenizer alignment: distinct segments are encoded and aligned once, documents are put together from them.

A text is cut before runs of white space that begin with a character which no token of either vocabulary holds behind
something else, so neither tokenizer merges across a cut and the ids of a text are those of its segments.

1. Batches of documents shrink to numbers of their distinct segments; a segment's hash names the shard that owns it.
2. A shard encodes each of its distinct segments once by both tokenizers, cuts it into groups where tokens of both end, and
   counts its links (the two tokens that end a group) over all occurrences.
3. Pairs of ids are counted over all shards, and go back to the shards that hold them.
4. Shards answer batches, and batches put their documents together.

What a batch asks of a shard, and the answer, are one compressed row. A segment that all documents hold is asked for once by
each batch of up to WORDS_TOGETHER words, not once for each occurrence.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.textarrays import release_memory
from colloquy.storage import bound_batches, materialize

#: A batch ends once it holds so many distinct segments, or words. Bytes of text for each shard of segments.
SEGMENTS_TOGETHER, WORDS_TOGETHER, BYTES_A_SHARD = 400_000, 8_000_000, 16_000_000
ALIGNED_TOGETHER = 4_000
#: White space as the byte-level tokenizer's pattern means it.
_BLANK = "\t\n\x0b\x0c\r "
_WIDE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.escape(_BLANK) + _WIDE
_MARK = "▁"
#: Of each batch a row with its documents (shard -1), and one for each shard with the segments that it asks for, numbered from begin.
_BATCH = "batch long, shard int, begin int, docs array<long>, sizes array<int>, body binary"
#: Of each shard a row with its alignments and links (batch -1), and one for each batch with the places of what it asked for.
_SHARD = "shard int, batch long, begin int, body binary, a array<int>, b array<int>, n array<long>, bad array<int>"
_ANSWER = "batch long, begin int, body binary"
_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {} string"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _packed(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.ZstdCompressor(3).compress(np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw))


def _unpacked(body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n, 8))])
    return [raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.fromiter(map(len, texts), np.int32, len(texts)), b"".join(texts)


def _split(lengths: bytes, raw: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, np.int32), dtype=np.int64).tolist()
    return [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]


def _byte_alphabet() -> dict[str, int]:
    """Bytes of the characters in which byte-level vocabularies are written: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}


class TokenizerPair:
    """A byte-level tokenizer (A), which gets a space and the text, and a piece tokenizer (B), which puts that space there itself."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.mark = self.b.piece_to_id(_MARK)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode()

    @cached_property
    def openers(self) -> str:
        """ASCII white space before which texts may be cut: no token of A or B holds it behind anything but white space, nor, as B puts a space before what it gets, one of B behind a space."""

        a_tokens, b_tokens = ([t.decode(errors="replace") for t in tokens if len(t) > 1] for tokens in (self.a_bytes, self.b_bytes))

        def whole(c: str) -> bool:
            behind = re.compile(f"[^{_SPACE}]{re.escape(c)}")
            after_space = behind if c == " " else re.compile(f"(?:[^{_SPACE}]| ){re.escape(c)}")
            return not any(map(behind.search, a_tokens)) and not any(map(after_space.search, b_tokens))

        return "".join(filter(whole, _BLANK))

    @cached_property
    def cuts(self) -> re.Pattern:
        """Finds the segments of a text: white space, what follows it, and more of both while the white space may not be cut."""
        if not self.openers:
            return re.compile("(?s:.+)")
        held = re.escape("".join(c for c in _BLANK if c not in self.openers)) + _WIDE
        return re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:[{held}][{_SPACE}]*[^{_SPACE}]*)*|[{_SPACE}]+")

    def segments(self, text: str | None) -> list[str]:
        """Segments of a space and the text; none of an empty text, nor of one with a U+2581, which B can't tell from a space."""
        return [] if not text or _MARK in text else self.cuts.findall(" " + text)

    def ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s == " ":
                b[i] = [self.mark]
            elif s[0] != " ":  # the space that B puts before it is a token of its own here
                b[i] = b[i][1:]
        return a, b

    def align(self, segments: list[str]) -> list[tuple[int, int, int, str | None, list[int], list[int]]]:
        """n_a, n_b, n_groups, groups and the linked ids of A and B for each segment; -1, -1, 0 and nothing where the tokens' bytes aren't the segment's."""
        a, b = self.ids(segments)
        raw = [s.encode() for s in segments]
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = [b"".join(map(a_bytes, x)) == r == b"".join(map(b_bytes, y)) for x, y, r in zip(a, b, raw, strict=True)]
        out: list = [(-1, -1, 0, None, [], [])] * len(segments)
        kept = [i for i, g in enumerate(good) if g]
        flat_a, flat_b = [t for i in kept for t in a[i]], [t for i in kept for t in b[i]]
        ends_a = np.cumsum([len(a_bytes(t)) for t in flat_a])
        ends_b = np.cumsum([len(b_bytes(t)) for t in flat_b])
        both = np.intersect1d(ends_a, ends_b)
        last_a, last_b = (np.searchsorted(ends, both, "right") - 1 for ends in (ends_a, ends_b))
        text_a, text_b = list(map(str, flat_a)), list(map(str, flat_b))
        groups, p, q = [], 0, 0
        for i, j in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            groups.append(",".join(text_a[p:i]) + "|" + ",".join(text_b[q:j]))
            p, q = i, j
        link_a, link_b = [flat_a[i] for i in last_a], [flat_b[j] for j in last_b]
        stops = np.searchsorted(both, np.cumsum([len(raw[i]) for i in kept]), "right").tolist()
        at = 0
        for i, stop in zip(kept, stops, strict=True):
            out[i] = (len(a[i]), len(b[i]), stop - at, ";".join(groups[at:stop]), link_a[at:stop], link_b[at:stop])
            at = stop
        return out


@cache
def tokenizer_pair(a_path: str, b_path: str) -> TokenizerPair:
    return TokenizerPair(a_path, b_path)


def _batch_rows(batch: int, docs: list[int | None], sizes: list[int], codes: np.ndarray, segments: list[bytes], shards: int) -> list[tuple]:
    """Rows of _BATCH: segments in the order of their shards, each shard's with lengths and counts in this batch."""
    shard = np.fromiter((zlib.crc32(s) % shards for s in segments), np.int64, len(segments))
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    codes = place[codes]
    counts = np.bincount(codes, minlength=len(order))
    rows = [(batch, -1, len(order), docs, sizes, _packed(codes.astype(np.int32)))]
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        rows.append((batch, int(shard[order[x]]), x, None, None, _packed(*_joined([segments[i] for i in order[x:y]]), counts[x:y])))
    return rows


_BATCH_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())


def segment_batches(docs: DataFrame, a_path: str, b_path: str, shards: int) -> DataFrame:
    """The rows of _BATCH of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = tokenizer_pair(a_path, b_path).segments
        task, serial = TaskContext.get().partitionId() << 32, count()

        def close() -> pa.RecordBatch:
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            rows = _batch_rows(task + next(serial), ids, sizes, flat, [s.encode() for s in numbers], shards)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _BATCH_KINDS, strict=True)], names=_names(_BATCH))

        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        ids, sizes, codes, words = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = find(text.as_py())
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(doc)
                sizes.append(len(found))
                words += len(found)
                if len(numbers) >= SEGMENTS_TOGETHER or words >= WORDS_TOGETHER:
                    yield close()
                    numbers = defaultdict(count().__next__)
                    ids, sizes, codes, words = [], [], [], 0
                    release_memory()
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BATCH)


def aligned_shards(batches: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The rows of _SHARD: each distinct segment of a shard is aligned once, however many batches ask for it."""
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))

    def run(table: pa.Table) -> pa.Table:
        pair = tokenizer_pair(a_path, b_path)
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        shard, asked, times = table["shard"][0].as_py(), [], []
        for batch, begin, body in zip(table["batch"].to_pylist(), table["begin"].to_pylist(), table["body"], strict=True):
            lengths, raw, counts = _unpacked(body.as_py())
            found = _split(lengths, raw)
            asked.append((batch, begin, np.fromiter(map(number.__getitem__, found), np.int32, len(found))))
            times.append(np.frombuffer(counts, np.int64))
        segments, n = list(number), np.zeros(len(number), np.int64)
        del number
        for (_, _, codes), counts in zip(asked, times, strict=True):
            n[codes] += counts  # codes of one batch are distinct
        sums, groups, links = [], [], []
        for i in range(0, len(segments), ALIGNED_TOGETHER):
            found = pair.align([s.decode() for s in segments[i : i + ALIGNED_TOGETHER]])
            sums.append(np.array([r[:3] for r in found], np.int32))
            groups.append(_joined([(r[3] or "").encode() for r in found]))
            links.append(np.array([[x for r in found for x in r[4]], [x for r in found for x in r[5]]], np.int32).reshape(2, -1))
        sums, links = np.concatenate(sums), np.concatenate(links, 1)
        keys, back = np.unique(links[0].astype(np.int64) << 32 | links[1], return_inverse=True)
        weight = np.zeros(len(keys), np.int64)
        np.add.at(weight, back, np.repeat(n, sums[:, 2]))
        body = _packed(np.ascontiguousarray(sums.T), np.concatenate([g[0] for g in groups]), b"".join(g[1] for g in groups), links)
        rows = [(shard, -1, 0, body, keys >> 32, keys & 0xFFFFFFFF, weight, None)]
        bad = sums[:, 0] < 0
        for batch, begin, codes in asked:
            odd = np.flatnonzero(bad[codes] & (n[codes] > 0)) + begin
            rows.append((shard, batch, begin, _packed(codes), None, None, None, odd if len(odd) else None))
        release_memory()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(_SHARD))

    return batches.filter("shard >= 0").select("shard", "batch", "begin", "body").groupBy("shard").applyInArrow(run, _SHARD)


def answered(shards: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of _ANSWER: sums and groups of the segments that a batch asked a shard for. known: (of, a, b, count, is_best) for each shard's pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batch, begin, body = left["batch"].to_pylist(), left["begin"].to_pylist(), left["body"].to_pylist()
        own = batch.index(-1)
        sums, lengths, raw, links = _unpacked(body[own])
        sums = np.frombuffer(sums, np.int32).reshape(3, -1).astype(np.int64)
        links = np.frombuffer(links, np.int32).reshape(2, -1).astype(np.int64)
        groups = _split(lengths, raw)
        keys = right["a"].to_numpy().astype(np.int64) << 32 | right["b"].to_numpy()
        order = np.argsort(keys)
        at = order[np.searchsorted(keys[order], links[0] << 32 | links[1])] if links.size else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sums[2])])
        more = [np.diff(np.concatenate([[0], np.cumsum(right[c].to_numpy()[at])])[ends]) for c in ("is_best", "count")]
        every = np.stack([*sums, *more])
        rows = []
        for k, (b, x, raw_codes) in enumerate(zip(batch, begin, body, strict=True)):
            if k != own:
                codes = np.frombuffer(_unpacked(raw_codes)[0], np.int32)
                rows.append((b, x, _packed(np.ascontiguousarray(every[:, codes]), *_joined([groups[c] for c in codes.tolist()]))))
        release_memory()
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=_names(_ANSWER))

    return shards.select("shard", "batch", "begin", "body").groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(run, _ANSWER)


def _codes(body: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Segment numbers of a batch's documents one behind the other, and where each document begins."""
    return np.frombuffer(_unpacked(body)[0], np.int32), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])


def without_odd_documents(batches: DataFrame, bad: DataFrame, shards: int) -> DataFrame:
    """batches anew, with no segments left of documents that hold a bad one; bad: (of, pos)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, segments = left.to_pylist(), []
        for row in sorted(rows, key=lambda r: (r["shard"] >= 0, r["begin"])):
            if row["shard"] < 0:
                own = row
            else:
                lengths, raw, _ = _unpacked(row["body"])
                segments += _split(lengths, raw)
        codes, bounds = _codes(own["body"], own["sizes"])
        odd = np.zeros(own["begin"], bool)
        odd[right["pos"].to_numpy()] = True
        gone = np.diff(np.concatenate([[0], np.cumsum(odd[codes])])[bounds]) > 0
        sizes = np.where(gone, 0, own["sizes"]).tolist()
        out = _batch_rows(own["batch"], own["docs"], sizes, codes[np.repeat(~gone, np.diff(bounds))], segments, shards)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _BATCH_KINDS, strict=True)], names=_names(_BATCH))

    hit = bad.select("of").distinct()
    changed = batches.join(hit, F.col("batch") == F.col("of"), "left_semi").groupBy("batch").cogroup(bad.groupBy("of")).applyInArrow(run, _BATCH)
    return batches.join(hit, F.col("batch") == F.col("of"), "left_anti").unionByName(changed)


def composed(batches: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """A row of _DIGEST for each document, from its batch and the alignments of that batch's segments."""
    kinds = [pa.int64()] * 7 + [pa.string()]
    hashed = column.endswith("sha256")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        codes, bounds = _codes(row["body"], row["sizes"])
        parts, groups = [], []
        for body in right.sort_by("begin")["body"]:
            sums, lengths, raw = _unpacked(body.as_py())
            parts.append(np.frombuffer(sums, np.int64).reshape(5, -1))
            groups += [g.decode() for g in _split(lengths, raw)]
        every = np.concatenate(parts, 1) if parts else np.zeros((5, 0), np.int64)
        out: list = [row["docs"]]
        for k in (0, 1, 2, 2, 3, 4):
            out.append(np.diff(np.concatenate([[0], np.cumsum(every[k][codes])])[bounds]))
        texts = (";".join(map(groups.__getitem__, codes[x:y].tolist())) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        out.append([hashlib.sha256(t.encode()).hexdigest() if hashed and t else t for t in texts])
        table = pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=_names(_DIGEST.format(column)))
        release_memory()
        return table

    own = batches.filter("shard < 0").select("batch", "docs", "sizes", "body")
    return own.groupBy("batch").cogroup(answers.select(F.col("batch").alias("of"), "begin", "body").groupBy("of")).applyInArrow(run, _DIGEST.format(column))


def align_documents(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", digest: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (or groups, in full) of each row of docs(doc_id, text); other columns are ignored.

    a and b are names of public tokenizer files. Texts that are null or empty, and those that a tokenizer can't give back
    byte by byte, have no tokens: all zero, and an empty last column; they count for no link either. Rows that repeat a
    doc_id, null ones too, are documents of their own. Texts without white space are one segment, whatever their length. An
    empty table gives no rows.
    """
    import public_tokenizers

    paths = public_tokenizers.path(a), public_tokenizers.path(b)
    bound_batches(docs.sparkSession)
    shards = max(16, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_SHARD)
    batches = materialize(segment_batches(docs, *paths, shards), "batches")
    owned = materialize(aligned_shards(batches, *paths), "shards")
    bad = owned.filter("bad is not null").select((F.col("batch") + 0).alias("of"), F.explode("bad").alias("pos"))
    if bad.limit(1).count():
        batches = materialize(without_odd_documents(batches, bad, shards), "batches")
        owned = materialize(aligned_shards(batches, *paths), "shards")
    pairs = owned.filter("batch < 0").select((F.col("shard") + 0).alias("of"), F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("of", "p.*")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    best = counts.groupBy("b").agg(F.max("count").alias("best"))
    known = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("best")).cast("long").alias("is_best"))
    answers = answered(owned, pairs.drop("n").join(known, ["a", "b"]))
    return composed(batches, answers, "groups_sha256" if digest else "groups")
