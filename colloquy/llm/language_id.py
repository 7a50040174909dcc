"""Language ID: a linear-chain conditional random field labels every word of a text, code-switched or not.

A word's features are its hash (lexicon), prefixes and suffixes of two and three bytes and inner byte trigrams, all hashed
into one weight table; transitions are learned along with them. Forward-backward runs over whole texts: texts are cut into
segments whose transfer matrices are multiplied first, so long texts cost no more steps than short ones. A text's language
is the one with the largest sum of word marginals.

Training takes all labelled training texts in one distributed round: each task makes gradient updates over its texts, with
the text's language as the label of its words, and the tasks' tables are averaged by words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.textarrays import Block, blocks, mix
from colloquy.storage import bound_batches

FEATURES, KINDS = 1 << 15, 7
SEGMENT, MINIBATCH_WORDS, RATE = 64, 16_384, 0.5
#: Text that one trainer reads at least, and trainers at most; each sends one weight table.
TRAINER_BYTES, TRAINERS = 8_000_000, 8192
_SLICES = 64
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_ANY_LETTER = re.compile(r"[^\W\d_]")


def word_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows (KINDS, words), which words have a letter, and word bounds by text."""
    starts, ends, bounds = block.words()
    if not len(starts):
        return np.zeros((KINDS, 0), np.int64), np.zeros(0, bool), bounds
    lower = block.data.copy()
    lower[(lower >= 65) & (lower <= 90)] += 32
    size = ends - starts
    room = np.concatenate([lower, np.zeros(4, np.uint8)]).astype(np.uint64)

    def at(place: np.ndarray, inside: np.ndarray, shift: int) -> np.ndarray:
        return np.where(inside, room[np.clip(place, 0, len(room) - 1)] + np.uint64(1), np.uint64(0)) << np.uint64(shift)

    middle = starts + np.maximum(size // 2 - 1, 0)
    first, second, third = (at(starts + j, size > j, 16 * j) for j in range(3))
    last, before, third_last = (at(ends - 1 - j, size > j, 16 * j) for j in range(3))
    inner = sum(at(starts + 1 + j, size > 1 + j, 16 * j) for j in range(3))
    centre = sum(at(middle + j, middle + j < ends, 16 * j) for j in range(3))
    kinds = [block.word_hashes(starts, ends), first + second, first + second + third, last + before, last + before + third_last, inner, centre]
    rows = np.stack([(mix(x + np.uint64(i << 56)) % np.uint64(FEATURES)).astype(np.int64) for i, x in enumerate(kinds)])
    letters = np.concatenate([[0], np.cumsum(_LETTER[block.data])])
    return rows, letters[ends] > letters[starts], bounds


class Model:
    """Weights of features and transitions between the labels."""

    def __init__(self, labels: int, weights: np.ndarray | None = None):
        self.labels = labels
        self.flat = np.zeros(FEATURES * labels + labels * labels, np.float32) if weights is None else weights
        self.emit, self.move = self.flat[: FEATURES * labels].reshape(FEATURES, labels), self.flat[FEATURES * labels :].reshape(labels, labels)

    def marginals(self, rows: np.ndarray, letters: np.ndarray, bounds: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Marginal label probabilities of each word, and, if asked for, the expected number of each transition."""
        k = self.labels
        score = self.emit[rows].sum(0) * letters[:, None]
        words = np.diff(bounds)
        parts = -(-words // SEGMENT)
        first = np.concatenate([[0], np.cumsum(parts)])
        part = np.arange(first[-1]) - np.repeat(first[:-1], parts)
        begin = np.repeat(bounds[:-1], parts) + part * SEGMENT
        size = np.minimum(np.repeat(bounds[1:], parts) - begin, SEGMENT)
        place = begin[:, None] + np.arange(SEGMENT)
        real = np.arange(SEGMENT) < size[:, None]
        place = np.where(real, place, 0)
        e = np.where(real[:, :, None], np.exp(score - score.max(1, keepdims=True))[place], 1).astype(np.float32)
        a = np.exp(self.move - self.move.max())
        steps = int(size.max(initial=0))
        whole = np.broadcast_to(np.eye(k, dtype=np.float32), (len(size), k, k)).copy()
        for t in range(steps):
            new = (whole @ a) * e[:, t, None, :]
            whole = np.where(real[:, t, None, None], new / new.max((1, 2), keepdims=True), whole)
        inward, outward = (np.full((len(size), k), 1 / k, np.float32) for _ in range(2))
        for j in range(int(parts.max(initial=0)) - 1):
            now = first[:-1][parts > j + 1] + j
            x = np.einsum("si,sij->sj", inward[now], whole[now])
            inward[now + 1] = x / x.sum(1, keepdims=True)
            later = first[1:][parts > j + 1] - 1 - j
            y = np.einsum("sij,sj->si", whole[later], outward[later])
            outward[later - 1] = y / y.sum(1, keepdims=True)
        forward = np.empty((steps + 1, len(size), k), np.float32)
        forward[0] = inward
        for t in range(steps):
            x = (forward[t] @ a) * e[:, t]
            forward[t + 1] = np.where(real[:, t, None], x / x.sum(1, keepdims=True), forward[t])
        out = np.zeros((len(score), k), np.float32)
        moves, b = np.zeros((k, k)), outward
        for t in range(steps - 1, -1, -1):
            now = real[:, t]
            m = forward[t + 1] * b
            out[place[now, t]] = (m / m.sum(1, keepdims=True))[now]
            eb = e[:, t] * b
            if expect:
                pair = forward[t][:, :, None] * a * eb[:, None, :]
                moves += (pair / pair.sum((1, 2), keepdims=True))[now].sum(0)
            y = eb @ a.T
            b = np.where(now[:, None], y / y.sum(1, keepdims=True), b)
        return out, moves

    def update(self, squares: np.ndarray, rows: np.ndarray, letters: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> None:
        """One AdaGrad step on some texts with labels."""
        expected, moves = self.marginals(rows, letters, bounds, expect=True)
        words = np.diff(bounds)
        error = expected.astype(float)
        error[np.arange(len(error)), np.repeat(label, words)] -= 1
        error *= letters[:, None]
        flat = rows.ravel()
        change = np.concatenate([np.stack([np.bincount(flat, np.tile(error[:, j], KINDS), FEATURES) for j in range(self.labels)], 1).ravel(), (moves - np.diag(np.bincount(label, words, self.labels))).ravel()])
        squares += change * change
        self.flat -= (RATE * change / np.sqrt(squares + 1)).astype(np.float32)


def train(docs: DataFrame, languages: list[str]) -> Model:
    """A model of docs(text, lang), all read once."""
    number = {x: i for i, x in enumerate(languages)}
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = Model(len(languages)), 0
        squares = np.zeros(len(model.flat))
        for batch in batches:
            label = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for block in blocks(batch.column(0)):
                rows, letters, bounds = word_features(block)
                lo = 0
                while lo < block.n:
                    hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + MINIBATCH_WORDS, "right")) - 1)
                    s = slice(bounds[lo], bounds[hi])
                    if bounds[hi] > bounds[lo]:
                        model.update(squares, rows[:, s], letters[s], bounds[lo : hi + 1] - bounds[lo], label[block.first + lo : block.first + hi])
                    lo = hi
                n += len(letters)
        cuts = np.linspace(0, len(model.flat), _SLICES + 1).astype(int)
        parts = [(model.flat[a:b] * n).astype(np.float32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([n] * _SLICES, pa.int64()), pa.array(parts, pa.binary())], names=["slice", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = sums.setdefault(i, [0, 0.0])
                one[0], one[1] = one[0] + n, one[1] + np.frombuffer(raw, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["slice", "n", "sums"])

    kind = "slice int, n long, sums binary"
    trainers = max(1, min(TRAINERS, size // TRAINER_BYTES))
    sent = docs.select("text", "lang").coalesce(trainers).mapInArrow(run, kind)
    rows = {r["slice"]: r for r in sent.repartition(_SLICES, "slice").mapInArrow(add, kind).collect()}  # one weight table
    flat = np.concatenate([np.frombuffer(rows[i]["sums"], np.float32) for i in range(_SLICES)])
    return Model(len(languages), flat / np.float32(max(rows[0]["n"], 1)))


def label_texts(docs: DataFrame, model: Model, languages: list[str]) -> DataFrame:
    """doc_id, lang_pred, score and switches (word number and label wherever the label of words changes) for docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model.flat)
    names = np.array([*languages, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(len(languages), held.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows, letters, bounds = word_features(block)
                p, _ = own.marginals(rows, letters, bounds)
                p = p * letters[:, None]
                sums = np.diff(np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0, dtype=float)])[bounds], axis=0)
                n = np.diff(np.concatenate([[0], np.cumsum(letters)])[bounds])
                raw = block.data.tobytes()
                known = np.array([bool(_ANY_LETTER.search(raw[a:b].decode())) for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)], bool)
                best = np.where(known, np.argmax(sums, 1), len(languages))
                score = np.where(known, np.clip(sums.max(1) / np.maximum(n, 1), 0, 1), 0.0)
                label = np.where(letters, np.argmax(p, 1) if len(p) else 0, -1)
                seen = np.flatnonzero(letters)
                text = np.repeat(np.arange(block.n), np.diff(bounds))[seen]
                turn = np.ones(len(seen), bool)
                turn[1:] = (label[seen][1:] != label[seen][:-1]) | (text[1:] != text[:-1])
                where = seen[turn]
                offsets = np.searchsorted(text[turn], np.arange(block.n + 1))
                change = pa.StructArray.from_arrays([pa.array(where - bounds[text[turn]], pa.int64()), pa.array(names[label[where]], pa.string())], ["word", "lang"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(names[best], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), change)], names=["doc_id", "lang_pred", "score", "switches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, switches array<struct<word: long, lang: string>>")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of doc_id as text leaves 1 by 3. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and switches for each row of docs(doc_id, text, lang); other columns are ignored.

    lang teaches only rows that aren't held out and have one. A text that is null or without a letter is `und` with score 0;
    so is every text if there is nothing to learn from. score is the mean marginal of lang_pred over words with letters.
    Repeated rows get equal answers. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # as many as there are languages
    mark = held_out(F.col("doc_id")).alias("held_out")
    if not languages:
        return docs.select("doc_id", mark, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<word: bigint, lang: string>>)").alias("switches"))
    found = label_texts(docs, train(rows, languages), languages)
    return found.select("doc_id", mark, "lang_pred", "score", "switches")
