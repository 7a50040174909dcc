"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, and counts of n-grams and skips on top of it.

A token is a word in lower case, or the end of a text. Its probability is that of its class times its own within the class.
Words of up to three bytes fall into classes by hash, longer ones by their last two bytes, so classes need no table.
Both factors depend on the tokens before. Their base is a softmax over hashed features of the previous token and the one
before it (skip) for the class, and counts of all training tokens for the word in its class. Then both are drawn towards
what followed the previous token in all training texts: the class to (n(previous, class) + S p(class)) / (n(previous) + S),
the word in it to (n(previous, word) + S p(word)) / (n(previous, class) + S p(class)), where p(word) = p(class) p(word | class).
Classes, and the words of a class, go on to sum to 1. In the product the counts of context and class cancel, so none is made.

The softmax is trained in rounds. In each, every task starts from the same weights and makes gradient updates over its
share of the training texts; the changes are averaged, weighted by tokens, and every training text is used in one round.
Its table has a fixed size. The counts have not: they grow with the training tokens and are never broadcast. Each block of
texts sends its distinct words and contexts, as hashes, to shards; a shard sums them and sends the sums back to the block. Counts go by 48 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.textarrays import Block, blocks, mix, release_memory
from colloquy.storage import bound_batches, materialize

CLASSES, SHORT = 64, 24
#: Rows of the weight table: previous word, word before it (skip), classes of both; the last row is the bias.
PREVIOUS, SKIP = 2048, 1024
FEATURES = PREVIOUS + SKIP + CLASSES * 16 + 1
ROUNDS, RATE, MINIBATCH = 2, 0.3, 8192
#: Text that one trainer reads at least, and trainers at most; each sends one weight table.
TRAINER_BYTES, TRAINERS = 8_000_000, 8192
#: Occurrences that the estimate a context starts from is worth; of 20, 200 and 2,000 the best on held-out rows at sf0.1.
STRENGTH = 2000.0
_SLICES = 64
_END, _START = (mix(np.array([x], np.uint64))[0] for x in (1, 2))
_SHARD_BYTES, _BLOCK_BYTES = 6_000_000, 2_000_000
_KEY = np.uint64((1 << 48) - 1)
#: The keys of a token that are counted; the other one is a word that was counted at its own place.
_COUNTED = [0, 2]
#: Marks keys that are no words.
_CONTEXT = 255


class Tokens:
    """The tokens of a block: hash, class and feature rows of each; text i has the tokens bounds[i]:bounds[i + 1]."""

    def __init__(self, block: Block):
        starts, ends, cuts = block.words()
        n = len(starts) + block.n
        self.bounds = cuts + np.arange(block.n + 1)
        last = self.bounds[1:] - 1
        word = np.ones(n, bool)
        word[last] = False
        self.hash = np.full(n, _END)
        self.hash[word] = block.word_hashes(starts, ends)
        lower = block.data.copy()
        lower[(lower >= 65) & (lower <= 90)] += 32
        long = ends - starts > 3
        tail = lower[ends - 1].astype(np.uint64) * np.uint64(256) + lower[np.maximum(ends - 2, 0)] if len(ends) else np.zeros(0, np.uint64)
        own = np.where(long, SHORT + (mix(tail) % np.uint64(CLASSES - 1 - SHORT)).astype(np.int64), (self.hash[word] % np.uint64(SHORT)).astype(np.int64))
        self.cls = np.full(n, CLASSES - 1)
        self.cls[word] = own
        first = self.bounds[:-1]
        self.one = one = self._before(self.hash, first, _START)
        two = self._before(one, first, _START)
        c1 = self._before(self.cls, first, CLASSES - 1)
        c2 = self._before(c1, first, CLASSES - 1)
        self.rows = np.stack([(one % np.uint64(PREVIOUS)).astype(np.int64), PREVIOUS + (mix(two) % np.uint64(SKIP)).astype(np.int64), PREVIOUS + SKIP + c1 * 16 + (c2 * 7 + c1) % 16])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and the places among them of three keys of each token: its word, the previous word, that with the word."""
        after = mix(mix(self.one + np.uint64(5)) * np.uint64(0xA0761D6478BD642F) + self.hash)
        # what follows a word is counted by the word, what begins a text by the ends of texts
        own = [x & _KEY for x in (self.hash, np.where(self.one == _START, _END, self.one), after)]
        coded = pa.array(np.concatenate(own)).dictionary_encode()  # cheaper than sorting all
        found, places = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        order = np.argsort(found)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return found[order], rank[places].reshape(len(own), -1)

    @staticmethod
    def _before(x: np.ndarray, first: np.ndarray, start) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[first] = start
        return out


def _odds(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Unnormalised logarithms of the class probabilities of each token, at most 0."""
    x = weights[rows[0]]
    x += weights[rows[1]]
    x += weights[rows[2]]
    x += weights[-1]
    x -= x.max(1, keepdims=True)
    return x


def log_classes(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural logarithms of the class probabilities of each token."""
    x = _odds(weights, rows)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def log_class(weights: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's own class."""
    x = _odds(weights, rows)
    own = x[np.arange(len(cls)), cls]
    return own - np.log(np.exp(x, out=x).sum(1))


def update(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> None:
    """One AdaGrad step on a minibatch, in place."""
    error = _odds(weights, rows)
    np.exp(error, out=error)
    error /= error.sum(1, keepdims=True)
    error[np.arange(len(cls)), cls] -= 1

    def step(at, sums: np.ndarray) -> None:
        squares[at] += sums * sums
        weights[at] -= RATE * sums / np.sqrt(squares[at] + 1.0)

    for own in rows:
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order], prepend=-1))
        step(own[order[cuts]], np.add.reduceat(error[order], cuts, axis=0))
    step(FEATURES - 1, error.sum(0))


def train_round(docs: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Weights after every task has gone over its share of docs(text): the mean of their results, by tokens."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares, n = held.value.copy(), np.zeros_like(held.value), 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                tokens = Tokens(block)
                for at in range(0, len(tokens.cls), MINIBATCH):
                    s = slice(at, at + MINIBATCH)
                    update(own, squares, tokens.rows[:, s], tokens.cls[s])
                n += len(tokens.cls)
        if n:
            change = ((own - held.value) * n).astype(np.float32).ravel()
            cuts = np.linspace(0, len(change), _SLICES + 1).astype(int)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([n] * _SLICES, pa.int64()), pa.array([change[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["slice", "n", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = sums.setdefault(i, [0, 0.0])
                one[0], one[1] = one[0] + n, one[1] + np.frombuffer(raw, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["slice", "n", "change"])

    kind = "slice int, n long, change binary"
    sent = docs.select("text").coalesce(max(1, min(TRAINERS, size // TRAINER_BYTES))).mapInArrow(run, kind)
    rows = {r["slice"]: r for r in sent.repartition(_SLICES, "slice").mapInArrow(add, kind).collect()}  # one weight table
    if not rows:
        return weights
    change = np.concatenate([np.frombuffer(rows[i]["change"], np.float32) for i in range(_SLICES)])
    return weights + change.reshape(weights.shape) / np.float32(rows[0]["n"])


def train(docs: DataFrame) -> np.ndarray:
    """Weights learned from all of docs(doc_id, text); zeros, that is equal classes, if there are none."""
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    for i in range(ROUNDS):
        weights = train_round(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == i), weights)
    return weights


def _pack(x: np.ndarray) -> bytes:
    """Bytes of one rank side by side: those that are mostly zero take no room once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _text_blocks(docs: DataFrame) -> DataFrame:
    """Rows of a batch number, ids, held_out (b), compressed bytes (c) and offsets (d) of texts that are worked on together."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for block in blocks(batch.column(1), _BLOCK_BYTES):
                texts = slice(block.first, block.first + block.n)
                row = (key, batch.column(0).slice(block.first, block.n).to_pylist(), held[texts].tobytes(), pa.compress(block.data.tobytes(), codec="zstd", asbytes=True), block.offsets.astype("<i8").tobytes())
                key += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3], strict=True)], names=["batch", "ids", "b", "c", "d"])

    return docs.mapInArrow(cut, "batch long, ids array<long>, b binary, c binary, d binary")


def _tokens(c: bytes, d: bytes) -> Tokens:
    offsets = np.frombuffer(d, "<i8")
    return Tokens(Block(0, np.frombuffer(pa.decompress(c, int(offsets[-1]), codec="zstd"), np.uint8) if offsets[-1] else np.zeros(0, np.uint8), offsets))


def _sum_by_key(texts: DataFrame, shards: int) -> DataFrame:
    """Rows of shards (a: what the keys sent by a block count in training) and of sums by class."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                key, _, held, c, d = (x[r].as_py() for x in batch.columns)
                tokens = _tokens(c, d)
                keys, places = tokens.keys()
                train = np.repeat(~np.frombuffer(held, bool), np.diff(tokens.bounds))
                times = np.bincount(places[_COUNTED][:, train].ravel(), minlength=len(keys)).astype("<u4")
                kinds = np.full(len(keys), _CONTEXT, np.uint8)
                kinds[places[0]] = tokens.cls
                shard = ((keys >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # keys are sorted, so shards are
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                out = [(int(i), key, _pack(np.diff(keys[cuts[i] : cuts[i + 1]], prepend=np.uint64(0))), _pack(times[cuts[i] : cuts[i + 1]]), kinds[cuts[i] : cuts[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(cuts))]
                del tokens, keys, places, train, times, kinds, shard
                release_memory()
                types = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], k) for j, k in enumerate(types)], names=["shard", "batch", "keys", "times", "kinds"])

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.cumsum(_unpack(r["keys"], "<u8"), dtype=np.uint64) for r in rows])
        times = np.concatenate([_unpack(r["times"], "<u4") for r in rows])
        kinds = np.frombuffer(b"".join(r["kinds"] for r in rows), np.uint8)
        found, first, place = np.unique(keys, return_index=True, return_inverse=True)
        del keys
        count, kind = np.bincount(place, weights=times, minlength=len(found)), kinds[first]
        words = kind < CLASSES
        sums = [np.bincount(kind[words], weights=x[words], minlength=CLASSES) for x in (count, count > 0)]
        out, at = [(rows[0]["shard"], None, np.concatenate(sums).tolist(), None)], 0
        for r in rows:
            many = len(r["kinds"])
            out.append((r["shard"], r["batch"], None, _pack(count[place[at : at + many]].astype("<i8"))))
            at += many
        del rows, times, kinds, found, first, place, count, kind, words
        release_memory()
        types = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.binary()]
        return pa.table([pa.array([x[j] for x in out], k) for j, k in enumerate(types)], names=["shard", "batch", "sums", "a"])

    sent = texts.mapInArrow(deal, "shard int, batch long, keys binary, times binary, kinds binary")
    return sent.groupBy("shard").applyInArrow(meet, "shard int, batch long, sums array<double>, a binary")


def log_scores(tokens: Tokens, weights: np.ndarray, count: np.ndarray, n_class: np.ndarray, v_class: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token. count has what the three keys of each count in training, n_class and v_class tokens and distinct words by class."""
    n = len(tokens.cls)
    logs = np.concatenate([log_class(weights, tokens.rows[:, a : a + MINIBATCH], tokens.cls[a : a + MINIBATCH]) for a in range(0, n, MINIBATCH)])
    p = np.exp(logs.astype(float)) * (count[0] + 0.5) / (n_class + 0.5 * (v_class + 1))[tokens.cls]
    return np.log10((count[2] + STRENGTH * p) / (count[1] + STRENGTH))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores each row of docs(doc_id, text) whole; other columns are ignored. Learns from rows whose crc32 of doc_id as text doesn't leave 1 by 5.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams) and score (this model), both
    as log10 of a probability. A null text counts as empty: its one token is the end. A null doc_id isn't held out. Repeated
    rows count, and are scored, one by one. Without training rows all classes are equal. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    weights = train(docs.filter("not held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = materialize(_text_blocks(docs), "texts")
    rows = materialize(_sum_by_key(texts, max(48, size // _SHARD_BYTES)), "sums")
    sums = np.zeros(2 * CLASSES)
    for r in rows.filter("sums is not null").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        sums[r["k"]] = r["x"]
    n_class, v_class = sums[:CLASSES], sums[CLASSES:]
    n = int(n_class.sum())
    base = np.log10(n + 0.5 * (v_class.sum() + 1))
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["b"] is not None)
        own = sorted((r for r in rows if r["b"] is None), key=lambda r: r["shard"])
        ids, held = head["ids"], np.frombuffer(head["b"], bool)
        tokens = _tokens(head["c"], head["d"])
        count = np.concatenate([_unpack(r["a"], "<i8") for r in own])[tokens.keys()[1]]
        first, size = tokens.bounds[:-1], np.diff(tokens.bounds)
        known = np.add.reduceat((count[0] > 0).astype(np.int64), first)
        gain = np.add.reduceat(np.log10(count[0] + 0.5), first)
        score = np.add.reduceat(log_scores(tokens, model.value, count, n_class, v_class), first)
        del table, rows, head, own, tokens, count, first
        release_memory()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(size), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(ids), n)), "base_score": pa.array(gain - size * base), "score": pa.array(score)})

    back = rows.filter("sums is null").drop("sums").unionByName(texts, allowMissingColumns=True)
    return back.groupBy("batch").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
