"""Secret scans: patterns for well-known secrets, and character Markov models for the rest.

Two first-order character models are trained from labelled samples. Random: the values that the patterns find in the corpus,
and strings drawn from the alphabets of keys. Ordinary: the shorter runs and the words of any length in the corpus, and
identifiers and paths that are put together, in every usual spelling, from common programming words. A run of at least 16 characters, not
digits alone, outside the patterns' spans becomes a secret when the log-likelihood ratio of the two models is high enough.
Training counts are sums over all texts, in a table whose size is fixed by the alphabet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.textarrays import Block, parts
from colloquy.storage import bound_batches

# Kinds in their order, patterns and least lengths.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Runs of so many characters are judged; shorter ones, of 8 and more, are the samples of ordinary strings.
CANDIDATE = 16
#: Text that is scanned at once.
TOGETHER_BYTES = 500_000

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Samples of a character that weigh as much as the fallback.
PRIOR = 10.0
START = len(ALPHABET)
SIZE = START + 1
_CODE = np.full(256, -1, np.int32)
_CODE[list(ALPHABET)] = np.arange(START)
_TOKEN = _CODE >= 0
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)]).astype(np.int32)
_LOWER = np.isin(np.arange(256), range(97, 123)).astype(np.int32)
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))

Span = tuple[str, int, int, float | None]

#: Words that identifiers are made of, for the ordinary samples.
ORDINARY_WORDS = """get set user account by id max min retry count per host src main java com example app docs getting started install sha file content version
 name list path index item value type key node table column row query result error message config option default timeout cache session request response
 client server http url data base model view controller service manager factory handler builder parser writer reader stream buffer queue thread process
 test unit spec mock util helper common core public static final void string integer boolean float double array object map hash tree graph image video
 audio email phone address order product price total date time start end begin stop update delete create insert select from where group sort filter
 left right top bottom width height color background margin padding border content page button label input output format encode decode convert""".split()
#: Labelled samples of each kind; corpus counts are added to theirs.
SAMPLES = 4000


def labelled_samples(n: int = SAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """(string, 1 if random): n ordinary identifiers and n random keys, always the same for a seed."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        words = [ORDINARY_WORDS[i] for i in rng.integers(0, len(ORDINARY_WORDS), int(rng.integers(3, 8)))]
        style = k % 7
        if style == 0:
            text = "_".join(words)
        elif style == 1:
            text = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 2:
            text = "_".join(words).upper()
        elif style == 3:
            text = "/".join(words)
        elif style == 4:
            text = "-".join(words)
        elif style == 5:
            text = "".join(w.capitalize() for w in words)
        else:
            text = f"{'_'.join(words)}_v{int(rng.integers(1, 300))}"
        out.append((text, 0))
        letters = (ALPHABET[:62], ALPHABET[26:62], b"0123456789abcdef", ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62])[k % 5]
        out.append((rng.choice(list(letters), int(rng.integers(16, 48))).astype(np.uint8).tobytes().decode(), 1))
    return out


def sample_counts() -> np.ndarray:
    total = np.zeros((2, SIZE * SIZE))
    for text, random in labelled_samples():
        codes = _CODE[np.frombuffer(text.encode(), np.uint8)]
        total[random] += np.bincount(_transitions(codes, np.array([0]), np.array([len(codes)]))[0], minlength=SIZE * SIZE)
    return total


def _runs(block: Block, members: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, _ = block.runs(members)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(starts, block.offsets)


def base_spans(text: str, hexes: list[tuple[int, int]]) -> tuple[list[Span], list[str]]:
    """Spans by the patterns, in code points, and the values they hold. hexes: the text's long runs of hex digits."""
    spans: list[Span] = []
    values = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                spans.append(("assign", m.start(), m.end(), None))
                values.append(m[2])
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= LEAST["access"]:
                spans.append(("access", m.start(), m.end(), None))
                values.append(m[0])
    for a, b in hexes:
        spans.append(("hex", a, b, None))
        values.append(text[a:b])
    return spans, values


def _texts(block: Block) -> Iterator[tuple[str, list[Span], list[str], list[tuple[int, int, int, int]]]]:
    """Each text with its pattern spans, their values, and its other runs of 8 and more (start, end, first byte, end byte)."""
    at = block.code_points()
    hex_starts, hex_ends, hex_bounds = _runs(block, _HEX, LEAST["hex"])
    starts, ends, bounds = _runs(block, _TOKEN, 8)
    raw = block.data.tobytes()
    for i in range(block.n):
        lo, hi = block.offsets[i], block.offsets[i + 1]
        h, t = slice(hex_bounds[i], hex_bounds[i + 1]), slice(bounds[i], bounds[i + 1])
        first = at[lo]
        spans, values = base_spans(raw[lo:hi].decode(), [(int(a - first), int(b - first)) for a, b in zip(at[hex_starts[h]], at[hex_ends[h]], strict=True)])
        own = np.stack([at[starts[t]] - first, at[ends[t]] - first, starts[t], ends[t]], 1)
        if spans:
            clear = np.ones(len(own), bool)
            for _, a, b, _ in spans:
                clear &= (own[:, 1] <= a) | (own[:, 0] >= b)
            own = own[clear]
        yield i, spans, values, own


def _transitions(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the transitions in runs of codes, start included, run after run; and their bounds by run."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    places = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths) + np.repeat(starts, lengths)
    now = codes[places]
    previous = np.concatenate([[START], now[:-1]]) if len(now) else now
    previous[bounds[:-1][lengths > 0]] = START
    return previous * SIZE + now, bounds


def count_transitions(docs: DataFrame) -> DataFrame:
    """random (1: values of pattern spans, 0: shorter runs, and longer ones that are small letters but for the first), transition, n: sums over all of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for _, block in parts(batch, 0, TOGETHER_BYTES):
                codes, values, plain = _CODE[block.data], [], []
                lower = np.concatenate([[0], np.cumsum(_LOWER[block.data])])
                for _, _, found, own in _texts(block):
                    values += found
                    size = own[:, 1] - own[:, 0]
                    plain.append(own[(size < CANDIDATE) | (lower[own[:, 3]] - lower[own[:, 2]] >= size - 1)])
                own = np.concatenate(plain) if plain else np.zeros((0, 4), np.int64)
                total[0] += np.bincount(_transitions(codes, own[:, 2], own[:, 3] - own[:, 2])[0], minlength=SIZE * SIZE)
                for value in values:
                    mine = _CODE[np.frombuffer(value.encode(), np.uint8)]
                    mine = mine[mine >= 0]
                    total[1] += np.bincount(_transitions(mine, np.array([0]), np.array([len(mine)]))[0], minlength=SIZE * SIZE)
        kind, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(pair, pa.int32()), pa.array(total[kind, pair])], names=["random", "transition", "n"])

    return docs.select("text").mapInArrow(run, "random int, transition int, n long").groupBy("random", "transition").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each transition, random over ordinary.

    Transitions that are seldom seen fall back to equal chances in random strings, and to how frequent the character is
    in ordinary ones. Corpus and labelled samples weigh the same, so prose, however much of it, doesn't drown identifiers.
    """
    own, total = np.zeros((2, SIZE * SIZE)), sample_counts()
    for r in count_transitions(docs).collect():  # at most 2 * SIZE ** 2 rows
        own[r["random"], r["transition"]] += r["n"]
    total += own * np.minimum(1.0, total.sum(1) / np.maximum(own.sum(1), 1))[:, None]
    table = total.reshape(2, SIZE, SIZE)[:, :, :START]
    usual = table[0].sum(0) + 0.5
    prior = np.stack([usual / usual.sum(), np.full(START, 1 / START)])
    chance = np.log((table + PRIOR * prior[:, None, :]) / (table.sum(2, keepdims=True) + PRIOR))
    return np.pad(chance[1] - chance[0], ((0, 0), (0, 1))).ravel()


def find_secrets(docs: DataFrame, name: str = "secrets", least: int = CANDIDATE, per_character: float = 0.5, redact: str | None = None, model: np.ndarray | None = None) -> DataFrame:
    """Appends to docs, by row, the array `name` of (kind, start, end, score): code points, end exclusive, by start and then kind.

    Null and empty texts have no secrets. Repeated rows get equal arrays; texts of any length are scanned whole. A column
    that is called like name is replaced. redact: if given, secrets (overlapping ones together) give way to it in text.
    """
    bound_batches(docs.sparkSession)
    ratios = fit(docs) if model is None else model
    docs = docs.drop(name)
    at = docs.columns.index("text")
    order = {k: i for i, k in enumerate(KINDS)}

    def scanned(block: Block) -> Iterator[list[Span]]:
        codes = _CODE[block.data]
        letters = np.concatenate([[0], np.cumsum(_LETTER[block.data])])
        for _, spans, _, own in _texts(block):
            long = own[own[:, 1] - own[:, 0] >= least]
            long = long[letters[long[:, 3]] > letters[long[:, 2]]]
            if len(long):
                pairs, bounds = _transitions(codes, long[:, 2], long[:, 3] - long[:, 2])
                scores = np.add.reduceat(ratios[pairs], bounds[:-1]) / np.diff(bounds)
                spans += [("markov", int(a), int(b), float(s)) for (a, b, _, _), s in zip(long, scores, strict=True) if s >= per_character]
            yield sorted(spans, key=lambda x: (x[1], order[x[0]]))

    def cut(text: str | None, spans: list[Span]) -> str | None:
        out, done = [], 0
        for _, a, b, _ in spans:
            if a >= done:
                out += [text[done:a], redact]
            done = max(done, b)
        return "".join([*out, text[done:]]) if spans else text

    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in parts(batch, at, TOGETHER_BYTES):
                found, columns = list(scanned(block)), list(part.columns)
                hit = np.array([bool(s) for s in found], bool)
                if redact is not None and hit.any():
                    new = [cut(t, s) for t, s in zip(columns[at].filter(pa.array(hit)).to_pylist(), filter(None, found), strict=True)]
                    columns[at] = pc.replace_with_mask(columns[at], pa.array(hit), pa.array(new, columns[at].type))
                columns.append(pa.array([[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in s] for s in found], pa.list_(kind)))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, SECRETS)]))


def written(secrets: Column) -> Column:
    """kind:start:end of each secret, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts by pattern, base_sha256 of the pattern spans and all spans, for each row of docs(doc_id, text)."""
    found = find_secrets(docs.select("doc_id", "text"))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in KINDS[:3]]
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def redact_documents(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with their columns, secrets in text replaced and n_chars, if there, counted anew."""
    name = "_secrets"
    while name in docs.columns:
        name += "_"
    out = find_secrets(docs, name, redact=mask).drop(name)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
