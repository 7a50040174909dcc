"""Alignments against tokenizers on whole texts; counts against a plain loop over all links."""

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import public_tokenizers as P
import pytest

from colloquy.llm import alignment, queries
from colloquy.llm.alignment import TokenizerPair, align_documents

LETTERS = [*"ab1!'é.ß世 \n\t\r<>s", "\x1c", "\x85", "\xa0", "　", " ", "  ", " \n", "'s", "<|endoftext|>", "<s>", "the", "ing ", "\r\n", "😀", "\x00"]


@pytest.fixture(scope="module")
def pair():
    return TokenizerPair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def brute(pair, texts):
    """A row of the contract for each text, from whole texts."""
    groups = []
    for text in texts:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            groups.append([])
            continue
        out, i, j, x, y = [], 0, 0, 0, 0
        ga, gb = [], []
        while i < len(a) or j < len(b):
            if x <= y:
                ga.append(a[i])
                x += len(pair.a_bytes[a[i]])
                i += 1
            else:
                gb.append(b[j])
                y += len(pair.b_bytes[b[j]])
                j += 1
            if x == y:
                out.append((ga, gb))
                ga, gb = [], []
        groups.append(out)
    counts = Counter((g[0][-1], g[1][-1]) for out in groups for g in out)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for out in groups:
        links = [(g[0][-1], g[1][-1]) for g in out]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in out)
        yield (sum(len(a) for a, _ in out), sum(len(b) for _, b in out), len(out), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "")


def test_segments_have_the_ids_of_the_whole_text(pair):
    assert set(" \n") <= set(pair.openers) and "\r" not in pair.openers
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 30)))
        segments = pair.segments(text)
        assert "".join(segments) == " " + text
        a, b = pair.ids(segments)
        assert sum(a, []) == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == pair.b.encode(text)


def test_documents_against_brute_force(spark, pair):
    rng = random.Random(4)
    texts = [None, "", " ", "a", "a ", "x" * 3000, "with ▁ inside", "<|endoftext|> as text", "the same", "the same", "\n\n a\tb \r\n", "lorem ipsum " * 3000]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1, "b", "s") for i, t in enumerate(texts)], "doc_id long, text string, n int, batch string, segment string").repartition(3)
    got = sorted(map(tuple, align_documents(docs).collect()), key=lambda r: 3 if r[0] is None else r[0])
    assert [r[1:] for r in got] == list(brute(pair, texts))
    full = {r.doc_id: r.groups for r in align_documents(docs, digest=False).collect()}
    assert all(hashlib.sha256(full[r[0]].encode()).hexdigest() == r[7] for r in got if r[7])


def run_shards(spark, pair, batches):
    """aligned_shards on the driver, with a pair of its own."""
    import pyarrow as pa

    captured = []

    class Grouped:
        def groupBy(self, *_):
            return self

        filter = select = groupBy

        def applyInArrow(self, run, _):
            captured.append(run)

    old, alignment.tokenizer_pair = alignment.tokenizer_pair, lambda *_: pair
    try:
        alignment.aligned_shards(Grouped(), "a", "b")
        rows = [r for r in batches.collect() if r.shard >= 0]
        out = []
        for shard in sorted({r.shard for r in rows}):
            own = [r for r in rows if r.shard == shard]
            table = captured[0](pa.table({"shard": [shard] * len(own), "batch": [r.batch for r in own], "begin": pa.array([r.begin for r in own], pa.int32()), "body": pa.array([bytes(r.body) for r in own], pa.binary())}))
            out += [SimpleNamespace(**r) for r in table.to_pylist()]
        return out
    finally:
        alignment.tokenizer_pair = old


def test_texts_that_a_tokenizer_changes_count_for_nothing(spark):
    """A word is given back wrongly: documents that hold it lose their tokens, and segments they share with others aren't counted for them."""
    pair = TokenizerPair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    never = pair.b.piece_to_id("▁never")
    texts = ["the cat", "the never", "a cat never", "cat cat", "the", "never"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pair.b_bytes[never] = b"?"
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    batches = alignment.segment_batches(docs, *paths, 4)
    first = run_shards(spark, pair, batches)
    bad = [(r.batch, p) for r in first for p in r.bad or []]
    assert bad
    again = alignment.without_odd_documents(batches, spark.createDataFrame(bad, "of long, pos int"), 4)
    rows = [r for r in again.collect() if r.shard < 0]
    assert [n for r in rows for n in r.sizes] == [2, 0, 0, 2, 1, 0]
    assert not any(r.bad for r in run_shards(spark, pair, again))


def test_query_on_whole_table(spark, pair):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(map(tuple, queries.op12_segment_alignment(spark, "/root/testdata/sf0.001").collect()))
    assert got == [(r.doc_id, *w) for r, w in zip(rows, brute(pair, [r.text for r in rows]), strict=True)]


def test_empty_table(spark):
    assert align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
