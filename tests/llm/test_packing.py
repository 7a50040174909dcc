import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import queries
from colloquy.llm.packing import WordIds, best_two_fit, pack_documents

TEXTS = [None, "", "a", "  two  spaces \n and\t tabs ", "été, ça va ?", "x " * 5000, "end <|endoftext|>", " lead", "trail ", "\n\n a\n b", "word", "word", "it's 1234 ok... don't"]


@cache
def tokenizer():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok


def ids(text):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_words_have_the_ids_of_the_whole_text():
    got = WordIds(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).texts([t or "" for t in TEXTS])
    assert all(np.array_equal(a, ids(t)) for a, t in zip(got, TEXTS, strict=True))


def test_every_token_has_one_place(spark):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, piece string, length int")
    rows = pack_documents(docs, 64).collect()
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for doc, text in enumerate(TEXTS):
        want, at = ids(text), 0
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 64 for r in parts[1:])
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == -(-sum(r.length for r in rows) // 64)


def test_queries_give_added_tokens_their_ids(spark, tmp_path):
    texts = [*TEXTS, "<|endoftext|>", "a <|endoftext|><|endoftext|>  b", "a<|endoftext|>b c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert whole[6] == [437, 220, 50256, 0]
    for rows in (queries.op3_best_two_fit(spark, str(tmp_path)).collect(), corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()):
        assert sum(r.length for r in rows) == sum(map(len, whole.values()))
        assert all(r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_up_the_counts_and_fit(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 257, 60)}
    patterns, seen = best_two_fit(counts, 256), defaultdict(int)
    for times, used in patterns:
        assert times > 0 and sum(x * n for x, n in used) <= 256
        for x, n in used:
            seen[x] += times * n
    assert dict(seen) == counts
    least = max(sum(k * v for k, v in counts.items()) / 256, sum(v for k, v in counts.items() if k > 128))
    assert sum(t for t, _ in patterns) <= 11 / 9 * least + 1


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_are_cut_where_the_pattern_never_matches_across():
    rng = np.random.default_rng(9)
    letters = list("ab1!'é.ß世 \n\t\r") + ["\x1c", "\x85", "\xa0", " ", "　", "  ", " \n", "'s", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(800)]
    got = WordIds(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).texts(texts)
    assert all(np.array_equal(a, ids(t)) for a, t in zip(got, texts, strict=True))
