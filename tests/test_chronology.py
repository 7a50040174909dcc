"""Matching blocks and edit paths against other algorithms; word chronology against a plain reading of its rules."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pytest

from colloquy.functions import blocks
from colloquy.operators import chronology
from colloquy.plans import registry
from colloquy.plans import catalogue  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_blocks_are_those_of_the_longest_match_first_rule(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n, m = rng.choice([(8, 9), (40, 30), (260, 240)])
        a, b = ("".join(rng.choice("abcd ef"[: rng.randrange(2, 7)]) for _ in range(rng.randrange(k))) for k in (n, m))
        x, y = blocks.coded(a, b)
        own = [(i, j, k) for i, j, k in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if k]
        assert sum(k for *_, k in blocks.matching_blocks(x, y)) == sum(k for *_, k in own)
        assert {(i + d, j + d) for i, j, k in blocks.matching_blocks(x, y) for d in range(k)} == {(i + d, j + d) for i, j, k in own for d in range(k)}
        assert blocks.ratio(a, b) == (SequenceMatcher(None, a, b).ratio() if a and b else 0.0)


def test_paths_cost_what_the_full_matrix_says():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)) for _ in "ab")
        full = np.zeros((len(a) + 1, len(b) + 1), int)
        full[:, 0], full[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                full[i, j] = min(full[i - 1, j] + 1, full[i, j - 1] + 1, full[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert (blocks.edit_costs(a, b) == full).all()
        kinds = [k for k, _, _ in blocks.traced(a, b)]
        assert sum(k != "match" for k in kinds) == full[-1, -1] and kinds.count("deletion") - kinds.count("insertion") == len(a) - len(b)


def plain(item, decodes):
    """label, confidence, overlap, gap by the rules, one item at a time."""

    def align(tokens, words):
        words = [w for w in words if w[3] >= 0.2]
        pairs = [(b.a + k, b.b + k) for b in SequenceMatcher(None, tokens, [w[0] for w in words], autojunk=False).get_matching_blocks() for k in range(b.size)]
        n, short = len(pairs), min(len(tokens), len(words))
        containment, precision = n / short if short else 0.0, n / len(words) if words else 0.0
        score = 0.45 * containment + 0.35 * precision + 0.2 * (sum(words[j][3] for _, j in pairs) / n if n else 0.0)
        ok = n >= (1 if len(tokens) == 1 else 2) and containment >= 0.5 and score >= 0.6
        return ok, round(score, 6), round(words[pairs[0][1]][1], 3) if pairs else None, round(words[pairs[-1][1]][2], 3) if pairs else None

    mic, remote = decodes.get("mic_clean", ("missing", [])), decodes.get("remote", ("missing", []))
    mm, mr, rr = align(item["me"], mic[1]), align(item["remote"], mic[1]), align(item["remote"], remote[1])
    evidence, active, only = item["evidence"], item["local"] + item["double"], item["only"]
    local = mm[0] and (mm[1] - mr[1] >= 0.12 or (evidence >= 60 and active >= 0.5))
    overlap = round(max(0.0, min(mm[3], rr[3]) - max(mm[2], rr[2])), 6) if mm[0] and rr[0] else None
    gap = round(max(mm[2], rr[2]) - min(mm[3], rr[3]), 6) if mm[0] and rr[0] else None
    if only >= 0.8 and active <= 0.1 and evidence <= 20 and rr[0] and (not local or item["upstream"] == "remote_leak_or_asr_segmentation"):
        return "transferred_remote_leak_or_segmentation", max(rr[1], 0.8), overlap, gap
    if overlap is not None and local:
        if overlap <= 0.35:
            return "localized_sequential_boundary", min(mm[1], rr[1]), overlap, gap
        if overlap >= 0.5:
            return "localized_double_talk", min(mm[1], rr[1]), overlap, gap
    if "ok" != mic[0] or "ok" != remote[0]:
        return "evidence_unavailable", 0.0, overlap, gap
    if mm[0] and rr[0] and not local:
        return "conflicting_role_alignment", max(mm[1], rr[1]), overlap, gap
    return "insufficient_word_alignment", max(mm[1], rr[1]), overlap, gap


def test_every_label_as_the_rules_say(spark):
    rng, words = random.Random(5), "ja to jest nie tak dobrze bardzo".split()
    items, decodes, want = [], [], {}
    for i in range(400):
        me, remote = ([rng.choice(words) for _ in range(rng.randrange(0, 6))] for _ in "ab")
        item = {"me": me, "remote": remote if rng.random() < 0.8 else me, "evidence": rng.choice([0, 10, 70]), "local": rng.choice([0.0, 0.6]), "double": rng.choice([0.0, 0.05]), "only": rng.choice([0.1, 0.9]), "upstream": rng.choice([None, "remote_leak_or_asr_segmentation"])}
        own = {}
        for source, text, at in (("mic_clean", item["me"], 0.0), ("remote", item["remote"], rng.choice([0.0, 0.4, 1.2, 3.0]))):
            if rng.random() < 0.9:
                heard = [t for t in text if rng.random() < 0.85] + [rng.choice(words)] * (rng.random() < 0.3)
                own[source] = (rng.choice(["ok", "ok", "ok", "decode_error"]), [(t, round(at + 0.3 * k, 3), round(at + 0.3 * k + 0.25, 3), rng.choice([0.1, 0.5, 0.9])) for k, t in enumerate(heard)])
        items.append((i, item["me"] or None, item["remote"], float(item["evidence"]), item["local"], item["double"], item["only"], item["upstream"]))
        decodes += [(i, s, st, w) for s, (st, w) in own.items()]
        want[i] = plain(item, own)
    items = spark.createDataFrame(items, "id long, me_tokens array<string>, remote_tokens array<string>, local_evidence double, local_only double, double_talk double, remote_only double, upstream string")
    decodes = spark.createDataFrame(decodes, "id long, source string, status string, words array<struct<token string, start double, end double, probability double>>")
    got = {r.id: r for r in chronology.classify(items, decodes, ["id"]).collect()}
    assert len({w[0] for w in want.values()}) == 6
    for i, (label, confidence, overlap, gap) in want.items():
        r = got[i]
        assert (r.label, r.actual_overlap, r.signed_gap) == (label, overlap, gap) and abs(r.confidence - confidence) < 1e-9
        assert not r.mic_me or [w.token for w in r.mic_me.w] == (r.me_tokens or [])


def test_query_gives_a_row_for_each_pair_of_turns(spark):
    rows = registry.queries()["word_chronology"](spark, SF).collect()
    assert rows and len({(r.session, r.id) for r in rows}) == len(rows)
    assert {"localized_sequential_boundary"} <= {r.label for r in rows}
    assert all((r.signed_gap is None) == (r.actual_overlap is None) and (r.signed_gap is None or r.actual_overlap == max(0, -r.signed_gap)) for r in rows)


def test_ratios_of_long_texts_in_all_tasks(spark):
    """Texts of thousands of characters take parts of a second, and few bytes of rows still go to all tasks."""
    rng = random.Random(5)
    a, b = ("".join(chr(0x4E00 + rng.randrange(300)) for _ in range(8000)) for _ in "ab")
    began = time.time()
    assert 0 < blocks.ratio(a, b) < 1 and time.time() - began < 10
    assert blocks.matching_blocks("xabcy", "abcxab") == [(0, 3, 3)] and blocks.matching_blocks("", "a") == []
    for name in ("sequence_ratio", "text_similarity", "offset_anchors", "banded_best_match_join", "reference_alignment_join", "word_chronology"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "REPARTITION_BY_NUM" in plan.split("== Physical Plan ==")[-1], name
