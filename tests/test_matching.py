"""Best matches against all pairs; a session far too large for all pairs."""

import random
from collections import Counter

import pytest

from colloquy.operators import matching as mt

TURN = "session string, id long, role string, start long, end long, tokens array<string>, content int"


def brute(turns, batch, same_role=False):
    out = {}
    for s, i, role, start, end, tokens, content in turns:
        if s is None or not tokens:
            continue
        rows = []
        for bs, j, brole, bstart, bend, btokens, _ in batch:
            if bs != s or not btokens or (same_role and (role is None or role != brole)):
                continue
            recall = (Counter(tokens) & Counter(btokens)).total() / len(tokens)
            away = abs(start - bstart)
            near = 0.0 if content > 3 else 0.35 if away <= 15_000 else 0.15 if away <= 45_000 else -0.25 if away > 120_000 else 0.0
            score = round(recall + 0.15 * (start < bend and end > bstart) + 0.1 * (role is not None and role == brole) + near, 6)
            rows.append((-score, -round(recall, 6), away, bstart, j))
        if rows:
            rows.sort()
            out[s, i] = (rows[0][4], -rows[0][0], -rows[1][0] if len(rows) > 1 else 0.0, sum(-r[1] >= 0.25 and -r[0] >= 0.35 for r in rows))
    return out


def made(rng, n, span, words):
    rows = []
    for i in range(n):
        start = rng.randrange(span)
        rows.append((rng.choice(["s", "s", "t", None]), i, rng.choice(["Me", "Colleagues", None]), start, start + rng.randrange(0, 20_000), [rng.choice(words) for _ in range(rng.randrange(0, 9))], rng.randrange(0, 6)))
    return rows


@pytest.mark.parametrize(("seed", "span", "vocabulary"), [(1, 200_000, 8), (2, 3_000_000, 40), (3, 20_000_000, 300)])
@pytest.mark.parametrize(("same_role", "small"), [(False, 0), (True, 0), (False, 64)])
def test_best_of_all_pairs(spark, monkeypatch, seed, span, vocabulary, same_role, small):
    monkeypatch.setattr(mt, "SMALL", small)
    rng = random.Random(seed)
    words = [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(vocabulary)]
    turns, batch = made(rng, 60, span, words), made(rng, 80, span, words)
    got = {(r.session, r.id): (r.batch_id, r.score, r.second_score, r.plausible) for r in mt.best_match(spark.createDataFrame(turns, TURN), spark.createDataFrame(batch, TURN), same_role).collect()}
    assert got == brute(turns, batch, same_role)


def test_a_session_of_twenty_thousand_turns(spark):
    rng = random.Random(9)
    words = [f"w{int(20_000 * rng.random() ** 2)}" for _ in range(400_000)]
    turns = [("s", i, "Me" if i % 2 else "Colleagues", 7000 * i, 7000 * i + 5000, [rng.choice(words) for _ in range(8)], 5) for i in range(20_000)]
    batch = [(s, i, r, a + 900, e + 900, t[: rng.randrange(4, 9)], c) for s, i, r, a, e, t, c in turns]
    got = {r.id: r for r in mt.best_match(spark.createDataFrame(turns, TURN), spark.createDataFrame(batch, TURN)).collect()}
    assert len(got) == 20_000 and sum(r.batch_id == i for i, r in got.items()) >= 19_990
    sample = rng.sample(turns, 5)
    want = brute(sample, batch)
    assert all((got[t[1]].batch_id, got[t[1]].score, got[t[1]].second_score, got[t[1]].plausible) == want["s", t[1]] for t in sample)
