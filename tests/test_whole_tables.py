"""Queries on whole tables and texts of any length, against brute force."""

import re

from colloquy.plans import catalogue, registry  # noqa: F401


def unit(words):
    fits = [k for k in range(1, 5) if len(words) % k == 0 and len(words) >= 4 * k and all(w == words[i % k] for i, w in enumerate(words))]
    return fits[0] if fits else None


def test_repeated_units_of_long_documents_are_found(spark, tmp_path):
    texts = ["yes " * 3000, "one two three " * 900, "one two three " * 900 + "four", "a b " * 4, "a b", "", "word " * 399 + "other"]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.unit for r in registry.queries()["repeated_unit"](spark, str(tmp_path)).collect()}
    assert got == {i: unit(re.findall(r"\w+", t)) for i, t in enumerate(texts)}
    assert got[0] == 1 and got[1] == 3
