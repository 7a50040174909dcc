"""Quality classifier: a sparse rule ensemble.

Statistics of whole texts feed a small random forest; every path from a root to a node becomes a conjunctive rule; a lasso
logistic regression weighs the rules; the rules with weights become one Spark column expression. All labelled training
rows take part, and both fits run as Spark jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.textarrays import Block, parts, shingle_hashes
from colloquy.storage import bound_batches, materialize

STATISTICS = ["log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "bang", "pipe", "newline", "stop", "high", "distinct_words", "top_word", "same_next", "distinct_shingles", "symbol_end", "upper_end"]
_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#$%&*@^~<>{}[]\\_+=/`", "bang": b"!", "pipe": b"|", "newline": b"\n", "stop": b".,;:?", "high": range(0xC0, 256)}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def block_statistics(block: Block) -> np.ndarray:
    """One row of STATISTICS per text; all are finite, and zero for an empty text."""
    starts, ends, bounds = block.words()
    hashes = block.word_hashes(starts, ends)
    shingles, cuts = shingle_hashes(hashes, bounds, 5)
    size, count = np.diff(block.offsets).astype(float), np.diff(bounds).astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)

    def total(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[edges])

    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(count), "word_length": total(ends - starts, bounds) * per_word}
    out |= {k: total(table[block.data], block.offsets) * per_byte for k, table in _TABLES.items()}
    last = block.data[ends - 1] if len(ends) else block.data[:0]
    out["symbol_end"] = total(_TABLES["symbol"][last] | _TABLES["bang"][last], bounds) * per_word
    out["upper_end"] = total(_TABLES["upper"][last], bounds) * per_word
    same = np.concatenate([hashes[1:] == hashes[:-1], [False]]) if len(hashes) else np.zeros(0, bool)
    inner = bounds[1:][bounds[1:] > 0] - 1
    same[inner] = False
    out["same_next"] = total(same, bounds) * per_word
    distinct, top, own = (np.zeros(block.n) for _ in range(3))
    for i in range(block.n):
        if count[i]:
            found, times = np.unique(hashes[bounds[i] : bounds[i + 1]], return_counts=True)
            distinct[i], top[i] = len(found), times.max()
            own[i] = len(np.unique(shingles[cuts[i] : cuts[i + 1]])) / (cuts[i + 1] - cuts[i])
    out |= {"distinct_words": distinct * per_word, "top_word": top * per_word, "distinct_shingles": own}
    return np.stack([out[k] for k in STATISTICS], 1)


def with_statistics(docs: DataFrame, name: str = "_statistics", keep: list[str] | None = None) -> DataFrame:
    """Appends the statistics of column text as an array<double>; keep: the columns to pass on, all if None."""
    bound_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    at = docs.columns.index("text")
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in parts(batch, at):
                flat = block_statistics(block)
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(STATISTICS), pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], column], names=[*keep, name])

    return docs.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, threshold) and so on


@dataclass
class RuleEnsemble:
    """Rules with weights; without rules, one probability for all texts."""

    rules: list[Rule]
    weights: list[float]
    intercept: float

    def probability(self, statistics: Column) -> Column:
        """The compiled ensemble: a column expression in [0, 1], high for quality 1."""
        score = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            score = score + F.when(rule_condition(rule, statistics), float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-score))


def rule_condition(rule: Rule, statistics: Column) -> Column:
    return reduce(and_, ((statistics[i] <= t) if below else (statistics[i] > t) for i, below, t in rule))


def forest_rules(model) -> list[Rule]:
    """The conjunctions on the paths from each root to each of its nodes, each once."""
    found: dict[Rule, None] = {}

    def walk(node, path: dict[tuple[int, bool], float]) -> None:
        if path:
            found[tuple(sorted((i, below, t) for (i, below), t in path.items()))] = None
        if node.subtreeDepth() == 0:
            return
        i, t = node.split().featureIndex(), node.split().threshold()
        walk(node.leftChild(), path | {(i, True): min(t, path.get((i, True), t))})
        walk(node.rightChild(), path | {(i, False): max(t, path.get((i, False), t))})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit(rows: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> RuleEnsemble:
    """Fits on rows(_statistics, label double 0 or 1), which is read several times. With one class or none, no rules."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return RuleEnsemble([], [], {0.0: -1.0, 1.0: 1.0}.get(next(iter(counts), None), 0.0))
    rows = rows.withColumn("features", array_to_vector("_statistics"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, minInstancesPerNode=5).fit(rows)
    rules = forest_rules(forest)
    if not rules:
        return RuleEnsemble([], [], float(np.log(counts[1.0] / counts[0.0])))
    fires = F.array(*[F.when(rule_condition(r, F.col("_statistics")), 1.0).otherwise(0.0) for r in rules])
    matrix = rows.select("label", array_to_vector(fires).alias("fires")).cache()
    lasso = LogisticRegression(featuresCol="fires", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(matrix)
    matrix.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w]
    return RuleEnsemble([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of doc_id as text leaves 1 by 3. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: statistics(doc_id, _statistics) that aren't held out, with quality as label; null and other labels are left out."""
    marks = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter("label in (0, 1)").filter(~held_out(F.col("doc_id")))
    return statistics.select("doc_id", "_statistics").join(marks, "doc_id").select("_statistics", "label")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, text); other columns are ignored.

    A null text counts as empty; an empty text has statistics of zero and so a score as well. Repeated rows get equal
    scores. Without labels of both kinds all scores are equal. An empty table gives no rows.
    """
    statistics = materialize(with_statistics(docs.select("doc_id", "text"), keep=["doc_id"]), "statistics")
    model = fit(materialize(labelled(statistics, labels), "labelled"))
    score = model.probability(F.col("_statistics"))
    return statistics.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least threshold.

    Statistics are made twice, for the fit and for the choice: that is cheaper than shuffling texts to their labels.
    """
    sample = with_statistics(docs.select("doc_id", "text"), keep=["doc_id"])
    model = fit(materialize(labelled(sample, labels), "labelled"))
    name = "_statistics"
    while name in docs.columns:
        name += "_"
    return with_statistics(docs, name).filter(model.probability(F.col(name)) >= threshold).drop(name)
