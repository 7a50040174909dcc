"""Scoring of turns for notes: actions, decisions, risks and open questions, by a lexicon that a domain pack provides.

Turns have text, needs_review and unresolved (an open review item touches it). Scores are clamped to 0 to 100; turns without
a marker of the kind get null. The status is selected, candidate, weak or hidden.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import strings as st
from colloquy.functions import text as tx
from colloquy.operators.decisions import clamp, points


@dataclass(frozen=True)
class Lexicon:
    """Markers are phrases looked for in lower-case text; words are compared with the tokens."""

    terms: list[str] = field(default_factory=list)
    stop: list[str] = field(default_factory=list)
    strong: list[str] = field(default_factory=list)
    medium: list[str] = field(default_factory=list)
    soft: list[str] = field(default_factory=list)
    verbs: list[str] = field(default_factory=list)
    weak_verbs: list[str] = field(default_factory=list)
    owners: list[str] = field(default_factory=list)
    times: list[str] = field(default_factory=list)
    facilitation: list[str] = field(default_factory=list)
    abstract: list[str] = field(default_factory=list)
    explicit: list[str] = field(default_factory=list)
    dialogue: list[str] = field(default_factory=list)
    choices: list[str] = field(default_factory=list)
    risks: list[str] = field(default_factory=list)
    worries: list[str] = field(default_factory=list)
    consequences: list[str] = field(default_factory=list)
    hedges: list[str] = field(default_factory=list)
    solved: list[str] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)
    asking: list[str] = field(default_factory=list)
    who: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    answers: list[str] = field(default_factory=list)
    filler: list[str] = field(default_factory=list)


def has(phrases: list[str]) -> Column:
    low = F.lower(F.coalesce("text", F.lit("")))
    return reduce(or_, (low.contains(p) for p in phrases), F.lit(False))


def any_of(words: list[str]) -> Column:
    return F.arrays_overlap("_tokens", F.array(*map(F.lit, words)).cast("array<string>")) if words else F.lit(False)


def _prepared(turns: DataFrame, lex: Lexicon) -> DataFrame:
    out = turns.withColumn("_tokens", tx.tokens(F.coalesce("text", F.lit(""))))
    content = F.array_distinct(F.filter("_tokens", lambda t: (F.length(t) >= 3) & ~t.isin(lex.stop)))
    return out.withColumn("_n", F.size(content)).withColumn("_terms", F.size(st.terms_in(F.col("text"), lex.terms)) if lex.terms else F.lit(0))


def _review(bonus: float, penalty: float) -> Column:
    return F.when(F.coalesce("needs_review", F.lit(False)), -penalty).otherwise(bonus) + F.when(F.coalesce("unresolved", F.lit(False)), -10.0).otherwise(0.0)


def _question() -> Column:
    return F.coalesce("text", F.lit("")).contains("?")


def status(score: Column, selected: float, candidate: float, weak: float) -> Column:
    return F.when(score >= selected, "selected").when(score >= candidate, "candidate").when(score >= weak, "weak").otherwise("hidden")


def score_actions(turns: DataFrame, lex: Lexicon) -> DataFrame:
    """score and status of what someone commits to: markers, a verb with an object, owner and time speak for it; vague talk against it."""
    rows = _prepared(turns, lex)
    strong, medium, soft, verb, weak = has(lex.strong), has(lex.medium), has(lex.soft), any_of(lex.verbs), any_of(lex.weak_verbs)
    # the object of a verb: a content word within the four that follow it
    verbs = lex.verbs + lex.weak_verbs
    after = F.exists(F.transform("_tokens", lambda t, i: t.isin(verbs) & F.exists(F.slice("_tokens", i + 2, F.lit(4)), lambda u: (F.length(u) >= 3) & ~u.isin(lex.stop) & ~u.isin(verbs))), lambda x: x)
    thing = F.coalesce(after, F.lit(False)) if verbs else F.lit(False)
    abstract, chair = has(lex.abstract), has(lex.facilitation)
    score = points((strong, 25), (medium, 18), (soft, 10), (verb, 22), (weak & thing, 10), (weak & ~thing, -12), (thing, 22), (~thing, -20), (~thing & ~strong, -25), (any_of(lex.owners) | strong, 15), (any_of(lex.times), 6))
    score = score + F.least(F.lit(10.0), F.col("_terms") * 5.0) + _review(8, 15) + points((abstract, -25), (medium & ~strong & ~verb & ~thing, -18), (F.col("_n") < 3, -10), (F.col("_n") > 45, -10), (_question(), -15))
    marked = strong | medium | soft | chair | verb | weak
    final = F.when(marked, F.when(chair, 25.0).otherwise(clamp(score, 0, 100)))
    shown = F.when(chair | abstract | (~thing & ~strong), "hidden").otherwise(status(final, 75, 55, 35))
    return rows.select(*turns.columns, final.alias("score"), F.when(marked, shown).alias("status"))


def score_decisions(turns: DataFrame, lex: Lexicon) -> DataFrame:
    """score and status of what was settled."""
    rows = _prepared(turns, lex)
    explicit, dialogue, chair = has(lex.explicit), has(lex.dialogue), has(lex.facilitation)
    thin = dialogue & ~explicit & (F.col("_n") < 3)
    score = points((explicit, 50), (dialogue, 20), (F.col("_terms") > 0, 15), (F.col("_n") >= 3, 10), (any_of(lex.choices), 15), (thin, -35)) + _review(8, 15) + points((_question(), -20), (F.col("_n") < 2, -20))
    bare = F.trim(F.lower(F.coalesce("text", F.lit("")))).isin(lex.filler)
    marked = (explicit | dialogue) & ~bare
    final = F.when(marked, F.when(chair & ~explicit, 25.0).otherwise(clamp(score, 0, 100)))
    return rows.select(*turns.columns, final.alias("score"), F.when(marked, F.when((chair & ~explicit) | thin, "hidden").otherwise(status(final, 75, 55, 35))).alias("status"))


def score_risks(turns: DataFrame, lex: Lexicon) -> DataFrame:
    """score and status of what may go wrong."""
    rows = _prepared(turns, lex)
    strong, medium, then = has(lex.risks), has(lex.worries), has(lex.consequences)
    bare = has(lex.worries[:1]) & ~then if lex.worries else F.lit(False)
    score = points((strong, 35), (medium, 20), (then, 20), (F.col("_terms") > 0, 10), (any_of(lex.hedges), 8), (has(lex.solved), -30), (bare, -15)) + _review(8, 10)
    final = F.when(strong | medium, clamp(score, 0, 100))
    return rows.select(*turns.columns, final.alias("score"), F.when(strong | medium, status(final, 70, 50, 35)).alias("status"))


def score_questions(turns: DataFrame, lex: Lexicon, by: str = "session", order: str = "turn") -> DataFrame:
    """score and status of questions that stay open: an answer among the five turns after it, within 90 s, speaks against it."""
    w = Window.partitionBy(by).orderBy(order)
    rows = _prepared(turns, lex).withColumn("_answer", F.when(has(lex.answers), F.col("start")))
    answered = F.lit(False)
    for k in range(1, 6):  # turns are in time order, so an answer too late ends the search like those after it
        answered = answered | F.coalesce(F.lead("_answer", k).over(w) - F.col("end") <= 90_000, F.lit(False))
    rows = rows.withColumn("_answered", answered)
    low = F.lower(F.coalesce("text", F.lit("")))
    asks = reduce(or_, (low.startswith(q + " ") | low.contains(f" {q} ") for q in lex.asking), F.lit(False))
    open_, mark = has(lex.unresolved), _question()
    score = points((mark | asks, 35), (open_, 25), (F.col("_terms") > 0, 10), (any_of(lex.who), 15), (has(lex.topics), -25), (F.col("_answered"), -30)) + _review(8, 10)
    marked = mark | open_ | asks
    final = F.when(marked, clamp(score, 0, 100))
    return rows.select(*turns.columns, final.alias("score"), F.when(marked, status(final, 70, 50, 35)).alias("status"))


def salience(turns: DataFrame, lex: Lexicon) -> DataFrame:
    """salience: how much a turn tells, at least 0."""
    rows = _prepared(turns, lex)
    marked = has(lex.medium + lex.explicit + lex.risks + lex.unresolved)
    filler = F.trim(F.lower(F.coalesce("text", F.lit("")))).isin(lex.filler)
    score = F.least(F.col("_n"), F.lit(20)) * 2.0 + F.col("_terms") * 5.0 + _review(8, 12) + points((marked, 8), (filler, -35), (has(lex.facilitation), -30), (F.col("_n") < 3, -15), (F.col("_n") > 45, -8))
    return rows.select(*turns.columns, F.greatest(score, F.lit(0.0)).cast("int").alias("salience"))


def topic_keywords(turns: DataFrame, by: list[str], lex: Lexicon, k: int = 4) -> DataFrame:
    """by, term, weight, rank: domain terms weigh 8 a turn, other content words of four letters and more 2; a total of 3 at least, the best k."""
    rows = _prepared(turns, lex)
    terms = F.transform(st.terms_in(F.col("text"), lex.terms), lambda t: F.struct(t.alias("term"), F.lit(8).alias("w")))
    words = F.transform(F.array_distinct(F.filter("_tokens", lambda t: (F.length(t) >= 4) & ~t.isin(lex.stop) & ~t.isin(lex.filler))), lambda t: F.struct(t.alias("term"), F.lit(2).alias("w")))
    sums = rows.select(*by, F.explode(F.concat(terms, words)).alias("x")).groupBy(*by, "x.term").agg(F.sum("x.w").alias("weight")).filter("weight >= 3")
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "term"))).filter(F.col("rank") <= k)
