"""Best matches between two lists of turns: scored pairs of a session, or of neighbouring time, of which the best stays.

Turns are rows(session, id, role, start, end, tokens, ...) in milliseconds. Pairs meet in buckets of time or by words that both
have, never by the session alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import strings as st
from colloquy.functions import text as tx
from colloquy.operators import intervals as iv
from colloquy.operators.joins import dealt
from colloquy.storage import materialize


def recall(a: Column, b: Column) -> Column:
    """Share of a's items that b has, as multisets; 0 for an empty a."""
    return F.when(F.size(a) > 0, tx.shared_count(a, b) / F.size(a)).otherwise(0.0)


#: Beyond so many milliseconds between two starts, time speaks against a match; nearer rows all meet.
FAR = 120_000
#: Rarest words that give a turn its first candidates; rows of a session that is compared whole.
SEEDS, SMALL = 3, 64


def _beyond(a: DataFrame, b: DataFrame) -> DataFrame:
    """session, id, batch_id: of each turn of a the two rows of b on either side that begin nearest to it but more than FAR away, among all rows and among those of its role.

    Starts are ranked in buckets of time, a turn's two bounds with them, and the rows of the ranks beside a bound are looked up.
    """

    def places(side: str, role: Column, at: Column, tie: Column) -> Column:
        return F.struct(role.alias("class"), F.lit(side).alias("side"), at.alias("at"), tie.cast("long").alias("tie"))

    def four(rows: DataFrame, left: Column, right: Column, new: int) -> DataFrame:
        named = [F.lit("*"), F.concat(F.lit("role "), "role")]
        each = F.explode(F.array(*[p for r in named for p in (places("left", r, left, -F.col("id")), places("right", r, right, F.col("id")))]))
        return rows.select("session", "id", each.alias("p")).select("session", "id", "p.*", F.lit(new).alias("new"), F.lit(1 - new).alias("asked")).filter("class is not null")

    both = four(b, F.col("start"), F.col("start"), 1).unionByName(four(a, F.col("start") - FAR - 1, F.col("start") + FAR, 0))
    by = ["session", "class", "side"]
    ranked = iv.numbered(iv.bucketed(both, "at"), by, ["at", "asked", "tie"], "new", "rank")
    first = F.when(F.col("side") == "left", F.col("rank") - 1).otherwise(F.col("rank") + 1)
    wanted = ranked.filter("asked = 1").select(*by, "id", F.explode(F.array(first, first + 1)).alias("rank"))
    return wanted.join(ranked.filter("asked = 0").select(*by, "rank", F.col("id").alias("batch_id")), [*by, "rank"]).select("session", "id", "batch_id")


def _scored(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """session, id, batch_id, batch_start, score, token_recall, away of candidate pairs."""
    left = a.select("session", "id", F.col("role").alias("a_role"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("items").alias("a_items"), "content")
    right = b.select("session", F.col("id").alias("batch_id"), F.col("role").alias("b_role"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("items").alias("b_items"))
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.repartition(spread, "session", "id").join(left, ["session", "id"]).join(right, ["session", "batch_id"])
    met = met.withColumn("n_shared", F.size(F.array_intersect("a_items", "b_items")))
    away = F.abs(F.col("a_start") - F.col("b_start"))
    nearness = F.when(F.col("content") > 3, 0.0).when(away <= 15_000, 0.35).when(away <= 45_000, 0.15).when(away > FAR, -0.25).otherwise(0.0)
    shared = F.col("n_shared") / F.size("a_items")
    overlaps = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    score = F.round(shared + F.when(overlaps, 0.15).otherwise(0.0) + F.when(F.col("a_role") == F.col("b_role"), 0.1).otherwise(0.0) + nearness, 6)
    return met.select("session", "id", "batch_id", F.col("b_start").alias("batch_start"), score.alias("score"), F.round(shared, 6).alias("token_recall"), away.alias("away"))


def best_match(turns: DataFrame, batch: DataFrame, same_role: bool = False) -> DataFrame:
    """session, id, batch_id, batch_start, score, token_recall, second_score, margin, plausible, ambiguous: for each turn with words, the best row of the batch in its session.

    The score is the recall of the turn's words, and more for overlap and an equal role; short turns (three content words at
    most) gain by nearness in time and lose by distance. Ties: higher recall, then nearer, then earlier, then smaller id.

    Turns meet the rows near in time, the nearest ones beyond, and the rows that have one of their rarest words. The second
    best of these bounds how many words any better row must share, so a turn looks up all but its commonest words, as many
    as that bound allows, in an index of words (the k-th of equal words is a word of its own). All pairs that could be first,
    second or plausible are scored exactly; no pair is made by the session alone. ids are whole numbers, unique in a session,
    and starts whole milliseconds; rows with a null session, id, start or end take no part.
    """
    spread = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small tables go to all cores as well

    def prepared(rows: DataFrame, columns: list[str]) -> DataFrame:
        known = rows.filter((F.size("tokens") > 0) & F.col("session").isNotNull() & F.col("id").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
        if same_role:
            known = known.filter(F.col("role").isNotNull()).withColumn("session", F.struct("session", "role"))
        return known.select("session", "id", "role", "start", "end", *columns, tx.elements(F.col("tokens")).alias("items")).repartition(spread, "session", "id")

    a, b = materialize(prepared(turns, ["content"]), "turns"), materialize(prepared(batch, []), "batch")
    whole = b.groupBy("session").agg(F.count("*").alias("_all"))
    # in a session of few rows all meet; the bound keeps pairs in proportion to turns
    few = whole.filter(F.col("_all") <= SMALL).select("session")
    pairs = a.join(few, "session").select("session", "id").join(b.select("session", F.col("id").alias("batch_id")), "session")
    rest_a, rest_b = a.join(few, "session", "left_anti"), b.join(few, "session", "left_anti")
    near = iv.overlap_join(
        rest_a.select("session", "id", (F.col("start") - FAR).alias("start"), (F.greatest("end", F.col("start") + FAR) + 1).alias("end")),
        rest_b.select("session", "id", "start", F.greatest("end", F.col("start") + 1).alias("end")), ["session"], FAR,
    ).select("session", F.col("l.id").alias("id"), F.col("r.id").alias("batch_id"))
    near = materialize(pairs.unionByName(near), "near")
    # turns that have met every row of their session have no more to look for
    met = near.groupBy("session", "id").agg(F.count("*").alias("_met"))
    open_ = rest_a.join(whole, "session").join(met, ["session", "id"], "left").filter(F.coalesce("_met", F.lit(0)) < F.col("_all")).drop("_all", "_met")
    scored = _all_scored(near, a, b, open_) if open_.limit(1).count() else _scored(near, a, b)
    if same_role:
        scored = scored.withColumn("session", F.col("session.session"))
    w = Window.partitionBy("session", "id")
    plausible = F.count_if((F.col("token_recall") >= 0.25) & (F.col("score") >= 0.35)).over(w)
    order = [F.desc("score"), F.desc("token_recall"), "away", "batch_start", "batch_id"]
    ranked = scored.withColumn("plausible", plausible).withColumn("second_score", F.coalesce(F.lead("score").over(w.orderBy(*order)), F.lit(0.0))).withColumn("_r", F.row_number().over(w.orderBy(*order))).filter("_r = 1")
    margin = F.round(F.col("score") - F.col("second_score"), 6)
    return ranked.select("session", "id", "batch_id", "batch_start", "score", "token_recall", "second_score", margin.alias("margin"), "plausible", ((F.col("plausible") > 1) & (margin < 0.20)).alias("ambiguous"))


def _all_scored(near: DataFrame, a_all: DataFrame, b_all: DataFrame, a: DataFrame) -> DataFrame:
    """Scored pairs of best_match: those of near, and for the turns a that have rows left to meet, all further ones that could count."""
    b = b_all.join(a.select("session").distinct(), "session", "left_semi")
    index = b.select("session", F.col("id").alias("batch_id"), F.explode("items").alias("item"))
    many = index.groupBy("session", "item").agg(F.count("*").alias("df"))
    own = a.select("session", "id", F.size("items").alias("n"), F.explode("items").alias("item")).join(many, ["session", "item"], "left")
    ordered = materialize(own.withColumn("place", F.row_number().over(Window.partitionBy("session", "id").orderBy("df", "item"))).filter("df is not null"), "items")
    # an item that no row has comes first: it takes a place of the rarest, but finds nothing
    seeds = ordered.withColumn("seed", F.row_number().over(Window.partitionBy("session", "id").orderBy("place"))).filter(F.col("seed") <= SEEDS)
    first = near.unionByName(_beyond(a, b)).unionByName(seeds.join(index, ["session", "item"]).select("session", "id", "batch_id")).distinct()
    first = materialize(_scored(first, a_all, b_all), "first")
    top = first.groupBy("session", "id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 2, 1).alias("second"))
    # a row further off gets 0.1 at most beside its recall
    least = F.ceil(F.least(F.lit(0.25), F.greatest(F.coalesce(F.get("second", F.lit(0)), F.lit(0.0)) - 0.1, F.lit(0.0))) * F.col("n") - 1e-5)
    looked = ordered.join(top, ["session", "id"]).filter((F.col("place") <= F.col("n") - F.greatest(least, F.lit(1)) + 1))
    more = looked.join(index, ["session", "item"]).select("session", "id", "batch_id").distinct().join(first, ["session", "id", "batch_id"], "left_anti")
    return first.unionByName(_scored(more, a, b))


def matched(turns: DataFrame, batch: DataFrame, least_recall: float = 0.25, least_score: float = 0.0) -> DataFrame:
    """The best matches that clear both floors."""
    return best_match(turns, batch).filter((F.col("token_recall") >= least_recall) & (F.col("score") >= least_score))


def tokens_around(turns: DataFrame, others: DataFrame, bucket: int = 60_000) -> DataFrame:
    """session, id and the words of all rows of others that overlap the turn, in their order; an empty list if none does."""
    pairs = iv.overlap_join(turns.select("session", "id", "start", "end"), others.select("session", "start", "end", "tokens", F.col("id").alias("oid")), ["session"], bucket)
    near = pairs.groupBy("session", F.col("l.id").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("r.start").alias("s"), F.col("r.oid").alias("o"), F.col("r.tokens").alias("t")))), lambda x: x["t"])).alias("around"))
    return turns.select("session", "id").join(near, ["session", "id"], "left").withColumn("around", F.coalesce("around", F.array().cast("array<string>")))


def leaked(turns: DataFrame, batch: DataFrame) -> DataFrame:
    """Turns of role Me, three words and more, whose words the other side said meanwhile (recall .55) and Me didn't (under .35)."""
    me = turns.filter((F.col("role") == "Me") & (F.size("tokens") >= 3))
    own, far = (tokens_around(me, batch.filter(F.col("role") == r)).withColumnRenamed("around", n) for r, n in (("Me", "own"), ("Colleagues", "far")))
    rows = me.join(own, ["session", "id"]).join(far, ["session", "id"])
    rows = rows.select("session", "id", F.round(recall(F.col("tokens"), F.col("own")), 6).alias("same_role_recall"), F.round(recall(F.col("tokens"), F.col("far")), 6).alias("remote_role_recall"))
    return rows.filter((F.col("remote_role_recall") >= 0.55) & (F.col("same_role_recall") < 0.35))


def missing(batch: DataFrame, turns: DataFrame) -> DataFrame:
    """Batch rows of role Me, two words and more and not suspicious, that live turns of Me hardly hold (recall under .35)."""
    me = batch.filter((F.col("role") == "Me") & (F.size("tokens") >= 2) & ~F.coalesce(F.col("suspicious"), F.lit(False)))
    rows = me.join(tokens_around(me, turns.filter("role = 'Me'")), ["session", "id"])
    return rows.select("session", "id", F.round(recall(F.col("tokens"), F.col("around")), 6).alias("recall")).filter("recall < 0.35")


def covered_by_base(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """session, id, base_id: candidates that a base turn of their role and chunk covers by .60 with .80 of their words; of several the first."""
    pairs = iv.overlap_join(candidates, base, ["session", "chunk", "role"], 60_000)
    shared = iv.overlap(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"))
    good = pairs.filter((shared >= 0.60 * (F.col("l.end") - F.col("l.start"))) & (recall(F.col("l.tokens"), F.col("r.tokens")) >= 0.80))
    return good.groupBy("session", F.col("l.id").alias("id")).agg(F.min_by("r.id", F.struct("r.start", "r.id")).alias("base_id"))


def best_remote(candidates: DataFrame, remote: DataFrame, terms: list[str], band: int = 1000) -> DataFrame:
    """candidates with their best remote row within a second: half its overlap by the shorter, then text and term likeness. Without one: zeros and 999 s.

    Adds remote_id, time_overlap, similarity, term_overlap, distance_sec. Of equal scores the first by start and end stays.
    """
    wide = candidates.select("session", "id", (F.col("start") - band).alias("start"), (F.col("end") + band + 1).alias("end"), "text")
    pairs = iv.overlap_join(wide, remote.select("session", "id", "start", (F.col("end") + 1).alias("end"), "text"), ["session"], 60_000)
    s, e, rs, re = F.col("l.start") + band, F.col("l.end") - band - 1, F.col("r.start"), F.col("r.end") - 1
    shared = iv.overlap(s, e, rs, re) / F.greatest(F.lit(1), F.least(e - s, re - rs))
    near = F.least(F.abs(s - re), F.abs(rs - e))
    flat = pairs.select("session", F.col("l.id").alias("id"), F.col("r.id").alias("remote_id"), rs.alias("rs"), re.alias("re"), shared.alias("o"), near.alias("near"), F.col("l.text").alias("x"), F.col("r.text").alias("y")).filter((F.col("o") > 0) | (F.col("near") <= band))
    flat = dealt(flat, "session", "id", "remote_id").withColumn("t", st.text_similarity(F.col("x"), F.col("y"))).withColumn("d", st.term_overlap(F.col("x"), F.col("y"), terms))
    score = F.col("o") * 0.50 + F.col("t") * 0.35 + F.col("d") * 0.15
    best = flat.groupBy("session", "id").agg(F.max_by(F.struct("remote_id", "o", "t", "d", F.when(F.col("o") > 0, 0).otherwise(F.col("near")).alias("n")), F.struct(score, -F.col("rs"), -F.col("re"))).alias("b"))
    out = candidates.join(best, ["session", "id"], "left")
    named = [F.col("b.remote_id").alias("remote_id"), *[F.round(F.coalesce(F.col(f"b.{c}"), F.lit(0.0)), 6).alias(n) for c, n in (("o", "time_overlap"), ("t", "similarity"), ("d", "term_overlap"))]]
    return out.select(*candidates.columns, *named, F.coalesce(F.round(F.col("b.n") / 1000, 3), F.lit(999.0)).alias("distance_sec"))


def lexical(a: Column, b: Column) -> tuple[Column, Column]:
    """Likeness of two token lists (the larger of shared words by the shorter list, and the sequence ratio of the joined words), and shared words."""
    shared = tx.shared_count(a, b)
    inside = F.when(F.least(F.size(a), F.size(b)) > 0, shared / F.least(F.size(a), F.size(b))).otherwise(0.0)
    return F.greatest(inside, st.sequence_ratio(F.array_join(a, " "), F.array_join(b, " "))), shared


def align(reference: DataFrame, turns: DataFrame, offset: int = 0, tolerance: int = 12_000, least: float = 0.45) -> DataFrame:
    """session, id, matched, turn_id, score, shared for each reference row: the best turn within the tolerance, three quarters by words and one by time.

    A match needs the least score and two shared words, one for rows of up to three words.
    """
    moved = reference.select("session", "id", (F.col("start") + offset).alias("s"), (F.col("end") + offset).alias("e"), "tokens")
    wide = moved.select("session", "id", (F.col("s") - tolerance).alias("start"), (F.col("e") + tolerance + 1).alias("end"), "tokens")
    pairs = iv.overlap_join(wide, turns.select("session", "id", "start", (F.col("end") + 1).alias("end"), "tokens"), ["session"], 60_000)
    s, e, ts, te = F.col("l.start") + tolerance, F.col("l.end") - tolerance - 1, F.col("r.start"), F.col("r.end") - 1
    shared_time = iv.overlap(s, e, ts, te)
    time = F.when(shared_time > 0, F.least(F.lit(1.0), shared_time / F.greatest(F.lit(10), e - s))).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.abs(s - te), F.abs(ts - e)) / 12_000))
    flat = pairs.select("session", F.col("l.id").alias("id"), F.col("r.id").alias("turn_id"), F.col("l.tokens").alias("a"), F.col("r.tokens").alias("b"), time.alias("time"))
    words, shared = lexical(F.col("a"), F.col("b"))
    flat = dealt(flat, "session", "id", "turn_id").withColumn("lex", words).withColumn("shared", shared)
    score = 0.75 * F.col("lex") + 0.25 * F.col("time")
    best = flat.groupBy("session", "id").agg(F.max(F.struct(score.alias("score"), "lex", "time", "shared", (-F.col("turn_id")).alias("t"))).alias("b"))
    out = reference.join(best, ["session", "id"], "left")
    ok = F.coalesce((F.col("b.score") >= least) & (F.col("b.shared") >= F.when(F.size("tokens") <= 3, 1).otherwise(2)), F.lit(False))
    return out.select("session", "id", ok.alias("matched"), F.when(ok, -F.col("b.t")).alias("turn_id"), F.round(F.coalesce("b.score", F.lit(0.0)), 6).alias("score"), F.coalesce("b.shared", F.lit(0)).alias("shared"))


def rare_token_pairs(reference: DataFrame, local: DataFrame, rarest: int = 3) -> DataFrame:
    """session, id, local_id: rows that share one of the reference row's rarest tokens among those the session's local rows have (ties: by token)."""
    index = local.select("session", F.col("id").alias("local_id"), F.explode(F.array_distinct("tokens")).alias("t"))
    count = index.groupBy("session", "t").agg(F.count("*").alias("df"))
    own = reference.select("session", "id", F.explode(F.array_distinct("tokens")).alias("t")).join(count, ["session", "t"])
    top = own.withColumn("_r", F.row_number().over(Window.partitionBy("session", "id").orderBy("df", "t"))).filter(F.col("_r") <= rarest).drop("_r", "df")
    return top.join(index, ["session", "t"]).select("session", "id", "local_id").distinct()


def anchors(reference: DataFrame, local: DataFrame, least_words: int = 4, least_score: float = 0.75) -> DataFrame:
    """session, id, local_id, offset (of the middles), score, shared: the best lexical match of each reference row among rare-token candidates."""
    ref = reference.filter(F.size("tokens") >= least_words)
    a = ref.select("session", "id", F.col("tokens").alias("a"), ((F.col("start") + F.col("end")) / 2).alias("am"))
    b = local.select("session", F.col("id").alias("local_id"), F.col("tokens").alias("b"), ((F.col("start") + F.col("end")) / 2).alias("bm"))
    pairs = rare_token_pairs(ref, local).join(a, ["session", "id"]).join(b, ["session", "local_id"])
    words, shared = lexical(F.col("a"), F.col("b"))
    pairs = dealt(pairs.withColumn("shared", shared).filter(F.col("shared") >= least_words), "session", "id", "local_id").withColumn("score", words)
    best = pairs.groupBy("session", "id").agg(F.max(F.struct("score", "shared", (-F.col("local_id")).alias("l"), (F.col("bm") - F.col("am")).alias("offset"))).alias("x"))
    return best.select("session", "id", (-F.col("x.l")).alias("local_id"), "x.offset", F.round("x.score", 6).alias("score"), "x.shared").filter(F.col("score") >= least_score)


def clock_fit(pairs: DataFrame, by: str, wide: float = 30.0, narrow: float = 10.0) -> DataFrame:
    """by, slope, intercept, used: a line through pairs(by, x, y) that lie within wide of the median offset, fitted again to those within narrow of it."""
    from colloquy.operators.evaluation import percentiles

    away = pairs.withColumn("_o", F.col("y") - F.col("x"))
    near = away.join(percentiles(away, [by], "_o", {"_m": 0.5}), by).filter(F.abs(F.col("_o") - F.col("_m")) <= wide)

    def fitted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("used"))

    first = fitted(near).select(by, F.col("slope").alias("_a"), F.col("intercept").alias("_b"))
    return fitted(near.join(first, by).filter(F.abs(F.col("y") - F.col("_a") * F.col("x") - F.col("_b")) <= narrow))
