"""Document fingerprints by I-Match with randomised lexicon subsets, in DataFrame functions only.

A text's terms are its distinct lower-case words, except those in more than a share of all documents: the band of inverse
document frequency is open at the rare end, where terms tell most. Terms are known by 64-bit hashes, and their document
frequencies counted in a table of hashed slots, so its size is fixed. The set of all terms, and of those in each of REPLICAS
random lexicon subsets at every one of LEVELS sampling rates, is hashed by combining term hashes so that order doesn't
matter, which takes the place of sorting; the hashes make up the fingerprint. Short texts meet in dense subsets, long ones
in sparse subsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.storage import discard, materialize

SLOTS = 1 << 18
#: A subset at level j holds a term if 2 * j bits of its hash, from a place of its own on, are zero: one term in 4**j. A hash has room for so many.
REPLICAS, LEVELS, TO_A_HASH = 12, 7, 4
_EMPTY = "...."
_SPACES = r"[ \t-\r]+"
_LEAST_KEY = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of the different lower-case words; white space at an end adds the empty word, which the band leaves out."""
    return F.array_distinct(F.transform(F.split(F.lower(text), _SPACES), lambda w: F.xxhash64(w)))


def band(docs: DataFrame, max_share: float) -> tuple[list[int], list[int]]:
    """Of docs(text): the terms in more than max_share of them, at most distinct terms a document / max_share; and a mask, 32 bits a number, of the slots whose terms occur in two documents or more."""
    limit = max(1.0, docs.count() * max_share)
    counts = docs.select(F.explode(terms(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    counts = materialize(counts, "terms")
    frequent = [r["h"] for r in counts.filter(F.col("n") > limit).select("h").collect()]
    slots = counts.groupBy(F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.sum("n").alias("n")).filter("n > 1")
    mask = [0] * (SLOTS // 32)
    for r in slots.groupBy(F.expr("slot div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("b")).collect():
        mask[r["w"]] = r["b"]
    discard(counts)
    return frequent, mask


def band_terms(text: Column, frequent: list[int], mask: list[int]) -> Column:
    """Sorted hashes of the text's terms in the band."""
    held, empty = F.from_json(F.lit(str(mask)), "array<bigint>"), F.xxhash64(F.lit(""))

    def inside(h: Column) -> Column:
        slot = F.pmod(h, F.lit(SLOTS))
        bit = F.get(held, F.floor(slot / 32).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(32)).cast("int")))
        seen = (bit != 0) & (h != empty)
        return seen & ~h.isin(frequent) if frequent else seen

    return F.array_sort(F.filter(terms(text), inside))


def _four(x: Column) -> Column:
    return F.when(F.size(x) == 0, _EMPTY).otherwise(F.lpad(F.hex(F.pmod(F.xxhash64(x), F.lit(65536))), 4, "0"))


def with_fingerprint(rows: DataFrame, text: str, name: str, frequent: list[int], mask: list[int]) -> DataFrame:
    """Adds the fingerprint of a text column: four signs for all terms and four for each subset, dots where it is empty."""
    sides = [lambda h: h, lambda h: F.xxhash64(h), lambda h: F.xxhash64(h, F.lit(1))]
    rows = rows.withColumn("_l0", F.array(band_terms(F.col(text), frequent, mask)))
    signs = ["_s0"]
    rows = rows.withColumn("_s0", _four(F.get("_l0", F.lit(0))))
    for level in range(1, LEVELS + 1):

        def kept(r: int, level: int = level) -> Column:
            bits = 3 << (2 * (LEVELS * (r % TO_A_HASH) + level - 1))
            side = sides[r // TO_A_HASH]
            return F.filter(F.get(f"_l{level - 1}", F.lit(0 if level == 1 else r)), lambda h: side(h).bitwiseAND(F.lit(bits)) == 0)

        rows = rows.withColumn(f"_l{level}", F.array(*[kept(r) for r in range(REPLICAS)])).drop(f"_l{level - 1}")
        rows = rows.withColumn(f"_s{level}", F.array_join(F.transform(f"_l{level}", _four), ""))
        signs.append(f"_s{level}")
    return rows.withColumn(name, F.concat(*signs)).drop(*signs, f"_l{LEVELS}")


def likeness(a: str, b: str) -> Column:
    """0 to 1 for two fingerprint columns: 1 if they are equal, else the largest share of equal subsets, of those with a term, at any level."""
    shares = []
    for level in range(LEVELS):
        begin = 5 + level * REPLICAS * 4
        places = f"sequence({begin}, {begin + (REPLICAS - 1) * 4}, 4)"
        some = f"size(filter({places}, p -> substr({a}, p, 4) <> '{_EMPTY}' or substr({b}, p, 4) <> '{_EMPTY}'))"
        same = f"size(filter({places}, p -> substr({a}, p, 4) <> '{_EMPTY}' and substr({a}, p, 4) = substr({b}, p, 4)))"
        shares.append(F.expr(f"cast({same} as double) / greatest({some}, 3)"))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(*shares))


def _bucket(docs: DataFrame, rows: int) -> Column:
    """A number for ranges of column key, in its order, of about as many rows: between quantiles, and interpolated inside these."""
    many = 256
    cuts = docs.agg(F.percentile_approx("key", [i / many for i in range(many + 1)], 10_000), F.count("*")).first()
    edges = sorted({int(x) for x in cuts[0] or [0]})
    each = max(1, round(cuts[1] / max(len(edges) - 1, 1) / rows))
    held = F.from_json(F.lit(str([*edges, edges[-1] + 1])), "array<bigint>")
    at = F.greatest(F.size(F.filter(held, lambda e: e <= F.col("key"))) - 1, F.lit(0))
    low, high = F.get(held, at).cast("double"), F.get(held, at + 1).cast("double")
    inner = F.least(F.floor((F.col("key").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * each), F.lit(each - 1))
    return (at * each + F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0))).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """docs(key, text, bucket, ...) with next_text of the row with the next smaller key (ties: smaller text); after the last row comes the first.

    Rows are sorted in buckets of bounded size. Each bucket also gets, as a last row with guest true, the first row of the
    bucket below it, found by a window over the short list of buckets.
    """
    ends = docs.groupBy("bucket").agg(F.max("key").alias("key"))
    below = F.lead("key").over(Window.orderBy(F.desc("bucket")))
    top = ends.agg(F.max("key").alias("_top"))  # one row
    ends = materialize(ends.select("bucket", below.alias("key")).join(F.broadcast(top)).select(F.col("bucket").alias("_into"), F.coalesce("key", "_top").alias("key")), "ends")
    guests = docs.join(ends, "key").select(*[c for c in docs.columns if c != "bucket"], F.col("_into").alias("bucket"), F.lit(True).alias("guest"))
    both = docs.withColumn("guest", F.lit(False)).select(*guests.columns).unionAll(guests)
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("text"))
    return both.withColumn("next_text", F.lead("text").over(order))


def fingerprint_documents(docs: DataFrame, max_share: float = 0.1) -> DataFrame:
    """Fingerprints each row of docs(doc_id, text), and its text with the last third replaced by the next document's start.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document has
    the next smaller doc_id; a null doc_id comes after all others, and rows with one doc_id follow each other by text. A
    null text counts as empty. Texts without terms in the band have equal fingerprints, all dots. A single row is its own
    next. An empty table gives no rows; other columns are ignored.

    Texts are shuffled once, into the buckets; all that follows keeps that partitioning.
    """
    size = docs.count()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_KEY)).alias("key"))
    frequent, mask = band(docs, max_share)
    rows = with_next(docs.withColumn("bucket", _bucket(docs, max(500, min(20_000, size // 400)))))
    third = "cast(floor(length(text) / 3) as int)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {third}), substring(next_text, 1, {third}))")
    rows = rows.withColumn("edited", F.when(~F.col("guest"), F.coalesce(edited, F.lit(""))))
    rows = with_fingerprint(rows, "text", "fingerprint", frequent, mask)
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("text"))
    rows = rows.withColumn("_next", F.lead("fingerprint").over(order)).filter("not guest").drop("next_text")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).drop("text")
    out = with_fingerprint(rows, "edited", "edited_fingerprint", frequent, mask)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_next").alias("near_next"))
