"""Text functions as column expressions: normalising, tokens, n-grams, similarity of token lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, all but letters, digits and + - / as spaces, runs of spaces as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}+/-]+", " "), " +", " "))


def tokens(text: Column) -> Column:
    """Words of the normalised text."""
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def content_tokens(text: Column, stop: list[str], least: int = 3) -> Column:
    """Different words of at least `least` letters outside the stop list, in order of first use."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~t.isin(stop)))


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short(text: Column, limit: int) -> Column:
    """The text, or its first limit - 1 characters without trailing spaces and an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def char_ngrams(text: Column, size: int = 3) -> Column:
    """Different n-grams of the normalised text without spaces; a shorter text is its own, an empty one has none."""
    letters = F.filter(F.split(F.regexp_replace(normalize(text), " ", ""), ""), lambda c: c != "")

    def grams(c: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(c) - size + 1, F.lit(1)))
        return F.when(F.size(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(c, i, size), ""))))

    return once(letters, grams)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often it is used in conditions and lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""

    def share(s: Column) -> Column:
        x, y = s["a"], s["b"]
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    return once(F.struct(a.alias("a"), b.alias("b")), share)


def containment(a: Column, b: Column) -> Column:
    """Share of a's different items that b has; 0 if a is empty."""
    own = F.array_distinct(a)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, b)) / F.size(own))


def ranked(a: Column) -> Column:
    """Each item with how many equal ones come before it: as a set, these pairs are the multiset."""
    return F.transform(a, lambda x, i: F.struct(x.alias("t"), F.size(F.filter(F.slice(a, F.lit(1), i), lambda y: y == x)).alias("k")))


def elements(a: Column) -> Column:
    """Hashes of 64 bits of each item with its number among equal ones: as a set, these are the multiset."""
    hashes = F.sort_array(F.transform(a, lambda x: F.xxhash64(x)))
    return once(hashes, lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x))))


def shared_count(a: Column, b: Column) -> Column:
    """How many items two token lists share as multisets."""
    return F.size(F.array_intersect(elements(a), elements(b)))


def multiset_intersect(a: Column, b: Column) -> Column:
    """Items of a that b has as well, each as often as in both, in the order of a."""
    return F.transform(F.array_intersect(ranked(a), ranked(b)), lambda x: x["t"])


def multiset_except(a: Column, b: Column) -> Column:
    """Items of a beyond those that b has, in the order of a; of equal items the first ones are matched."""
    return F.transform(F.array_except(ranked(a), ranked(b)), lambda x: x["t"])


def suffix_prefix(a: Column, b: Column) -> Column:
    """The longest k so that the last k items of a are the first k of b."""
    most = F.least(F.size(a), F.size(b))
    ks = F.filter(F.sequence(F.lit(0), most), lambda k: (k == 0) | (F.slice(a, F.size(a) - k + 1, F.greatest(k, F.lit(1))) == F.slice(b, F.lit(1), F.greatest(k, F.lit(1)))))
    return F.array_max(ks)


def find_sublist(a: Column, b: Column) -> Column:
    """First index, from 0, at which the items of b follow each other in a; -1 if never, 0 for an empty b."""
    n, m = F.size(a), F.size(b)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: (i + m - 1 <= n) & (F.slice(a, i, F.greatest(m, F.lit(1))) == b))
    return F.when(m == 0, 0).otherwise(F.coalesce(F.get(at, F.lit(0)) - 1, F.lit(-1)))


def count_sublist(a: Column, b: Column) -> Column:
    """How often b occurs in a, overlaps included; 0 for an empty b."""
    n, m = F.size(a), F.size(b)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: (i + m - 1 <= n) & (F.slice(a, i, F.greatest(m, F.lit(1))) == b))
    return F.when(m == 0, 0).otherwise(F.size(at))


def repeated_unit(a: Column, most: int = 4, least: int = 4) -> Column:
    """Length of the shortest unit of up to `most` items that makes up the whole list at least `least` times; null if none."""
    def fits(k: Column) -> Column:
        return (F.size(a) % k == 0) & (F.size(a) / k >= least) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: F.get(a, i - 1) == F.get(a, (i - 1) % k))

    return F.array_min(F.filter(F.sequence(F.lit(1), F.lit(most)), fits))


def parse_clock(value: Column) -> Column:
    """mm:ss or hh:mm:ss as seconds; null for anything else."""
    p = F.split(value, ":")
    n = F.transform(p, lambda x: F.expr("1") * x.try_cast("int"))
    return F.when(F.size(p) == 2, F.get(n, F.lit(0)) * 60 + F.get(n, F.lit(1))).when(F.size(p) == 3, F.get(n, F.lit(0)) * 3600 + F.get(n, F.lit(1)) * 60 + F.get(n, F.lit(2)))


def format_clock(seconds: Column) -> Column:
    """Whole seconds as [hh:]mm:ss."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is null or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def level_db(samples: Column, floor: float = -120.0) -> Column:
    """Root mean square in dB, at least floor; floor for no samples."""
    mean = dot(samples, samples) / F.greatest(F.size(samples), F.lit(1))
    return F.round(F.greatest(F.when(mean > 0, 10 * F.log10(mean)).otherwise(floor), F.lit(floor)), 3)


def unit(vector: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    vector = F.col(vector) if isinstance(vector, str) else vector

    def scaled(v: Column) -> Column:
        return once(F.sqrt(dot(v, v)), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v))

    return once(F.transform(vector, lambda x: x.cast("double")), scaled)


def target_score(x: Column, positive: Column, negative: Column) -> Column:
    """Similarity to a voice, less that to its contrast; a missing contrast counts 0."""
    return cosine(x, positive) - cosine(x, negative)


def peak_db(samples: Column) -> Column:
    """The largest amplitude in dB; -240 for silence, -120 for no samples."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.coalesce(F.round(20 * F.log10(top + 1e-12), 3), F.lit(-120.0))


def zero_lag_corr(a: Column, b: Column, least: int = 160) -> Column:
    """Absolute Pearson correlation of the samples that both have; 0 for fewer than least, or flat ones."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), F.greatest(n, F.lit(1))), F.slice(b, F.lit(1), F.greatest(n, F.lit(1)))

    def mean(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, w: s + w.cast("double")) / n

    def centred(v: Column) -> Column:
        return F.transform(v, lambda w: w.cast("double") - mean(v))

    return F.when(n < least, 0.0).otherwise(F.abs(cosine(centred(x), centred(y))))


def shifted(samples: Column, by: int) -> Column:
    """The signal of equal length moved by some samples, zeros where nothing is left; negative numbers move it forward."""
    n = F.size(samples)
    zeros = F.array_repeat(F.lit(0.0), F.least(F.lit(abs(by)), n))
    kept = F.greatest(n - abs(by), F.lit(0))
    body = F.transform(F.slice(samples, F.lit(1 if by >= 0 else 1 - by), kept), lambda x: x.cast("double"))
    return F.concat(zeros, body) if by >= 0 else F.concat(body, zeros)


def vad_ratio(raw: Column, clean: Column, frame: int, threshold: float) -> Column:
    """Full frames of the clean signal at or over the threshold in dB, by those of the raw signal; 1 if the raw one has none."""

    def active(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(x) / frame).cast("int") - 1, F.lit(0))), lambda i: F.slice(x, i * frame + 1, F.lit(frame)))
        return F.size(F.filter(parts, lambda p: (F.size(p) == frame) & (10 * F.log10(dot(p, p) / frame + 1e-12) >= threshold)))

    return F.when(active(raw) == 0, 1.0).otherwise(active(clean) / active(raw))


def dedupe_strings(values: Column) -> Column:
    """Trimmed different strings in the order of their first use, without nulls and empty ones."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def edit_le_1(a: Column, b: Column) -> Column:
    """Whether one edit at most leads from a to b; lengths are compared first."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b) <= 1)


def probable_noise(text: Column, ms: Column, mean_p: Column, low_share: Column) -> Column:
    """At most two words in three seconds and more, with a low mean probability or many improbable tokens; unknown figures speak for neither."""
    few = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")) <= 2
    return few & (ms >= 3000) & (F.coalesce(mean_p < 0.64, F.lit(False)) | F.coalesce(low_share >= 0.45, F.lit(False)))
