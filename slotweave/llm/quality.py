"""Quality rules: base thresholds, then robust multivariate outliers per language and source.

Method: every document gets a vector of transformed statistics. For each (language,
source) the minimum-covariance-determinant (MCD) estimate of location and scatter is
found by concentration steps from two deterministic starts (median with MAD, and the
plain mean with covariance): a step keeps the 75 % of the group's documents with the
least Mahalanobis distance and estimates again; the start that ends with the lesser
determinant wins. A last reweighted estimate uses all documents within the 97.5 %
point. A document whose squared distance exceeds the ``OUTLIER`` point is rejected.

Statistics (``x1`` to ``x4``): log mean word length, and the variance-stabilised
(arcsine square root) shares of symbols, of repeated lines and of repeated words.
Each is shrunk by a few pseudo-observations, so that short documents aren't outliers
for being short. ``FLOOR`` is added to the variances: most documents have no repeated
line at all, which alone would make the scatter singular.

Main path: DataFrame functions only. Distances go through Cholesky factors held in
columns. A narrow table (id, counts, vector) is written once; the steps then only
aggregate it: sums and mergeable quantile sketches, one row per group.

Groups of fewer than ``MIN_GROUP`` documents are pooled by language; if that pool is
smaller still, its documents are judged by the whole language, and where that is too
small, by all documents, however few. Every document thus gets a verdict.

Edge cases: a null or empty text has no words, so it fails the base rules; null
language or source is a value of its own; repeated rows each get their row; an empty
table gives an empty result; other input columns are ignored by ``measure`` and
returned untouched by ``keep``. Repeated 5-word windows are found by 64-bit hashes
within one document, as whole texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, small, stored, table

SYMBOLS = "#*$%&|<>"
GRAM = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SUBSET, STEPS, MIN_GROUP = 0.75, 4, 40
DIM = 4
#: That of the symbols is about the sampling noise of a share in 300 characters.
FLOOR = (0.06**2, 0.03**2, 0.12**2, 0.12**2)
#: A squared distance above the 99.99 % point of chi-square with 4 degrees (23.5) is an outlier.
OUTLIER = 0.9999
ACCURACY = 10_000


def _chi4(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def _chi6(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)


def _chi4_point(p: float) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi4(mid) < p else (lo, mid)
    return lo


CUTOFF = _chi4_point(OUTLIER)


#: What a covariance of the inner share ``p`` of a normal sample falls short of the whole one's.
def consistency(p: float) -> float:
    return p / _chi6(_chi4_point(p))


def counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, the base counts and ``_lines`` (lines with a word)."""
    bare = F.expr("trim(BOTH ' \\t\\n\\u000b\\f\\r' FROM coalesce(text, ''))")
    t = docs.select("doc_id", *carry, F.col("text"), bare.alias("_bare"))
    spaces = F.lit(SPACE_CHARS)
    t = t.select(
        "doc_id",
        *carry,
        F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", r"[\x20\x09-\x0D]+")).alias("_w"),
        F.char_length(F.translate("_bare", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length("_bare") - F.char_length(F.translate("_bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, spaces) != "").alias("_l"),
    )
    n = F.size("_w")
    grams = F.transform(
        F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(GRAM)])
    )
    t = t.select(
        "doc_id",
        *carry,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("_lines"),
        F.when(n >= GRAM, grams).alias("_g"),
    )
    again = F.col("_g").isNotNull() & (F.size(F.array_distinct("_g")) < F.size("_g"))
    keep = [*["doc_id", *carry], "n_words", "word_chars", "n_symbols", "n_dup_lines", "_lines"]
    t = t.select(*keep, F.when(again, F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("_s"))
    same = lambda s, k: (F.get(F.col("_s"), k - 1)["x"] == s["x"]) | (F.get(F.col("_s"), k + 1)["x"] == s["x"])
    t = t.select(*keep, F.sort_array(F.transform(F.filter("_s", lambda s, k: F.coalesce(same(s, k), F.lit(False))), lambda s: s["i"])).alias("_p"))
    start = F.struct(F.lit(-GRAM).alias("last"), F.lit(0).alias("covered"))
    step = lambda a, p: F.struct(p.alias("last"), (a["covered"] + F.least(F.lit(GRAM), p - a["last"])).alias("covered"))
    # a boundary case: comparing a sorted hash with both neighbours marks every window that is found twice or more
    covered = F.aggregate("_p", start, step, lambda a: a["covered"])
    return t.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vector(t: DataFrame) -> DataFrame:
    share = lambda part, whole, more: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / (F.col(whole) + more))))
    return t.withColumns(
        {
            "x1": F.log((F.col("word_chars") + 110.0) / (F.col("n_words") + 20.0)),
            "x2": share("n_symbols", "word_chars", 20.0),
            "x3": share("n_dup_lines", "_lines", 5.0),
            "x4": share("n_repeat_words", "n_words", 20.0),
        }
    )


X = [f"x{i + 1}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def _moments(scale: float) -> list[Column]:
    """Aggregates: the count, means m1.. and covariances c11.. (times ``scale``)."""
    out = [F.count(F.lit(1)).alias("n")] + [F.avg(x).alias(f"m{i + 1}") for i, x in enumerate(X)]
    return out + [(F.covar_pop(X[i], X[j]) * scale).alias(f"c{i + 1}{j + 1}") for i, j in PAIRS]


def _factors(t: DataFrame) -> DataFrame:
    """Cholesky factors l11.. of the covariances with FLOOR added, and their log determinant."""
    for i, j in PAIRS:
        c = F.coalesce(F.col(f"c{i + 1}{j + 1}"), F.lit(0.0)) + (FLOOR[i] if i == j else 0.0)
        for k in range(j):
            c = c - F.col(f"l{i + 1}{k + 1}") * F.col(f"l{j + 1}{k + 1}")
        t = t.withColumn(f"l{i + 1}{j + 1}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l{j + 1}{j + 1}"))
    logdet = sum((F.log(f"l{i + 1}{i + 1}") for i in range(DIM)), F.lit(0.0))
    return t.select("g", "start", *[f"m{i + 1}" for i in range(DIM)], *[f"l{i + 1}{j + 1}" for i, j in PAIRS], logdet.alias("logdet"))


def _distance(t: DataFrame) -> DataFrame:
    """``d2``: the squared Mahalanobis distance by forward substitution."""
    for i in range(DIM):
        z = F.col(X[i]) - F.col(f"m{i + 1}")
        for j in range(i):
            z = z - F.col(f"l{i + 1}{j + 1}") * F.col(f"_z{j + 1}")
        t = t.withColumn(f"_z{i + 1}", z / F.col(f"l{i + 1}{i + 1}"))
    return t.withColumn("d2", sum((F.col(f"_z{i + 1}") * F.col(f"_z{i + 1}") for i in range(DIM)), F.lit(0.0)))


def estimates(rows: DataFrame, n_groups: int) -> DataFrame:
    """(g, m.., l..): reweighted MCD location and Cholesky factors per group of ``rows`` (g, x1..x4)."""
    with_start = lambda t, s: t.withColumn("start", F.lit(s))
    med = rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, ACCURACY).alias(f"m{i + 1}") for i, x in enumerate(X)])
    dev = rows.join(small(med, n_groups), "g").groupBy("g", *[f"m{i + 1}" for i in range(DIM)])
    dev = dev.agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i + 1}")), 0.5, ACCURACY).alias(f"s{i + 1}") for i, x in enumerate(X)])
    zero = {f"c{i + 1}{j + 1}": (F.pow(F.col(f"s{i + 1}") * 1.4826, 2) if i == j else F.lit(0.0)) for i, j in PAIRS}
    first = _factors(with_start(dev.withColumns(zero), 0)).unionByName(_factors(with_start(rows.groupBy("g").agg(*_moments(1.0)), 1)))
    est = stored(first, "mcd")
    for _ in range(STEPS):
        d = _distance(rows.join(small(est, 2 * n_groups), "g")).select("g", "start", "d2", *X)
        cut = d.groupBy("g", "start").agg(F.percentile_approx("d2", SUBSET, ACCURACY).alias("cut"))
        inner = d.join(small(cut, 2 * n_groups), ["g", "start"]).where(F.col("d2") <= F.col("cut"))
        est = stored(_factors(inner.groupBy("g", "start").agg(*_moments(consistency(SUBSET)))), "mcd", replaces=est)
    best = est.groupBy("g").agg(F.min_by(F.struct(*est.columns), F.struct("logdet", "start")).alias("e")).select("e.*")
    d = _distance(rows.join(small(best, n_groups), "g")).where(F.col("d2") <= _chi4_point(0.975))
    last = d.groupBy("g").agg(*_moments(consistency(0.975))).withColumn("start", F.lit(2))
    # where nothing lies within (it can't, but for rounding), the raw estimate stands
    both = _factors(last).unionByName(best)
    return both.groupBy("g").agg(F.max_by(F.struct(*both.columns), "start").alias("e")).select("e.*")


def measure(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``carry``, the counts, base_failed, distance2, kept."""
    base = vector(counts(docs, tuple(dict.fromkeys(("lang", "source", *carry)))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    key = lambda *c: F.concat_ws("\u0001", *[F.coalesce(F.col(x), F.lit("\u0002")) for x in c])
    base = stored(base.withColumn("base_failed", failed).withColumn("_gl", key("lang")).withColumn("_gs", key("lang", "source")), "stats")
    ok = base.where(~F.col("base_failed"))
    size = stored(ok.groupBy("_gl", "_gs").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    n_groups = size.count()
    of_lang = size.groupBy("_gl").agg(F.sum("_n").alias("_all"), F.sum(F.when(F.col("_n") < MIN_GROUP, F.col("_n"))).alias("_pool"))
    lacks = F.coalesce(F.col("_pool") < MIN_GROUP, F.lit(False))  # some documents of the language need more than their pool
    of_lang = of_lang.withColumn("_wide", F.when(lacks & (F.col("_all") >= MIN_GROUP), "L").when(lacks, "a"))
    every = of_lang.agg(F.coalesce(F.bool_or(F.col("_wide") == "a"), F.lit(False)).alias("_every"))
    whole = F.when(F.col("_wide") == "L", F.concat(F.lit("L"), F.col("_gl")))
    narrow = F.when(F.col("_n") >= MIN_GROUP, F.concat(F.lit("s"), F.col("_gs"))).when(F.col("_pool") >= MIN_GROUP, F.concat(F.lit("l"), F.col("_gl")))
    names = size.join(small(of_lang, n_groups), "_gl").crossJoin(F.broadcast(every)).select(  # one row
        "_gs",
        F.coalesce(narrow, whole, F.lit("a")).alias("g"),
        F.array_compact(F.array(narrow, whole, F.when(F.col("_every"), "a"))).alias("_in"),
    )
    names = stored(names, "groups")
    # a document counts in every group that someone is judged by
    rows = stored(ok.join(small(names, n_groups), "_gs").select(F.explode("_in").alias("g"), *X), "vectors")
    names = names.drop("_in")
    est = estimates(rows, 2 * n_groups + 1)
    known = names.join(est, "g", "left").withColumn("g", F.coalesce("g", F.lit("")))
    d = _distance(base.join(small(known, n_groups), "_gs", "left"))
    out = F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("d2") <= CUTOFF, F.lit(True)))
    keep = ["doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return d.select(*keep, out.alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"))


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject, all columns as they were."""
    packed = docs.select("doc_id", "text", "lang", "source", F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    return measure(packed, ("doc",)).where("kept").select("doc.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))
