"""Quality rules as robust multivariate outliers, with DataFrame functions only.

Each text gives rates: letters a word, symbols, repeated lines and words of repeated windows for each word, on logarithmic scales in
steps of 1/1024, so that all sums are of integers and a rerun gives the same. Of each language and source the
minimum-covariance-determinant estimate is taken: the mean and covariance of the half of its texts that lie together most
closely, so up to half of a source may be junk. Two starts (median with quartiles, and all texts) go through concentration steps: distances under the present
estimate, the nearest half, their mean and covariance. The start of the smaller determinant is kept, and re-estimated from
all texts that are no outliers of it. A text is rejected where its squared Mahalanobis distance exceeds ``CUT``.

A step is one aggregation: moments are summed by bins of distance, so the nearest half is found and summed at once (whole
bins, 1/16 of an octave wide). Most texts have no symbols or repeats at all, and a covariance of theirs is singular; so each
rate has a tolerance (``SPREAD``), whose square is added to its variance.

Sources of fewer than ``LEAST`` usable texts are taken together by language, languages of fewer together, and where even
these are fewer there is no verdict and the text stays.

Defined cases: a null text has no words; null language and source are values of their own; texts without words fail the base rules;
those that do are no part of any estimate; each row is judged by itself, so repeated ids and rows stay; an empty table gives no rows;
other columns stay as they are, but for those that are named like a column made here (``MADE``), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profilion.operators import facts
from profilion.session import written

#: White space, symbols, the base rules.
BLANKS, BLANK_RUN, SYMBOLS = " \t\n\x0b\x0c\r", "[\\x20\\x09-\\x0D]+", "#*$%&|<>"
FEWEST_WORDS, MOST_REPEATED = 50, 50
#: The rates, how many steps an octave has, how many of them the quartiles of a start are read to, and how far each may spread in octaves whatever its texts are like.
RATES = ("letters", "symbols", "lines", "windows")
STEPS, COARSE, SPREAD = 1024, 16, {"letters": 0.25, "symbols": 0.5, "lines": 0.5, "windows": 0.5}
#: Share of the texts in the subset, and what makes their covariance that of all (chi-square with 4 and 6 degrees of freedom, at
#: the quantile of the share); the same for the re-estimate, with the distance up to which texts take part.
SHARE, WIDEN, NEAR, WIDEN_NEAR = 0.5, 2.109, 11.143, 1.064
#: The 0.9999 quantile of chi-square with 4 degrees of freedom.
CUT = 23.51
LEAST, CONCENTRATIONS = 100, 4
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "x", "own", "pool", "wanted", "estimates", "e", "distance", "kept")
PAIRS = [(i, j) for i in range(len(RATES)) for j in range(i + 1)]


def _held(value: Column, f) -> Column:
    """f of a value that is worked out once, although f's lambdas use it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more."""

    def found(h: Column) -> Column:
        named = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        twice = _held(
            named, lambda s: F.transform(F.filter(s, lambda x, i: F.get(s, i - 1)["v"].eqNullSafe(x["v"]) | F.get(s, i + 1)["v"].eqNullSafe(x["v"])), lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        added = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"))
        return F.aggregate(F.array_sort(twice), start, added, lambda acc: acc["total"])

    windows = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return _held(words, lambda w: _held(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found(h))))


def measured(docs: DataFrame) -> DataFrame:
    """Rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    docs, text = docs.drop(*MADE), F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    of_words = _held(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")))
    rows = docs.withColumn("_words", of_words).select(
        *[c for c in docs.columns if c != "text"],
        F.col("_words.n").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _held(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("_words.repeated").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def rates(rows: DataFrame) -> DataFrame:
    """Adds the rates x, in whole steps; NULL without words."""
    per_word = lambda c, k: F.log2(1 + k * F.col(c) / F.col("n_words"))
    x = (F.log2(F.col("word_chars") / F.col("n_words")), per_word("n_symbols", 32), per_word("n_dup_lines", 64), per_word("n_repeat_words", 8))
    return rows.withColumn("x", F.when(F.col("n_words") > 0, F.array(*[F.rint(STEPS * v).cast("long") for v in x])))


def pooled(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds pool, the texts that a text is judged among: those of its language and source, or where these are too few of its language's
    other small sources, or of all other small ones; NULL where all are too few."""
    named = rows.withColumn("own", F.to_json(F.struct("lang", "source")))
    sizes = named.groupBy("own", "lang").agg(F.count_if(~F.col("base_failed")).alias("usable"), F.count("*").alias("wanted"))
    small = F.col("usable") < least
    sizes = sizes.withColumn("language", F.to_json(F.struct("lang"))).withColumn("in_language", F.sum(F.when(small, F.col("usable"))).over(Window.partitionBy("language")))
    in_rest = sizes.where(small & (F.col("in_language") < least)).agg(F.sum("usable")).first()[0] or 0
    pool = F.when(~small, F.col("own")).when(F.col("in_language") >= least, F.col("language")).when(F.lit(in_rest >= least), F.lit("rest"))
    return facts.joined(named, written(sizes.select("own", pool.alias("pool"), "wanted")), ["own"], "wanted", rows.count()).drop("own")


def _cumulated(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return rows.withColumn("upto", F.sum("n").over(w.orderBy(order))).withColumn("all", F.sum("n").over(w))


def _started(usable: DataFrame) -> DataFrame:
    """For each pool its size, and for both starts a mean and the covariance's lower half, in octaves."""
    coarse = F.transform("x", lambda v: F.floor(v / COARSE) * COARSE)
    values = _cumulated(usable.select("pool", F.posexplode(coarse).alias("k", "v")).groupBy("pool", "k", "v").agg(F.count("*").alias("n")), ["pool", "k"], "v")
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v"))) / STEPS
    middle = values.groupBy("pool", "k").agg(at(0.5).alias("median"), ((at(0.75) - at(0.25)) / 1.349).alias("wide"))
    middle = middle.groupBy("pool").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "median", "wide"))), lambda r: F.struct(r["median"].alias("m"), r["wide"].alias("s"))).alias("r"))
    zero = F.lit(0.0)
    median = middle.select("pool", F.lit(0).alias("start"), F.transform("r", lambda r: r["m"]).alias("mean"), F.array(*[F.get("r", F.lit(i))["s"] ** 2 if i == j else zero for i, j in PAIRS]).alias("cov"))
    every = _estimated(usable.select("pool", F.lit(1).alias("start"), "x").groupBy("pool", "start").agg(*_moments()), 1.0)
    return median.unionByName(every.select("pool", "start", "mean", "cov"))


def _moments() -> list[Column]:
    """Exact sums; of products in 64 bits for up to 2^31 texts whose rates are below 2^16 steps."""
    x = lambda i: F.get("x", F.lit(i))
    return [F.count("*").alias("n"), *[F.sum(x(i)).alias(f"s{i}") for i in range(len(RATES))], *[F.sum(x(i) * x(j)).alias(f"p{i}{j}") for i, j in PAIRS]]


def _summed() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(len(RATES))], *[f"p{i}{j}" for i, j in PAIRS])]


def _estimated(moments: DataFrame, widen: float) -> DataFrame:
    mean = F.array(*[F.col(f"s{i}") / F.col("n") / STEPS for i in range(len(RATES))])
    cov = [widen * (F.col(f"p{i}{j}").cast("decimal(38,0)") * F.col("n") - F.col(f"s{i}").cast("decimal(38,0)") * F.col(f"s{j}")).cast("double") / (F.col("n").cast("double") ** 2) / STEPS**2 for i, j in PAIRS]
    return moments.select("pool", "start", mean.alias("mean"), F.array(*cov).alias("cov"))


def _solved(estimates: DataFrame) -> DataFrame:
    """Adds the lower half of the covariance's inverse, tolerances included, and the determinant's logarithm, by Cholesky's method."""
    rows, n = estimates, len(RATES)
    at = {(i, j): k for k, (i, j) in enumerate(PAIRS)}
    for i, j in PAIRS:
        value = F.get("cov", F.lit(at[i, j])) + (F.lit(SPREAD[RATES[i]] ** 2) if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        rows = rows.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    for j in range(n):  # the inverse of the lower triangle
        for i in range(j, n):
            value = F.lit(1.0) if i == j else F.lit(0.0)
            for k in range(j, i):
                value = value - F.col(f"l{i}{k}") * F.col(f"m{k}{j}")
            rows = rows.withColumn(f"m{i}{j}", value / F.col(f"l{i}{i}"))
    inverse = [sum((F.col(f"m{k}{i}") * F.col(f"m{k}{j}") for k in range(i, n)), F.lit(0.0)) for i, j in PAIRS]
    size = sum((F.log(F.col(f"l{i}{i}")) for i in range(n)), F.lit(0.0))
    return rows.select("pool", "start", "mean", F.array(*inverse).alias("inverse"), size.alias("size"))


def distance(x: Column, e: Column) -> Column:
    """Squared Mahalanobis distance under an estimate's mean and inverse."""
    d = [F.get(x, F.lit(i)) / STEPS - F.get(e["mean"], F.lit(i)) for i in range(len(RATES))]
    return sum(((1 if i == j else 2) * F.get(e["inverse"], F.lit(k)) * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def _with(rows: DataFrame, estimates: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """Rows with their pool's estimates, as an array."""
    gathered = estimates.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("start", "size", "mean", "inverse"))).alias("estimates"))
    return facts.joined(rows, written(gathered.join(sizes, "pool")), ["pool"], "wanted", total)


def estimated(rows: DataFrame) -> DataFrame:
    """(pool, estimates of one element) from usable rows (pool, x)."""
    usable, total = rows, rows.count()
    sizes = written(usable.groupBy("pool").agg(F.count("*").alias("wanted")))
    now = written(_solved(_started(usable)))
    for _ in range(CONCENTRATIONS):
        each = _with(usable, now, sizes, total).select("pool", "x", F.explode("estimates").alias("e"))
        bins = each.select("pool", F.col("e.start").alias("start"), "x", F.floor(16 * F.log2(distance(F.col("x"), F.col("e")) + 1.0 / 64)).alias("bin")).groupBy("pool", "start", "bin").agg(*_moments())
        near = _cumulated(bins, ["pool", "start"], "bin").where(F.col("upto") - F.col("n") < SHARE * F.col("all"))
        now = written(_solved(_estimated(near.groupBy("pool", "start").agg(*_summed()), WIDEN)))
    best = now.withColumn("rank", F.row_number().over(Window.partitionBy("pool").orderBy("size", "start"))).where("rank = 1").drop("rank")
    each = _with(usable, best, sizes, total).withColumn("e", F.get("estimates", F.lit(0)))
    near = each.where(distance(F.col("x"), F.col("e")) <= NEAR).select("pool", F.lit(0).alias("start"), "x").groupBy("pool", "start").agg(*_moments())
    return written(_solved(_estimated(near, WIDEN_NEAR)))


def judged(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (their columns but text) with the statistics, base_failed, pool, distance (NULL: no verdict) and kept."""
    rows = written(pooled(rates(written(measured(docs))), least))
    usable = rows.where("NOT base_failed AND pool IS NOT NULL")
    found = estimated(usable.select("pool", "x"))
    sizes = rows.where("pool IS NOT NULL").groupBy("pool").agg(F.count("*").alias("wanted"))
    rows = _with(rows, found, sizes, rows.count()).withColumn("e", F.get("estimates", F.lit(0)))
    rows = rows.withColumn("distance", F.when(~F.col("base_failed"), distance(F.col("x"), F.col("e"))))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).drop("e", "estimates", "x")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
