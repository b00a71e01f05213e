"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Base rules look at one text. The verdict is Mahalanobis distance: for every language and source
a minimum-covariance-determinant estimate of centre and scatter is made from transformed
statistics, and documents far from their group's centre are rejected.

The estimate starts from the documents nearest to the coordinate-wise median, scaled by the
median deviation, and takes a fixed number of concentration steps: fit centre and scatter to the
nearest three quarters, measure all distances anew, take the nearest three quarters again. Every
step is a few sums per group. Statistics are whole numbers (thousandths) and distances are ranked
in bins, so sums and quantiles are exact and reruns agree. A last fit takes every document within
the inlier distance; a group without any is judged by the fit before. Scatter is regularised by
fixed floors and, where a group is small, by the scatter within all groups, so constant statistics
and tiny groups stay harmless.

Null texts have no words and fail the base rules. A null language or source counts as an empty
name. Repeated rows are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, words_of

SYMBOLS = "#*$%&|<>"
HAS_WORD = "[^ \\t-\\r]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body` as often as needed."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""
    def covered(hashes: Column) -> Column:
        return let(F.sort_array(F.transform(
            hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
                   lambda s: F.size(F.array_distinct(F.flatten(F.transform(
                       F.filter(s, lambda x, j: F.coalesce(
                           (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]),
                           F.get(s, j - 1)["h"] == x["h"], F.get(s, j + 1)["h"] == x["h"],
                           F.lit(False))),
                       lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def base_stats(text: Column) -> Column:
    """Struct n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    body = F.coalesce(text, F.lit(""))
    length = F.length(body)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(HAS_WORD))
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (length - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        .alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words")))


#: The judged statistics, and the standard deviation (in thousandths) that each has at least.
FLOORS = {"log_words": 1000.0, "word_length": 200.0, "symbols": 500.0, "dup_lines": 500.0,
          "repeats": 120.0}
Z = list(FLOORS)
P = len(Z)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Share of a group that a concentration step keeps, and the number of steps.
CORE, STEPS = 0.75, 4
#: For five dimensions: what makes the scatter of the nearest three quarters consistent at the
#: normal distribution, and the squared distances that bound inliers and kept documents
#: (chi-square quantiles 0.975 and 1 - 1e-6).
CONSISTENCY, INLIER, KEEP = 1.41, 12.83, 35.89
#: Documents that the scatter and the centre of all groups count as in a group's estimate.
PRIOR_SCATTER, PRIOR_CENTRE = 50, 5
#: Distances are ranked in steps of 1/8, all above the last bin alike.
BIN, LAST_BIN = 8, 4095


def transformed() -> dict[str, Column]:
    per_word = F.greatest(F.col("n_words"), F.lit(1).cast("long"))
    return {
        "log_words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / per_word,
        "symbols": F.log1p(100 * F.col("n_symbols") / per_word),
        "dup_lines": F.log1p("n_dup_lines"),
        "repeats": F.sqrt(F.col("n_repeat_words") / per_word)}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base statistics, base verdict, group (`_lang`, `_source`) and the judged statistics."""
    stats = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("_lang"),
        F.coalesce("source", F.lit("")).alias("_source"), base_stats(F.col(text)).alias("_s"))
    flat = stats.select("doc_id", "_lang", "_source", "_s.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.withColumns({"base_failed": failed, **{
        z: F.round(1000 * value).cast("long") for z, value in transformed().items()}})


def _distance(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Add `_d2`, the squared Mahalanobis distance from the group's centre."""
    joined = rows.join(fit, ["_lang", "_source"])
    parts = [sum((F.col(f"i{i}{j}") * (F.col(Z[j]) - F.col(f"m{j}")) for j in range(i + 1)),
                 F.lit(0.0)) for i in range(P)]
    return joined.withColumn("_d2", sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def _fit(kept: DataFrame, factor: float, name: str) -> DataFrame:
    """Centre `m*` and the inverse Cholesky factor `i**` of the scatter, one row per group."""
    sums = materialise(kept.groupBy("_lang", "_source").agg(
        F.count("*").alias("n"), *[F.sum(z).alias(f"s{i}") for i, z in enumerate(Z)],
        *[F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"c{i}{j}") for i, j in PAIRS]), name)
    scatter = {(i, j): F.col(f"c{i}{j}") - F.col(f"s{i}") * (F.col(f"s{j}") / F.col("n"))
               for i, j in PAIRS}
    whole = sums.agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(P)],
                     *[F.sum(v).alias(f"t{i}{j}") for (i, j), v in scatter.items()]).first()
    total = whole.n or 1
    fit = sums.withColumns({
        f"m{i}": (F.col(f"s{i}") + F.lit(PRIOR_CENTRE * (whole[f"s{i}"] or 0) / total))
        / (F.col("n") + PRIOR_CENTRE) for i in range(P)} | {
        f"a{i}{j}": F.lit(factor) * (v + F.lit(PRIOR_SCATTER * (whole[f"t{i}{j}"] or 0.0) / total))
        / (F.col("n") + PRIOR_SCATTER) + F.lit(FLOORS[Z[i]] ** 2 if i == j else 0.0)
        for (i, j), v in scatter.items()})
    # Cholesky factor l and its inverse i, entry by entry.
    for j in range(P):
        for i in range(j, P):
            rest = F.col(f"a{i}{j}") - sum(
                (F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            fit = fit.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(P):
        for i in range(j, P):
            value = F.lit(1.0) if i == j else -sum(
                (F.col(f"l{i}{k}") * F.col(f"i{k}{j}") for k in range(j, i)), F.lit(0.0))
            fit = fit.withColumn(f"i{i}{j}", value / F.col(f"l{i}{i}"))
    return materialise(fit.select(
        "_lang", "_source", *[f"m{i}" for i in range(P)], *[f"i{i}{j}" for i, j in PAIRS]),
        f"{name}-fit")


def _start(rows: DataFrame) -> DataFrame:
    """Squared distance from the median in units of the median deviation, as `_d2`."""
    group = ["_lang", "_source"]
    medians = materialise(rows.groupBy(*group).agg(
        *[F.percentile(z, 0.5).alias(f"m{i}") for i, z in enumerate(Z)]), "mcd-median")
    centred = rows.join(medians, group)
    off = [F.abs(F.col(z) - F.col(f"m{i}")) for i, z in enumerate(Z)]
    spread = materialise(centred.groupBy(*group).agg(
        *[F.greatest(1.4826 * F.percentile(F.round(o), 0.5), F.lit(FLOORS[z])).alias(f"w{i}")
          for i, (o, z) in enumerate(zip(off, Z))]), "mcd-spread")
    return centred.join(spread, group).withColumn(
        "_d2", sum(((o / F.col(f"w{i}")) ** 2 for i, o in enumerate(off)), F.lit(0.0)))


def _nearest(rows: DataFrame) -> DataFrame:
    """The rows whose distance bin is within their group's quantile `CORE`."""
    binned = rows.withColumn("_bin", F.least(F.floor(F.col("_d2") * BIN), F.lit(LAST_BIN)))
    # Written, so that the join with a group of very many rows may be split.
    limits = materialise(binned.groupBy("_lang", "_source").agg(
        F.ceil(F.percentile("_bin", CORE)).alias("_limit")), "mcd-limits")
    return binned.join(limits, ["_lang", "_source"]).filter(F.col("_bin") <= F.col("_limit"))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base statistics, `base_failed`, squared distance `d2` and `kept` of every document."""
    rows = materialise(measured(docs, text), "mcd-rows")
    fitted = rows.filter(~F.col("base_failed")).select("_lang", "_source", *Z)
    core = _nearest(_start(fitted))
    for step in range(STEPS):
        fit = _fit(core, CONSISTENCY, f"mcd-{step}")
        core = _nearest(_distance(fitted, fit))
    inner = _fit(core, CONSISTENCY, "mcd-core")
    last = _fit(_distance(fitted, inner).filter(F.col("_d2") <= INLIER), 1.0, "mcd-inliers")
    # A small group far from all others may have no inlier: its core is its estimate.
    fit = last.unionByName(inner.join(last, ["_lang", "_source"], "left_anti"))
    # Groups in which every document fails the base rules have no estimate and need none.
    near = _distance(rows.filter(~F.col("base_failed")), fit).select(
        *rows.columns, F.col("_d2").alias("d2"))
    lost = rows.filter("base_failed").withColumn("d2", F.lit(None).cast("double"))
    return near.unionByName(lost).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= KEEP, F.lit(False)))
