"""URL filter: allow and block rules, and a logistic regression on hashed character n-grams of host and path.

Everything on the main path is DataFrame and SQL functions with Spark's own JVM-side
feature hashing and regression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NGRAM_SIZES = (3, 4, 5)
FEATURES = 1 << 14
#: Bound of the labelled table that is learned from: the rows of smallest hash.
MAX_LABELLED = 4000
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls; ``rules`` are (verdict, ``host/path``)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def ngrams(host: Column, path: Column, sizes: Sequence[int] = NGRAM_SIZES) -> Column:
    """Distinct character n-grams of both parts, marked by part; ``^`` and ``$`` stand at the ends."""

    def of(part: Column, mark: str, n: int) -> Column:
        whole = F.concat(F.lit("^"), part, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))

    return F.array_distinct(F.concat(*(of(p, m, n) for p, m in ((host, "h:"), (path, "p:")) for n in sizes)))


def _hashed(df: DataFrame) -> DataFrame:
    hasher = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True)
    return hasher.transform(df.withColumn("_grams", ngrams(F.col("host"), F.col("path")))).drop("_grams")


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> LogisticRegressionModel | None:
    """Fit on a small table of ``host``, ``path`` and ``allow`` (0 or 1); None if one class is missing.

    Of a larger table the ``max_labelled`` rows of smallest hash are taken, each host and path once.
    """
    rows = labelled.select("host", "path", F.col("allow").cast("double").alias("allow")).where(F.col("allow").isin(0.0, 1.0))
    rows = rows.groupBy("host", "path").agg(F.min("allow").alias("allow"))
    # The smallest hashes of each class, so that a rare class is there.
    by_hash = (F.xxhash64("host", "path"), F.col("host"), F.col("path"))
    parts = [rows.where(F.col("allow") == a).orderBy(*by_hash).limit(max_labelled // 2) for a in (0.0, 1.0)]
    sample = parts[0].union(parts[1]).coalesce(1).cache()
    try:
        if sample.select("allow").distinct().count() < 2:
            return None
        return LogisticRegression(featuresCol="_features", labelCol="allow", maxIter=50, regParam=1e-3).fit(_hashed(sample))
    finally:
        sample.unpersist()


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    labelled: DataFrame | None = None,
    url: str = "url",
    key: str = "page_id",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(key, host, path, rule, verdict, score)`` of each row; a rule decides, else the regression.

    ``labelled`` (``url``, ``allow``) is the table to learn from; without it the URLs
    that the rules decide are the labelled ones. ``score`` is the regression's
    probability of allow (1 where nothing could be learned, so nothing is blocked).

    Defined cases: a null url, or one without ``://``, has empty host and path, fits
    no rule and is left to the regression; repeated rows stay; an empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parted = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parted.select("_key", "host", "path", rule.alias("rule"), verdict.alias("_says"))
    if labelled is None:
        known = ruled.where(F.col("_says").isNotNull()).select("host", "path", (F.col("_says") == "allow").cast("int").alias("allow"))
    else:
        known = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "allow")
    model = train(known)
    if model is None:
        scored = ruled.withColumn("score", F.lit(1.0))
    else:
        model = model.setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_prediction")
        scored = model.transform(_hashed(ruled)).withColumn("score", vector_to_array("_p")[1])
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("_says", by_model).alias("verdict"), "score")
