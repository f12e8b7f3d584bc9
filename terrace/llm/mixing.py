"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources get weights and share a number of words; what a source may not take is shared by
the others. Within a source every document expects the same number of copies, so the
prefix sum of expected copies is a document's place times this rate. One random offset is
added, and a document is taken once for each integer that its step crosses. Documents stand
in the order of their size, so that neighbours of nearly one size stand in for each other
and the words taken miss the target by no more than two documents of the greatest size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.plans.durable import durable, maybe_broadcast
from terrace.plans.indexing import row_index

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
SEED = "mixing"

_WORD = r"[^\x20\x09-\x0D]+"
# Rates are whole numbers of 2^-40 copies, so that prefix sums are exact: the high and the
# low 20 bits are multiplied by the place apart and never leave a long below 2^42 documents.
_HALF = 20
_LOW = (1 << _HALF) - 1


def n_words(text: Column) -> Column:
    """Runs other than space and control characters 9 to 13; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``source, source_size, target, rate``: words wanted of each source of ``sized`` (``source, size``), ``rate`` in 2^-40 copies.

    Sources by code point, null last, take the weights in turn and share ``share`` times
    all sizes. A target stops at ``limit`` times its source's size; what is above goes to
    the others by weight until none is above. Each round is one aggregate over sources.
    """
    per = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.isnull("source")))
    turn = (F.col("k") % len(weights)).cast("int")
    known = durable(row_index(per, ["_null", "source"]).withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), turn)))
    above = F.col("w") * F.lit(0.0) > F.col("source_size")
    level, n_full = 0.0, -1
    while True:
        sums = known.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("full"),
            F.sum(F.when(~above, F.col("w"))).alias("open"),
            F.count_if(above).alias("n"),
        ).first()
        if sums["n"] == n_full or not sums["open"]:
            break
        n_full, level = sums["n"], (share * sums["all"] - limit * sums["full"]) / sums["open"]
        above = F.col("w") * F.lit(level) > F.lit(float(limit)) * F.col("source_size")
    target = F.least(F.col("w") * F.lit(level), F.lit(float(limit)) * F.col("source_size"))
    rate = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size") * float(1 << 2 * _HALF))).otherwise(F.lit(0))
    return known.select("source", "source_size", target.alias("target"), rate.cast("long").alias("rate"))


def _crossed(place: Column, rate: Column, offset: Column) -> Column:
    """Integers below offset plus ``place`` steps of ``rate``; the offset has 20 bits."""
    low = F.shiftright(place * rate.bitwiseAND(F.lit(_LOW)), _HALF)
    return F.shiftright(place * F.shiftright(rate, _HALF) + offset + low, _HALF)


def _dealt(rows: DataFrame, weights: tuple[float, ...], share: float, limit: float, seed: str) -> DataFrame:
    """``rows`` (``row`` with what is kept, ``source``, ``size`` and the texts ``_a``, ``_b`` that settle ties) with targets and ``copies``."""
    wanted = durable(targets(rows, weights, share, limit))
    placed = row_index(rows.withColumn("_null", F.isnull("source")), ["_null", "source", "size", "_a", "_b"])
    first = placed.groupBy("source").agg(F.min("k").alias("_first"))
    table = wanted.join(first.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    table = maybe_broadcast(durable(table.drop("source")), 200)
    place, rate = F.col("k") - F.col("_first"), F.col("rate")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("long")
    copies = _crossed(place + 1, rate, offset) - _crossed(place, rate, offset)
    return placed.join(table, F.col("source").eqNullSafe(F.col("_source"))).select("row", "size", "source_size", "target", copies.alias("copies"))


def _rows(docs: DataFrame, kept: list[str], text: str) -> DataFrame:
    """Rows to deal; what is kept is packed, so that no name can clash."""
    doc = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    return docs.select(
        F.struct(*(docs[f"`{c}`"].alias(c) for c in kept)).alias("row"),
        docs["source"].alias("source"),
        n_words(docs[text]).alias("size"),
        F.concat(F.substring(F.md5(doc), 1, 8), doc).alias("_a"),
        F.xxhash64(docs[text]).alias("_b"),
    )


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED, text: str = "text") -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row of ``docs``; ``taken`` is size times copies.

    Defined cases: a null text has size 0, as an empty one has; documents of size 0 are
    dealt copies like others and take no words; a null source is a source of its own, the
    last; repeated rows and ids are dealt one by one; where all texts are empty, targets are 0;
    an empty table gives an empty result. Texts of any length count whole. Only ``doc_id``,
    ``source`` and the text are read, whatever other columns are called. Documents of one
    source, size, id and text stand in any order, which changes nothing in the result.
    """
    dealt = _dealt(durable(_rows(docs, ["doc_id"], text)), weights, share, limit, seed)
    return dealt.select("row.doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED, text: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``plan`` takes it; defined cases as there."""
    dealt = _dealt(_rows(docs, docs.columns, text), weights, share, limit, seed).where("copies > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
