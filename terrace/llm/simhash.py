"""SimHash near-duplicates found by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints at most four bits
apart have a segment that differs in at most two bits, so the Hamming balls of
radius one around the two segment values meet. Every distinct fingerprint is
written into the table under each value of both balls (66 rows), rows meeting
under a value are candidates, and candidates are verified on all 64 bits.

A table value shared by many distinct fingerprints would give a quadratic number
of candidates. Its fingerprints go to an exact second table instead: each is
written under every value within two bits of it. Two fingerprints meet there if,
and only if, they are at most four bits apart, so linking each one to the
smallest fingerprint under the value loses no link and makes no wrong one, in
linear space.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators.components import connected_components
from terrace.plans.durable import durable, maybe_broadcast

SEED = 42
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: A table value with more distinct fingerprints than this uses the exact second table.
#: It is about the size of the ball of radius two, where comparing within the value
#: and writing that ball cost the same.
PAIR_BUCKET = 2048


def fingerprint_of(text: bytes | None, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a text's k-word shingles; 0 for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, seed) for s in shingles], "<u8"))


def majority(h: np.ndarray) -> int:
    """64 bits, each set if over half of the 64-bit hashes have it; 0 of none."""
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
    counts = np.add.reduce(bits, axis=0, dtype=np.uint16 if len(h) < 1 << 16 else np.int64)
    return int.from_bytes(np.packbits(counts > len(h) // 2, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", k: int = SHINGLE_WORDS, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs``'s columns ``keep`` with ``fp``, the fingerprint as a signed long. A null text counts as empty."""

    def run(batches):
        for batch in batches:
            out = [fingerprint_of(t, k, seed) for t in batch.column(0).to_pylist()]
            fp = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], [*keep, "fp"])

    schema = docs.select(*keep).schema.add("fp", T.LongType())
    return docs.select(F.col(text).cast("binary").alias("_text"), *keep).mapInArrow(run, schema)


def _ball(value, bits: int, radius: int):
    """Column: array of all values within ``radius`` bits of ``value``."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.lit(np.array(masks, np.int64)), lambda m: value.bitwiseXOR(m))


def spanning_links(fps: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links that connect what all pairs of ``fps`` within ``max_distance`` bits connect, one fewer than nodes in each part."""
    fps = np.asarray(fps, np.int64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_distance
    fresh, out = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not fresh[root]:
            continue
        fresh[root], front = False, [root]
        while front:
            at = front.pop()
            found = np.flatnonzero(near[at] & fresh)
            fresh[found] = False
            front += found.tolist()
            out += [(int(fps[at]), int(fps[i])) for i in found]
    return out


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links ``(src, dst)`` with the components of all pairs of distinct ``fp`` within ``max_distance`` bits.

    A table value of up to ``pair_bucket`` fingerprints is compared within itself and
    gives a spanning forest of its near pairs, never the pairs; a larger one uses
    the second table.
    """
    if max_distance != 4:
        raise ValueError("segments and balls are laid out for a distance of 4")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    side = F.lit(1 << 32)
    balls = F.concat(_ball(low, 32, 1), F.transform(_ball(high, 32, 1), lambda v: v.bitwiseOR(side)))
    # Every row becomes 66, so few rows are spread over as many tasks as a shuffle has.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    table = spread.select("fp", F.explode(balls).alias("value"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_distance
    # Sizes and both ends of a value first: nearly all values have one or two
    # fingerprints, and only those with more are gathered, up to the bound.
    size = F.count(F.lit(1))
    sizes = durable(table.groupBy("value").agg(size.alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).where("n > 1"))
    two = sizes.where("n = 2").select("x", "y").where(near)
    many = table.join(maybe_broadcast(sizes.where("n > 2").select("value", "n"), 64), "value")
    few = many.where(F.col("n") <= pair_bucket).groupBy("value").agg(F.collect_list("fp").alias("fps")).select("fps")

    def compare(batches):
        for batch in batches:
            found = [p for fps in batch.column(0) for p in spanning_links(fps.values.to_numpy(), max_distance)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["x", "y"])

    hot = many.where(F.col("n") > pair_bucket).select("fp").distinct()
    middle = hot.select("fp", F.explode(_ball(F.col("fp"), 64, 2)).alias("value"))
    star = middle.groupBy("value").agg(F.min("fp").alias("x"))
    stars = middle.join(star, "value").where("fp != x").select("x", F.col("fp").alias("y"))
    found = two.union(few.mapInArrow(compare, "x bigint, y bigint"))
    if sizes.where(F.col("n") > pair_bucket).limit(1).count():
        found = found.union(stars)
    return found.select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (hex), ``component_id``.

    Documents whose fingerprints differ in at most four bits are linked;
    ``component_id`` is the smallest ``doc_id`` reachable over links, the document's
    own included.

    Defined cases: a null or empty text, or one of white space only, has
    fingerprint 0 and is linked like any other; repeated rows stay; a null
    ``doc_id`` is never a component's id unless all its members have none; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    marked = durable(fingerprints(docs, text))
    named = _components(marked)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = named.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(marked: DataFrame) -> DataFrame:
    """``(fp, first_id, component)`` of every distinct fingerprint; components are named by a fingerprint of theirs."""
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comps = durable(connected_components(links(distinct)))
    return distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of smallest ``doc_id``.

    Defined cases: as in ``near_duplicates``; a row without ``doc_id`` stays only if no
    row of its component has one, then that of smallest text hash; of repeated rows one
    stays; all columns are kept, whatever their names.
    """
    marked = durable(fingerprints(docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("_hash")), "text", keep=("doc_id", "_hash")))
    named = _components(marked).select("fp", "component")
    return first_rows(docs, text, marked.join(named, "fp"))


def first_rows(docs: DataFrame, text: str, named: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``component`` of ``named``, which has ``doc_id`` and ``_hash``, the text's ``xxhash64``, of every row."""
    keys = [F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_hash")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), "_hash"))
    kept = named.groupBy("component").agg(first.alias("first")).select("first._id", "first._hash")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), *keys)
    same = rows["_hash"] == kept["_hash"], rows["_id"].eqNullSafe(kept["_id"])
    return rows.join(kept, same[0] & same[1], "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")
