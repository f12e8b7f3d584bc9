"""Near-duplicates by exact Jaccard similarity of word shingles, candidates by SimHash, then by MinHash bands.

Texts whose SimHash fingerprints differ in at most four bits are found first, by the
Hamming balls of ``simhash.links``, and verified on the whole sets. That reaches the closest
copies alone: at a similarity of 0.8 about ten of 64 bits differ, where balls are no longer
small. So that no link is lost, MinHash bands give candidates for the rest, and what fingerprints
have joined is not compared again.

A text's signature is cut into 36 bands of five minima. Two texts of similarity 0.8
agree in all five minima of a band with odds 0.8^5, and so in at least one of the bands
but for odds of (1 - 0.8^5)^36 = 6e-7; more similar ones miss each other less often yet.
Texts with a common band are candidates, and every link is verified on the whole sets.

In each band value all texts are first compared with one of them, that which meets
most others. Texts of a value that this has joined need no further comparison; each text
outside the value's largest component is then compared with all of the value, so no
link between components is left out. In a value of many texts that is done in blocks:
sets travel once for each block they meet, never once for each pair, and only links
that join two components come back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm import simhash
from terrace.llm.simhash import SEED, first_rows
from terrace.operators.components import connected_components
from terrace.plans.durable import durable

SHINGLE_WORDS = 5
#: Texts are linked from a similarity of 4/5 on, in whole numbers.
PARTS, OF = 4, 5
BANDS, ROWS = 36, 5
#: Texts of a value of up to so many are compared by joined pairs; larger values in blocks of about so many shingles.
PAIRED = 16
BLOCK_SHINGLES = 1_000_000
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingles_of(text: bytes | None, k: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(k))))) if len(words) >= k else {b" ".join(words)} if words else ()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, seed) for s in shingles], "<u8"))


def bands_of(shingles: np.ndarray) -> list[int]:
    """A signed long for each band of the MinHash signature; no bands for no shingles."""
    if not len(shingles):
        return []
    short, mins = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(mins, (short[None, at : at + 512] * _FACTORS + _TERMS).min(axis=1), out=mins)
    values = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(mins.reshape(BANDS, ROWS))]
    return np.array(values, np.uint64).view(np.int64).tolist()


def _node(shingles: np.ndarray) -> int:
    """One number, a signed long, for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def _mark(batches):
    for batch in batches:
        sets = [shingles_of(t) for t in batch.column(0).to_pylist()]
        new = pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bands_of(s) for s in sets], pa.list_(pa.int64()))
        fps = pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new, fps], ["doc_id", "_hash", "node", "n", "bands", "fp"])


def _sets(batches):
    for batch in batches:
        sets = [shingles_of(t) for t in batch.column(0).to_pylist()]
        new = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(new, ["node", "shingles"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` ``(x, y)`` whose sets have the similarity."""
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in "xy")
    common, sizes = F.size(F.array_intersect("_x", "_y")), F.size("_x") + F.size("_y")
    return pairs.join(one, "x").join(two, "y").where(common * (PARTS + OF) >= sizes * PARTS).select("x", "y")


def _fit(n: str, m: str):
    """Whether sets of these sizes can have the similarity at all."""
    return F.least(n, m) * OF >= F.greatest(n, m) * PARTS


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates ``(x, y)`` among ``node, n, fp``: those of one fingerprint, and links between fingerprints at most four bits apart."""
    lead = durable(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("lead")).select("fp", "lead.*"))
    same = nodes.join(lead.toDF("fp", "x", "m"), "fp").where("node != x").select("x", F.col("node").alias("y"), "m", "n")
    ends = simhash.links(lead.select("fp")).join(lead.toDF("src", "x", "m"), "src").join(lead.toDF("dst", "y", "n"), "dst")
    return durable(same.union(ends.select("x", "y", "m", "n")).where(_fit("n", "m")).select("x", "y"))


def _band_members(nodes: DataFrame) -> DataFrame:
    """``value, node, n, size`` of each band value of more than one node."""
    table = nodes.select("node", "n", F.explode("bands").alias("value"))
    size = F.count(F.lit(1)).over(Window.partitionBy("value"))
    return durable(table.withColumn("size", size).where("size > 1"))


def _components(members: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame:
    """``(node, component)`` of nodes that are linked, from candidates ``near`` and from ``members``, which has ``value, node, n, size``."""
    close = durable(_similar(near, sets))
    first = durable(connected_components(close, "x", "y"))
    meets = members.groupBy("node").agg(F.sum("size").alias("meets"))
    most = F.max(F.struct("meets", "node", "n")).alias("most")
    centre = members.join(meets, "node").groupBy("value").agg(most).select("value", F.col("most.node").alias("x"), F.col("most.n").alias("m"))
    stars = members.join(centre, "value").where(F.col("node") != F.col("x")).where(_fit("n", "m"))
    stars = stars.select("x", F.col("node").alias("y")).distinct()
    # What fingerprints have joined needs no comparison.
    ends = [first.toDF(c, f"_{c}") for c in "xy"]
    stars = durable(stars.join(ends[0], "x", "left").join(ends[1], "y", "left").where("not (_x <=> _y) or _x is null").select("x", "y"))
    parts = durable(connected_components(_similar(stars, sets).union(first.toDF("x", "y")), "x", "y"))
    # What the stars leave apart in a value: all but its largest part, against the others.
    placed = durable(members.join(parts, "node", "left").select("value", "node", "n", "size", F.coalesce("component", "node").alias("part")))
    shares = placed.groupBy("value", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    largest = F.max(F.struct("k", "part")).alias("largest")
    torn = shares.groupBy("value").agg(largest, F.count(F.lit(1)).alias("parts"), F.sum("n").alias("total")).where("parts > 1")
    torn = durable(placed.join(torn.select("value", F.col("largest.part").alias("main"), "total"), "value"))
    few = torn.where(F.col("size") <= PAIRED)
    rest = few.where("part != main").select("value", F.col("node").alias("x"), F.col("n").alias("m"), F.col("part").alias("other"))
    pairs = few.join(rest, "value").where("part != other and (part = main or node < x)").where(_fit("n", "m"))
    tried = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = pairs.select(F.least("x", "node").alias("x"), F.greatest("x", "node").alias("y")).distinct().join(tried, ["x", "y"], "left_anti")
    part = placed.select("node", "part").distinct()
    ends = _similar(pairs, sets).join(part.toDF("x", "a"), "x").join(part.toDF("y", "b"), "y").select("a", "b")
    ends = ends.union(_blocked(torn.where(F.col("size") > PAIRED), sets)).distinct()
    joined = connected_components(ends, "a", "b").toDF("part", "component")
    # Fingerprints also join texts that have no band in common with any.
    part = part.union(parts.join(part, "node", "left_anti").select("node", F.col("component").alias("part")))
    return part.join(joined, "part", "left").select("node", F.coalesce("component", "part").alias("component"))


def _blocked(torn: DataFrame, sets: DataFrame) -> DataFrame:
    """Parts ``(a, b)`` that a link joins, of values with many texts.

    A value's texts are dealt into blocks; texts outside its main part meet all texts,
    block by block, so no task holds more than two blocks.
    """
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    rows = torn.join(sets, "node").select("value", "part", "main", "shingles", blocks.alias("blocks"), F.xxhash64("node", "value").alias("draw"))
    own, every = F.pmod("draw", "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    names = ["value", "part", "shingles", "i", "j"]
    rest = rows.where("part != main").select("value", "part", "shingles", own.alias("i"), every.alias("j")).toDF(*names)
    texts = rows.select("value", "part", "shingles", every.alias("i"), own.alias("j")).toDF(*names)
    keys = ("value", "i", "j")
    return rest.groupBy(*keys).cogroup(texts.groupBy(*keys)).applyInArrow(_meet, "a bigint, b bigint")


def _meet(rest: pa.Table, texts: pa.Table) -> pa.Table:
    """Links between sets of ``rest`` and of ``texts``, as few pairs of parts as connect the same parts."""
    out: list[tuple[int, int]] = []
    if rest.num_rows and texts.num_rows:
        column = texts["shingles"].combine_chunks()
        sizes = np.asarray(column.value_lengths())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        shingles = np.asarray(column.flatten())
        order = np.argsort(shingles, kind="stable")
        owner = owner[order]
        known, first, count = np.unique(shingles[order], return_index=True, return_counts=True)
        parts, root = np.asarray(texts["part"].combine_chunks()), {}

        def find(part: int) -> int:
            while root.setdefault(part, part) != part:
                root[part] = part = root[root[part]]
            return part

        for part, mine in zip(rest["part"].to_pylist(), rest["shingles"].combine_chunks()):
            mine = mine.values.to_numpy()
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            at = at[known[at] == mine]
            long = count[at]
            places = np.repeat(first[at] - np.cumsum(long) + long, long) + np.arange(long.sum())
            common = np.bincount(owner[places], minlength=len(sizes))
            for other in np.unique(parts[common * (PARTS + OF) >= (sizes + len(mine)) * PARTS]).tolist():
                a, b = find(part), find(other)
                if a != b:
                    root[a] = b
                    out.append((part, other))
    return pa.table({c: pa.array([p[k] for p in out], pa.int64()) for k, c in enumerate("ab")})


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of smallest ``doc_id``.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles
    is 0.8 or more; a group is all that links reach. Words are what white space parts,
    in lower case.

    Defined cases: a text of fewer than five words is one shingle; null and empty texts
    and those of white space only are alike; a row without ``doc_id`` stays only if no
    row of its group has one, then that of smallest text hash; of repeated rows one
    stays; all columns are kept, whatever their names.
    """
    source = docs.select(F.col(text).cast("binary").alias("_text"), "doc_id", F.xxhash64(text).alias("_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = durable(source.mapInArrow(_mark, f"doc_id {kind}, _hash bigint, node bigint, n int, bands array<bigint>, fp bigint"))
    first = F.min(F.struct("_hash", "doc_id")).alias("first")
    near = _fingerprint_pairs(marked.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp")))
    members = _band_members(marked.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("bands").alias("bands")))
    met = members.select("node").union(near.select("x")).union(near.select("y")).distinct()
    wanted = marked.join(met, "node", "left_semi").groupBy("node").agg(first).select("first.*")
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"))
    texts = source.join(wanted, (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = durable(texts.select("_text").mapInArrow(_sets, "node bigint, shingles array<bigint>").dropDuplicates(["node"]))
    parts = durable(_components(members, sets, near))
    named = marked.select("doc_id", "_hash", "node").join(parts, "node", "left")
    return first_rows(docs, text, named.select("doc_id", "_hash", F.coalesce("component", "node").alias("component")))
