import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import neighbours, queries


def brute(ids, vectors, wanted, k):
    out = {}
    for q in wanted:
        scores = (vectors * vectors[ids.index(q)]).sum(axis=1)
        order = sorted((-s, i) for s, i in zip(scores.tolist(), ids) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def table(spark, ids, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<float>, rank string")


@pytest.mark.parametrize("block", [100, 8192])
def test_recall_and_exact_scores(spark, block):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((900, 16)).astype(np.float32) * rng.uniform(0.2, 3, (900, 1)).astype(np.float32)
    vectors[700:760] = vectors[10]  # many copies: ties go to the smaller ids
    ids = list(range(900))
    df = table(spark, ids, vectors)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=20, block_rows=block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(ids, vectors.astype(np.float64), range(0, 900, 20), 20)
    hits = 0
    for q, expect in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        for _, i, s in mine:
            assert i != q and abs(s - float(vectors[i].astype(np.float64) @ vectors[q].astype(np.float64))) < 1e-9
        hits += len({i for i, _ in expect} & {i for _, i, _ in mine})
    assert hits >= 0.9 * 20 * len(want)


def test_verifying_all_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = np.repeat(rng.standard_normal((60, 4)).astype(np.float32), 4, axis=0)
    df = table(spark, list(range(240)), vectors)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id < 9"), k=7, block_rows=50, share=1.0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in v] for q, v in brute(list(range(240)), vectors.astype(np.float64), range(9), 7).items()}


def test_unusable_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [float("inf"), 1.0]), (6, [0.5, 0.5]), (7, []), (None, [1.0, 1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 6, 0.5), (20, 1, 6, 1.5), (20, 2, 0, 1.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_on_the_query_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in queries.op10_neighbours(spark, "/root/testdata/sf0.01").collect()}
    rows = df.orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows], np.float64)
    want = brute([r.vec_id for r in rows], vectors, [r.vec_id for r in rows if r.vec_id % 20 == 0], 20)
    assert sum((q, i) in got for q, v in want.items() for i, _ in v) >= 0.9 * 20 * len(want)
    assert df.where(F.col("vec_id") % 20 == 0).count() * 20 == len(got)


@pytest.mark.parametrize("skew", ["one long vector", "lognormal"])
def test_recall_with_skewed_lengths(spark, skew):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((4000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if skew == "lognormal":
        vectors *= rng.lognormal(0, 0.5, (4000, 1))
    else:
        vectors[7] *= 3
    vectors = vectors.astype(np.float32)
    df = table(spark, range(4000), vectors)
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, df.where("vec_id % 40 = 0")).collect()}
    want = brute(list(range(4000)), vectors.astype(np.float64), range(0, 4000, 40), 20)
    assert sum((q, i) in got for q, v in want.items() for i, _ in v) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("dim, spread, copies", [(256, 0.0, 1), (768, 0.0, 1), (256, 0.3, 1), (384, 0.0, 2)])
def test_recall_in_many_dimensions(dim, spread, copies):
    """At least 0.9 of the nearest, or of others just as near, where vectors have more dimensions than the query table's."""
    random = np.random.default_rng(dim)
    vectors = random.standard_normal((4096 // copies, dim))
    vectors = np.tile(vectors / np.linalg.norm(vectors, axis=1)[:, None], (copies, 1)) * random.lognormal(0, spread, 4096)[:, None]
    ids, wanted = np.arange(4096), vectors[:40]
    query, found, _ = neighbours.search_block(wanted, ids[:40], vectors, ids, 20)
    hits = 0
    for i in range(40):
        scores = (vectors * wanted[i]).sum(axis=1)
        scores[i] = -np.inf
        hits += (scores[found[query == i]] >= np.sort(scores)[-20] - 1e-12).sum()
    assert hits >= 0.9 * 40 * 20
