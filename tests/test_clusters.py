import pickle

import numpy as np
import pyarrow as pa
import pytest

from terrace.operators import profiles, volume

SCHEMA = "brick_id int, row int, col int, p array<double>"


def by_rounds(drawn, of, medians, rounds=100):
    """The groups of ``of``, a list of profiles with None for nulls, by loops from the places of the first centres."""
    centres, before = [of[i] for i in drawn], None
    for turn in range(rounds):
        groups = []
        for p in of:
            ranks = []
            for j, c in enumerate(centres):
                if len(p) != len(c) or None in p or None in c:
                    ranks.append((0, 0.0, j))
                    continue
                with np.errstate(invalid="ignore"):
                    steps = np.array(p) - np.array(c)
                    d = sum(np.abs(steps) if medians else steps * steps)
                ranks.append((2, 0.0, j) if np.isnan(d) else (1, float(d), j))
            groups.append(min(ranks)[-1])
        if groups == before or turn == rounds - 1:
            return groups
        before = groups
        for j in range(len(centres)):
            mine = [p for p, g in zip(of, groups) if g == j]
            new = []
            for at in range(max(map(len, mine), default=0)):
                values = [p[at] for p in mine if at < len(p) and p[at] is not None]
                sort = np.sort([v for v in values if not medians or not np.isnan(v)])
                with np.errstate(invalid="ignore"):
                    new.append(None if not values else float(np.mean(values)) if not medians else float(sort[len(sort) // 2]) if len(sort) else float("nan"))
            centres[j] = new if mine else centres[j]


@pytest.fixture
def drawn(spark):
    from pyspark.sql import functions as F

    def of(keys, k):
        at = spark.createDataFrame([(r, c) for _, r, c in keys], "row int, col int").select("row", "col", F.xxhash64("row", "col", F.lit(1)).alias("h")).collect()
        order = sorted(range(len(keys)), key=lambda i: (at[i].h, at[i].row, at[i].col))
        return order[:k]

    return of


@pytest.mark.parametrize("centre", ["mean", "median"])
def test_clusters_of_odd_profiles(spark, drawn, centre):
    """Nulls, NaN, infinite values, short profiles, equal profiles and huge values, by loops over the same first centres."""
    random = np.random.default_rng(2)
    inf, nan = float("inf"), float("nan")
    odd = {
        0: [list(map(float, random.normal(size=3))) for _ in range(40)] + [[1.0, 2.0, 3.0]] * 30,
        1: [list(map(float, random.integers(0, 3, 2))) for _ in range(20)] + [[None, 1.0], [2.0], [1.0, None], [1.0, 0.0, 4.0]],
        2: [list(map(float, random.normal(size=2))) for _ in range(20)] + [[nan, 0.0], [inf, 1.0], [-inf, 1.0], [inf, 0.5], [nan, nan]],
        3: [[float(v)] for v in random.normal(size=12) * 1.7e308 * (np.arange(12) % 3 - 1)] + [[5e-324], [0.0], [1e-320]],
        4: [[nan, 1.0 + i] for i in range(6)],
    }
    keys = {b: [(b, i // 7, i % 7) for i in range(len(of))] for b, of in odd.items()}
    rows = [(*key, p) for b in odd for key, p in zip(keys[b], odd[b])]
    got = {(r.brick_id, r.row, r.col): r.cluster for r in volume.clusters_of(spark.createDataFrame(rows, SCHEMA), 3, centre=centre).collect()}
    for b, of in odd.items():
        assert [got[key] for key in keys[b]] == by_rounds(drawn(keys[b], 3), of, centre == "median"), b
    assert len(got) == len(rows)


@pytest.mark.parametrize("most, bins", [(8192, 256), (4, 8), (1, 16)])
def test_medians_by_windows_are_exact(monkeypatch, most, bins):
    """Windows that miss, hold too much or hold one value many times cost passes alone; the groups are those by sorting."""
    monkeypatch.setattr(profiles, "most_of", lambda windows: most)
    monkeypatch.setattr(profiles, "bins_of", lambda windows: bins)
    random = np.random.default_rng(6)
    inf, nan = float("inf"), float("nan")
    x = np.round(random.standard_cauchy((500, 4)), 1) * np.where(np.arange(500) % 9, 1, 1e6)[:, None]
    x[400:], x[:3], x[3, 1], x[4, 2], x[5, 3] = 0.5, 0.0, inf, -inf, 5e-324
    x[6:60, 0], x[60:62, 0] = -inf, nan
    state = profiles.started({"first": [(None, x[i], np.zeros(4, bool)) for i in range(100, 104)], "n": 500, "low": np.where(np.isfinite(x), x, inf).min(axis=0), "high": np.where(np.isfinite(x), x, -inf).max(axis=0)}, 100, True)
    marks, passes = random.integers(0, 1 << 63, 500).astype(np.uint64), 0
    while not state["done"]:
        told = [profiles.told(x[at], None, None, marks[at], state, True) for at in np.array_split(np.arange(500), 7)]
        state = profiles.stepped(state, profiles.merged([profiles.merged(told[:3]), profiles.merged(told[3:])]), 100, True, float(np.finfo(float).eps))
        passes += 1
        assert passes < 2000
    assert list(profiles.nearest(x, None, None, state, True)) == by_rounds(range(100, 104), [list(map(float, p)) for p in x], True)
    assert most < 8192 or passes <= state["turn"] + 1


def test_what_tasks_hold_is_sent_in_parts(monkeypatch):
    monkeypatch.setattr(profiles, "HELD", 10)
    batch = pa.RecordBatch.from_pydict({"brick_id": [2, 1, 2, 1, 1]})
    sent = list(profiles.gathered(iter([batch, batch]), lambda brick, rows: {"n": np.array([rows.num_rows])}, profiles.merged, 5))
    assert [(b, p - (5 << 24), pickle.loads(t)["n"][0]) for b, p, t in sent] == [(2, 0, 2), (1, 0, 3), (2, 1, 2), (1, 1, 3)]


def test_a_round_of_medians_is_few_jobs(spark):
    """Each round used to run some ten jobs for its medians alone: over 0.1 GB the rounds took longer than the limit."""
    random = np.random.default_rng(7)
    rows = [(0, i // 20, i % 20, list(map(float, random.normal(size=6)))) for i in range(600)]
    brick = spark.createDataFrame([(b, lev, r, c, w) for b, r, c, p in rows for lev, w in enumerate(p)], "brick_id int, lev int, row int, col int, w double")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("clusters", "clusters")
    try:
        volume.clusters(brick, 3, rounds=6, centre="median")
        jobs = len(seen.getJobIdsForGroup("clusters"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert jobs <= 40


def test_many_volumes_are_joined_to_their_states(spark, monkeypatch):
    """Where states are too many for the driver groups are the same."""
    random = np.random.default_rng(9)
    rows = [(b, i // 5, i % 5, list(map(float, random.normal(size=3)))) for b in range(7) for i in range(20)]
    want = sorted(map(tuple, volume.clusters_of(spark.createDataFrame(rows, SCHEMA), 3, centre="median").collect()))
    monkeypatch.setattr(volume, "BROADCAST_BYTES", 10)
    assert sorted(map(tuple, volume.clusters_of(spark.createDataFrame(rows, SCHEMA), 3, centre="median").collect())) == want


@pytest.mark.parametrize("twice", [False, True])
def test_profiles_are_read_from_vectors(spark, tmp_path, twice):
    """Vectors are not dealt out value by value, unless an id stands twice; either way they are the volume's profiles."""
    from pyspark.sql import functions as F

    from terrace.sources import tables

    rows = [(i, [float(i), None if i == 3 else 0.5 * i]) for i in range(40)] + [(50, []), (51, None), (52, [7.0])] + [(4, [9.0, 8.0])] * twice
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = tables.profiles(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == twice
    of = lambda df: sorted(map(tuple, df.withColumn("p", F.col("p").cast("array<double>")).collect()), key=repr)
    assert of(got) == of(volume.profiles(tables.brick(spark, str(tmp_path))))


def test_centres_are_not_copied_to_profiles(spark, monkeypatch):
    """Each row used to carry all centres of two rounds: over 1,025,640 vectors the batches took more memory than an executor has."""
    columns, keep = [], volume._with_states

    def kept(*of):
        made = keep(*of)
        columns.extend([made[0].columns] if made else [])
        return made

    monkeypatch.setattr(volume, "_with_states", kept)
    rows = [(0, i // 5, i % 5, [float(i % 3), float(i)]) for i in range(40)]
    assert volume.clusters_of(spark.createDataFrame(rows, SCHEMA), 3).count() == 40
    assert len(columns) > 2 and all(set(c) <= {"brick_id", "row", "col", "h", "p", "holes"} for c in columns)
