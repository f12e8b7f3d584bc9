"""Work that must not grow faster than the input: frames, sums and shuffles of the operators that the driver's larger tables reach."""

import numpy as np
from pyspark.sql import functions as F

from terrace.operators import components, distances, distributions, filters, fractals, geometry, grains, levelling, points, statistics, volume, watershed
from terrace.plans import tiles


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def column(spark, n):
    """A field of one column with every hundredth pixel free."""
    return spark.range(n).select(F.lit(0).alias("field_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.col("id").cast("double").alias("z"), (F.col("id") % 100 != 0).cast("double").alias("m"))


def turned(field):
    return field.withColumns({"row": F.col("col"), "col": F.col("row")})


def test_distances_read_a_column_once(spark):
    for metric in distances.METRICS:
        assert "unboundedfollowing" not in plan(distances.distance_transform(column(spark, 8), metric, from_border=False)).lower().replace("unboundedpreceding$(), unboundedfollowing$()", "")
    found = distances.distance_transform(column(spark, 1000), "cityblock", from_border=False).collect()
    assert sorted((r.row, r.z) for r in found) == [(i, float(min(i % 100, 100 - i % 100 if i < 900 else 1000))) for i in range(1000)]


def test_masked_pixels_read_a_row_once(spark):
    assert "unboundedfollowing" not in plan(levelling.interpolate_masked(turned(column(spark, 8)))).lower()
    found = levelling.interpolate_masked(turned(column(spark, 1000))).collect()
    assert sorted((r.col, round(r.z, 6)) for r in found) == [(i, float(min(i, 900))) for i in range(1000)]


def test_kernels_gather_a_window_once(spark):
    """Neither images of each pixel nor a join on the gathered windows, which was computed three times for its field's size."""
    field = column(spark, 12).drop("m")
    for made in (filters.gaussian(field, 1.0), filters.kernel5(field, "laplace_gauss"), filters.gradient(field)):
        assert "Generate" not in plan(made) and "Join" not in plan(made)
    # Wider than the field: mirrored over and over.
    found = filters.convolve(field.where("row < 2"), [1.0, 0, 0, 0, 0, 0, 0], 1, 7).collect()
    assert sorted((r.row, r.z) for r in found) == [(0, 1.0), (1, 1.0)]


def test_entropy_of_all_levels_from_one_sort(spark):
    """No bin is copied to every level; bins that go over batches and partitions count once."""
    rng = np.random.default_rng(3)
    cloud = [(f, float(np.exp(x)), float(y)) for f in range(2) for x, y in rng.normal(size=(500, 2)).round(1)]
    field = spark.createDataFrame(cloud, "field_id int, x double, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = distributions.entropy_at_scales(field, ("x", "y"))
        assert "Generate" not in plan(made)
        found = {(r.field_id, r.level): r.entropy for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for f in range(2):
        at = np.array([(x, y) for g, x, y in cloud if g == f])
        low, span = at.min(axis=0), np.ptp(at, axis=0)
        for level in range(14):
            counts = np.unique(np.minimum(np.floor((at - low) / span * 2**level), 2**level - 1), axis=0, return_counts=True)[1]
            assert abs(found[f, level] - np.log(500) - np.log(span.prod() / 4**level) + (counts * np.log(counts)).sum() / 500) < 1e-9
    assert len(found) == 28


def test_nearest_points_of_a_dense_cloud(spark, monkeypatch):
    """A query meets a few points of its place and around, however dense the cloud is."""
    cloud = [(0, i, float(i % 40) / 100, float(i // 40 % 40) / 100) for i in range(6400)]
    dense = spark.createDataFrame(cloud, "surface_id int, pt_id long, x double, y double")
    tried, within = [], points._within
    monkeypatch.setattr(points, "_within", lambda left, right: tried.append(within(left, right).count()) or within(left, right))
    found = points.nearest(dense.where("pt_id % 1000 = 7"), dense, 2.0, 3).collect()
    assert sum(tried) < 7 * 3 * 30
    at = {i: (x, y) for _, i, x, y in cloud}
    for q in {r.left_id for r in found}:
        best = sorted((float(np.hypot(at[q][0] - x, at[q][1] - y)), i) for i, (x, y) in at.items())[:3]
        assert sorted((r.distance, r.right_id) for r in found if r.left_id == q) == best
    assert len(found) == 21


def test_pairs_of_crowded_cells_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(points, "PAIRS", 100)
    cloud = spark.range(300).select(F.lit(0).alias("surface_id"), F.col("id").alias("pt_id"), (F.col("id") % 30).cast("double").alias("x"), F.lit(0.0).alias("y"))
    made = points.within(cloud, cloud, 1.0)
    assert made.count() == 300 * 30 - 2 * 100 and made.rdd.getNumPartitions() == 89


def test_grains_are_joined_within_strips_first(spark, monkeypatch):
    """Only what touches across the borders of strips is left for rounds over the whole table."""
    seen, components = [], grains.connected_components
    monkeypatch.setattr(grains, "connected_components", lambda edges, *how: seen.append(edges.count()) or components(edges, *how))
    rng = np.random.default_rng(5)
    mask = rng.random((200, 12)) < 0.55
    field = spark.createDataFrame([(0, r, c, float(mask[r, c])) for r in range(200) for c in range(12)], "field_id int, row int, col int, m double")
    for corners in (False, True):
        found = {(p.row, p.col): p.grain for p in grains.number(field, corners).collect()}
        want, at = {}, 0
        for r, c in zip(*np.nonzero(mask)):
            if (r, c) in want:
                continue
            at, todo = at + 1, [(int(r), int(c))]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 200 and 0 <= x < 12 and mask[y, x] and (y, x) not in want:
                    want[y, x] = at
                    todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not i or not j]
        assert found == want
    assert max(seen) <= 3 * 12


def test_clusters_write_profiles_once(spark, monkeypatch):
    """Rounds write centres and medians, not the profiles again."""
    rng = np.random.default_rng(4)
    rows = [(0, lev, r, c, float(rng.normal() + 2 * (r % 2) * lev)) for r in range(20) for c in range(10) for lev in range(3)]
    sizes = []
    for module, name in ((volume, "durable"), (volume, "written"), (statistics, "durable")):
        keep = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, keep=keep: (lambda made: sizes.append(made.count()) or made)(keep(df)))
    for centre in ("mean", "median"):
        sizes.clear()
        assert volume.clusters(spark.createDataFrame(rows, "brick_id int, lev int, row int, col int, w double"), 2, centre=centre).count() == 200
        assert len(sizes) > 5 and sum(n >= 200 for n in sizes) == 1


def test_watershed_follows_borders_of_tiles_alone(spark, monkeypatch):
    """Rounds see the pixels on tiles' borders, touching pixels are not copied, and results are those of one tile."""
    y, x = np.mgrid[0:40, 0:36]
    z = np.hypot(y - 3, x - 30) + np.random.default_rng(6).random(y.shape) * (x < 12)
    field = spark.createDataFrame([(0, r, c, float(z[r, c])) for r in range(40) for c in range(36)], "field_id int, row int, col int, z double")
    sizes, want = [], None
    keep = watershed.written
    monkeypatch.setattr(watershed, "written", lambda df: (lambda made: sizes.append(made.count()) or made)(keep(df)))
    for side in (64, 8):
        monkeypatch.setattr(tiles, "TILE", side)
        sizes.clear()
        basins = watershed.basins(field)
        rounds = max(sizes, default=0)
        met = watershed.saddles(basins)
        assert "_s#" not in plan(met)
        lines = watershed.segments(watershed.watershed(field, 0.3))
        found = [sorted(map(tuple, df.collect())) for df in (basins, met, lines)]
        want = want or found
        assert found == want
    assert 0 < rounds < 1440 * 0.55


def test_levels_of_triangles_are_not_copied(spark, monkeypatch):
    """Corners of small squares are not sent out by level; sums over tiles are those of the whole field."""
    z = np.random.default_rng(8).random((33, 33))
    field = spark.createDataFrame([(0, r, c, float(z[r, c])) for r in range(33) for c in range(33)], "field_id int, row int, col int, z double")
    h, heron = z * 32 / np.ptp(z), lambda a, b, c: np.sqrt(np.maximum((a + b + c) * (b + c - a) * (a + c - b) * (a + b - c), 0)) / 4
    for side in (4, 256):
        monkeypatch.setattr(tiles, "TILE", side)
        found = {r.level: r.log_area for r in fractals.triangulation(field).collect()}
        for level in range(6):
            s = 32 >> level
            g = h[::s, ::s]
            a, b, c, d = g[:-1, :-1], g[:-1, 1:], g[1:, :-1], g[1:, 1:]
            across = np.hypot(s * 2**0.5, c - b)
            area = heron(np.hypot(s, a - b), np.hypot(s, a - c), across) + heron(np.hypot(s, c - d), np.hypot(s, b - d), across)
            assert abs(found[level] - np.log(area.sum())) < 1e-12
        assert len(found) == 6


def test_resampling_sends_a_pixel_to_tiles(spark, monkeypatch):
    """One row for each tile that a pixel weighs in, whatever number of new pixels; nulls weigh nothing, missing pixels leave gaps."""
    z = np.random.default_rng(9).random((7, 5))
    rows = [(0, r, c, None if (r, c) in ((2, 2), (0, 0)) else float(z[r, c])) for r in range(7) for c in range(5) if (r, c) != (6, 0)]
    field = spark.createDataFrame(rows, "field_id int, row int, col int, z double")
    values = {(r, c): v for _, r, c, v in rows}
    for side, linear, (xres, yres) in ((4, True, (11, 9)), (256, True, (40, 3)), (4, False, (11, 9)), (2, True, (2, 2))):
        monkeypatch.setattr(tiles, "TILE", side)
        sent = geometry.resample(field, xres, yres, linear)
        assert "_r.w" not in plan(sent)
        want = {}
        for t in range(yres):
            for s in range(xres):
                y, x = min(max((t + 0.5) / (yres / 7) - 0.5, 0), 6), min(max((s + 0.5) / (xres / 5) - 0.5, 0), 4)
                weigh = (lambda at, to: max(1 - abs(at - to), 0)) if linear else (lambda at, to: float(np.floor(at + 0.5) == to))
                met = [(v, weigh(y, r) * weigh(x, c)) for (r, c), v in values.items() if weigh(y, r) * weigh(x, c) > 0]
                if met:
                    known = [v * w for v, w in met if v is not None]
                    want[t, s] = round(sum(known), 9) if known else None
        assert {(r.row, r.col): r.z if r.z is None else round(r.z, 9) for r in sent.collect()} == want


def test_rounds_of_components_do_not_broadcast(spark, monkeypatch):
    """Each broadcast of a round costs the driver a job, a thread and a table."""
    plans, keep = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: plans.append(plan(df)) or keep(df))
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "src long, dst long")
    assert sorted(map(tuple, components.connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert all(p.count("Join") == p.count("strategy=merge") for p in plans) and "strategy=merge" in plans[1]


def test_rounds_of_components_deal_rows_out_three_times(spark, monkeypatch):
    """A round has one shuffle for each star and one for repeated links; small tables are mostly a shuffle's files."""
    plans, keep = [], components.durable

    def kept(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return keep(df)

    monkeypatch.setattr(components, "durable", kept)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 95), (95, 91)], "src long, dst long")
    assert {r.node: r.component for r in components.connected_components(edges).collect()} == dict.fromkeys(range(41), 0) | dict.fromkeys((90, 91, 95), 90)
    assert all(p.count("Exchange hash") - p.count("ReusedExchange") <= 3 for p in plans[1:])
