"""Exact neighbour search and point-in-polygon against brute force."""

import numpy as np
import pytest

from gridstats.operators.neighbours import isolation_filter, knn_impute, knn_join
from gridstats.operators.spatial import RING_TYPE, assign_region, mask_outside


def brute(x, k):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    return {i: sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))}


@pytest.mark.parametrize("block_rows", [2048, 30])
def test_neighbours_with_a_third_of_copies(spark, block_rows):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(240, 3)), 2)
    x[80:160] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vec array<double>")
    got = {}
    for r in knn_join(df, "id", "vec", 5, block_rows=block_rows).collect():
        got.setdefault(r["id"], []).append((r["rank"], round(r["distance"], 9), r["neighbour"]))
    for i, want in brute(x, 5).items():
        assert [(d, n) for _, d, n in sorted(got[i])] == [(round(d, 9), n) for d, n in want]


def test_isolated_rows_are_dropped(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(99, 2)).tolist() + [[50.0, 50.0]]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(100, None, 1.0)], "id int, a double, b double")
    left = {r["id"] for r in isolation_filter(df, ["a", "b"], k=5, share=0.99, block_rows=25).collect()}
    assert left == set(range(99))


def test_neighbour_imputation(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 3)), 2)
    x[rng.random(60) < 0.3, 0] = np.nan
    x[rng.random(60) < 0.3, 1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in knn_impute(df, df, ["a", "b", "c"], "id", 5, block_rows=40).collect()}
    for i in range(60):
        for f in range(3):
            if not np.isnan(x[i, f]):
                assert got[i][f] == x[i, f]
                continue
            found = []
            for j in range(60):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not np.isnan(x[j, f]) and both.any():
                    found.append((np.sqrt(3 / both.sum() * ((x[i][both] - x[j][both]) ** 2).sum()), j))
            found = sorted(found)[:5]
            if not found:
                want = np.nanmean(x[:, f])
            elif found[0][0] == 0:
                want = np.mean([x[j, f] for d, j in found if d == 0])
            else:
                w = np.array([1 / d for d, _ in found])
                want = (w * [x[j, f] for _, j in found]).sum() / w.sum()
            assert got[i][f] == pytest.approx(want)


POLYGONS = {
    "A": [[(0, 0), (5, 0), (5, 5), (0, 5)], [(1, 1), (1, 3), (3, 3), (3, 1)]],
    "B": [[(4, 4), (9, 4.5), (7, 9)]],
    "C": [[(-1, 6), (2, 6), (2, 9.5), (-1, 9.5), (-1, 6)], [(8, 0.5), (9.9, 0.5), (9.9, 2.5)]],
}


def inside(x, y, rings):
    count = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
                count += 1
    return count % 2 == 1


@pytest.mark.parametrize("tile", [0.4, 50.0])
def test_points_in_polygons(spark, tile):
    rng = np.random.default_rng(6)
    points = [(float(a), float(b)) for a, b in np.round(rng.uniform(-2, 10.5, (300, 2)), 2)]
    points += [(float(a), float(b)) for a in range(-1, 11) for b in range(0, 10)]  # vertices and edges
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, x double, y double")
    table = spark.createDataFrame([(k, [[(float(a), float(b)) for a, b in r] for r in v]) for k, v in POLYGONS.items()], "region string, rings " + RING_TYPE)
    got = {r["id"]: r["region"] for r in assign_region(df, table, x="x", y="y", tile=tile).collect()}
    for i, (x, y) in enumerate(points):
        rings = {k: [r[:-1] if r[0] == r[-1] else r for r in v] for k, v in POLYGONS.items()}
        assert got[i] == next((k for k in sorted(rings) if inside(x, y, rings[k])), None)
    masked = mask_outside(df, table, "x", x="x", y="y", tile=tile)
    assert masked.where("x is null").count() == sum(v is None for v in got.values())


def test_neighbours_keep_text_ids(spark):
    df = spark.createDataFrame([(f"s{i:02d}", [float(i), 0.0]) for i in range(30)], "name string, vec array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in knn_join(df, "name", "vec", 2, block_rows=8).collect()}
    assert got["s00", 1] == "s01" and got["s10", 1] == "s09" and got["s10", 2] == "s11"


def test_approximate_neighbours(spark):
    """Clusters, one of them most of the rows, with copies; fewer pairs than all, recall measured, distances exact."""
    from gridstats.operators import neighbours
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16)) * 6
    x = np.concatenate([centres[rng.integers(0, 30, 600)] + 0.3 * rng.standard_normal((600, 16)), centres[0] + 0.1 * rng.standard_normal((500, 16))])
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(2000 + i, x[7].tolist()) for i in range(9)] + [(3000, None)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    found = neighbours.knn_join_approximate(frame, "id", "v", 4, block_rows=64)
    exact = neighbours.knn_join(frame, "id", "v", 4, block_rows=64)
    row = neighbours.neighbour_recall(found, exact).first()
    assert row["wanted"] == 4 * 1109 and row["recall"] >= 0.95
    known = {(r["id"], r["neighbour"]): r["distance"] for r in exact.collect()}
    got = found.collect()
    assert all(known.get((r["id"], r["neighbour"]), r["distance"]) == pytest.approx(r["distance"]) for r in got)
    assert len({(r["id"], r["neighbour"]) for r in got}) == len(got) and max(r["rank"] for r in got) == 4
    assert neighbours.knn_join_approximate(frame.limit(0), "id", "v", 4).count() == 0
    buckets = neighbours.fit_buckets(x, 4, 0.95)
    share = np.mean([np.isin(buckets.home(x), row).any(axis=1).mean() for row in buckets.visited(x[:50])])
    assert share < 0.8


def test_points_on_tile_borders_and_ragged_regions(spark):
    """Vertices, flat edges and points on tile borders; a ragged ring; edges stored stay few beside tiles times edges."""
    from gridstats.operators.spatial import region_tiles
    rng = np.random.default_rng(4)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 60))
    ragged = [(float(np.round(3 + (1 + 2 * r) * np.cos(t), 1)), float(np.round(3 + (1 + 2 * r) * np.sin(t), 1))) for t, r in zip(angle, rng.random(60))]
    steps = [(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (4.0, 2.0), (4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (0.0, 6.0), (0.0, 4.0), (2.0, 4.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    shapes = {"a": [steps], "b": [ragged], "c": [[(x * 0.1, y * 0.1) for x, y in steps], [(5.0, 5.0), (5.0, 5.5), (5.5, 5.5)]]}
    table = spark.createDataFrame([(k, v) for k, v in shapes.items()], "region string, rings " + RING_TYPE)
    grid = [(i, round(float(a), 2), round(float(b), 2)) for i, (a, b) in enumerate((a, b) for a in np.arange(-1, 7, 0.2) for b in np.arange(-1, 7, 0.2))]
    df = spark.createDataFrame(grid, "id int, x double, y double")

    def inside(x, y, rings):
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    return False
                if (y1 > y) != (y2 > y) and x1 + (y - y1) * ((x2 - x1) / (y2 - y1)) > x:
                    odd = not odd
        return odd

    want = {i: next((k for k in sorted(shapes) if inside(x, y, shapes[k])), None) for i, x, y in grid}
    for tile in (0.1, 0.3, 1.0, 2.0, 50.0):
        got = {r["id"]: r["region"] for r in assign_region(df, table, x="x", y="y", tile=tile).collect()}
        assert got == want, tile
    small = region_tiles(table.where("region = 'a'"), 0.1).selectExpr("sum(aggregate(candidates, 0, (n, c) -> n + coalesce(size(c.tile.edges), 0))) as n").first()["n"]
    assert small <= 13 * 2 + 5 * sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(steps, steps[1:])) / 0.1


@pytest.mark.parametrize("block_rows", [9, 2048])
def test_imputation_under_any_pattern(spark, block_rows):
    """Six features, dozens of missing patterns, copies, a row and a feature without values; small cells."""
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(150, 6)) + 4 * rng.integers(0, 3, (150, 1)), 1)
    x[rng.random((150, 6)) < 0.4] = np.nan
    x[20:60], x[70] = x[19], np.nan
    x[:, 5] = np.nan
    names = list("abcdef")
    frame = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: [r[n] for n in names] for r in knn_impute(frame, frame, names, "id", 4, block_rows=block_rows).collect()}
    assert len(got) == 150
    for i in range(150):
        for f in range(6):
            if not np.isnan(x[i, f]):
                assert got[i][f] == x[i, f]
                continue
            found = []
            for j in range(150):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not np.isnan(x[j, f]) and both.any():
                    found.append((np.sqrt(((x[i][both] - x[j][both]) ** 2).sum()) * np.sqrt(6 / both.sum()), j))
            found = sorted(found)[:4]
            if f == 5:
                assert got[i][f] is None
            elif not found:
                assert got[i][f] == pytest.approx(np.nanmean(x[:, f]))
            elif found[0][0] == 0:
                assert got[i][f] == pytest.approx(np.mean([x[j, f] for d, j in found if d == 0]))
            else:
                assert got[i][f] == pytest.approx(sum(x[j, f] / d for d, j in found) / sum(1 / d for d, j in found))


def test_vectors_are_copied_few_times(spark):
    """In many dimensions bounds rule out little: a vector then visits a few large units, not every small block."""
    from gridstats.operators import neighbours
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 24))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(600, [float("nan")] * 24)], "id bigint, v array<double>")
    handed = []
    meet = neighbours._meet

    def counted(asked, given, *rest):
        handed.append(asked.count() + given.count())
        return meet(asked, given, *rest)

    neighbours._meet = counted
    try:
        found = neighbours.knn_join(frame, "id", "v", 3, block_rows=10).collect()
        near = neighbours.knn_join_approximate(frame, "id", "v", 3, block_rows=10).collect()
    finally:
        neighbours._meet = meet
    got = {}
    for r in sorted(found, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append((pytest.approx(r["distance"]), r["neighbour"]))
    want = brute(x, 3)
    assert {i: v for i, v in got.items() if i < 600} == {i: [(d, j) for d, j in v] for i, v in want.items()}
    assert len(handed) == 3 and max(handed) <= 601 * 16
    exact = {(i, j) for i, v in want.items() for _, j in v}
    assert len({(r["id"], r["neighbour"]) for r in near} & exact) >= 0.9 * len(exact)


def test_imputation_copies_donors_few_times(spark):
    """Gaps far from each other in the order of rows: donors are copied per part of their visitors, not per part of all rows."""
    from gridstats.operators import neighbours
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 3)) * 50, 2)
    rows = [(i, None if i % 3 == 0 else float(a), float(b), float(c)) for i, (a, b, c) in enumerate(x)]
    frame = spark.createDataFrame([*rows, (900, None, 1.0, 2.0), (901, None, 1.0, 2.0)], "id bigint, a double, b double, c double")
    handed = []
    meet = neighbours._meet

    def counted(asked, given, *rest):
        handed.append((asked.count(), given.count()))
        return meet(asked, given, *rest)

    neighbours._meet = counted
    try:
        got = {r["id"]: r["a"] for r in knn_impute(frame, frame, ["a", "b", "c"], "id", 3, block_rows=16).collect()}
    finally:
        neighbours._meet = meet
    assert got[900] == got[901] and [a for a, _ in handed][0] == 301 and max(a for a, _ in handed) < 301 * 30 and all(g <= 902 for _, g in handed)
    donors = [i for i in range(900) if i % 3]
    for i in range(0, 900, 90):
        found = sorted((np.sqrt(((x[i, 1:] - x[j, 1:]) ** 2).sum()), j) for j in donors)[:3]
        w = np.array([1 / d for d, _ in found])
        assert got[i] == pytest.approx((w * x[[j for _, j in found], 0]).sum() / w.sum())


def test_isolation_filter_searches_once(spark):
    """the quantile and the rows that are left read written distances; the search is not part of their plans."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "id int, a double, b double")
    left = isolation_filter(df, ["a", "b"], k=5, share=0.9, block_rows=64)
    assert "CoGroup" not in left._jdf.queryExecution().executedPlan().toString()
    x = np.array([(r["a"], r["b"]) for r in df.orderBy("id").collect()])
    mean = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 1:6].mean(axis=1)
    assert {r["id"] for r in left.collect()} == set(np.flatnonzero(mean <= np.quantile(mean, 0.9)).tolist())


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 1e6), (1e-30, 0.0), (1e150, 0.0), (1e200, 0.0)])
def test_products_in_single_precision_lose_no_neighbour(scale, offset):
    """rough distances rule out only pairs that are none of the nearest, whatever the size of the numbers."""
    from gridstats.operators import neighbours
    rng = np.random.default_rng(6)
    asked, given = (rng.normal(size=(n, 8)).round(1) * scale + offset for n in (40, 5000))
    with np.errstate(over="ignore"):
        dist = neighbours._distances(asked, given)
        for reach in (np.full(40, np.inf), np.sort(dist, axis=1)[:, 3], np.sort(dist, axis=1)[:, 300]):
            at, to, found = neighbours._close_pairs(asked, given, 6, reach)
            want = (dist <= np.minimum(np.sort(dist, axis=1)[:, 5], reach)[:, None])
            assert set(zip(*np.nonzero(want))) <= set(zip(at, to)) and np.array_equal(found, dist[at, to])


def test_rows_look_at_few_pivots(spark):
    """cells and boxes come in groups; a group's box is no farther than any of its cells', and results do not depend on the cells."""
    from gridstats.operators.neighbours import Boxes, Groups, Layout
    rng = np.random.default_rng(7)
    x = np.where(rng.random((4000, 3)) < 0.3, np.nan, rng.normal(size=(4000, 3)))
    filled = np.nan_to_num(x)
    groups = Groups.of(filled[:100])
    assert len(groups.centres) == 10 and sorted(np.unique(np.concatenate(groups.members))) == list(range(100))
    home = groups.home(filled)
    low, high, every, some = (np.full((100, 3), v) for v in (np.nan, np.nan, True, False))
    for c in np.unique(home):
        rows = x[home == c]
        some[c], every[c] = ~np.isnan(rows).all(axis=0), ~np.isnan(rows).any(axis=0)
        low[c, some[c]], high[c, some[c]] = np.nanmin(rows[:, some[c]], axis=0), np.nanmax(rows[:, some[c]], axis=0)
    boxes, held = Boxes(low, high, every, some), [g[np.isin(g, home)] for g in groups.members]
    held = [g for g in held if len(g)]
    outer, inner = boxes.around(held).bounds(x[:300]), boxes.bounds(x[:300])
    assert all((outer[:, i] <= inner[:, g].min(axis=1) * (1 + 1e-12)).all() for i, g in enumerate(held))
    layout = Layout(np.array([0, 1, 4]), np.array([1, 3, 1]))
    assert [u.tolist() for u in layout.units(np.array([2, 0, 0, 2]), np.array([0, 1, 2, 2]), 4)] == [[1, 2, 3, 4], [], [0, 4], []]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x[:900])], "id int, a double, b double, c double")
    fine, whole = ({r["id"]: r[1:] for r in knn_impute(df, df, ["a", "b", "c"], "id", 3, block_rows=b).collect()} for b in (16, 4096))
    assert fine.keys() == whole.keys() and all(fine[i] == pytest.approx(whole[i]) for i in whole)
