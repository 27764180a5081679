"""The pivot index gives what a full search gives, and reads less of clustered vectors."""

from __future__ import annotations

import numpy as np
import pytest

from codestrata import schemas
from codestrata.operators import pivots, vectors
from codestrata.sources import tables


def hits(df):
    return sorted((r.collection, r.query_id, r["rank"], r.item_id, r.distance) for r in df.collect())


def stored(spark, tmp_path, rows, dim, metric, **options):
    df = spark.createDataFrame(rows, schemas.VECTORS).repartition(4)
    tables.write_vectors(df, str(tmp_path / "vectors"))
    return df, tables.load_pivot_index(spark, str(tmp_path / "index"), str(tmp_path / "vectors"), dim, metric, **options)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16)) * 10
    rows = [(c, f"{c}{i:05d}", [float(x) for x in centers[i % 20] + rng.normal(size=16) * 0.3]) for c in "ab" for i in range(2000)]
    # Whole numbers give ties, copies of one vector a third of a collection, and one collection is shorter than k.
    rows += [("t", f"t{i}", [float(x) for x in (rng.integers(-1, 2, 16) if i % 3 else [1] * 8 + [0] * 8)]) for i in range(300)]
    rows += [("s", "only", [1.0] * 16), ("t", "zero", [0.0] * 16)]
    queries = [(f"q{i}", [float(x) for x in centers[i] + rng.normal(size=16) * 0.3]) for i in range(3)]
    queries += [("tie", [1.0] * 8 + [0.0] * 8), ("far", [1000.0] * 16), ("zero", [0.0] * 16)]
    return rows, queries


@pytest.mark.parametrize("metric", ["l2", "unit"])
@pytest.mark.parametrize("asked", [slice(0, 3), slice(3, 6), slice(0, 6)], ids=["near", "ties", "all"])
def test_equals_the_full_search(spark, tmp_path, clustered, metric, asked):
    rows, queries = clustered
    df, index = stored(spark, tmp_path, rows, 16, metric, pivots=24)
    q = spark.createDataFrame(queries[asked], "query_id string, embedding array<float>")
    for k in (1, 5):
        want = hits(vectors.knn(df, q, k, metric))
        got = hits(pivots.search(index, q, k))
        assert [w[:4] for w in want] == [g[:4] for g in got]
        assert [w[4] for w in want] == pytest.approx([g[4] for g in got], abs=1e-9)
    assert hits(pivots.search(index, q, 5, broadcast_bytes=10)) == hits(vectors.knn(df, q, 5, metric, broadcast_bytes=10))


def rows_read(df):
    """Rows that the scan itself brought, before any filter: those of the row groups it opened."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_reads_fewer_row_groups_of_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 64)) * 10
    rows = [("a", f"{i:05d}", [float(x) for x in centers[i % 40] + rng.normal(size=64) * 0.3]) for i in range(8000)]
    _, index = stored(spark, tmp_path, rows, 64, "l2", pivots=40, file_rows=100)
    q = spark.createDataFrame([("q", rows[7][2])], "query_id string, embedding array<float>")
    condition = pivots.to_read(index, q, 5)
    assert index.rows.filter(condition).count() < 0.1 * len(rows)
    plan = index.rows.filter(condition)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(pivot," in plan.split("PushedFilters:")[1]

    assert rows_read(index.rows) == len(rows)
    assert 0 < rows_read(index.rows.filter(condition)) < 0.2 * len(rows)


def test_empty_tables_and_other_widths(spark, tmp_path):
    q = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, embedding array<float>")
    _, index = stored(spark, tmp_path, [("a", "1", None)], 2, "l2")
    assert hits(pivots.search(index, q)) == []
    _, index = stored(spark, tmp_path / "more", [("a", "1", [0.0, 0.0])] * 3, 2, "unit")
    assert hits(pivots.search(index, q)) == [] and hits(pivots.search(index, q.limit(0))) == []
    with pytest.raises(ValueError, match="not for l2"):
        tables.load_pivot_index(spark, str(tmp_path / "more" / "index"), str(tmp_path / "more" / "vectors"), 2, "l2")
    with pytest.raises(Exception, match="several widths|of width"):
        stored(spark, tmp_path / "odd", [("a", "1", [0.0, 0.0]), ("a", "2", [0.0])], 2, "l2")


def test_bounds_never_lose_a_vector():
    rng = np.random.default_rng(5)
    for _ in range(200):
        points, p = rng.normal(size=(60, 3)), rng.normal(size=(5, 3))
        q = rng.normal(size=(2, 3))
        gaps, to = pivots.distances(q, p), pivots.distances(points, p)
        own = to.argmin(axis=1)
        exact = np.sqrt(((q[:, None] - points[None]) ** 2).sum(axis=2))
        bound = np.sort(exact, axis=1)[:, 4]
        for c in np.unique(own):
            inside = np.flatnonzero(own == c)
            span = pivots.reachable(gaps, bound, int(c), to[inside, c].min(), to[inside, c].max(), p)
            for i in inside[(exact[:, inside] <= bound[:, None]).any(axis=0)]:
                assert span and span[0] - 1e-9 <= to[i, c] <= span[1] + 1e-9
