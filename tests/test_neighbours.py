"""Nearest neighbours: both ways against all distances, blocks that bounds leave out, what is shuffled."""

import numpy as np
import pytest

from passagework.operators import neighbours
from passagework.operators.neighbours import best, cells_of, in_cells, knn, pivots_of, rank_of, vectors, visits


def clusters(rng, n, dims=6, groups=12, spread=0.05):
    centres = rng.normal(0, 3, (groups, dims))
    return centres[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, dims))


def frame(spark, matrix, ident, scope=None, first=0):
    rows = [(first + k, [float(x) for x in v], scope[k] if scope else "x") for k, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{ident} long, vector array<double>, tenant string")


def brute(a, b, k, scope_a=None, scope_b=None):
    out = set()
    for i, x in enumerate(a):
        d = [(round(float(((x - y) ** 2).sum()), 6), j) for j, y in enumerate(b) if not scope_a or scope_a[i] == scope_b[j]]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(sorted(d)[:k])}
    return out


def found(df):
    return {(r.query_id, r.key, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("small_bytes", [1 << 20, 0])
@pytest.mark.parametrize("scoped", [False, True])
def test_equals_all_distances(spark, monkeypatch, small_bytes, scoped):
    monkeypatch.setattr(neighbours, "MATRIX", 500)
    monkeypatch.setattr(neighbours, "BATCH_BYTES", 6 * 8 * 25)
    rng = np.random.default_rng(3)
    a, b = clusters(rng, 60), np.concatenate([clusters(rng, 300), np.repeat(clusters(rng, 1), 120, axis=0)])  # one vector many times
    sa, sb = (([f"t{k % 3}" for k in range(len(x))] if scoped else None) for x in (a, b))
    got = knn(frame(spark, a, "query_id", sa), frame(spark, b, "key", sb).repartition(5), 7, ["tenant"] if scoped else [], 40, small_bytes)
    assert got.columns == [*(["tenant"] if scoped else []), "query_id", "key", "distance", "rank"]
    assert found(got) == brute(a, b, 7, sa, sb)


@pytest.mark.parametrize("small_bytes", [1 << 20, 0])
def test_odd_rows(spark, small_bytes):
    q = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, None, "a"), (3, [1.0, 0.0], None), (4, [0.0, 0.0], "b"), (5, [0.0, 0.0], "none")],
                              "query_id long, vector array<double>, tenant string")
    c = spark.createDataFrame([("x", [0.0, 1.0], "a", 1), ("y", None, "a", 1), ("w", [0.0, 1.0], "a", 1), ("z", [3.0, 4.0], "b", 1), ("v", [0.0, 0.0], None, 1)],
                              "key string, vector array<float>, tenant string, distance int")
    got = sorted((r.tenant, r.query_id, r.key, r.distance, r["rank"]) for r in knn(q, c, 3, ["tenant"], 2, small_bytes).collect())
    assert got == [("a", 1, "w", 1.0, 1), ("a", 1, "x", 1.0, 2), ("b", 4, "z", 25.0, 1)]
    for left, right in ((q.limit(0), c), (q, c.limit(0))):
        assert knn(left, right, 3, [], 2, small_bytes).count() == 0


def test_best_keeps_ties_by_key():
    d = np.array([[1.0, 1.0 + 1e-9, 0.5, 1.0, 2.0]])
    row, col = best(d, 2, rank_of(np.array(["d", "b", "e", "c", "a"])))
    assert col.tolist() == [2, 1] and row.tolist() == [0, 0]
    assert best(d, 3, np.arange(5), np.array([0.7]))[1].tolist() == [2]


def test_bounds_leave_blocks_out(spark):
    """Of clustered vectors a question meets few blocks; of vectors without structure it meets them all, and both are exact."""
    rng = np.random.default_rng(5)
    for data, most in ((clusters(rng, 2000, groups=20), 0.35), (rng.normal(0, 1, (400, 30)), 1.0)):
        c = frame(spark, data, "key")
        q = frame(spark, data[:50], "query_id")
        pivots = pivots_of(c, 50)
        placed = in_cells(c, pivots)
        cells = cells_of(placed, [], 50)
        blocks = sum(x["subs"] for x in cells.first()["cells"])
        local = neighbours.by_cells(q, c, 5, [], 50)
        kth = neighbours.top_per_key(local, ["query_id"], ["distance", "key"], 5).filter("rank = 5").selectExpr("query_id", "round(distance, 6) reach")
        share = visits(q.join(kth, "query_id"), cells, pivots, 5, [], False).count() / (50 * blocks)
        assert 0 < share <= most
        assert visits(q, cells, pivots, 5, [], True).count() < 50 * 4


def test_parts_that_no_question_needs_are_skipped():
    rng = np.random.default_rng(6)
    near = neighbours.Nearest(np.zeros((10, 4)), 3)
    near.meet(np.arange(100), rng.normal(0, 0.1, (100, 4)))
    near.meet(np.arange(100, 200), rng.normal(9, 0.1, (100, 4)))
    assert (near.parts, near.skipped) == (20, 10) and near.found["key"].max() < 100


def test_corpus_stays_where_few_questions_come(spark):
    rng = np.random.default_rng(7)
    q, c = frame(spark, clusters(rng, 20), "query_id"), frame(spark, clusters(rng, 200), "key").repartition(6)
    c.write.mode("overwrite").parquet(path := neighbours.cut.__globals__["shared_folder"](spark) + "/corpus-of-vectors")
    plan = knn(q, spark.read.parquet(path), 5, [])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in below and "WindowGroupLimit" in below


def test_vectors_of_slices(spark):
    table = frame(spark, np.arange(12.0).reshape(4, 3), "key").toArrow()
    assert vectors(table.column("vector").slice(1, 2)).tolist() == [[3, 4, 5], [6, 7, 8]]


@pytest.mark.parametrize("small_bytes", [1 << 20, 0])
def test_only_folders_of_asked_tenants_are_read(spark, tmp_path, small_bytes):
    """The corpus lies by tenant: other tenants' folders may even be gone."""
    import shutil
    rng = np.random.default_rng(8)
    tenants = [f"t{k % 5}" for k in range(300)]
    path = str(tmp_path / "vectors")
    c = frame(spark, clusters(rng, 300), "key", tenants)
    c.write.partitionBy("tenant").parquet(path)
    q = frame(spark, clusters(rng, 10), "query_id", ["t1", "t3"] * 5)
    stored = spark.read.schema(c.schema).parquet(path)
    want = found(knn(q, c, 4, ["tenant"], 40, small_bytes))
    for name in ("t0", "t2", "t4"):
        shutil.rmtree(tmp_path / "vectors" / f"tenant={name}")
    got = knn(q, stored, 4, ["tenant"], 40, small_bytes)
    if small_bytes:
        assert "PartitionFilters: [isnotnull(tenant" in got._jdf.queryExecution().executedPlan().toString()
    assert found(got) == want


def test_tiles_hold_few_rows_without_structure(spark, monkeypatch):
    """Vectors that no bound separates: results of a tile, not of every block, and both sides move once per crowd or slab."""
    monkeypatch.setattr(neighbours, "CROWD", 50)
    monkeypatch.setattr(neighbours, "SLAB", 200)
    monkeypatch.setattr(neighbours, "GATHERED", 30)
    rng = np.random.default_rng(9)
    data = rng.normal(0, 1, (400, 20))
    q, c = frame(spark, data[:200], "query_id"), frame(spark, data, "key")
    made, plain = [], neighbours.tiles
    monkeypatch.setattr(neighbours, "tiles", lambda *args: made.append(plain(*args)) or made[-1])
    assert found(knn(q, c, 5, [], 10, 0)) == brute(data[:200], data, 5)
    assert made[0].count() <= 200 * 5 * 4  # a block holds 10 rows: every block's best would be 200 * 5 * 40 rows


def test_a_vector_that_python_makes_is_made_once(spark):
    """The filter on rows without a vector does not run the embedding a second time."""
    from passagework.operators import retrieval as R
    c = R.embed(spark.createDataFrame([(k, f"a{k} b", "x") for k in range(9)] + [(9, "", "x")], "key long, text string, tenant string"), "text")
    q = R.embed(spark.createDataFrame([(1, "a3 b", "x")], "query_id long, text string, tenant string"), "text")
    found = R.knn(q, c, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("vectors(") <= 2 and plan.count("ArrowEvalPython") == 1
    assert found.filter("rank = 1").first().key == 3
