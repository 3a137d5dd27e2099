import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import neighbours, queries


def brute(rows, k, is_query):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in rows:
        if is_query(q):
            found = sorted((-float(np.dot(np.float64(np.float32(x)), np.float64(np.float32(v)))), i) for i, v in rows if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in queries.op2_inner_products(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = total = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        s = x @ x[ids == q][0]
        want = [i for _, i in sorted(zip(-s, ids.tolist(), strict=True)) if i != q][:20]
        hits += len(set(want) & {r.vec_id for r in found})
        total += 20
        assert np.allclose([r.score for r in found], [s[ids == r.vec_id][0] for r in found], atol=1e-12)
    assert hits / total >= 0.98


def test_odd_rows_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.5]) for i in range(60)]  # a common vector
    rows += [(200, None), (201, [0.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] + [1.0] * 4), (None, [1.0] * 5), (0, rows[0][1]), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = {}
    for r in neighbours.search(df, F.col("id") % 4 == 0, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute([r for r in rows if r[0] != 205], 7, lambda i: i % 4 == 0)
    assert set(got) == set(want)
    for q, found in want.items():
        found = [(i + 1, *x) for i, x in enumerate(found)]
        assert [x[:2] for x in sorted(got[q])] == [x[:2] for x in found] and np.allclose([x[2] for x in sorted(got[q])], [x[2] for x in found])


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.search(df, F.col("id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert neighbours.search(df.limit(0), F.col("id") == 0).count() == 0


def test_many_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    monkeypatch.setattr(neighbours, "CHUNK", 20)
    x = np.random.default_rng(7).normal(size=(1_200, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
        got = {}
        for r in neighbours.search(df, F.col("id") % 20 == 0, k=9).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        want = brute(rows, 9, lambda i: i % 20 == 0)
        assert {q: sorted(found) for q, found in got.items()} == {q: [(n + 1, i) for n, (i, _) in enumerate(found)] for q, found in want.items()}


def test_cells_are_bounded_and_follow_the_tables():
    assert neighbours.cell_sides(2_000, 100, 64) == (8_192, 4_096)
    assert neighbours.cell_sides(10_000_000, 500_000, 64) == (65_536, 31_250)
    assert max(neighbours.cell_sides(10**9, 10**9, 1_024)) * 1_024 * 8 <= neighbours.CELL_BYTES
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(400, 4)), rng.normal(size=(2, 4))
    model = neighbours.fit(x)  # more asked for than are reranked otherwise
    for query, (at, _) in zip(q, neighbours.best_in_block(model.packed(x), x, np.arange(400), q, model, 300), strict=True):
        assert len(at) == 300 and len(set(at) & set(np.argsort(-(x @ query))[:300])) >= 285
