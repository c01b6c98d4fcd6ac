"""Operators on embeddings against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkward.llm import base, embedding_dedup, hard_negatives, registry, whitening
from tests.duck import duck, rows

NAN, INF = float("nan"), float("inf")


def _table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.select("*", *(F.lit("clash").alias(c) for c in ("v", "x", "uid", "node", "key", "core", "anchor", "score", "n")))


@pytest.fixture(scope="module")
def vectors(spark):
    """A tight crowd, a loose chain, copies, unrelated vectors, and every kind of unusable one."""
    base.tune(spark)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(24)
    crowd = centre + rng.standard_normal((60, 24)) * 0.12 * np.linalg.norm(centre) / math.sqrt(24)
    chain = [rng.standard_normal(24)]
    for _ in range(40):
        step = rng.standard_normal(24)
        chain.append(chain[-1] + 0.22 * step * np.linalg.norm(chain[-1]) / np.linalg.norm(step))
    loose = np.array([5.0] + [0.0] * 23) + rng.standard_normal((40, 24)) * 0.32
    other = rng.standard_normal((60, 24))
    rows = [(i, [float(np.float32(c)) for c in v], i % 4) for i, v in enumerate([*crowd, *chain, *loose, *other])]
    n = len(rows)
    rows += [(n + i, rows[i][1], 2) for i in (0, 0, 70, 70, 150)] + [rows[3], rows[3], (None, rows[5][1], 1), (None, None, None), (n + 9, None, 1)]
    rows += [(n + 10, [0.0] * 24, 1), (n + 11, [NAN] * 24, 1), (n + 12, [INF] + [1.0] * 23, 2), (n + 13, [None] + [1.0] * 23, 2), (n + 14, [], 2), (n + 15, [1.0, 2.0], 3), (n + 16, [2.0, 4.0], 3), (n + 17, [-0.0] * 23 + [1.0], 3), (n + 18, [0.0] * 23 + [1.0], None)]
    return _table(spark, rows)


def _usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def _links(rows):
    good = [i for i, r in enumerate(rows) if _usable(r.embedding) and any(r.embedding)]
    near = defaultdict(set)
    for i in good:
        a = np.array(rows[i].embedding)
        for j in good:
            b = np.array(rows[j].embedding)
            if i != j and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.95:
                near[i].add(j)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j].vec_id for j in seen if rows[j].vec_id is not None), default=None)
        out.append((r.vec_id, len(near[i]), least, least == r.vec_id))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "chunk"), [(256, 512), (6, 4)])
def test_links_by_brute_force(spark, vectors, hot, chunk):
    want = _links(vectors.collect())
    got = sorted(map(tuple, embedding_dedup.link(spark, vectors, hot=hot, chunk=chunk).collect()), key=repr)
    assert got == want
    assert max(w[1] for w in want) > 50 and sum(w[1] == 0 for w in want) > 20


def test_links_are_found_in_any_number_of_dimensions():
    for d in (1, 2, 17, 64):
        for n in (100, 10**6):
            k, tables = embedding_dedup.layout(n, d)
            rng = np.random.default_rng(n)
            a = rng.standard_normal((500, d))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            b = a + rng.standard_normal((500, d)) * 0.25 / math.sqrt(d)
            b /= np.linalg.norm(b, axis=1, keepdims=True)
            near = (a * b).sum(1) >= 0.95
            found = np.zeros(500, bool)
            for t in range(tables):
                found |= (embedding_dedup.table_keys(a, t, k)[:, :, None] == embedding_dedup.table_keys(b, t, k)[:, None]).any((1, 2))
            assert found[near].mean() > 0.97 if near.any() else True


def _mined(rows):
    use = []
    for r in rows:
        if r.label is not None and r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding):
            label = (r.label + 1) % 10 if r.vec_id is not None and r.vec_id % 7 == 0 else r.label
            use.append((r.vec_id, label, [math.floor(256 * c) for c in r.embedding]))
    order = lambda p: (-p[0], use[p[1]][0] is None, use[p[1]][0] or 0)
    out = []
    for i, (vec_id, label, x) in enumerate(use):
        if vec_id is None or vec_id % 100:
            continue
        score = [(sum(a * b for a, b in zip(x, y[2], strict=True)), j) for j, y in enumerate(use) if j != i and len(y[2]) == len(x)]
        for p, j in sorted((s for s in score if use[s[1]][1] == label), key=order)[:5]:
            fit = sorted((s for s in score if use[s[1]][1] != label and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:10]
            out += [(vec_id, use[j][0], k, use[m][0], p, s) for k, (s, m) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def test_hard_negatives_by_brute_force(spark, vectors, monkeypatch):
    got = sorted(map(tuple, _mine(spark, vectors).collect()), key=repr)
    want = _mined(vectors.collect())
    assert got == want and len(want) > 20


def _mine(spark, df):
    label = F.col("label").cast("long")
    return hard_negatives.mine(spark, df, F.col("vec_id") % 100 == 0, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


@pytest.mark.parametrize("size", [1.0, 3000.0, 2.0**16])
def test_hard_negatives_with_ties_and_large_components(spark, size):
    rng = np.random.default_rng(int(size))
    rows = [(i * 20, [float(c) * size for c in rng.integers(-3, 4, 6)], int(rng.integers(0, 3))) for i in range(300)]
    df = _table(spark, rows + rows[:3])
    assert sorted(map(tuple, _mine(spark, df).collect()), key=repr) == _mined(df.collect())


def test_every_row_or_group_of_block_products():
    rng = np.random.default_rng(1)
    x, a = rng.integers(-300, 300, (500, 16)).astype(np.int32), rng.integers(-300, 300, (7, 16)).astype(np.int32)
    rows, anchors, score = hard_negatives.Block(x).scores(a, np.ones((500, 7), bool), lambda r, c, low, high: (low <= (x.astype(int) @ a.T)[r, c]) & (high >= (x.astype(int) @ a.T)[r, c]))
    assert len(rows) == 3500 and (score == (x.astype(int) @ a.T)[rows, anchors]).all()


def test_whitening_by_brute_force(spark, vectors):
    rows = [r for r in vectors.collect() if _usable(r.embedding) and len(r.embedding) == 24]
    x = np.array([[math.floor(64 * c) + 1000000 for c in r.embedding] for r in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(spark, vectors).toPandas()
    assert len(got) == 16 * len(rows) and set(got.n) == {n}
    assert sorted(zip(got.vec_id.fillna(-1), got.deviation, strict=True)) == sorted((-1 if r.vec_id is None else r.vec_id, int(((n * v - s) ** 2).sum())) for r, v in zip(rows, x, strict=True) for _ in range(16))
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    for c in range(16):
        part = got[(got.component == c + 1) & got.vec_id.notna()].drop_duplicates().set_index("vec_id")
        want = {r.vec_id: float((v - s / n) @ axes[:, c] / math.sqrt(values[c])) for r, v in zip(rows, x, strict=True) if r.vec_id is not None}
        sign = math.copysign(1, sum(part.whitened[i] * w for i, w in want.items()))
        assert all(abs(sign * part.whitened[i] - w) < 1e-7 for i, w in want.items())
        assert abs(part.explained.iloc[0] / (values[c] / values.sum()) - 1) < 1e-9


def test_triangles_are_reduced_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (400, 5))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(9)
    r = whitening.tsqr(spark, df, [int(c) for c in x.sum(0)], 400)
    y = x - x.mean(0)
    assert np.allclose(r.T @ r, y.T @ y)


def test_jacobi_gives_small_deviations_accurately():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((9, 9)))[0]
    scale = 10.0 ** -np.arange(9)
    sigma, v = whitening.jacobi(np.linalg.qr(rng.standard_normal((40, 9)))[0] * scale @ np.eye(9) @ q)
    assert np.allclose(sigma / scale, 1, rtol=1e-6) and np.allclose(v.T @ v, np.eye(9), atol=1e-13)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], [(100, [1.0], 1), (200, [3.0], 1), (None, [2.0], 2)]])
def test_small_tables(spark, rows):
    df = _table(spark, rows)
    assert sorted(map(tuple, embedding_dedup.link(spark, df).collect()), key=repr) == _links(df.collect())
    assert sorted(map(tuple, _mine(spark, df).collect()), key=repr) == _mined(df.collect())
    fit = {tuple(r[1]) for r in rows if r[1]}
    assert whitening.whiten(spark, df).count() == (len([r for r in rows if r[1]]) * min(1, len(fit) - 1) if fit else 0)


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_hard_negatives"])
def test_queries_by_sql(spark, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck(registry.ORACLE_SQL[name], sf_dir)
    assert len(got) and sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
