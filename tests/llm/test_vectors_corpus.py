"""Near-duplicate vectors and whitening against numpy over all pairs and all rows."""

import numpy as np
import pytest

from thermocline.llm import embedding_dedup as E, whitening

DDL = "vec_id long, embedding array<float>, label int, node long, v string, x int, copies string, n double"


def vectors(seed=3, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(400, dim))
    near = np.repeat(base[:30], 6, axis=0) + 0.05 * rng.normal(size=(180, dim))
    hot = base[40] + 0.04 * rng.normal(size=(250, dim))
    chain = base[50] + np.linspace(0, 3, 40)[:, None] * base[51]  # neighbours link, ends do not
    rows = [(i, v) for i, v in enumerate(np.r_[base, near, hot, chain].astype("f4").tolist())]
    same = rows[7][1]
    rows += [(2000 + i, same) for i in range(60)] + [(2100, [2 * x for x in same]), (2101, [-x for x in same])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, [float("nan")] + [1.0] * (dim - 1)), (3004, [float("inf")] + [1.0] * (dim - 1)),
             (3005, [None] + [1.0] * (dim - 1)), (3006, same[:5]), (3007, same[:5]), (3008, [1e-30 * x for x in same]), (None, same),
             (3009, [3e38] * dim), (3009, [3e38] * dim), (3010, None), (3010, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", 3, "c", 0.5) for i, v in rows], DDL)


def all_pairs(rows, threshold):
    at, m = [], []
    for k, (_, v) in enumerate(rows):
        if v and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            at.append(k)
            m.append(np.array(v, "f4").astype(float))
    m = np.array(m)
    m /= np.abs(m).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    ids = [-(2 ** 63) if i is None else i for i, _ in rows]
    links, comp = [0] * len(rows), list(ids)
    label = np.array([ids[k] for k in at])
    while True:
        low = np.minimum(label, np.where(near, label[None, :], 2 ** 62).min(axis=1))
        if (low == label).all():
            break
        label = low
    for k, n, c in zip(at, near.sum(axis=1), label):
        links[k], comp[k] = int(n), int(c)
    return sorted(zip(ids, links, comp))


def found(df):
    fill = lambda x: -(2 ** 63) if x is None else x
    got = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    return sorted((fill(r.vec_id), r.n_links, fill(r.component_id)) for r in got)


@pytest.mark.parametrize("per_centre,shard,slice_", [(500, 2000, 16000), (60, 50, 300)])
def test_links_and_components(spark, monkeypatch, per_centre, shard, slice_):
    """Also with many small shards, parts and slices, so that groups lie across their borders."""
    monkeypatch.setattr(E, "PER_CENTRE", per_centre)
    monkeypatch.setattr(E, "SHARD", shard)
    monkeypatch.setattr(E, "SLICE", slice_)
    rows = vectors()
    got = E.near_dedup(frame(spark, rows), 0.95, recall=1.0)
    assert found(got) == all_pairs(rows, 0.95)
    assert got.first().audited_recall == 1.0


def test_the_audit_widens_the_search(spark, monkeypatch):
    """One shard and a beam of one node miss links; the audit sees it and the result is whole."""
    monkeypatch.setattr(E, "PER_CENTRE", 20)
    rows = vectors(4)
    asked = []
    monkeypatch.setattr(E, "search_all", lambda *a, whole=E.search_all: asked.append(a[-2:]) or whole(*a))
    assert found(E.near_dedup(frame(spark, rows), 0.95, probes=1, beam=1, recall=1.0)) == all_pairs(rows, 0.95)
    assert len(asked) > 1


def test_no_vectors(spark):
    assert E.near_dedup(frame(spark, [])).count() == 0
    assert found(E.near_dedup(frame(spark, [(4, None), (2, [0.0])]))) == [(2, 0, 2), (4, 0, 4)]
    assert found(E.near_dedup(frame(spark, [(4, [1.0, 2.0])]))) == [(4, 0, 4)]


def test_graph_search_reaches_all_in_range():
    rng = np.random.default_rng(0)
    v = E.unit(np.r_[rng.normal(size=(300, 16)), rng.normal(size=16) * 3 + 0.3 * rng.normal(size=(200, 16))])
    a, b = E.build(v, np.sqrt(0.1))
    starts = np.r_[0, np.cumsum(np.bincount(a, minlength=len(v)))]
    rows, nodes = E.search(v, starts, b, E.medoids_of(v, 8), v, np.full(len(v), -1), 0.95)
    want = v @ v.T >= 0.95
    assert set(zip(rows.tolist(), nodes.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want))))


def brute_whitening(rows):
    x = {k: np.floor(64 * np.array(v, "f4").astype(float)).astype("i8") + 1_000_000 for k, (_, v) in enumerate(rows)
         if v and len(v) == 12 and all(c is not None and np.isfinite(c) and abs(c) < 2.0 ** 40 for c in v)}
    points = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(points), points.sum(axis=0)
    c = (points * n - sums) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    return n, {k: ((n * p - sums) ** 2).sum() for k, p in x.items()}, {k: ((n * p - sums) / n) @ w / np.sqrt(e) for k, p in x.items()}, e / e.sum()


def test_whitening(spark):
    rows = [r for r in vectors() if r[0] != 3009]
    got = whitening.whiten(frame(spark, [*rows, (3009, [3e38] * 12)]), components=7).collect()
    n, deviation, whitened, explained = brute_whitening(rows)
    assert len(got) == 7 * len(deviation) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, set()).add((r.deviation, r.whitened, r.explained))
    signs = np.ones(7)
    for j in range(7):
        signs[j] = np.sign(next(iter(by[0][j + 1]))[1] * whitened[0][j])
    for k, (i, _) in enumerate(rows):
        if k in deviation:
            assert sorted(by[i]) == list(range(1, 8))
            for j in range(7):
                (d, w, share), = by[i][j + 1]
                assert d == deviation[k] and abs(share - explained[j]) < 1e-12
                assert abs(w * signs[j] - whitened[k][j]) < 1e-7


def test_whitening_of_flat_and_equal_tables(spark):
    rng = np.random.default_rng(1)
    flat = [(i, [float(a), float(b), float(a + b), 5.0]) for i, (a, b) in enumerate(rng.integers(0, 9, size=(200, 2)))]
    got = whitening.whiten(frame(spark, flat))
    assert {r.component for r in got.collect()} == {1, 2}
    assert got.first().identity_error < 1e-9
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])])).count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    big = [(i, [float(x), 1.0]) for i, x in enumerate((0, 2.0 ** 38, -(2.0 ** 38), 1.0))]
    got = whitening.whiten(frame(spark, big), components=1).collect()
    assert {r.vec_id: r.deviation is None for r in got}[1]


def test_solving_and_factors():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 6))
    r = whitening.cholesky(a.T @ a)
    assert np.allclose(whitening.solve_rows(a, r) @ r, a)
    assert np.allclose(whitening.solve_rows(a, r).T @ whitening.solve_rows(a, r), np.eye(6))
    assert np.isfinite(whitening.cholesky(np.zeros((3, 3)))).all()
