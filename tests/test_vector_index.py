"""The pruned vector index against a comparison of all pairs."""

import math

import numpy as np
import pytest

from fidelis.operators import similarity as S
from fidelis.operators import vector_index as X


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id long, v array<double>").repartition(3)


def brute(cand, ref, k):
    """{candidate id: [(rank, id, similarity)]} over all pairs, ties by id."""
    def unit(v):
        m = np.nan_to_num(np.array([0.0 if x is None else x for x in (v or [0.0] * 3)], float))
        n = np.linalg.norm(m)
        return m / n if n else m
    out = {}
    for i, v in cand:
        sims = sorted(((-round(float(unit(v) @ unit(w)), 10) + 0.0, j) for j, w in ref))
        out.setdefault(i, []).append([(r + 1, j, -s) for r, (s, j) in enumerate(sims[:k])])
    return out


def points(rng, n, d, scale=0.25):
    centres = rng.normal(size=(6, d))
    return centres[rng.integers(0, 6, n)] + scale * rng.normal(size=(n, d))


@pytest.mark.parametrize("k", [1, 3])
def test_search_equals_brute_force(spark, k):
    rng = np.random.default_rng(2)
    ref = [(1000 + i, v) for i, v in enumerate(points(rng, 700, 3).tolist())]
    ref += [(3000 + i, ref[5][1]) for i in range(40)] + [(4000 + i, [0.0] * 3) for i in range(3)] + [(4100, None), (4101, [float("nan")] * 3), (4102, [1.0, None, 0.0])]
    cand = [(i, v) for i, v in enumerate(points(rng, 150, 3).tolist())] + [(500, [0.0] * 3), (501, None), (502, ref[5][1]), (503, [-x for x in ref[0][1]]), (7, [1.0, 2.0, 3.0])]
    index = X.build_index(frame(spark, ref), "id", "v", cell_rows=20)
    assert len(index.cells.cell) > 20
    found, work = X.search(index, frame(spark, cand), "id", "v", k, block_rows=16)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append((r.rank, r.rid, round(r.similarity, 10) + 0.0))
    want = {i: [x for one in sorted(v) for x in one] for i, v in brute(cand, ref, k).items()}
    assert set(got) == set(want)
    for i in want:
        a, b = sorted(got[i]), sorted((r, j, s + 0.0) for r, j, s in want[i])
        assert [(r, j) for r, j, _ in a] == [(r, j) for r, j, _ in b], i
        assert [s for *_, s in a] == pytest.approx([s for *_, s in b], abs=1e-9)
    assert work["candidates"] == len(cand) and work["rows"] == len(ref) and work["compared"] < 0.6 * len(cand) * work["vectors"]


def test_many_neighbours(spark):
    """More neighbours than ids are kept by default, among copies of one vector."""
    ref = [(i, [1.0, 0.1 * (i % 4)]) for i in range(200)]
    got = S.nn_search(frame(spark, [(0, [1.0, 0.0])]), frame(spark, ref), "id", "id", "v", k=60, cell_rows=2).collect()
    assert [r.ref_id for r in sorted(got, key=lambda r: r["rank"])] == [j for _, j, _ in brute([(0, [1.0, 0.0])], ref, 60)[0][0]]


def test_opposite_vectors_and_few_rows(spark):
    ref, cand = [(1, [1.0, 0.0]), (2, [0.0, 0.0])], [(9, [-1.0, 0.0])]
    index = X.build_index(frame(spark, ref), "id", "v")
    found, _ = X.search(index, frame(spark, cand), "id", "v", 3)
    assert [(r.rank, r.rid, r.similarity) for r in sorted(found.collect(), key=lambda r: r.rank)] == [(1, 2, 0.0), (2, 1, -1.0)]


def test_rings_of_a_hot_pivot(spark):
    """Nearly all rows lie around one direction; few pivots, so the rings do the pruning."""
    rng = np.random.default_rng(3)
    ref = [(i, [1.0, *(0.02 * rng.normal(size=3))]) for i in range(600)]
    cand = [(i, [1.0, *(0.02 * rng.normal(size=3))]) for i in range(60)]
    index = X.build_index(frame(spark, ref), "id", "v", cell_rows=25, most_pivots=2)
    assert len(index.cells.pivots) == 2 and len(index.cells.cell) >= 10
    found, work = X.search(index, frame(spark, cand), "id", "v", 2, block_rows=10)
    want = brute(cand, ref, 2)
    for r in found.collect():
        assert r.similarity == pytest.approx(want[r.id][0][r.rank - 1][2], abs=1e-9)
    assert work["compared"] < len(ref) * len(cand)


def test_an_index_is_read_again(spark, tmp_path):
    rng = np.random.default_rng(4)
    ref, cand = list(enumerate(points(rng, 200, 4).tolist())), list(enumerate(points(rng, 30, 4).tolist()))
    built = X.build_index(frame(spark, ref), "id", "v", path=str(tmp_path / "index"), cell_rows=10)
    read = X.load_index(spark, str(tmp_path / "index"))
    a, b = (sorted(map(tuple, X.search(x, frame(spark, cand), "id", "v", 2)[0].collect())) for x in (built, read))
    assert a == b and len(a) == 60


def test_bound_never_leaves_out_a_nearer_row():
    rng = np.random.default_rng(5)
    for _ in range(30):
        d = int(rng.integers(2, 7))
        u = rng.normal(size=(200, d))
        u /= np.linalg.norm(u, axis=1)[:, None]
        pivots = u[:5]
        angle = X._angles(u, pivots)
        near = angle.argmin(1)
        own = angle[np.arange(200), near]
        inner = {p: np.quantile(own[near == p], [0.5]) for p in range(5) if (near == p).sum() > 3}
        cell = X.cells_of(near, own, inner)
        names = np.unique(cell)
        cells = X.Cells(pivots, names, np.array([own[cell == c].min() for c in names]), np.array([own[cell == c].max() for c in names]), np.array([(cell == c).sum() for c in names]), inner)
        q = rng.normal(size=(20, d))
        q /= np.linalg.norm(q, axis=1)[:, None]
        sims = q @ u.T
        kth = np.sort(sims, axis=1)[:, -3]
        reach = X._reach(cells, q, kth)
        for i in range(20):
            needed = set(cell[sims[i] >= kth[i]].tolist())
            assert needed <= set(names[reach[i]].tolist())


def test_empty_sides(spark):
    some, none = frame(spark, [(1, [1.0, 0.0])]), spark.createDataFrame([], "id long, v array<double>")
    assert [tuple(r) for r in S.nn_search(some, none, "id", "id", "v").collect()] == [(1, 1, None, 0.0)]
    assert S.nn_search(none, some, "id", "id", "v").count() == 0
    assert S.nn_search(none, none, "id", "id", "v").count() == 0
    with pytest.raises(ValueError):
        X.search(X.build_index(some, "id", "v"), some, "id", "v", 1000)
    assert math.isclose(S.nn_search(some, some, "id", "id", "v").first().similarity, 1.0)


def test_a_block_compares_few_of_its_pairs(monkeypatch):
    """The best in a block are those of all pairs, and eight times the vectors ask for hardly more comparisons."""
    rng = np.random.default_rng(6)
    pairs = []
    for n in (2000, 16000):
        v, c = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(n, 4)), rng.normal(size=(500, 4))))
        v[7] = v[3]
        c[0] = v[3]
        for k in (1, 3):
            sizes = []
            real = np.partition
            monkeypatch.setattr(X.np, "partition", lambda a, *args, **kw: (sizes.append(a.size), real(a, *args, **kw))[1])
            who, which, sims = X.nearest_in_block(c, np.full(len(c), -1.0), v, k)
            monkeypatch.undo()
            all_pairs = c @ v.T
            last = np.sort(all_pairs, axis=1)[:, -k]
            assert set(zip(who.tolist(), which.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(all_pairs >= last[:, None] - 1e-12))))
            assert sims == pytest.approx(all_pairs[who, which])
            pairs.append(sum(sizes))
    assert pairs[2] < 2 * pairs[0] and pairs[2] < 0.1 * 500 * 16000


def test_candidates_of_a_pivot_rule_out_pivots_together():
    """The joint bound leaves no needed cell out, whatever pivot a candidate is said to be near, and reaches few others."""
    rng = np.random.default_rng(11)
    u = points(rng, 4000, 4)
    u /= np.linalg.norm(u, axis=1)[:, None]
    pivots = u[:200]
    near, own = X._nearest(u, pivots)
    inner = {p: np.quantile(own[near == p], [0.5]) for p in range(200) if (near == p).sum() > 8}
    cell = X.cells_of(near, own, inner)
    names = np.unique(cell)
    cells = X.Cells(pivots, names, np.array([own[cell == c].min() for c in names]), np.array([own[cell == c].max() for c in names]), np.array([(cell == c).sum() for c in names]), inner)
    sims = u[-600:] @ u[:3400].T
    kth = np.sort(sims, axis=1)[:, -2]
    kth[::50] = -1.0
    nearest = X._nearest(u[-600:], pivots)[0]
    for home in (nearest, rng.integers(0, 200, 600)):
        row, at = X._reached(cells, home, u[-600:], kth)
        got = set(zip(row.tolist(), names[at].tolist()))
        assert len(got) == len(row)
        assert {(int(i), int(cell[j])) for i, j in zip(*np.nonzero(sims >= kth[:, None]))} <= got
        if home is nearest:
            assert sum(kth[i] > -1.0 for i, _ in got) < 0.2 * len(names) * 588


def test_equal_vectors_are_sorted_by_a_number_first(spark):
    """Distinct vectors with their smallest ids, a zero of either sign included; the sort compares arrays only after a hash of them."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.integers(0, 3, (400, 2)))] + [(1000, [-0.0, 1.0]), (1001, [0.0, 1.0]), (1001, [2.0, 7.0])]
    want = {}
    for i, v in rows:
        want.setdefault(tuple(x + 0.0 for x in v), []).append(i)
    units = spark.createDataFrame(rows, "id long, u array<double>").repartition(3)
    out = X._equal(units, 4)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    sorts = [line.split("Sort [", 1)[1] for line in plan.split("\n") if "Sort [" in line]
    assert sorts and all(s.startswith("h#") for s in sorts)
    found = [(tuple(x + 0.0 for x in r["u"]), r["ids"][:4]) for r in out.collect()]
    assert len(found) == len(want) and dict(found) == {v: sorted(i)[:4] for v, i in want.items()}


def test_a_search_leaves_only_its_answers(spark, tmp_path, monkeypatch):
    """No copy of the vectors stays on the disk, and the answers need no further shuffle."""
    for module in (X, S):
        if hasattr(module, "checkpoint_dir"):
            monkeypatch.setattr(module, "checkpoint_dir", lambda _: str(tmp_path))
    rng = np.random.default_rng(7)
    ref, cand = list(enumerate(points(rng, 300, 4).tolist())), list(enumerate(points(rng, 100, 4).tolist()))
    found = S.nn_search(frame(spark, cand), frame(spark, ref), "id", "id", "v", k=2, cell_rows=20)
    assert found.count() == 200
    names = [p.name for p in tmp_path.iterdir()]
    assert len(names) == 1 and names[0].startswith("search-")
    assert "Exchange" not in found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")


def test_equal_vectors_are_shuffled_once_and_joined_before(spark):
    """A vector that nearly all rows share leaves each task as one row."""
    units = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(2000)] + [(None, [1.0, 2.0]), (5, [0.5, 0.5])], "id long, u array<double>").repartition(4)
    out = X._equal(units, 3)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning(u#") == 1 and "Window" not in plan
    assert sorted((r["u"], r["ids"], r["nulls"]) for r in out.collect()) == [([0.5, 0.5], [5], 0), ([1.0, 2.0], [0, 1, 2], 1)]


def test_rows_without_an_id(spark):
    """They come first among the neighbours of a zero vector, and a vector's ids leave them out."""
    ref = spark.createDataFrame([(None, [0.0, 0.0]), (4, [0.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0])], "id long, v array<double>")
    index = X.build_index(ref, "id", "v", keep=3)
    assert index.smallest == [None, None, 4] and index.zeros == [None, 4] and index.n_rows == 4
    found, _ = X.search(index, frame(spark, [(1, [2.0, 0.0]), (2, [0.0, 0.0])]), "id", "v", 2)
    assert sorted((r.id, r["rank"], r.rid, r.similarity) for r in found.collect()) == [(1, 1, 9, 1.0), (1, 2, None, 0.0), (2, 1, None, 0.0), (2, 2, None, 0.0)]


def test_candidates_of_a_hot_cell_go_to_several_tasks(spark, monkeypatch):
    """Nearly all candidates fall into one cell: they are dealt over the tasks, and all are answered."""
    monkeypatch.setattr(X, "TASK_ROWS", 16)
    rng = np.random.default_rng(8)
    ref = list(enumerate(points(rng, 200, 3).tolist()))
    cand = [(i, [x + 1e-3 * rng.normal() for x in ref[0][1]]) for i in range(400)] + [(1000 + i, v) for i, v in enumerate(points(rng, 20, 3).tolist())]
    found, _ = X.search(X.build_index(frame(spark, ref), "id", "v", cell_rows=20), frame(spark, cand), "id", "v")
    want = brute(cand, ref, 1)
    assert {r.id: r.rid for r in found.collect()} == {i: w[0][0][1] for i, w in want.items()}
    assert len(found.inputFiles()) >= 6
