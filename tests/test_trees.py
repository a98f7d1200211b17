"""Exact trees and histogram trees against brute force, in every phase that can grow a node."""

import heapq

import numpy as np
import pandas as pd
import pytest

from regcast.operators import boosting as BO
from regcast.operators import trees as TR


def frame(spark, X, y, parts=5):
    cols = {f"f{j}": X[:, j] for j in range(X.shape[1])}
    return spark.createDataFrame(pd.DataFrame({**cols, "y": y, "idx": np.arange(len(y))})).repartition(parts)


def names(X):
    return [f"f{j}" for j in range(X.shape[1])]


def brute(X, y, w, c, spec, depth=0):
    total = w.sum()
    mean = (w * y).sum() / total
    found = []
    if y.min() != y.max() and c.sum() >= spec.min_samples_split and depth < spec.depth_cap:
        for f in range(X.shape[1]):
            v = np.unique(X[:, f])
            for a, b in zip(v[:-1], v[1:], strict=True):
                left = X[:, f] <= a
                if min(c[left].sum(), c[~left].sum()) >= spec.min_samples_leaf:
                    s, wl = (w[left] * (y[left] - mean)).sum(), w[left].sum()
                    found.append((s * s * total / (wl * (total - wl)), f, a, b))
    if not found:
        return ("leaf", mean)
    top = max(x[0] for x in found)
    f = min(x[1] for x in found if x[0] >= top * (1 - 1e-9))
    _, f, a, b = min((x for x in found if x[1] == f and x[0] >= top * (1 - 1e-9)), key=lambda x: x[2])
    left = X[:, f] <= a
    return f, (a + b) / 2, *(brute(X[m], y[m], w[m], c[m], spec, depth + 1) for m in (left, ~left))


def nested(t, i=0):
    if t.feat[i] < 0:
        return ("leaf", t.value[i])
    return int(t.feat[i]), float(t.thr_val[i]), nested(t, t.left[i]), nested(t, t.right[i])


def same(a, b):
    if "leaf" in (a[0], b[0]):
        return a[0] == b[0] and np.isclose(a[1], b[1])
    return a[0] == b[0] and np.isclose(a[1], b[1]) and same(a[2], b[2]) and same(a[3], b[3])


def data(n, p, seed=0):
    rng = np.random.default_rng(seed)
    X = np.column_stack([rng.integers(0, 7, n) if j == 0 else rng.normal(size=n) for j in range(p)]).astype(float)
    return X, np.round(rng.normal(size=n), 1) + 1000 + 2 * (X[:, 0] > 3)


@pytest.mark.parametrize("n,p,kw", [(60, 2, {}), (200, 3, {"min_samples_leaf": 5}), (150, 2, {"max_depth": 4, "min_samples_split": 10}), (300, 3, {})])
def test_grow_exact_equals_brute_force(n, p, kw):
    X, y = data(n, p)
    rng = np.random.default_rng(1)
    c = rng.integers(1, 4, n).astype(float)
    w = c * rng.uniform(0.5, 1, n)
    spec = TR.GrowSpec(**kw)
    assert same(nested(TR.grow_exact(X, y, w, c, spec)), brute(X, y, w, c, spec))


def test_a_zero_gain_split_is_taken():
    """Exclusive or: no first split helps, the second level is perfect."""
    X = np.array([[0, 0], [0, 1], [1, 0], [1, 1]] * 3, dtype=float)
    y = np.array([0, 1, 1, 0] * 3, dtype=float)
    t = TR.grow_exact(X, y, np.ones(12), np.ones(12), TR.GrowSpec())
    assert np.array_equal(t.value[TR._walk(t, X, False)], y)


@pytest.mark.parametrize("values", [[], [3.0], [2.0, 2.0, 2.0]])
def test_nothing_to_split(spark, values):
    if values:
        df = frame(spark, np.ones((len(values), 2)), np.array(values))
        assert np.allclose(TR.decision_tree_fit(df, ["f0", "f1"], "y").predict_numpy(np.zeros((2, 2))), values[0])
    t = TR.grow_exact(np.ones((4, 1)), np.array([1.0, 2.0, 3.0, 4.0]), np.ones(4), np.ones(4), TR.GrowSpec())
    assert len(t) == 1 and t.value[0] == 2.5


@pytest.mark.parametrize("value_rows", [10**6, 3])
@pytest.mark.parametrize("fit,kw", [
    (TR.decision_tree_fit, {}), (TR.decision_tree_fit, {"max_depth": 3}), (TR.extra_tree_fit, {}),
    (TR.random_forest_fit, {"n_estimators": 3}), (TR.extra_trees_fit, {"n_estimators": 2}), (TR.bagging_fit, {"n_estimators": 2, "max_samples": 0.5}),
    (TR.gradient_boosting_fit, {"n_estimators": 3}), (BO.adaboost_fit, {"n_estimators": 3}),
])
def test_jobs_and_tasks_grow_the_same_trees(spark, monkeypatch, fit, kw, value_rows):
    """Nodes of more than 60 rows by jobs over the table, with bins cut finer until 3 rows are left (or all listed)."""
    X, y = data(700, 2, seed=3)
    y[123] += 50
    df = frame(spark, X, y)
    whole = fit(df, names(X), "y", **kw)
    monkeypatch.setattr(TR, "SUBTREE_CELLS", 360)
    monkeypatch.setattr(TR, "VALUE_ROWS", value_rows)
    monkeypatch.setattr(TR, "CUTS", 7)
    split = fit(df.repartition(3), names(X), "y", **kw)
    for a, b in zip(whole.trees, split.trees, strict=True):
        assert same(nested(a), nested(b))


def test_a_single_spike_among_many_values_is_isolated(spark, monkeypatch):
    """60,000 distinct values, one row at 1000: three levels reach it (quantile edges alone predicted 4.27)."""
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60_000, 1))
    y = np.zeros(60_000)
    y[4711] = 1000.0
    df = frame(spark, X, y, 8)
    assert TR.decision_tree_fit(df, ["f0"], "y", max_depth=3).predict_numpy(X[[4711]])[0] == pytest.approx(1000.0)
    monkeypatch.setattr(TR, "SUBTREE_CELLS", 5 * 10_000)
    monkeypatch.setattr(TR, "VALUE_ROWS", 100)
    assert TR.decision_tree_fit(df, ["f0"], "y", max_depth=3).predict_numpy(X[[4711]])[0] == pytest.approx(1000.0)


def test_bounds_hold_for_every_split_inside_a_cell():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(4, 30))
        x, y, w = np.sort(rng.normal(size=n)), rng.normal(size=n) * 10 + 3, rng.uniform(0.1, 2, n)
        cuts = np.sort(rng.normal(size=2))
        b = np.searchsorted(cuts, x)
        mean, W = (w * y).sum() / w.sum(), w.sum()
        own = pd.DataFrame([{"bin": k, "w": w[m].sum(), "s": (w * y)[m].sum(), "c": m.sum(), "n": m.sum(), "y0": y[m].min(), "y1": y[m].max(), "x0": x[m].min(), "x1": x[m].max()} for k in range(3) if (m := b == k).any()])
        phase = TR._TopPhase(None, 1, TR.GrowSpec(), None, None, 0.0)
        fact = {"w": W, "c": n, "n": n, "mean": mean, "found": []}
        spans = phase.search(TR._Span(0, 0, 0, -np.inf, np.inf, cuts), own, fact)
        for s, bound in spans:
            for i in range(n - 1):
                if s.low <= x[i] and x[i + 1] <= s.high:
                    part = (w * (y - mean))[: i + 1].sum()
                    assert part**2 * W / (w[: i + 1].sum() * w[i + 1 :].sum()) <= bound


def test_finer_cuts_reach_neighbouring_doubles():
    for low, high in ((0.0, 1.0), (-1e300, 1e300), (1.0, np.nextafter(1.0, 2)), (-0.0, 5e-324), (-3.0, -2.0)):
        for _ in range(12):
            cuts = TR._finer(low, high)
            assert (cuts >= low).all() and (cuts < high).all()
            if len(cuts) == 1:
                break
            low, high = cuts[len(cuts) // 2], cuts[min(len(cuts) // 2 + 1, len(cuts) - 1)]
        assert TR._ordered_bits(high) - TR._ordered_bits(low) <= 1


@pytest.mark.parametrize("cells", [4_000_000, 360])
def test_subtrees_kept_as_a_table_score_the_same(spark, monkeypatch, cells):
    X, y = data(400, 2, seed=7)
    df = frame(spark, X, y)
    whole = TR.random_forest_fit(df, names(X), "y", n_estimators=3)
    monkeypatch.setattr(TR, "SUBTREE_CELLS", cells)
    monkeypatch.setattr(TR, "GATHER_NODES", 10)
    monkeypatch.setattr(TR, "ROWS_PER_PART", 40)  # leaves asked for by more rows are dealt over copies
    kept = TR.random_forest_fit(df, names(X), "y", n_estimators=3)
    assert kept.subtrees is not None
    got = kept.transform(df, "p").select("idx", "p", "y").orderBy("idx").toPandas()
    assert np.allclose(got["p"], whole.predict_numpy(X)) and np.array_equal(got["y"], y)
    with pytest.raises(ValueError):
        kept.to_dict()


def best_first(bins, g, h, spec, columns, offsets):
    """Splits the leaf of the largest gain until the budget is used; leaves as (rows) -> value."""
    def best(rows):
        hist = TR.histograms(bins[rows], g[rows], h[rows], np.zeros(len(rows), dtype=int), [0], offsets)
        return TR._best_splits(hist, offsets, spec, columns)[0]

    n, heap, leaves = 0, [], [np.arange(len(g))]
    first = best(leaves[0])
    if first[0] is not None:
        heap.append((-first[0], 1, leaves[0], first))
    done = {1: leaves[0]}
    while heap and len(done) < spec.max_leaf_nodes:
        _, path, rows, (_, f, b, _, _) = heapq.heappop(heap)
        del done[path]
        left = bins[rows, f] <= b
        for child, own in ((2 * path, rows[left]), (2 * path + 1, rows[~left])):
            done[child] = own
            found = best(own)
            if found[0] is not None and child.bit_length() <= spec.depth_cap:
                heapq.heappush(heap, (-found[0], child, own, found))
        n += 1
    out = np.zeros(len(g))
    for rows in done.values():
        out[rows] = -g[rows].sum() / (h[rows].sum() + spec.reg_lambda)
    return out, len(done)


@pytest.mark.parametrize("kw", [{"max_leaf_nodes": 9}, {"max_leaf_nodes": 31, "min_samples_leaf": 5}, {"max_leaf_nodes": 40, "max_depth": 4, "reg_lambda": 2.0}])
def test_leaf_budget_is_best_first(spark, kw):
    rng = np.random.default_rng(11)
    X = np.column_stack([rng.exponential(size=500), rng.normal(size=500), rng.integers(0, 5, 500)])
    y = np.exp(X[:, 0]) + X[:, 2] * (X[:, 1] > 0.5) + rng.normal(scale=0.1, size=500)
    df = frame(spark, X, y)
    spec = TR.GrowSpec(policy="leaves", **kw)
    rows, edges, n = TR._rows(df, names(X), "y", True, 255)
    local = rows.orderBy("_rid").toPandas()
    bins = local[["b0", "b1", "b2"]].to_numpy().astype(np.int64)
    want, leaves = best_first(bins, -local["_y"].to_numpy(), np.ones(n), spec, [0, 1, 2], TR._offsets(edges))
    grad = lambda b: (-TR._col(b, "_y"), np.ones(b.num_rows))
    in_task = TR._rounds_in_task(rows.selectExpr("*", "0d as _F"), 3, edges, spec, 1.0, [0], True)[0]
    by_jobs = TR._hist_tree(rows, edges, spec, grad, 0)
    for tree in (in_task, by_jobs):
        assert (tree.feat < 0).sum() == leaves <= kw["max_leaf_nodes"]
        assert np.allclose(tree.value[TR._walk(tree, bins, True)], want)


@pytest.mark.parametrize("fit,kw", [
    (TR.lightgbm_fit, {"n_estimators": 3, "num_leaves": 5, "min_child_samples": 5, "colsample_bytree": 0.5}),
    (TR.catboost_fit, {"iterations": 3, "depth": 3}), (TR.xgboost_fit, {"n_estimators": 3, "max_depth": 3}), (TR.hist_gradient_boosting_fit, {"max_iter": 2, "early_stopping": False}),
])
def test_histograms_by_jobs_and_in_a_task_agree(spark, monkeypatch, fit, kw):
    X, y = data(300, 2, seed=9)
    df = frame(spark, X, y)
    whole = fit(df, names(X), "y", **kw)
    monkeypatch.setattr(TR, "SUBTREE_CELLS", 0)
    jobs = fit(df.repartition(2), names(X), "y", **kw)
    assert np.allclose(whole.predict_numpy(X), jobs.predict_numpy(X))


def test_a_forest_at_its_defaults_is_grown_in_two_jobs(spark):
    """100 unlimited trees: no job per level."""
    X, y = data(3000, 3, seed=13)
    df = frame(spark, X, y)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("forest", "forest")
    m = TR.random_forest_fit(df, names(X), "y")
    jobs = len(tracker.getJobIdsForGroup("forest"))
    spark.sparkContext.setJobGroup("", "")
    assert len(m.trees) == 100 and max(t.depth.max() for t in m.trees) > 12 and jobs <= 6
    assert np.corrcoef(m.predict_numpy(X), y)[0, 1] > 0.9
