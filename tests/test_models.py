"""Trees, ELM, kernels, neighbours, nets — each against a NumPy reference."""

import numpy as np
import pandas as pd
import pytest

from regcast.operators import elm as ELM
from regcast.operators import kernels as K
from regcast.operators import neighbors as NB
from regcast.operators import trees as TR
from regcast.operators.models import REGISTRY


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    X = np.column_stack([rng.integers(0, 20, 120).astype(float), rng.normal(size=120)])
    y = np.where(X[:, 0] > 9.5, 5.0, 1.0) + 0.5 * X[:, 1] + rng.normal(scale=0.05, size=120)
    df = spark.createDataFrame(pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "y": y, "idx": np.arange(120)}))
    return df, X, y


def test_registry_has_all_reference_keys():
    keys = {
        "linear_regression", "ridge", "lasso", "elastic_net", "lars", "lasso_lars", "bayesian_ridge", "huber_regressor",
        "sgd_regressor", "quantile_regressor", "tweedie_regressor", "decision_tree", "extra_tree", "random_forest",
        "extra_trees", "gradient_boosting", "hist_gradient_boosting", "adaboost", "bagging", "knn", "svm", "nu_svr",
        "kernel_ridge", "gaussian_process", "mlp", "pls_regression", "elm", "xgboost", "catboost", "lightgbm",
        "voting_regressor",
    }
    assert keys == set(REGISTRY)


def _best_stump(X, y):
    best = (-np.inf, None)
    for f in range(X.shape[1]):
        v = np.unique(X[:, f])
        for a, b in zip(v[:-1], v[1:]):
            m = X[:, f] < (a + b) / 2
            g = m.sum() * y[m].mean() ** 2 + (~m).sum() * y[~m].mean() ** 2
            if g > best[0] + 1e-9:
                best = (g, (f, (a + b) / 2, y[m].mean(), y[~m].mean()))
    return best[1]


def test_decision_stump_matches_brute_force(small):
    df, X, y = small
    m = TR.decision_tree_fit(df, ["a", "b"], "y", max_depth=1, max_bins=1024)
    f, thr, lv, rv = _best_stump(X, y)
    t = m.trees[0]
    assert (t.feat[0], t.thr_val[0]) == (f, pytest.approx(thr))
    assert t.value[t.left[0]] == pytest.approx(lv) and t.value[t.right[0]] == pytest.approx(rv)


def test_full_depth_tree_fits_training_rows(small):
    df, X, y = small
    m = TR.decision_tree_fit(df, ["a", "b"], "y", max_bins=1024)
    assert np.allclose(m.predict_numpy(X), y)


def test_gradient_boosting_spark_and_numpy_scoring_agree(small):
    df, X, y = small
    m = TR.gradient_boosting_fit(df, ["a", "b"], "y", n_estimators=12)
    out = m.transform(df, "p").select("idx", "p").toPandas().sort_values("idx")
    assert np.allclose(out.p.to_numpy(), m.predict_numpy(X))
    mse0 = np.mean((y - y.mean()) ** 2)
    assert np.mean((m.predict_numpy(X) - y) ** 2) < 0.5 * mse0


def test_boosting_first_tree_is_shrunk_residual_tree(small):
    df, X, y = small
    m = TR.gradient_boosting_fit(df, ["a", "b"], "y", n_estimators=1, learning_rate=0.1, max_depth=1)
    f, thr, lv, rv = _best_stump(X, y - y.mean())
    t = m.trees[0]
    assert m.init == pytest.approx(y.mean())
    assert t.value[t.left[0]] == pytest.approx(lv)


@pytest.mark.parametrize("fit", [TR.random_forest_fit, TR.extra_trees_fit, TR.bagging_fit])
def test_forests_are_deterministic(small, fit):
    df, X, y = small
    a = fit(df, ["a", "b"], "y", n_estimators=3, max_depth=3) if fit is not TR.bagging_fit else fit(df, ["a", "b"], "y", n_estimators=3)
    b = fit(df.repartition(3), ["a", "b"], "y", n_estimators=3, max_depth=3) if fit is not TR.bagging_fit else fit(df.repartition(3), ["a", "b"], "y", n_estimators=3)
    assert np.allclose(a.predict_numpy(X), b.predict_numpy(X))


@pytest.mark.parametrize("fit,kw", [(TR.xgboost_fit, {"n_estimators": 3}), (TR.lightgbm_fit, {"n_estimators": 3}),
                                    (TR.catboost_fit, {"iterations": 3}), (TR.hist_gradient_boosting_fit, {"max_iter": 3})])
def test_boosters_reduce_training_error(small, fit, kw):
    df, X, y = small
    m = fit(df, ["a", "b"], "y", **kw)
    assert np.mean((m.predict_numpy(X) - y) ** 2) < np.mean((y - y.mean()) ** 2)


def test_catboost_trees_are_symmetric(small):
    df, X, y = small
    m = TR.catboost_fit(df, ["a", "b"], "y", iterations=2, depth=2)
    t = m.trees[0]
    inner = [i for i, f in enumerate(t.feat) if f >= 0]
    by_depth = {}
    for i in inner:
        by_depth.setdefault(t.depth[i], set()).add((t.feat[i], t.thr_bin[i]))
    assert all(len(v) == 1 for v in by_depth.values())


def test_elm_multi_output_and_reproducible(spark):
    x = np.linspace(-1, 1, 40)
    pdf = pd.DataFrame({"x": x, "y1": x ** 2, "y2": x ** 3})
    df = spark.createDataFrame(pdf)
    from regcast.operators.gram import gram_mapped, total

    W, b = ELM._draw(1, 80)
    m = total(gram_mapped(df, ["x"], ["y1", "y2"], lambda X: ELM._hidden(X, W, b, "tanh"), 80))
    S = m.uncentered()
    beta = ELM._solve(S[:80, :80], S[:80, 80:], 1e-6)
    pred = ELM._hidden(x[:, None], W, b, "tanh") @ beta
    assert np.mean((pred - np.column_stack([x ** 2, x ** 3])) ** 2) < 1e-4
    a = ELM.elm_fit(df, ["x"], "y1")
    c = ELM.elm_fit(df.repartition(3), ["x"], "y1")
    assert np.allclose(a.predict_numpy(x[:, None]), c.predict_numpy(x[:, None]))


def test_elm_hidden_layer_draw_order():
    W, b = ELM._draw(2, 3)
    rng = np.random.RandomState(42)
    assert np.array_equal(W, rng.normal(size=(2, 3))) and np.array_equal(b, rng.normal(size=3))


def test_elm_classifier_labels_and_probabilities(spark):
    df = spark.createDataFrame([(-2.0, -1.0, "negative"), (-1.5, -2.0, "negative"), (1.5, 2.0, "positive"), (2.0, 1.0, "positive")], "a double, b double, label string")
    m = ELM.elm_classifier_fit(df, ["a", "b"], "label", n_hidden=30, alpha=1e-6)
    X = np.array([[-2.0, -1.0], [-1.5, -2.0], [1.5, 2.0], [2.0, 1.0]])
    assert list(m.predict_numpy(X)) == ["negative", "negative", "positive", "positive"]
    assert np.allclose(m.predict_proba(X).sum(axis=1), 1.0)


def test_elm_rejects_bad_parameters(small):
    df, _, _ = small
    with pytest.raises(ValueError, match="n_hidden"):
        ELM.elm_fit(df, ["a"], "y", n_hidden=0)
    with pytest.raises(ValueError, match="alpha"):
        ELM.elm_fit(df, ["a"], "y", alpha=-1.0)


def test_kernel_ridge_with_all_landmarks_is_exact(small):
    df, X, y = small
    m = K.kernel_ridge_fit(df, ["a", "b"], "y", alpha=0.5, kernel="rbf", gamma=0.1, n_landmarks=10_000)
    Km = K.kernel_matrix(X, X, "rbf", 0.1)
    ref = Km @ np.linalg.solve(Km + 0.5 * np.eye(len(y)), y)
    assert np.allclose(m.predict_numpy(X), ref, atol=1e-6)


def test_knn_matches_brute_force(small, spark):
    df, X, y = small
    m = NB.knn_fit(df, ["a", "b"], "y", n_neighbors=5)
    test = spark.createDataFrame(pd.DataFrame({"a": [3.0, 15.0], "b": [0.1, -0.2]}))
    got = sorted(m.transform(test, "p").select("a", "p").collect())
    for a, p in got:
        q = np.array([a, 0.1 if a == 3.0 else -0.2])
        d = np.sqrt(((X - q) ** 2).sum(1))
        nb = np.lexsort((np.arange(len(d)), d))[:5]
        assert p == pytest.approx(y[nb].mean())


def test_ksg_mutual_information_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=150)
    yv = x + rng.normal(scale=0.5, size=150)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": yv}))
    got = NB.ksg_mi(df, "x", "y", 3)
    xs, ys = x / x.std(), yv / yv.std()
    n = len(x)
    D = np.round(np.maximum(np.abs(xs[:, None] - xs[None]), np.abs(ys[:, None] - ys[None])), 9)
    np.fill_diagonal(D, np.inf)
    r = np.sort(D, axis=1)[:, 2]
    dx = np.round(np.abs(xs[:, None] - xs[None]), 9)
    dy = np.round(np.abs(ys[:, None] - ys[None]), 9)
    np.fill_diagonal(dx, np.inf)
    np.fill_diagonal(dy, np.inf)
    nx = ((dx < r[:, None]) | (dx == 0)).sum(1)
    ny = ((dy < r[:, None]) | (dy == 0)).sum(1)
    psi = NB._digamma_int
    ref = psi(np.array([n]))[0] + psi(np.array([3]))[0] - np.mean(psi(nx + 1)) - np.mean(psi(ny + 1))
    assert got == pytest.approx(max(ref, 0.0))


def test_mlp_gradient_matches_finite_differences():
    from regcast.operators.mlp import Net

    rng = np.random.default_rng(0)
    X, y = rng.normal(size=(7, 3)), rng.normal(size=7)
    for act in ("relu", "tanh", "logistic", "identity"):
        net = Net((3, 4, 2, 1), act)
        th = net.init(1)
        f, g = net.loss_grad(X, y, th)
        e = np.zeros_like(th)
        num = []
        for i in range(th.size):
            e[:] = 0
            e[i] = 1e-6
            num.append((net.loss_grad(X, y, th + e)[0] - net.loss_grad(X, y, th - e)[0]) / 2e-6)
        assert np.allclose(g, num, atol=1e-4)


def test_early_stopping_rule_and_holdout(small):
    assert not TR._should_stop([-3.0, -2.0, -1.0], 2, 1e-7)
    assert TR._should_stop([-1.0, -1.0, -1.0], 2, 1e-7)
    df, X, y = small
    m = TR.hist_gradient_boosting_fit(df, ["a", "b"], "y", max_iter=40, early_stopping=True, n_iter_no_change=2,
                                      min_samples_leaf=5, learning_rate=0.5)
    assert m.extra["n_iter"] == len(m.trees) <= 40
    assert len(m.extra["validation_scores"]) == len(m.trees) + 1


def test_nu_svr_nu_bounds_the_fraction_outside_the_tube(spark):
    rng = np.random.default_rng(21)
    x = rng.uniform(-2, 2, 150)
    y = np.sin(x) + rng.normal(scale=0.2, size=150)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    for nu in (0.2, 0.6):
        m = K.nu_svr_fit(df, ["x"], "y", nu=nu, C=10.0, gamma=1.0, n_landmarks=150, max_iter=300)
        r = np.abs(y - m.predict_numpy(x[:, None]))
        eps = m.extra["epsilon"]
        # ν bounds the share of points outside the fitted tube (the hinge is
        # smoothed over a width δ, so points within δ of the edge are inside)
        assert np.mean(r > eps + m.extra["smoothing"]) <= nu + 0.02
        assert np.mean(r >= eps - 1e-9) >= nu - 0.1  # and (about) the share on or outside it


def test_linear_svr_matches_numpy_primal(spark):
    from regcast.operators.kernels import _smooth_eps_loss

    rng = np.random.default_rng(22)
    x = rng.normal(size=120)
    y = 2 * x + 1 + rng.normal(scale=0.3, size=120)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    m = K.svr_fit(df, ["x"], "y", kernel="linear", C=1.0, epsilon=0.1, max_iter=300)
    # the same smoothed primal, 1/2 w^2 + C * sum of the losses, minimised in NumPy
    delta = 1e-3 * y.std()

    def obj(th):
        r = y - (th[0] * x + th[1])
        loss, d, _ = _smooth_eps_loss(r, 0.1, delta)
        return 0.5 * th[0] ** 2 + loss.sum(), np.array([th[0] - np.sum(d * x), -np.sum(d)])

    from regcast.operators.optim import lbfgs

    th = lbfgs(obj, np.array([0.0, y.mean()]), max_iter=500, tol=1e-12)
    pred_ref = th[0] * x + th[1]
    assert np.allclose(m.predict_numpy(x[:, None]), pred_ref, atol=5e-3)


def _svr_objective(x, y, w, b, C, eps):
    return 0.5 * w * w + C * np.maximum(np.abs(y - w * x - b) - eps, 0).sum()


@pytest.mark.parametrize("C", [0.02, 1.0])
def test_svr_minimises_the_summed_loss(spark, C):
    """Against a fine grid over (slope, intercept) of the exact objective."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=60)
    y = 3 * x - 1 + rng.normal(scale=0.5, size=60)
    m = K.svr_fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), ["x"], "y", kernel="linear", C=C, epsilon=0.1, max_iter=300)
    got = _svr_objective(x, y, m.w[0], m.b, C, 0.1)
    grid = min(_svr_objective(x, y, w, b, C, 0.1) for w in np.linspace(0, 4, 201) for b in np.linspace(-3, 1, 201))
    assert got <= grid * 1.002 + 1e-3


def test_svr_repeated_rows_weigh_like_a_larger_c(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=40)
    y = 2 * x + rng.normal(scale=0.4, size=40)
    one = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    ten = spark.createDataFrame(pd.DataFrame({"x": np.tile(x, 10), "y": np.tile(y, 10)}))
    for fit in (K.svr_fit, K.nu_svr_fit):
        few = fit(one, ["x"], "y", kernel="linear", C=0.01, max_iter=300)
        larger = fit(one, ["x"], "y", kernel="linear", C=0.1, max_iter=300)
        more = fit(ten, ["x"], "y", kernel="linear", C=0.01, max_iter=300)
        few, larger, more = (float(m.a @ m.X[:, 0]) for m in (few, larger, more))
        assert abs(more - larger) < 0.02 and abs(more - few) > 0.1


def test_explicit_kernel_maps(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(30, 3))
    for degree, coef0 in ((2, 1.0), (3, 0.5)):
        P = K.feature_map(None, ["a", "b", "c"], "poly", 0.4, degree, coef0)(X)
        assert np.allclose(P @ P.T, K.kernel_matrix(X, X, "poly", 0.4, degree, coef0))
    Z = K.feature_map(None, ["a", "b", "c"], "rbf", 0.3, n_components=20_000)(X)
    assert np.abs(Z @ Z.T - K.kernel_matrix(X, X, "rbf", 0.3)).max() < 0.05
    with pytest.raises(ValueError, match="n_landmarks"):
        K.feature_map(None, ["a"], "sigmoid", 1.0)
