"""Regressor registry: key → (fit function, default parameters).

Every fit takes ``(df, features, target, **params)`` where ``features`` are
already-encoded double columns, and returns a model exposing
``transform(df, output)`` (a projection, or a broadcast-model Arrow map for
non-linear models) plus ``to_dict()`` for persistence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import linear as L


@dataclass(frozen=True)
class ModelDefinition:
    key: str
    label: str
    fit: Callable
    defaults: dict


def _g1(solver):
    def fit(df: DataFrame, features, target, **params):
        return solver(L.moments_of(df, features, target), features, **params)

    return fit


def _lasso(m, features, alpha=1.0, max_iter=1000, tol=1e-4):
    return L.enet_from_moments(m, features, alpha=alpha, l1_ratio=1.0, max_iter=max_iter, tol=tol)


def _lars(m, features, n_nonzero_coefs=500):
    return L.lars_from_moments(m, features, n_nonzero_coefs=n_nonzero_coefs)


def _lasso_lars(m, features, alpha=1.0):
    return L.lars_from_moments(m, features, alpha=alpha)


def _sgd(df, features, target, loss="squared_error", alpha=1e-4, penalty="l2", **kw):
    return L.sgd_objective_fit(df, features, target, loss=loss, penalty=penalty, alpha=alpha, **kw)


def _kernel_ridge(df, features, target, alpha=1.0, kernel="linear", **kw):
    if kernel == "linear":
        return L.kernel_ridge_linear_from_moments(L.moments_of(df, features, target), features, alpha=alpha)
    from .kernels import kernel_ridge_fit

    return kernel_ridge_fit(df, features, target, alpha=alpha, kernel=kernel, **kw)


def _lazy(module: str, name: str):
    def fit(df, features, target, **params):
        import importlib

        mod = importlib.import_module(f"regcast.operators.{module}")
        return getattr(mod, name)(df, features, target, **params)

    return fit


# Registry keys, labels and default parameters.
REGISTRY: dict[str, ModelDefinition] = {
    d.key: d
    for d in [
        ModelDefinition("linear_regression", "Linear Regression", _g1(L.ols_from_moments), {}),
        ModelDefinition("ridge", "Ridge Regression", _g1(L.ridge_from_moments), {"alpha": 1.0}),
        ModelDefinition("lasso", "Lasso Regression", _g1(_lasso), {"alpha": 1.0}),
        ModelDefinition("elastic_net", "Elastic Net", _g1(L.enet_from_moments), {"alpha": 1.0, "l1_ratio": 0.5}),
        ModelDefinition("lars", "Least Angle Regression", _g1(_lars), {"n_nonzero_coefs": 500}),
        ModelDefinition("lasso_lars", "Lasso Lars", _g1(_lasso_lars), {"alpha": 1.0}),
        ModelDefinition("bayesian_ridge", "Bayesian Ridge", _g1(L.bayesian_ridge_from_moments), {"max_iter": 300}),
        ModelDefinition("huber_regressor", "Huber Regressor", L.huber_fit, {"epsilon": 1.35, "alpha": 1e-4}),
        ModelDefinition("sgd_regressor", "SGD Regressor", _sgd, {"loss": "squared_error", "alpha": 1e-4, "penalty": "l2"}),
        ModelDefinition("quantile_regressor", "Quantile Regressor", L.quantile_fit, {"quantile": 0.5, "alpha": 1.0}),
        ModelDefinition("tweedie_regressor", "Tweedie Regressor", L.tweedie_fit, {"power": 0.0, "alpha": 1.0}),
        ModelDefinition("pls_regression", "Partial Least Squares Regressor", _g1(L.pls_from_moments), {"n_components": 1}),
        ModelDefinition("kernel_ridge", "Kernel Ridge Regressor", _kernel_ridge, {"alpha": 1.0, "kernel": "linear"}),
        ModelDefinition("elm", "Extreme Learning Machine Regressor", _lazy("elm", "elm_fit"), {"n_hidden": 100, "activation": "tanh", "alpha": 1e-3}),
        ModelDefinition("decision_tree", "Decision Tree Regressor", _lazy("trees", "decision_tree_fit"), {"max_depth": None, "min_samples_split": 2}),
        ModelDefinition("random_forest", "Random Forest Regressor", _lazy("trees", "random_forest_fit"), {"n_estimators": 100, "max_depth": None, "min_samples_split": 2}),
        ModelDefinition("bagging", "Bagging Regressor", _lazy("trees", "bagging_fit"), {"n_estimators": 10, "max_samples": 1.0}),
        ModelDefinition("gradient_boosting", "Gradient Boosting Regressor", _lazy("trees", "gradient_boosting_fit"), {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3}),
        ModelDefinition("extra_tree", "Extra Tree Regressor", _lazy("trees", "extra_tree_fit"), {"max_depth": None, "min_samples_split": 2}),
        ModelDefinition("extra_trees", "Extra Trees Regressor", _lazy("trees", "extra_trees_fit"), {"n_estimators": 100, "max_depth": None, "min_samples_split": 2}),
        ModelDefinition("hist_gradient_boosting", "Histogram Gradient Boosting Regressor", _lazy("trees", "hist_gradient_boosting_fit"), {"max_iter": 100, "learning_rate": 0.1, "max_leaf_nodes": 31}),
        ModelDefinition("xgboost", "XGBoost Regressor", _lazy("trees", "xgboost_fit"), {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3}),
        ModelDefinition("lightgbm", "LightGBM Regressor", _lazy("trees", "lightgbm_fit"), {"n_estimators": 100, "learning_rate": 0.1, "max_depth": -1, "num_leaves": 31, "subsample": 1.0, "colsample_bytree": 1.0}),
        ModelDefinition("catboost", "CatBoost Regressor", _lazy("trees", "catboost_fit"), {"iterations": 500, "depth": 6, "learning_rate": 0.03}),
        ModelDefinition("knn", "K-Neighbors Regressor", _lazy("neighbors", "knn_fit"), {"n_neighbors": 5, "weights": "uniform"}),
        ModelDefinition("adaboost", "AdaBoost Regressor", _lazy("boosting", "adaboost_fit"), {"n_estimators": 50, "learning_rate": 1.0, "loss": "linear"}),
        ModelDefinition("svm", "Support Vector Regressor", _lazy("kernels", "svr_fit"), {"kernel": "rbf", "C": 1.0, "epsilon": 0.1, "degree": 3, "gamma": "scale", "coef0": 0.0}),
        ModelDefinition("nu_svr", "Nu Support Vector Regressor", _lazy("kernels", "nu_svr_fit"), {"nu": 0.5, "C": 1.0, "kernel": "rbf"}),
        ModelDefinition("gaussian_process", "Gaussian Process Regressor", _lazy("kernels", "gaussian_process_fit"), {"alpha": 1e-10}),
        ModelDefinition("mlp", "Multi-layer Perceptron Regressor", _lazy("mlp", "mlp_fit"), {"hidden_layer_sizes": "100", "activation": "relu", "alpha": 1e-4, "max_iter": 200}),
    ]
}


def _voting(df, features, target, estimators=None, **params):
    """Plain mean of the member regressors (all 30 by default); member
    parameters use nested ``<key>__<param>`` names."""
    from .voting import voting_fit

    return voting_fit(df, features, target, estimators=estimators, **params)


REGISTRY["voting_regressor"] = ModelDefinition("voting_regressor", "Voting Regressor", _voting, {})
VOTING_MEMBERS = [k for k in REGISTRY if k != "voting_regressor"]


def get_definition(key: str) -> ModelDefinition:
    if key not in REGISTRY:
        raise ValueError(f"Unknown model: {key}")
    return REGISTRY[key]


def fit_model(key: str, df: DataFrame, features, target: str, params: dict | None = None):
    d = get_definition(key)
    merged = {**d.defaults, **(params or {})}
    return d.fit(df, list(features), target, **merged)


def model_from_dict(d: dict):
    kind = d["kind"]
    if kind == "linear":
        return L.LinearModel.from_dict(d)
    import importlib

    module, cls = d["class"].rsplit(".", 1)
    return getattr(importlib.import_module(module), cls).from_dict(d)
