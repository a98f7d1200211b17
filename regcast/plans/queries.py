"""Registered queries: one per operator, each over WHOLE driver tables.

Every entry is ``(spark, sf_dir) -> DataFrame`` plus (where SQL can express
it) the DuckDB SQL computing the same values.  Doubles are rounded on both
sides; every output column is aliased to the same name on both sides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks, profile
from ..functions.metrics import long_form, metrics_frame
from ..operators import autocorr, sampling
from ..operators.encoders import Preprocessor, Scaler
from ..operators.lags import lookback_features, windows
from ..operators.linear import moments_of, ols_from_moments
from ..operators.recursive import ar_forecast
from ..operators.rowindex import with_row_index
from ..sources import tables
from ..sources.tables import load
from .config import PipelineConfig, TrainingConfig, ValidationConfig
from . import workflows as W

D = 6  # rounding digits for values of table scale
DS = 8  # rounding digits for standardised values

PART_FEATURES = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
ORDERS_ORDER = ["o_orderdate", "o_orderkey"]
EVENTS_ORDER = ["ts", "event_id"]


def r(c, d=D):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


# --------------------------------------------------------------- profiling


def q_profile_plan(spark: SparkSession, sf: str) -> DataFrame:
    return profile.preprocessing_plan(load(spark, sf, "part"), PART_FEATURES)


def q_encoded_feature_count(spark, sf):
    return profile.transformed_feature_count(q_profile_plan(spark, sf))


def q_plan_override(spark, sf):
    plan = q_profile_plan(spark, sf)
    return profile.override_plan(plan, {"p_brand": profile.ONE_HOT}, scaling=profile.MIN_MAX)


_PROFILE_SQL_CTE = """WITH u AS (SELECT
  count(DISTINCT p_name) + max(CASE WHEN p_name IS NULL THEN 1 ELSE 0 END) AS u_name,
  count(DISTINCT p_brand) + max(CASE WHEN p_brand IS NULL THEN 1 ELSE 0 END) AS u_brand,
  count(DISTINCT p_type) + max(CASE WHEN p_type IS NULL THEN 1 ELSE 0 END) AS u_type,
  count(DISTINCT p_size) + max(CASE WHEN p_size IS NULL THEN 1 ELSE 0 END) AS u_size,
  count(DISTINCT p_retailprice) + max(CASE WHEN p_retailprice IS NULL THEN 1 ELSE 0 END) AS u_price
  FROM part)"""


def _profile_sql(brand_step=None, numeric_step="'StandardScaler'") -> str:
    def string_row(name, u):
        step = "CASE WHEN {u} > 10 THEN 'OrdinalEncoder' ELSE 'OneHotEncoder' END".format(u=u)
        if name == "p_brand" and brand_step:
            step = brand_step
        return f"SELECT '{name}' AS \"Variable\", 'String' AS \"Type\", CAST({u} AS BIGINT) AS \"Unique Count\", {step} AS \"Preprocessing\" FROM u"

    def num_row(name, u):
        return f"SELECT '{name}' AS \"Variable\", 'Numeric' AS \"Type\", CAST({u} AS BIGINT) AS \"Unique Count\", {numeric_step} AS \"Preprocessing\" FROM u"

    rows = [
        string_row("p_name", "u_name"),
        string_row("p_brand", "u_brand"),
        string_row("p_type", "u_type"),
        num_row("p_size", "u_size"),
        num_row("p_retailprice", "u_price"),
    ]
    return _PROFILE_SQL_CTE + "\n" + "\nUNION ALL\n".join(rows)


SQL_PROFILE_PLAN = _profile_sql()
SQL_ENCODED_FEATURE_COUNT = (
    _PROFILE_SQL_CTE
    + """
SELECT CAST((CASE WHEN u_name > 10 THEN 1 ELSE u_name END)
          + (CASE WHEN u_brand > 10 THEN 1 ELSE u_brand END)
          + (CASE WHEN u_type > 10 THEN 1 ELSE u_type END) + 1 + 1 AS BIGINT) AS encoded_features FROM u"""
)
SQL_PLAN_OVERRIDE = _profile_sql(brand_step="'OneHotEncoder'", numeric_step="'MinMaxScaler'")


# ------------------------------------------------------------------ checks

LINEITEM_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def q_null_check(spark, sf):
    return checks.null_count_table(load(spark, sf, "lineitem"), LINEITEM_COLS)


SQL_NULL_CHECK = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM lineitem" for c in LINEITEM_COLS
)


def q_series_check(spark, sf):
    return checks.series_summary(load(spark, sf, "events"), "value")


SQL_SERIES_CHECK = """SELECT CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) - count(value) AS BIGINT) AS nulls,
  CAST(count(*) FILTER (WHERE isnan(value) OR isinf(value)) AS BIGINT) AS non_finite
FROM events"""


# ---------------------------------------------------------------- encoders


def _part_plan(spark, sf, steps):
    part = load(spark, sf, "part")
    plan = [(v, t, s, u) for v, t, s, u in profile.plan_steps(profile.preprocessing_plan(part, [v for v, _ in steps]))]
    wanted = dict(steps)
    return part, [(v, t, wanted[v], u) for v, t, _, u in plan]


def q_encode_onehot(spark, sf):
    part, plan = _part_plan(spark, sf, [("p_type", profile.ONE_HOT)])
    pre = Preprocessor.fit(part, plan)
    return pre.transform(part, keep=["p_partkey"])


P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]  # fixed values of the test data
SQL_ENCODE_ONEHOT = "SELECT p_partkey, " + ", ".join(
    f"CAST(p_type = '{v}' AS DOUBLE) AS p_type_{v}" for v in P_TYPES
) + " FROM part"


def q_encode_ordinal(spark, sf):
    part, plan = _part_plan(spark, sf, [("p_brand", profile.ORDINAL)])
    return Preprocessor.fit(part, plan).transform(part, keep=["p_partkey"])


SQL_ENCODE_ORDINAL = "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS p_brand FROM part"


def _scaled(spark, sf, step):
    part, plan = _part_plan(spark, sf, [("p_size", step), ("p_retailprice", step)])
    out = Preprocessor.fit(part, plan).transform(part, keep=["p_partkey"])
    return out.select("p_partkey", r("p_size", DS).alias("p_size"), r("p_retailprice", DS).alias("p_retailprice"))


def q_scale_standard(spark, sf):
    return _scaled(spark, sf, profile.STANDARD)


def q_scale_minmax(spark, sf):
    return _scaled(spark, sf, profile.MIN_MAX)


def _std_sql(c):
    return (
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 "
        f"ELSE stddev_pop({c}) OVER () END, {DS}) AS {c}"
    )


def _mm_sql(c):
    return (
        f"round(({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1 "
        f"ELSE max({c}) OVER () - min({c}) OVER () END, {DS}) AS {c}"
    )


SQL_SCALE_STANDARD = f"SELECT p_partkey, {_std_sql('p_size')}, {_std_sql('p_retailprice')} FROM part"
SQL_SCALE_MINMAX = f"SELECT p_partkey, {_mm_sql('p_size')}, {_mm_sql('p_retailprice')} FROM part"


def q_encoded_frame(spark, sf):
    """The default plan's full encoded frame (one-hot, ordinal, standard)."""
    part = load(spark, sf, "part")
    feats = ["p_brand", "p_type", "p_size", "p_retailprice"]
    pre = Preprocessor.fit(part, profile.preprocessing_plan(part, feats), feats)
    out = pre.transform(part, keep=["p_partkey"])
    return out.select(*[r(c, DS).alias(c) if c != "p_partkey" else F.col(c) for c in out.columns])


SQL_ENCODED_FRAME = (
    "SELECT p_partkey, "
    + ", ".join(f"round(CAST(p_type = '{v}' AS DOUBLE), {DS}) AS p_type_{v}" for v in P_TYPES)
    + f", round(CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE), {DS}) AS p_brand, "
    + _std_sql("p_size")
    + ", "
    + _std_sql("p_retailprice")
    + " FROM part"
)


def q_target_scaling(spark, sf):
    """Min-max target scaling and its inverse."""
    orders = load(spark, sf, "orders")
    sc = Scaler.fit(orders, "o_totalprice", profile.MIN_MAX)
    scaled = orders.select("o_orderkey", sc.apply("o_totalprice").alias("scaled"))
    return scaled.select("o_orderkey", r("scaled", DS).alias("scaled"), r(sc.invert(F.col("scaled")), 4).alias("restored"))


SQL_TARGET_SCALING = f"""WITH s AS (SELECT o_orderkey, (o_totalprice - min(o_totalprice) OVER ())
    / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) AS scaled, o_totalprice FROM orders)
SELECT o_orderkey, round(scaled, {DS}) AS scaled, round(o_totalprice, 4) AS restored FROM s"""


# --------------------------------------------------------- order and splits


def _orders_ix(spark, sf):
    return with_row_index(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ORDERS_ORDER)


def q_row_index(spark, sf):
    return _orders_ix(spark, sf).df.select("o_orderkey", "idx")


SQL_ROW_INDEX = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders"

_ORD_RN = "WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)"
_HASH_RN = (
    "WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '|42')), o_orderkey) - 1 AS rn, "
    "count(*) OVER () AS n FROM orders)"
)


def q_last_percent(spark, sf):
    return sampling.last_percent(_orders_ix(spark, sf), 30).df.select("o_orderkey", "idx")


SQL_LAST_PERCENT = _ORD_RN + """
SELECT o_orderkey, rn - (n - greatest(1, (n * 30 + 99) // 100)) AS idx FROM s
WHERE rn >= n - greatest(1, (n * 30 + 99) // 100)"""


def q_random_percent(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey")
    return sampling.random_percent(orders, "o_orderkey", 20).df.select("o_orderkey", "idx")


SQL_RANDOM_PERCENT = _HASH_RN + """
SELECT o_orderkey, rn AS idx FROM s WHERE rn < greatest(1, (n * 20 + 99) // 100)"""


def q_random_split(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey")
    train, test = sampling.random_split(orders, "o_orderkey", 25, indexed=False)
    return train.df.select("o_orderkey", F.lit("train").alias("split")).unionByName(
        test.df.select("o_orderkey", F.lit("test").alias("split"))
    )


SQL_RANDOM_SPLIT = _HASH_RN + """
SELECT o_orderkey, CASE WHEN rn < (n * 25 + 99) // 100 THEN 'test' ELSE 'train' END AS split FROM s"""


def q_last_split(spark, sf):
    train, val = sampling.last_split(_orders_ix(spark, sf), 20)
    return train.df.select("o_orderkey", F.lit("train").alias("split")).unionByName(
        val.df.select("o_orderkey", F.lit("test").alias("split"))
    )


SQL_LAST_SPLIT = _ORD_RN + """
SELECT o_orderkey, CASE WHEN rn >= n - greatest(1, (n * 20 + 99) // 100) THEN 'test' ELSE 'train' END AS split FROM s"""


def _fold_sql(k: int) -> str:
    return f"""CAST(CASE WHEN rn < (n % {k}) * (n // {k} + 1) THEN rn // (n // {k} + 1)
  ELSE (n % {k}) + (rn - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS INTEGER) AS fold"""


def q_kfold_random(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey")
    return sampling.kfold_random(orders, "o_orderkey", 7, indexed=False).df.select("o_orderkey", "fold")


SQL_KFOLD_RANDOM = _HASH_RN + f"\nSELECT o_orderkey, {_fold_sql(7)} FROM s"


def q_kfold_contiguous(spark, sf):
    return sampling.kfold_contiguous(_orders_ix(spark, sf), 7).df.select("o_orderkey", "fold")


SQL_KFOLD_CONTIGUOUS = _ORD_RN + f"\nSELECT o_orderkey, {_fold_sql(7)} FROM s"


def q_expanding_folds(spark, sf):
    ix = sampling.expanding_folds(_orders_ix(spark, sf), 4)
    return ix.df.where(F.col("fold").isNotNull()).select("o_orderkey", "fold")


SQL_EXPANDING_FOLDS = _ORD_RN + """
SELECT o_orderkey, CAST((rn - (n - 4 * (n // 5))) // (n // 5) AS INTEGER) AS fold FROM s
WHERE rn >= n - 4 * (n // 5)"""


# ------------------------------------------------------------------ metrics


def q_metrics(spark, sf):
    c = load(spark, sf, "customer")
    pred = c.select(
        F.col("c_acctbal").alias("Real"),
        (F.col("c_acctbal") * 0.95 + (F.col("c_custkey") % 11) - 5.0).alias("Prediction"),
    )
    m = metrics_frame(pred)
    return m.select(*[r(x, DS).alias(x) for x in m.columns])


def _metrics_sql(src: str, y: str = "y", p: str = "p") -> str:
    return f"""SELECT
  round(CASE WHEN var_pop({y}) * count(*) = 0 THEN (CASE WHEN sum(({y} - {p}) * ({y} - {p})) = 0 THEN 1.0 ELSE 0.0 END)
        ELSE 1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*)) END, {DS}) AS r2,
  round(avg(abs({y} - {p})), {DS}) AS mae,
  round(sqrt(avg(({y} - {p}) * ({y} - {p}))), {DS}) AS rmse,
  round(CASE WHEN count(*) FILTER (WHERE {y} = 0) = 0
        THEN avg(abs({y} - {p}) / greatest(abs({y}), 2.220446049250313e-16)) * 100 END, {DS}) AS mape
FROM {src}"""


SQL_METRICS = (
    "WITH q AS (SELECT c_acctbal AS y, c_acctbal * 0.95 + (c_custkey % 11) - 5.0 AS p FROM customer)\n"
    + _metrics_sql("q")
)


# --------------------------------------------------------------- workflows


def _part_cfg(spark, sf, features=("p_size",), key="linear_regression", params=None, scaling=None, **kw):
    part = load(spark, sf, "part")
    plan = profile.preprocessing_plan(part, list(features))
    if scaling is not None:
        plan = profile.override_plan(plan, scaling=scaling)
    from .config import ModelSpec

    cfg = PipelineConfig(tuple(features), "p_retailprice", ("p_partkey",), plan, ModelSpec(key, params or {}), **kw)
    return part, cfg


def q_ols_2(spark, sf):
    """W1 + W3: OLS on two (standardised) features, predictions for every row."""
    part, cfg = _part_cfg(spark, sf, ("p_size", "p_partkey"))
    res = W.train(part, TrainingConfig(cfg, "Last percent", 100), test=part)
    return res.prediction.data.select("idx", r("Real").alias("Real"), r("Prediction").alias("Prediction"))


SQL_OLS_2 = f"""WITH m AS (SELECT
    covar_pop(p_size, p_size) AS s11, covar_pop(p_partkey, p_partkey) AS s22, covar_pop(p_size, p_partkey) AS s12,
    covar_pop(p_size, p_retailprice) AS s1y, covar_pop(p_partkey, p_retailprice) AS s2y,
    avg(p_size) AS m1, avg(p_partkey) AS m2, avg(p_retailprice) AS my FROM part),
c AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM m)
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, round(p_retailprice, {D}) AS "Real",
       round(my + b1 * (p_size - m1) + b2 * (p_partkey - m2), {D}) AS "Prediction"
FROM part, c"""


def q_prediction_long(spark, sf):
    """A3 over the one-feature OLS predictions of every part row."""
    part, cfg = _part_cfg(spark, sf, ("p_size",))
    res = W.train(part, TrainingConfig(cfg, "Last percent", 100), test=part)
    lf = long_form(res.prediction.data)
    return lf.select("Row", "Series", r("Value").alias("Value"))


SQL_PREDICTION_LONG = f"""WITH c AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part),
p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS "Row", p_retailprice AS real, a + b * p_size AS pred FROM part, c)
SELECT "Row", 'Real' AS "Series", round(real, {D}) AS "Value" FROM p
UNION ALL SELECT "Row", 'Prediction' AS "Series", round(pred, {D}) AS "Value" FROM p"""


def q_ridge_1(spark, sf):
    part, cfg = _part_cfg(spark, sf, ("p_size",), key="ridge", params={"alpha": 1.0}, scaling="None")
    res = W.train(part, TrainingConfig(cfg, "Last percent", 100), test=part)
    return res.prediction.data.select("idx", r("Prediction").alias("Prediction"))


SQL_RIDGE_1 = f"""WITH m AS (SELECT covar_pop(p_size, p_retailprice) * count(*) AS sxy, var_pop(p_size) * count(*) AS sxx,
    avg(p_size) AS mx, avg(p_retailprice) AS my FROM part),
c AS (SELECT sxy / (sxx + 1.0) AS b, mx, my FROM m)
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, round(my + b * (p_size - mx), {D}) AS "Prediction" FROM part, c"""


def _validation_metrics(spark, sf, strategy, percent=20, folds=5):
    part, cfg = _part_cfg(spark, sf, ("p_size",))
    res = W.validate(part, ValidationConfig(cfg, strategy, percent, folds))
    m = metrics_frame(res.prediction.data)
    return m.select(*[r(x, DS).alias(x) for x in m.columns])


def q_validate_last_split(spark, sf):
    return _validation_metrics(spark, sf, "Last split", 20)


def q_validate_random_split(spark, sf):
    return _validation_metrics(spark, sf, "Random split", 25)


def q_validate_kfold(spark, sf):
    return _validation_metrics(spark, sf, "Cross-validation", folds=5)


_SPLIT_FIT_SQL = """{rank},
tr AS (SELECT * FROM s WHERE {train_cond}), te AS (SELECT * FROM s WHERE NOT ({train_cond})),
c AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM tr),
q AS (SELECT p_retailprice AS y, a + b * p_size AS p FROM te, c)
"""
SQL_VALIDATE_LAST_SPLIT = _SPLIT_FIT_SQL.format(
    rank="WITH s AS (SELECT p_size, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part)",
    train_cond="rn < n - greatest(1, (n * 20 + 99) // 100)",
) + _metrics_sql("q")
SQL_VALIDATE_RANDOM_SPLIT = _SPLIT_FIT_SQL.format(
    rank=(
        "WITH s AS (SELECT p_size, p_retailprice, row_number() OVER (ORDER BY md5(concat(CAST(p_partkey AS VARCHAR), '|42')), p_partkey) - 1 AS rn, "
        "count(*) OVER () AS n FROM part)"
    ),
    train_cond="rn >= (n * 25 + 99) // 100",
) + _metrics_sql("q")
SQL_VALIDATE_KFOLD = (
    "WITH h AS (SELECT p_size AS x, p_retailprice AS y, row_number() OVER (ORDER BY md5(concat(CAST(p_partkey AS VARCHAR), '|42')), p_partkey) - 1 AS rn, "
    "count(*) OVER () AS n FROM part),\n"
    "f AS (SELECT x, y, CASE WHEN rn < (n % 5) * (n // 5 + 1) THEN rn // (n // 5 + 1) "
    "ELSE (n % 5) + (rn - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM h),\n"
    "fs AS (SELECT fold, count(*) AS c, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM f GROUP BY fold),\n"
    "t AS (SELECT sum(c) AS c, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM fs),\n"
    "tr AS (SELECT fs.fold, t.c - fs.c AS c, t.sx - fs.sx AS sx, t.sy - fs.sy AS sy, t.sxx - fs.sxx AS sxx, t.sxy - fs.sxy AS sxy FROM fs, t),\n"
    "co AS (SELECT fold, (c * sxy - sx * sy) / (c * sxx - sx * sx) AS b, sy / c - (c * sxy - sx * sy) / (c * sxx - sx * sx) * sx / c AS a FROM tr),\n"
    "q AS (SELECT y, a + b * x AS p FROM f JOIN co USING (fold))\n" + _metrics_sql("q")
)


# -------------------------------------------------------- feature selection


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def q_f_regression(spark, sf):
    from ..operators.feature_selection import f_regression_table

    li = load(spark, sf, "lineitem")
    t = f_regression_table(li, LINE_FEATURES, "l_extendedprice")
    return t.select("Variable", r("score", 6).alias("score"))


SQL_F_REGRESSION = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"Variable\", round(corr({c}, l_extendedprice) ^ 2 / (1 - corr({c}, l_extendedprice) ^ 2) * (count(*) - 2), 6) AS score FROM lineitem"
    for c in LINE_FEATURES
)


def q_select_k_best(spark, sf):
    """FS0 with F-regression over the default-plan encoded part features."""
    from ..operators.feature_selection import f_regression_table, k_best_flags

    part = load(spark, sf, "part")
    feats = ["p_type", "p_brand", "p_size"]
    pre = Preprocessor.fit(part, profile.preprocessing_plan(part, feats), feats)
    enc = pre.transform(part, keep=["p_retailprice"])
    t = f_regression_table(enc, pre.output_names(), "p_retailprice")
    flagged = k_best_flags(t, 3)
    return flagged.select("Variable", r("score", 4).alias("score"), "selected")


def _sql_select_k_best() -> str:
    cols = [(f"p_type_{v}", f"CAST(p_type = '{v}' AS DOUBLE)") for v in P_TYPES]
    cols += [("p_brand", "CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE)"), ("p_size", "p_size")]
    enc = "WITH e AS (SELECT p_retailprice AS y, " + ", ".join(f"{expr} AS {n}" for n, expr in cols) + " FROM part),\n"
    parts = []
    for pos, (n, _) in enumerate(cols):
        parts.append(
            f"SELECT '{n}' AS v, {pos} AS pos, coalesce(corr({n}, y) ^ 2 / (1 - corr({n}, y) ^ 2) * (count(*) - 2), 0) AS score FROM e"
        )
    return (
        enc
        + "s AS (" + "\nUNION ALL\n".join(parts) + ")\n"
        + "SELECT v AS \"Variable\", round(score, 4) AS score, "
        + "row_number() OVER (ORDER BY score DESC, pos DESC) <= 3 AS selected FROM s"
    )


SQL_SELECT_K_BEST = _sql_select_k_best()


# ------------------------------------------------------------ time series


def _events_ix(spark, sf):
    return with_row_index(load(spark, sf, "events").select("event_id", "ts", "value"), EVENTS_ORDER)


_EV_RN = "WITH s AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events)"


def q_lag_features(spark, sf):
    ix = _events_ix(spark, sf)
    out = lookback_features(ix.df, "value", 3, idx="idx")
    return out.select("event_id", "value_lag_1", "value_lag_2", "value_lag_3")


SQL_LAG_FEATURES = _EV_RN + """,
l AS (SELECT event_id, i, lag(value, 1) OVER w AS value_lag_1, lag(value, 2) OVER w AS value_lag_2,
      lag(value, 3) OVER w AS value_lag_3 FROM s WINDOW w AS (ORDER BY i))
SELECT event_id, value_lag_1, value_lag_2, value_lag_3 FROM l WHERE i >= 3"""


def q_windows(spark, sf):
    ix = _events_ix(spark, sf)
    w = windows(ix.df.select("idx", "value"), "value", (1, 3, 5))
    return w.select("idx", "lag_1", "lag_3", "lag_5", "label")


SQL_WINDOWS = _EV_RN + """,
l AS (SELECT i, lag(value, 1) OVER w AS lag_1, lag(value, 3) OVER w AS lag_3, lag(value, 5) OVER w AS lag_5,
      value AS label FROM s WINDOW w AS (ORDER BY i))
SELECT i AS idx, lag_1, lag_3, lag_5, label FROM l WHERE i >= 5"""


def _acf_df(spark, values, name="acf"):
    rows = [(int(k), float(round(v, 10))) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("lag", T.LongType()), T.StructField(name, T.DoubleType())]))


def q_acf(spark, sf):
    ix = _events_ix(spark, sf)
    return _acf_df(spark, autocorr.acf_values(ix, "value", 40))


_ACF_CTE = _EV_RN + """,
m AS (SELECT avg(value) AS mu FROM s),
c AS (SELECT i, value - mu AS c FROM s, m),
d AS (SELECT sum(c * c) AS d0 FROM c),
k AS (SELECT range AS k FROM range(0, {K} + 1)),
a AS (SELECT k.k AS lag, sum(x.c * y.c) / max(d.d0) AS acf FROM k JOIN c x ON true JOIN c y ON y.i = x.i + k.k, d GROUP BY k.k)"""
SQL_ACF = _ACF_CTE.format(K=40) + "\nSELECT CAST(lag AS BIGINT) AS lag, round(acf, 10) AS acf FROM a"


def q_pacf(spark, sf):
    ix = _events_ix(spark, sf)
    return _acf_df(spark, autocorr.pacf_values(ix, "value", 40), "pacf")


SQL_PACF = (
    "WITH RECURSIVE "
    + _ACF_CTE.format(K=40).removeprefix("WITH ")
    + """,
r AS (SELECT list(acf ORDER BY lag) AS rl FROM a),
dl(k, phi, pk) AS (
  SELECT 1, [rl[2]], rl[2] FROM r
  UNION ALL
  SELECT k + 1, list_append(list_transform(phi, lambda x, j: x - refl * phi[k + 1 - j]), refl), refl
  FROM (SELECT k, phi, (rl[k + 2] - back) / (1 - back) AS refl
        FROM (SELECT k, phi, rl, list_sum(list_transform(phi, lambda x, j: x * rl[k + 2 - j])) AS back FROM dl, r WHERE k < 40)))
SELECT CAST(0 AS BIGINT) AS lag, 1.0 AS pacf
UNION ALL SELECT CAST(k AS BIGINT) AS lag, round(pk, 10) AS pacf FROM dl"""
)


def q_acf_bounds(spark, sf):
    ix = _events_ix(spark, sf)
    t = autocorr.correlation_table(spark, autocorr.acf_values(ix, "value", 20), ix.n)
    return t.select("lag", r("correlation", 10).alias("correlation"), "zero", r("bound", 10).alias("bound"))


SQL_ACF_BOUNDS = (
    _ACF_CTE.format(K=20)
    + "\nSELECT CAST(lag AS BIGINT) AS lag, round(acf, 10) AS correlation, 0.0 AS zero, "
    + "round(1.96 / sqrt((SELECT count(*) FROM events)), 10) AS bound FROM a"
)


def _lags_df(spark, lags):
    return spark.createDataFrame([(int(k),) for k in lags], "lag bigint")


def q_select_lags_best(spark, sf):
    ix = _events_ix(spark, sf)
    return _lags_df(spark, autocorr.select_lags(ix, "value", 20, "Best N ACF", count=5))


SQL_SELECT_LAGS_BEST = (
    _ACF_CTE.format(K=20)
    + "\nSELECT CAST(lag AS BIGINT) AS lag FROM (SELECT lag, row_number() OVER (ORDER BY abs(acf) DESC, lag) AS r FROM a WHERE lag >= 1) WHERE r <= 5"
)


def q_select_lags_threshold(spark, sf):
    """ACF-threshold lag choice at half the 95 % white-noise bound (0.98/√n)."""
    ix = _events_ix(spark, sf)
    threshold = 0.98 / float(np.sqrt(ix.n))
    return _lags_df(spark, autocorr.select_lags(ix, "value", 20, "ACF threshold", threshold=threshold))


SQL_SELECT_LAGS_THRESHOLD = (
    _ACF_CTE.format(K=20)
    + "\nSELECT CAST(lag AS BIGINT) AS lag FROM a WHERE lag >= 1 AND abs(acf) >= 0.98 / sqrt((SELECT count(*) FROM events))"
)


def q_ar_forecast(spark, sf):
    """T1 + G1 + T2: AR(2) by least squares on the whole series, then a
    12-step recursive forecast from the last two observations."""
    ix = _events_ix(spark, sf)
    lagged = lookback_features(ix.df.select("idx", "value"), "value", 2, idx="idx")
    m = moments_of(lagged, ["value_lag_1", "value_lag_2"], "value")
    model = ols_from_moments(m, ["value_lag_1", "value_lag_2"])
    last = ix.df.where(F.col("idx") >= ix.n - 2).select("idx", "value").collect()
    history = [float(x["value"]) for x in sorted(last, key=lambda x: x["idx"])]
    fc = ar_forecast(model.intercept, model.coef, history, 12)
    return spark.createDataFrame([(i + 1, float(round(v, D))) for i, v in enumerate(fc)], "step bigint, forecast double")


SQL_AR_FORECAST = "WITH RECURSIVE " + _EV_RN.removeprefix("WITH ") + f""",
l AS (SELECT i, value AS y, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2 FROM s WINDOW w AS (ORDER BY i)),
t AS (SELECT * FROM l WHERE i >= 2),
m AS (SELECT covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12,
             covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM t),
c AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2,
             m1, m2, my FROM m),
h AS (SELECT max(CASE WHEN i = (SELECT max(i) FROM s) THEN value END) AS y1,
             max(CASE WHEN i = (SELECT max(i) FROM s) - 1 THEN value END) AS y2 FROM s),
fc AS (SELECT 1 AS step, my - b1 * m1 - b2 * m2 + b1 * y1 + b2 * y2 AS v, y1 AS p1 FROM c, h
       UNION ALL SELECT step + 1, (SELECT my - b1 * m1 - b2 * m2 FROM c) + (SELECT b1 FROM c) * v + (SELECT b2 FROM c) * p1, v
       FROM fc WHERE step < 12)
SELECT CAST(step AS BIGINT) AS step, round(v, {D}) AS forecast FROM fc"""


# ------------------------------------------------------------------ models

MODEL_FEATURES = ("p_size", "p_type", "p_brand")

# Parameters of the registered model queries: the reference defaults where
# empty; the others only lower a penalty that would leave a constant model.
MODEL_QUERY_PARAMS = {
    "linear_regression": {},
    "ridge": {},
    "lasso": {"alpha": 0.1},
    "elastic_net": {"alpha": 0.1},
    "lars": {},
    "lasso_lars": {"alpha": 0.1},
    "bayesian_ridge": {},
    "huber_regressor": {},
    "sgd_regressor": {},
    "quantile_regressor": {"alpha": 0.01},
    "tweedie_regressor": {"power": 2.0, "alpha": 0.01},
    "pls_regression": {"n_components": 2},
    "kernel_ridge": {},
    "elm": {},
    "decision_tree": {},
    "extra_tree": {},
    "random_forest": {},
    "extra_trees": {},
    "bagging": {},
    "gradient_boosting": {},
    "hist_gradient_boosting": {},
    "xgboost": {},
    "lightgbm": {},
    "catboost": {},
    "knn": {},
    "adaboost": {},
    "svm": {},
    "nu_svr": {},
    "gaussian_process": {},
    "mlp": {},
    "voting_regressor": {},
}


def _model_query(key: str):
    def run(spark, sf):
        part, cfg = _part_cfg(spark, sf, MODEL_FEATURES, key=key, params=MODEL_QUERY_PARAMS.get(key, {}))
        res = W.validate(part, ValidationConfig(cfg, "Last split", 20))
        return res.prediction.data.select("idx", r("Real").alias("Real"), r("Prediction").alias("Prediction"))

    run.__name__ = f"q_model_{key}"
    return run


def q_knn(spark, sf):
    """knn (k=5, uniform) trained on the first 80 % of part, raw features."""
    part, cfg = _part_cfg(spark, sf, ("p_size", "p_partkey"), key="knn", scaling="None")
    res = W.validate(part, ValidationConfig(cfg, "Last split", 20))
    return res.prediction.data.select("idx", r("Prediction").alias("Prediction"))


SQL_KNN = f"""WITH s AS (SELECT p_partkey, p_size, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS rn,
    count(*) OVER () AS n FROM part),
c AS (SELECT max(n) - greatest(1, (max(n) * 20 + 99) // 100) AS cut FROM s),
tr AS (SELECT s.* FROM s, c WHERE rn < cut), te AS (SELECT s.*, c.cut FROM s, c WHERE rn >= cut),
d AS (SELECT te.rn - te.cut AS idx, tr.rn AS did, tr.p_retailprice AS y,
        sqrt((te.p_size - tr.p_size) * (te.p_size - tr.p_size) + (te.p_partkey - tr.p_partkey) * (te.p_partkey - tr.p_partkey)) AS dist
      FROM te, tr),
k AS (SELECT idx, y, row_number() OVER (PARTITION BY idx ORDER BY dist, did) AS r FROM d)
SELECT idx, round(avg(y), {D}) AS "Prediction" FROM k WHERE r <= 5 GROUP BY idx"""


def q_decision_tree_2(spark, sf):
    """decision_tree of depth 2 on raw columns, one of them with a value per row (exact splits, no bins)."""
    part, cfg = _part_cfg(spark, sf, ("p_size", "p_partkey"), key="decision_tree", params={"max_depth": 2}, scaling="None")
    res = W.train(part, TrainingConfig(cfg, "Last percent", 100), test=part)
    return res.prediction.data.select("idx", r("Prediction").alias("Prediction"))


def _tree_level_sql(rows: str, level: int) -> str:
    """Best split of every node of ``rows`` (id, y, node): all values of both features tried; then the nodes below."""
    k = level
    return f"""a{k} AS (SELECT r.id, r.y, r.node, l.f, l.x FROM {rows} r JOIN l USING (id)),
v{k} AS (SELECT node, f, x, count(*) AS c, sum(y) AS s FROM a{k} GROUP BY ALL),
c{k} AS (SELECT *, sum(c) OVER w AS cl, sum(s) OVER w AS sl, sum(c) OVER (PARTITION BY node, f) AS ct, sum(s) OVER (PARTITION BY node, f) AS st,
         lead(x) OVER w AS nx FROM v{k} WINDOW w AS (PARTITION BY node, f ORDER BY x)),
g{k} AS (SELECT node, f, (x + nx) / 2 AS thr, (sl - cl * st / ct) ** 2 * ct / (cl * (ct - cl)) AS gain FROM c{k} WHERE nx IS NOT NULL),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, thr) AS rn FROM g{k}) WHERE rn = 1),
n{k} AS (SELECT a.id, a.y, 2 * a.node + CASE WHEN a.x <= b.thr THEN 0 ELSE 1 END AS node FROM a{k} a JOIN b{k} b ON a.node = b.node AND a.f = b.f)"""


SQL_DECISION_TREE_2 = f"""WITH l AS (SELECT p_partkey AS id, 0 AS f, p_size::DOUBLE AS x FROM part UNION ALL SELECT p_partkey, 1, p_partkey::DOUBLE FROM part),
n0 AS (SELECT p_partkey AS id, p_retailprice AS y, 1 AS node FROM part),
{_tree_level_sql("n0", 1)},
{_tree_level_sql("n1", 2)}
SELECT row_number() OVER (ORDER BY id) - 1 AS idx, round(avg(y) OVER (PARTITION BY node), {D}) AS "Prediction" FROM n2"""


def q_candidate_features(spark, sf):
    """IO5: every column but the target may be a feature; the selected table holds the features and the target."""
    part = load(spark, sf, "part")
    return tables.select_frame(part, tables.candidate_features(part, "p_retailprice"), "p_retailprice")


SQL_CANDIDATE_FEATURES = "SELECT * EXCLUDE (p_retailprice), p_retailprice FROM part"


def q_relief_regression(spark, sf):
    from ..operators.neighbors import relief_scores

    part = load(spark, sf, "part")
    feats = ["p_size", "p_partkey"]
    scores = relief_scores(part, feats, "p_retailprice", order_by=["p_partkey"])
    return spark.createDataFrame([(f, float(round(v, DS))) for f, v in zip(feats, scores)], "Variable string, score double")


SQL_RELIEF_REGRESSION = f"""WITH s AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id,
    (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) AS x1,
    (p_partkey - min(p_partkey) OVER ()) / (max(p_partkey) OVER () - min(p_partkey) OVER ()) AS x2,
    p_retailprice AS y, max(p_retailprice) OVER () - min(p_retailprice) OVER () AS yr FROM part),
d AS (SELECT a.id, b.id AS did, sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS dist,
        abs(b.x1 - a.x1) AS f1, abs(b.x2 - a.x2) AS f2, abs(b.y - a.y) / a.yr AS td
      FROM s a JOIN s b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, did) AS k FROM d),
nb AS (SELECT *, exp(-dist / greatest(avg(dist) OVER (PARTITION BY id), 2.220446049250313e-16)) AS w FROM r WHERE k <= 10),
t AS (SELECT sum(w) AS sw, sum(w * td) AS st, sum(w * f1) AS s1, sum(w * f2) AS s2, sum(w * td * f1) AS j1, sum(w * td * f2) AS j2 FROM nb)
SELECT 'p_size' AS "Variable",
  round((j1 / sw) / greatest(st / sw, 2.220446049250313e-16) - (s1 / sw - j1 / sw) / greatest(1 - st / sw, 2.220446049250313e-16), {DS}) AS score FROM t
UNION ALL
SELECT 'p_partkey' AS "Variable",
  round((j2 / sw) / greatest(st / sw, 2.220446049250313e-16) - (s2 / sw - j2 / sw) / greatest(1 - st / sw, 2.220446049250313e-16), {DS}) AS score FROM t"""


def q_mrmr_regression(spark, sf):
    """mRMR ranking (KSG relevance, |corr| redundancy) of part features."""
    from ..operators.neighbors import mrmr_scores

    part = load(spark, sf, "part")
    feats = ["p_size", "p_partkey"]
    scores = mrmr_scores(part, feats, "p_retailprice")
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feats, scores)], "Variable string, score double")


def q_mutual_info(spark, sf):
    """FS2 relevance: KSG mutual information (k = 3) of part features with the price."""
    from ..operators.neighbors import ksg_mi

    part = load(spark, sf, "part")
    rows = [(f, float(round(ksg_mi(part, f, "p_retailprice", 3), DS))) for f in ("p_size", "p_partkey")]
    return spark.createDataFrame(rows, "Variable string, mi double")


def _mi_sql(x: str) -> str:
    return f"""SELECT '{x}' AS "Variable", round(greatest(0.0, hn.hn1 + 1.5 - avg(hx.H) - avg(hy.H)), {DS}) AS mi
FROM cnt JOIN harm hx ON hx.i = cnt.nx JOIN harm hy ON hy.i = cnt.ny,
     (SELECT H AS hn1 FROM harm WHERE i = (SELECT count(*) FROM s) - 1) hn
GROUP BY hn.hn1"""


def _sql_mutual_info(x: str) -> str:
    return f"""WITH s AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id,
    {x} / stddev_pop({x}) OVER () AS x, p_retailprice / stddev_pop(p_retailprice) OVER () AS y FROM part),
pairs AS (SELECT a.id, b.id AS did, round(greatest(abs(a.x - b.x), abs(a.y - b.y)), 9) AS d FROM s a JOIN s b ON a.id <> b.id),
rk AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d, did) AS k FROM pairs),
rad AS (SELECT id, d AS r FROM rk WHERE k = 3),
cnt AS (SELECT a.id, sum(CASE WHEN round(abs(a.x - b.x), 9) < rad.r OR round(abs(a.x - b.x), 9) = 0 THEN 1 ELSE 0 END) AS nx,
               sum(CASE WHEN round(abs(a.y - b.y), 9) < rad.r OR round(abs(a.y - b.y), 9) = 0 THEN 1 ELSE 0 END) AS ny
        FROM s a JOIN rad ON rad.id = a.id JOIN s b ON a.id <> b.id GROUP BY a.id),
harm AS (SELECT 0 AS i, 0.0 AS H UNION ALL
         SELECT range AS i, sum(1.0 / range) OVER (ORDER BY range) AS H FROM range(1, (SELECT count(*) FROM s) + 1))
{_mi_sql(x)}"""


SQL_MUTUAL_INFO = "(" + _sql_mutual_info("p_size") + ")\nUNION ALL\n(" + _sql_mutual_info("p_partkey") + ")"


def q_mutual_info_classif(spark, sf):
    """FS4 relevance: KSG mutual information of document counts with the quality label."""
    from ..operators.neighbors import ksg_mi_cd

    docs = _docs(spark, sf)
    rows = [(f, float(round(ksg_mi_cd(docs, f, "quality", 3), DS))) for f in ("n_chars", "n_words")]
    return spark.createDataFrame(rows, "Variable string, mi double")


def _sql_mi_classif(name: str, expr: str) -> str:
    return f"""WITH d0 AS (SELECT d.doc_id, {expr} AS f, l.quality AS c FROM documents d JOIN labels l USING (doc_id)),
sd AS (SELECT stddev_pop(f) AS sd FROM d0),
cc AS (SELECT c, count(*) AS cnt FROM d0 GROUP BY c),
s AS (SELECT row_number() OVER (ORDER BY d0.doc_id) - 1 AS id, d0.f / sd.sd AS x, d0.c, cc.cnt, least(3, cc.cnt - 1) AS k
      FROM d0 JOIN cc USING (c), sd WHERE cc.cnt > 1),
pairs AS (SELECT a.id, b.id AS did, a.k, round(abs(a.x - b.x), 9) AS d FROM s a JOIN s b ON a.c = b.c AND a.id <> b.id),
rk AS (SELECT id, k, d, row_number() OVER (PARTITION BY id ORDER BY d, did) AS rn FROM pairs),
rad AS (SELECT id, d AS r FROM rk WHERE rn = k),
m AS (SELECT a.id, a.k, a.cnt, sum(CASE WHEN round(abs(a.x - b.x), 9) < rad.r OR round(abs(a.x - b.x), 9) = 0 THEN 1 ELSE 0 END) AS m
      FROM s a JOIN rad ON rad.id = a.id JOIN s b ON true GROUP BY a.id, a.k, a.cnt),
harm AS (SELECT 0 AS i, 0.0 AS H UNION ALL
         SELECT range AS i, sum(1.0 / range) OVER (ORDER BY range) AS H FROM range(1, (SELECT count(*) FROM s) + 1))
SELECT '{name}' AS "Variable",
  round(greatest(0.0, (SELECT H FROM harm WHERE i = (SELECT count(*) FROM s) - 1) + avg(hk.H) - avg(hc.H) - avg(hm.H)), {DS}) AS mi
FROM m JOIN harm hk ON hk.i = m.k - 1 JOIN harm hc ON hc.i = m.cnt - 1 JOIN harm hm ON hm.i = m.m - 1"""


SQL_MUTUAL_INFO_CLASSIF = (
    "(" + _sql_mi_classif("n_chars", "CAST(d.n_chars AS DOUBLE)") + ")\nUNION ALL\n("
    + _sql_mi_classif("n_words", "CAST(len(string_split(d.text, ' ')) AS DOUBLE)") + ")"
)


def q_feature_selection_pipeline(spark, sf):
    """FS0 inside a workflow: F Regression picks 2 of the encoded part features."""
    from .config import FeatureSelection

    part, cfg = _part_cfg(spark, sf, ("p_size", "p_type", "p_partkey"))
    cfg = PipelineConfig(cfg.features, cfg.target, cfg.order_by, cfg.plan, cfg.model, feature_selection=FeatureSelection("F Regression", 2))
    res = W.train(part, TrainingConfig(cfg, "Last percent", 100), test=part)
    return res.prediction.data.select("idx", r("Prediction").alias("Prediction"))


def q_lookback_validate(spark, sf):
    """T1 + T2 in a workflow: ridge with 3 target lags on events, Last split
    10 %, recursive predictions from the training history."""
    from .config import ModelSpec

    ev = load(spark, sf, "events")
    plan = profile.preprocessing_plan(ev, ["event_type"])
    cfg = PipelineConfig(("event_type",), "value", tuple(EVENTS_ORDER), plan, ModelSpec("ridge"), lookback=3)
    res = W.validate(ev, ValidationConfig(cfg, "Last split", 10))
    return res.prediction.data.select("idx", r("Real").alias("Real"), r("Prediction").alias("Prediction"))


def q_known_history_score(spark, sf):
    """One-step predictions with actual history on the last 10 % of events."""
    from ..operators.recursive import known_history_predict
    from ..operators.rowindex import Indexed
    from .config import ModelSpec

    ev = load(spark, sf, "events")
    plan = profile.preprocessing_plan(ev, ["event_type"])
    cfg = PipelineConfig(("event_type",), "value", tuple(EVENTS_ORDER), plan, ModelSpec("linear_regression"), lookback=3)
    ix = with_row_index(ev, EVENTS_ORDER)
    cut = ix.n - max(1, -(-ix.n * 10 // 100))
    tr = Indexed(ix.df.where(F.col("idx") < cut), cut, "idx")
    fitted = W.fit_pipeline(tr, cfg)
    te = ix.df.where(F.col("idx") >= cut).withColumn("idx", F.col("idx") - cut)
    out = known_history_predict(fitted, tr, te, keep=["idx", "value"])
    return out.select("idx", r("value").alias("Real"), r("Prediction").alias("Prediction"))


# ----------------------------------------- one-feature closed-form models


def _one_feature_model(key, params, feature="p_partkey"):
    def run(spark, sf):
        part, cfg = _part_cfg(spark, sf, (feature,), key=key, params=params, scaling="None")
        res = W.train(part, TrainingConfig(cfg, "Last percent", 100), test=part)
        return res.prediction.data.select("idx", r("Prediction").alias("Prediction"))

    return run


_ONE_CTE = """WITH m AS (SELECT covar_pop({x}, p_retailprice) * count(*) AS sxy, var_pop({x}) * count(*) AS sxx,
    sum({x} * p_retailprice) AS uxy, sum({x} * {x}) AS uxx, avg({x}) AS mx, avg(p_retailprice) AS my, count(*) AS n FROM part),
c AS (SELECT {w} AS w, {b} AS b FROM m)
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, round(b + w * {x}, {d}) AS "Prediction" FROM part, c"""


def _one_sql(w: str, b: str = "my - w_ * mx", x: str = "p_partkey") -> str:
    # ``w_`` in the intercept refers to the slope expression itself
    return _ONE_CTE.format(x=x, w=w, b=b.replace("w_", f"({w})"), d=D)


SQL_LASSO_1 = _one_sql("sign(sxy) * greatest(abs(sxy) - n * 1.0, 0) / sxx")
SQL_ELASTIC_NET_1 = _one_sql("sign(sxy) * greatest(abs(sxy) - n * 1.0 * 0.5, 0) / (sxx + n * 1.0 * 0.5)")
SQL_KERNEL_RIDGE_1 = _one_sql("uxy / (uxx + 1.0)", b="0.0")
SQL_TWEEDIE_1 = _one_sql("sxy / (sxx + n * 1.0)")
SQL_PLS_1 = _one_sql("sxy / sxx")


GRID_ALPHAS = (1.0, 1e5, 1e6)


def q_grid_search_1(spark, sf):
    """W4 + A5 on one raw feature: ridge alpha grid, 3 unshuffled folds of the seeded order, mean R² per candidate."""
    from .config import ModelSpec

    part, cfg = _part_cfg(spark, sf, ("p_size",), scaling="None")
    spec = ModelSpec("ridge", {}, True, {"model__alpha": list(GRID_ALPHAS)}, 3)
    res = W.train(part, TrainingConfig(PipelineConfig(cfg.features, cfg.target, cfg.order_by, cfg.plan, spec), "Random percent", 100))
    gs = res.grid_search
    rows = [(float(c["model__alpha"]), float(round(sc, DS)), c["model__alpha"] == gs.best_parameters["model__alpha"]) for c, sc in gs.scores]
    return spark.createDataFrame(rows, "alpha double, mean_r2 double, best boolean")


SQL_GRID_SEARCH_1 = f"""WITH h AS (SELECT p_size AS x, p_retailprice AS y, count(*) OVER () AS n,
    row_number() OVER (ORDER BY md5(concat(CAST(p_partkey AS VARCHAR), '|42')), p_partkey) - 1 AS rn FROM part),
f AS (SELECT x, y, {_fold_sql(3)} FROM h),
g AS (SELECT DISTINCT fold AS held FROM f),
tr AS (SELECT held, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx, avg(x) AS mx, avg(y) AS my FROM f JOIN g ON fold <> held GROUP BY held),
a AS (SELECT unnest([{", ".join(f"{v}::DOUBLE" for v in GRID_ALPHAS)}]) AS alpha),
te AS (SELECT held, alpha, 1 - sum((y - my - sxy / (sxx + alpha) * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM f JOIN tr ON fold = held, a GROUP BY held, alpha),
m AS (SELECT alpha, avg(r2) AS r FROM te GROUP BY alpha)
SELECT alpha, round(r, {DS}) AS mean_r2, r = max(r) OVER () AS best FROM m"""


def q_boosting_round(spark, sf):
    """gradient_boosting, one round of depth 1 on a column with a value per row."""
    return _one_feature_model("gradient_boosting", {"n_estimators": 1, "max_depth": 1})(spark, sf)


SQL_BOOSTING_ROUND = f"""WITH m AS (SELECT avg(p_retailprice) AS my FROM part),
v AS (SELECT p_partkey AS x, count(*) AS c, sum(p_retailprice - my) AS s FROM part, m GROUP BY p_partkey),
cum AS (SELECT x, sum(c) OVER (ORDER BY x) AS cl, sum(s) OVER (ORDER BY x) AS sl, sum(c) OVER () AS ct, sum(s) OVER () AS st, lead(x) OVER (ORDER BY x) AS nx FROM v),
g AS (SELECT (x + nx) / 2.0 AS thr, sl / cl AS ml, (st - sl) / (ct - cl) AS mr, sl * sl / cl + (st - sl) * (st - sl) / (ct - cl) AS gain FROM cum WHERE nx IS NOT NULL),
b AS (SELECT thr, ml, mr FROM g ORDER BY gain DESC, thr LIMIT 1)
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, round(my + 0.1 * CASE WHEN p_partkey < thr THEN ml ELSE mr END, {D}) AS "Prediction" FROM part, b, m"""


def _mrmr_sql(relevance: str) -> str:
    """Two features: the more relevant one is chosen first, so it scores 2 and the other 1."""
    return f'SELECT "Variable", CAST(3 - row_number() OVER (ORDER BY mi DESC) AS DOUBLE) AS score FROM ({relevance})'


def q_decision_stump(spark, sf):
    """decision_tree with max_depth=1 on p_size (exact thresholds)."""
    return _one_feature_model("decision_tree", {"max_depth": 1}, "p_size")(spark, sf)


SQL_DECISION_STUMP = f"""WITH v AS (SELECT p_size AS x, count(*) AS c, sum(p_retailprice) AS s FROM part GROUP BY p_size),
cum AS (SELECT x, sum(c) OVER (ORDER BY x) AS cl, sum(s) OVER (ORDER BY x) AS sl,
        sum(c) OVER () AS ct, sum(s) OVER () AS st, lead(x) OVER (ORDER BY x) AS nx FROM v),
g AS (SELECT (x + nx) / 2.0 AS thr, sl / cl AS ml, (st - sl) / (ct - cl) AS mr,
        sl * sl / cl + (st - sl) * (st - sl) / (ct - cl) AS gain FROM cum WHERE nx IS NOT NULL),
b AS (SELECT thr, ml, mr FROM g ORDER BY gain DESC, thr LIMIT 1)
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, round(CASE WHEN p_size < thr THEN ml ELSE mr END, {D}) AS "Prediction"
FROM part, b"""


# ------------------------------------- lookback workflows with SQL oracles


def _events_lookback_cfg(spark, sf):
    from .config import ModelSpec

    ev = load(spark, sf, "events").select("ts", "event_id", "user_id", "value")
    plan = profile.override_plan(profile.preprocessing_plan(ev, ["user_id"]), scaling="None")
    cfg = PipelineConfig(("user_id",), "value", tuple(EVENTS_ORDER), plan, ModelSpec("linear_regression"), lookback=1)
    return ev, cfg


def q_lookback_recursive_sql(spark, sf):
    """T1 + T2: OLS on (user_id, value_lag_1), Last split 10 %, predictions
    fed back recursively from the last training value."""
    ev, cfg = _events_lookback_cfg(spark, sf)
    res = W.validate(ev, ValidationConfig(cfg, "Last split", 10))
    return res.prediction.data.select("idx", r("Prediction").alias("Prediction"))


def q_known_history_sql(spark, sf):
    """The same model scored with the ACTUAL previous values."""
    from ..operators.recursive import known_history_predict
    from ..operators.rowindex import Indexed

    ev, cfg = _events_lookback_cfg(spark, sf)
    tr, va = sampling.last_split(W._index(ev, cfg), 10)
    fitted = W.fit_pipeline(tr, cfg)
    out = known_history_predict(fitted, tr, va.df, keep=["idx"])
    return out.select("idx", r("Prediction").alias("Prediction"))


_LB_FIT = """s AS (SELECT CAST(user_id AS DOUBLE) AS x, value AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS i,
    count(*) OVER () AS n FROM events),
cut AS (SELECT max(n) - greatest(1, (max(n) * 10 + 99) // 100) AS c FROM s),
tr AS (SELECT s.x, s.y, s.i, lag(s.y) OVER (ORDER BY s.i) AS l1 FROM s, cut WHERE s.i < cut.c),
t AS (SELECT * FROM tr WHERE i >= 1),
m AS (SELECT covar_pop(x, x) AS s11, covar_pop(l1, l1) AS s22, covar_pop(x, l1) AS s12, covar_pop(x, y) AS s1y,
             covar_pop(l1, y) AS s2y, avg(x) AS m1, avg(l1) AS m2, avg(y) AS my FROM t),
co AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2,
              m1, m2, my FROM m),
k AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM co),
va AS (SELECT s.x, s.y, s.i - cut.c AS j FROM s, cut WHERE s.i >= cut.c),
h AS (SELECT y AS last_y FROM s, cut WHERE s.i = cut.c - 1)"""

SQL_LOOKBACK_RECURSIVE = "WITH RECURSIVE " + _LB_FIT + f""",
rec AS (SELECT 0 AS j, (SELECT b0 FROM k) + (SELECT b1 FROM k) * va.x + (SELECT b2 FROM k) * (SELECT last_y FROM h) AS p
          FROM va WHERE va.j = 0
        UNION ALL
        SELECT rec.j + 1, (SELECT b0 FROM k) + (SELECT b1 FROM k) * va.x + (SELECT b2 FROM k) * rec.p
          FROM rec JOIN va ON va.j = rec.j + 1)
SELECT CAST(j AS BIGINT) AS idx, round(p, {D}) AS "Prediction" FROM rec"""

SQL_KNOWN_HISTORY = "WITH " + _LB_FIT + f"""
SELECT CAST(va.j AS BIGINT) AS idx,
  round(k.b0 + k.b1 * va.x + k.b2 * coalesce(lag(va.y) OVER (ORDER BY va.j), (SELECT last_y FROM h)), {D}) AS "Prediction"
FROM va, k"""


def q_ar_forecast_by_series(spark, sf):
    """T1 + G1 + T2 for every user's event series at once (12 steps)."""
    from ..operators.recursive import ar2_forecast_by_series

    ev = load(spark, sf, "events")
    fc = ar2_forecast_by_series(ev, "user_id", EVENTS_ORDER, "value", 12)
    return fc.select("user_id", "step", r("forecast").alias("forecast"))


SQL_AR_FORECAST_BY_SERIES = f"""WITH RECURSIVE s AS (SELECT user_id, value AS y,
    lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, row_number() OVER w AS i FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT user_id, covar_pop(l1, l1) AS s11, covar_pop(l2, l2) AS s22, covar_pop(l1, l2) AS s12,
             covar_pop(l1, y) AS s1y, covar_pop(l2, y) AS s2y, avg(l1) AS m1, avg(l2) AS m2, avg(y) AS my
      FROM s WHERE l2 IS NOT NULL GROUP BY user_id),
c AS (SELECT user_id, (s22 * s1y - s12 * s2y) / nullif(s11 * s22 - s12 * s12, 0) AS b1,
             (s11 * s2y - s12 * s1y) / nullif(s11 * s22 - s12 * s12, 0) AS b2, m1, m2, my FROM m),
k AS (SELECT user_id, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM c WHERE b1 IS NOT NULL),
h AS (SELECT user_id, arg_max(y, i) AS y1, arg_max(l1, i) AS y2 FROM s GROUP BY user_id),
fc AS (SELECT k.user_id, 1 AS step, k.b0 + k.b1 * h.y1 + k.b2 * h.y2 AS v, h.y1 AS p2 FROM k JOIN h USING (user_id)
       UNION ALL
       SELECT fc.user_id, fc.step + 1, k.b0 + k.b1 * fc.v + k.b2 * fc.p2, fc.v FROM fc JOIN k USING (user_id) WHERE fc.step < 12)
SELECT user_id, CAST(step AS BIGINT) AS step, round(v, {D}) AS forecast FROM fc"""


# ------------------------------------------------ sources, gather, grid


def q_head_rows(spark, sf):
    """IO3: the first 100 rows of orders in (o_orderdate, o_orderkey) order."""
    from ..sources.tables import head_rows

    ix = _orders_ix(spark, sf)
    return head_rows(ix.df, 100).select("o_orderkey", "idx")


SQL_HEAD_ROWS = "SELECT o_orderkey, idx FROM (" + SQL_ROW_INDEX + ") WHERE idx < 100"


def q_gather_rows(spark, sf):
    """Orders rows whose position is listed by the last expanding fold."""
    ix = _orders_ix(spark, sf)
    tagged = sampling.expanding_folds(ix, 4).df
    indices = tagged.where(F.col("fold") == 3).select("idx")
    return sampling.gather(ix, indices).select("o_orderkey", "idx")


SQL_GATHER_ROWS = _ORD_RN + """
SELECT o_orderkey, rn AS idx FROM s WHERE rn >= n - 4 * (n // 5) AND (rn - (n - 4 * (n // 5))) // (n // 5) = 3"""


def q_artifact_roundtrip(spark, sf):
    """IO4: by how much the predictions of a saved and reloaded pipeline differ from the original's."""
    from ..sources.artifacts import deserialize_artifact, serialize_artifact

    part, cfg = _part_cfg(spark, sf, MODEL_FEATURES, key="gradient_boosting", params={})
    res = W.train(part, TrainingConfig(cfg, "Random percent", 80))
    again = deserialize_artifact(serialize_artifact(res.artifact))
    ix = with_row_index(part, ["p_partkey"])
    a = res.artifact.predict(ix.df, keep=["idx"]).withColumnRenamed("Prediction", "before")
    b = again.predict(ix.df, keep=["idx"]).withColumnRenamed("Prediction", "after")
    return a.join(b, "idx").select("idx", (F.col("after") - F.col("before")).alias("difference"))


SQL_ARTIFACT_ROUNDTRIP = "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, 0.0::DOUBLE AS difference FROM part"


def q_csv_roundtrip(spark, sf):
    """IO1 + IO2: part written as CSV by the prediction sink and read back by the source."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.tables import read_table, write_predictions

    path = f"{ensure_checkpoint_dir(spark)}/csv-roundtrip-{uuid.uuid4().hex}.csv"
    write_predictions(load(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"), path)
    back = read_table(spark, path)
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"), r("p_retailprice").alias("p_retailprice"))


SQL_CSV_ROUNDTRIP = f"SELECT p_partkey::BIGINT AS p_partkey, p_brand, p_type, p_size::BIGINT AS p_size, round(p_retailprice::DOUBLE, {DS}) AS p_retailprice FROM part"


def q_grid_search_summary(spark, sf):
    """W4 + A5: ridge alpha grid, 3 unshuffled folds, mean R² per candidate."""
    from .config import ModelSpec

    part, cfg = _part_cfg(spark, sf, MODEL_FEATURES)
    spec = ModelSpec("ridge", {}, True, {"model__alpha": [0.1, 1.0, 10.0]}, 3)
    cfg = PipelineConfig(cfg.features, cfg.target, cfg.order_by, cfg.plan, spec)
    res = W.train(part, TrainingConfig(cfg, "Random percent", 100))
    gs = res.grid_search
    rows = [(float(c["model__alpha"]), float(round(sc, DS)), bool(c == {"model__alpha": gs.best_parameters["model__alpha"]})) for c, sc in gs.scores]
    return spark.createDataFrame(rows, "alpha double, mean_r2 double, best boolean")


# --------------------------------------------------- classification fixtures


def _docs(spark, sf):
    d = load(spark, sf, "documents")
    lab = load(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.col("text"), " ")).cast("double").alias("n_words"),
        "lang",
        "quality",
    )


def q_relief_classif(spark, sf):
    from ..operators.neighbors import relief_classif_scores

    docs = _docs(spark, sf)
    sc = relief_classif_scores(docs, ["n_chars", "n_words"], "quality", order_by=["doc_id"])
    return spark.createDataFrame([("n_chars", float(round(sc[0], DS))), ("n_words", float(round(sc[1], DS)))], "Variable string, score double")


SQL_RELIEF_CLASSIF = f"""WITH d0 AS (SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS f1, CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS f2,
    l.quality AS c FROM documents d JOIN labels l USING (doc_id)),
s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id,
    (f1 - min(f1) OVER ()) / (max(f1) OVER () - min(f1) OVER ()) AS x1,
    (f2 - min(f2) OVER ()) / (max(f2) OVER () - min(f2) OVER ()) AS x2, c FROM d0),
n AS (SELECT count(*) AS n FROM s),
pr AS (SELECT c, count(*) / max(n.n) AS p FROM s, n GROUP BY c),
pairs AS (SELECT a.id, a.c AS ac, b.c AS nc, b.id AS did,
    sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS dist,
    abs(b.x1 - a.x1) AS d1, abs(b.x2 - a.x2) AS d2 FROM s a JOIN s b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id, nc ORDER BY dist, did) AS k FROM pairs),
nb AS (SELECT *, count(*) OVER (PARTITION BY id, nc) AS cnt FROM r WHERE k <= (SELECT least(10, n - 1) FROM n)),
w AS (SELECT nb.d1, nb.d2, (CASE WHEN nb.nc = nb.ac THEN -1.0 / nb.cnt ELSE pn.p / (1 - pa.p) / nb.cnt END) / (SELECT n FROM n) AS wt
      FROM nb JOIN pr pn ON pn.c = nb.nc JOIN pr pa ON pa.c = nb.ac)
SELECT 'n_chars' AS "Variable", round(sum(wt * d1), {DS}) AS score FROM w
UNION ALL SELECT 'n_words' AS "Variable", round(sum(wt * d2), {DS}) AS score FROM w"""


def q_mrmr_classif(spark, sf):
    from ..operators.neighbors import mrmr_classif_scores

    docs = _docs(spark, sf)
    sc = mrmr_classif_scores(docs, ["n_chars", "n_words"], "quality")
    return spark.createDataFrame([("n_chars", float(sc[0])), ("n_words", float(sc[1]))], "Variable string, score double")


def q_elm_classifier(spark, sf):
    """ELM classifier on documents ⋈ labels (standardised counts, one-hot lang)."""
    from ..operators.elm import elm_classifier_fit

    docs = _docs(spark, sf)
    feats = ["n_chars", "n_words", "lang"]
    pre = Preprocessor.fit(docs, profile.preprocessing_plan(docs, feats), feats)
    enc = pre.transform(docs, keep=["doc_id", "quality"])
    m = elm_classifier_fit(enc, pre.output_names(), "quality", n_hidden=50)
    return m.transform(enc, "predicted").select("doc_id", "quality", "predicted")


# ------------------------------------------------------------ many series


def q_acf_by_series(spark, sf):
    """T4 per series (events per user): one global index over (user, time),
    per-series halo lags, grouped sums — no per-series window or task."""
    from ..operators.lags import with_lags

    ev = load(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    ix = with_row_index(ev, ["user_id", "ts", "event_id"])
    stats = ix.df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mu"))
    c = ix.df.join(stats.where(F.col("n") > 3), "user_id").select("user_id", "idx", (F.col("value") - F.col("mu")).alias("c"))
    lagged = with_lags(c, "c", [1, 2, 3], idx="idx", names=["l1", "l2", "l3"], series="user_id")
    agg = lagged.groupBy("user_id").agg(
        F.sum(F.col("c") * F.col("c")).alias("s0"), *[F.sum(F.col("c") * F.col(f"l{k}")).alias(f"s{k}") for k in (1, 2, 3)]
    )
    out = agg.select(
        "user_id",
        F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.try_divide(F.col(f"s{k}"), F.col("s0")).alias("acf")) for k in (1, 2, 3)])).alias("x"),
    )
    return out.select("user_id", F.col("x.lag").alias("lag"), r(F.col("x.acf"), 8).alias("acf"))


SQL_ACF_BY_SERIES = """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
    count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id) AS mu FROM events),
c AS (SELECT user_id, i, value - mu AS c FROM s WHERE n > 3),
l AS (SELECT user_id, c, lag(c, 1) OVER w AS l1, lag(c, 2) OVER w AS l2, lag(c, 3) OVER w AS l3 FROM c
      WINDOW w AS (PARTITION BY user_id ORDER BY i)),
g AS (SELECT user_id, sum(c * c) AS s0, sum(c * l1) AS s1, sum(c * l2) AS s2, sum(c * l3) AS s3 FROM l GROUP BY user_id)
SELECT user_id, CAST(1 AS BIGINT) AS lag, round(s1 / nullif(s0, 0), 8) AS acf FROM g
UNION ALL SELECT user_id, CAST(2 AS BIGINT) AS lag, round(s2 / nullif(s0, 0), 8) AS acf FROM g
UNION ALL SELECT user_id, CAST(3 AS BIGINT) AS lag, round(s3 / nullif(s0, 0), 8) AS acf FROM g"""


# ---------------------------------------------------------------- registry


def registry() -> dict:
    """name → (callable, sql or None)."""
    return {
        "profile_plan": (q_profile_plan, SQL_PROFILE_PLAN),
        "encoded_feature_count": (q_encoded_feature_count, SQL_ENCODED_FEATURE_COUNT),
        "plan_override": (q_plan_override, SQL_PLAN_OVERRIDE),
        "null_check": (q_null_check, SQL_NULL_CHECK),
        "series_check": (q_series_check, SQL_SERIES_CHECK),
        "encode_onehot": (q_encode_onehot, SQL_ENCODE_ONEHOT),
        "encode_ordinal": (q_encode_ordinal, SQL_ENCODE_ORDINAL),
        "scale_standard": (q_scale_standard, SQL_SCALE_STANDARD),
        "scale_minmax": (q_scale_minmax, SQL_SCALE_MINMAX),
        "encoded_frame": (q_encoded_frame, SQL_ENCODED_FRAME),
        "target_scaling": (q_target_scaling, SQL_TARGET_SCALING),
        "row_index": (q_row_index, SQL_ROW_INDEX),
        "last_percent": (q_last_percent, SQL_LAST_PERCENT),
        "random_percent": (q_random_percent, SQL_RANDOM_PERCENT),
        "random_split": (q_random_split, SQL_RANDOM_SPLIT),
        "last_split": (q_last_split, SQL_LAST_SPLIT),
        "kfold_random": (q_kfold_random, SQL_KFOLD_RANDOM),
        "kfold_contiguous": (q_kfold_contiguous, SQL_KFOLD_CONTIGUOUS),
        "expanding_folds": (q_expanding_folds, SQL_EXPANDING_FOLDS),
        "metrics": (q_metrics, SQL_METRICS),
        "ols_2": (q_ols_2, SQL_OLS_2),
        "prediction_long": (q_prediction_long, SQL_PREDICTION_LONG),
        "ridge_1": (q_ridge_1, SQL_RIDGE_1),
        "validate_last_split": (q_validate_last_split, SQL_VALIDATE_LAST_SPLIT),
        "validate_random_split": (q_validate_random_split, SQL_VALIDATE_RANDOM_SPLIT),
        "validate_kfold": (q_validate_kfold, SQL_VALIDATE_KFOLD),
        "f_regression": (q_f_regression, SQL_F_REGRESSION),
        "select_k_best": (q_select_k_best, SQL_SELECT_K_BEST),
        "lag_features": (q_lag_features, SQL_LAG_FEATURES),
        "windows": (q_windows, SQL_WINDOWS),
        "acf": (q_acf, SQL_ACF),
        "pacf": (q_pacf, SQL_PACF),
        "acf_bounds": (q_acf_bounds, SQL_ACF_BOUNDS),
        "select_lags_best": (q_select_lags_best, SQL_SELECT_LAGS_BEST),
        "select_lags_threshold": (q_select_lags_threshold, SQL_SELECT_LAGS_THRESHOLD),
        "ar_forecast": (q_ar_forecast, SQL_AR_FORECAST),
        "knn": (q_knn, SQL_KNN),
        "relief_regression": (q_relief_regression, SQL_RELIEF_REGRESSION),
        "mrmr_regression": (q_mrmr_regression, _mrmr_sql(SQL_MUTUAL_INFO)),
        "mutual_info": (q_mutual_info, SQL_MUTUAL_INFO),
        "mutual_info_classif": (q_mutual_info_classif, SQL_MUTUAL_INFO_CLASSIF),
        "feature_selection_pipeline": (q_feature_selection_pipeline, None),
        **{f"model_{k}": (_model_query(k), None) for k in MODEL_QUERY_PARAMS},
        "lasso_1": (_one_feature_model("lasso", {"alpha": 1.0}), SQL_LASSO_1),
        "elastic_net_1": (_one_feature_model("elastic_net", {"alpha": 1.0, "l1_ratio": 0.5}), SQL_ELASTIC_NET_1),
        "kernel_ridge_1": (_one_feature_model("kernel_ridge", {"alpha": 1.0, "kernel": "linear"}), SQL_KERNEL_RIDGE_1),
        "tweedie_1": (_one_feature_model("tweedie_regressor", {"power": 0.0, "alpha": 1.0}), SQL_TWEEDIE_1),
        "lars_1": (_one_feature_model("lars", {}), SQL_PLS_1),
        "lasso_lars_1": (_one_feature_model("lasso_lars", {"alpha": 1.0}), SQL_LASSO_1),
        "boosting_round": (q_boosting_round, SQL_BOOSTING_ROUND),
        "grid_search_1": (q_grid_search_1, SQL_GRID_SEARCH_1),
        "pls_1": (_one_feature_model("pls_regression", {"n_components": 1}), SQL_PLS_1),
        "decision_stump": (q_decision_stump, SQL_DECISION_STUMP),
        "decision_tree_2": (q_decision_tree_2, SQL_DECISION_TREE_2),
        "candidate_features": (q_candidate_features, SQL_CANDIDATE_FEATURES),
        "lookback_recursive_sql": (q_lookback_recursive_sql, SQL_LOOKBACK_RECURSIVE),
        "known_history_sql": (q_known_history_sql, SQL_KNOWN_HISTORY),
        "ar_forecast_by_series": (q_ar_forecast_by_series, SQL_AR_FORECAST_BY_SERIES),
        "head_rows": (q_head_rows, SQL_HEAD_ROWS),
        "gather_rows": (q_gather_rows, SQL_GATHER_ROWS),
        "artifact_roundtrip": (q_artifact_roundtrip, SQL_ARTIFACT_ROUNDTRIP),
        "csv_roundtrip": (q_csv_roundtrip, SQL_CSV_ROUNDTRIP),
        "grid_search_summary": (q_grid_search_summary, None),
        "relief_classif": (q_relief_classif, SQL_RELIEF_CLASSIF),
        "mrmr_classif": (q_mrmr_classif, _mrmr_sql(SQL_MUTUAL_INFO_CLASSIF)),
        "elm_classifier": (q_elm_classifier, None),
        "acf_by_series": (q_acf_by_series, SQL_ACF_BY_SERIES),
        "lookback_validate": (q_lookback_validate, None),
        "known_history_score": (q_known_history_score, None),
    }
