"""Encoders and scalers (E1-E8): fit on training rows, then project.

Fitting is ONE aggregate pass: means / population std / min / max for the
scaled numerics and the sorted category sets for string columns whose plan
cardinality is small.  Projection is a single ``select`` of column
expressions (whole-stage codegen, no UDF, no shuffle):

* one-hot: ``(c = 'v')::double`` per sorted category, unknown ⇒ all zeros;
* ordinal: code = rank of the sorted category, unknown ⇒ -1.  Small
  vocabularies become a literal map lookup; large ones (> ``MAP_LIMIT``)
  become a code table built with the distributed row index and joined —
  broadcast only when its size (known from the plan) is under the
  broadcast threshold;
* standard: ``(x - mean) / std_pop`` (zero std ⇒ 1);
* min-max: ``(x - min) / (max - min)`` (zero range ⇒ 1, no clipping);
* passthrough remainder: cast to double (booleans become 0/1).

Output order: one-hot block, ordinal block, standard block, min-max block,
remainder — names unprefixed, one-hot as ``<col>_<value>``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import MIN_MAX, NONE, ONE_HOT, ORDINAL, STANDARD, plan_steps
from .rowindex import with_row_index

MAP_LIMIT = 4096  # categories held as a literal map; above, a code table is joined
BROADCAST_BYTES = 8 << 20  # code tables up to this measured size may be broadcast
MAX_ONE_HOT = 10_000  # columns that one-hot encoding of one variable may make


def refuse_wide_one_hot(df: DataFrame, columns) -> None:
    """Raises before any category reaches the driver if a variable has more than MAX_ONE_HOT."""
    if columns:
        row = df.agg(*[F.count_distinct(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        wide = [c for i, c in enumerate(columns) if row[f"n{i}"] > MAX_ONE_HOT]
        if wide:
            raise ValueError(f"One-hot encoding makes more than {MAX_ONE_HOT} columns for: " + ", ".join(wide))


def _scale_or_one(s):
    return 1.0 if s is None or s == 0 or s != s else float(s)


@dataclass
class Preprocessor:
    """A fitted ColumnTransformer equivalent (feature-sized state only)."""

    onehot: dict[str, list] = field(default_factory=dict)
    ordinal: dict[str, list] = field(default_factory=dict)
    ordinal_tables: dict[str, DataFrame] = field(default_factory=dict)
    standard: dict[str, tuple[float, float]] = field(default_factory=dict)
    minmax: dict[str, tuple[float, float]] = field(default_factory=dict)
    passthrough: list[str] = field(default_factory=list)
    order: dict[str, list[str]] = field(default_factory=dict)

    # ---- fit -----------------------------------------------------------
    @classmethod
    def fit(cls, df: DataFrame, plan, features=None) -> "Preprocessor":
        steps = plan_steps(plan) if isinstance(plan, DataFrame) else list(plan)
        if features is not None:
            keep = set(features)
            steps = [s for s in steps if s[0] in keep]
            feature_order = list(features)
        else:
            feature_order = [s[0] for s in steps]
        by_step: dict[str, list[tuple[str, int]]] = {}
        for var, _typ, step, uniq in steps:
            by_step.setdefault(step, []).append((var, uniq))
        onehot = [v for v, _ in by_step.get(ONE_HOT, [])]
        ordinal = by_step.get(ORDINAL, [])
        small_ord = [v for v, u in ordinal if u <= MAP_LIMIT]
        big_ord = [v for v, u in ordinal if u > MAP_LIMIT]
        std = [v for v, _ in by_step.get(STANDARD, [])]
        mm = [v for v, _ in by_step.get(MIN_MAX, [])]
        used = set(onehot) | {v for v, _ in ordinal} | set(std) | set(mm)
        remainder = [v for v in feature_order if v not in used]

        refuse_wide_one_hot(df, onehot)
        aggs: list[Column] = []
        for i, v in enumerate(onehot + small_ord):
            aggs.append(F.array_sort(F.collect_set(F.col(v))).alias(f"cat{i}"))
        for i, v in enumerate(std):
            x = F.col(v).cast("double")
            aggs += [F.avg(x).alias(f"mu{i}"), F.stddev_pop(x).alias(f"sd{i}")]
        for i, v in enumerate(mm):
            x = F.col(v).cast("double")
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        row = df.agg(*aggs).first() if aggs else None

        pre = cls()
        cats = onehot + small_ord
        for i, v in enumerate(cats):
            values = list(row[f"cat{i}"])
            if v in onehot:
                pre.onehot[v] = values
            else:
                pre.ordinal[v] = values
        for v in big_ord:
            distinct = df.select(F.col(v).alias("category")).distinct()
            ix = with_row_index(distinct, ["category"], "code")
            pre.ordinal_tables[v] = ix.df.select("category", F.col("code").cast("double").alias("code"))
        for i, v in enumerate(std):
            pre.standard[v] = (float(row[f"mu{i}"]), _scale_or_one(row[f"sd{i}"]))
        for i, v in enumerate(mm):
            lo, hi = float(row[f"lo{i}"]), float(row[f"hi{i}"])
            pre.minmax[v] = (lo, _scale_or_one(hi - lo))
        pre.passthrough = remainder
        pre.order = {
            "onehot": onehot,
            "ordinal": [v for v, _ in ordinal],
            "standard": std,
            "minmax": mm,
        }
        return pre

    # ---- projection ----------------------------------------------------
    def output_names(self) -> list[str]:
        names: list[str] = []
        for v in self.order.get("onehot", []):
            names += [f"{v}_{c}" for c in self.onehot[v]]
        names += self.order.get("ordinal", [])
        names += self.order.get("standard", [])
        names += self.order.get("minmax", [])
        names += self.passthrough
        return names

    def expressions(self) -> list[Column]:
        out: list[Column] = []
        for v in self.order.get("onehot", []):
            for c in self.onehot[v]:
                out.append((F.col(v) == F.lit(c)).cast("double").alias(f"{v}_{c}"))
        for v in self.order.get("ordinal", []):
            if v in self.ordinal:
                cats = self.ordinal[v]
                mapping = F.create_map(*[x for i, c in enumerate(cats) for x in (F.lit(c), F.lit(float(i)))]) if cats else None
                code = F.coalesce(F.element_at(mapping, F.col(v)), F.lit(-1.0)) if mapping is not None else F.lit(-1.0)
                out.append(code.alias(v))
            else:
                out.append(F.coalesce(F.col(f"_code_{v}"), F.lit(-1.0)).alias(v))
        for v in self.order.get("standard", []):
            mu, sd = self.standard[v]
            out.append(((F.col(v).cast("double") - F.lit(mu)) / F.lit(sd)).alias(v))
        for v in self.order.get("minmax", []):
            lo, rng = self.minmax[v]
            out.append(((F.col(v).cast("double") - F.lit(lo)) / F.lit(rng)).alias(v))
        for v in self.passthrough:
            out.append(F.col(v).cast("double").alias(v))
        return out

    def _join_code_tables(self, df: DataFrame) -> DataFrame:
        for v, table in self.ordinal_tables.items():
            t = table.select(F.col("category").alias(f"_cat_{v}"), F.col("code").alias(f"_code_{v}"))
            size = t.agg(F.sum(F.octet_length(F.col(f"_cat_{v}").cast("string")) + 32)).first()[0] or 0
            if size <= BROADCAST_BYTES:
                t = F.broadcast(t)
            df = df.join(t, df[v] == t[f"_cat_{v}"], "left").drop(f"_cat_{v}")
        return df

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        """Encoded columns, preceded by the pass-through columns in ``keep``."""
        if self.ordinal_tables:
            df = self._join_code_tables(df)
        return df.select(*[F.col(k) for k in keep], *self.expressions())

    # ---- persistence (IO4) ----------------------------------------------
    def to_json(self, allow_tables: bool = False) -> str:
        if self.ordinal_tables and not allow_tables:
            raise ValueError("Large ordinal vocabularies are saved as tables, not JSON.")
        return json.dumps(
            {
                "onehot": self.onehot,
                "ordinal": self.ordinal,
                "standard": self.standard,
                "minmax": self.minmax,
                "passthrough": self.passthrough,
                "order": self.order,
            }
        )

    @classmethod
    def from_json(cls, text: str) -> "Preprocessor":
        d = json.loads(text)
        return cls(
            onehot=d["onehot"],
            ordinal=d["ordinal"],
            standard={k: tuple(v) for k, v in d["standard"].items()},
            minmax={k: tuple(v) for k, v in d["minmax"].items()},
            passthrough=d["passthrough"],
            order=d["order"],
        )


# ---- target and series scalers (E6, E7) ----------------------------------

TARGET_SCALINGS = (NONE, STANDARD, MIN_MAX)


@dataclass(frozen=True)
class Scaler:
    """Affine scaler ``(y - shift) / scale``; identity for "None"."""

    kind: str = NONE
    shift: float = 0.0
    scale: float = 1.0

    @classmethod
    def fit(cls, df: DataFrame, column: str, kind: str) -> "Scaler":
        if kind not in TARGET_SCALINGS:
            raise ValueError(f"Unsupported target processing: {kind}")
        if kind == NONE:
            return cls()
        y = F.col(column).cast("double")
        if kind == STANDARD:
            r = df.agg(F.avg(y).alias("a"), F.stddev_pop(y).alias("b")).first()
            return cls(kind, float(r["a"]), _scale_or_one(r["b"]))
        r = df.agg(F.min(y).alias("a"), F.max(y).alias("b")).first()
        return cls(kind, float(r["a"]), _scale_or_one(float(r["b"]) - float(r["a"])))

    def apply(self, col) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return (c.cast("double") - F.lit(self.shift)) / F.lit(self.scale)

    def invert(self, col) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return c * F.lit(self.scale) + F.lit(self.shift)

    def apply_value(self, v: float) -> float:
        return (v - self.shift) / self.scale

    def invert_value(self, v: float) -> float:
        return v * self.scale + self.shift
