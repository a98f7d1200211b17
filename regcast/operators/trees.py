"""H1: regression trees grown on Spark, exact or on histograms.

**Exact trees** (``decision_tree``, ``extra_tree``, forests, ``bagging``,
``gradient_boosting``, ``adaboost``) try every split between two
neighbouring values, on the raw columns:

1. A node that fits a task (``SUBTREE_CELLS``) is grown there, with all that
   lies below it: one job routes the rows by (tree, node), each group sorts
   its columns once and grows level by level on prefix sums
   (``grow_exact``), and one row per group brings the subtree back. The
   number of jobs does not grow with the depth.
2. Nodes above that size are split by jobs over the whole table
   (``_TopPhase``), a bounded number of nodes a job. A first pass sums quantile
   bins. A split inside a bin moves part of its weight k and sum s to the
   left; the gain is convex in (k, s), and (k, s) lies in the parallelogram
   that the bin's smallest and largest targets allow, so the gain at its four
   corners bounds every split inside. Bins that could still win are cut finer,
   until their remaining values are few enough to be listed. The split found
   is the best of all, whatever the number of distinct values.

**Histogram trees** (``hist_gradient_boosting``, ``xgboost``, ``lightgbm``,
``catboost``) work on at most ``max_bins`` bins per feature, as these families
do. One grower serves both sizes: histograms come from one job per step, or
from one task where the whole table fits one. The larger child's histogram is
its parent's less its sibling's. Policies: depth-wise; best-first with a leaf
budget (a heap of gains; a step evaluates the children of all leaves that the
budget may still reach, so the number of jobs follows the depth, not the
leaves); symmetric (one condition per level).

Model size: a tree's nodes come to the driver while all trees together have
at most ``GATHER_NODES``. Beyond, subtrees stay a table and rows are scored by
sending them to their subtrees.

A table beyond a task, or of ``MERGE_ROWS`` rows of which half are equal to others, is
merged first where its distinct rows of features (or bins) fit a task: least squares
needs of equal rows their number and mean target only (``_merged``). Bootstrap draws and the weights of AdaBoost differ between equal
rows: there tasks sum them per kind of row (``RowKinds``). Where the distinct
rows do not fit a task either, the jobs over the whole table above do the work.

Boosting keeps the running prediction ``F`` as a column that is rewritten and
checkpointed every ``REFRESH`` trees, or ``TASK_ROUNDS`` of a table that fits a task. Randomness (bootstrap counts, thresholds)
comes from hashes of (seed, tree, row or path), so a refit gives the same model
on any partitioning, and the same tree whichever phase grows a node.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SEED = 42
REFRESH = 10
TASK_ROUNDS = 100  # boosting rounds of one task, where it holds the whole table
MERGE_ROWS = 10_000  # from so many rows on, equal rows are merged even where the table fits a task
ROWS_PER_PART = 50_000  # rows per task in scans of the whole table
SUBTREE_CELLS = 4_000_000  # rows x (features + 4) of a node that a task takes over
HIST_CELLS = 2_000_000  # histogram cells that one job brings to the driver
VALUE_ROWS = 500_000  # rows of the bins whose values are listed one by one
GATHER_NODES = 5_000_000  # nodes of a model kept on the driver (about 40 bytes each)
KIND_SUMS = 8_000_000  # sums of kinds of rows that a task keeps at once
CHUNK_ROWS = 200_000  # rows a task looks at together in the top phase
CUTS = 255  # inner cuts of a bin that is cut finer
TIE = 1e-10  # gains that differ by less (relative) are ties: lowest feature, then lowest value


# ------------------------------------------------------------------ model


class Tree:
    """A tree as arrays, one entry per node; ``feat`` is -1 at a leaf.

    A row goes left if its value is below ``thr_val`` (raw columns) or its bin at
    most ``thr_bin`` (binned columns).
    """

    FIELDS = (("feat", "<i4", -1), ("thr_bin", "<i4", 0), ("thr_val", "<f8", 0.0), ("left", "<i4", -1), ("right", "<i4", -1), ("value", "<f8", 0.0), ("depth", "<i4", 0))

    def __init__(self, **arrays):
        for name, kind, empty in self.FIELDS:
            setattr(self, name, np.asarray(arrays.get(name, [empty]), dtype=kind))

    def __len__(self) -> int:
        return len(self.feat)

    def pack(self) -> bytes:
        return b"".join(getattr(self, name).tobytes() for name, _, _ in self.FIELDS)

    @classmethod
    def unpack(cls, n: int, blob: bytes) -> Tree:
        out, at = {}, 0
        for name, kind, _ in cls.FIELDS:
            out[name] = np.frombuffer(blob, dtype=kind, count=n, offset=at)
            at += out[name].nbytes
        return cls(**out)

    def to_dict(self):
        return {"n": len(self), "nodes": base64.b64encode(zlib.compress(self.pack(), 1)).decode()}

    @classmethod
    def from_dict(cls, d):
        return cls.unpack(d["n"], zlib.decompress(base64.b64decode(d["nodes"])))

    def graft(self, subs: list[tuple[int, Tree]]) -> Tree:
        """This tree with its leaves ``node`` replaced by whole trees."""
        cols = {name: [getattr(self, name).copy()] for name, _, _ in self.FIELDS}
        size = len(self)
        for node, sub in subs:
            for name, _, _ in self.FIELDS:
                values = getattr(sub, name)
                if name in ("left", "right"):
                    values = np.where(values > 0, values + (size - 1), values)
                cols[name][0][node] = values[0]
                cols[name].append(values[1:])
            size += len(sub) - 1
        return Tree(**{name: np.concatenate(c) for name, c in cols.items()})


def _walk(tree: Tree, cols: np.ndarray, on_bins: bool) -> np.ndarray:
    """Leaf (or current node) index of every row; ``cols`` is (n, p)."""
    thr = tree.thr_bin if on_bins else tree.thr_val
    node = np.zeros(cols.shape[0], dtype=np.int64)
    live = np.arange(cols.shape[0])
    while True:
        at = node[live]
        inner = tree.feat[at] >= 0
        live, at = live[inner], at[inner]
        if not live.size:
            return node
        x = cols[live, tree.feat[at]]
        go_left = x <= thr[at] if on_bins else x < thr[at]
        node[live] = np.where(go_left, tree.left[at], tree.right[at])


@dataclass
class TreeEnsemble:
    features: list
    trees: list
    weights: list  # per-tree multiplier (learning rate)
    init: float = 0.0
    combine: str = "sum"  # "sum" (boosting) or "mean" (forests)
    extra: dict = field(default_factory=dict)
    subtrees: DataFrame | None = None  # t, node, n, blob of every leaf of ``trees``, where they are too many to gather

    def predict_numpy(self, X: np.ndarray) -> np.ndarray:
        if self.subtrees is not None:
            raise ValueError("This model's subtrees are a table; score rows with transform.")
        X = np.asarray(X, dtype=float)
        out = np.zeros(X.shape[0])
        for t, w in zip(self.trees, self.weights):
            out += w * t.value[_walk(t, X, on_bins=False)]
        if self.combine == "mean":
            return out / max(len(self.trees), 1)
        return out + self.init

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        if self.subtrees is not None:
            return self._transform_routed(df, output)
        feats = list(self.features)
        model = df.sparkSession.sparkContext.broadcast(self)  # at most GATHER_NODES nodes

        @F.pandas_udf("double")
        def score(cols: pd.DataFrame) -> pd.Series:
            return pd.Series(model.value.predict_numpy(cols[feats].to_numpy(dtype=float)))

        return df.withColumn(output, score(F.struct(*[F.col(c).cast("double").alias(c) for c in feats])))

    def _transform_routed(self, df: DataFrame, output: str) -> DataFrame:
        """Rows meet their subtrees in a shuffle by (tree, leaf of its top).

        A leaf asked for by more than ``ROWS_PER_PART`` rows is split: its rows
        are dealt over copies of that one subtree. A task streams through its
        rows behind the subtree they need, so it holds one subtree at a time.
        """
        p, n_trees = len(self.features), len(self.trees)
        tops = df.sparkSession.sparkContext.broadcast(self.trees)
        keyed = materialize(df.withColumn("_row", F.monotonically_increasing_id()))  # ids that survive a lost executor
        cols = keyed.select(F.col("_row"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(self.features)])
        xs = ", ".join(f"x{j} double" for j in range(p))

        def route(batches):
            for b in batches:
                X = _matrix(b, p)
                for t, top in enumerate(tops.value):
                    node = _walk(top, X, on_bins=False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(node), t, dtype=np.int64)), pa.array(node), b.column("_row"), *[pa.array(X[:, j]) for j in range(p)]],
                        names=["t", "node", "_row", *[f"x{j}" for j in range(p)]],
                    )

        asked = cols.mapInArrow(route, f"t long, node long, _row long, {xs}")
        copies = asked.groupBy("t", "node").agg(F.ceil(F.count("*") / ROWS_PER_PART).alias("copies"))
        model = self.subtrees.join(copies, ["t", "node"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        hot = copies.filter("copies > 1")
        rows = asked.join(hot, ["t", "node"], "left").withColumn("part", F.pmod(F.xxhash64("_row"), F.coalesce("copies", F.lit(1))))
        both = model.select("t", "node", "part", F.lit(-1).cast("long").alias("_row"), *[F.lit(0.0).alias(f"x{j}") for j in range(p)], "n", "blob").unionByName(
            rows.select("t", "node", "part", "_row", *[f"x{j}" for j in range(p)], F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("blob"))
        )

        def score(batches):
            tree = None
            for b in batches:
                row, n, blob, X = b.column("_row").to_numpy(), b.column("n").to_numpy(), b.column("blob"), _matrix(b, p)
                heads = np.flatnonzero(row < 0)
                cuts = np.concatenate([[0], heads, [len(row)]])
                for a, z in zip(cuts[:-1], cuts[1:]):
                    if a < z and row[a] < 0:
                        tree = Tree.unpack(int(n[a]), blob[int(a)].as_py())
                        a += 1
                    if a < z:
                        yield pa.RecordBatch.from_arrays([pa.array(row[a:z]), pa.array(tree.value[_walk(tree, X[a:z], on_bins=False)])], names=["_row", "value"])

        met = both.repartition("t", "node", "part").sortWithinPartitions("t", "node", "part", "_row")
        total = met.mapInArrow(score, "_row long, value double").groupBy("_row").agg(F.sum("value").alias(output))
        return keyed.join(total.withColumn(output, F.col(output) / F.lit(float(n_trees))), "_row").drop("_row")

    def to_dict(self):
        if self.subtrees is not None:
            raise ValueError("This model's subtrees are a table; it has no JSON form.")
        return {
            "kind": "trees",
            "class": "regcast.operators.trees.TreeEnsemble",
            "features": self.features,
            "trees": [t.to_dict() for t in self.trees],
            "weights": list(self.weights),
            "init": self.init,
            "combine": self.combine,
            "extra": self.extra,
        }

    @classmethod
    def from_dict(cls, d):
        return cls(d["features"], [Tree.from_dict(t) for t in d["trees"]], d["weights"], d["init"], d["combine"], d.get("extra", {}))

    def to_json(self):
        return json.dumps(self.to_dict())


def _col(b, name):
    return b.column(name).to_numpy(zero_copy_only=False).astype(float)


def _matrix(b, p: int, prefix: str = "x") -> np.ndarray:
    """Columns x0.. (or b0..) of a batch as an (n, p) array."""
    return np.column_stack([b.column(f"{prefix}{j}").to_numpy(zero_copy_only=False) for j in range(p)])


# ---------------------------------------------------------------- binning


def bin_edges(df: DataFrame, features, max_bins: int = 255) -> list[np.ndarray]:
    """Cut points per feature: midpoints of the distinct values when there
    are at most ``max_bins`` of them, else approximate quantiles."""
    cnt = df.agg(*[F.approx_count_distinct(F.col(f)).alias(f"d{i}") for i, f in enumerate(features)]).first()
    edges: list[np.ndarray | None] = [None] * len(features)
    low = [i for i, f in enumerate(features) if cnt[f"d{i}"] <= max_bins]
    if low:
        # exact distinct sets (each bounded by max_bins, checked above)
        row = df.agg(*[F.array_sort(F.collect_set(F.col(features[i]).cast("double"))).alias(f"v{i}") for i in low]).first()
        for i in low:
            v = np.asarray(row[f"v{i}"], dtype=float)
            if len(v) <= max_bins:
                edges[i] = (v[:-1] + v[1:]) / 2.0
    high = [i for i in range(len(features)) if edges[i] is None]
    if high:
        probs = [k / max_bins for k in range(1, max_bins)]
        qs = df.approxQuantile([features[i] for i in high], probs, 1e-4)
        for i, q in zip(high, qs):
            edges[i] = np.unique(np.asarray(q, dtype=float))
    return edges


def _binned(df: DataFrame, features, edges) -> DataFrame:
    """Bin columns ``b0..`` by the JVM ``Bucketizer`` (binary search per value)."""
    from pyspark.ml.feature import Bucketizer

    tmp = [f"_x{j}" for j in range(len(features))]
    out = df.select(*[F.col(f).cast("double").alias(t) for f, t in zip(features, tmp)], *df.columns)
    splits = [[-float("inf"), *[float(v) for v in e], float("inf")] for e in edges]
    bz = Bucketizer(splitsArray=splits, inputCols=tmp, outputCols=[f"_q{j}" for j in range(len(features))])
    out = bz.transform(out)
    return out.select(*[F.col(f"_q{j}").cast("int").alias(f"b{j}") for j in range(len(features))], *df.columns)


def _row_uniform(rowid: np.ndarray, tree: int, seed: int) -> np.ndarray:
    x = rowid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 7919 + seed) & 0xFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _poisson_counts(u: np.ndarray, lam: float) -> np.ndarray:
    """Inverse-CDF Poisson(lam) counts from uniforms (bootstrap weights)."""
    out = np.zeros(u.shape[0])
    p = np.exp(-lam)
    cdf = p
    k = 0
    while k < 60:
        out += u > cdf
        k += 1
        p *= lam / k
        cdf += p
    return out


# ----------------------------------------------------- exact trees in a task


@dataclass
class GrowSpec:
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_child_weight: float = 0.0
    reg_lambda: float = 0.0
    max_leaf_nodes: int | None = None
    policy: str = "depth"  # depth | random | leaves | symmetric
    col_fraction: float = 1.0

    @property
    def depth_cap(self) -> float:
        return float("inf") if self.max_depth is None or self.max_depth < 0 else int(self.max_depth)


def _mix(x) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (wrapping arithmetic)."""
    x = np.atleast_1d(np.asarray(x, dtype=np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _child_keys(keys) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the left and right children: they name a node by its path alone."""
    keys = np.atleast_1d(np.asarray(keys, dtype=np.uint64))
    return _mix(keys * np.uint64(2)), _mix(keys * np.uint64(2) + np.uint64(1))


def _root_key(seed: int, tree: int) -> np.uint64:
    return _mix(_mix(np.uint64(seed))[0] ^ np.uint64(tree))[0]


def _draw(keys, feature: int) -> np.ndarray:
    """A uniform number in [0, 1) for each (node key, feature)."""
    return (_mix(np.atleast_1d(np.asarray(keys, dtype=np.uint64)) ^ _mix(np.uint64(feature + 1))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _threshold(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The midpoint as a strict bound: x < result holds for x <= midpoint only, so for ``low`` and not for ``high``."""
    mid = low / 2 + high / 2
    mid = np.where((mid >= low) & (mid < high), mid, low)
    return np.nextafter(mid, np.inf)


def _drawn(low: np.ndarray, high: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A threshold between a node's smallest and largest value: x <= result goes left."""
    t = low + u * (high - low)
    return np.where((t >= low) & (t < high), t, low)


def grow_exact(X: np.ndarray, y: np.ndarray, weight: np.ndarray, count: np.ndarray, spec: GrowSpec, depth: int = 0, key=np.uint64(0)) -> Tree:
    """The whole subtree over these rows: every split between neighbouring values is tried.

    All nodes of a level are handled together: each column stays sorted within
    its node (a stable partition keeps it so), targets are centred on their
    node's mean, and prefix sums give the gain S² · W / (W_left · W_right) of
    every position. A node stops when its targets are equal, at the depth
    limit, or where no position is allowed.
    """
    p = X.shape[1]
    order = [np.argsort(X[:, f], kind="stable") for f in range(p)]
    out = {name: [] for name, _, _ in Tree.FIELDS}
    starts, ids, keys = np.array([0]), np.array([0]), np.atleast_1d(np.uint64(key))
    size, n_nodes = np.array([len(y)]), 1
    levels: list[dict] = []
    slot, centred = np.zeros(len(y), dtype=np.int64), np.zeros(len(y))
    while True:
        rows = order[0]
        seg = np.repeat(np.arange(len(starts)), size)
        W = np.add.reduceat(weight[rows], starts)
        C = np.add.reduceat(count[rows], starts)
        mean = np.add.reduceat((weight * y)[rows], starts) / W
        k = len(ids)
        level = {"feat": np.full(k, -1), "thr_val": np.zeros(k), "left": np.full(k, -1), "right": np.full(k, -1), "value": mean, "depth": np.full(k, depth)}
        levels.append(level)
        pure = np.minimum.reduceat(y[rows], starts) == np.maximum.reduceat(y[rows], starts)
        can = ~pure & (C >= spec.min_samples_split) & (depth < spec.depth_cap)
        if not can.any():
            break
        slot[rows] = seg
        centred[rows] = weight[rows] * (y[rows] - mean[seg])
        best = np.full((p, k), -1.0)
        at = np.zeros((p, k), dtype=np.int64)
        drawn = np.zeros((p, k))
        last = starts + size - 1
        for f in range(p):
            idx = order[f]
            x = X[idx, f]
            SL, WL, CL = (np.cumsum(v[idx]) for v in (centred, weight, count))
            before = np.where(starts > 0, starts - 1, 0)
            for v in (SL, WL, CL):
                v -= np.where(starts > 0, v[before], 0.0)[seg]
            WR = W[seg] - WL
            ok = np.zeros(len(x), dtype=bool)
            ok[:-1] = x[:-1] < x[1:]
            ok[last] = False
            ok &= (CL >= spec.min_samples_leaf) & (C[seg] - CL >= spec.min_samples_leaf) & (WL > 0) & (WR > 0) & can[seg]
            if spec.policy == "random":
                drawn[f] = _drawn(x[starts], x[last], _draw(keys, f))
                below = np.add.reduceat((x <= drawn[f][seg]).astype(np.int64), starts)
                chosen = np.zeros(len(x), dtype=bool)
                chosen[starts + np.maximum(below, 1) - 1] = True
                ok &= chosen
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, SL * SL * W[seg] / (WL * WR), -1.0)
            best[f] = np.maximum.reduceat(gain, starts)
            hits = np.flatnonzero(ok & (gain >= (best[f] * (1 - TIE))[seg]))
            if hits.size:
                first = np.minimum(np.searchsorted(seg[hits], np.arange(k)), len(hits) - 1)
                at[f] = hits[first]
        top = best.max(axis=0)
        split = can & (top >= 0)
        if not split.any():
            break
        f_of = np.argmax(best >= top * (1 - TIE), axis=0)
        pos = at[f_of, np.arange(k)]
        low, high = np.zeros(k), np.zeros(k)
        for f in range(p):
            mine = split & (f_of == f)
            low[mine], high[mine] = X[order[f][pos[mine]], f], X[order[f][np.minimum(pos[mine] + 1, len(rows) - 1)], f]
        if spec.policy == "random":
            low = drawn[f_of, np.arange(k)]
            thr = np.nextafter(low, np.inf)
        else:
            thr = _threshold(low, high)
        where = np.flatnonzero(split)
        child = n_nodes + 2 * np.arange(len(where))
        level["feat"][where], level["thr_val"][where] = f_of[where], thr[where]
        level["left"][where], level["right"][where] = child, child + 1
        n_nodes += 2 * len(where)
        # stable partition of every column into the children of the nodes that split
        kept = split[seg]
        rank = np.cumsum(split) - 1
        goes = np.zeros(len(y), dtype=bool)
        live = rows[kept]
        goes[live] = X[live, f_of[slot[live]]] <= low[slot[live]]
        n_left = np.add.reduceat(goes[rows].astype(np.int64), starts)[where]
        pair = np.stack([n_left, size[where] - n_left], axis=1).ravel()
        new_starts = np.concatenate([[0], np.cumsum(pair)[:-1]])
        for f in range(p):
            idx = order[f][kept]
            left = goes[idx]
            s = rank[seg[kept]]
            counted = np.cumsum(left)
            base = np.concatenate([[0], counted])[new_starts[::2]]
            left_rank = counted - base[s] - 1
            place = np.arange(len(idx)) - new_starts[::2][s]
            target = np.where(left, new_starts[::2][s] + left_rank, new_starts[1::2][s] + place - (left_rank + 1))
            moved = np.empty_like(idx)
            moved[target] = idx
            order[f] = moved
        left_keys, right_keys = _child_keys(keys[where])
        keys = np.stack([left_keys, right_keys], axis=1).ravel()
        ids = np.stack([child, child + 1], axis=1).ravel()
        starts, size, depth = new_starts, pair, depth + 1
    for name in ("feat", "thr_val", "left", "right", "value", "depth"):
        out[name] = np.concatenate([lv[name] for lv in levels])
    out["thr_bin"] = np.zeros(n_nodes)
    return Tree(**out)


# --------------------------------------- exact trees: nodes larger than a task


class _Top:
    """The part of a tree that jobs over the whole table grow: node lists on the driver."""

    def __init__(self, key, n_rows: int):
        self.feat, self.thr_val, self.left, self.right, self.value, self.depth = [-1], [0.0], [-1], [-1], [0.0], [0]
        self.key, self.rows = [key], [n_rows]

    def split(self, node: int, f: int, thr: float, rows: tuple[int, int]) -> tuple[int, int]:
        first = len(self.feat)
        for key, n in zip(_child_keys(self.key[node]), rows, strict=True):
            self.feat.append(-1)
            self.thr_val.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(0.0)
            self.depth.append(self.depth[node] + 1)
            self.key.append(key[0])
            self.rows.append(n)
        self.feat[node], self.thr_val[node], self.left[node], self.right[node] = f, thr, first, first + 1
        return first, first + 1

    def tree(self) -> Tree:
        return Tree(feat=self.feat, thr_val=self.thr_val, left=self.left, right=self.right, value=self.value, depth=self.depth, thr_bin=np.zeros(len(self.feat)))


@dataclass
class _Span:
    """Rows of a node whose feature lies in [low, high], cut at ``cuts``, with what lies left of it."""

    t: int
    node: int
    f: int
    low: float
    high: float
    cuts: np.ndarray | None  # None: one cell per value
    n: float = 0.0
    before: np.ndarray = field(default_factory=lambda: np.zeros(4))  # weight, sum, count, rows


CELL = ("w", "s", "c", "n")  # weight, weighted target, count, rows: summed per cell
CELL_SCHEMA = "k long, bin long, x double, w double, s double, c double, n double, y0 double, y1 double, x0 double, x1 double"


def _ordered_bits(x: float) -> int:
    """Doubles as integers in the same order."""
    b = int(np.float64(x).view(np.int64))
    return b if b >= 0 else -(b & 0x7FFFFFFFFFFFFFFF)


def _from_bits(b: int) -> float:
    return float(np.int64(b).view(np.float64)) if b >= 0 else -float(np.int64(-b).view(np.float64))


def _finer(low: float, high: float) -> np.ndarray:
    """At most ``CUTS`` cuts in [low, high), evenly spread over the doubles between; a few passes reach single values."""
    a, b = _ordered_bits(low), _ordered_bits(high)
    return np.unique([_from_bits(a + (b - a) * j // (CUTS + 1)) for j in range(CUTS + 1)])


class _TopPhase:
    """Exact splits of nodes that do not fit a task."""

    def __init__(self, data: DataFrame, p: int, spec: GrowSpec, rows_fn, weight_fn, shift: float):
        self.data, self.p, self.spec, self.rows_fn, self.weight_fn, self.shift = data, p, spec, rows_fn, weight_fn, shift
        self.edges = None

    def coarse(self) -> list[np.ndarray]:
        if self.edges is None:
            probs = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
            self.edges = [np.unique(np.asarray(q, dtype=float)) for q in self.data.approxQuantile([f"x{j}" for j in range(self.p)], probs, 1e-3)]
        return self.edges

    def cells(self, tops: list[_Top], spans: list[_Span]) -> pd.DataFrame:
        """Sums per (span, bin) or, where a span has no cuts, per (span, value)."""
        p, rows_fn, weight_fn, shift = self.p, self.rows_fn, self.weight_fn, self.shift
        trees = {s.t: tops[s.t].tree() for s in spans}
        wanted: dict[int, dict[int, list]] = {}
        for k, s in enumerate(spans):
            wanted.setdefault(s.t, {}).setdefault(s.node, []).append((k, s.f, s.low, s.high, s.cuts))

        def summed(parts):
            cols = [np.concatenate(c) for c in zip(*parts)]
            order = np.lexsort((cols[2], cols[1], cols[0]))
            cols = [c[order] for c in cols]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            first = np.flatnonzero(new)
            ops = [None, None, None, np.add, np.add, np.add, np.add, np.minimum, np.maximum, np.minimum, np.maximum]
            return [c[first] if op is None else op.reduceat(c, first) for c, op in zip(cols, ops, strict=True)]

        def look(X, y, h, rid):
            for t, nodes in wanted.items():
                count = weight_fn(rid, t)
                used = np.flatnonzero(count > 0)
                at = _walk(trees[t], X[used], on_bins=False)
                order = np.argsort(at, kind="stable")
                used, at = used[order], at[order]
                for node, spans_here in nodes.items():
                    a, z = np.searchsorted(at, [node, node + 1])
                    rows = used[a:z]
                    for k, f, low, high, cuts in spans_here if rows.size else ():
                        x = X[rows, f]
                        inside = np.flatnonzero((x >= low) & (x <= high))
                        if not inside.size:
                            continue
                        x, r = x[inside], rows[inside]
                        b = np.zeros(len(x), dtype=np.int64) if cuts is None else np.searchsorted(cuts, x, side="left")
                        value = x if cuts is None else np.zeros(len(x))
                        c = count[r]
                        w = h[r] * c
                        yield summed([(np.full(len(x), k), b, value, w, w * (y[r] - shift), c, np.ones(len(x)), y[r], y[r], x, x)])

        def part(batches):
            held, parts, size = [], [], 0

            def flush():
                nonlocal parts
                X, y, h, rid = (np.concatenate(c) for c in zip(*held))
                parts += list(look(X, y, h, rid))
                held.clear()
                if parts:
                    parts = [summed(parts)]

            for b in batches:
                held.append((_matrix(b, p), *rows_fn(b), b.column("_rid").to_numpy(zero_copy_only=False)))
                size += b.num_rows
                if size >= CHUNK_ROWS:
                    flush()
                    size = 0
            if held:
                flush()
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0]], names=[c.split()[0] for c in CELL_SCHEMA.split(", ")])

        low, high = [F.min(c).alias(c) for c in ("y0", "x0")], [F.max(c).alias(c) for c in ("y1", "x1")]
        return self.data.mapInArrow(part, CELL_SCHEMA).groupBy("k", "bin", "x").agg(*[F.sum(c).alias(c) for c in CELL], *low, *high).orderBy("k", "bin", "x").toPandas()

    def splits(self, tops: list[_Top], group: list[tuple[int, int]]) -> dict:
        """(value, rows, best split or None) of every node of the group; a split is (feature, threshold, rows left)."""
        spec = self.spec
        random = spec.policy == "random"
        edges = [np.empty(0)] * self.p if random else self.coarse()
        spans = [_Span(t, node, f, -np.inf, np.inf, edges[f]) for t, node in group for f in range(self.p)]
        first = self.cells(tops, spans)
        by_span = dict(iter(first.groupby("k")))
        facts: dict = {}
        for k, s in enumerate(spans):
            if s.f == 0:
                own = by_span[k]
                w, total, c, n = (float(own[x].sum()) for x in CELL)
                stop = own["y0"].min() == own["y1"].max() or c < spec.min_samples_split or tops[s.t].depth[s.node] >= spec.depth_cap
                facts[s.t, s.node] = {"w": w, "c": c, "n": n, "mean": total / w, "stop": stop, "found": []}
        if random:
            spans = [
                _Span(s.t, s.node, s.f, -np.inf, np.inf, _drawn(own["x0"].to_numpy(), own["x1"].to_numpy(), _draw(tops[s.t].key[s.node], s.f)))
                for s, own in ((s, by_span[k]) for k, s in enumerate(spans)) if not facts[s.t, s.node]["stop"] and own["x0"].iloc[0] < own["x1"].iloc[0]
            ]
            by_span = dict(iter(self.cells(tops, spans).groupby("k"))) if spans else {}
        spans = [(s, by_span[k]) for k, s in enumerate(spans) if not facts[s.t, s.node]["stop"]]
        while spans:
            open_spans = [x for s, own in spans for x in self.search(s, own, facts[s.t, s.node])]
            live = [s for s, bound in open_spans if not random and bound >= self.best(facts[s.t, s.node]) * (1 - 10 * TIE)]
            spans = []
            listed = sum(s.n for s in live) <= VALUE_ROWS
            step = len(live) if listed else max(1, HIST_CELLS // (CUTS + 1))
            for a in range(0, len(live), max(step, 1)):
                some = live[a : a + step]
                for s in some:
                    s.cuts = None if listed else _finer(s.low, s.high)
                by_span = dict(iter(self.cells(tops, some).groupby("k")))
                spans += [(s, by_span[k]) for k, s in enumerate(some)]
        out = {}
        for at, fact in facts.items():
            # ties as in ``grow_exact``: the lowest feature, then the lowest value among its own best
            f_best = min((f for gain, f, *_ in fact["found"] if gain >= self.best(fact) * (1 - TIE)), default=None)
            mine = [x for x in fact["found"] if x[1] == f_best]
            found = sorted(x[2:] for x in mine if x[0] >= max(x[0] for x in mine) * (1 - TIE))
            out[at] = (fact["mean"] + self.shift, (f_best, found[0][1], int(found[0][2])) if found else None)
        return out

    @staticmethod
    def best(fact: dict) -> float:
        return max((x[0] for x in fact["found"]), default=-1.0)

    def search(self, s: _Span, own: pd.DataFrame, fact: dict) -> list[tuple[_Span, float]]:
        """Notes the splits between the cells of a span and returns its cells that hold more, each with its bound."""
        spec, W, C, N = self.spec, fact["w"], fact["c"], fact["n"]
        w, total, c, n = (own[x].to_numpy() for x in CELL)
        centred = total - fact["mean"] * w
        sums = np.stack([w, centred, c, n])
        upto = s.before[:, None] + np.cumsum(sums, axis=1)
        x0, x1 = own["x0"].to_numpy(), own["x1"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = upto[1] ** 2 * W / (upto[0] * (W - upto[0]))
        ok = (upto[2] >= spec.min_samples_leaf) & (C - upto[2] >= spec.min_samples_leaf) & (upto[3] < N) & (upto[0] > 0) & (upto[0] < W)
        ok[-1] = False  # a span's last cell ends where the coarser pass has looked
        i = np.flatnonzero(ok)
        if i.size:
            thr = np.nextafter(s.cuts[own["bin"].to_numpy()[i]], np.inf) if spec.policy == "random" else _threshold(x1[i], x0[i + 1])
            keep = gain[i] >= max(self.best(fact), gain[i].max()) * (1 - 10 * TIE)
            fact["found"] += [(float(g), s.f, float(x), float(b), float(m)) for g, x, b, m in zip(gain[i][keep], x1[i][keep], thr[keep], upto[3][i][keep], strict=True)]
        wide = np.flatnonzero(x0 < x1)
        if spec.policy == "random" or not wide.size:
            return []
        before = upto - sums
        y0, y1 = own["y0"].to_numpy() - self.shift - fact["mean"], own["y1"].to_numpy() - self.shift - fact["mean"]
        bound = np.full(len(w), -1.0)
        span = np.maximum(y1 - y0, 1e-300)
        corners = [(np.zeros_like(w), np.zeros_like(w)), (w, centred)]
        k = np.clip((centred - w * y0) / span, 0, w)
        corners.append((k, k * y1))
        k = np.clip((w * y1 - centred) / span, 0, w)
        corners.append((k, k * y0))
        for k, part in corners:
            left, moved = before[0] + k, before[1] + part
            with np.errstate(divide="ignore", invalid="ignore"):
                bound = np.maximum(bound, np.where((left > 0) & (left < W), moved**2 * W / (left * (W - left)), np.where(np.abs(moved) > 0, np.inf, 0.0)))
        # rounding of the sums must not hide a split
        bound = bound * (1 + 1e-9) + 1e-12 * np.abs(fact["mean"]) ** 2
        return [(_Span(s.t, s.node, s.f, x0[j], x1[j], None, float(n[j]), before[:, j].copy()), float(bound[j])) for j in wide]


def _grow_exact_trees(data: DataFrame, p: int, n_rows: int, n_trees: int, spec: GrowSpec, rows_fn, weight_fn, seed: int = 0, shift: float = 0.0):
    """Trees over ``data`` (x0.., _rid and what ``rows_fn`` reads): a list, or (tops, table of subtrees) beyond ``GATHER_NODES``."""
    limit = max(2, SUBTREE_CELLS // (p + 4))
    tops = [_Top(_root_key(seed, t), n_rows) for t in range(n_trees)]
    big = [(t, 0) for t in range(n_trees) if n_rows > limit]
    phase = _TopPhase(data, p, spec, rows_fn, weight_fn, shift)
    done: set = set()
    step = max(1, HIST_CELLS // (p * (CUTS + 1)))
    while big:
        found = {}
        for a in range(0, len(big), step):
            found |= phase.splits(tops, big[a : a + step])
        big = []
        for (t, node), (value, split) in found.items():
            tops[t].value[node] = value
            if split is None:
                done.add((t, node))
                continue
            f, thr, n_left = split
            for child in tops[t].split(node, f, thr, (n_left, tops[t].rows[node] - n_left)):
                if tops[t].rows[child] > limit:
                    big.append((t, child))
    open_nodes = [(t, node) for t, top in enumerate(tops) for node, f in enumerate(top.feat) if f < 0 and (t, node) not in done]
    trees = [top.tree() for top in tops]
    if not open_nodes:
        return trees, None
    table = _subtrees(data, p, trees, tops, open_nodes, spec, rows_fn, weight_fn)
    ends = [(t, node, Tree(value=[tops[t].value[node]], depth=[tops[t].depth[node]])) for t, node in done]
    most = sum(min(2 * tops[t].rows[node], 2 ** min(spec.depth_cap - tops[t].depth[node] + 1, 60)) for t, node in open_nodes)
    return _gathered(table, trees, ends, most)


def _gathered(table: DataFrame, trees: list[Tree], ends: list[tuple], most: float):
    """The whole trees from a table of subtrees, or (trees, table) where their nodes are more than ``GATHER_NODES``."""
    if most > GATHER_NODES:
        table = materialize(table)
        if table.agg(F.sum("n")).first()[0] > GATHER_NODES:
            leaves = [(t, node, len(leaf), bytearray(leaf.pack())) for t, node, leaf in ends]
            return trees, table.unionByName(table.sparkSession.createDataFrame(leaves, table.schema)) if leaves else table
    grown: dict[int, list] = {}
    for r in table.collect():
        grown.setdefault(r["t"], []).append((r["node"], Tree.unpack(r["n"], r["blob"])))
    return [tree.graft(sorted(grown.get(t, []), key=lambda x: x[0])) for t, tree in enumerate(trees)], None


def _subtrees(data: DataFrame, p: int, trees: list[Tree], tops: list[_Top], nodes: list[tuple[int, int]], spec: GrowSpec, rows_fn, weight_fn) -> DataFrame:
    """t, node, n, blob: one subtree per open node, each grown in one task from at most ``SUBTREE_CELLS`` cells."""
    open_by_tree: dict[int, np.ndarray] = {}
    for t, node in nodes:
        open_by_tree.setdefault(t, []).append(node)
    open_by_tree = {t: np.array(sorted(v)) for t, v in open_by_tree.items()}
    names = ["t", "node", "_rid", "y", "w", "c", *[f"x{j}" for j in range(p)]]
    sent = data.sparkSession.sparkContext.broadcast(({t: trees[t] for t in open_by_tree}, {(t, node): (tops[t].key[node], tops[t].depth[node]) for t, node in nodes}))

    def route(batches):
        walked = sent.value[0]
        for b in batches:
            X, (y, h), rid = _matrix(b, p), rows_fn(b), b.column("_rid").to_numpy(zero_copy_only=False)
            for t, mine in open_by_tree.items():
                count = weight_fn(rid, t) * _rows_of(b)
                node = _walk(walked[t], X, on_bins=False)
                r = np.flatnonzero((count > 0) & np.isin(node, mine))
                if r.size:
                    cols = [np.full(len(r), t, dtype=np.int64), node[r], rid[r], y[r], (h * count)[r], count[r].astype(float), *[X[r, j] for j in range(p)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def grow(table: pa.Table) -> list:
        t, node = table["t"][0].as_py(), table["node"][0].as_py()
        order = np.argsort(table["_rid"].to_numpy(), kind="stable")  # sums in one order, whatever the partitioning
        cols = [table[c].to_numpy()[order] for c in names[3:]]
        key, depth = sent.value[1][t, node]
        tree = grow_exact(np.column_stack(cols[3:]), *cols[:3], spec, depth, key)
        return [pa.array([t]), pa.array([node]), pa.array([len(tree)]), pa.array([tree.pack()], pa.binary())]

    out = ["t", "node", "n", "blob"]
    if len(nodes) == 1:  # one group: no shuffle is needed to bring it together

        def whole(batches):
            found = list(route(batches))
            if found:
                yield pa.RecordBatch.from_arrays(grow(pa.Table.from_batches(found)), names=out)

        return data.coalesce(1).mapInArrow(whole, "t long, node long, n long, blob binary")
    spark = data.sparkSession
    rows = sum(tops[t].rows[node] for t, node in nodes)
    limit = max(2, SUBTREE_CELLS // (p + 4))
    parts = min(len(nodes), max(4 * spark.sparkContext.defaultParallelism, ceil(rows / limit)))
    routed = data.mapInArrow(route, "t long, node long, _rid long, y double, w double, c double, " + ", ".join(f"x{j} double" for j in range(p)))
    return routed.repartition(parts, "t", "node").groupBy("t", "node").applyInArrow(lambda g: pa.Table.from_arrays(grow(g), names=out), "t long, node long, n long, blob binary")


# ------------------------------------------------------------ histogram trees


def _uniform(*key: int) -> float:
    """A uniform draw from the first 32 bits of the MD5 of the key."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16) / float(1 << 32)


def _columns_of_tree(level_seed: int, tree: int, p: int, fraction: float) -> list[int]:
    """Exactly ceil(fraction * p) columns: those with the smallest draws for this tree."""
    draw = sorted((_uniform(SEED, level_seed // 1000, tree, f), f) for f in range(p))
    return sorted(f for _, f in draw[: max(1, ceil(fraction * p - 1e-9))])


def _offsets(edges: list[np.ndarray]) -> np.ndarray:
    """Where each feature's bins start in a row of cells; the last entry is their number."""
    return np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64)


def histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, nodes: list[int], offsets: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Sums of g, h and rows per (node of ``nodes``, cell): an array (nodes, 3, cells); a cell is a bin of a feature.

    ``rows`` tells how many rows each stands for (one without it)."""
    k = len(nodes)
    by_id = np.argsort(nodes)
    sorted_nodes = np.asarray(nodes)[by_id]
    slot = np.minimum(np.searchsorted(sorted_nodes, node), k - 1)
    r = np.flatnonzero(sorted_nodes[slot] == node)
    slot = by_id[slot[r]]
    values = (g[r], h[r], None if rows is None else rows[r])
    out = np.empty((k, 3, int(offsets[-1])))
    for f, (a, z) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        at = slot * (z - a) + bins[r, f]
        for i, v in enumerate(values):
            out[:, i, a:z] = np.bincount(at, weights=v, minlength=k * (z - a)).reshape(k, z - a)
    return out


class _LocalHistograms:
    """Histograms of rows that one task holds."""

    def __init__(self, bins, g, h, offsets, rows=None):
        self.bins, self.g, self.h, self.offsets, self.rows = bins, g, h, offsets, rows

    def __call__(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        return histograms(self.bins, self.g, self.h, _walk(tree, self.bins, on_bins=True), nodes, self.offsets, self.rows)


class _SparkHistograms:
    """Histograms by one job: a task sums its rows into one partial histogram, Spark sums the cells that are not empty."""

    def __init__(self, data: DataFrame, p: int, offsets: np.ndarray, grad_fn):
        self.data, self.p, self.offsets, self.grad_fn = data, p, offsets, grad_fn

    def partials(self, tree: Tree, nodes: list[int]) -> DataFrame:
        p, offsets, grad_fn = self.p, self.offsets, self.grad_fn

        def part(batches):
            total = None
            for b in batches:
                bins = _matrix(b, p, "b").astype(np.int64)
                g, h = grad_fn(b)
                own = histograms(bins, g, h, _walk(tree, bins, on_bins=True), nodes, offsets)
                total = own if total is None else total + own
            if total is not None:
                cells = np.moveaxis(total, 1, -1).reshape(-1, 3)
                full = np.flatnonzero(cells[:, 2] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(full), *[pa.array(cells[full, i]) for i in range(3)]], names=["cell", "G", "H", "C"])

        return self.data.mapInArrow(part, "cell long, G double, H double, C double")

    def __call__(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        n_cells = int(self.offsets[-1])
        out = np.zeros((len(nodes), 3, n_cells))
        step = max(1, HIST_CELLS // n_cells)
        for a in range(0, len(nodes), step):
            some = nodes[a : a + step]
            rows = self.partials(tree, some).groupBy("cell").agg(F.sum("G").alias("G"), F.sum("H").alias("H"), F.sum("C").alias("C")).toPandas()
            cells = np.zeros((len(some) * n_cells, 3))
            cells[rows["cell"].to_numpy()] = rows[["G", "H", "C"]].to_numpy()
            out[a : a + step] = np.moveaxis(cells.reshape(len(some), n_cells, 3), -1, 1)
        return out


def _gains(hists: np.ndarray, offsets: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain of splitting behind each cell (nodes, cells), sums up to each cell of its feature, and the nodes' sums."""
    upto = np.cumsum(hists, axis=2)
    ends = upto[:, :, offsets[1:] - 1]
    before = np.concatenate([np.zeros_like(ends[:, :, :1]), ends[:, :, :-1]], axis=2)
    upto -= np.repeat(before, np.diff(offsets), axis=2)
    total = upto[:, :, offsets[1] - 1]
    (GL, HL), (G, H) = (upto[:, 0], upto[:, 1]), (total[:, 0, None], total[:, 1, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = GL * GL / (HL + lam) + (G - GL) ** 2 / (H - HL + lam) - G * G / (H + lam)
    return gain, upto, total


def _first_best(found: np.ndarray) -> np.ndarray:
    """Along the last axis: ties go to the lowest feature, then to the lowest bin."""
    top = found.max(axis=-1, keepdims=True)
    with np.errstate(invalid="ignore"):
        return np.argmax(found >= top - TIE * np.abs(top), axis=-1)


def _best_splits(hists: np.ndarray, offsets: np.ndarray, spec: GrowSpec, columns: list[int]) -> list[tuple]:
    """(gain, feature, bin, sums left, sums of the node) of each node; gain is None where no split is allowed."""
    gain, upto, total = _gains(hists, offsets, float(spec.reg_lambda))
    rest = total[:, :, None] - upto
    ok = (hists[:, 2] > 0) & (rest[:, 2] > 0) & (upto[:, 2] >= spec.min_samples_leaf) & (rest[:, 2] >= spec.min_samples_leaf)
    ok &= (upto[:, 1] >= spec.min_child_weight) & (rest[:, 1] >= spec.min_child_weight) & (total[:, 2, None] >= spec.min_samples_split)
    feature = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok &= np.isin(feature, columns)
    found = np.where(ok, gain, -np.inf)
    at = _first_best(found)
    out = []
    for i, c in enumerate(at):
        good = ok[i, c] and found[i, c] > 1e-12 * max(1.0, abs(total[i, 0]))
        out.append((float(found[i, c]) if good else None, int(feature[c]), int(c - offsets[feature[c]]), upto[i, :, c], total[i]))
    return out


def _symmetric_split(hists: np.ndarray, offsets: np.ndarray, spec: GrowSpec):
    """The (feature, bin) with the largest sum of gains over a level's nodes; None where no column can be cut."""
    gain, upto, total = _gains(hists, offsets, float(spec.reg_lambda))
    inside = (upto[:, 2] > 0) & (upto[:, 2] < total[:, 2, None])
    can = inside.any(axis=0)
    if not can.any():
        return None
    at = int(_first_best(np.where(can, np.where(inside, np.nan_to_num(gain, nan=0.0, posinf=0.0, neginf=0.0), 0.0).sum(axis=0), -np.inf)))
    f = int(np.searchsorted(offsets, at, side="right")) - 1
    return f, at - int(offsets[f])


def grow_hist(source, spec: GrowSpec, edges: list[np.ndarray], seed: int = 0) -> Tree:
    """One histogram tree; ``source(tree, nodes)`` gives the nodes' histograms.

    Nodes are named by path (root 1, children 2i and 2i + 1). ``known`` holds a
    node's best split once its histogram was seen; ``splits`` what the tree is
    made of.
    """
    lam, p, offsets = float(spec.reg_lambda), len(edges), _offsets(edges)
    columns = _columns_of_tree(seed * 1000, 0, p, spec.col_fraction) if spec.col_fraction < 1.0 else list(range(p))

    def leaf(sums) -> float:
        return -sums[0] / (sums[1] + lam) if sums[1] + lam > 0 else 0.0

    def build(splits: dict, sums: dict) -> tuple[Tree, dict]:
        cols = {name: [] for name, _, _ in Tree.FIELDS}
        order = [1]
        for path in order:
            if path in splits:
                order += [2 * path, 2 * path + 1]
        at = {path: i for i, path in enumerate(order)}
        for path in order:
            f, b = splits.get(path, (-1, 0))
            cols["feat"].append(f)
            cols["thr_bin"].append(b)
            cols["thr_val"].append((edges[f][b] if b < len(edges[f]) else np.inf) if f >= 0 else 0.0)
            cols["left"].append(at.get(2 * path, -1))
            cols["right"].append(at.get(2 * path + 1, -1))
            cols["value"].append(leaf(sums[path]))
            cols["depth"].append(path.bit_length() - 1)
        return Tree(**cols), at

    def look(splits: dict, sums: dict, parents: list[int], hists: dict) -> dict:
        """Histograms of the parents' children: the one with fewer rows is counted, the other is the difference."""
        tree, at = build(splits, sums)
        fewer = [2 * q if sums[2 * q][2] <= sums[2 * q + 1][2] else 2 * q + 1 for q in parents]
        counted = source(tree, [at[c] for c in fewer])
        return {x: y for q, c, own in zip(parents, fewer, counted, strict=True) for x, y in ((c, own), (c ^ 1, hists[q] - own))}

    hists = {1: source(Tree(), [0])[0]}
    sums = {1: hists[1][:, : offsets[1]].sum(axis=1)}
    splits: dict = {}
    if spec.policy == "symmetric":
        level, depth = [1], 0
        while depth < spec.depth_cap:
            choice = _symmetric_split(np.stack([hists[q] for q in level]), offsets, spec)
            if choice is None:
                break
            f, b = choice
            for q in level:
                splits[q] = choice
                own, cut = hists[q][:, offsets[f] : offsets[f + 1]], b + 1
                sums[2 * q], sums[2 * q + 1] = own[:, :cut].sum(axis=1), own[:, cut:].sum(axis=1)
            depth += 1
            if depth < spec.depth_cap:
                hists = look(splits, sums, level, hists)
            level = [c for q in level for c in (2 * q, 2 * q + 1)]
        return build(splits, sums)[0]

    known = {1: _best_splits(hists[1][None], offsets, spec, columns)[0]}
    budget = spec.max_leaf_nodes if spec.max_leaf_nodes is not None else float("inf")
    while True:
        # the heap: leaves by gain; a leaf whose children are not known yet may be split, its children wait
        splits, leaves, frontier, unknown = {}, 1, [1], []
        while frontier and leaves < budget:
            q = min(frontier, key=lambda x: (-(known[x][0] or 0.0), x.bit_length(), x))
            frontier.remove(q)
            gain, f, b, left, node = known[q]
            if gain is None or q.bit_length() > spec.depth_cap:
                continue
            splits[q] = (f, b)
            sums[2 * q], sums[2 * q + 1] = left, node - left
            leaves += 1
            if 2 * q in known:
                frontier += [2 * q, 2 * q + 1]
            elif q.bit_length() < spec.depth_cap:
                unknown.append(q)
        if not unknown or leaves - len(unknown) >= budget:
            break
        seen = look(splits, sums, unknown, hists)
        hists |= seen
        known |= dict(zip(seen, _best_splits(np.stack(list(seen.values())), offsets, spec, columns), strict=True))
    return build(splits, sums)[0]


# ----------------------------------------------------------------- driver


def _rows(df: DataFrame, features, target: str, binned: bool, max_bins: int = 255):
    """The table that trees grow on, with row ids that do not depend on partitioning, its bin edges and row count."""
    # the pipeline's row index when present, else a hash of the row's values
    rid = F.col("idx").cast("long") if "idx" in df.columns else F.xxhash64(*[F.col(f) for f in features], F.col(target))
    y = F.col(target).cast("double").alias("_y")
    if binned:
        edges = bin_edges(df, features, max_bins)
        data = _binned(df.select(*[F.col(f) for f in features], y, rid.alias("_rid")), features, edges).drop(*features)
    else:
        edges = []
        data = df.select(*[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)], y, rid.alias("_rid"))
    data = materialize(data)
    n = data.count()
    parts = max(1, min(data.rdd.getNumPartitions(), ceil(n / ROWS_PER_PART)))
    return (data.coalesce(parts) if parts < data.rdd.getNumPartitions() else data), edges, n


def _rows_of(b) -> np.ndarray:
    """How many rows of the table each row of the batch stands for."""
    return _col(b, "_many") if "_many" in b.schema.names else np.ones(b.num_rows)


def _merged(data: DataFrame, columns: list[str], n: int) -> tuple[DataFrame, int] | None:
    """One row for all that agree in ``columns``: their number ``_many``, mean target ``_y`` and squares around it ``_ss``.

    Least squares sees no more of them. None where the merged rows would not fit a
    task, and where all rows fit one and are few or seldom equal.
    """
    width = len([c for c in columns if c != "_val"]) + 4
    if n < MERGE_ROWS and n * width <= SUBTREE_CELLS:
        return None
    few = data.groupBy(*columns).agg(F.count("*").cast("double").alias("_many"), F.avg("_y").alias("_y"), (F.var_pop("_y") * F.count("*")).alias("_ss"), F.min("_rid").alias("_rid"))
    few = materialize(few)
    found = (few.where(~F.col("_val")) if "_val" in columns else few).count()
    fits = found * width <= SUBTREE_CELLS
    return (few, found) if fits and (n * width > SUBTREE_CELLS or 2 * found <= n) else None


class RowKinds:
    """Rows numbered by the distinct values of their features, where these fit a task.

    A task sums what trees need per kind, so its output does not grow with its
    rows; the features of the kinds (at most ``SUBTREE_CELLS`` numbers) are broadcast.
    """

    def __init__(self, data: DataFrame, kinds: DataFrame, p: int):
        from .rowindex import with_row_index

        self.p, spark = p, data.sparkSession
        columns = [f"x{j}" for j in range(p)]
        numbered = with_row_index(kinds.select(*columns), columns, "_kind")
        self.n = numbered.n
        self.X = numbered.df.orderBy("_kind").select(*columns).toPandas().to_numpy(dtype=float)
        self.sent = spark.sparkContext.broadcast(self.X)
        right = F.broadcast(numbered.df.select(*[F.col(c).alias(f"_k{c}") for c in columns], "_kind"))
        same = F.lit(True)
        for c in columns:
            same = same & F.col(c).eqNullSafe(F.col(f"_k{c}"))
        self.data = materialize(data.join(right, same).drop(*columns, *[f"_k{c}" for c in columns]))
        self.tasks = 4 * spark.sparkContext.defaultParallelism

    def grow(self, trees: list[int], weigh, spec: GrowSpec, seed: int) -> DataFrame:
        """t, node, n, blob of whole trees; ``weigh(batch, t)`` gives the rows' weights and counts."""
        n, sent = self.n, self.sent

        def part(batches):
            sums = np.zeros((len(trees), 3, n))
            for b in batches:
                kind, y = b.column("_kind").to_numpy(zero_copy_only=False), _col(b, "_y")
                for i, t in enumerate(trees):
                    w, c = weigh(b, t)
                    for j, v in enumerate((w, w * y, c)):
                        sums[i, j] += np.bincount(kind, weights=v, minlength=n)
            for i, t in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([sums[i].tobytes()], pa.binary())], names=["t", "sums"])

        def whole(g: pa.Table) -> pa.Table:
            t = g["t"][0].as_py()
            total = sum(np.frombuffer(v.as_py(), dtype=float).reshape(3, n) for v in sorted(g["sums"], key=lambda v: v.as_py()))
            has = total[0] > 0
            w, s, c = total[:, has]
            tree = grow_exact(sent.value[has], s / w, w, c, spec, 0, _root_key(seed, t))
            return pa.Table.from_arrays([pa.array([t]), pa.array([0]), pa.array([len(tree)]), pa.array([tree.pack()], pa.binary())], names=["t", "node", "n", "blob"])

        rows = self.data.coalesce(min(self.tasks, self.data.rdd.getNumPartitions()))
        parts = rows.mapInArrow(part, "t long, sums binary").repartition(min(len(trees), self.tasks), "t")
        return parts.groupBy("t").applyInArrow(whole, "t long, node long, n long, blob binary")


def _ones(rid: np.ndarray, t: int) -> np.ndarray:
    return np.ones(rid.shape[0])


def _plain(b):
    y = _col(b, "_y")
    return y, np.ones_like(y)


def _forest(df, features, target, n_trees, spec: GrowSpec, bootstrap: float | None, seed: int = SEED):
    data, _, n = _rows(df, features, target, binned=False)
    p = len(features)

    def weight(rid, t):
        return _ones(rid, t) if bootstrap is None else _poisson_counts(_row_uniform(rid, t, seed), bootstrap)

    merged = _merged(data, [f"x{j}" for j in range(p)], n)
    if merged and bootstrap is None:
        data, n = merged
    elif merged:
        kinds = RowKinds(data, merged[0], p)

        def drawn(b, t):
            count = weight(b.column("_rid").to_numpy(zero_copy_only=False), t)
            return count, count

        tables = []
        step = max(1, KIND_SUMS // (3 * kinds.n))
        for a in range(0, n_trees, step):
            tables.append(kinds.grow(list(range(a, min(n_trees, a + step))), drawn, spec, seed))
        whole = tables[0]
        for more in tables[1:]:
            whole = whole.unionByName(more)
        trees, table = _gathered(whole, [Tree()] * n_trees, [], n_trees * min(2 * kinds.n, 2 ** min(spec.depth_cap + 1, 60)))
        return TreeEnsemble(list(features), trees, [1.0] * len(trees), 0.0, "mean", subtrees=table)
    shift = float(data.agg(F.avg("_y")).first()[0]) if n * (p + 4) > SUBTREE_CELLS else 0.0
    trees, table = _grow_exact_trees(data, p, n, n_trees, spec, _plain, weight, seed, shift)
    return TreeEnsemble(list(features), trees, [1.0] * len(trees), 0.0, "mean", subtrees=table)


def _holdout(data: DataFrame, fraction: float) -> DataFrame:
    """Flag an exact ceil(fraction·n) validation share by the seeded-hash rank."""
    from .sampling import shuffled_index

    ix = shuffled_index(data, "_rid", idx_col="_vrank")
    n_val = ceil(ix.n * fraction)
    return materialize(ix.df.withColumn("_val", F.col("_vrank") < n_val).drop("_vrank"))


def _running(b, pending: list[Tree], lr: float, p: int, binned: bool) -> np.ndarray:
    """The prediction so far: column ``_F`` and the trees that are not folded into it yet."""
    out = _col(b, "_F")
    if pending:
        cols = _matrix(b, p, "b" if binned else "x")
        for tree in pending:
            out = out + lr * tree.value[_walk(tree, cols, on_bins=binned)]
    return out


def _validation_losses(base: DataFrame, trees, lr, p) -> list[float]:
    """½·mean squared error on the held-out rows for column ``_F`` and 0, 1, ... of ``trees`` on top of it, in one pass."""
    trees = tuple(trees)

    def run(batches):
        acc, cnt = np.zeros(len(trees) + 1), 0.0
        for b in batches:
            now, y, bins, w = _col(b, "_F"), _col(b, "_y"), _matrix(b, p, "b"), _rows_of(b)
            cnt += w.sum()
            within = _col(b, "_ss").sum() if "_ss" in b.schema.names else 0.0
            for i in range(len(trees) + 1):
                if i:
                    now = now + lr * trees[i - 1].value[_walk(trees[i - 1], bins, on_bins=True)]
                acc[i] += float((w * (y - now)) @ (y - now)) + within
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc))), pa.array(acc), pa.array(np.full(len(acc), cnt))], names=["i", "s", "n"])

    rows = base.where(F.col("_val")).mapInArrow(run, "i long, s double, n double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    return [0.5 * r["s"] / max(r["n"], 1.0) for r in sorted(rows, key=lambda r: r["i"])]


def _should_stop(scores: list, n_iter_no_change: int, tol: float) -> bool:
    """Stop when none of the last ``n_iter_no_change`` scores beats the score
    just before them by more than ``tol`` (scores: higher is better)."""
    ref_pos = n_iter_no_change + 1
    if len(scores) < ref_pos:
        return False
    reference = scores[-ref_pos] + tol
    return not any(sc > reference for sc in scores[-ref_pos + 1 :])


def _hist_tree(data: DataFrame, edges, spec: GrowSpec, grad_fn, seed: int) -> Tree:
    """One histogram tree over a table of any size: one job per step."""
    return grow_hist(_SparkHistograms(data, len(edges), _offsets(edges), grad_fn), spec, edges, seed)


def _rounds_in_task(data: DataFrame, p: int, edges, spec: GrowSpec, lr: float, seeds: list[int], binned: bool) -> list[Tree]:
    """The next rounds' trees of a table that fits a task: one job instead of one or more per round."""
    offsets = _offsets(edges)

    def whole(batches):
        parts = [(_matrix(b, p, "b" if binned else "x"), _col(b, "_y"), _col(b, "_F"), b.column("_rid").to_numpy(zero_copy_only=False), _rows_of(b)) for b in batches]
        if not parts:
            return
        X, y, now, rid, w = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(rid, kind="stable")  # sums in one order, whatever the partitioning
        X, y, now, w = X[order], y[order], now[order], w[order]
        for seed in seeds:
            if binned:
                tree = grow_hist(_LocalHistograms(X.astype(np.int64), w * (now - y), w, offsets, w), spec, edges, seed)
            else:
                tree = grow_exact(X, y - now, w, w, spec, 0, _root_key(seed, 0))
            now = now + lr * tree.value[_walk(tree, X, on_bins=binned)]
            yield pa.RecordBatch.from_arrays([pa.array([seed]), pa.array([len(tree)]), pa.array([tree.pack()], pa.binary())], names=["seed", "n", "blob"])

    rows = data.coalesce(1).mapInArrow(whole, "seed long, n long, blob binary").collect()
    return [Tree.unpack(r["n"], r["blob"]) for r in sorted(rows, key=lambda r: r["seed"])]


def _boost(df, features, target, n_rounds, lr, spec: GrowSpec, max_bins: int | None, init: str = "mean", seed: int = SEED, early_stopping: dict | None = None):
    """Least-squares boosting; ``max_bins`` None grows exact trees."""
    binned, p = max_bins is not None, len(features)
    data, edges, n = _rows(df, features, target, binned, max_bins or 0)
    if early_stopping:
        data = _holdout(data, early_stopping["validation_fraction"])
        train_rows = data.where(~F.col("_val"))
    else:
        train_rows = data
    f0 = float(train_rows.agg(F.avg("_y")).first()[0]) if init == "mean" else 0.0
    columns = [f"{'b' if binned else 'x'}{j}" for j in range(p)] + (["_val"] if early_stopping else [])
    data, n = _merged(data, columns, n) or (data, n)
    base = data.withColumn("_F", F.lit(f0))
    trees: list[Tree] = []
    pending: list[Tree] = []  # trees not yet folded into _F
    scores = [-v for v in _validation_losses(base, [], lr, p)] if early_stopping else []

    while len(trees) < n_rounds:
        grow_on = base.where(~F.col("_val")) if early_stopping else base
        in_task = n * (p + 4) <= SUBTREE_CELLS
        at_once = TASK_ROUNDS if in_task and not early_stopping else REFRESH - len(pending)
        seeds = list(range(seed + len(trees), seed + min(n_rounds, len(trees) + at_once)))
        if in_task:
            new = _rounds_in_task(grow_on, p, edges, spec, lr, seeds, binned)
        else:

            def residual(b, pending=tuple(pending)):
                r = _col(b, "_y") - _running(b, pending, lr, p, binned)
                return r, np.ones_like(r)

            def grad(b, residual=residual):
                r, one = residual(b)
                return -r, one

            if binned:
                new = [_hist_tree(grow_on, edges, spec, grad, seeds[0])]
            else:
                new = _grow_exact_trees(grow_on, p, n, 1, spec, residual, _ones, seeds[0])[0]
        if early_stopping:
            scores += [-v for v in _validation_losses(base, pending + new, lr, p)[-len(new) :]]
            for k in range(len(scores) - len(new), len(scores)):
                if _should_stop(scores[: k + 1], early_stopping["n_iter_no_change"], early_stopping["tol"]):
                    new, scores, n_rounds = new[: len(new) - (len(scores) - 1 - k)], scores[: k + 1], 0
                    break
        trees += new
        pending += new
        if len(pending) >= REFRESH and len(trees) < n_rounds:
            base = _fold_in(base, pending, lr, p, binned)
            pending = []
    model = TreeEnsemble(list(features), trees, [lr] * len(trees), f0, "sum")
    if early_stopping:
        model.extra = {"n_iter": len(trees), "validation_scores": scores}
    return model


def _fold_in(base: DataFrame, pending, lr, p, binned: bool) -> DataFrame:
    pending = tuple(pending)

    def upd(batches):
        for b in batches:
            F_new = _running(b, pending, lr, p, binned)
            yield pa.RecordBatch.from_arrays([b.column(c) if c != "_F" else pa.array(F_new) for c in b.schema.names], names=b.schema.names)

    return materialize(base.mapInArrow(upd, base.schema))


# ------------------------------------------------------ registry entries


def decision_tree_fit(df, features, target, max_depth=None, min_samples_split=2, **_):
    return _forest(df, features, target, 1, GrowSpec(max_depth=max_depth, min_samples_split=min_samples_split), None)


def extra_tree_fit(df, features, target, max_depth=None, min_samples_split=2, **_):
    return _forest(df, features, target, 1, GrowSpec(max_depth=max_depth, min_samples_split=min_samples_split, policy="random"), None)


def random_forest_fit(df, features, target, n_estimators=100, max_depth=None, min_samples_split=2, **_):
    return _forest(df, features, target, int(n_estimators), GrowSpec(max_depth=max_depth, min_samples_split=min_samples_split), 1.0)


def extra_trees_fit(df, features, target, n_estimators=100, max_depth=None, min_samples_split=2, **_):
    return _forest(df, features, target, int(n_estimators), GrowSpec(max_depth=max_depth, min_samples_split=min_samples_split, policy="random"), None)


def bagging_fit(df, features, target, n_estimators=10, max_samples=1.0, **_):
    return _forest(df, features, target, int(n_estimators), GrowSpec(), float(max_samples))


def gradient_boosting_fit(df, features, target, n_estimators=100, learning_rate=0.1, max_depth=3, **_):
    return _boost(df, features, target, int(n_estimators), float(learning_rate), GrowSpec(max_depth=max_depth), None)


def hist_gradient_boosting_fit(df, features, target, max_iter=100, learning_rate=0.1, max_leaf_nodes=31, max_depth=None,
                               min_samples_leaf=20, l2_regularization=0.0, max_bins=255, early_stopping="auto",
                               validation_fraction=0.1, n_iter_no_change=10, tol=1e-7, **_):
    """Early stopping "auto" is on above 10 000 rows, like the reference's default."""
    spec = GrowSpec(max_depth=max_depth, min_samples_leaf=min_samples_leaf, reg_lambda=l2_regularization,
                    max_leaf_nodes=max_leaf_nodes, policy="leaves")
    stop = early_stopping is True or (early_stopping == "auto" and df.count() > 10_000)
    es = {"validation_fraction": float(validation_fraction), "n_iter_no_change": int(n_iter_no_change), "tol": float(tol)} if stop else None
    return _boost(df, features, target, int(max_iter), float(learning_rate), spec, max_bins, early_stopping=es)


def xgboost_fit(df, features, target, n_estimators=100, max_depth=6, learning_rate=0.3, reg_lambda=1.0,
                min_child_weight=1.0, max_bins=256, **_):
    spec = GrowSpec(max_depth=max_depth, reg_lambda=reg_lambda, min_child_weight=min_child_weight)
    return _boost(df, features, target, int(n_estimators), float(learning_rate), spec, max_bins)


def lightgbm_fit(df, features, target, n_estimators=100, learning_rate=0.1, max_depth=-1, num_leaves=31, subsample=1.0,
                 colsample_bytree=1.0, min_child_samples=20, reg_lambda=0.0, max_bins=255, **_):
    spec = GrowSpec(max_depth=max_depth, min_samples_leaf=min_child_samples, reg_lambda=reg_lambda, min_child_weight=1e-3,
                    max_leaf_nodes=num_leaves, policy="leaves", col_fraction=float(colsample_bytree))
    return _boost(df, features, target, int(n_estimators), float(learning_rate), spec, max_bins)


def catboost_fit(df, features, target, iterations=500, depth=6, learning_rate=0.03, l2_leaf_reg=3.0, max_bins=254, **_):
    spec = GrowSpec(max_depth=depth, reg_lambda=l2_leaf_reg, policy="symmetric")
    return _boost(df, features, target, int(iterations), float(learning_rate), spec, max_bins)
