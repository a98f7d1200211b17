"""Support vector regression on the pivots of an exact kernel: Newton steps, each a job over the rows.

The hinge max(0, u) is smoothed to u²/2δ below δ. Its dual variables are
C·min(max(u, 0)/δ, 1), so every free one has a residual within δ of its edge of the
tube: at the smoothed minimum no pair violates libsvm's optimality condition by more
than 2δ. δ falls from the spread of the targets to half the tolerance, and each stage
starts where the last one ended. The loss is piecewise quadratic, so the steps end;
their number does not follow the number of rows.

Late stages have few rows with curvature, and each step changes which. There the
driver gets the rows nearest to the tube's edges (at most ``BAND``), takes all others
as the lines they are on, and minimises that; a job then evaluates the result on all
rows. It ends only when the gradient over all rows is zero.

Rows with equal features share φ: a task gets them as one row with all
their targets (a sorted list with counts, in pieces of a batch), so φ and
the Hessian ΦᵀDΦ cost what the distinct rows cost, and nothing is left out.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .kernel_exact import BLOCK, STRIPE, Kernel, KernelDualModel, PivotMap, _x, pivot_map

LENGTHS = 0.5 ** np.arange(12)  # of a Newton step; all are tried in the job that takes the full one
SMALLER = 0.1  # δ of a stage over the last one's
BAND = 8192  # rows next to the tube's edges that the driver gets; BAND_CELLS bounds their φ
BAND_CELLS = 4_000_000
ROUNDS = 12  # of these before plain Newton steps go on
COLLECTED = 512  # up to so many pivots the driver adds the tasks' sums itself


def _grouped(data: DataFrame, p: int) -> DataFrame:
    """x0.., the targets of equal rows ``y`` and their numbers ``w`` as binary cells, and a row id."""
    names = [f"x{j}" for j in range(p)]
    counted = data.groupBy(*names, "y").agg(F.count("*").cast("double").alias("w"))
    # by features and target: a hot row of features is dealt over several tasks
    parts = max(data.sparkSession.sparkContext.defaultParallelism, data.rdd.getNumPartitions())
    ranged = counted.repartitionByRange(parts, *names, "y").sortWithinPartitions(*names, "y")

    def gather(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            X, y, w = _x(b, p), b.column("y").to_numpy(zero_copy_only=False), b.column("w").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], (X[1:] != X[:-1]).any(axis=1)]))
            ends = [*first[1:].tolist(), len(X)]
            cells = [pa.array([v[i:j].tobytes() for i, j in zip(first.tolist(), ends)], pa.binary()) for v in (y, w)]
            yield pa.RecordBatch.from_arrays([*(pa.array(X[first, j]) for j in range(p)), *cells], names=[*names, "y", "w"])

    schema = ", ".join([*(f"{c} double" for c in names), "y binary", "w binary"])
    return materialize(ranged.mapInArrow(gather, schema).withColumn("_rid", F.xxhash64(*names)))


def _targets(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The targets of a batch's groups in one array, their numbers, and how many each group has."""
    y, w = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=float) for c in ("y", "w"))
    return y, w, np.array([len(v) // 8 for v in b.column("y").to_pylist()], dtype=int)


def _pieces(batches, p: int, fmap: PivotMap):
    """Up to BLOCK groups, their φ and targets, the targets' numbers and group places."""
    for b in batches:
        X = _x(b, p)
        y, w, many = _targets(b)
        ends = np.concatenate([[0], np.cumsum(many)])
        for a in range(0, len(X), BLOCK):
            z = min(a + BLOCK, len(X))
            yield X[a:z], fmap(X[a:z]), y[ends[a] : ends[z]], w[ends[a] : ends[z]], np.repeat(np.arange(z - a), many[a:z])


def hinge(u: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smoothed max(0, u), its slope, and where it is curved (δ = 0: the hinge itself)."""
    if delta == 0:
        return np.maximum(u, 0.0), (u > 0).astype(float), np.zeros(len(u))
    part = np.clip(u, 0.0, delta)
    return part * part / (2 * delta) + np.maximum(u - delta, 0.0), part / delta, ((u > 0) & (u < delta)).astype(float)


@dataclass
class Point:
    """f(x) = φ(x)·w + b and the half width ε of the tube."""

    w: np.ndarray
    b: float
    eps: float

    def plus(self, d: Point, t: float) -> Point:
        return Point(self.w + t * d.w, self.b + t * d.b, self.eps + t * d.eps)


class _Nearest:
    """The ``most`` rows (x, y, number) with the least distance to a curved part of their loss, and the distance up to which none is missing."""

    def __init__(self, most: int):
        self.most, self.reach, self.found = most, np.inf, []

    def add(self, X: np.ndarray, y: np.ndarray, n: np.ndarray, place: np.ndarray, distance: np.ndarray) -> None:
        near = np.flatnonzero(distance < self.reach)
        self.found.append(np.column_stack([distance[near], X[place[near]], y[near], n[near]]))
        if sum(map(len, self.found)) > 2 * self.most:
            self.cut()

    def cut(self) -> np.ndarray:
        rows = np.concatenate(self.found)
        if len(rows) > self.most:
            rows = rows[np.argpartition(rows[:, 0], self.most)]
            self.reach = float(rows[self.most, 0])
            rows = rows[: self.most]
        self.found = [rows]
        return rows

    def cell(self) -> bytes:
        rows = self.cut() if self.found else np.empty(0)
        return np.concatenate([[self.reach], rows.ravel()]).tobytes()


def _sums(pieces, m: int, at: Point, d: Point, delta: float, near: _Nearest | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of a task's rows: the losses at ``at`` + LENGTHS·d, and at the first of these (``at`` + d) the slopes and curvatures.

    Returns Φᵀ[HΦ, h, s, g] and the losses, Σg, Σ slopes, Σh, Σs; g is the
    upper slope less the lower one, h their curvature and s the curvatures' difference.
    """
    cells, flat = np.zeros((m, m + 3)), np.zeros(len(LENGTHS) + 4)
    moving = bool(d.w.any() or d.b or d.eps)
    for X, phi, y, n, place in pieces:
        r, move = y - (phi @ at.w + at.b)[place], (phi @ d.w + d.b)[place]
        for k, t in enumerate(LENGTHS):
            if k and not moving:
                break
            rest, eps = r - t * move, at.eps + t * d.eps
            upper, lower = hinge(rest - eps, delta), hinge(-rest - eps, delta)
            flat[k] += n @ (upper[0] + lower[0])
            if k == 0:
                if near is not None:
                    near.add(X, y, n, place, np.minimum(np.abs(rest - eps - delta / 2), np.abs(-rest - eps - delta / 2)))
                g, h, s = (np.bincount(place, n * v, len(phi)) for v in (upper[1] - lower[1], upper[2] + lower[2], upper[2] - lower[2]))
                flat[-4:] += g.sum(), n @ (upper[1] + lower[1]), h.sum(), s.sum()
                cells[:, -1] += phi.T @ g
                bent = h > 0
                if bent.any():
                    phi, h, s = phi[bent], h[bent], s[bent]
                    cells[:, :-1] += phi.T @ np.column_stack([phi * h[:, None], h, s])
    return cells, flat


class Rows:
    """The grouped rows and the sums that one job makes of them."""

    def __init__(self, data: DataFrame, p: int, fmap: PivotMap):
        self.data, self.p, self.m = data, p, fmap.dim
        self.spark = data.sparkSession
        self.fmap, self.sent = fmap, self.spark.sparkContext.broadcast(fmap)
        self.most = min(BAND, BAND_CELLS // fmap.dim)
        self.share = -(-self.most // data.rdd.getNumPartitions())  # of a task

    def sums(self, at: Point, d: Point, delta: float, band: bool = False):
        """``_sums`` of all rows; with ``band`` the rows next to the edges at ``at`` + d also, as φ, y, numbers and places."""
        p, m, sent, share = self.p, self.m, self.sent, self.share
        args = self.spark.sparkContext.broadcast((at, d, delta))

        def run(batches):
            near = _Nearest(share) if band else None
            cells, flat = _sums(_pieces(batches, p, sent.value), m, *args.value, near)
            if band:
                yield pa.RecordBatch.from_arrays([pa.array([-2 - TaskContext.get().partitionId()]), pa.array([near.cell()], pa.binary())], names=["i", "cells"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([flat.tobytes()], pa.binary())], names=["i", "cells"])
            for i in range(0, m, STRIPE):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([cells[i : i + STRIPE].tobytes()], pa.binary())], names=["i", "cells"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(c.as_py(), dtype=float) for c in table["cells"])
            return pa.Table.from_arrays([table["i"][:1].combine_chunks(), pa.array([total.tobytes()], pa.binary())], names=["i", "cells"])

        parts = self.data.mapInArrow(run, "i long, cells binary")
        if m > COLLECTED:
            parts = parts.groupBy("i").applyInArrow(add, "i long, cells binary")
        total: dict[int, np.ndarray] = {}
        for r in parts.collect():
            total[r["i"]] = total.get(r["i"], 0.0) + np.frombuffer(r["cells"], dtype=float)
        args.destroy()
        sums = np.concatenate([total[i] for i in sorted(total) if i >= 0]).reshape(m, m + 3), total[-1]
        if not band:
            return sums
        found = [v for i, v in total.items() if i < -1]
        rows = np.concatenate([v[1:].reshape(-1, p + 3) for v in found])
        rows = rows[rows[:, 0] < min(v[0] for v in found)]
        rows = rows[np.lexsort(rows.T)]
        return *sums, (None, self.fmap(rows[:, 1:-2]), rows[:, -2], rows[:, -1], np.arange(len(rows)))

    def optimality(self, at: Point, w: np.ndarray, delta: float, cost: float) -> np.ndarray:
        """Of the dual variables at ``at`` and f = Φw: for a⁺ and a⁻ the largest value that may rise and the smallest that may fall, then Σyβ/C."""
        p, sent = self.p, self.sent

        def run(batches):
            ends, total = np.array([[-np.inf, np.inf]] * 2), 0.0
            for _, phi, y, n, place in _pieces(batches, p, sent.value):
                r, v = y - (phi @ at.w + at.b)[place], y - (phi @ w)[place]
                plus, minus = hinge(r - at.eps, delta)[1], hinge(-r - at.eps, delta)[1]
                total += n @ (y * (plus - minus))
                for k, (value, up, low) in enumerate(((v - cost, plus < 1, plus > 0), (v + cost, minus > 0, minus < 1))):
                    ends[k] = max(ends[k, 0], value[up].max(initial=-np.inf)), min(ends[k, 1], value[low].min(initial=np.inf))
            yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in (*ends.ravel(), total)], names=["h0", "l0", "h1", "l1", "yb"])

        found = self.data.mapInArrow(run, "h0 double, l0 double, h1 double, l1 double, yb double").collect()
        return np.array([max(r["h0"] for r in found), min(r["l0"] for r in found), max(r["h1"] for r in found), min(r["l1"] for r in found), sum(r["yb"] for r in found)])


@dataclass
class Problem:
    """½‖w‖² + C·(the losses, for ν-SVR + ν·n·ε) in m weights, b and, for ν-SVR, ε."""

    m: int
    n: float
    scale: float  # the largest k(x, x)
    C: float
    nu: float | None
    tol: float

    @property
    def last(self) -> float:
        return self.tol / 2

    @property
    def still(self) -> Point:
        return Point(np.zeros(self.m), 0.0, 0.0)

    def objective(self, x: Point, loss: float) -> float:
        return 0.5 * float(x.w @ x.w) + self.C * (loss + (self.nu * self.n * x.eps if self.nu is not None else 0.0))

    def gradient(self, at: Point, cells: np.ndarray, flat: np.ndarray) -> np.ndarray:
        free = [-flat[-4]] if self.nu is None else [-flat[-4], self.nu * self.n - flat[-3]]
        return np.concatenate([at.w - self.C * cells[:, -1], self.C * np.array(free)])

    def settled(self, grad: np.ndarray) -> bool:
        """Whether the gradient leaves next to nothing in f, and of the sums of the dual variables."""
        return np.sqrt(self.scale) * np.linalg.norm(grad[: self.m]) <= 0.02 * self.tol and np.abs(grad[self.m :]).max() <= 1e-9 * self.C * self.n

    def newton(self, grad: np.ndarray, cells: np.ndarray, flat: np.ndarray, delta: float) -> tuple[Point, float]:
        """The Newton step and its decrement."""
        m, (bent, side), bend = self.m, flat[-2:], self.C / delta
        H = np.zeros((m + 2, m + 2))
        H[:m, :m] = bend * cells[:, :m] + np.eye(m)
        H[:m, m:] = bend * cells[:, m : m + 2]
        H[m:, :m] = H[:m, m:].T
        # an edge of the tube without curvature leaves b or ε undetermined
        flat_edge = min(bent + side, bent - side) <= 0 if self.nu is not None else bent <= 0
        H[m:, m:] = bend * np.array([[bent, side], [side, bent]]) + bend * (1e-9 * bent + flat_edge) * np.eye(2)
        step = np.linalg.solve(H[: len(grad), : len(grad)], -grad)
        return Point(step[:m], float(step[m]), float(step[m + 1]) if self.nu is not None else 0.0), float(-grad @ step)

    def better(self, at: Point, d: Point, now: float, gain: float, flat: np.ndarray) -> float:
        """The length of the step: 1 where that lowers the objective, else the best tried."""
        values = [self.objective(at.plus(d, t), loss) for t, loss in zip(LENGTHS, flat)]
        return 1.0 if values[0] <= now - 1e-4 * gain + 1e-11 * abs(now) else float(LENGTHS[int(np.argmin(values))])

    def descend(self, sums, at: Point, delta: float, few: float, max_steps: int) -> tuple[Point, float, int]:
        """Newton steps by stages of δ until the last stage is settled, or at most ``few`` rows have curvature."""
        cells, flat = sums(at, self.still, delta)
        steps = 0
        while steps < max_steps:
            grad = self.gradient(at, cells, flat)
            if delta <= self.last and self.settled(grad):
                break
            d, decrement = self.newton(grad, cells, flat, delta)
            if delta > self.last and decrement <= 0.02 * self.C * self.n * delta:
                if flat[-2] <= few:
                    break
                delta = max(SMALLER * delta, self.last)
                cells, flat = sums(at, self.still, delta)
                continue
            steps += 1
            now = self.objective(at, flat[0])
            cells, flat = sums(at, d, delta)
            t = self.better(at, d, now, decrement, flat)
            at = at.plus(d, t)
            if t < 1:
                cells, flat = sums(at, self.still, delta)
        return at, delta, steps

    def near_edges(self, sums, at: Point, delta: float, max_steps: int) -> tuple[Point, int]:
        """Rounds at the last δ: minimise with the rows of the band, the others on their lines; try the result on all rows."""
        cells, flat, band = sums(at, self.still, self.last, True)
        for rounds in range(min(ROUNDS, max_steps)):
            if self.settled(self.gradient(at, cells, flat)):
                return at, rounds
            mine = _sums([band], self.m, at, self.still, self.last)
            pull, lines = cells[:, -1] - mine[0][:, -1], flat[-4:-2] - mine[1][-4:-2]

            def part(x: Point, d: Point, delta: float, band=band, pull=pull, lines=lines):
                cells, flat = _sums([band], self.m, x, d, delta)
                cells[:, -1] += pull
                flat[-4:-2] += lines
                for k, t in enumerate(LENGTHS):
                    y = x.plus(d, t)
                    flat[k] -= pull @ y.w + lines[0] * y.b + lines[1] * y.eps
                return cells, flat

            goal, _, _ = self.descend(part, at, delta, -1, 500)
            d, now, grad = goal.plus(at, -1.0), self.objective(at, flat[0]), self.gradient(at, cells, flat)
            gain = -float(grad @ np.concatenate([d.w, [d.b, d.eps]])[: len(grad)])
            cells, flat, band = sums(at, d, self.last, True)
            t = self.better(at, d, now, gain, flat)
            at = at.plus(d, t)
            if t < 1:
                cells, flat, band = sums(at, self.still, self.last, True)
            delta = max(SMALLER * delta, self.last)
        return at, min(ROUNDS, max_steps)

    def minimise(self, rows: Rows, start: Point, spread: float, max_steps: int) -> tuple[Point, int]:
        at, delta, steps = self.descend(rows.sums, start, max(spread, self.last), rows.most / 8, max_steps)
        if delta > self.last:
            at, more = self.near_edges(rows.sums, at, delta, max_steps - steps)
            at, _, rest = self.descend(rows.sums, at, self.last, -1, max_steps - steps - more)
            steps += more + rest
        return at, steps


def newton_svr(data: DataFrame, n: int, features, kernel: Kernel, C: float, epsilon: float, nu: float | None, max_iter: int, tol: float) -> KernelDualModel | None:
    """The model over the kernel's pivots; None where these do not span the kernel on the rows."""
    p = len(features)
    low, high, center, spread = data.agg(F.min("y"), F.max("y"), F.avg("y"), F.stddev_pop("y")).first()
    groups = _grouped(data, p)
    # f misses at most Σ|β|·residual ≤ C·n·residual
    scale = _largest(groups, p, kernel)
    fmap, complete = pivot_map(groups, p, kernel, min(1e-6, max(1e-13, 0.02 * tol / max(C * n * scale, 1e-300))))
    if fmap is None or not complete or not low < high:
        return None
    rows, problem = Rows(groups, p, fmap), Problem(fmap.dim, n, scale, C, nu, tol)
    at, steps = problem.minimise(rows, Point(np.zeros(fmap.dim), center, epsilon if nu is None else 0.0), spread, max_iter)
    cells, flat = rows.sums(at, problem.still, problem.last)
    pull = C * cells[:, -1]  # Φᵀβ
    found = rows.optimality(at, pull, problem.last, epsilon if nu is None else 0.0)
    ends = [(max(found[0], found[2]), min(found[1], found[3]))] if nu is None else [tuple(found[:2]), tuple(found[2:4])]
    violation = max(hi - lo for hi, lo in ends)
    if violation > tol:
        warnings.warn(f"The dual stopped after {steps} steps at a violation of {violation:.1e}.", stacklevel=2)
    mids = [(hi + lo) / 2 if np.isfinite(hi) and np.isfinite(lo) else (hi if np.isfinite(hi) else lo) for hi, lo in ends]
    b = float(np.mean(mids)) if nu is not None else float(mids[0])
    eps = float((mids[0] - mids[1]) / 2) if nu is not None else epsilon
    end, norm = Point(pull, b, eps), float(pull @ pull)
    slack = float(rows.sums(end, problem.still, 0.0)[1][0])
    primal = 0.5 * norm + C * (slack + (nu * n * eps if nu is not None else 0.0))
    dual = -0.5 * norm + C * float(found[4]) - (epsilon * C * float(flat[-3]) if nu is None else 0.0)
    gap = (primal - dual) / max(abs(primal), abs(dual), 1e-300)
    extra = {"epsilon": eps, "gap": float(gap), "violation": float(violation), "steps": steps, "rank": fmap.dim}
    return KernelDualModel(list(features), fmap.pivots, fmap.inverse.T @ pull, b, kernel, extra)


def _largest(data: DataFrame, p: int, kernel: Kernel) -> float:
    """The largest k(x, x) of all rows."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max((float(kernel.diagonal(_x(b, p)).max(initial=0.0)) for b in batches), default=0.0)])], names=["k"])

    return max(r["k"] for r in data.mapInArrow(run, "k double").collect())
