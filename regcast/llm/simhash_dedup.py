"""SimHash near-dedup over vantage-point trees.

1. Fingerprints: one pass over the texts; equal fingerprints become one point.
2. A top tree, grown on a bounded sample of points, cuts the Hamming space into
   shards. Each inner node has a vantage point and a radius: points within the
   radius go inside, the others outside. A point inside whose distance is within
   the link bound of the radius may have partners outside (triangle
   inequality), so it also visits the outside shards that it can reach.
3. Each shard searches exact pairs between its own points and its visitors by a
   vantage-point tree of its own, and returns its links as stars.
4. Stars of all shards are joined to components.

Every pair within the bound meets in exactly one shard: that of its outer
point. The sample only shapes the shards; no pair depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from regcast.llm.common import fresh, map_arrow, maybe_broadcast, prepare, quoted, schema_of
from regcast.llm.components import connected_components
from regcast.session import materialize

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Points of a shard aimed at, and points of the sample that shapes the top tree.
SHARD_POINTS, SAMPLE_POINTS = 8_192, 65_536
#: Distances computed at once when a branch is small enough to be compared directly.
DIRECT = 1 << 18
BLOCK = 1 << 16


def fingerprint(text: bytes | None, k: int) -> int:
    """64 bits of a text: A-Z lower-cased, words between ASCII white space, k-word shingles with repeats."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        upto = min(n, at + BLOCK)
        spans = zip(begin[at:upto].tolist(), end[min(k, len(words)) - 1 :][at:upto].tolist(), strict=True)
        h = np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """``docs`` without its text, plus the fingerprint as a (signed) long."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([fingerprint(t, k) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], names=[*b.schema.names[:-1], name])

    kept = docs.select(*map(quoted, rest), F.col(quoted(text_col)).cast("binary"))
    return map_arrow(kept, run, schema_of(kept.schema.fields[:-1], (name, LongType())))


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that halves ``points`` best; None if no try parts them."""
    best = None
    for v in points[:: max(1, len(points) // 4)][:5]:
        d = distance(points, v)
        for radius in {int(x) for x in np.percentile(d, (45, 50, 55))}:
            inside = int((d <= radius).sum())
            if 0 < inside < len(points) and (best is None or abs(2 * inside - len(points)) < best[0]):
                best = abs(2 * inside - len(points)), v, radius
        if best and best[0] <= len(points) // 5:
            break
    return best and best[1:]


def grow(points: np.ndarray, depth: int) -> list:
    """The top tree as nested (vantage, radius, inside, outside); a leaf is None."""
    cut = _split(points) if depth > 0 and len(points) > 1 else None
    if cut is None:
        return None
    d = distance(points, cut[0])
    return (*cut, grow(points[d <= cut[1]], depth - 1), grow(points[d > cut[1]], depth - 1))


def leaves(tree, path: int = 1) -> dict[int, int]:
    """Leaf numbers by path (1, then a 0 or 1 bit for each step inside or outside)."""
    return {path: 0} if tree is None else leaves(tree[2], 2 * path) | leaves(tree[3], 2 * path + 1)


def route(tree, points: np.ndarray, own: np.ndarray, visit: np.ndarray, bits: int, path: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, points at home there, visitors). own and visit index into ``points``."""
    if not len(own) and not len(visit):
        return
    if tree is None:
        yield path, own, visit
        return
    vantage, radius, inside, outside = tree
    d, e = distance(points[own], vantage).astype(np.int64), distance(points[visit], vantage).astype(np.int64)
    yield from route(inside, points, own[d <= radius], visit[e - bits <= radius], bits, 2 * path)
    near = own[(d <= radius) & (d + bits > radius)]
    yield from route(outside, points, own[d > radius], np.concatenate([near, visit[e + bits > radius]]), bits, 2 * path + 1)


class Links:
    """Least linked index of every point; links come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(nxt := self.root[self.root], self.root):
                self.root = nxt


def search(points: np.ndarray, own: np.ndarray, visit: np.ndarray, bits: int, links: Links) -> None:
    """Adds every pair within ``bits`` of an own point and another own point or visitor."""
    cut = _split(points[own]) if len(own) * (len(own) + len(visit)) > DIRECT else None
    if cut is None:
        every = np.concatenate([own, visit])
        step = max(1, DIRECT // max(1, len(every)))
        for at in range(0, len(own), step):
            block = own[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[every][None, :]) <= bits)
            links.add(block[i], every[j])
        return
    vantage, radius = cut
    d, e = distance(points[own], vantage).astype(np.int64), distance(points[visit], vantage).astype(np.int64)
    near = own[(d <= radius) & (d + bits > radius)]
    search(points, own[d <= radius], visit[e - bits <= radius], bits, links)
    search(points, own[d > radius], np.concatenate([near, visit[e + bits > radius]]), bits, links)


def stars(batch: pa.Table, bits: int) -> pa.Table:
    """One shard's links: every linked point with the least of its component there."""
    points = batch.column("fp").to_numpy()
    order = np.argsort(points, kind="stable")
    points, home = points[order], batch.column("home").to_numpy(zero_copy_only=False)[order]
    links = Links(len(points))
    search(points.view(np.uint64), np.flatnonzero(home), np.flatnonzero(~home), bits, links)
    linked = links.root != np.arange(len(points))
    return pa.table({"u": points[linked], "v": points[links.root[linked]]})


def fingerprint_components(points: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(u, v) of distinct fingerprints ``fp``: each one that is not its component's least, with that least one."""
    prepare(points.sparkSession)
    n = points.count()
    depth = min(max(0, int(np.ceil(np.log2(max(1, n) / SHARD_POINTS)))), int(np.log2(SAMPLE_POINTS / 16)))
    tree = None
    if depth:
        share = min(1.0, SAMPLE_POINTS / n)
        taken = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.xxhash64("fp").alias("h"), "fp").collect()
        tree = grow(np.array([r["fp"] for r in sorted(taken)], np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for path, own, visit in route(tree, fp.view(np.uint64), np.arange(len(fp)), np.empty(0, np.int64), bits):
                both = np.concatenate([own, visit])
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(both), path, np.int64)), "fp": pa.array(fp[both]), "home": pa.array(np.arange(len(both)) < len(own))})

    dealt = points.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return connected_components(dealt.groupBy("shard").applyInArrow(lambda t: stars(t, bits), "u long, v long"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (long), ``component`` (fingerprint) and ``component_id``.

    Documents link where fingerprints differ in ``bits`` bits or fewer;
    ``component_id`` is the smallest id reachable through links, itself
    included. Null and wordless texts have fingerprint 0 and link like any
    other. Rows with a null id take part; a component of null ids only has a
    null ``component_id``. Repeated rows each get their row. Other columns are
    left out, so their names cannot clash. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    found = materialize(fingerprints(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "text", k, "fp"))
    points = materialize(found.groupBy("fp").agg(F.min("id").alias("first")))
    star = fingerprint_components(points, bits)
    member = star.select(F.col("u").alias("fp"), F.col("v").alias("component")).unionAll(star.select("v", "v").distinct())
    linked = points.join(member, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    known = linked.join(least, "component").select("fp", "component", "least")
    classes = points.join(known, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    # written out, so that both sides of the last join are plain exchanges: a hot fingerprint is then split
    return found.join(materialize(classes), "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest id.

    Rows that share an id (or have none) are told apart by their whole row: of
    those that stand for one group, the row with the smallest hash stays. Null
    and empty texts form one group like equal texts do. An empty table stays
    empty; other columns, whatever their names, are kept as they are.
    """
    groups = materialize(near_duplicates(docs, text_col, id_col, k, bits)).toDF("_id", "fingerprint", "component", "component_id")
    shared = groups.groupBy("_id").agg(F.count("*").alias("n")).filter(F.col("n").__gt__(1) | F.col("_id").isNull()).select("_id")
    gone = groups.filter(~F.col("_id").eqNullSafe(F.col("component_id"))).select("_id").unionAll(shared).distinct()
    (gid,) = fresh(docs, "_gone")
    gone = maybe_broadcast(gone.select(F.col("_id").alias(gid)))
    kept = docs.join(gone, F.col(quoted(id_col)) == F.col(gid), "left_anti").filter(F.col(quoted(id_col)).isNotNull())
    if shared.isEmpty():
        return kept
    fp, comp, cid = fresh(docs, "_fp", "_component", "_component_id")
    odd = docs.join(shared.select(F.col("_id").alias(gid)), F.col(quoted(id_col)).eqNullSafe(F.col(gid)), "left_semi")
    (copy,) = fresh(docs, "_text")
    odd = fingerprints(odd.withColumn(copy, F.col(quoted(text_col))), copy, k, fp)
    classes = groups.select(F.col("fingerprint").alias(fp), F.col("component").alias(comp), F.col("component_id").alias(cid)).distinct()
    stand = odd.join(classes, fp).filter(F.col(quoted(id_col)).eqNullSafe(F.col(cid)))
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    one = stand.groupBy(comp).agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
    return kept.unionByName(one.select("row.*"))
