import itertools
import random
import re
from collections import Counter

import pytest

from regcast.llm.filter_audit import filter_audit, intervals, lehmer_rank, order_effects

SCHEMA, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        bad = set()
        if len(words) < 50:
            bad.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
            bad.add("C")
        if any(c in "#$%&*|" for c in text):
            bad.add("D")
        if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows):
            bad.add("E")
        out.append(bad)
    return out


def brute(rows, labels):
    fails = failures(rows)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    out = []
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        found, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order):
                here = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                shapley[c] += len(here)
                failing = [x for x in mine if c in x[1]]
                found.append((part, order, step + 1, len(left), len(here), len(failing) - len(here), sum(x[1] == {c} for x in failing),
                              sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)))
        out += [(*f, shapley[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def corpus(n=160, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["word", f"w{rng.randrange(500)}", "Cap", "é"]) for _ in range(rng.choice([0, 3, 49, 50, 51, 80, 200]))]
        text = rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", "", " #", "|", "ABCDEFGH" * 3])
        rows.append((rng.randrange(n), rng.choice([text, text, text, "same text", None, ""]), "hot" if i % 3 else rng.choice(["a", None, "", "é"])))
    rows += [(None, "same text", "a"), (None, None, "z"), *[(0, "same text", "hot")] * 3, *[(999, "same text", "hot")] * 4, (-5, "same text", "b"), (-5, "same text", "a")]
    return rows


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def test_equals_applying_every_order(spark):
    rows = corpus()
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (7, None, 1)]
    labels = [(d, q, int(t) if t is not None else None) for d, q, t in labels]
    out = filter_audit(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got(out) == brute(rows, labels)


def test_intervals_cover_every_order_once():
    orders = list(itertools.permutations(range(5)))
    assert [lehmer_rank(o, 5) for o in orders] == list(range(120))
    for mask in range(32):
        removed = {}
        for step, start, stop in intervals(mask, 5):
            for rank in range(start, stop):
                assert rank not in removed
                removed[rank] = step
        want = {r: min(i + 1 for i, f in enumerate(o) if mask >> f & 1) for r, o in enumerate(orders) if mask}
        assert removed == want


def test_other_filter_sets(spark):
    """Three filters, named out of order: bit i of a mask is the i-th name."""
    counts = spark.createDataFrame([("p", 0, 7), ("p", 1, 2), ("p", 6, 3), ("p", 6, 1), ("q", 7, 5)], "part string, mask int, n long")
    out = {(r["part"], r["filter_order"], r["step"]): r for r in order_effects(counts, "zxy", []).collect()}
    assert len(out) == 2 * 6 * 3 and {k[1] for k in out} == {"".join(o) for o in itertools.permutations("xyz")}
    assert [out["p", "yxz", s]["removed"] for s in (1, 2, 3)] == [4, 0, 2] and out["p", "yxz", 3]["kept"] == 7
    assert out["p", "zyx", 3]["redundant"] == 4 and out["p", "zyx", 1]["unique_fails"] == 2
    assert out["q", "xyz", 1]["removed"] == 5 and out["q", "xyz", 1]["shapley"] == 10
    with pytest.raises(ValueError):
        order_effects(counts, "zz", [])


def test_edges_and_clashing_names(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS + "").selectExpr("*", "'x' as text", "1 as `a.b`")
    assert got(filter_audit(spark.createDataFrame([], SCHEMA), labels)) == []
    rows = [(1, None, None), (2, "", ""), (3, "w " * 3000, "s")]
    df = spark.createDataFrame([(*r, 3, "m", 1) for r in rows], SCHEMA + ", `a.b` int, mask string, quality int")
    assert got(filter_audit(df, labels)) == brute(rows, [(1, 1, 0)])
    assert got(filter_audit(df, labels.limit(0))) == brute(rows, [])
    odd = df.toDF("doc_id", "te.xt", "so urce", "x", "y", "z")
    assert got(filter_audit(odd, labels, "te.xt", "so urce")) == brute(rows, [(1, 1, 0)])
