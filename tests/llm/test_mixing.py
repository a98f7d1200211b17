import math

import pytest

from regcast.llm.mixing import mix, targets

SCHEMA = "doc_id long, text string, source string"


def reshared(sizes, weights, most=3):
    """Targets by resharing the excess round by round."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        rest = [i for i in range(len(sizes)) if i not in full]
        weight = sum(weights[i] for i in rest)
        share = {i: left * weights[i] / weight for i in rest}
        over = {i for i in rest if share[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 40], [0, 7, 0, 9], [3], [100, 1, 1, 1, 1, 1, 500]])
def test_targets_equal_resharing(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = targets(sizes, weights)
    assert got == pytest.approx(reshared(sizes, weights))
    assert sum(got) == pytest.approx(sum(sizes))


def rows(n=600):
    return [(i, " ".join(["w"] * (i * 7 % 23)), ("a", "b", "a", None, "a", "Z")[i % 6]) for i in range(n)]


def test_every_source_is_cut_at_its_budget(spark):
    out = mix(spark.createDataFrame(rows(), SCHEMA).repartition(7)).collect()
    assert len(out) == 600
    names = ["Z", "a", "b", None]
    sizes = [sum(r["size"] for r in out if r["source"] == s) for s in names]
    goal = targets(sizes, [5, 2, 1, 5])
    for s, size, t in zip(names, sizes, goal, strict=True):
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size} and {r["target"] for r in mine} == {t}
        assert sum(r["taken"] for r in mine) == math.floor(t)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        whole = math.floor(t / size)
        assert sum(r["taken"] not in (whole * r["size"], (whole + 1) * r["size"]) for r in mine) <= 1
    again = mix(spark.createDataFrame(rows()[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_repeated_rows_share_the_cut(spark):
    out = mix(spark.createDataFrame([(None, "a b c", "x")] * 50 + [(1, "a b", "y")] * 1 + [(2, None, "y"), (3, "", "z")], SCHEMA)).collect()
    for s in "xyz":
        mine = [r for r in out if r["source"] == s]
        assert len({r["taken"] for r in mine if r["doc_id"] is None}) <= 1
        assert math.floor(mine[0]["target"]) - sum(r["taken"] for r in mine) in range(50)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9, "t")], SCHEMA + ", size int, taken string")
    out = mix(df)
    assert out.columns == ["doc_id", "text", "source", "size", "taken", "size_", "source_size", "target", "taken_"]
    assert tuple(out.first())[3:] == (9, "t", 2, 2, 2.0, 2)
    assert mix(df.limit(0)).count() == 0
