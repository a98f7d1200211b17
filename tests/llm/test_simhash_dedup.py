import numpy as np
import xxhash

from regcast.llm import simhash_dedup as S

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, bits=2):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(points))]


def clustered(n=150, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for base in rng.integers(0, 2**63, n):
        x = int(base)
        for _ in range(int(rng.integers(1, 8))):
            out.append(x)
            for _ in range(int(rng.integers(1, 4))):
                x ^= 1 << int(rng.integers(0, 64))
    return sorted(set(out))


def test_query_equals_brute_force(spark):
    from regcast.llm.queries import op2_simhash_near_dedup

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    comp = brute_components(prints)
    want = {(i, f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, comp, strict=True)}
    got = {tuple(r) for r in op2_simhash_near_dedup(spark, SF).collect()}
    assert got == want


def test_sharded_search_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_POINTS", 40)
    points = clustered()
    comp = brute_components(points)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in points], "fp long").repartition(5)
    star = {r["u"]: r["v"] for r in S.fingerprint_components(df).collect()}
    signed = [int(np.uint64(p).astype(np.int64)) for p in points]
    least = {}
    for s, c in zip(signed, comp, strict=True):
        least[c] = min(least.get(c, s), s)
    assert {s: star.get(s, s) for s in signed} == {s: least[c] for s, c in zip(signed, comp, strict=True)}


def test_local_tree_equals_direct_comparison(monkeypatch):
    points = np.array(clustered(400, 1), np.uint64)
    monkeypatch.setattr(S, "DIRECT", 500)
    tree = S.Links(len(points))
    S.search(points, np.arange(len(points)), np.empty(0, np.int64), 2, tree)
    monkeypatch.setattr(S, "DIRECT", 1 << 40)
    direct = S.Links(len(points))
    S.search(points, np.arange(len(points)), np.empty(0, np.int64), 2, direct)
    assert np.array_equal(tree.root, direct.root)


def test_long_text_is_whole():
    text = " ".join(f"w{i}" for i in range(150_000))
    rng = np.random.default_rng(3)
    assert S.fingerprint(text.encode(), 3) != S.fingerprint(text[: len(text) // 2].encode(), 3)
    words = " ".join(f"{x}" for x in rng.integers(0, 99, 2_000))
    assert S.fingerprint(words.encode(), 3) & (2**64 - 1) == brute_fingerprint(words)


def test_edge_rows(spark):
    rows = [(None, "A b c d"), (3, "a B C d"), (None, None), (9, ""), (9, " \n"), (None, "one other text here now"), (4, "x y"), (4, "x y")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (None, 9), (9, 9), (9, 9), (None, None), (4, 4), (4, 4)], key=str)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], (r["text"] or "").strip()) for r in kept.collect()), key=str) == sorted([(3, "a B C d"), (9, ""), (None, "one other text here now"), (4, "x y")], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.keep_one(df.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    from regcast.llm.components import connected_components

    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["u"]: r["v"] for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}
