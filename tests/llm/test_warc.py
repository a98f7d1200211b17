import random

from pyspark.sql import functions as F

from regcast.llm.warc import PERMITTED, canonical_url, resolve_revisits

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string"


def lower(headers):
    out = {}
    for k, v in sorted((k.lower(), v) for k, v in (headers or {}).items()):
        out[k] = v
    return out


def brute(records, keys):
    out = []
    for i, (rid, _, ts, kind, headers, digest) in enumerate(records):
        own = lower(headers)
        if kind == "response":
            out.append((rid, rid, "response", own))
            continue
        prior = [(r[2], r[0], r) for r, k in zip(records, keys, strict=True) if r[3] == "response" and k is not None and k == keys[i] and r[2] is not None and ts is not None and r[2] < ts]
        if kind != "revisit" or not prior:
            out.append((rid, None, "no_response", own))
            continue
        base = max(prior, key=lambda x: x[:2])[2]
        b = lower(base[4])
        weak = lambda e: e[2:] if e and e.startswith("W/") else e
        mine, theirs = (weak(own.get("etag")), own.get("last-modified"), digest), (weak(b.get("etag")), b.get("last-modified"), base[5])
        if all(m is None for m in mine):
            out.append((rid, None, "unvalidated", own))
        elif any(m is not None and m != t for m, t in zip(mine, theirs, strict=True)):
            out.append((rid, None, "mismatch", own))
        else:
            out.append((rid, base[0], "resolved", b | {k: v for k, v in own.items() if k in PERMITTED}))
    return out


def records(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        url = rng.choice(["http://a.org/x", "HTTP://A.org:80/x#f", "http://a.org/x?utm_source=1", "http://b.org/?q=1", None, "no url"]) if rng.random() < 0.6 else "https://hot.org/"
        headers = {k: v for k, v in (("ETag", rng.choice(["1", "W/1", "2"])), ("Last-Modified", rng.choice("ab")), ("Set-Cookie", "c"), ("DATE", str(i))) if rng.random() < 0.6}
        out.append((i, url, rng.choice([None, *range(60)]), rng.choice(["response", "revisit", "revisit", None]), headers if rng.random() < 0.9 else None, rng.choice([None, None, "d1", "d2"])))
    return out


def test_equals_brute_force(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges, also of the hot url
    try:
        rows = records(400, 1)
        df = spark.createDataFrame(rows, SCHEMA)
        keys = {r["record_id"]: r["k"] for r in df.select("record_id", canonical_url(F.col("url")).alias("k")).collect()}
        want = brute(rows, [keys[r[0]] for r in rows])
        got = {r["record_id"]: (r["record_id"], r["response_id"], r["resolution"], r["headers"]) for r in resolve_revisits(df).collect()}
        assert got == {w[0]: w for w in want}
        assert {w[2] for w in want} == {"response", "no_response", "unvalidated", "mismatch", "resolved"}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_canonical_urls(spark):
    urls = ["HTTP://A.Org:80", "https://a.org:443/B?", "http://a.org:8080/?b=2&utm_source=x&a=1#z", "https://a.org:80/x?q=http://y", "a.org/x", None, " http://a.org/ "]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()]
    assert got == ["http://a.org/", "https://a.org/B", "http://a.org:8080/?b=2&a=1", "https://a.org:80/x?q=http://y", None, None, "http://a.org/"]


def test_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a/", 1, "response", {"etag": "x"}, None)] * 2 + [(2, "http://a/", 2, "revisit", {"ETag": "x"}, None)] * 2, SCHEMA).withColumn("near", F.lit(1))
    assert sorted(r["resolution"] for r in resolve_revisits(df).collect()) == ["resolved", "resolved", "response", "response"]
    assert resolve_revisits(df.limit(0)).count() == 0
