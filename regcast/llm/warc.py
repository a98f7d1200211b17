"""WARC not-modified revisits: an as-of join to the latest earlier full response of the same canonical url.

The as-of join is split by time as well as by url. Records are range-partitioned
on (canonical url, time), so a hot url spreads over many ranges. Within a
range a running maximum finds the latest earlier response; what a range hands
to later ranges of the same url is one row per (url, range), and a running
maximum over those rows carries it forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regcast.llm.common import prepare
from regcast.session import materialize

#: Header fields that a 304 response may update (RFC 9110, 15.4.5, and Last-Modified). Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a resource.
TRACKING = r"(?i)^utm_[a-z]+(=|$)"
HEADERS = "map<string,string>"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment, tracking parameter or empty query; path at least ``/``.

    Null and urls without a scheme have none (null)."""
    u = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    site = F.regexp_replace(F.regexp_replace(F.lower(head), r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    path = F.regexp_extract(rest, r"^[^?]*", 0)
    query = F.substring(rest, F.length(path) + 2, F.length(rest))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    full = F.concat(site, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(head != "", full)


def _lower_names(headers: Column) -> Column:
    """Header entries by lower-cased name, sorted; of repeated names the one that sorts last stays."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | (e["key"] != F.get(entries, i + 1)["key"]))


def _value(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per record: record_id, url_key, kind, response_id, resolution, headers (map).

    ``records`` has record_id, url, ts (long), kind (response or revisit),
    headers (map) and digest; further columns are left out. A revisit looks for
    the response of its canonical url with the greatest ts below its own (of
    equal ts, the greatest record_id). ``resolution``: ``response`` for full
    responses (response_id is their own id); ``no_response`` where there is
    none, or the revisit has no canonical url or no ts; ``unvalidated`` if the
    revisit brings no ETag, Last-Modified or digest; ``mismatch`` if one that it
    brings differs (ETags compare weakly); else ``resolved``, with the
    response's id and its headers updated by the revisit's permitted ones.
    Other revisits keep their own headers. A response without ts is never
    found. A kind other than the two (or null) gets ``no_response``. Repeated
    rows each get their row; null headers count as none.
    """
    prepare(records.sparkSession)
    etag = lambda e: F.regexp_replace(_value(e, "etag"), r"^W/", "")
    entries = _lower_names(F.coalesce(F.col("headers"), F.create_map().cast(HEADERS)))
    r = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "digest", entries.alias("own"))
    r = r.withColumns({"etag": etag(F.col("own")), "modified": _value(F.col("own"), "last-modified")})
    timed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    dealt = materialize(r.filter(timed).repartitionByRange("url_key", "ts").withColumn("range", F.spark_partition_id()))
    found = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "modified", "digest", F.col("own").alias("headers")))
    near = Window.partitionBy("url_key", "range").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    tails = dealt.groupBy("url_key", "range").agg(F.max(found).alias("tail"))
    far = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("carried", F.max("tail").over(far)).filter("carried is not null").select("url_key", "range", "carried")
    rows = dealt.withColumn("near", F.max(found).over(near)).join(carried, ["url_key", "range"], "left")
    rows = rows.withColumn("base", F.coalesce("near", "carried")).select(*r.columns, "base")
    rows = rows.unionByName(r.filter(~timed).withColumn("base", F.lit(None).cast(rows.schema["base"].dataType)))

    brought = [("etag", "etag"), ("modified", "modified"), ("digest", "digest")]
    none = F.lit(True)
    differs = F.lit(False)
    for mine, theirs in brought:
        none = none & F.col(mine).isNull()
        differs = differs | (F.col(mine).isNotNull() & ~F.col(mine).eqNullSafe(F.col("base")[theirs]))
    resolution = (
        F.when(F.col("kind") == "response", "response")
        .when(F.col("base").isNull() | ~F.col("kind").eqNullSafe("revisit"), "no_response")
        .when(none, "unvalidated").when(differs, "mismatch").otherwise("resolved")
    )
    updates = F.filter("own", lambda e: e["key"].isin(*PERMITTED))
    merged = F.array_sort(F.concat(F.filter(F.col("base")["headers"], lambda e: ~F.exists(updates, lambda u: u["key"] == e["key"])), updates))
    rows = rows.withColumn("resolution", resolution)
    ok = F.col("resolution") == "resolved"
    return rows.select(
        "record_id", "url_key", "kind",
        F.when(ok, F.col("base")["record_id"]).when(F.col("resolution") == "response", F.col("record_id")).alias("response_id"),
        "resolution", F.map_from_entries(F.when(ok, merged).otherwise(F.col("own"))).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """``name: value`` lines by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def crawl_log(pages: DataFrame) -> DataFrame:
    """The crawl records that ``pages`` stands for (the tables hold no WARC files).

    Every page is fetched at ts page_id * 10 with its MD5 as ETag (one page in
    seven was fetched before the archive began: no record), asked for again at
    +3 under a tracking parameter and a fragment (a 304; one in five with
    another ETag), one in three is fetched anew at +5 with a new ETag, and all
    are asked for again at +8 with the latest ETag.
    """
    k = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit(""))), 1, 16), F.lit('"'))
    new = F.concat(F.lit('"n'), k.cast("string"), F.lit('"'))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    url2 = F.concat("url", F.when(F.col("url").contains("?"), "&utm_medium=crawl#again").otherwise("?utm_medium=crawl#again"))

    def record(n: int, url: Column, kind: str, when: Column, **headers: Column | str) -> Column:
        pairs = [x for name, v in headers.items() for x in (F.lit(name.replace("_", "-")), F.lit(v) if isinstance(v, str) else v)]
        return F.struct((k * 4 + n).alias("record_id"), url.alias("url"), (k * 10 + (0, 3, 5, 8)[n]).alias("ts"), F.lit(kind).alias("kind"), F.create_map(*pairs).alias("headers"), when.alias("there"))

    every = F.lit(True)
    log = pages.select(F.explode(F.array(
        record(0, F.col("url"), "response", ~(k % 7).eqNullSafe(0), ETag=tag, Content_Type="text/html", Content_Length=size, Date="d0"),
        record(1, url2, "revisit", every, ETag=F.when(k % 5 == 0, '"stale"').otherwise(F.concat(F.lit("W/"), tag)), Content_Length="0", Date="d3"),
        record(2, F.col("url"), "response", k % 3 == 0, ETag=new, Content_Type="text/html", Content_Length=size, Date="d5"),
        record(3, url2, "revisit", every, ETag=F.when(k % 3 == 0, new).otherwise(tag), Cache_Control="max-age=60", Set_Cookie="x", Date="d8"),
    )).alias("r")).filter("r.there")
    return log.select("r.record_id", "r.url", "r.ts", "r.kind", "r.headers", F.lit(None).cast("string").alias("digest"))
