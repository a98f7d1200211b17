"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Only DataFrame functions are used. A url is cut down to what rules can see
(as many host labels, and as many path characters, as the longest rule has),
so the many urls of one site share one key. Each distinct key expands into its
host-suffix x path-prefix expressions; an equi-join on the first 32 bits of
SHA-256 finds candidate rules; the full digest and the rest of the rule's path
confirm them; the longest rule wins. The verdict table has one row per key
that some rule fits, and is joined back to the urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regcast.llm.common import ascii_lower, fresh, maybe_broadcast

PREFIX_HEX = 8  # 32 bits


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _slashes(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("/"), F.lit("")))


def _rules(rules: DataFrame) -> DataFrame:
    """Rules with the digest of host + path up to its last ``/``; rules without a host or action go."""
    path = F.coalesce(F.col("path"), F.lit(""))
    return (
        rules.select(ascii_lower(F.col("host")).alias("host"), path.alias("path"), F.lower("action").alias("action"))
        .filter("host != '' and action in ('allow', 'block')")
        .withColumn("base", F.regexp_extract("path", r"^(?s:.*)/", 0))
        .withColumn("digest", F.sha2(F.concat("host", "base"), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )


def url_verdicts(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has action (allow or block), host and path. A rule fits its host
    and all subdomains when the url's path starts with the rule's path. Of the
    rules that fit, the longest string wins, then the longer host, then block
    before allow. Where none fits, ``rule`` is null and ``verdict`` is
    ``default``. Null urls and urls without ``://`` have empty host and path.
    Repeated rows each get their verdict; repeated rules count once; an empty
    rule table gives every url the default. If ``urls`` already has a column
    host, path, rule or verdict, the new column's name gets a ``_`` behind it.
    """
    host, path, rule, verdict, k1, k2 = fresh(urls, "host", "path", "rule", "verdict", "_host_tail", "_path_head")
    ruled = _rules(rules)
    depth = ruled.agg(F.max(F.size(F.split("host", r"\."))), F.max(_slashes(F.col("base"))), F.max(F.length("path"))).first()
    labels, dirs, chars = (x or 0 for x in depth)
    parts = urls.withColumns({host: url_host(F.col(url_col)), path: url_path(F.col(url_col))})
    if not labels:
        return parts.withColumns({rule: F.lit(None).cast("string"), verdict: F.lit(default)})
    parts = parts.withColumns({k1: F.substring_index(host, ".", -labels), k2: F.substring(path, 1, chars)})
    keys = parts.select(F.col(k1).alias("h"), F.col(k2).alias("p")).distinct()
    n = F.least(F.lit(dirs), _slashes(F.col("p")))
    expressions = keys.select(
        "h", "p", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda i: F.call_function("substring_index", F.col("h"), F.lit("."), -i)))).alias("eh")
    ).select(
        "h", "p", "eh",
        F.explode(F.concat(F.array(F.lit("")), F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: F.concat(F.call_function("substring_index", F.col("p"), F.lit("/"), j), F.lit("/")))).otherwise(F.array().cast("array<string>")))).alias("ep"),
    )
    hashed = expressions.withColumn("full", F.sha2(F.concat("eh", "ep"), 256)).select("h", "p", "full", F.substring("full", 1, PREFIX_HEX).alias("prefix"))
    hits = hashed.join(maybe_broadcast(ruled), "prefix").filter((F.col("full") == F.col("digest")) & F.col("p").startswith(F.col("path")))
    order = F.struct(F.length("host") + F.length("path"), F.length("host"), F.when(F.col("action") == "block", 1).otherwise(0))
    best = hits.groupBy("h", "p").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "action"), order).alias("b"))
    best = maybe_broadcast(best.select(F.col("h").alias(k1), F.col("p").alias(k2), F.col("b.rule").alias(rule), F.col("b.action").alias(verdict)))
    return parts.join(best, [k1, k2], "left").drop(k1, k2).withColumn(verdict, F.coalesce(verdict, F.lit(default)))
