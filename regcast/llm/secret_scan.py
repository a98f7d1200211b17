"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

One pass over the texts finds candidate spans and hashes their values; texts
stay behind. The hashes are counted by distinct owners and repositories:
values that many owners or many repositories hold are copied examples, values
of few are live, unless they say themselves that they are placeholders. Spans
beside the base patterns are only added where the value also looks random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regcast.llm.common import fresh, maybe_broadcast, prepare, quoted
from regcast.session import materialize

#: kind -> (pattern, group that holds the value, least length of the value). Fixed values, in the order of the kinds.
#: For access and hex the least length stands in the pattern: their matches are maximal runs, so this drops the same ones.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: What the method adds: long runs of token characters, kept where ownership says live and no base span overlaps.
ADDED = {"opaque": (r"[A-Za-z0-9+/_-]{20,}", 0, 20)}
KINDS = list(BASE) + list(ADDED)
MAX_OWNERS = 2  # a live value has at most so many owners
MAX_REPOS = 20  # and is in at most so many repositories (documents): an owner that copies a value about has made it an example
MIN_DISTINCT = 8  # different characters of an added value, which also has a digit and a letter
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|x{4}|your[_-]"
MARK = "[SECRET]"
STEP = 256


def _plausible(value: Column, kind: str) -> Column:
    """No placeholder; outside the base patterns, which name a secret themselves, also random-looking."""
    real = ~value.rlike(PLACEHOLDER)
    if kind in BASE:
        return real
    return real & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _with_spans(df: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """``df`` (with ``text``) plus an array column named after the kind: its spans in order.

    Matches and the pieces between them give every match's place by a prefix
    sum, in blocks of ``STEP`` so that its cost stays near-linear in the matches.
    """
    names = fresh(df, "_m", "_v", "_len", "_block", "_base")
    m, v, ln, block, base = names
    none = F.array().cast("array<int>")
    df = df.withColumn(m, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    found = F.size(m) > 0
    df = df.withColumn(v, F.when(found, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))) if group else F.col(m))
    piece = F.transform(F.split("text", pattern), lambda x: F.length(x))
    before = F.concat(F.array(F.lit(0)), F.transform(F.col(m), lambda x: F.length(x)))
    df = df.withColumn(ln, F.when(found, F.zip_with(piece, before, lambda a, b: a + b)).otherwise(none))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int"))
    df = df.withColumn(block, F.when(found, F.transform(blocks(F.size(ln)), lambda b: add(F.slice(ln, b * STEP + 1, STEP)))))
    df = df.withColumn(base, F.when(found, F.transform(blocks(F.size(ln)), lambda b: add(F.slice(block, F.lit(1), b)))))
    place = lambda i: F.get(base, F.floor(i / STEP).cast("int")) + add(F.slice(ln, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP + 1))
    spans = F.transform(F.arrays_zip(F.col(m).alias("m"), F.col(v).alias("v")), lambda x, i: F.struct(place(i).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["m"].alias("m"), x["v"].alias("v")))
    full = F.transform(F.filter(spans, lambda s: F.length(s["v"]) >= least), lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), (s["start"] + F.length(s["m"])).alias("end"),
        F.length(s["v"]).alias("width"), F.sha2(s["v"], 256).alias("hash"), _plausible(s["v"], kind).alias("looks"),
    ))
    return df.withColumn(kind, F.when(found, full).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,width:int,hash:string,looks:boolean>>"))).drop(*names)


def candidates(docs: DataFrame, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """id columns, ``owner``, ``repo``, ``key`` (digest of a text with spans) and one span array a kind; without the text."""
    df = docs.select(F.col(quoted(repo_col)).alias("repo"), F.col(quoted(owner_col)).alias("owner"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    for kind, (pattern, group, least) in (BASE | ADDED).items():
        df = _with_spans(df, kind, pattern, group, least)
    apart = lambda s: ~F.exists(F.concat(*BASE), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.withColumn("opaque", F.filter("opaque", lambda s: s["looks"] & apart(s)))
    some = F.size(F.concat(*KINDS)) > 0
    return df.select("repo", "owner", F.when(some, F.sha2("text", 256)).alias("key"), *KINDS)


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(hash, n_owners, n_repos, copied, live) of every candidate value.

    Copied: more than ``max_owners`` owners or ``max_repos`` repositories hold it
    (a repository of two owners counts for each; null is an owner and a
    repository like any other). Live: not copied and plausible.
    """
    values = found.filter("key is not null").select("owner", "repo", F.explode(F.concat(*KINDS)).alias("s"))
    by_repo = values.groupBy(F.col("s.hash").alias("hash"), "owner", "repo").agg(F.max("s.looks").alias("looks"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("looks").alias("looks"))
    total = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("looks").alias("looks"))
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)
    return total.select("hash", "n_owners", "n_repos", copied.alias("copied"), (F.col("looks") & ~copied).alias("live"))


def _judged(found: DataFrame, owners: DataFrame) -> DataFrame:
    """Per text with spans: its ``live`` spans, the number of spans with a copied value and the most repositories of a value."""
    texts = found.filter("key is not null").groupBy("key").agg(*[F.first(k).alias(k) for k in KINDS])
    spans = texts.select("key", F.explode(F.concat(*KINDS)).alias("s")).withColumn("hash", F.col("s.hash"))
    judged = spans.join(owners.select("hash", "copied", "live", "n_repos"), "hash")
    mine = F.when(F.col("live"), F.struct("s.start", "s.rank", "s.end", "s.width"))
    return judged.groupBy("key").agg(F.collect_list(mine).alias("live"), F.sum(F.when(F.col("copied"), 1).otherwise(0)).alias("n_example"), F.max("n_repos").alias("n_repos"))


def _text(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document: ``repo_col``, counts and strings of spans, and what ownership says.

    n_assign, n_access, n_hex and ``base`` (kind:start:end, code points, end
    exclusive, by start and then kind) are of the base patterns; ``spans`` also
    has the opaque spans whose value is live. n_live counts the spans with a
    live value, n_example those with a copied one; placeholders that few hold are
    neither. n_repos is the most repositories that hold a value of the text.
    A null text is empty. Rows with equal texts get equal spans; null owners
    and ids are values like others; repeated rows each get their row. Other
    columns are left out.
    """
    prepare(docs.sparkSession)
    found = materialize(candidates(docs, text_col, owner_col, repo_col))
    judged = _judged(found, ownership(found, max_owners, max_repos))
    # texts without a span have no key: they pass by the join instead of meeting in one of its tasks
    rows = found.filter("key is not null").join(judged, "key", "left").unionByName(found.filter("key is null"), allowMissingColumns=True)
    slim = F.transform(F.concat(*BASE), lambda s: F.struct(s["start"], s["rank"], s["end"], s["width"]))
    live = F.coalesce("live", F.array().cast("array<struct<start:int,rank:int,end:int,width:int>>"))
    added = F.filter(live, lambda s: s["rank"] >= len(BASE))
    return rows.select(
        F.col("repo").alias(repo_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        _text(slim).alias("base"), _text(F.concat(slim, added)).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("n_repos", F.lit(0)).alias("n_repos"),
    )


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", chars_col: str | None = "n_chars", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``docs`` with every live value replaced by ``MARK``; copied examples stay, and so does every document.

    ``chars_col``, if there, follows the new text. Only texts with candidates
    are joined to the findings (by digest); the others pass straight through.
    Null and empty texts stay as they are; equal texts and repeated rows are
    masked alike; of overlapping live values the first is masked with what
    follows it. An empty table stays empty; other columns are kept.
    """
    prepare(docs.sparkSession)
    found = materialize(candidates(docs, text_col, owner_col, repo_col))
    key, live = fresh(docs, "_key", "_live")
    judged = _judged(found, ownership(found, max_owners, max_repos)).filter(F.size("live") > 0)
    judged = maybe_broadcast(judged.select(F.col("key").alias(key), F.array_sort(F.transform("live", lambda s: F.struct((s["end"] - s["width"]).alias("a"), s["end"].alias("b")))).alias(live)))
    text = F.col(quoted(text_col))
    some = F.coalesce(text.rlike("|".join(p for p, _, _ in (BASE | ADDED).values())), F.lit(False))
    there = docs.filter(some).withColumn(key, F.sha2(text, 256)).join(judged, key, "left")
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["b"]).alias("at"),
        F.when(s["a"] >= acc["at"], F.concat(acc["out"], F.array(cut(acc["at"], s["a"]), F.lit(MARK)))).otherwise(acc["out"]).alias("out"),
    )
    new = F.aggregate(live, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), cut(acc["at"], F.length(text))))
    there = there.withColumn(text_col, F.when(F.col(live).isNotNull(), new).otherwise(text))
    if chars_col and chars_col in docs.columns:
        there = there.withColumn(chars_col, F.when(F.col(live).isNotNull(), F.length(text)).otherwise(F.col(quoted(chars_col))).cast(docs.schema[chars_col].dataType))
    return there.select(*map(quoted, docs.columns)).unionAll(docs.filter(~some))
