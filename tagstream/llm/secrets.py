"""Operator 9, secret scans: corpus-wide ownership frequency.

Fixed patterns find the base spans.  The method looks at every candidate credential in the corpus,
the value of a base span or any long mixed token, and counts the distinct repositories and owners
that hold it.  A value that more than ``MAX_OWNERS`` owners or ``MAX_REPOSITORIES`` repositories hold is
a widely copied example; any other is live.  A live mixed token that looks random (see
``looks_random``) becomes a span of kind ``owned`` unless it overlaps a base span.

Native columns only.  Candidates are small rows; the counts are by distinct (value, owner,
repository) with partial sums, so a value that is copied everywhere stays a few rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import prepare, stored, text_of

# Fixed patterns (as the task states them)
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
#: A candidate of the method: a whole run of token characters, this long at least, with letter and digit.
TOKEN_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: A value of up to this many owners is specific to them; of more, an example.
MAX_OWNERS = 2
#: Likewise of repositories: a value that one owner copies to more is that owner's template.
MAX_REPOSITORIES = 4
#: A random token has so many different characters, and so many changes a character between letter and
#: digit, or between lower case, upper case and digit.  Paths, slugs and identifiers have whole words.
MIN_DISTINCT, MIN_DIGIT_CHANGES, MIN_CHANGES = 8, 0.12, 0.5
KINDS = ("assign", "access", "hex", "owned")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of the pattern's leftmost non-overlapping matches, in code points.

    The pieces between the matches give the places: the pieces and matches before one add up to its start.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    return F.when(text.rlike(pattern), F.arrays_zip(
        F.transform(between, lambda x: F.length(x)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("len"), value.alias("value")))


def placed(zipped: Column) -> Column:
    """(gap, len, value) triples to (start, end, value); the last gap has no match after it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        a = s["at"] + m["gap"]
        b = a + F.coalesce(m["len"], F.lit(0))
        found = F.struct(a.alias("start"), b.alias("end"), m["value"].alias("value"))
        return F.struct(b.alias("at"), F.when(m["len"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(found))).alias("out"))

    return F.aggregate(zipped, start, step, lambda s: s["out"])


def _kinded(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))


def candidates(rows: DataFrame) -> DataFrame:
    """rows plus ``base`` and ``tokens``: arrays of (start, kind, end, value) in order."""
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    found = rows.select("*", matches(text, ASSIGN, 2).alias("__a"), matches(text, ACCESS).alias("__b"),
                        F.when(text.rlike(r"[0-9a-f]{32}"), matches(text, r"[0-9a-f]{32,}")).alias("__c"), matches(text, TOKEN_RUN).alias("__d")).drop("text")
    long = lambda c, n: F.filter(placed(F.col(c)), lambda m: F.length(m["value"]) >= n)
    base = F.array_sort(F.concat(F.coalesce(_kinded(long("__a", ASSIGN_VALUE), 0), none), F.coalesce(_kinded(long("__b", ACCESS_LENGTH), 1), none),
                                 F.coalesce(_kinded(long("__c", HEX_LENGTH), 2), none)))
    mixed = F.filter(placed(F.col("__d")), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    return found.select("*", base.alias("base"), F.coalesce(_kinded(mixed, 3), none).alias("tokens")).drop("__a", "__b", "__c", "__d")


def looks_random(value: Column) -> Column:
    """Whether a token mixes its characters as random ones do; separators are left out."""
    bare = F.regexp_replace(value, "[+/_=-]", "")
    changes = lambda *edges: F.length(F.regexp_replace(bare, "|".join(f"(?<=[{a}])(?=[{b}])" for a, b in edges), " ")) - F.length(bare)
    digit = changes(("0-9", "A-Za-z"), ("A-Za-z", "0-9"))
    every = changes(("0-9", "A-Za-z"), ("a-z", "A-Z0-9"), ("A-Z", "a-z0-9"))
    return (F.size(F.array_distinct(F.split(bare, ""))) >= MIN_DISTINCT) & (
        (digit >= MIN_DIGIT_CHANGES * F.length(bare)) | (every >= MIN_CHANGES * F.length(bare)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS,
         max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, repositories.

    ``owner`` and ``repository`` are columns of ``docs``; a null one is a name of its own.  n_live and
    n_example count the spans (base and owned) whose value is live, or an example (held by more than
    ``max_owners`` owners or ``max_repositories`` repositories).  repositories has the number of distinct
    repositories of the value of each of ``spans``, comma-joined in their order.  Null texts are empty.  Rows that repeat an id have a row each, with the same result.
    """
    prepare(docs.sparkSession)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(owner.cast("string"), F.lit("\x00")).alias("owner"),
                       F.coalesce(repository.cast("string"), F.lit("\x00")).alias("repo"), text_of(text_col).alias("text"),
                       F.xxhash64(text_of(text_col)).alias("th"))
    # only texts with a candidate have rows here; th tells apart several texts under one id
    found = candidates(rows)
    found = found.withColumn("row", F.xxhash64("id", "th", "owner", "repo"))
    found = stored(found, "op9-candidates")
    spans = found.select("row", "id", "th", "owner", "repo", F.explode(F.concat("base", "tokens")).alias("s"))
    spans = spans.withColumn("h1", F.xxhash64("s.value")).withColumn("h2", F.hash(F.col("s.value"), F.lit(1)))
    held = spans.select("h1", "h2", "owner", "repo").distinct()
    owners = held.groupBy("h1", "h2", "owner").agg(F.count("*").alias("repos"))
    counts = stored(owners.groupBy("h1", "h2").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")), "op9-counts")
    judged = spans.select("id", "th", "owner", "repo", "s", "h1", "h2").join(counts, ["h1", "h2"])
    judged = judged.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repositories))
    judged = judged.withColumn("random", (F.col("s.kind") == 3) & looks_random(F.col("s.value")))
    judged = judged.select("id", "th", "owner", "repo", F.struct("s.start", "s.kind", "s.end", "live", "random", "repos").alias("s")).distinct()
    judged = judged.groupBy("id", "th", "owner", "repo").agg(F.sort_array(F.collect_list("s")).alias("all"))
    judged = judged.withColumnsRenamed({"id": "__id", "th": "__th", "owner": "__owner", "repo": "__repo"})
    out = found.join(judged, found["id"].eqNullSafe(judged["__id"]) & (found["th"] == judged["__th"]) & (found["owner"] == judged["__owner"]) & (found["repo"] == judged["__repo"]), "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,random:boolean,repos:bigint>>")
    out = out.withColumn("all", F.coalesce("all", empty))
    base = F.filter("all", lambda s: s["kind"] < 3)
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    out = out.withColumn("shown", F.filter("all", lambda s: (s["kind"] < 3) | (s["live"] & s["random"] & apart(s))))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(F.col("id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                      F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("shown")).alias("spans"),
                      F.size(F.filter("shown", lambda s: s["live"])).cast("long").alias("n_live"),
                      F.size(F.filter(base, lambda s: ~s["live"])).cast("long").alias("n_example"),
                      F.array_join(F.transform("shown", lambda s: s["repos"].cast("string")), ",").alias("repositories"))
