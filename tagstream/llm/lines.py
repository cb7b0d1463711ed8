"""Operator 8, line dedup: winnowing over line hashes.

A document is the sequence of its lines that hold a word.  The gram of a line is the shortest run of
lines from it with ``GRAM_WORDS`` words or more; the window of a line is the shortest run from it
with ``min_words`` or more.  Of the grams inside a window the one with the smallest hash is the
window's fingerprint.  A run of ``min_words`` words that two documents share holds a whole window of
both, so both pick the same fingerprint: no such run is missed, while neighbouring windows mostly
share one fingerprint row.

Fingerprints that occur once are done with.  The windows of the others are keyed by their content;
each finds the first place (document, line) with that content.  Pairs of documents and line offsets
are made distinct, the match is extended both ways by comparing line hashes along the offset, and
every run of equal lines with ``min_words`` words or more is deleted in the later place.

Every window is joined with one place only, so a passage in a third of all documents makes as many
rows as it has copies.  Native columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.llm.common import SPACES, prepare, stored, text_of

GRAM_WORDS = 25
MIN_WORDS = 50


def _line_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, SPACES), ""))


def line_arrays(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), and for the lines with a word: h (hashes), w (words), at (index among all lines)."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter("id is not null")
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.xxhash64(x).alias("h"), _line_words(x).alias("w"), i.alias("at")))
    rows = rows.select("id", F.xxhash64("text").alias("th"), F.filter(every, lambda s: s["w"] > 0).alias("l"))
    return rows.filter(F.size("l") > 0).select("id", "th", F.col("l.h").alias("h"), F.col("l.w").alias("w"), F.col("l.at").alias("at"))


def windows_of(lines: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """id, th, i (first line of a window), f (its fingerprint), key and key2 (hashes of the window's lines).

    ``before`` is the number of words before a line.  As every line has a word, the lines of the
    shortest run from a line with n words are those less than n words on: a range frame.
    """
    doc = Window.partitionBy("id", "th").orderBy("i")
    df = lines.select("id", "th", F.posexplode(F.arrays_zip("h", "w")).alias("i", "l")).select("id", "th", "i", "l.h", "l.w")
    # rows that repeat an id with its text are one document
    df = df.withColumn("prior", F.lag("i").over(doc)).filter("prior is null or prior <> i")
    df = df.withColumn("before", F.sum("w").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w"))
    ahead = Window.partitionBy("id", "th").orderBy("before")
    gram, run = ahead.rangeBetween(0, gram_words - 1), ahead.rangeBetween(0, min_words - 1)
    df = df.withColumn("gram_n", F.sum("w").over(gram)).withColumn("gram", F.xxhash64(F.collect_list("h").over(gram)))
    df = df.withColumn("g", F.when(F.col("gram_n") >= gram_words, F.struct((F.col("before") + F.col("gram_n")).alias("end"), "gram")))
    df = df.withColumn("n", F.sum("w").over(run)).withColumn("run", F.collect_list("h").over(run)).withColumn("grams", F.collect_list("g").over(run))
    df = df.filter(F.col("n") >= min_words)
    inside = F.filter("grams", lambda g: g["end"] <= F.col("before") + F.col("n"))
    return df.select("id", "th", "i", F.array_min(F.transform(inside, lambda g: g["gram"])).alias("f"),
                     F.xxhash64("run").alias("key"), F.hash("run").alias("key2"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """id, th, gone: indexes (among all lines, from 0) of the lines to delete, for documents that have any."""
    prepare(docs.sparkSession)
    lines = stored(line_arrays(docs, id_col, text_col), "op8-lines")
    windows = stored(windows_of(lines, min_words, gram_words), "op8-windows")
    often = windows.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f")
    shared = stored(windows.join(stored(often, "op8-fingerprints"), "f"), "op8-shared")
    first = shared.groupBy("key", "key2").agg(F.min(F.struct("id", "i", "th")).alias("p"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first.select("key", "key2", F.col("p.id").alias("id0"), F.col("p.th").alias("th0"), F.col("p.i").alias("i0")), "op8-firsts")
    pairs = shared.join(first, ["key", "key2"]).filter("id <> id0 or th <> th0 or i <> i0")
    pairs = stored(pairs.select("id", "th", "id0", "th0", (F.col("i") - F.col("i0")).alias("shift")).distinct(), "op8-pairs")

    b = lines.select(F.col("id").alias("id0"), F.col("th").alias("th0"), F.col("h").alias("h0"))
    both = pairs.join(b, ["id0", "th0"]).join(lines, ["id", "th"])
    # equal lines along the offset, then the runs that are long enough, both ways from wherever they matched
    same = F.transform(F.sequence(F.lit(0), F.size("h") - 1),
                       lambda j: F.coalesce((j >= F.col("shift")) & (F.get("h", j) == F.get("h0", j - F.col("shift"))), F.lit(False)))
    both = both.select("id", "th", "w", "at", same.alias("same"))
    empty = F.struct(F.lit(0).alias("from"), F.lit(0).alias("words"), F.array().cast("array<struct<from:int,to:int>>").alias("runs"))

    def step(s: Column, j: Column) -> Column:
        on = F.coalesce(F.get("same", j), F.lit(False))  # one step past the end closes the last run
        close = F.when(s["words"] >= min_words, F.concat(s["runs"], F.array(F.struct(s["from"].alias("from"), j.alias("to"))))).otherwise(s["runs"])
        return F.struct(F.when(on, s["from"]).otherwise(j + 1).alias("from"),
                        F.when(on, s["words"] + F.get("w", j)).otherwise(0).alias("words"),
                        F.when(on, s["runs"]).otherwise(close).alias("runs"))

    runs = F.aggregate(F.sequence(F.lit(0), F.size("same")), empty, step, lambda s: s["runs"])
    both = both.select("id", "th", "at", runs.alias("runs"))
    gone = F.flatten(F.transform("runs", lambda r: F.slice("at", r["from"] + 1, r["to"] - r["from"])))
    out = both.select("id", "th", F.explode(gone).alias("line")).distinct().groupBy("id", "th").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    return stored(out, "op8-gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """n_lines, n_gone, gone_lines (indexes from 0, comma-joined), then the columns of ``docs`` with the repeated runs out of the text.

    The earlier place, by id and then by line, stays; a run repeated inside one document counts as
    well.  Blank lines are kept, and lines are equal only when all their characters are.  A null id
    takes no part and a null text stays null.  Rows that repeat an id with its text are one document
    and change alike; an id with several texts is so many documents.  The three new columns replace
    input columns of their names.
    """
    gone = repeated_runs(docs, id_col, text_col, min_words, gram_words)
    plain = docs.drop("n_lines", "n_gone", "gone_lines")
    own = plain.select(F.struct(*plain.columns).alias("r"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    out = own.join(gone, ["id", "th"], "left").withColumn("lines", F.split("text", "\n", -1))
    none = F.array().cast("array<int>")
    kept = F.filter(F.transform("lines", lambda x, i: F.when(F.array_contains(F.coalesce("gone", none), i), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col("r")[text_col]).otherwise(F.array_join(kept, "\n"))
    return out.select(F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_gone"),
                      F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("gone_lines"),
                      *[text.alias(c) if c == text_col else F.col("r")[c].alias(c) for c in plain.columns])
