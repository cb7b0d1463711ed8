"""Operator 4, quality rules: distribution divergence.

Each language gets two reference histograms from all its documents: character classes, and its
``COMMON`` most frequent words (with one bin for all other words).  A document is compared with its
language's references by Jensen-Shannon distance (the root of the divergence in bits, 0 to 1) and is
rejected when a distance is beyond its limit.  Each comparison has a guard: texts shorter than
``MIN_CHARS`` or ``MIN_WORDS`` say too little about a distribution and pass it, and so do languages
with less than ``MIN_REFERENCE`` words.

The limit of the word distance follows from each language's own documents of the same length (four
classes an octave of words), as short texts are further from any reference than long ones: their
median and ``SPREADS`` of their spreads (scaled median deviation), but at most ``TOWARDS_NONE`` of the
way from the median to the distance of a text with none of the common words.  A length with fewer than
``MIN_PEERS`` documents takes the limit of the next shorter one that has them; without one, the limit
is just below the distance of a text without common words.

Native columns only.  A document's work is done in its row (arrays of its own words); only counts by
language and word are shuffled, after partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.llm.common import SPACES, let, prepare, stored, text_of, words_of

COMMON = 256
#: The common words lie in so many buckets by hash, so a lookup reads a few of them only.
BUCKETS = 64
MIN_CHARS, MIN_WORDS, MIN_REFERENCE = 200, 100, 5000
MAX_CLASS_DISTANCE = 0.30
SPREADS, MIN_SPREAD, TOWARDS_NONE, MIN_PEERS = 4.0, 0.005, 2 / 3, 20
NEAR_NONE = 0.98
#: A reference table of more languages than this is joined by shuffle, not broadcast.
BROADCAST_LANGUAGES = 10_000
SYMBOLS = "#*$%&|<>"
#: Classes of characters, each counted in what the earlier ones left; the rest is the last class.
CLASSES = (("lower", r"\p{Ll}+"), ("space", SPACES), ("upper", r"\p{Lu}+"), ("point", r"[.,;:!?'\"()-]+"), ("digit", r"\p{Nd}+"))




def with_classes(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``n_<class>`` columns (long); every class is counted on what the one before left over."""
    left = F.col(text_col)
    df = df.withColumn("__left", left)
    for name, pattern in CLASSES:
        df = df.withColumn("__rest", F.regexp_replace("__left", pattern, ""))
        df = df.withColumn(f"n_{name}", (F.length("__left") - F.length("__rest")).cast("long")).drop("__left").withColumnRenamed("__rest", "__left")
    return df.withColumn("n_other", F.length("__left").cast("long")).drop("__left")


CLASS_COLUMNS = [f"n_{n}" for n, _ in CLASSES] + ["n_other"]


def _term(a: Column, b: Column) -> Column:
    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))

    return half(a, b) + half(b, a)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, x: s + x)


def _root(total: Column) -> Column:
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    return _root(_sum(F.zip_with(p, q, _term)))


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def _word_distance() -> Column:
    """Distance of the words of a text (``bins``: numbers of its common words, sorted) to ref_shares.

    A common word that the text lacks adds its whole share, so only those that it has are looked at."""
    common = _sum("ref_shares")
    starts = F.array_compact(F.transform("bins", lambda b, i: F.when((i == 0) | (b != F.get("bins", i - 1)), i)))

    def term(s: Column, end: Column) -> Column:
        q = F.get("ref_shares", F.get("bins", s) - 1)
        return _term((end - s) / F.col("n_words"), q) - q

    terms = let(starts, lambda at: F.transform(at, lambda s, k: term(s, F.coalesce(F.get(at, k + 1), F.size("bins")))))
    return _root(_sum(terms) + common + _term((F.col("n_words") - F.size("bins")) / F.col("n_words"), F.lit(1.0) - common))


def word_limits(scored: DataFrame) -> DataFrame:
    """lang, length, word_limit from (lang, length, word_distance, none_distance) rows of all documents.

    Distances are counted by thousandths, so what is grouped again does not grow with the documents."""
    hist = scored.filter("word_distance is not null").groupBy("lang", "length", F.round("word_distance", 3).alias("d")).agg(
        F.count("*").alias("n"), F.first("none_distance").alias("none"))
    hist = stored(hist, "op4-distances")
    middle = hist.groupBy("lang", "length").agg(F.expr("percentile(d, 0.5, n)").alias("mid"), F.sum("n").alias("peers"), F.first("none").alias("none"))
    away = hist.join(middle.select("lang", "length", "mid"), ["lang", "length"]).groupBy("lang", "length").agg(F.expr("percentile(abs(d - mid), 0.5, n)").alias("mad"))
    spread = F.greatest(F.col("mad") * 1.4826, F.lit(MIN_SPREAD))
    limit = F.least(F.col("mid") + SPREADS * spread, F.col("mid") + TOWARDS_NONE * F.greatest(F.col("none") - F.col("mid"), F.lit(0.0)))
    shorter = Window.partitionBy("lang").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = F.last(F.when(F.col("peers") >= MIN_PEERS, limit), ignorenulls=True).over(shorter)
    return stored(middle.join(away, ["lang", "length"]).select("lang", "length", F.coalesce(limit, F.col("none") * NEAR_NONE).alias("word_limit")), "op4-limits")


def _shares(counts: list[Column], total: Column) -> Column:
    return F.array(*[c / total for c in counts])


def references(rows: DataFrame) -> DataFrame:
    """lang, ref_classes, ref_words (by bucket), ref_before, ref_shares, ref_total, none_distance from (lang, text, words) rows of all documents."""
    classes = with_classes(rows.select("lang", "text"), "text").groupBy("lang").agg(*[F.sum(c).alias(c) for c in CLASS_COLUMNS])
    chars = sum((F.col(c) for c in CLASS_COLUMNS[1:]), F.col(CLASS_COLUMNS[0]))
    classes = classes.select("lang", _shares([F.col(c) for c in CLASS_COLUMNS], F.greatest(chars, F.lit(1))).alias("ref_classes"))
    counts = rows.select("lang", F.explode(words_of(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    counts = stored(counts.filter("n > 1").union(counts.filter("n = 1").groupBy("lang").agg(F.lit(None).cast("string").alias("w"), F.sum("n").alias("n"))), "op4-counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("ref_total"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "w")
    top = counts.filter("w is not null").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= COMMON)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(_bucket(F.col("w")).alias("b"), "w", "n"))).alias("top")).join(total, "lang")
    buckets = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    top = top.select("lang", "ref_total", F.transform("top", lambda t: t["n"] / F.col("ref_total")).alias("ref_shares"),
                     F.transform(buckets, lambda b: F.transform(F.filter("top", lambda t: t["b"] == b), lambda t: t["w"])).alias("ref_words"),
                     F.transform(buckets, lambda b: F.size(F.filter("top", lambda t: t["b"] < b))).alias("ref_before"))
    common = _sum("ref_shares")
    top = top.withColumn("none_distance", _root(common + _term(F.lit(1.0), F.lit(1.0) - common)))
    return stored(classes.join(top, "lang", "left"), "op4-references")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance (null where a guard holds).

    Null texts are empty (base_failed: less than 50 words).  A null language is the language ''.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text_of(text_col).alias("text"))
    ref = references(rows)
    ref = F.broadcast(ref) if ref.count() <= BROADCAST_LANGUAGES else ref

    df = rows.join(ref, "lang", "left").withColumn("words", words_of(F.col("text")))
    df = with_classes(df, "text")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    df = df.withColumn("n_words", F.size("words").cast("long"))
    # starts of 3-word windows, hashed; only texts in which a window occurs again look further
    grams = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
                        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    df = df.withColumn("grams", F.when(F.col("n_words") >= 4, grams))
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    pairs = F.sort_array(F.arrays_zip(F.col("grams").alias("h"), F.sequence(F.lit(0), F.size("grams") - 1).alias("p")))
    df = df.withColumn("sorted", F.when(again, pairs))
    is_again = lambda s, k: (F.get("sorted", k - 1)["h"] == s["h"]) | (F.get("sorted", k + 1)["h"] == s["h"])
    starts = F.filter("sorted", lambda s, k: F.coalesce(is_again(s, k), F.lit(False)))
    covered = F.flatten(F.transform(starts, lambda s: F.sequence(s["p"], s["p"] + 2)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("sorted").isNotNull(), F.size(F.array_distinct(covered))), F.lit(0)).cast("long"))

    chars = sum((F.col(c) for c in CLASS_COLUMNS[1:]), F.col(CLASS_COLUMNS[0]))
    enough = F.col("ref_total") >= MIN_REFERENCE
    df = df.withColumn("class_distance", F.when(enough & (chars >= MIN_CHARS), js_distance(_shares([F.col(c) for c in CLASS_COLUMNS], chars), F.col("ref_classes"))))
    # number of each common word of the text, sorted
    common = F.filter("words", lambda w: F.array_contains(F.get("ref_words", _bucket(w)), w))
    bins = F.transform(common, lambda w: F.array_position(F.get("ref_words", _bucket(w)), w).cast("int") + F.get("ref_before", _bucket(w)))
    df = df.withColumn("bins", F.when(enough & (F.col("n_words") >= MIN_WORDS), F.sort_array(bins)))
    df = df.withColumn("word_distance", F.when(F.col("bins").isNotNull(), _word_distance()))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = df.select("id", "lang", F.floor(4 * F.log2(F.greatest("n_words", F.lit(1)))).cast("int").alias("length"), "none_distance", "n_words",
                       (F.length("text") - F.col("n_space")).cast("long").alias("word_chars"),
                       (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
                       failed.alias("base_failed"), "class_distance", "word_distance")
    scored = stored(scored, "op4-scored")
    limits = word_limits(scored)
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_LANGUAGES else limits
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    out = scored.join(limits, ["lang", "length"], "left")
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")
