"""Operator 8, line dedup by word: winnowing over grams of words, wherever in a line they stand.

Every run of ``min_words`` words of a text is a window, keyed by hashes of its words.  A window that
occurred earlier (by id, then by position) is deleted; a longer repeated run is the union of its
windows, so it needs no extension and its ends may lie inside lines.

Not every window is shuffled.  An anchor is a place where the codes of the first characters of three
words are even, odd and odd; its gram is the third of a window that begins there.  Anchors depend on
the words alone, so equal windows hold equal grams, and a window is looked at only if all grams
inside it occur at more than one place.  A text costs one hash a gram, not some a word.

Windows that hold no gram (tables, some scripts) are hashed one by one, and those are looked at whose
hash occurs at more than one place.  Equal windows are of one kind.

Texts that are equal as a whole are looked at once: the later ones go without their windows.  Texts are
fetched only where a window may repeat; a bit map of fixed size keeps most others out of the joins.

Keys of windows are made by doubling: two grams of n words give one of 2n.  Native columns only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.llm.common import let, prepare, stored, text_of, words_of

MIN_WORDS = 50
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
RUNS = "array<struct<from:int,to:int>>"
#: End of a run that covers all words.
ALL = 2**31 - 1
#: Bits of the map of texts that a join may concern; at most BITS / 8 bytes are broadcast.
BITS = 2**25


def gram_words(min_words: int) -> int:
    """Words of a gram: the largest power of two that is at most three quarters of a window."""
    n = 1
    while 8 * n <= 3 * min_words:
        n *= 2
    return n


def _joined(a: Column, shifts: list[int], op: Callable[..., Column]) -> Column:
    """``op`` of each element and those ``shifts`` after it, where the last of them exists."""
    return F.transform(F.slice(a, 1, F.greatest(F.size(a) - max(shifts), F.lit(0))), lambda x, i: op(x, *[F.get(a, i + s) for s in shifts]))


def _doubled(a: Column, length: int, op: Callable[..., Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of ``op`` over every run of ``length`` (a power of two) elements."""
    def up(x: Column, have: int) -> Column:
        return then(x) if have == length else let(_joined(x, [have], op), lambda y: up(y, 2 * have))

    return up(a, 1)


def _grams(words: Column, min_words: int, then: Callable[[Column], Column]) -> Column:
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _doubled(h, gram_words(min_words), F.xxhash64, then))


def window_keys(words: Column, min_words: int) -> Column:
    """Two hashes of every window: of grams that cover it."""
    n = gram_words(min_words)
    shifts = sorted({*range(n, min_words - n, n), min_words - n} - {0})
    pair = lambda x, *more: F.struct(x.alias("key"), (more[0] if len(more) == 1 else F.xxhash64(x, *more)).alias("key2"))
    return _grams(words, min_words, lambda g: _joined(g, shifts or [0], pair))


def anchor_words(min_words: int) -> int:
    """Words of an anchor's gram."""
    return max(3, min_words // 3)


def anchor_places(words: Column, min_words: int) -> Column:
    """Where the grams of anchors begin, in words."""
    odd = F.transform(words, lambda w: F.ascii(w).bitwiseAND(F.lit(1)))
    at = lambda o: F.transform(o, lambda x, i: F.when((x == 0) & (F.get(o, i + 1) == 1) & (F.get(o, i + 2) == 1) & (i + anchor_words(min_words) <= F.size(o)), i))
    return F.array_compact(let(odd, at))


def anchors(words: Column, places: Column, min_words: int) -> Column:
    """key (hash of the gram) of each anchor; windows p0 to last have it as their first anchor, those after ``stop`` hold the next one's gram."""
    n = anchor_words(min_words)
    return F.transform(places, lambda p, k: F.struct(
        F.xxhash64(F.array_join(F.slice(words, p + 1, n), " ")).alias("key"), F.coalesce(F.get(places, k - 1) + 1, F.lit(0)).alias("p0"),
        F.least(p, F.size(words) - min_words).alias("last"), (F.get(places, k + 1) + (n - 1 - min_words)).alias("stop")))


def plain_windows(words: Column, places: Column, min_words: int) -> Column:
    """p0, p1, key of the windows (p1 = p0 + 1) that hold no anchor's gram."""
    n, starts = F.size(words), max(0, min_words - anchor_words(min_words) + 1)
    ends = F.concat(places, F.array(n + starts))
    # from one place to the next, the windows that begin ``starts`` or more words before the next
    gaps = F.transform(ends, lambda p, k: F.struct(F.coalesce(F.get(places, k - 1) + 1, F.lit(0)).alias("p0"), F.least(p - starts, n - min_words).alias("last")))
    at = F.flatten(F.transform(F.filter(gaps, lambda g: g["p0"] <= g["last"]), lambda g: F.sequence(g["p0"], g["last"])))
    return F.transform(at, lambda i: F.struct(i.alias("p0"), (i + 1).alias("p1"), F.xxhash64(F.array_join(F.slice(words, i + 1, min_words), " ")).alias("key")))


def _joint(sorted_items: Column, after: Callable[[Column, Column], Column], of: Callable[[Column, Column], Column]) -> Column:
    """``of`` the first and last of each run of items in which none is ``after`` the one before it by a gap."""
    begin = F.filter(sorted_items, lambda x, k: F.coalesce(after(x, F.get(sorted_items, k - 1)), F.lit(True)))
    end = F.filter(sorted_items, lambda x, k: F.coalesce(after(F.get(sorted_items, k + 1), x), F.lit(True)))
    return F.zip_with(begin, end, of)


def _repeated(places: DataFrame) -> DataFrame:
    """th, at: the places ``at`` of each text whose key occurs at more than one place (of equal texts, one counts)."""
    place = F.xxhash64("th", "at.p0")
    often = places.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("key")
    return places.join(stored(often, "op8-often"), "key").groupBy("th").agg(F.sort_array(F.collect_set("at")).alias("at"))


def _may_be_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false only for a th that is not in ``keys``, by a map of BITS bits."""
    bit = F.pmod(F.col("th"), F.lit(BITS)) + 1  # Spark's bit maps count from 1
    bits = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(byte, at)").bitwiseAND(F.lit(1)) == 1
    out = rows.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "bucket", "left")
    out = out.withColumn("byte", byte).withColumn("at", (at % 8).cast("int")).withColumn("maybe", F.coalesce(hit, F.lit(False)))
    return out.drop("bucket", "bits", "byte", "at")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, th (hash of the text), runs: the words to delete, as disjoint [from, to), for texts that have any."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter("id is not null")
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")

    def marks_of(words: Column) -> Column:
        marks = let(anchor_places(words, min_words), lambda p: F.struct(anchors(words, p, min_words).alias("anchors"), plain_windows(words, p, min_words).alias("plain")))
        return F.when(F.size(words) >= min_words, marks)

    marks = stored(rows.select("id", "th", let(words_of(F.col("text")), marks_of).alias("m")), "op8-marks").filter("m is not null")
    owners = stored(marks.groupBy("th").agg(F.min("id").alias("id"), F.max("id").alias("id1")), "op8-texts")
    grams = marks.select("th", F.posexplode("m.anchors").alias("k", "a")).select("th", "a.key", F.struct("a.p0", "k", "a.last", "a.stop").alias("at"))
    plain = marks.select("th", F.explode("m.plain").alias("r")).select("th", "r.key", F.struct("r.p0", "r.p1").alias("at"))
    # runs of anchors whose grams all repeat, and neighbouring ranges of plain windows
    held = _joint(F.col("at"), lambda x, y: x["k"] > y["k"] + 1, lambda a, b: F.struct(a["p0"].alias("p0"), (F.least(b["last"], b["stop"]) + 1).alias("p1")))
    held = _repeated(grams).select("th", F.filter(held, lambda r: r["p0"] < r["p1"]).alias("held"))
    joined = _joint(F.col("at"), lambda x, y: x["p0"] > y["p1"], lambda a, b: F.struct(a["p0"].alias("p0"), b["p1"].alias("p1")))
    joined = _repeated(plain).select("th", joined.alias("plain"))
    none = F.array().cast("array<struct<p0:int,p1:int>>")
    some = held.join(joined, "th", "full").select("th", F.concat(F.coalesce("held", none), F.coalesce("plain", none)).alias("ranges"))
    # of equal texts, the first
    some = stored(some.filter(F.size("ranges") > 0).join(owners.select("id", "th"), "th"), "op8-some")
    fetched = _may_be_in(rows, some).filter("maybe").join(some, ["id", "th"]).select("id", "th", "ranges", words_of(F.col("text")).alias("words"))

    def keyed(r: Column) -> Column:
        keys = window_keys(F.slice("words", r["p0"] + 1, r["p1"] - r["p0"] + (min_words - 1)), min_words)
        return F.transform(keys, lambda key, k: F.struct(key["key"].alias("key"), key["key2"].alias("key2"), (r["p0"] + k).alias("i")))

    def marked(x: Column, y: Column) -> Column:
        again = F.coalesce((x["key"] == y["key"]) & (x["key2"] == y["key2"]) & (x["i"] > y["i"]), F.lit(False))
        return F.struct(F.when(again, F.xxhash64("id", "th", x["i"])).otherwise(x["key"]).alias("key"), F.when(~again, x["key2"]).alias("key2"), x["i"].alias("i"))

    # a window that repeats inside its text ("a b a b ...") is gone whatever other texts hold: such rows get keys of their own, and no key2
    ordered = lambda w: let(F.sort_array(w), lambda s: F.transform(s, lambda x, k: marked(x, F.get(s, k - 1))))
    every = let(F.flatten(F.transform("ranges", keyed)), lambda w: F.when(F.size(F.array_distinct(w["key"])) < F.size(w), ordered(w)).otherwise(w))
    windows = fetched.select("id", "th", F.inline(every))
    place = F.rank().over(Window.partitionBy("key", "key2").orderBy("id", "i", "th"))  # equal for repeated rows
    at = windows.withColumn("place", place).filter("place > 1 or key2 is null").groupBy("id", "th").agg(F.sort_array(F.collect_set("i")).alias("at"))
    runs = _joint(F.col("at"), lambda x, y: x > y + min_words, lambda a, b: F.struct(a.alias("from"), (b + min_words).alias("to")))
    runs = at.select("id", "th", runs.cast(RUNS).alias("runs"))

    # a later text that equals an earlier one goes as a whole
    copied = owners.filter("id <> id1").select("th", F.col("id").alias("id0"))
    copies = marks.select("id", "th").join(copied, "th").filter("id <> id0").select("id", "th").distinct()
    whole = F.array(F.struct(F.lit(0).alias("from"), F.lit(ALL).alias("to"))).cast(RUNS)
    return stored(runs.union(copies.select("id", "th", whole.alias("runs"))), "op8-gone")


def _cut(lines: Column, runs: Column) -> Column:
    """The lines without the words of ``runs``; null for a line all of whose words go."""
    def line(x: Column, before: Column, n: Column) -> Column:
        hit = F.filter(runs, lambda r: (r["from"] < before + n) & (r["to"] > before))

        def left(hit: Column) -> Column:
            pieces = F.regexp_extract_all(x, F.lit(f"{WORD}{SPACE}"), F.lit(0))
            stay = F.filter(pieces, lambda p, k: ~F.exists(hit, lambda r: (r["from"] <= before + k) & (r["to"] > before + k)))
            all_gone = F.exists(hit, lambda r: (r["from"] <= before) & (r["to"] >= before + n))
            return F.when(F.size(hit) == 0, x).when(all_gone, F.lit(None)).otherwise(F.concat(F.regexp_extract(x, f"^{SPACE}", 0), F.array_join(stay, "")))

        return let(hit, left)

    counts = F.transform(lines, lambda x: F.size(words_of(x)))
    line_of_word = lambda n: F.flatten(F.transform(n, lambda c, i: F.array_repeat(i, c)))
    return let(counts, lambda n: let(line_of_word(n), lambda at: F.transform(lines, lambda x, i: F.when(F.get(n, i) == 0, x).otherwise(
        let((F.array_position(at, i) - 1).cast("int"), lambda before: line(x, before, F.get(n, i)))))))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """n_lines, n_gone, gone_lines (indexes from 0, comma-joined), then the columns of ``docs`` with the repeated passages out of the text.

    The earlier place, by id and then by position, stays; a passage repeated inside one document
    counts as well.  Words are equal only when all their characters are; white space between them is
    not compared.  gone_lines are the lines all of whose words went; of a line that keeps words, the
    deleted ones go with the white space after them.  Blank lines are kept.  A null id takes no part and a
    null text stays null.  Rows that repeat an id with its text change alike; an id with several
    texts is so many documents.  The three new columns replace input columns of their names.
    """
    gone = repeated_passages(docs, id_col, text_col, min_words)
    plain = docs.drop("n_lines", "n_gone", "gone_lines")
    own = plain.select(F.struct(*plain.columns).alias("r"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"))
    own = _may_be_in(own, gone)
    out = own.filter("maybe").drop("maybe").join(gone, ["id", "th"], "left").select("r", "runs")
    out = out.union(own.filter("not maybe").select("r", F.lit(None).cast(RUNS)))
    out = out.withColumn("lines", F.split(F.col("r")[text_col].cast("string"), "\n", -1))
    out = out.withColumn("left", F.when(F.col("runs").isNotNull(), _cut(F.col("lines"), F.col("runs"))))
    indexes = F.array_compact(F.transform("left", lambda x, i: F.when(x.isNull(), i)))
    text = F.when(F.col("left").isNull(), F.col("r")[text_col]).otherwise(F.array_join("left", "\n"))
    return out.select(F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.size(indexes), F.lit(0)).alias("n_gone"),
                      F.coalesce(F.array_join(indexes.cast("array<string>"), ","), F.lit("")).alias("gone_lines"),
                      *[text.alias(c) if c == text_col else F.col("r")[c].alias(c) for c in plain.columns])
