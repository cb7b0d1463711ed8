"""Operator 5, MinHash near-dedup with odd sketches.

Each text becomes the set of its word shingles; equal sets form one class.  A class gets ``HASHES``
MinHash samples.  They make ``BANDS`` band keys (candidates share a band), and they are folded into
an odd sketch: a parity bitmap in which sample i flips one bit.  The XOR of two sketches has a
population count z from which the number of differing samples is about -b/2 ln(1 - 2z/b), a precise
estimate at high similarity; pairs that are far off the threshold by it are dropped, the rest are
confirmed on the full shingle sets.  Where many candidates meet, an odd sketch of the whole sets
comes before that: its differing bits are a lower bound of the differing shingles.

A bucket of a band is not expanded into its pairs.  First each member is compared with the bucket's
most central member only (the one with most fellow members over all its bands: in a group of edited
copies, the text they were made from), and components are formed.  Members of one bucket that are
still in different components, and only those, are then compared with each other, in blocks of
``BLOCK`` members and each pair in its first common band, so a link that does not pass through a
central member is found as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import prepare, stored, text_of

BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
SKETCH_BITS = 512
#: Bits of the parity bitmap of a whole shingle set, for the candidates that are compared in blocks.
PARITY_BITS = 4096
#: Members of a bucket that one block compares with another block.
BLOCK = 1000
#: Bits of the filter that picks the candidates' texts; its size is fixed.
FILTER_BITS = 1 << 24
#: Standard deviations below the threshold at which a sketch still lets a pair pass.
MARGIN = 4.5
_M1, _M2, _ODD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def _family() -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, 2 * HASHES + 1, dtype=np.uint64)
    r = _mixed(at * _ODD)
    return r[:HASHES] | np.uint64(1), r[HASHES:]


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, size: int):
        self.size = size
        self.words: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.words
        if len(known) > 500_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        n = max(1, len(h) - self.size + 1)
        with np.errstate(over="ignore"):
            out = np.full(n, np.uint64(min(self.size, len(h))))
            for k in range(min(self.size, len(h))):
                out = _mixed(out * _ODD + h[k:k + n])
        return np.unique(out)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for s in range(0, len(shingles), 1024):
            x = shingles[s:s + 1024, None] * a[None, :]
            x += b[None, :]
            np.minimum(best, x.min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    s = samples.reshape(BANDS, BAND_ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _M2
        for k in range(BAND_ROWS):
            key = _mixed(key * _ODD + s[:, k])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        bit = _mixed(samples * _M1 + np.arange(len(samples), dtype=np.uint64) * _ODD) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parity(shingles: np.ndarray) -> bytes:
    """Parity bitmap of a whole set: two bitmaps differ in at most as many bits as the sets in shingles."""
    bit = (shingles >> _S33) % np.uint64(PARITY_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing_bits_limit(threshold: float) -> int:
    """Largest XOR population count that a pair at the threshold shows, ``MARGIN`` deviations out."""
    differ = 2 * HASHES * (1 - threshold)
    left = np.exp(-2 * differ / SKETCH_BITS)
    z = SKETCH_BITS / 2 * (1 - left)
    of_samples = 2 * left * np.sqrt(HASHES * threshold * (1 - threshold))  # how z varies with the samples drawn
    of_bits = np.sqrt(SKETCH_BITS / 4 * (1 - left ** 2))  # and with where their bits fall
    return int(np.ceil(z + MARGIN * np.hypot(of_samples, of_bits)))


def _signatures(size: int):
    def run(batches):
        shingler, (a, b) = Shingler(size), _family()
        for batch in batches:
            n, lo, hi, bands, sketch = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler.shingles(text)
                n.append(len(s))
                if not len(s):
                    lo.append(0), hi.append(0), bands.append(None), sketch.append(None)
                    continue
                d = xxhash.xxh128_digest(s.tobytes())
                lo.append(int.from_bytes(d[:8], "big", signed=True))
                hi.append(int.from_bytes(d[8:], "big", signed=True))
                m = minhash(s, a, b)
                bands.append(band_keys(m))
                sketch.append(odd_sketch(m))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["id", "n", "lo", "hi", "bands", "sketch"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node on an edge; root is the smallest node that it reaches.

    Alternates large-star and small-star steps; each round is a written table, so no lineage grows.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "op5-edges")
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "op5-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "op5-small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        if now == state:
            return e.select("u", F.col("v").alias("root"))
        state = now


def _candidate_sets(docs: DataFrame, wanted: DataFrame, size: int, repeats: bool) -> DataFrame:
    """(id, set, parity) of the wanted ids.  A bitmap of fixed size keeps other texts out of the shuffle."""
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    maps = (wanted.select((slot + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect())  # FILTER_BITS bits at most
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in maps:  # bucket k holds the 32768 slots from (k - 1) * 32768 on
        got = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        bits[(r["k"] - 1) * 4096:][:len(got)] |= got
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches):
        table, shingler = shared.value, Shingler(size)
        for b in batches:
            s = b.column("slot").to_numpy()
            hit = np.flatnonzero((table[s >> 3] >> (s & 7).astype(np.uint8)) & 1)
            texts = b.column("text")
            out = [shingler.shingles(texts[int(k)].as_py()) for k in hit]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(hit)), pa.array([x.view(np.int64) for x in out], pa.list_(pa.int64())),
                                              pa.array([parity(x) for x in out], pa.binary())], names=["id", "set", "parity"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.filter("id is not null").select("id", slot.alias("slot"), "text").mapInArrow(sets, f"id {kind}, set array<bigint>, parity binary")
    rows = rows.join(wanted, "id", "left_semi")
    if repeats:
        rows = rows.withColumn("h", F.xxhash64("set")).dropDuplicates(["id", "h"]).drop("h")
    return rows


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("id").alias("u"), F.col("set").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("set").alias("sv"))
    rows = pairs.join(a, "u").join(b, "v").withColumn("i", F.size(F.array_intersect("su", "sv")))
    return rows.filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("su") + F.size("sv") - F.col("i"))).select("u", "v")


def _near(limit: int):
    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("su").to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column("sv").to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1)
            hit = np.flatnonzero(np.bitwise_count(x ^ y).sum(axis=1) <= limit)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(hit)) for c in ("u", "v")], names=["u", "v"])
    return run


class _Block:
    """Members of buckets as arrays."""

    def __init__(self, part: pd.DataFrame):
        self.key, self.own, self.n = (part[c].to_numpy() for c in ("key", "own", "n"))
        self.id, self.root = (part[c].to_numpy() if part[c].dtype.kind in "iu" else part[c].to_numpy(dtype=object) for c in ("id", "root"))
        self.bands = np.stack(part["bands"].to_numpy())
        self.sketch, self.parity = (np.frombuffer(b"".join(part[c]), dtype=np.uint64).reshape(len(part), -1) for c in ("sketch", "parity"))

    def open_pairs(self, first: np.ndarray, second: np.ndarray, same: bool, limit: int, percent: int):
        """(u, [v ...]) of one bucket's members that may be linked and are in different components."""
        if not len(first) or not len(second):
            return
        rooted = self.root[second]
        names, counts = np.unique(rooted, return_counts=True)
        most = names[counts.argmax()]
        rest = second[rooted != most]  # all that a member of the largest component can be open with
        before = int(np.flatnonzero(self.bands[first[0]] == self.key[first[0]])[0])  # bands in front of this one
        for u in first.tolist():
            if self.root[u] != most:
                v = second[rooted != self.root[u]]
            elif not same:
                v = rest
            else:
                continue  # the same pairs come up from their other side
            v = v[np.bitwise_count(self.sketch[u] ^ self.sketch[v]).sum(axis=1) <= limit]
            if before and len(v):
                v = v[~(self.bands[u, :before] == self.bands[v, :before]).any(axis=1)]
            if len(v):
                # odd bits never outnumber the shingles that differ, so this bound loses no link
                odd = np.bitwise_count(self.parity[u] ^ self.parity[v]).sum(axis=1)
                v = v[(100 + percent) * odd <= (100 - percent) * (self.n[u] + self.n[v])]
            if len(v):
                yield u, v


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked;
    component_id is the smallest id that a document reaches, and that document is kept.  A text
    without words has no set and is linked with nothing.  A null id is linked with nothing: its
    component_id is null and it is kept.  Repeated rows of an id with one text share its component; an
    id that comes with several texts is one node, linked if any of its texts is, and each of its rows
    carries the component of its own text.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sigs = stored(rows.mapInArrow(_signatures(shingle), f"id {kind}, n long, lo long, hi long, bands array<bigint>, sketch binary"), "op5-signatures")

    linked = sigs.filter("n > 0 and id is not null")
    classes = stored(linked.groupBy("lo", "hi", "n").agg(F.min("id").alias("rep")), "op5-classes")
    reps = linked.join(classes.withColumnRenamed("rep", "id"), ["id", "lo", "hi", "n"]).select("id", "lo", "hi", "bands", "sketch")
    reps = stored(reps, "op5-reps")
    repeats = reps.count() > classes.count()  # rows that repeat an id with its text
    if repeats:
        reps = stored(reps.dropDuplicates(["id", "lo", "hi"]), "op5-reps")

    keys = reps.select(F.explode("bands").alias("key"), "id")
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "op5-sizes")
    members = stored(keys.join(sizes, "key"), "op5-in-buckets")  # key, id, members
    fellows = stored(members.groupBy("id").agg(F.sum("members").alias("fellows")), "op5-fellows")
    members = stored(members.join(fellows, "id"), "op5-weighed")
    centre = members.groupBy("key").agg(F.max(F.struct("fellows", F.hash("id"), "id")).alias("c")).select("key", F.col("c.id").alias("centre"))
    shared = stored(members.join(stored(centre, "op5-centres"), "key"), "op5-members")  # key, id, members, centre

    sketch_u = reps.select(F.col("id").alias("u"), F.col("sketch").alias("su"))
    sketch_v = reps.select(F.col("id").alias("v"), F.col("sketch").alias("sv"))
    limit = differing_bits_limit(percent / 100)

    stars = shared.filter("id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")).distinct()
    stars = stars.join(sketch_u, "u").join(sketch_v, "v").mapInArrow(_near(limit), f"u {kind}, v {kind}")
    stars = stored(stars, "op5-stars")
    sets = stored(_candidate_sets(rows, shared.select("id").distinct(), shingle, repeats), "op5-sets")
    edges = stored(_confirmed(stars, sets, percent), "op5-links")
    roots = components(edges)

    # members of a bucket that the first pass left in different components
    placed = shared.join(roots.withColumnRenamed("u", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = stored(placed, "op5-placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
    todo = placed.join(stored(open_, "op5-open"), "key").join(reps.select("id", "bands", "sketch"), "id").join(sets.select("id", "parity", F.size("set").alias("n")), "id")
    todo = todo.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    todo = todo.withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    todo = todo.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # buckets of one block go to the workers in bundles, a block of a larger bucket by itself
    bundles = max(1, placed.count() // (2 * BLOCK))
    todo = todo.withColumn("alone", F.col("blocks") > 1).withColumn("bundle", F.when(F.col("alone"), F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(bundles))))
    todo = todo.select("alone", "bundle", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "bands", "sketch", "parity", "n")

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        block = _Block(part)
        order = np.argsort(block.key, kind="stable")
        cuts = np.flatnonzero(np.diff(block.key[order])) + 1
        us, vs = [], []
        for members in np.split(order, cuts):
            first, second = members[block.own[members] == key[2]], members[block.own[members] == key[3]]
            for u, v in block.open_pairs(first, second, key[2] == key[3], limit, percent):
                us.append(np.full(len(v), block.id[u], dtype=block.id.dtype))
                vs.append(block.id[v])
        none = np.empty(0, dtype=block.id.dtype)
        us, vs = np.concatenate([none, *us]), np.concatenate([none, *vs])
        return pd.DataFrame({"u": pd.Series(us, dtype=us.dtype), "v": pd.Series(vs, dtype=vs.dtype)})  # ids of any type

    more = todo.groupBy("alone", "bundle", "i", "j").applyInPandas(compare, f"u {kind}, v {kind}")
    more = stored(more.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "op5-more")
    found = _confirmed(more, sets, percent)
    both = stored(edges.union(found), "op5-all-links")
    roots = components(both)

    named = classes.join(roots.withColumnRenamed("u", "rep"), "rep", "left").select("lo", "hi", F.col("n").alias("n"), F.coalesce("root", "rep").alias("component_id"))
    named = stored(named, "op5-components")
    own = sigs.select("id", "n", "lo", "hi")
    out = own.filter("n > 0 and id is not null").join(named, ["lo", "hi", "n"]).select("id", "n", "component_id")
    out = out.union(own.filter("n = 0 or id is null").select("id", "n", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

