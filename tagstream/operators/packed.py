"""Training and scoring of label trees over packed questions.

A question is one row: its sorted buckets and values, the nodes it reaches and their outcomes.  Features
are therefore stored once per question, not once per reached node, and nothing is shuffled per epoch but
the summed gradients.  Weights go to the tasks in blocks of consecutive nodes of at most ``BLOCK_BYTES``;
node models are independent, so training visits the blocks one after another and holds one at a time.

Scoring searches the tree inside a question's row, best node first.  A path's probability never rises on
the way down, so the first k leaves are the k best ones and the search ends below the wanted probability;
what lies under other nodes is never looked at and no label x question rows are made.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tagstream.session import dimension

#: Largest block of weights that goes to a task at a time (dense, 8 bytes each).
BLOCK_BYTES = 64 * 1024 * 1024
#: Questions of a stacked row, and weights of a row of summed gradients.
STACK, CELLS = 256, 8192
STACKED = ["sizes", "b", "v", "n", "y"]
#: Features of a batch that a task of ``sequence`` holds, and of all batches of one call (12 bytes each).
BATCH_BYTES, ROUND_BYTES = 8 * 1024 * 1024, 128 * 1024 * 1024
BIAS = -1
_TINY = 1e-300


def pack(features: DataFrame, questions: DataFrame, examples: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """key, buckets, values and, with ``examples`` (key, node, y), nodes and ys; one row per question, stored.

    The bias is a feature of every question (bucket ``BIAS``, value 1)."""
    own = features.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("bucket").cast("int").alias("b"), F.col("value").cast("double").alias("v")))).alias("x"))
    rows = questions.select(key).distinct().join(own, key, "left")
    empty = F.array().cast("array<struct<b:int,v:double>>")
    bias = F.array(F.struct(F.lit(BIAS).cast("int").alias("b"), F.lit(1.0).alias("v")))
    rows = rows.withColumn("x", F.concat(bias, F.coalesce("x", empty)))
    columns = [key, F.col("x.b").alias("buckets"), F.col("x.v").alias("values")]
    if examples is not None:
        reached = examples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("long").alias("n"), F.col("y").cast("int").alias("y")))).alias("e"))
        rows = rows.join(reached, key)
        columns += [F.col("e.n").alias("nodes"), F.col("e.y").alias("ys")]
    return dimension(rows.select(*columns), "packed")


def width_of(packed: DataFrame, weights: DataFrame | None = None) -> int:
    """Columns of a dense row of weights: the bias and every bucket up to the largest."""
    top = packed.agg(F.max(F.element_at("buckets", -1))).first()[0]
    held = weights.agg(F.max("bucket")).first()[0] if weights is not None else None
    return max(x if x is not None else BIAS for x in (top, held)) + 2


def row_bytes(packed: DataFrame) -> float:
    """Mean bytes of a question's features."""
    return 12.0 * (packed.agg(F.avg(F.size("buckets"))).first()[0] or 0)


def blocks_of(nodes: int, width: int, limit: int | None = None) -> list[tuple[int, int]]:
    step = max(1, (BLOCK_BYTES if limit is None else limit) // (8 * width))
    return [(s, min(s + step, nodes)) for s in range(0, nodes, step)]


def dense(weights: DataFrame, start: int, end: int, width: int) -> np.ndarray:
    """The weights of nodes ``start`` to ``end`` - 1, at most one block."""
    out = np.zeros((end - start, width))
    t = weights.filter((F.col("node") >= start) & (F.col("node") < end)).select("node", "bucket", "w").toArrow()
    out[t["node"].to_numpy() - start, t["bucket"].to_numpy() + 1] = t["w"].to_numpy()
    return out


def held_weights(weights: DataFrame | None, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All weights of a tree of one block, and which of them exist."""
    out, known = np.zeros((nodes, width)), np.zeros((nodes, width), dtype=bool)
    if weights is not None:
        t = weights.select("node", "bucket", "w").toArrow()
        at = t["node"].to_numpy(), t["bucket"].to_numpy() + 1
        out[at], known[at] = t["w"].to_numpy(), True
    return out, known


def _lists(batch: pa.RecordBatch, name: str):
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy())[:-1]) if batch.num_rows else []


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def _stacked(batches):
    """Questions of a batch as rows of at most ``STACK``: their buckets, values, nodes and outcomes one after
    another as bytes, so an epoch reads them without a conversion of every element."""
    for batch in batches:
        rows = []
        lists = [_lists(batch, c) for c in ("buckets", "values", "nodes", "ys")]
        for at in range(0, batch.num_rows, STACK):
            b, v, n, y = (x[at:at + STACK] for x in lists)
            sizes = np.array([[len(x) for x in b], [len(x) for x in n]], dtype=np.int32)
            rows.append([sizes.tobytes(), *(np.concatenate(x).astype(t).tobytes() for x, t in ((b, np.int32), (v, np.float64), (n, np.int64), (y, np.int32)))])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in (zip(*rows) if rows else [()] * 5)], names=STACKED)


def stack(packed: DataFrame) -> DataFrame:
    """Packed questions in the form that ``step`` reads, for training over many epochs.  Those that reach the same or
    nearly the same nodes are neighbours, so a node finds its questions' features in one piece or a few."""
    return dimension(packed.select("buckets", "values", "nodes", "ys").sortWithinPartitions("nodes", "ys").mapInArrow(_stacked, ", ".join(f"{c} binary" for c in STACKED)), "stacked")


def _stacks(batch: pa.RecordBatch):
    """Buckets and nodes of each question, and buckets, values, nodes and outcomes one after another, of stacked rows."""
    for sizes, *flat in zip(*(batch.column(c) for c in STACKED)):
        of_b, of_n = np.frombuffer(sizes.as_buffer(), np.int32).reshape(2, -1)
        b, v, n, y = (np.frombuffer(x.as_buffer(), t) for x, t in zip(flat, (np.int32, np.float64, np.int64, np.int32)))
        yield of_b, of_n, b.astype(np.int64) + 1, v, n, y


def _reached(of_n: np.ndarray, n: np.ndarray, y: np.ndarray, start: int, end: int):
    """(questions, [(node - start, outcomes)]): nodes that the same questions reach come together."""
    of = np.repeat(np.arange(len(of_n)), of_n)
    own = (n >= start) & (n < end)
    of, n, y = of[own], n[own] - start, y[own]
    order = np.argsort(n, kind="stable")
    of, n, y = of[order], n[order], y[order]
    cuts = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)] if len(n) else []
    groups: dict[bytes, list] = {}
    for i, j in zip(cuts, cuts[1:]):
        groups.setdefault(of[i:j].tobytes(), []).append((int(n[i]), y[i:j]))
    return [(np.frombuffer(q, of.dtype), nodes) for q, nodes in groups.items()]


def _part(q: np.ndarray, of_b: np.ndarray, b: np.ndarray, v: np.ndarray):
    """Buckets, values and number of buckets of some questions."""
    if len(q) == len(of_b):
        return b, v, of_b
    size = of_b[q].astype(np.int64)
    if q[-1] - q[0] + 1 == len(q):  # neighbours
        at = slice(int(of_b[:q[0]].sum()), int(of_b[:q[-1] + 1].sum()))
        return b[at], v[at], size
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) + np.repeat((np.cumsum(of_b) - of_b)[q] - (ends - size), size)
    return b[at], v[at], size


def _margin(w: np.ndarray, b: np.ndarray, v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Margins of one node, whose weights (a row) stay in the cache: every question has a bias and so a bucket."""
    x = w.take(b)
    x *= v
    return np.add.reduceat(x, first)


def _add(total: np.ndarray, b: np.ndarray, v: np.ndarray, size: np.ndarray, g: np.ndarray) -> None:
    """Adds g·x of some questions to one node's row of gradients."""
    x = np.repeat(g, size)
    x *= v
    if 4 * len(b) < len(total):
        np.add.at(total, b, x)
    else:
        total += np.bincount(b, weights=x, minlength=len(total))


def _chunk(nodes: int) -> int:
    """Buckets of a row of summed gradients."""
    return max(1, CELLS // nodes)


def _gradients(shared, start: int, end: int, width: int, seen: bool = False):
    """Of one partition: the summed gradients of the weights that its questions touch, some buckets a row.

    The questions of a stack are taken node by node: a node's row of weights and of sums is small and read at random,
    what is large (buckets, values) is read in its order."""
    size, nodes = _chunk(end - start), end - start

    def run(batches):
        w = shared.value if shared is not None else None
        total, touched = np.zeros((nodes, width)), np.zeros((nodes, width), dtype=bool)
        for batch in batches:
            for of_b, of_n, all_b, all_v, n, y in _stacks(batch):
                for q, mine in _reached(of_n, n, y, start, end):
                    b, v, size_b = _part(q, of_b, all_b, all_v)
                    first = np.cumsum(size_b) - size_b
                    for node, at in mine:
                        g = (_sigmoid(_margin(w[node], b, v, first)) if w is not None else 0.5) - at
                        _add(total[node], b, v, size_b, g)
                        if not seen:
                            touched[node][b] = True
        total, touched = total.T, (total != 0).T if seen else touched.T
        for c in range(0, width, size):
            if touched[c:c + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([c], pa.int32()), pa.array([total[c:c + size].tobytes()], pa.binary()), pa.array([touched[c:c + size].tobytes()], pa.binary())], names=["start", "chunk", "gw", "touched"])
    return run


def _summed(size: int, nodes: int):
    """Rows of the partitions, sorted by (start, chunk), added up: node, bucket and gradient of what was touched."""
    def out(at, total, touched):
        bucket, node = np.nonzero(touched)
        return pa.RecordBatch.from_arrays([pa.array(node + at[0]), pa.array((bucket + at[1] - 1).astype(np.int32)), pa.array(total[bucket, node])], names=["node", "bucket", "gw"])

    def run(batches):
        at = None
        for batch in batches:
            for s, c, g, t in zip(*(batch.column(x) for x in ("start", "chunk", "gw", "touched"))):
                shape = (-1, min(size, nodes - s.as_py()))
                g, t = np.frombuffer(g.as_buffer()).reshape(shape), np.frombuffer(t.as_buffer(), bool).reshape(shape)
                if at == (s.as_py(), c.as_py()):
                    total, touched = total + g, touched | t
                    continue
                if at is not None:
                    yield out(at, total, touched)
                at, total, touched = (s.as_py(), c.as_py()), g, t
        if at is not None:
            yield out(at, total, touched)
    return run


def step(packed: DataFrame, n_node: DataFrame, weights: DataFrame | None, nodes: int, lr: float, width: int, limit: int | None = None,
         held: np.ndarray | None = None, seen: bool = False) -> DataFrame:
    """One full-batch epoch: w[n, b] -= lr · Σ_q (σ(margin) - y)·x[q, b] / N_n.  ``n_node``: rows of each node.
    ``held``: all weights as ``dense`` gives them, for a caller that has read them before.  ``seen``: ``weights`` have
    a row for all that these questions touch, as after an epoch over them.

    ``packed`` may be stacked.  A task adds up its questions' gradients in dense rows of some buckets, and only
    these are shuffled: no row a weight and task."""
    spark, grad = packed.sparkSession, None
    if packed.columns != STACKED:
        packed = packed.select("buckets", "values", "nodes", "ys").mapInArrow(_stacked, ", ".join(f"{c} binary" for c in STACKED))
    blocks = blocks_of(nodes, width, limit)
    for start, end in blocks:
        shared = spark.sparkContext.broadcast(held[start:end] if held is not None else dense(weights, start, end, width)) if weights is not None else None
        part = packed.mapInArrow(_gradients(shared, start, end, width, seen), "start long, chunk int, gw binary, touched binary")
        grad = part if grad is None else grad.unionByName(part)
    if grad is None:  # no node
        return weights if weights is not None else spark.createDataFrame([], "node long, bucket int, w double")
    grad = grad.repartition("start", "chunk").sortWithinPartitions("start", "chunk").mapInArrow(_summed(blocks[0][1], nodes), "node long, bucket int, gw double")
    change = grad.join(F.broadcast(n_node) if nodes * 16 <= BLOCK_BYTES else n_node, "node").select("node", "bucket", (F.lit(-lr) * F.col("gw") / F.col("n_node")).alias("w"))
    if weights is None:
        return change
    both = change.unionByName(weights.select("node", "bucket", "w"))
    return both.groupBy("node", "bucket").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))


def _search(w: np.ndarray, internal: int, k: int, b: np.ndarray, v: np.ndarray, top: int, floor: float):
    """(leaf, log probability), best first: the ``top`` best, those as good as the last of them, and all from ``floor`` on."""
    found: list[tuple[int, float]] = []
    lp = np.log(np.maximum(_sigmoid(w[:1, b + 1] @ v), _TINY))
    heap = [(-float(lp[0]), 0)]
    while heap:
        least, node = heapq.heappop(heap)
        if -least < floor and (len(found) >= top and (not top or -least < found[top - 1][1] - 1e-9)):
            break
        if node >= internal:
            found.append((node, -least))
            continue
        first, last = node * k + 1, min(node * k + k + 1, len(w))
        lp = np.log(np.maximum(_sigmoid(w[first:last][:, b + 1] @ v), _TINY)) - least
        for n, x in zip(range(first, last), lp.tolist()):
            heapq.heappush(heap, (-x, n))
    return found


def search_labels(packed: DataFrame, weights: DataFrame, internal: int, nodes: int, k: int, top: int, low: float, width: int,
                  key: str = "question_id", label: str = "tag_index", held: np.ndarray | None = None) -> DataFrame:
    """(key, label, prob) of the ``top`` best labels of each question and of all with a probability of at least
    ``low``.  The whole tree's weights must be one block (``fits``); ``held`` as in ``step``."""
    shared = packed.sparkSession.sparkContext.broadcast(dense(weights, 0, nodes, width) if held is None else held)
    floor = math.log(max(low, _TINY))

    def run(batches):
        w = shared.value
        for batch in batches:
            at, leaves, probs = [], [], []
            for row, (b, v) in enumerate(zip(_lists(batch, "buckets"), _lists(batch, "values"))):
                for leaf, lp in _search(w, internal, k, b, v, top, floor):
                    at.append(row), leaves.append(leaf - internal), probs.append(math.exp(lp))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(leaves, pa.int32()), pa.array(probs, pa.float64())], names=[key, label, "prob"])

    kind = packed.schema[key].dataType.simpleString()
    return packed.select(key, "buckets", "values").mapInArrow(run, f"{key} {kind}, {label} int, prob double")


def fits(nodes: int, width: int, limit: int | None = None) -> bool:
    return 8 * nodes * width <= (BLOCK_BYTES if limit is None else limit)


# --- many small batches in a row ---------------------------------------------------------------

def _batches(batches, by: list[str], columns: list[str]):
    """(values of ``by``, table) of each run of equal values of the rows sorted by them."""
    parts, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by])
        cuts = [0, *(np.flatnonzero(np.diff(numbers).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            own = tuple(numbers[:, i].tolist())
            if parts and own != at:
                yield at, pa.Table.from_batches(parts)
                parts = []
            at = own
            parts.append(batch.slice(i, j - i).select(columns))
    if parts:
        yield at, pa.Table.from_batches(parts)


def _sequence(shared, share: int, rate, epochs: int, number: str, key: str, schema: pa.Schema):
    """Batch after batch the margins, the steps and the margins again, at ``share`` nodes from ``start`` on."""
    def row(**columns):
        return pa.RecordBatch.from_pylist([columns], schema=schema)

    def run(batches):
        held, exist = shared.value
        now = None
        for (start, last), table in _batches(batches, ["start", number], [key, "buckets", "values", "nodes", "ys"]):
            if start != now:
                if now is not None:
                    yield row(at=-1, start=now, w=w.tobytes(), known=np.packbits(known).tobytes())  # noqa: F821
                now, w, known = start, held[start:start + share].copy(), exist[start:start + share].copy()
            nodes = len(w)
            rows = table.combine_chunks().to_batches()[0]
            ids, first = np.unique(rows.column(key).to_numpy(zero_copy_only=False), return_index=True)  # a question once
            lists = [[x[i] for i in first] for x in (_lists(rows, c) for c in ("buckets", "values", "nodes", "ys"))]
            of_b, of_n = (np.array([len(x) for x in lists[i]]) for i in (0, 2))
            all_b, all_v, n, y = (np.concatenate(x) for x in lists)
            all_b, begin = all_b.astype(np.int64) + 1, np.cumsum(of_b) - of_b
            groups = [(q, mine, *_part(q, of_b, all_b, all_v)) for q, mine in _reached(of_n, n, y, start, start + nodes)]

            def margins():
                return np.array([_margin(own, all_b, all_v, begin) for own in w]).T

            m = pre = margins()
            for t in range(epochs):
                change = np.zeros_like(w)
                for q, mine, b, v, size in groups:
                    for node, at in mine:
                        _add(change[node], b, v, size, _sigmoid(m[q, node]) - at)
                        change[node] *= -rate(last, t) / len(q)
                        known[node][b] = True
                w += change
                m = margins()
            for at in range(0, len(ids), STACK):
                part = slice(at, at + STACK)
                yield row(**{number: last, "at": at, "start": start, "ids": rows.column(key).take(pa.array(first[part])).to_pylist(),
                             "pre": pre[part].tobytes(), "post": m[part].tobytes()})
        if now is not None:
            yield row(at=-1, start=now, w=w.tobytes(), known=np.packbits(known).tobytes())
    return run


def sequence(packed: DataFrame, held: tuple[np.ndarray, np.ndarray], rate, epochs: int, number: str = "chunk_no", key: str = "question_id") -> DataFrame:
    """The steps of many small batches (equal ``number``), one after another: ``epochs`` full-batch steps as
    ``step`` takes them, of size ``rate(number, epoch)``, on each batch's distinct questions.

    Batches depend on each other, node models do not: a task goes through all batches with its share of the
    nodes and holds one batch (at most ``BATCH_BYTES``) at a time; each reads ``packed``, nothing is shuffled.  All
    weights are one block, ``held_weights``.  Rows: the margins of up to ``STACK`` questions before and after their
    batch's steps, and the last weights (``at`` = -1)."""
    spark, nodes = packed.sparkSession, len(held[0])
    shares = min(nodes, spark.sparkContext.defaultParallelism)
    share = -(-nodes // shares)
    shares = -(-nodes // share)
    ddl = f"{number} long, at int, start int, ids array<{packed.schema[key].dataType.simpleString()}>, pre binary, post binary, w binary, known binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    rows = packed.select(F.col(number).cast("long").alias(number), key, "buckets", "values", "nodes", "ys").coalesce(1)
    each = spark.range(0, shares, 1, shares).select((F.col("id") * share).cast("int").alias("start"))
    each = each.crossJoin(rows.hint("shuffle_replicate_nl")).sortWithinPartitions("start", number)
    return each.mapInArrow(_sequence(spark.sparkContext.broadcast(held), share, rate, epochs, number, key, schema), ddl)


def margins_of(steps: DataFrame, number: str = "chunk_no") -> DataFrame:
    """number, ids, pre and post (of the shares of nodes, in their order) of each stack of questions of ``sequence``."""
    each = F.array_sort(F.collect_list(F.struct("start", "pre", "post"))).alias("m")
    stacks = steps.filter("at >= 0").groupBy(number, "at").agg(F.first("ids").alias("ids"), each)
    return stacks.select(number, "ids", F.col("m.pre").alias("pre"), F.col("m.post").alias("post"))


def last_weights(steps: DataFrame, width: int) -> DataFrame:
    """(node, bucket, w) after the last batch of ``sequence``."""
    def run(batches):
        for batch in batches:
            for start, w, known in zip(*(batch.column(c) for c in ("start", "w", "known"))):
                w = np.frombuffer(w.as_buffer()).reshape(-1, width)
                node, bucket = np.nonzero(np.unpackbits(np.frombuffer(known.as_buffer(), np.uint8), count=w.size).reshape(w.shape))
                yield pa.RecordBatch.from_arrays([pa.array(node + start.as_py()), pa.array((bucket - 1).astype(np.int32)), pa.array(w[node, bucket])], names=["node", "bucket", "w"])

    return steps.filter("at = -1").select("start", "w", "known").mapInArrow(run, "node long, bucket int, w double")


def best_labels(stacks: DataFrame, margins: str, internal: int, nodes: int, k: int, top: int, low: float, keys: tuple[str, str] = ("chunk_no", "question_id"),
                label: str = "tag_index") -> DataFrame:
    """What ``search_labels`` finds, where the margins of all nodes (column ``margins`` of ``margins_of``) are known."""
    floor = math.log(max(low, _TINY))
    number, key = keys

    def run(batches):
        for batch in batches:
            for at, ids, parts in zip(batch.column(number), batch.column("ids"), batch.column(margins)):
                own = ids.values
                lp = np.concatenate([np.frombuffer(p.as_buffer()).reshape(len(own), -1) for p in parts], axis=1)
                lp = np.log(np.maximum(_sigmoid(lp), _TINY))
                first = 1
                while first < nodes:  # a level of the complete tree
                    after = min(first * k + 1, nodes)
                    lp[:, first:after] += lp[:, (np.arange(first, after) - 1) // k]
                    first = after
                leaves = lp[:, internal:]
                good = leaves >= floor
                if top:
                    least = np.partition(leaves, -top, axis=1)[:, -top:-top + 1 or None] if top < leaves.shape[1] else -np.inf
                    good |= leaves >= least - 1e-9
                row, leaf = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), at.as_py(), dtype=np.int64)), own.take(pa.array(row)), pa.array(leaf.astype(np.int32)),
                                                  pa.array([math.exp(x) for x in leaves[row, leaf].tolist()], pa.float64())], names=[number, key, label, "prob"])

    kind = stacks.schema["ids"].dataType.elementType.simpleString()
    return stacks.select(number, "ids", margins).mapInArrow(run, f"{number} long, {key} {kind}, {label} int, prob double")
