"""Operator 12, conversation structure repair with Four-Russians block tables.

A conversation is a string of symbols, one per row: the initial of its role and its first fault.  The
repaired initials must have the form ``(s?(ua)+)?``, which is an automaton of four states.  Seen from the
end, the cost of repairing the rest of a conversation from each state is a vector of four numbers, and a
symbol maps one vector to the one before it.  Only a few vectors exist once their least number is
subtracted, so the step over every block of ``BLOCK`` symbols is tabulated for each of them: next vector
and what was subtracted.  A conversation is processed from its end, one lookup a block.

Tracing goes forward.  The vector on the right of a block is known, so the block is expanded backward
into the vectors between its symbols; then each row takes the edit with the least letter that still
reaches the least cost.  This gives the cheapest edits, among those of equal cost the ASCII-least ones.

Conversations of any length.  Rows are put in order by a range sort and cut into segments of at most
2 ** ``SEGMENT_BITS`` rows.  Where a conversation has several segments, each gives its cost from every
state to every state (the same tables, run from unit vectors) and its trace from every state; these
summaries, not rows, are combined per conversation.  Texts are read in order once, for the hash of the
repaired conversation, one batch in memory; a hash of a whole conversation has to see it in one task.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.llm.common import prepare, stored

#: Symbols of a tabulated block, and rows of a segment as a power of two.
BLOCK = 3
SEGMENT_BITS = 16
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NONE, BLANK, DUPLICATE, CUT = range(4)
#: States: nothing yet, after s, after u, after a.  What may be put there (u or a) leads to _NEXT.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_PUT = ("user", "user", "assistant", "user")
_ENDS = (0, 2 * INSERT, INSERT, 0)
#: Initials s, u, a, other; after them a symbol for a row that must go, and one that fills a block up.
_INITIALS = "sua"
_GONE, _FILL = 8, 9
_SYMBOLS = 10
_FAR = 1 << 20


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """Symbols of codes ``initial * 4 + fault``."""
    initial, fault = codes >> 2, codes & 3
    return np.where((fault == BLANK) | (fault == DUPLICATE), _GONE, initial * 2 + (fault == CUT))


def options(symbol: int, state: int):
    """(letter, cost, state after it) of the edits that consume a row, in the order of their letters."""
    yield "D", DELETE, state
    if symbol == _GONE:
        return
    initial, cut = symbol >> 1, (symbol & 1) * TRUNCATED
    if (initial == 0 and state == START) or (initial == 1 and state != AFTER_U) or (initial == 2 and state == AFTER_U):
        yield "K", cut, (AFTER_S, AFTER_U, AFTER_A)[initial]
    yield "R", REROLE + cut, _NEXT[state]


def before(symbol: int, after: tuple) -> tuple:
    """Costs in front of a row, from each state, given those behind it; inserted rows included."""
    if symbol == _FILL:
        return after
    c = [min(cost + after[to] for _, cost, to in options(symbol, state)) for state in range(4)]
    for _ in range(3):
        c = [min(c[state], INSERT + c[_NEXT[state]]) for state in range(4)]
    return tuple(min(x, _FAR) for x in c)


def normal(costs: tuple) -> tuple[tuple, int]:
    low = min(costs)
    return tuple(x if x >= _FAR else x - low for x in costs), low


def closed_unit(state: int) -> tuple:
    """Costs of reaching ``state`` by inserted rows alone."""
    c = [_FAR] * 4
    c[state] = 0
    for _ in range(3):
        c = [min(c[s], INSERT + c[_NEXT[s]]) for s in range(4)]
    return tuple(min(x, _FAR) for x in c)


class Tables:
    """Every normalised vector, and the step over every block from each of them."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.number: dict[tuple, int] = {}
        for v in (_ENDS, *(closed_unit(s) for s in range(4))):
            self._add(normal(v)[0])
        step, paid = [], []
        k = 0
        while k < len(self.vectors):
            row = [normal(before(s, self.vectors[k])) for s in range(_SYMBOLS)]
            step.append([self._add(v) for v, _ in row])
            paid.append([low for _, low in row])
            k += 1
        one, cost = np.array(step), np.array(paid)
        self.step, self.paid = np.empty((k, _SYMBOLS ** BLOCK), dtype=np.int64), np.empty((k, _SYMBOLS ** BLOCK), dtype=np.int64)
        for b, symbols in enumerate(product(range(_SYMBOLS), repeat=BLOCK)):
            at, total = np.arange(k), np.zeros(k, dtype=np.int64)
            for s in reversed(symbols):
                total += cost[at, s]
                at = one[at, s]
            self.step[:, b], self.paid[:, b] = at, total
        self.traces: dict[tuple, tuple[str, int]] = {}

    def _add(self, vector: tuple) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    def blocks(self, codes: np.ndarray) -> np.ndarray:
        symbols = symbols_of(codes)
        symbols = np.concatenate([np.full(-len(symbols) % BLOCK, _FILL), symbols])
        return symbols.reshape(-1, BLOCK) @ (_SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def backward(self, blocks: np.ndarray, right: tuple) -> tuple[list[int], tuple]:
        """Numbers of the vectors on the right of each block, and the costs in front of all of them."""
        vector, total = normal(right)
        at, out = self._add(vector), []
        for b in blocks[::-1].tolist():
            out.append(at)
            total += int(self.paid[at, b])
            at = int(self.step[at, b])
        return out[::-1], tuple(x if x >= _FAR else x + total for x in self.vectors[at])

    def trace_block(self, block: int, right: int, state: int) -> tuple[str, int]:
        """Edits of a block and the state behind it; the block is expanded backward once and kept."""
        key = (block, right, state)
        if key not in self.traces:
            symbols = [block // _SYMBOLS ** k % _SYMBOLS for k in range(BLOCK - 1, -1, -1)]
            costs = [self.vectors[right]]
            for s in reversed(symbols):
                costs.append(before(s, costs[-1]))
            costs.reverse()
            edits = []
            for k, s in enumerate(symbols):
                if s != _FILL:
                    state = _row(s, state, costs[k], costs[k + 1], edits)
            self.traces[key] = "".join(edits), state
        return self.traces[key]

    def trace(self, blocks: np.ndarray, rights: list[int], state: int) -> tuple[str, int]:
        out = []
        for b, right in zip(blocks.tolist(), rights):
            edits, state = self.trace_block(b, right, state)
            out.append(edits)
        return "".join(out), state


def _row(symbol: int, state: int, here: tuple, after: tuple, edits: list) -> int:
    """The ASCII-least optimal edits up to and with one row; rows inserted before it come between D and K."""
    while True:
        left = {letter: (cost, to) for letter, cost, to in options(symbol, state)}
        left["I"] = INSERT, None
        for letter in "DIKR":
            if letter in left:
                cost, to = left[letter]
                if cost + (here[_NEXT[state]] if letter == "I" else after[to]) == here[state]:
                    edits.append(letter)
                    break
        if letter != "I":
            return to
        state = _NEXT[state]


def closing(state: int) -> str:
    """Rows inserted at the end."""
    return "I" * (_ENDS[state] // INSERT)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def damaged(rows: DataFrame, modulus: int = 20, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plants faults by crc32 of ``conv:turn``: 0 drops a row, 1 empties its text, 2 takes its end marks
    out, 3 repeats it, 4 sets role user.  A null counts as one space."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col, role_col, text_col)]
    kind = F.crc32(F.concat_ws(":", *spaced[:2]).cast("binary")) % modulus
    rows = rows.select(F.col(conv_col).alias(conv_col), F.col(turn_col).alias(turn_col), spaced[2].alias("__role"), spaced[3].alias("__text"), kind.alias("__kind"))
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("__text", ".!?", "")).otherwise(F.col("__text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("__role"))
    rows = rows.filter("__kind <> 0").withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(conv_col, turn_col, role.alias(role_col), text.alias(text_col))


def _illegal(initial: np.ndarray) -> int:
    a, b = initial[:-1], initial[1:]
    return int((~(((b == 1) & ((a == 0) | (a == 2))) | ((a == 1) & (b == 2)))).sum())


def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("codes")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy())[:-1]) if batch.num_rows else []


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_AUDIT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _counted(codes: np.ndarray) -> tuple[int, ...]:
    fault = codes & 3
    return (*(int((fault == f).sum()) for f in (BLANK, DUPLICATE, CUT)), _illegal(codes >> 2))


def _whole(batches):
    """Conversations of one segment."""
    t = tables()
    for batch in batches:
        rows = []
        for key, codes in zip(batch.column("key").to_pylist(), _codes(batch)):
            blocks = t.blocks(codes)
            rights, costs = t.backward(blocks, _ENDS)
            audit, state = t.trace(blocks, rights, START)
            rows.append((key, *_counted(codes), costs[START], audit + closing(state)))
        yield _batch(rows, ("key", *_COUNTS, "cost", "audit"), (pa.string(), *[pa.int64()] * 5, pa.string()))


def _batch(rows: list, names, kinds) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=list(names))


def _summaries(batches):
    """Of a segment: costs from every state to every state, its counts, first and last initial."""
    t = tables()
    for batch in batches:
        rows = []
        for key, seg, codes in zip(batch.column("key").to_pylist(), batch.column("seg").to_pylist(), _codes(batch)):
            blocks = t.blocks(codes)
            ends = [t.backward(blocks, closed_unit(to))[1] for to in range(4)]
            rows.append((key, seg, [ends[to][s] for s in range(4) for to in range(4)], *_counted(codes), int(codes[0]) >> 2, int(codes[-1]) >> 2))
        yield _batch(rows, ("key", "seg", "costs", *_COUNTS, "first", "final"), (pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 6))


def _rights(batches):
    """Costs on the right of each segment, from the summaries of a conversation's segments in order."""
    for batch in batches:
        rows = []
        for key, parts in zip(batch.column("key").to_pylist(), batch.column("parts").to_pylist()):
            right, out = np.array(_ENDS), []
            for p in reversed(parts):
                out.append({"seg": p["seg"], "costs": right.tolist()})
                right = (np.array(p["costs"]).reshape(4, 4) + right[None, :]).min(axis=1)
            between = sum(_illegal(np.array([a["final"], b["first"]])) for a, b in zip(parts, parts[1:]))
            counts = [sum(p[c] for p in parts) for c in _COUNTS]
            rows.append((key, out, *counts[:3], counts[3] + between, int(right[START])))
        kinds = (pa.string(), pa.list_(pa.struct([("seg", pa.int64()), ("costs", pa.list_(pa.int64()))])), *[pa.int64()] * 5)
        yield _batch(rows, ("key", "rights", *_COUNTS, "cost"), kinds)


def _traces(batches):
    """Edits of a segment from every state, and the state behind them."""
    t = tables()
    for batch in batches:
        rows = []
        for key, seg, right, codes in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "costs")), _codes(batch)):
            blocks = t.blocks(codes)
            rights, _ = t.backward(blocks, tuple(right))
            found = [t.trace(blocks, rights, s) for s in range(4)]
            rows.append((key, seg, [a for a, _ in found], [s for _, s in found]))
        yield _batch(rows, ("key", "seg", "audits", "states"), (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))


def _starts(batches):
    """The state in front of each segment of a conversation, and the rows inserted at its end."""
    for batch in batches:
        rows = []
        for key, parts in zip(batch.column("key").to_pylist(), batch.column("parts").to_pylist()):
            state = START
            for n, p in enumerate(parts):
                after = p["states"][state]
                rows.append((key, p["seg"], state, closing(after) if n == len(parts) - 1 else ""))
                state = after
        yield _batch(rows, ("key", "seg", "state", "closing"), (pa.string(), pa.int64(), pa.int64(), pa.string()))


def _repaired(batches):
    """Applies the audits: of each conversation its audit comes first, then its rows in order."""
    key, audit, at, state, pos = None, "", 0, START, 0
    out: list = []

    def put(edit: str, role: str, text: str):
        nonlocal pos
        out.append((key, pos, edit, role, text))
        pos += 1

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            put("I", _PUT[state], "")
            state, at = _NEXT[state], at + 1

    for batch in batches:
        for k, kind, a, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "audit", "role", "text"))):
            if kind == 0:
                inserted()
                key, audit, at, state, pos = k, a, 0, START, 0
                continue
            inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                put("K", role, text)
                state = (AFTER_S, AFTER_U, AFTER_A)[_INITIALS.index(role[0])]
            elif edit == "R":
                put("R", _PUT[state], text)
                state = _NEXT[state]
        yield _batch(out, ("key", "pos", "edit", "role", "text"), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))
        out.clear()
    inserted()
    yield _batch(out, ("key", "pos", "edit", "role", "text"), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))


def _hashed(batches):
    """sha256 of each conversation's ``role:text`` lines, which come in order."""
    key, h, rows = None, None, []
    for batch in batches:
        for k, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "role", "text"))):
            if pos == 0:
                if h is not None:
                    rows.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield _batch(rows, ("key", "sha256"), (pa.string(), pa.string()))
        rows = []
    if h is not None:
        yield _batch([(key, h.hexdigest())], ("key", "sha256"), (pa.string(), pa.string()))


class Repair:
    """The repair of a table of conversations.

    ``audits`` has a row for each conversation: key, blank, duplicate, truncated, illegal, cost, audit;
    ``rows`` its repaired rows: key, pos (from 0), edit (K, R or I), role, text.  Each partition of
    ``rows`` holds whole conversations in order.

    A conversation's rows count in the order of turn (nulls first), then role, then a hash of role and
    text, so ties have one order; repeated rows are duplicates of the first.  A null role or text is one
    space.  Rows whose conversation is null form one conversation.  ``key`` is the conversation as text
    with a v before it, or n.  Other columns are ignored.  An empty table gives empty results.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        spark = rows.sparkSession
        prepare(spark)
        spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col)]
        full = rows.select(key_of(conv_col).alias("key"), F.col(turn_col).alias("turn"), spaced[0].alias("role"), spaced[1].alias("text"))
        full = full.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(12), "role", "text")})
        order = ["key", "turn", "role", "h1", "h2"]

        first = F.substring("role", 1, 1)
        initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
        seen = F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     "))
        fault = F.when(seen == "", BLANK).when(F.substring(seen, -1, 1).isin(".", "!", "?"), NONE).otherwise(CUT)
        narrow = full.select(*order, (initial * 4 + fault).alias("code")).repartitionByRange(*order).sortWithinPartitions(*order)
        narrow = narrow.select("key", "h1", "h2", "code", F.monotonically_increasing_id().alias("at"))
        narrow = stored(narrow.withColumn("seg", F.shiftright("at", SEGMENT_BITS)), "op12-rows")

        # the first of equal rows: one row a segment and text goes into the window
        same = narrow.groupBy("key", "h1", "h2", "seg").agg(F.min("at").alias("m"), F.count("*").alias("n"))
        of_all = Window.partitionBy("key", "h1", "h2")
        same = same.select("key", "h1", "h2", "seg", F.min("m").over(of_all).alias("m"), F.sum("n").over(of_all).alias("n")).filter("n > 1").drop("n")
        coded = narrow.join(same, ["key", "h1", "h2", "seg"], "left")
        late = F.coalesce(F.col("at") > F.col("m"), F.lit(False)) & (F.col("code") % 4 != BLANK)
        coded = coded.select("key", "seg", "at", F.when(late, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code")).alias("code"))
        segments = coded.groupBy("key", "seg").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("s"))
        segments = stored(segments.select("key", "seg", F.col("s.code").alias("codes")), "op12-segments")

        several = stored(segments.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "op12-several")
        whole = segments.join(several, "key", "left_anti").mapInArrow(_whole, _AUDIT)
        parts = stored(segments.join(several, "key"), "op12-parts")
        counts = ", ".join(f"{c} long" for c in _COUNTS)
        sums = parts.mapInArrow(_summaries, f"key string, seg long, costs array<long>, {counts}, first long, final long")
        sums = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seg", "costs", *_COUNTS, "first", "final"))).alias("parts"))
        sums = stored(sums.mapInArrow(_rights, f"key string, rights array<struct<seg: long, costs: array<long>>>, {counts}, cost long"), "op12-sums")
        rights = sums.select("key", F.explode("rights").alias("r")).select("key", "r.seg", "r.costs")
        traces = parts.join(rights, ["key", "seg"]).mapInArrow(_traces, "key string, seg long, audits array<string>, states array<long>")
        traces = stored(traces, "op12-traces")
        starts = traces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seg", "states"))).alias("parts"))
        starts = starts.mapInArrow(_starts, "key string, seg long, state long, closing string")
        chosen = traces.join(starts, ["key", "seg"]).select("key", "seg", F.concat(F.get("audits", F.col("state").cast("int")), "closing").alias("audit"))
        chosen = chosen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seg", "audit"))).alias("s"))
        chosen = chosen.join(sums, "key").select("key", *_COUNTS, "cost", F.array_join(F.col("s.audit"), "").alias("audit"))
        self.audits = stored(whole.union(chosen), "op12-audits")

        heads = self.audits.select("key", F.lit(0).alias("kind"), "audit")
        lines = heads.unionByName(full.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        lines = lines.repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "h1", "h2").select("key", "kind", "audit", "role", "text")
        self.rows = lines.mapInArrow(_repaired, "key string, pos long, edit string, role string, text string")

    def hashes(self) -> DataFrame:
        """key, sha256 of the repaired ``role:text`` lines; conversations of which nothing is left are absent."""
        return self.rows.mapInArrow(_hashed, "key string, sha256 string")


def key_of(conv_col: str) -> Column:
    return F.when(F.col(conv_col).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(conv_col).cast("string")))


def repair_report(original: DataFrame, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation of ``original``: its id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.  ``rows`` are the rows to repair, in which a conversation may be missing:
    then its numbers are zero and its audit is empty.  Gaps are turns missing between the least and the
    greatest, null turns aside."""
    done = Repair(rows, conv_col, turn_col, role_col, text_col)
    ids = original.select(F.col(conv_col).alias("id"), key_of(conv_col).alias("key")).distinct()
    turn = F.col(turn_col).cast("decimal(38,0)")
    turns = rows.select(key_of(conv_col).alias("key"), turn.alias("t")).groupBy("key").agg((F.max("t") - F.min("t") + 1 - F.count_distinct("t")).alias("gaps"))
    out = ids.join(turns, "key", "left").join(done.audits, "key", "left").join(done.hashes(), "key", "left")
    return out.select(F.col("id").alias(conv_col), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
