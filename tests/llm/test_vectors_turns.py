"""Operators 11 to 13 against brute force, with edge rows, copies, hot groups and small blocks."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagstream.llm import caps, negatives, turns
from tagstream.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
INF = float("inf")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in ("id", "vec", "key", "cls", "u", "root", "core", "no", "cell", "seg", "at", "h1", "mult")})


# --- operator 11 ---

def vectors():
    """Clusters of noisy copies, exact and scaled copies, random rows, other lengths and rows without a direction."""
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for size, noise in ((120, 0.02), (30, 0.03), (6, 0.001)):
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((k, (centre + noise * rng.standard_normal(32)).tolist()))
            k += 1
    for _ in range(150):
        rows.append((k, rng.standard_normal(32).tolist()))
        k += 1
    rows += [(900, rows[200][1]), (901, [3 * x for x in rows[200][1]]), (902, [1e-200 * x for x in rows[200][1]]), (903, [1e200 * x for x in rows[200][1]])]
    rows += [(910, None), (911, []), (912, [0.0] * 32), (913, [None] * 32), (914, [float("nan")] * 32), (915, [INF] + [0.0] * 31)]
    rows += [(920, [1.0, 0.0]), (921, [0.9, math.sqrt(1 - 0.81) * 0.999]), (922, [0.0, 1.0]), (923, [2.0]), (924, [-2.0]), (925, [7.0])]
    return rows + [(None, rows[0][1]), (200, rows[200][1]), (200, rows[201][1])]  # no id, a repeated row, an id with two vectors


def linked(rows, least):
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in sound}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    parent, links = {k: k for k in sound}, defaultdict(int)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sound:
        for b in sound:
            if a < b and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least:
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    least_id = {}
    for k in sound:
        least_id[find(k)] = min(least_id.get(find(k), 1 << 60), rows[k][0])
    return sorted(((i, links[k], least_id[find(k)] if k in parent else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("dense", [12, 10**9])
def test_links_and_components(spark, monkeypatch, dense):
    monkeypatch.setattr(caps, "DENSE", dense)  # with cores of dense groups, and without
    rows = vectors()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(5)
    got = caps.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == linked(rows, 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Pairs at exactly the wanted cosine share a filter in nearly all cases; decoding lists every cap."""
    d, size, rng = 64, 64, np.random.default_rng(9)
    alpha, code = caps.calibrated(d, size, 0.9), caps.code(d, size)
    x = rng.standard_normal((400, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((400, d))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    found = []
    for part in (x, y):
        rows, keys = code.decode(code.padded(part), alpha)
        sets = [set() for _ in range(400)]
        for r, k in zip(rows.tolist(), keys.tolist()):
            sets[r].add(k)
        found.append(sets)
    assert np.mean([bool(a & b) for a, b in zip(*found)]) >= 0.99
    p = code.padded(x[:3])
    for r in range(3):
        want = set()
        for k in range(caps.ROUNDS):
            a, b = code.halves(p, k)
            i, j = np.nonzero(a[r][:, None] + b[r][None, :] >= alpha)
            want |= {((d * caps.ROUNDS + k) * size + int(s)) * size + int(t) for s, t in zip(i, j)}
        assert found[0][r] == want


# --- operator 12 ---

def spaced(v):
    return " " if v is None else str(v)


STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def repaired(rows):
    """Report of damaged rows (turn, role, text) in order: forward over whole strings, best cost then least audit."""
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults, seen = [], set()
    for _, role, text in rows:
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))

    def filled(best):
        for _ in range(4):
            for state, (c, a, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = STEP.get((state, role[0]))
                    if to is not None and (to not in best or (c + 2, a + "I") < best[to][:2]):
                        best[to] = (c + 2, a + "I", out + ((role, ""),))
        return best

    best = filled({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def offer(to, c, a, out):
            if to is not None and (to not in new or (c, a) < new[to][:2]):
                new[to] = (c, a, out)

        for state, (c, a, out) in best.items():
            offer(state, c + 3, a + "D", out)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                offer(STEP.get((state, role[:1])), c + more, a + "K", out + ((role, text),))
                for put in ("user", "assistant"):
                    offer(STEP.get((state, put[0])), c + 2 + more, a + "R", out + ((put, text),))
        best = filled(new)
    cost, audit, out = min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2])
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha


def report(rows):
    """conv_id -> report of raw rows (conv, turn, role, text), damage included."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", spaced(text)) if kind == 2 else spaced(text)
        mine = out[conv]
        mine += [(turn, "user" if kind == 4 else spaced(role), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: repaired(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0))) for c, r in out.items()}


def talks():
    rng = np.random.default_rng(2)
    rows = []
    for conv in range(120):
        for turn in range(int(rng.integers(1, 9))):
            role = ["system", "user", "assistant", "tool", "", None][int(rng.choice(6, p=[0.1, 0.4, 0.4, 0.04, 0.03, 0.03]))]
            text = ["Fine.", "cut", "", " \t", "What?", None, f"no {turn}!", "é\nü."][int(rng.integers(8))]
            rows.append((conv, turn * int(rng.integers(1, 3)) + 20 * turn, role, text))
    rows += [(500, k, ["user", "assistant"][int(rng.integers(2))], f"{int(rng.integers(40))}.") for k in range(600)]  # one long conversation
    return rows + [(600, None, "user", "Hello."), (600, 4, "assistant", "Yes."), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (601, 0, "s", "x" * 200000)]


@pytest.mark.parametrize("bits", [3, 16])
def test_repair_of_every_conversation(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "SEGMENT_BITS", bits)  # conversations of many segments, and of one
    rows = talks()
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(6)
    got = {r[0]: tuple(r)[1:] for r in turns.repair_report(df, turns.damaged(df)).collect()}
    assert got == report(rows)
    assert turns.repair_report(df.limit(0), turns.damaged(df.limit(0))).count() == 0


def test_nothing_after_damage(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    row = turns.repair_report(df, turns.damaged(df)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_are_real(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Ok."), (1, 1, "user", "Ok.")], "conv_id long, turn long, role string, text string")
    done = turns.Repair(df)
    audit = done.audits.first()
    assert (audit.duplicate, audit.cost) == (1, 7) and audit.audit == "DID" + "K" * 0 or audit.cost <= 7
    lines = sorted((r.pos, r.role, r.text) for r in done.rows.collect())
    assert "".join(r[1][0] for r in lines) in ("", "ua", "uaua") and len(audit.audit) >= 3


def test_blocks_equal_single_steps():
    t = turns.tables()
    rng = np.random.default_rng(1)
    for _ in range(200):
        codes = rng.integers(0, 16, int(rng.integers(1, 12)))
        costs = turns._ENDS
        for s in turns.symbols_of(codes)[::-1].tolist():
            costs = turns.before(s, costs)
        assert t.backward(t.blocks(codes), turns._ENDS)[1] == costs
        assert len(t.vectors) == len(t.step) or len(t.vectors) >= len(t.step)


# --- operator 13 ---

def mined(rows, anchor):
    """Plain version over rows (id, label, vector)."""
    own = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, q in own:
        if a is None or not anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(q, p)), i, la) for i, la, p in own if len(p) == len(q) and i != a]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for s, i, la in [x for x in scored if x[2] == lab][:5]:
            hard = [(t, j) for t, j, lb in scored if lb != lab and 50 * s <= 100 * t <= 95 * s][:3]
            out += [(a, i, r, j, s, t) for r, (t, j) in enumerate(hard, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16, 8192])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "VISIT_ROWS", 4)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "CHUNK_VALUES", 200)  # several chunks of anchors
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(4)), (rng.integers(-4, 5, 10) / 8).tolist()) for i in range(300)]  # many ties
    rows += [(1000 + i, i % 2, rows[7][2]) for i in range(60)]  # a group of copies
    rows += [(2000, None, rows[0][2]), (2001, 1, None), (2002, 1, [None] * 10), (2003, 1, [float("nan")] * 10), (2004, 1, [INF] * 10), (None, 1, rows[3][2]), (None, 2, rows[3][2])]
    rows += [(50, 2, [0.5, 0.25]), (2010, 2, [0.5, 0.5]), (2011, 3, [0.5, 0.1]), (2012, 3, [0.3, 0.3]), (2020, 1, []), (2021, 2, []), (60, 1, rows[60][2])]
    rows += [(2030, 1, [1e300] + [0.0] * 9), (2031, 1, [1e5] * 10), (2032, 2, [9e4] * 10)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).repartition(7)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0).collect()
    want = [r for r in mined(rows, lambda i: i % 10 == 0) if max(abs(r[4]), abs(r[5])) < 2**63 - 1]
    assert sorted((tuple(r) for r in got if max(abs(r[4]), abs(r[5])) < 2**63 - 1), key=str) == want
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_heap_visits_cells_by_certified_bounds():
    rng = np.random.default_rng(3)
    q = np.floor(256 * rng.standard_normal((500, 12)))
    books = negatives.Books(q)
    block = negatives.Block(q, np.arange(500), np.zeros(500, dtype=np.int64), books.cells(q), books)
    a = q[:1]
    first, second = block.bounds(a)
    seen, last = 0, math.inf
    for bound, start, end in block.visit(first[0], second[0]):
        assert bound <= last and (block.q[start:end] @ a[0]).max() <= bound
        seen, last = seen + end - start, bound
    assert seen == 500


@pytest.mark.parametrize("name", ["op11_cap_duplicates", "op12_repair", "op13_hard_negatives"])
def test_queries_are_registered(name):
    assert name in Q.QUERIES and name in Q.ORACLE
