"""Repeated passages by word, against a plain Python version of the contract."""

import random
import re

import pytest

from tagstream.llm import passages

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def brute(rows, size):
    """(id, text) -> (gone lines, text left): every window of ``size`` words that occurred earlier goes."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        words = [w for w in SPLIT.split(t) if w]
        gone = set()
        for k in range(len(words) - size + 1):
            key = tuple(words[k:k + size])
            if key in seen:
                gone.update(range(k, k + size))
            seen.add(key)
        left, lost, at = [], [], 0
        for n, line in enumerate(t.split("\n")):
            pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", line)
            stay = [p for k, p in enumerate(pieces, at) if k not in gone]
            if pieces and not stay:
                lost.append(n)
            else:
                left.append(line if len(stay) == len(pieces) else re.match(r"[\x20\x09-\x0D]*", line).group() + "".join(stay))
            at += len(pieces)
        out[i, t] = (",".join(map(str, lost)), "\n".join(left))
    return out


def same(spark, rows, size=50):
    want = brute(rows, size)
    got = passages.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=size).collect()
    assert len(got) == len(rows)
    for r, key in ((r, k) for r in got for k in [r.doc_id] if k is not None):
        assert (r.gone_lines, r.text or "") in [v for (i, _), v in want.items() if i == key], key
    return {r.doc_id: r for r in got}


def test_passage_in_the_middle_of_a_line(spark):
    p = " ".join(f"p{k}" for k in range(60))
    tail = " ".join(f"t{k}" for k in range(20))
    rows = [(1, f"one {p} end of it"), (2, f"\tother words  {p}  after\nlast"), (3, f"head\n {p}\n\n {tail} x"), (4, f"z\n{p} {tail} y"),
            (5, f"{p}"), (6, None), (None, p), (7, f"{p[:-3]} short"), (7, f"{p} again"), (5, f"{p}")]
    got = same(spark, rows)
    assert got[2].text == "\tother words  after\nlast" and got[1].n_gone == 0 and got[None].text == p and got[6].text is None
    # the tail that follows the passage in 3 and 4, but not in its first place, goes from 4 as well
    assert got[4].text == "z\ny" and got[3].gone_lines == "1" and got[5].text == ""


@pytest.mark.parametrize("size", [1, 2, 7, 50, 64])
def test_random_pastes(spark, size):
    rng = random.Random(size)
    pool = [" ".join(f"w{rng.randrange(400)}" for _ in range(size + rng.randrange(-1, 40))) for _ in range(6)]
    rows = []
    for i in range(40):
        part = [rng.choice(pool) if rng.random() < 0.4 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))) for _ in range(6)]
        rows.append((i, "".join(x + rng.choice([" ", "  ", "\n", "\n\n", " \n\t"]) for x in part)))
    rows += [(100, "a " * 200), (101, "b a " * 90), (102, rows[3][1]), (103, "a " * 200)]
    same(spark, rows, size)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    same(spark, rows)
    assert passages.dedup_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_without_anchors(spark):
    """Words whose first characters are all even or all odd hold no anchor; other scripts, tables, one word repeated."""
    rng = random.Random(3)
    even = lambda n: " ".join(rng.choice("bdfhjlnprtvxz") + str(rng.randrange(10**5)) for _ in range(n))
    odd = lambda n: " ".join(rng.choice("acegikmoqsuwyж") + str(rng.randrange(10**5)) for _ in range(n))
    p, q, r = even(70), odd(61), "| 1 " * 40
    mixed = " ".join(f"{c}{k}" for k, c in enumerate("bcabdecfaghizkab" * 4))
    rows = [(1, f"{p} {mixed}"), (2, f"{mixed} {p}\n{q}"), (3, f"{q} {r}"), (4, f"{r}\n{p[:-9]} {mixed[9:]}"), (5, f"{even(30)} {q} {even(9)}"), (6, "x " * 130), (7, "x " * 99 + q)]
    got = same(spark, rows)
    assert got[2].gone_lines == "0" and got[5].text.count(" ") == 38


def test_one_row_a_text_where_nothing_repeats(spark, monkeypatch):
    """What is stored and shuffled must not grow with the words of texts that repeat nothing."""
    seen, plain = {}, passages.stored

    def counted(df, name):
        out = plain(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(passages, "stored", counted)
    common = " ".join(f"{c}x{k}" for k, c in enumerate("bcadeefgahiajk" * 3))  # 42 words: no window
    rows = [(i, " ".join(f"{chr(97 + (i * k + k // 7) % 26)}{i}y{k}" for k in range(300)) + " " + common + f" end{i}") for i in range(20)]
    passages.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(seen.values()) <= 4 * len(rows), seen
