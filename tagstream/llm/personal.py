"""Operator 10, PII: skip-chain conditional random field.

Fixed patterns find the base spans.  The field labels the tokens that could be personal data, those
with a digit or an ``@`` (its nodes), as none, email, ip, card or phone.  A node's potentials come from
the shape of the token and the word before it; neighbours share a chain potential; and nodes
anywhere in a document whose tokens are equal, or have the same last eight digits or the same local
part, share a skip potential, each with the next of its like, so edges grow with the nodes.  Loopy
sum-product passes messages over both kinds of edges; nodes under a base span are observed.  Nodes
that come out with a label beyond ``BELIEF`` add spans (neighbours of one label join), unless they
touch a base span.

The potentials are fitted on a bounded sample of documents, ``TRAIN_DOCS`` in hash order, with the
base spans as labels; the scan itself covers every whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import prepare, text_of

TRAIN_DOCS = 4000
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
BELIEF, ROUNDS, DAMPING = 0.9, 8, 0.5
#: Strength of the skip potentials (equal tokens, similar tokens), in log space.
SAME, SIMILAR = 4.0, 2.5
FEATURES = 512

# Fixed patterns (as the task states them; what goes before a digit run or an @ only avoids retries)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = frozenset("\x20\t\n\x0b\x0c\r")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k & 1:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost matches; each @ is tried once with all of the local part before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at)
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = _emails(text) if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _bucket(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "replace"), digest_size=4).digest(), "big") % FEATURES


class _Bucketed(dict):
    def __missing__(self, feature: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[feature] = n = _bucket(feature)
        return n


_BUCKETS = _Bucketed()


def _shape(token: str) -> str:
    """Classes of the characters of the whole token, each run of one class or character as one."""
    out = []
    for ch in token:
        k = "9" if ch.isdigit() else "a" if ch.isalpha() else ch
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _word_before(text: str, at: int) -> str:
    end = at
    while end and text[end - 1] in _SPACES:
        end -= 1
    start = end
    while start and text[start - 1] not in _SPACES:
        start -= 1
    return text[start:end]


class Document:
    """Nodes of a text with features, base labels and edges."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        found = [m.span() for m in _WORD.finditer(text) if _HINT.search(m.group())]
        self.start = [a for a, _ in found]
        self.end = [b for _, b in found]
        n = len(found)
        self.label = np.zeros(n, dtype=np.int64)
        k = 0
        for i, (a, b) in enumerate(found):
            while k < len(spans) and spans[k][2] <= a:
                k += 1
            if k < len(spans) and spans[k][0] < b:
                self.label[i] = 1 + spans[k][1]
        rows, cols = [], []
        like: dict[str, list] = defaultdict(list)
        self.chain: list[int] = []  # i: node i and i + 1 are neighbouring tokens
        for i, (a, b) in enumerate(found):
            token = text[a:b].strip(".,;:!?\"'")
            digits = "".join(_DIGITS.findall(token))
            before = _word_before(text, a)
            feats = (f"s:{_shape(token)}", f"n:{min(len(token) // 2, 20)}", f"d:{min(len(digits), 20)}", f"@:{'@' in token}",
                     f".:{min(token.count('.'), 4)}", f"+:{token[:1] == '+'}", f"w:{before.lower()}", "bias")
            for f in feats:
                rows.append(i)
                cols.append(_BUCKETS[f])
            like[f"t:{token}"].append((i, SAME))
            if len(digits) >= 7:
                like[f"d:{digits[-8:]}"].append((i, SIMILAR))
            if "@" in token:
                like[f"l:{token.split('@')[0].lower()}"].append((i, SIMILAR))
            if i + 1 < n and found[i + 1][0] - b == 1:
                self.chain.append(i)
        self.rows, self.cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
        skip: dict[tuple[int, int], float] = {}
        for members in like.values():
            for (i, w), (j, _) in zip(members, members[1:]):
                skip[(i, j)] = max(w, skip.get((i, j), 0.0))
        self.skip = skip


def unary(doc: Document, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(doc.start), LABELS))
    np.add.at(out, doc.rows, weights[doc.cols])
    return out - np.logaddexp.reduce(out, axis=1, keepdims=True)


def beliefs(local: np.ndarray, edges: list[tuple[int, int, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of every node by damped loopy sum-product in log space."""
    if not edges:
        b = local - local.max(axis=1, keepdims=True)
        p = np.exp(b)
        return p / p.sum(axis=1, keepdims=True)
    a = np.array([e[0] for e in edges])
    b = np.array([e[1] for e in edges])
    pot = np.stack([e[2] for e in edges])
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    pair = np.concatenate([pot, pot.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    msg = np.zeros((len(src), LABELS))
    for _ in range(rounds):
        total = local.copy()
        np.add.at(total, dst, msg)
        out = (total[src] - msg[back])[:, :, None] + pair
        new = np.logaddexp.reduce(out, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        msg = DAMPING * msg + (1 - DAMPING) * new
    total = local.copy()
    np.add.at(total, dst, msg)
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(axis=1, keepdims=True)


class Field:
    def __init__(self, weights: np.ndarray, chain: np.ndarray):
        self.weights, self.chain = weights, chain
        self.same, self.similar = SAME * np.eye(LABELS), SIMILAR * np.eye(LABELS)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and those that the field adds."""
        if not _HINT.search(text):
            return [], []
        base = base_spans(text)
        doc = Document(text, base)
        if not doc.start:
            return base, []
        local = unary(doc, self.weights)
        seen = np.flatnonzero(doc.label)
        local[seen] = -20.0
        local[seen, doc.label[seen]] = 0.0
        edges = [(i, i + 1, self.chain) for i in doc.chain]
        edges += [(i, j, self.same if w == SAME else self.similar) for (i, j), w in doc.skip.items()]
        p = beliefs(local, edges)
        best = p.argmax(axis=1)
        chain, added = set(doc.chain), []
        for i in range(len(best)):
            if doc.label[i] or best[i] == 0 or p[i, best[i]] < BELIEF:
                continue
            kind = int(best[i]) - 1
            a, b = doc.start[i], doc.end[i]
            while b > a and text[b - 1] in ".,;:!?\"'":
                b -= 1
            while a < b and text[a] in ".,;:!?\"'":
                a += 1
            if added and added[-1][1] == kind and i - 1 in chain and added[-1][3] == i - 1:
                added[-1] = (added[-1][0], kind, b, i)
            elif a < b:
                added.append((a, kind, b, i))
        return base, [x[:3] for x in added]


def _learn(docs: list[Document], steps: int = 200, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    rows, cols, label, at = [], [], [], 0
    trans = np.full((LABELS, LABELS), 0.5)
    for d in docs:
        rows.append(d.rows + at)
        cols.append(d.cols)
        label.append(d.label)
        at += len(d.start)
        for i in d.chain:
            trans[d.label[i], d.label[i + 1]] += 1
    w = np.zeros((FEATURES, LABELS))
    if at:
        r, c, y = np.concatenate(rows), np.concatenate(cols), np.concatenate(label)
        truth, square = np.eye(LABELS)[y], np.full(w.shape, 1e-8)
        for _ in range(steps):  # softmax regression by AdaGrad
            z = np.zeros((at, LABELS))
            np.add.at(z, r, w[c])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = np.zeros_like(w)
            np.add.at(g, c, (p - truth)[r] / at)
            g += ridge * w
            square += g * g
            w -= rate * g / np.sqrt(square)
    prior = trans.sum(axis=1, keepdims=True) * trans.sum(axis=0, keepdims=True) / trans.sum()
    return Field(w, np.clip(np.log(trans / prior), -2.0, 2.0))


def fit(docs: DataFrame, id_col: str, text_col: str, train_docs: int = TRAIN_DOCS) -> Field:
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter("id is not null").withColumn("th", F.xxhash64("text"))
    chosen = rows.select("id", "th").distinct().orderBy(F.xxhash64("id"), "id", "th").limit(train_docs)
    # of an id with several texts each is a row of the sample, and a repeated row counts once
    sample = rows.join(F.broadcast(chosen), ["id", "th"]).dropDuplicates(["id", "th"]).filter(F.col("text").rlike("[0-9@]"))

    def nodes(batches):
        for b in batches:
            out = [Document(t, base_spans(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([d.cols.tolist() for d in out], pa.list_(pa.int64())), pa.array([d.label.tolist() for d in out], pa.list_(pa.int64())),
                pa.array([d.chain for d in out], pa.list_(pa.int64()))], names=["cols", "label", "chain"])

    found = sample.select("text").mapInArrow(nodes, "cols array<bigint>, label array<bigint>, chain array<bigint>").toArrow()  # bounded by the sample
    docs_ = []
    order = sorted(zip(*(found.column(c).to_pylist() for c in ("cols", "label", "chain"))))  # the same sums in any task order
    for cols, label, chain in order:
        d = Document.__new__(Document)
        d.cols, d.label, d.chain, d.start = np.array(cols, dtype=np.int64), np.array(label, dtype=np.int64), chain, label
        d.rows = np.repeat(np.arange(len(label)), len(cols) // max(1, len(label)))
        docs_.append(d)
    return _learn(docs_)


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Null texts are empty; a null id has its row, and is not used for fitting.
    """
    prepare(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, train_docs))
    rows = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches):
        model = field.value
        for b in batches:
            n, sha, spans, more = [[] for _ in KINDS], [], [], []
            for text in b.column("__text").to_pylist():
                base, added = model.spans(text)
                for k in range(len(KINDS)):
                    n[k].append(sum(1 for s in base if s[1] == k))
                sha.append(hashlib.sha256(_text(base).encode()).hexdigest())
                spans.append(_text(sorted(base + added)))
                more.append(len(added))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(sha), pa.array(spans), pa.array(more, pa.int64())], names=names)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
