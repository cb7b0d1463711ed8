"""Operator 1, LM scoring: subword lattice likelihood.

An existing subword vocabulary (a public piece list; never trained here) spans the lattice of all
segmentations of a word.  Piece probabilities start from the vocabulary's own scores (its ranks) and
are re-estimated by expectation-maximisation on the word counts of the training documents, so that
every segmentation counts by its posterior weight.  The probability of a text is the product over
its words of the marginal over all segmentations, computed by a forward recursion in log space, and
of one end symbol.  Pieces mark a word's start and never cross words, so the marginal of a document
is exactly the product of the marginals of its words.

Layout: documents are dealt to blocks by a hash of their id.  Each block reports its distinct words
once; those rows are summed over the corpus by word (partial sums first, so a frequent word is a few
rows per task), the lattice runs once per distinct word of the corpus, and each block gets back a
dictionary of its own words only.  Memory is bounded by a block; nothing word-sized reaches the
driver (only the probabilities of the fixed piece list do).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import fold, parts_for, prepare, stored, text_bytes, text_of

#: Bytes of text in a block of documents.
BLOCK_BYTES = 32 * 1024 * 1024
#: Words that the vectorised lattice takes at once.
CHUNK_WORDS = 50_000
WORD_START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
NEG = -np.inf


def load_pieces(model_file: str) -> list[tuple[str, float]]:
    """(piece, start weight) of a public piece vocabulary; control pieces are left out.

    The file's scores are negative merge ranks; a piece starts with weight 1 / (rank + 10).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        p = sp.id_to_piece(i)
        rank = -sp.get_score(i)
        out.append((p, 1.0 / (min(rank, 1e6) + 10.0)))
    return out


class Lattice:
    """All segmentations of many words at once, for a piece list with log probabilities."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.logp = np.asarray(logp, dtype=np.float64)
        self.byte_piece = np.zeros(256, dtype=np.int64)
        normal: list[tuple[int, int]] = []
        self.max_len = 1
        self.single: set[int] = set()
        for k, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
                self.byte_piece[int(p[3:5], 16)] = k
                continue
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for ch in p:
                    h = h * _BASE + np.uint64(ord(ch) + 1)
            normal.append((int(h), k))
            self.max_len = max(self.max_len, len(p))
            if len(p) == 1:
                self.single.add(ord(p))
        normal.sort()
        self.keys = np.array([h for h, _ in normal], dtype=np.uint64)
        self.ids = np.array([k for _, k in normal], dtype=np.int64)

    def _edges(self, codes: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, piece ids) of the pieces that start at position ``i``."""
        h = np.zeros(len(codes), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(i, min(codes.shape[1], i + self.max_len)):
                h = h * _BASE + (codes[:, j] + np.uint64(1))
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                rows = np.flatnonzero(self.keys[at] == h)
                if len(rows):
                    yield j + 1, rows, self.ids[at[rows]]

    def _fallback(self, codes: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Log probability of each character by its UTF-8 bytes (-inf where a piece covers it)."""
        uniq, inverse = np.unique(codes, return_inverse=True)
        lp, spell = np.full(len(uniq), NEG), {}
        for n, c in enumerate(uniq.tolist()):
            if c not in self.single:
                spell[c] = self.byte_piece[list(chr(c).encode("utf-8", "surrogatepass"))]
                lp[n] = self.logp[spell[c]].sum()
        return lp[inverse].reshape(codes.shape), spell

    def forward(self, codes: np.ndarray) -> np.ndarray:
        """alpha[:, j]: log of the total probability of all segmentations of the first j characters."""
        n, length = codes.shape
        alpha = np.full((n, length + 1), NEG)
        alpha[:, 0] = 0.0
        fall, _ = self._fallback(codes)
        for i in range(length):
            for end, rows, ids in self._edges(codes, i):
                alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, i] + self.logp[ids])
            alpha[:, i + 1] = np.logaddexp(alpha[:, i + 1], alpha[:, i] + fall[:, i])
        return alpha

    def expected(self, codes: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Adds to ``total`` each piece's expected count over all segmentations."""
        n, length = codes.shape
        alpha = self.forward(codes)
        beta = np.full((n, length + 1), NEG)
        beta[:, length] = 0.0
        fall, spell = self._fallback(codes)
        z = alpha[:, length]
        for i in range(length - 1, -1, -1):
            edges = list(self._edges(codes, i))
            for end, rows, ids in edges:
                beta[rows, i] = np.logaddexp(beta[rows, i], beta[rows, end] + self.logp[ids])
            beta[:, i] = np.logaddexp(beta[:, i], beta[:, i + 1] + fall[:, i])
            for end, rows, ids in edges:
                post = np.exp(alpha[rows, i] + self.logp[ids] + beta[rows, end] - z[rows]) * weight[rows]
                total += np.bincount(ids, weights=post, minlength=len(total))
            post = np.exp(alpha[:, i] + fall[:, i] + beta[:, i + 1] - z) * weight
            for c in np.unique(codes[post > 0, i]).tolist():
                np.add.at(total, spell[c], post[codes[:, i] == c].sum())


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code matrix) of words of equal length, the start mark in front."""
    texts = [WORD_START + w.decode("utf-8", "replace") for w in words]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            step = max(1, min(CHUNK_WORDS, 2_000_000 // max(1, int(lengths[part[0]]))))
            for s in range(0, len(part), step):
                at = part[s:s + step]
                flat = "".join([texts[k] for k in at.tolist()]).encode("utf-32-le", "surrogatepass")
                yield at, np.frombuffer(flat, dtype="<u4").reshape(len(at), -1).astype(np.uint64)


def _buffered(batches: Iterable[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes both touch ASCII only


def _count_block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    learn: Counter = Counter()
    seen: set = set()
    for text, train in zip(part["text"], part["train"]):
        w = _tokens(text)
        if train:
            learn.update(w)
        else:
            seen.update(w)
    words = list(learn)
    counts = list(learn.values())
    rest = [w for w in seen if w not in learn]
    return pd.DataFrame({"block": np.int64(key[0]), "word": words + rest,
                         "c": np.array(counts + [0] * len(rest), dtype=np.int64)})


def estimate(words: DataFrame, vocabulary: list[tuple[str, float]], n_ends: int,
             iterations: int = 2, smooth: float = 0.1) -> tuple[list[str], np.ndarray, float]:
    """Piece log probabilities (natural) and the end symbol's, by EM over (word, c) rows."""
    pieces = [p for p, _ in vocabulary]
    w = np.array([x for _, x in vocabulary])
    logp = np.log(w / w.sum())
    end = 0.0
    for _ in range(iterations):
        now = logp

        def expect(batches, now=now):
            lattice, total = Lattice(pieces, now), np.zeros(len(now))
            for t in _buffered(batches):
                word, c = t.column("word").to_pylist(), t.column("c").to_numpy().astype(np.float64)
                for at, codes in _by_length(word):
                    lattice.expected(codes, c[at], total)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.float64())})

        rows = (words.filter("c > 0").mapInArrow(expect, "piece long, n double")
                .groupBy("piece").agg(F.sum("n").alias("n")).collect())  # at most one row per piece
        n = np.zeros(len(pieces))
        for r in rows:
            n[r["piece"]] = r["n"]
        whole = n.sum() + smooth * len(pieces) + n_ends + smooth
        logp = np.log((n + smooth) / whole)
        end = math.log((n_ends + smooth) / whole)
    return pieces, logp, end


def score_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                    held_out_fold: int = 1, folds: int = 5, iterations: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the log10 marginal probability of the text (its words and one end) under the subword
    lattice; ``base_score`` the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over its tokens.  Training
    rows are those whose id is in another fold than ``held_out_fold``.  Null texts are empty texts:
    one end token.  Rows with a null id are scored but never learned from (held_out is then false).
    With no training row at all N = V = 0, and the pieces keep their start weights.
    """
    spark = docs.sparkSession
    prepare(spark)
    f = fold(id_col, folds)
    rows = docs.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(f == held_out_fold, F.lit(False)).alias("held_out"),
        F.coalesce(f != held_out_fold, F.lit(False)).alias("train"),
        text_of(text_col).cast("binary").alias("text"))
    n_blocks = parts_for(spark, text_bytes(docs, text_col), BLOCK_BYTES)
    deal = F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(n_blocks))
    rows = rows.withColumn("block", deal)

    by_block = stored(rows.groupBy("block").applyInPandas(_count_block, "block long, word binary, c long"), "op1-blocks")
    words = stored(by_block.groupBy("word").agg(F.sum("c").alias("c")), "op1-words")
    n_ends = rows.filter("train").count()
    known = words.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train, v = (known["n"] or 0) + n_ends, known["v"] + (1 if n_ends else 0)
    pieces, logp, end = estimate(words, load_pieces(model_file), n_ends, iterations) if n_train else (
        *_start(load_pieces(model_file)), math.log(0.5))

    below = n_train + 0.5 * (v + 1)
    to10 = 1.0 / math.log(10.0)

    def weigh(batches):
        lattice = Lattice(pieces, logp)
        for t in _buffered(batches):
            word = t.column("word").to_pylist()
            lp = np.empty(len(word))
            for at, codes in _by_length(word):
                lp[at] = lattice.forward(codes)[:, -1]
            yield from pa.table({"word": t.column("word"), "c": t.column("c"), "lp": pa.array(lp * to10, pa.float64())}).to_batches()

    scored = stored(words.mapInArrow(weigh, "word binary, c long, lp double"), "op1-scored")
    own = by_block.select("block", "word").join(scored, "word")

    def score_block(key: tuple, part: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        c = np.append(dictionary["c"].to_numpy(dtype=np.int64), n_ends)
        lp = np.append(dictionary["lp"].to_numpy(dtype=np.float64), end * to10)
        base = np.log10((c + 0.5) / below)
        place = dict(zip(dictionary["word"], range(len(dictionary))))
        last = len(dictionary)
        out = np.empty((len(part), 2))
        counts = np.empty((len(part), 2), dtype=np.int64)
        for k, text in enumerate(part["text"]):
            at = [place[w] for w in _tokens(text)]
            at.append(last)
            at = np.array(at, dtype=np.int64)
            out[k] = base[at].sum(), lp[at].sum()
            counts[k] = len(at), np.count_nonzero(c[at])
        return pd.DataFrame({"id": part["id"], "held_out": part["held_out"], "n_tokens": counts[:, 0],
                             "n_known": counts[:, 1], "train_tokens": np.int64(n_train),
                             "base_score": out[:, 0], "score": out[:, 1]})

    out = rows.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(
        score_block, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])


def _start(vocabulary: list[tuple[str, float]]) -> tuple[list[str], np.ndarray]:
    w = np.array([x for _, x in vocabulary])
    return [p for p, _ in vocabulary], np.log(0.5 * w / w.sum())
