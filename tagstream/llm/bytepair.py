"""Operator 6, byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

A batch of texts becomes one array of code points and, by a table, of character classes.  Where a
piece may start depends on what came before (an apostrophe begins a contraction only at the start of
a piece), so each character is a function on the states of a small automaton, packed into one byte:
two bits for each of four states.  Composition of such functions is associative and a table look-up;
a blocked prefix scan over the array composes all prefixes at once and gives the state before every
character.  Boundaries are then comparisons of neighbouring classes and states; no regex is run.

The pieces go through a cache to the pair merging, which joins the pair of lowest rank until none is
left.  Byte offsets of the tokens are kept: decoding joins the tokens' bytes, and offsets cut a text
at token boundaries.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import prepare, text_of

OTHER, LETTER, NUMBER, SPACE, WHITE, QUOTE = range(6)
#: Unicode White_Space other than the space.
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces that the cache of a Python worker holds at most.
CACHE_PIECES = 100_000
#: Characters that are cut into pieces at a time: pieces take some hundred bytes a word until they are merged, and
#: workers keep the memory of their largest batch.  A longer text is cut by itself.
SLICE_CHARS = 1_000_000

# States before a character.  FREE: a contraction may begin; BOUND: an apostrophe belongs to what is
# before it; ONE, TWO: so many letters of a contraction are still to come.
FREE, BOUND, ONE, TWO = range(4)


def _packed(*to: int) -> int:
    return sum(s << (2 * k) for k, s in enumerate(to))


_STEP = np.zeros(8, dtype=np.uint8)  # class (6 and 7: apostrophe before a contraction's one or two letters) -> function
_STEP[OTHER] = _STEP[SPACE] = _STEP[QUOTE] = _packed(BOUND, BOUND, BOUND, BOUND)
_STEP[LETTER] = _packed(FREE, FREE, FREE, ONE)
_STEP[NUMBER] = _STEP[WHITE] = _packed(FREE, FREE, FREE, FREE)
_STEP[6] = _packed(ONE, BOUND, ONE, ONE)
_STEP[7] = _packed(TWO, BOUND, TWO, TWO)
_IDENTITY = _packed(0, 1, 2, 3)


@lru_cache(maxsize=1)
def _compose() -> np.ndarray:
    """compose[a * 256 + b]: first a, then b."""
    a, b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    out = np.zeros((256, 256), dtype=np.int64)
    for s in range(4):
        out |= ((b >> (2 * ((a >> (2 * s)) & 3))) & 3) << (2 * s)
    return out.astype(np.uint8).ravel()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k:
            table[c] = k
    table[_WHITE] = WHITE
    table[32], table[39] = SPACE, QUOTE
    return table


def states_before(step: np.ndarray) -> np.ndarray:
    """State before each character, by a blocked scan of the composed step functions, from FREE."""
    n, compose = len(step), _compose()
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    padded = np.full(blocks * width, _IDENTITY, dtype=np.uint8)
    padded[:n] = step
    f = np.ascontiguousarray(padded.reshape(blocks, width).T)  # row j: character j of each block
    upto = np.empty_like(f)
    upto[0] = f[0]
    for j in range(1, width):
        upto[j] = compose[upto[j - 1].astype(np.int64) * 256 + f[j]]
    entry = np.empty(blocks, dtype=np.uint8)  # state before each block
    s = FREE
    for k, g in enumerate(upto[-1].tolist()):
        entry[k] = s
        s = (g >> (2 * s)) & 3
    state = np.empty_like(f)
    state[0] = entry
    state[1:] = (upto[:-1] >> (2 * entry)) & 3
    return state.T.ravel()[:n]


def piece_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Indexes at which a piece starts, in texts laid end to end (no empty ones)."""
    n = len(codes)
    cls = class_table()[codes]
    begins = np.zeros(n + 1, dtype=bool)
    begins[text_starts] = True
    begins[n] = True
    # what follows within the same text, 0 beyond it
    one = np.zeros(n, dtype=np.uint32)
    one[:-1] = np.where(begins[1:n], 0, codes[1:])
    two = np.zeros(n, dtype=np.uint32)
    two[:-1] = np.where(begins[1:n], 0, one[1:])
    symbol = cls.copy()
    quote = cls == QUOTE
    if quote.any():
        at = np.flatnonzero(quote)
        a, b = one[at], two[at]
        short = np.isin(a, [ord(x) for x in "stmd"])
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbol[at[short]] = 6
        symbol[at[long]] = 7
    step = _STEP[symbol]
    first = step[text_starts] & 3  # a text starts FREE, whatever was before it
    step[text_starts] = first | first << 2 | first << 4 | first << 6
    state = states_before(step)
    state[text_starts] = FREE
    in_contraction = state >= ONE
    opens = (symbol >= 6) & (state == FREE)

    kind = np.where(quote, OTHER, cls)
    white = (cls == SPACE) | (cls == WHITE)
    before_white, before_space = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before_white[1:], before_space[1:] = white[:-1], cls[:-1] == SPACE
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    ended = np.zeros(n, dtype=bool)  # the character before was a contraction's last
    ended[1:] = (state[:-1] == ONE)
    next_plain = np.zeros(n, dtype=bool)
    next_plain[:-1] = ~white[1:] & ~begins[1:n]

    plain_start = np.where(before_white, ~before_space, change | ended | opens) & ~in_contraction
    white_start = ~before_white | next_plain
    start = np.where(white, white_start, plain_start)
    start[text_starts] = True
    return np.flatnonzero(start)


class BytePair:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.top = max(self.tokens) + 1
        self.byte = np.array([ranks[bytes([k])] for k in range(256)], dtype=np.int64)
        self.same = list(range(self.top))  # one object for each id
        # every way in which two tokens make a third
        made = [(ranks[t[:k]] * self.top + ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        made.sort()
        self.pairs = np.array([x for x, _ in made], dtype=np.int64)
        self.joined = np.array([i for _, i in made], dtype=np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make, ``top`` if none."""
        key = a * self.top + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], self.top)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece: pieces of equal length are merged together, one pair of each at a time."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        whole = self.ranks
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if p in whole:
                out[k] = (whole[p],)
            elif len(p) > 64:
                out[k] = self._merge_long(p)
            else:
                by_length.setdefault(len(p), []).append(k)
        same = self.same
        for width, members in by_length.items():
            at = np.array(members)
            ids = self.byte[np.frombuffer(b"".join([pieces[k] for k in members]), dtype=np.uint8).reshape(-1, width)]
            rank = self._rank(ids[:, :-1], ids[:, 1:])
            while True:
                k = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), dtype=np.int64)
                low = rank[np.arange(len(ids)), k] if rank.shape[1] else np.full(len(ids), self.top)
                done = low >= self.top
                for place, row in zip(at[done].tolist(), ids[done].tolist()):
                    out[place] = tuple([same[i] for i in row])
                if done.all():
                    break
                at, ids, rank, k, low = at[~done], ids[~done], rank[~done], k[~done, None], low[~done]
                rows = np.arange(len(ids))
                col = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, col + (col > k), axis=1)
                ids[rows, k[:, 0]] = low
                col = col[:-1]
                rank = np.take_along_axis(rank, col + (col >= k), axis=1)
                k = k[:, 0]
                left, right = np.flatnonzero(k > 0), np.flatnonzero(k < ids.shape[1] - 1)
                rank[left, k[left] - 1] = self._rank(ids[left, k[left] - 1], ids[left, k[left]])
                rank[right, k[right]] = self._rank(ids[right, k[right]], ids[right, k[right] + 1])
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges by a heap over linked parts, for one piece of many bytes."""
        import heapq

        parts = [piece[k:k + 1] for k in range(len(piece))]
        ranks, n = self.ranks, len(parts)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            m = after[k] if live[k] else n
            if m >= n or ranks.get(parts[k] + parts[m]) != r:
                continue  # one of the two has been merged since
            parts[k] += parts[m]
            live[m] = False
            after[k] = after[m]
            if after[k] < n:
                prior[after[k]] = k
            for a, b in ((prior[k], k), (k, after[k])):
                if a >= 0 and b < n and (x := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (x, a))
        return tuple(ranks[parts[k]] for k in range(n) if live[k])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        start = size = 0
        for k, t in enumerate(texts):
            if k > start and size + len(t) > SLICE_CHARS:
                out += self._encode(texts[start:k])
                start, size = k, 0
            size += len(t)
        return out + self._encode(texts[start:])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        whole = "".join(texts)
        if not whole:
            return out
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths)
        filled = np.flatnonzero(lengths)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts = piece_starts(codes, ends[filled] - lengths[filled])
        cuts = np.append(starts, len(codes)).tolist()
        pieces = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        first = np.searchsorted(starts, ends - lengths).tolist()
        last = np.searchsorted(starts, ends).tolist()
        cache, distinct = self.cache, set(pieces)
        new = [p for p in distinct if p not in cache]
        if len(cache) + len(new) > CACHE_PIECES:
            cache.clear()
            new = list(distinct)
        cache.update(zip(new, self.merge_many([p.encode("utf-8", "replace") for p in new])))
        look = cache.__getitem__
        for k in filled.tolist():
            out[k] = list(chain.from_iterable(map(look, pieces[first[k]:last[k]])))
        return out

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Byte offset of each token's start, and the length of the text at the end."""
        return np.concatenate([[0], np.cumsum([len(self.tokens[i]) for i in ids], dtype=np.int64)]).astype(np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_models: dict[int, BytePair] = {}


def _model(shared) -> BytePair:
    """One model (and cache) per Python worker and vocabulary."""
    if shared.id not in _models:
        _models.clear()
        _models[shared.id] = BytePair(shared.value)
    return _models[shared.id]


class _Shared:
    """A broadcast of the vocabulary (of fixed size) with a name that its users can key a cache by."""

    def __init__(self, spark, ranks: dict[bytes, int]):
        self.broadcast = spark.sparkContext.broadcast(ranks)
        self.id = hashlib.sha256(b" ".join(sorted(ranks))).hexdigest()

    @property
    def value(self) -> dict[bytes, int]:
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (array of token ids), offsets (byte offset of each token, then the length).

    Null texts are empty: no ids, offsets [0].
    """
    prepare(docs.sparkSession)
    shared = _Shared(docs.sparkSession, read_ranks(rank_file))
    rows = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = _model(shared)
        for b in batches:
            ids = model.encode_batch(b.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([model.offsets(x) for x in ids], pa.list_(pa.int64()))],
                                             names=[id_col, "ids", "offsets"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, offsets array<bigint>")


def decode(encoded: DataFrame, rank_file: str, id_col: str = "doc_id") -> DataFrame:
    """One row per encoded document: id, bytes."""
    prepare(encoded.sparkSession)
    shared = _Shared(encoded.sparkSession, read_ranks(rank_file))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        model = _model(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], names=[id_col, "bytes"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to)."""
    prepare(docs.sparkSession)
    shared = _Shared(docs.sparkSession, read_ranks(rank_file))
    rows = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = _model(shared)
        for b in batches:
            encoded = model.encode_batch(b.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in encoded]),
                pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in encoded])], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
