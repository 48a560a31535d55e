"""Problem 6: encoding of whole texts with a public byte-level BPE vocabulary.

Method: a pair occurrence index over all different pre-tokens of a batch.  The symbols
of the pre-tokens stand in one doubly linked array; each mergeable pair maps to all its
positions (the first index is made in arrays); ranks are taken in ascending order and each
merge updates the index of its neighbours only.  A pre-token of a million characters
therefore costs n log n, not n^2, and each different pre-token of a worker is merged once.

Null and empty texts have defined ids: the empty list.  Marker look-alikes such as
``<|endoftext|>`` are ordinary text; no special token is ever produced.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The white space of the Unicode property White_Space, and the pre-token
# pattern that belongs to the vocabulary.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Different pre-tokens that a worker remembers between batches; beyond it the memory starts anew.
REMEMBERED = 1_000_000
#: Characters that are encoded at a time within a batch.
CHUNK = 4_000_000


class Vocabulary:
    """Byte strings by id, and the merge rank of pairs of ids."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        pairs = sorted((ranks[b[:k]] << 32 | ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        self.single_ids = np.array(self.single, np.int64)

    def merge(self, a: int, b: int) -> int:
        """The id (and rank) of the two tokens joined, -1 where the vocabulary has none."""
        r = self.merged.get((a, b))
        if r is None:
            r = self.merged[a, b] = self.ranks.get(self.bytes[a] + self.bytes[b], -1)
        return r

    def encode_pieces(self, pieces: list[bytes]) -> list[array]:
        """Token ids of each pre-token, by one occurrence index over all of them."""
        merge = self.merge
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        walls = np.cumsum(size + 1) - 1  # one between pre-tokens
        symbols = np.full(int(size.sum()) + len(pieces), -1, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[walls] = False
        symbols[inside] = self.single_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbols)
        # the index: all places of each pair that merges, by its rank
        key = symbols[:-1] << 32 | symbols[1:]
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        place = np.flatnonzero((self.pair_keys[found] == key) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)) if n > 1 else np.empty(0, np.int64)
        rank = self.pair_ranks[found[place]]
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        edge = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1], True]) if len(rank) else np.zeros(1, np.int64)
        at: dict[int, list[int]] = {int(rank[lo]): place[lo:hi].tolist() for lo, hi in zip(edge[:-1], edge[1:])}
        sym = symbols.tolist()
        starts = (walls - size).tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ranks = list(at)
        heapq.heapify(ranks)
        while ranks:
            r = heapq.heappop(ranks)
            places = at.pop(r, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                a = sym[i]
                if a < 0:
                    continue
                j = after[i]
                if j >= n or sym[j] < 0 or merge(a, sym[j]) != r:
                    continue
                sym[i] = r
                sym[j] = -2  # consumed
                nxt = after[j]
                after[i] = nxt
                if nxt < n:
                    before[nxt] = i
                least = r
                prev = before[i]
                if prev >= 0 and sym[prev] >= 0:
                    q = merge(sym[prev], r)
                    if q >= 0:
                        if q not in at:
                            at[q] = [prev]
                            heapq.heappush(ranks, q)
                        else:
                            at[q].append(prev)
                        least = min(least, q)
                if nxt < n and sym[nxt] >= 0:
                    q = merge(r, sym[nxt])
                    if q >= 0:
                        if q not in at:
                            at[q] = [i]
                            heapq.heappush(ranks, q)
                        else:
                            at[q].append(i)
                        least = min(least, q)
                if least < r and k + 1 < len(places):
                    # a lower rank came up: it goes first, the rest of this rank later
                    at.setdefault(r, []).extend(places[k + 1 :])
                    heapq.heappush(ranks, r)
                    break
        out = []
        for s in starts:
            ids = array("i")
            i = s
            while sym[i] != -1:
                ids.append(sym[i])
                i = after[i]
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a path, loaded once per worker."""
    return Vocabulary(path)


class Encoder:
    """Encodes texts to flat ids; remembers the pre-tokens it has met."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.vocabulary = vocabulary(path)
        self.find = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.sizes = np.empty(1 << 14, np.int32)
        self.vocabulary.merged.clear()

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encode the pre-tokens not met before and store their ids."""
        code = self.code
        new = [p for p in pieces if p not in code]
        if not new:
            return
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        lists = self.vocabulary.encode_pieces(raw)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.frombuffer(b"".join(x.tobytes() for x in lists), np.int32)
        k, known = len(code), len(code) + len(new)
        if known > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * known), np.resize(self.sizes, 2 * known)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.starts[k:known] = self.used + np.cumsum(sizes) - sizes
        self.sizes[k:known] = sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        code.update(zip(new, range(k, known)))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the pre-tokens of all texts one after the other, number of pre-tokens of each text)."""
        return self.find_codes(texts)[1:]

    def find_codes(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """(pre-tokens of each text, their codes one after the other, their number in each text)."""
        if len(self.code) > REMEMBERED:
            self._reset()
        found = [self.find(t) for t in texts]
        self._learn(set().union(*found))
        flat = np.fromiter(map(self.code.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        return found, flat, np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        flat, pieces = self.codes(texts)
        sizes = self.sizes[flat].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        # position of each id in the store: start of its piece plus its place within the piece
        where = np.repeat(self.starts[flat] - (ends - sizes), sizes) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces)])]
        return self.ids[where], np.diff(bounds)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a list of ids."""
        return b"".join(self.vocabulary.bytes[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters each; every text in one range, whole."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """<id_col> LONG, ids ARRAY<INT>: the token ids of every row's whole text, in one pass without a shuffle.

    Null and empty texts give the empty list; repeated rows are encoded each.
    """
    out = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            keys = b.column(0).cast(pa.int64())
            for lo, hi in chunks(texts):
                ids, sizes = enc.encode(texts[lo:hi])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys[lo:hi], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], schema=out)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` long, ids array<int>")
