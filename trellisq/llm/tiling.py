"""Problem 7: passages of held-out test items inside a training corpus.

Method: greedy string tiling over words.  Texts and passages are reduced to words (case,
accents, punctuation, markup and spacing aside).  A running Karp-Rabin hash over five
words finds the shared seeds of a whole batch at once; seeds are joined to the passages
that hold them; for each (passage, document) the longest match is marked again and again
until none is left, so that tiles do not overlap on either side.  The covered share of
the passage is held against a threshold, whatever the order of the tiles (reordered
passages); a leak in the sense of the data is a run of at least 25 passage words in order of
which at most one in eight is changed, dropped or added, decided exactly from the tiles or,
where they do not settle it, by an alignment around every place where seeds stand.

Why seeds of five words lose nothing: 25 or more words with at most an eighth edited keep
22 intact in at most four stretches, or more in as many; one of them has six words.

Why seven edits are enough to look for: a longer stretch cut into runs of 32 words, the last
one of up to 55, has a run within the share, as the shares allowed to the runs add up to
that of the whole.

The corpus is read once, in one pass without a shuffle, for each block of passages; blocks
are packed by counted words, at most ``block_words`` each, so what is sent to the tasks is
bounded.  Passages that are equal as words are matched once and expanded to all their items
at the end.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.llm.bpe import chunks
from trellisq.session import written

SEED = 5
LEAST_WORDS = 25
EDIT_SHARE = 8
#: The longest run that has to be looked for, and its edits.
LONGEST = 56
MOST_EDITS = LONGEST // EDIT_SHARE
#: Share of the passage under tiles, in any order, from which a passage counts as taken over though no stretch is left.
REORDERED = 0.6
#: Pairs of seed places that are held at a time.
MOST_SEEDS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u0670\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\u3099\u309a\ufe20-\ufe2f\u00ad\u200b-\u200f\u2060\ufeff]")
#: Letters that carry a stroke or join two letters and have no decomposition.
_LETTERS = {"\u0142": "l", "\u00f8": "o", "\u0111": "d", "\u0127": "h", "\u0167": "t", "\u0131": "i", "\u00e6": "ae", "\u0153": "oe", "\u00f0": "d", "\u00fe": "th"}
_LETTER = re.compile(f"[{''.join(_LETTERS)}]")


def words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits without case, accents and markup."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = _LETTER.sub(lambda x: _LETTERS[x[0]], text)
    return _WORD.findall(text)


@dataclass
class Tile:
    """A marked match: first word in the passage and in the document, and its length."""

    item: int
    doc: int
    size: int


def tiles(item: np.ndarray, doc: np.ndarray, starts: list[tuple[int, int]], least: int = SEED) -> list[Tile]:
    """Greedy tiling: mark the longest match of unmarked words, again and again, down to ``least`` words.

    ``starts`` are the seed places (passage, document).  Ties go to the earlier place.
    """
    m, n = len(item), len(doc)
    free_i, free_d = np.ones(m, bool), np.ones(n, bool)
    runs: dict[int, list[tuple[int, int]]] = {}
    seen: set[tuple[int, int]] = set()
    for i, d in starts:
        # maximal run of equal words through the seed
        if (i, d) in seen:
            continue
        a = 0
        while i - a > 0 and d - a > 0 and item[i - a - 1] == doc[d - a - 1]:
            a += 1
        b = 0
        while i + b < m and d + b < n and item[i + b] == doc[d + b]:
            b += 1
        seen.update((i + k, d + k) for k in range(-a, b))
        runs.setdefault(a + b, []).append((i - a, d - a))
    out: list[Tile] = []
    while runs:
        size = max(runs)
        for i, d in sorted(runs.pop(size)):
            ok = free_i[i : i + size] & free_d[d : d + size]
            if ok.all():
                free_i[i : i + size] = False
                free_d[d : d + size] = False
                out.append(Tile(i, d, size))
                continue
            # what is left of an overlapped run competes again at its own length
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
            for x, y in zip(edge[::2], edge[1::2]):
                if y - x >= least:
                    runs.setdefault(int(y - x), []).append((i + int(x), d + int(x)))
    return out


def _allowed(length: int) -> int:
    return length // EDIT_SHARE


def chained(found: list[Tile], m: int) -> bool:
    """Whether tiles in order already make a stretch; gaps count as their longer side."""
    found = sorted(found, key=lambda t: (t.item, t.doc))
    for a, first in enumerate(found):
        edits, last = 0, first
        for nxt in found[a : a + 1] + found[a + 1 :]:
            if nxt is not first:
                gi, gd = nxt.item - last.item - last.size, nxt.doc - last.doc - last.size
                if gi < 0 or gd < 0 or max(gi, gd) > _allowed(m) + 1:
                    continue
                edits, last = edits + max(gi, gd), nxt
            length = last.item + last.size - first.item
            if length >= LEAST_WORDS and edits <= _allowed(length):
                return True
    return False


def aligned(item: np.ndarray, doc: np.ndarray) -> bool:
    """Exact: does some run of passage words align with the document within the edit share?

    L[e, j] is the longest run of passage words that ends at the current passage word and
    at document word j with e edits.  A run begins and ends with an equal word, or spends
    its edits on changed words at its ends.
    """
    m, n = len(item), len(doc)
    most = min(_allowed(m), MOST_EDITS)
    low = -(10**6)
    prev = np.full((most + 1, n + 1), low, np.int32)
    need = np.maximum(np.arange(most + 1) * EDIT_SHARE, LEAST_WORDS)[:, None]
    for i in range(m):
        equal = doc == item[i]
        cur = np.full((most + 1, n + 1), low, np.int32)
        step = prev[:, :-1]
        cur[:, 1:] = np.where(equal, step + 1, low)
        cur[0, 1:] = np.where(equal, np.maximum(step[0] + 1, 1), low)
        if most:
            # a changed word may also begin a run
            fresh = np.where(~equal, 1, low)
            cur[1:, 1:] = np.maximum(cur[1:, 1:], np.where(equal, low, prev[:-1, :-1] + 1))
            cur[1, 1:] = np.maximum(cur[1, 1:], fresh)
            cur[1:, :] = np.maximum(cur[1:, :], prev[:-1, :] + 1)
            for e in range(1, most + 1):
                np.maximum(cur[e, 1:], cur[e - 1, :-1], out=cur[e, 1:])
        if (cur >= need).any():
            return True
        prev = cur
    return False


@dataclass
class Seeds:
    """Seed hashes of passages in ascending order, with the passage and the place they stand at."""

    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def __post_init__(self) -> None:
        self.distinct, first = np.unique(self.hash, return_index=True)
        self.first = np.append(first, len(self.hash))

    def halves(self) -> list[Seeds]:
        """The seeds of the lower and of the upper passages; nothing to split where there is one passage."""
        low, high = (int(self.item.min()), int(self.item.max())) if len(self.item) else (0, 0)
        if low == high:
            return []
        lower = self.item <= (low + high) // 2
        return [Seeds(self.hash[k], self.item[k], self.place[k]) for k in (lower, ~lower)]


class Index:
    """The passages of one block: word ids, seed hashes and where they stand."""

    def __init__(self, passages: list[list[str]]) -> None:
        self.ids: dict[str, int] = {}
        self.items = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in p], np.int64) for p in passages]
        rows = [(h, k, i) for k, p in enumerate(self.items) for i, h in enumerate(self.hashes(p).tolist())]
        rows.sort()
        self.seeds = Seeds(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    @staticmethod
    def hashes(ids: np.ndarray) -> np.ndarray:
        """Karp-Rabin hash of every run of SEED words, modulo 2^64."""
        n = len(ids) - SEED + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SEED):
                h = h * BASE + ids[k : k + n].astype(np.uint64)
        return h

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, bool]]:
        """(text number, passage number, covered share, whether it holds a stretch) of the pairs worth a look."""
        found = [words(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
        base = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.zeros(base[-1], np.int64)
        get = self.ids.get
        for b, w in zip(base, found):
            flat[b : b + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
        del found
        known = np.flatnonzero(np.convolve(flat > 0, np.ones(SEED, np.int8), "valid") == SEED) if len(flat) >= SEED else np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            h = np.zeros(len(known), np.uint64)
            for k in range(SEED):
                h = h * BASE + flat[known + k].astype(np.uint64)
        yield from self._met(flat, base, known, h, self.seeds)

    def _met(self, flat: np.ndarray, base: np.ndarray, known: np.ndarray, h: np.ndarray, seeds: Seeds) -> Iterator[tuple[int, int, float, bool]]:
        """The judged pairs of texts and passages; passages are halved where too many seed places meet at once."""
        if not len(known) or not len(seeds.distinct):
            return
        at = np.minimum(np.searchsorted(seeds.distinct, h), len(seeds.distinct) - 1)
        hit = seeds.distinct[at] == h
        known, at, h = known[hit], at[hit], h[hit]
        if not len(known):
            return  # five known words in a row, but in no passage so
        # join the seeds with every passage place that has them
        many = seeds.first[at + 1] - seeds.first[at]
        if many.sum() > MOST_SEEDS and (halves := seeds.halves()):
            for half in halves:
                yield from self._met(flat, base, known, h, half)
            return
        where = np.repeat(known, many)
        row = np.repeat(seeds.first[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        item, place = seeds.item[row], seeds.place[row]
        text = np.searchsorted(base, where, "right") - 1
        order = np.lexsort((where, place, item, text))
        text, item, place, where = text[order], item[order], place[order], where[order]
        edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
        edge = np.append(edge, len(text))
        # passage words covered by seeds: each place adds what the place before did not cover
        step = np.minimum(np.diff(place, prepend=-SEED), SEED)
        step[edge[:-1]] = SEED
        cover = np.add.reduceat(step, edge[:-1]) if len(text) else np.empty(0)
        for k in np.flatnonzero(cover >= 2 * SEED):
            lo, hi = edge[k], edge[k + 1]
            yield self._judge(int(text[lo]), int(item[lo]), place[lo:hi], where[lo:hi] - base[text[lo]], flat[base[text[lo]] : base[text[lo] + 1] - 1])

    def _judge(self, t: int, k: int, place: np.ndarray, where: np.ndarray, doc: np.ndarray) -> tuple[int, int, float, bool]:
        item = self.items[k]
        m = len(item)
        found = tiles(item, doc, list(zip(place.tolist(), where.tolist())))
        share = sum(x.size for x in found) / m
        if any(x.size >= LEAST_WORDS for x in found) or chained(found, m):
            return t, k, share, True
        for lo, hi in self._windows(item, doc, place, where):
            if aligned(item, doc[lo:hi]):
                return t, k, share, True
        return t, k, share, False

    def _windows(self, item: np.ndarray, doc: np.ndarray, place: np.ndarray, where: np.ndarray) -> list[tuple[int, int]]:
        """The parts of the document that may hold a stretch, from all seed places, sorted and without overlap.

        The seeds of a stretch lie on diagonals (document place less passage place) no
        farther apart than the edits allowed and cover ten passage words or more; from its
        lowest diagonal the stretch lies within the passage's length and the edits allowed.
        Tiles do not tell: words that are tiled elsewhere in the document have no tile here.
        """
        m = len(item)
        room = min(_allowed(m), MOST_EDITS)
        by = np.lexsort((place, where - place))
        diagonal, place = (where - place)[by], place[by]
        lowest, first = np.unique(diagonal, return_index=True)
        last = np.searchsorted(diagonal, lowest + room, "right")
        out: list[tuple[int, int]] = []
        for d, a, b in zip(lowest.tolist(), first.tolist(), last.tolist()):
            if b - a < 2:
                continue
            held = np.sort(place[a:b])
            cover = SEED + np.minimum(np.diff(held), SEED).sum()
            if cover < 2 * SEED or not self._possible(item, doc, d):
                continue
            first_word, last_word = max(0, int(held[0]) - LONGEST), min(m, int(held[-1]) + SEED + LONGEST)
            lo, hi = max(0, d + first_word - room), min(len(doc), d + last_word + 2 * room)
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out

    @staticmethod
    def _possible(item: np.ndarray, doc: np.ndarray, diagonal: int) -> bool:
        """A bound that spares the alignment: enough passage words near the diagonal.

        Any stretch of 25 words and an eighth of edits has, in some run of 25 passage
        words, at least 18 that stand in the document no farther off the diagonal than
        the edits allowed.
        """
        m = len(item)
        slack = min(_allowed(m), MOST_EDITS) + 1
        near = np.zeros(m, bool)
        for s in range(-slack, slack + 1):
            j = np.arange(m) + diagonal + s
            ok = (j >= 0) & (j < len(doc))
            near[ok] |= item[ok] == doc[j[ok]]
        runs = np.convolve(near, np.ones(min(LEAST_WORDS, m), int), "valid")
        return bool(runs.max() >= 18)


def _blocks(passages: DataFrame, block_words: int) -> list[tuple[int, int]]:
    """(part, parts) of blocks of distinct passages (key, n): hash parts of at most ``block_words`` counted words, or of one passage."""
    total = passages.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // block_words) or 1
    while True:
        sizes = passages.groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("passages"))
        if parts == 1 or sizes.where((F.col("words") > block_words) & (F.col("passages") > 1)).isEmpty():
            return [(r.part, parts) for r in sizes.select("part").orderBy("part").toLocalIterator()]
        parts *= 2


def leaks(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "passage",
    block_words: int = 2_000_000,
) -> DataFrame:
    """<item_col>, <id_col>, covered (share of the passage under tiles), stretch (a leak as defined), verdict.

    One row per item and document that share seeds over ten passage words or more.
    ``verdict`` is ``stretch``; or ``reordered`` where tiles cover REORDERED of a passage of
    25 words or more in another order; or ``partial``.  Null and empty texts and passages,
    and passages under five words, match nothing; repeated rows and equal passages each get
    their rows.
    """
    spark = documents.sparkSession
    as_words = F.pandas_udf(lambda s: s.map(lambda p: " ".join(words(p))), "string")
    named = items.where(F.col(passage_col).isNotNull()).select(F.col(item_col).cast("long").alias(item_col), as_words(passage_col).alias("key"))
    named = written(named.withColumn("n", F.size(F.split("key", " "))).where((F.col("key") != "") & (F.col("n") >= SEED)))
    passages = named.groupBy("key").agg(F.min("n").alias("n"))
    schema = pa.schema([("kid", pa.string()), ("n", pa.int32()), (id_col, pa.int64()), ("covered", pa.float64()), ("stretch", pa.bool_())])
    ddl = f"kid string, n int, `{id_col}` long, covered double, stretch boolean"
    texts = documents.select(id_col, text_col)
    found = spark.createDataFrame([], ddl)
    for part, parts in _blocks(passages, block_words):
        keys = [r.key for r in passages.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).select("key").collect()]
        sent = spark.sparkContext.broadcast((Index([k.split(" ") for k in keys]), [md5(k.encode()).hexdigest() for k in keys]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, kids = sent.value
            for b in batches:
                ids, texts = b.column(0).cast(pa.int64()).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
                for lo, hi in chunks(texts):
                    got = [(kids[k], len(index.items[k]), ids[lo + t], share, yes) for t, k, share, yes in index.search(texts[lo:hi])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got), schema)], schema=schema) if got else pa.RecordBatch.from_pylist([], schema=schema)

        found = found.unionByName(texts.mapInArrow(run, ddl))
    verdict = F.when(F.col("stretch"), "stretch").when((F.col("covered") >= REORDERED) & (F.col("n") >= LEAST_WORDS), "reordered").otherwise("partial")
    names = named.select(F.md5("key").alias("kid"), item_col)
    return found.join(names, "kid").select(item_col, id_col, "covered", "stretch", verdict.alias("verdict"))
