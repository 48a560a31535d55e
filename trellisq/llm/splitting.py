"""Problem 8: cut oversized texts into pieces within a token limit, at natural boundaries.

Method: token offsets are prefix sums over the text's pre-tokens; boundaries are a sorted
array per kind (headings, paragraphs, lines, sentences, words).  From the start of a piece
a binary search in the prefix sums finds the last place within the limit, another one the
best kind of boundary in the piece's second half, or where there is none the last boundary
past the piece before; the next piece steps back by the overlap, and where there is no
boundary at all the cut is between words or hard.  Only a text's own arrays are searched, never its tokens one by
one.

Cuts lie between pre-tokens, so a piece's tokens are those of the text, except that white
space at a cut may be grouped differently; each piece is therefore counted again as a text
of its own and, where that exceeds the limit, cut shorter.  A single pre-token beyond the
limit (text without any boundary) is cut at characters, by bisection over its counts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trellisq.llm.bpe import VOCABULARY, Encoder, chunks, encoder

HEADING, PARAGRAPH, LINE, SENTENCE, WORD, HARD, END = "heading", "paragraph", "line", "sentence", "word", "hard", "end"

_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")
_HEADING = re.compile(r"(?:(?<=\n)|(?<=\r))(?=#{1,6}[ \t]|={3,}[^=\r\n]|[^\r\n]+(?:\r\n|\n|\r)(?:={3,}|-{3,})[ \t]*(?:[\r\n]|\Z))")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_SENTENCE = re.compile(r"[.!?\u2026;\u061f\u06d4][\"'\u201d\u2019\u00bb)\]]*\s+|[\u3002\uff01\uff1f\uff1b][\u300d\u300f\u201d\u2019\uff09]*")


@dataclass(frozen=True)
class Limits:
    """Sizes in tokens: the largest piece, the overlap, and how full a piece must be for a better kind of boundary to go before a later one."""

    limit: int = 512
    overlap: int = 64
    fill: float = 0.5

    def __post_init__(self) -> None:
        if self.limit < 8 or not 0 <= self.overlap <= self.limit // 2:
            raise ValueError("limit must be at least 8 and the overlap at most half of it")


def boundaries(text: str) -> list[tuple[str, list[int]]]:
    """Sorted character offsets at which a piece may end, by kind, best kind first."""
    return [
        (HEADING, [m.start() for m in _HEADING.finditer(text)]),
        (PARAGRAPH, [m.end() for m in _PARAGRAPH.finditer(text)]),
        (LINE, [m.end() for m in _LINE.finditer(text)]),
        (SENTENCE, [m.end() for m in _SENTENCE.finditer(text)]),
    ]


class Splitter:
    """Splits single texts; holds the encoder and the limits."""

    def __init__(self, enc: Encoder, limits: Limits) -> None:
        self.enc, self.limits = enc, limits
        #: No piece within the limit has more characters.
        self.most_characters = limits.limit * enc.vocabulary.longest

    def count(self, text: str) -> int:
        """Tokens of a text of its own."""
        if not text:
            return 0
        codes = self.enc.codes([text])[0]  # first: new pre-tokens may come with another array of sizes
        return int(self.enc.sizes[codes].sum())

    def _fit(self, length: int, most: int, count: Callable[[int], int]) -> int:
        """A size in characters, at most ``length``, whose count is within ``most`` and near it.

        Steps in proportion to the counts met; ends at nine tenths of ``most`` or when no
        size between is left.  At least 1: no single character has more than four tokens.
        """
        low, high, size = 0, length + 1, min(length, 3 * most)
        for _ in range(40):
            n = count(size)
            if n <= most:
                low = size
                if size == length or 10 * n >= 9 * most:
                    break
            else:
                high = size
            if high - low <= 1:
                break
            size = min(max(int(size * 0.97 * most / max(n, 1)), low + 1), high - 1)
        return max(low, 1)

    def _longest(self, text: str, start: int, end: int) -> int:
        """An end' <= end such that text[start:end'] is within the limit, at least one character on."""
        return start + self._fit(end - start, self.limits.limit, lambda k: self.count(text[start : start + k]))

    def split(self, text: str, char_ends: np.ndarray, tokens: np.ndarray) -> list[tuple[int, int, int, str]]:
        """(start, end, tokens, cut) of the pieces; char_ends and tokens are prefix sums over the pre-tokens."""
        n, limit, overlap = len(text), self.limits.limit, self.limits.overlap
        kinds = boundaries(text)
        out: list[tuple[int, int, int, str]] = []
        start = 0
        while True:
            first = int(np.searchsorted(char_ends, start, "right"))  # the pre-token that holds start
            base = int(tokens[first - 1]) if first else 0
            last = int(np.searchsorted(tokens, base + limit, "right"))  # pre-tokens up to here fit
            most = int(char_ends[last - 1]) if last else 0
            # what every piece has to pass: the start, and the end of the piece before
            passed = max(start, out[-1][1] if out else 0)
            if most <= passed:
                cut, end = HARD, self._longest(text, start, min(n, start + self.most_characters))
                if end <= passed:  # the overlap alone fills the piece: go on without it
                    start = passed
                    end = self._longest(text, start, min(n, start + self.most_characters))
                if end == n:
                    cut = END
            elif most >= n:
                cut, end = END, n
            else:
                floor_at = int(np.searchsorted(tokens, base + int(limit * self.limits.fill), "left"))
                least = max(passed, int(char_ends[min(floor_at, len(char_ends) - 1)]))
                cut, end = WORD, most
                best = [(kind, at[k - 1]) for kind, at in kinds if (k := bisect_right(at, most)) and at[k - 1] > passed]
                if best:
                    # the best kind in a piece that is full enough, else the last boundary of any kind
                    cut, end = next((x for x in best if x[1] > least), max(best, key=lambda x: x[1]))
            size = self._size(text, start, end, char_ends, tokens)
            if size > limit:
                shorter = self._longest(text, start, end)
                if shorter <= passed:
                    start = passed
                    shorter = self._longest(text, start, end)
                end, cut = shorter, HARD
                size = self.count(text[start:end])
            out.append((start, end, size, END if end == n else cut))
            if end >= n:
                return out
            start = self._step_back(text, start, end, char_ends, tokens) if overlap else end

    def _size(self, text: str, start: int, end: int, char_ends: np.ndarray, tokens: np.ndarray) -> int:
        """Tokens of text[start:end] as a text of its own.

        Pre-tokens are matched from left to right without looking back, so from a pre-token
        on they are those of the whole text up to the last one that is not white space
        (white space is grouped by what follows it); only the rest is counted anew.
        """
        first = int(np.searchsorted(char_ends, start, "left")) if start else -1
        if start and char_ends[first] != start:
            return self.count(text[start:end])
        last = int(np.searchsorted(char_ends, end, "right")) - 1
        while last > first and text[int(char_ends[last - 1]) if last else 0 : int(char_ends[last])].isspace():
            last -= 1
        if last <= first:
            return self.count(text[start:end])
        return int(tokens[last]) - (int(tokens[first]) if start else 0) + self.count(text[int(char_ends[last]) : end])

    def _step_back(self, text: str, start: int, end: int, char_ends: np.ndarray, tokens: np.ndarray) -> int:
        """Where the next piece begins: the first pre-token within the overlap before the end.

        Where a pre-token is longer than the overlap, the step back is made in characters.
        """
        at_end = int(np.searchsorted(char_ends, end, "left"))
        k = int(np.searchsorted(tokens, int(tokens[at_end]) - self.limits.overlap, "left"))
        # a piece within the overlap is not repeated whole
        k = max(k, int(np.searchsorted(char_ends, start, "right")))
        if start < char_ends[k] < end:
            return int(char_ends[k])
        return max(end - self._fit(end - start - 1, self.limits.overlap, lambda k: self.count(text[end - k : end])), start + 1) if end - start > 1 else end


def split_texts(texts: list[str], path: str, limits: Limits) -> Iterator[list[tuple[int, int, int, str]]]:
    """The pieces of each text.  Empty texts have one empty piece, so that no record is lost."""
    enc = encoder(path)
    splitter = Splitter(enc, limits)
    found, flat, counts = enc.find_codes(texts)
    # taken at once: counting pieces may make the encoder's memory start anew, and the codes are of the memory before
    sizes = enc.sizes[flat]
    ends = np.cumsum(counts)
    for text, own, lo, hi in zip(texts, found, ends - counts, ends):
        tokens = np.cumsum(sizes[lo:hi], dtype=np.int64)
        total = int(tokens[-1]) if hi > lo else 0
        if total <= limits.limit:
            yield [(0, len(text), total, END)]
        else:
            yield splitter.split(text, np.cumsum(np.fromiter(map(len, own), np.int64, len(own))), tokens)


def split(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    path: str = VOCABULARY,
) -> DataFrame:
    """<id_col>, piece_no (from 0), start, end (character offsets), n_tokens, cut, piece: every row's pieces in order.

    Pieces lie within the limit, cover the text without a gap, and overlap their forerunner
    by at most the stated number of tokens.  A null text gives no piece; an empty text one
    empty piece; repeated rows are split each.  One pass, no shuffle.
    """
    out = pa.schema([(id_col, pa.int64()), ("piece_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int32()), ("cut", pa.string()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).cast(pa.int64()).to_pylist(), b.column(1).to_pylist()
            kept = [(k, t) for k, t in zip(keys, texts) if t is not None]
            keys, texts = [k for k, _ in kept], [t for _, t in kept]
            for lo, hi in chunks(texts):
                rows = [
                    (k, i, s, e, n, c, t[s:e])
                    for k, t, pieces in zip(keys[lo:hi], texts[lo:hi], split_texts(texts[lo:hi], path, limits))
                    for i, (s, e, n, c) in enumerate(pieces)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out) if rows else pa.RecordBatch.from_pylist([], schema=out)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` long, piece_no int, start long, end long, n_tokens int, cut string, piece string")
