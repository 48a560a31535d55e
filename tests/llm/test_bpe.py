import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trellisq.llm import bpe

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    ids, sizes = bpe.Encoder().encode(texts)
    out, at = [], 0
    for n in sizes:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


TEXTS = [
    "",
    " ",
    "\n\n\n",
    "Hello world",
    "don't 'S 'll we've",
    "<|endoftext|> <|startoftext|>",
    "naïve café — déjà vu …",
    "\U0001f600 中文字 Русский",
    "a" * 5000,
    "字" * 3000,
    "x=1;  y\t=\r\n 22  　 z",
    "\x00\x1c\x1f᠎﻿",
    "1.67801 E.567252 23:59:30",
    "-" * 500 + " " * 500 + "b",
]


def test_equals_reference(reference):
    assert encode(TEXTS) == [reference.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(reference, text):
    (got,) = encode([text])
    assert got == reference.encode_ordinary(text)
    assert bpe.encoder().decode(got) == text


def naive(v, raw):
    """The lowest rank first, its first place first, pair by pair."""
    ids = [v.single[x] for x in raw]
    while True:
        ranks = [v.merge(a, b) for a, b in zip(ids, ids[1:])]
        live = [r for r in ranks if r >= 0]
        if not live:
            return ids
        k = ranks.index(min(live))
        ids[k : k + 2] = [ranks[k]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \néthein", max_size=60), max_size=5))
def test_occurrence_index_against_naive_merging(texts):
    v = bpe.vocabulary(bpe.VOCABULARY)
    raw = [t.encode() for t in texts]
    assert [x.tolist() for x in v.encode_pieces(raw)] == [naive(v, r) for r in raw]


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    e = bpe.Encoder()
    first = [e.encode([f"word{i} other"])[0].tolist() for i in range(20)]
    assert first == [encode([f"word{i} other"])[0] for i in range(20)]


def test_table(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "a b", "c"), (3, "a b", "c"), (None, "x", "c"), (4, "z" * 100_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(df).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.ids)
    assert by[1] == [[]] and by[2] == [[]] and by[3] == [encode(["a b"])[0]] * 2 and by[None] == [encode(["x"])[0]]
    assert bpe.encode(df.limit(0)).count() == 0


def test_chunks_cover():
    texts = ["a" * n for n in (5, 0, 7, 30, 1, 1)]
    got = list(bpe.chunks(texts, 10))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(6))
    assert list(bpe.chunks([], 10)) == []
