import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trellisq.llm import bpe
from trellisq.llm.splitting import Limits, Splitter, boundaries, split, split_texts


def pieces(text, limits):
    return next(iter(split_texts([text], bpe.VOCABULARY, limits)))


def check(text, limits):
    got = pieces(text, limits)
    sp = Splitter(bpe.encoder(), limits)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for start, end, n, cut in got:
        assert n == sp.count(text[start:end]) <= limits.limit
        assert end > start or not text
    for a, b in zip(got, got[1:]):
        assert a[0] < b[0] <= a[1] < b[1]
        assert sp.count(text[b[0] : a[1]]) <= limits.overlap + 1
    whole = text[: got[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(got, got[1:]))
    assert whole == text
    return got


SMALL = Limits(limit=24, overlap=6)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .,\n\té字#!?=- \U0001f600")), max_size=400))
def test_any_text(text):
    check(text, SMALL)


@pytest.mark.parametrize("text", ["a" * 3000, "字" * 900, "\n" * 500, " " * 900, "word " * 500, "\U0001f600" * 300, "." * 900, "a\r\n" * 300, ""])
def test_texts_without_boundaries(text):
    check(text, SMALL)
    check(text, Limits(limit=24, overlap=0))


def test_best_boundary_is_taken():
    text = "One two three four. Five six.\nSeven eight nine ten eleven.\n\nTwelve thirteen fourteen fifteen sixteen seventeen eighteen.\nNineteen twenty."
    got = check(text, SMALL)
    assert got[0][3] == "paragraph" and text[: got[0][1]].endswith("eleven.\n\n")
    text = "Alpha beta gamma delta epsilon zeta.\n## Next part\nMore words follow here and here and here and again here."
    got = check(text, Limits(limit=20, overlap=4))
    assert got[0][3] == "heading" and text[got[0][1] :].startswith("## Next")


@pytest.mark.parametrize("kind, first", [("paragraph", "Part one\n\n"), ("line", "Part one\n"), ("sentence", "Part one. "), ("heading", "Part one\n# ")])
def test_boundary_in_the_first_half_is_taken(kind, first):
    text = first + "word " * 60
    got = check(text, SMALL)
    assert got[0][3] == kind and text[: got[0][1]] == first.removesuffix("# ")
    assert {x[3] for x in got[1:-1]} == {"word"}
    # not a whole piece again, and from a word's start
    assert all(text[x[0] - 1 : x[0] + 1].strip() != text[x[0] - 1 : x[0] + 1] or not text[x[0] - 1].isalnum() for x in got[1:])


def test_last_boundary_of_any_kind_in_the_first_half():
    text = "# A\n\nOne two. Three four. " + "word " * 60
    got = check(text, SMALL)
    assert got[0][3] == "sentence" and text[: got[0][1]] == "# A\n\nOne two. Three four. "


def test_boundaries_are_sorted():
    for kind, at in boundaries("A. B!\n\nTitle\n=====\nC? d。e\r\n# x\n"):
        assert at == sorted(at), kind


def test_limits_are_checked():
    with pytest.raises(ValueError):
        Limits(limit=4)
    with pytest.raises(ValueError):
        Limits(limit=20, overlap=15)


def test_table(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "short", 9), (3, "short", 9), (4, "line of words here\n" * 400, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = split(df, limits=Limits(limit=64, overlap=8)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert 1 not in by and [r.piece for r in by[2]] == [""] and [r.piece for r in by[3]] == ["short", "short"]
    long = sorted(by[4], key=lambda r: r.piece_no)
    assert [r.piece_no for r in long] == list(range(len(long))) and all(r.n_tokens <= 64 and r.piece == rows[4][1][r.start : r.end] for r in long)
    assert split(df.limit(0)).count() == 0


def test_headings_of_any_length():
    title = "word " * 60
    (kind, at), *_ = boundaries(f"intro\n{title.strip()}\n=====\nbody")
    assert kind == "heading" and at == [6]


def test_unbroken_text_is_cut_at_any_length():
    # one pre-token, its tokens as long as the vocabulary has them
    text = " " * 200_000 + "x"
    got = pieces(text, Limits(16, 0))
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] >= b[0] for a, b in zip(got, got[1:])) and all(n <= 16 for _, _, n, _ in got)


def test_memory_starts_anew_while_pieces_are_counted(monkeypatch):
    # more pre-tokens than a new memory has room for, and sentence ends within pre-tokens, after which pieces are counted
    texts = [" ".join(f"Stop {k * 6000 + i} is open." for i in range(6000)) for k in range(4)]
    want = [pieces(t, SMALL) for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    bpe.encoder.cache_clear()
    try:
        assert list(split_texts(texts, bpe.VOCABULARY, SMALL)) == want
    finally:
        bpe.encoder.cache_clear()
