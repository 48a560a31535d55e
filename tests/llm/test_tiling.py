import random

import numpy as np
import pytest

from trellisq.llm import tiling
from trellisq.llm.tiling import Index, Tile, aligned, chained, leaks, tiles, words

VOC = [f"w{i}" for i in range(400)]


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return prev[-1]


def brute(item, doc, least=25):
    """Some run of item words against some run of document words within an eighth of edits."""
    for i in range(len(item)):
        for k in range(i + least, len(item) + 1):
            want, room = item[i:k], (k - i) // 8
            for j in range(len(doc)):
                for n in range(max(1, len(want) - room), len(want) + room + 1):
                    if edit_distance(want, doc[j : j + n]) <= room:
                        return True
    return False


def test_words():
    assert words("L'Àliga <b>DE</b> l’Été, nº5 &amp; straße­!") == ["l", "aliga", "de", "l", "ete", "no5", "strasse"]
    assert words("Łąkowa øre") == ["lakowa", "ore"]
    assert words("") == [] and words("<|x|> a_b") == ["x", "a", "b"]


def planted(rng, m, edits, noise=12):
    item = [rng.choice(VOC) for _ in range(34)]
    part = item[2 : 2 + m]
    for _ in range(edits):
        k = rng.randrange(1, len(part) - 1)
        kind = rng.choice("cdi")
        if kind == "c":
            part[k] = "changed"
        elif kind == "d":
            del part[k]
        else:
            part.insert(k, "added")
    fill = lambda: [rng.choice(VOC) for _ in range(noise)]
    return item, fill() + part + fill()


def test_judgement_equals_brute_force():
    rng = random.Random(5)
    for k in range(24):
        item, doc = planted(rng, rng.choice([18, 23, 25, 28, 30]), rng.choice([0, 1, 2, 3, 4, 5]))
        want = brute(item, doc)
        got = [yes for _, _, _, yes in Index([item]).search([" ".join(doc)])]
        assert bool(got and got[0]) == want, (k, item, doc)
        a = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
        assert aligned(np.array([a[w] for w in item]), np.array([a.get(w, 0) for w in doc])) == want


def test_tiles_do_not_overlap_and_are_greedy():
    item = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])
    doc = np.array([7, 8, 9, 10, 11, 12, 0, 1, 2, 3, 4, 5, 6, 7, 0, 0])
    got = tiles(item, doc, [(6, 0), (0, 7)])
    assert [(t.item, t.doc, t.size) for t in got] == [(0, 7, 7), (7, 1, 5)]
    assert tiles(item, doc, []) == []
    assert not chained(got, 12)
    assert chained([Tile(0, 5, 20), Tile(21, 26, 9)], 30)


def test_reordered_passage_is_covered_but_no_stretch():
    rng = random.Random(1)
    item = rng.sample(VOC, 48)
    doc = item[24:36] + item[0:12] + item[36:48] + item[12:24]
    ((_, _, share, yes),) = Index([item]).search([" ".join(doc)])
    assert share == 1.0 and not yes


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_table(spark, block_words):
    rng = random.Random(7)
    items = [[rng.choice(VOC) for _ in range(40)] for _ in range(6)]
    rows = [(1, " ".join(items[0]), "q"), (2, " ".join(items[1]), "q"), (3, " ".join(items[0]).upper(), "q"), (4, None, "q"), (5, "", "q"), (6, "too short", "q")]
    docs = [(100, "x " + ", ".join(items[0]) + " y"), (101, " ".join(items[1][5:35])), (101, " ".join(items[1][5:35])), (102, None), (103, ""), (104, " ".join(items[5])), (105, "z " * 50_000 + "\n".join(items[1]))]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, passage string, doc_id string").drop("doc_id"), block_words=block_words)
    found = sorted((r.item_id, r.doc_id) for r in got.where("stretch").collect())
    assert found == [(1, 100), (2, 101), (2, 101), (2, 105), (3, 100)]
    empty = spark.createDataFrame([], "item_id long, passage string")
    assert leaks(spark.createDataFrame(docs, "doc_id long, text string"), empty).count() == 0


@pytest.mark.parametrize("every", [8, 9])
def test_edited_copy_beside_a_reordered_one(every):
    rng = random.Random(every)
    item = rng.sample(VOC, 48)
    reordered = item[33:] + ["x"] * 9 + item[17:33] + ["y"] * 9 + item[:17]
    copy = [f"changed{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
    for doc in (reordered + ["z"] * 400 + copy, copy + ["z"] * 400 + reordered):
        ((_, _, _, yes),) = Index([item]).search([" ".join(doc)])
        assert yes
    ((_, _, _, yes),) = Index([item]).search([" ".join(reordered + ["z"] * 400 + item[33:])])
    assert not yes


def test_windows_lose_no_stretch():
    rng = random.Random(11)
    for k in range(12):
        item, part = planted(rng, rng.choice([25, 30]), rng.choice([3, 4]), 2)
        doc = item[20:] + [rng.choice(VOC) for _ in range(40)] + part + [rng.choice(VOC) for _ in range(3)] + item[:20]
        got = [yes for _, _, _, yes in Index([item]).search([" ".join(doc)])]
        assert bool(got and got[0]) == brute(item, doc), (k, item, doc)


def aligned_in_full(item, doc):
    """The alignment with all edits a passage of its length may have: L[e][j] as in the operator, word by word."""
    most, low = len(item) // 8, -(10**6)
    prev = [[low] * (len(doc) + 1) for _ in range(most + 1)]
    for w in item:
        cur = [[low] * (len(doc) + 1) for _ in range(most + 1)]
        for e in range(most + 1):
            for j in range(len(doc) + 1):
                best = low
                if j and doc[j - 1] == w:
                    best = max(prev[e][j - 1] + 1, 1 if e == 0 else low)
                elif j and e:
                    best = max(prev[e - 1][j - 1] + 1, 1 if e == 1 else low)
                if e:
                    best = max(best, prev[e - 1][j] + 1, cur[e - 1][j - 1] if j else low)
                cur[e][j] = best
                if best >= max(25, 8 * e):
                    return True
        prev = cur
    return False


@pytest.mark.parametrize("m", [34, 40, 48])
def test_words_that_stand_elsewhere_in_longer_pieces(m):
    rng = random.Random(m)
    item = rng.sample(VOC, m)
    copy = item[3:30]
    for k in (4, 12, 20):
        copy[k] = f"other{k}"
    far = lambda: [rng.choice(VOC[350:]) + "x" for _ in range(200)]
    for doc in (item[:17] + far() + item[17:] + far() + copy, copy + far() + item[17:] + far() + item[:17]):
        assert aligned_in_full(item, doc)
        ((_, _, _, yes),) = Index([item]).search([" ".join(doc)])
        assert yes


def test_documents_with_several_partial_copies():
    rng = random.Random(21)
    seen = {True: 0, False: 0}
    for _ in range(60):
        m = rng.choice([30, 40, 64, 120])
        item = [rng.choice(VOC) for _ in range(m)]
        doc = []
        for _ in range(rng.randint(2, 5)):
            a = rng.randrange(m - 8)
            part = item[a : a + rng.choice([8, 14, 22, 27, 40, 60])]
            for _ in range(rng.choice([0, len(part) // 9, len(part) // 7])):
                k = rng.randrange(len(part))
                part[k : k + rng.choice([0, 1, 1])] = rng.choice([["new"], []])
            doc += part + [rng.choice(VOC) for _ in range(rng.choice([0, 3, 40]))]
        want = aligned_in_full(item, doc)
        seen[want] += 1
        got = [yes for _, _, _, yes in Index([item]).search([" ".join(doc)])]
        assert bool(got and got[0]) == want, (item, doc)
    assert min(seen.values()) > 5


def test_long_tags_are_markup():
    rng = random.Random(2)
    item = rng.sample(VOC, 30)
    tag = '<a href="' + "/".join(["part"] * 80) + '">'
    doc = " ".join(item[:9]) + tag + " ".join(item[9:17]) + tag + " ".join(item[17:24]) + tag + " ".join(item[24:])
    ((_, _, share, yes),) = Index([item]).search([doc])
    assert share == 1.0 and yes
    assert words("<" + "a" * 100_000) == ["a" * 100_000]


def test_many_seeds_are_met_in_parts(monkeypatch):
    rng = random.Random(8)
    items = [[rng.choice(VOC) for _ in range(40)] for _ in range(9)]
    docs = [" ".join(items[k % 9] * 3 + items[(k * 5 + 1) % 9][:20]) for k in range(12)]
    whole = sorted(Index(items).search(docs))
    monkeypatch.setattr(tiling, "MOST_SEEDS", 40)
    assert sorted(Index(items).search(docs)) == whole and len(whole) >= 12


def test_known_words_without_a_seed(monkeypatch):
    item = VOC[:40]
    index = Index([item, VOC[40:80]])
    mixed = " ".join(item[::-1])
    assert list(index.search([mixed])) == []
    assert list(index.search([mixed, "", " ".join(item)])) == [(2, 0, 1.0, True)]
    monkeypatch.setattr(tiling, "MOST_SEEDS", 1)
    # one half of the passages has no seed in the texts
    assert list(index.search([mixed, " ".join(item)])) == [(1, 0, 1.0, True)]


def test_batches_without_a_seed(spark):
    item = VOC[:40]
    docs = spark.createDataFrame([(k, " ".join(item if k == 7 else item[::-1])) for k in range(10)], "doc_id long, text string").repartition(10, "doc_id")
    got = leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, passage string"))
    assert [(r.item_id, r.doc_id, r.verdict) for r in got.collect()] == [(1, 7, "stretch")]


def test_verdicts(spark):
    rng = random.Random(3)
    item = rng.sample(VOC, 48)
    docs = [(1, " ".join(item)), (2, " ".join(item[24:36] + item[:12] + item[36:] + item[12:24])), (3, " ".join(item[:12]))]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, passage string"))
    assert sorted((r.doc_id, r.verdict) for r in got.collect()) == [(1, "stretch"), (2, "reordered"), (3, "partial")]
