"""Problem 4: text that was decoded with the wrong character encoding.

Method: garbled sequences are computed beforehand for all pairs of encodings and matched
by a multi-pattern automaton; only matched spans are replaced, what stands around them is
left as it is.

* *Characters.*  Every character beyond ASCII, written as UTF-8 and read as one of the
  single-byte encodings, is a sequence of two to four characters.  The automaton of a
  reading holds how all of them begin (two characters, which also tell the length); the
  rest must be continuation bytes of that reading and the whole an assigned character.
  Spans are replaced again and again until none is left, which undoes misreading repeated
  any number of times (every round shortens the text).  Replacement characters and C1
  controls are certain signs without an original.
* *Words.*  Between single-byte encodings, and where bytes were lost, one character stands
  for another and only the word tells.  Each word of the sound texts is garbled through
  every pair of encodings; a word of the corpus that equals such a form is replaced, at the
  place where it stands and nowhere else, where the sound word stands in far more distinct
  texts or rows, or where the form is no plausible word and the sound word is one: its
  letters join as they do in words that are nobody's form.  Words and forms are joined by
  a shuffle, so the vocabulary may grow with the corpus.
* *Signs.*  Words without a known original count as garbled where what they show cannot
  have been written (see :func:`suspicious`).

When a lone match proves nothing: sound text has letters beside letters, letters beside
closing or opening signs, and lines of box drawing.  A sequence of that kind counts only
beside others, and where what they stand for is of one script.

Texts are looked at once each, however often they occur.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.operators.skew import spread_join
from trellisq.session import written

# Encodings by their role in a misreading.
READ_OF_UTF8 = ("cp1252", "latin-1", "iso8859-15", "cp437", "cp850", "mac_roman")
WRITTEN = ("utf-8", "cp1252", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "cp1253", "iso8859-7", "cp1254", "mac_roman", "mac_cyrillic", "mac_greek", "cp437", "cp850", "cp852")
READ = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "cp1253", "iso8859-7", "cp1254", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852")
#: Ranges of the characters that names are mostly made of and misreadings mostly bring in (Latin, Greek, Cyrillic, combining marks, Vietnamese, punctuation): a lone one of these may prove a misreading where one of the rest would not.
REPERTOIRE = ((0x80, 0x17F), (0x192, 0x192), (0x1A0, 0x1B0), (0x218, 0x21B), (0x2C6, 0x2DC), (0x300, 0x328), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x1EA0, 0x1EF9), (0x2010, 0x2027), (0x2030, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2126), (0x2202, 0x2265), (0x2310, 0x2321), (0x2500, 0x25CA), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF))
#: Lead characters that sound text may well have before another of the same kind: one match alone proves nothing.
WEAK_LEADS = "\u2013\u2014\u0152\u0153\u00f0"
#: Closing signs that may follow a capital with a tilde or circumflex in sound text.
CLOSING = "\u2019\u201d\u00bb\u2026\u00a0"
#: Signs that sound text has before, after or between letters.
ORDINARY = "\u2018\u2019\u201a\u201c\u201d\u201e\u2026\u2013\u2014\u2022\u00ab\u00bb\u2039\u203a\u00a0\u00b0\u00b7\u00bf\u00a1"
#: Characters of the shortest form that is looked for as a word; a shorter one fits too many words.
LEAST_FORM = 3
#: Share of its word's characters that a form must have left: one that lost more fits too many words.
LEAST_LEFT = 0.6
_LOST = re.compile("[\ufffd\u0080-\u009f]")
_EDGES = "()[]{}<>,;:/\\-.\"!?\u00ab\u00bb\u2013\u2014\u2026'"
# Signs between two letters that are one letter in another encoding and that nobody
# writes there.  Exponents, the signs of multiplication and of paragraphs are not among them.
_IN_WORD = re.compile("(?<=[^\\W\\d_])[\u221a\u00ac\u2202\u0192\u02d9\u02c6\u00b8\u02dc\u2030\u201e\u201d\ufb02\ufb01\u00f7\u00a5\u00a3\u00a8\u00a9\u00ae\u00b1\u00b9\u00b3\u00bc\u00bd\u00be\u00bf\u00a1\u2248\u2260\u2265\u2264\u2211\u222b\u2500-\u259f](?=[^\\W\\d_])")

#: What is left of a no-break space read as two characters, at the end of a word in small letters.
_TAIL = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]\u00c2\\Z")

#: Symbols read as Cyrillic: rare letters that stand alone or end a number.
_ALONE = re.compile("\\A[\u0402\u0403\u0453\u0409\u040a\u040c\u040b\u040f\u0452\u0459\u045a\u045c\u045b\u045f\u040e\u045e\u0408\u0490\u0405\u0455]\\Z|[0-9][\u0402\u0403\u0453\u0409\u040a\u040c\u040b\u040f\u0452\u0459\u045a\u045c\u045b\u045f\u040e\u045e\u0408\u0490\u0405\u0455\u0406\u0456]\\Z")


def _read(data: bytes, encoding: str, errors: str = "strict") -> str:
    """Decode as readers do: bytes that a Windows code page leaves open become C1 controls."""
    if errors == "strict" and encoding.startswith("cp125"):
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)
    return data.decode(encoding, errors)


_COMMON = frozenset(chr(c) for lo, hi in REPERTOIRE for c in range(lo, hi + 1))
#: First bytes of a UTF-8 sequence: its length, and the least and greatest second byte.
_LEADS = (
    *((b, 2, 0x80, 0xBF) for b in range(0xC2, 0xE0)),
    *((b, 3, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)),
    *((b, 4, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)),
)


@lru_cache(maxsize=None)
def byte_of(reading: str) -> dict[str, int]:
    """The byte that a reader under ``reading`` shows as a character."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[_read(bytes([b]), reading)] = b
        except UnicodeDecodeError:
            continue
    return out


@lru_cache(maxsize=None)
def automaton(reading: str) -> ahocorasick.Automaton:
    """How every character beyond ASCII begins when written as UTF-8 and read as ``reading`` -> length of its sequence."""
    shown = {b: c for c, b in byte_of(reading).items()}
    a = ahocorasick.Automaton()
    for lead, size, least, most in _LEADS:
        for second in range(least, most + 1):
            if lead in shown and second in shown:
                a.add_word(shown[lead] + shown[second], size)
    a.make_automaton()
    return a


def _drawn(c: str) -> bool:
    return "\u2500" <= c <= "\u259f"


#: What a sequence says of its character having been misread; in a row of sequences more than HINT together is proof.
PROOF, HINT, LETTERS = 3, 2, 1


def _weight(g: str, c: str, reading: str) -> int:
    """What the sequence g says of c having been misread: proof, a hint, or little (accented letters, as many a word has two)."""
    if any("\x80" <= x <= "\x9f" for x in g):
        return PROOF
    letters = all(x.isalpha() for x in g)
    if c in _COMMON:
        return PROOF if len(g) > 2 or g[0] not in WEAK_LEADS and (reading in ("cp1252", "latin-1", "iso8859-15") or not letters) else HINT
    if letters:
        return HINT if len(g) > 2 else LETTERS if c.isalpha() else 0
    # a letter before signs, or a sign before letters, as sound text has them
    after, before = all(x in ORDINARY for x in g[1:]), g[0] in ORDINARY and all(x.isalpha() for x in g[1:])
    return HINT if len(g) == 2 or after or before or all(map(_drawn, g)) else PROOF


def _one_script(text: str) -> bool:
    """Whether the letters of a mended span belong to one script, as those of a word do (Japanese and Korean count as one with Chinese).

    Letters that names are mostly made of count only as Latin, Greek or Cyrillic beside letters of the rest.
    """
    if all(x in _COMMON for x in text):
        return True
    scripts = {_script(x) for x in text if x.isalpha()}
    rest = {_script(x) for x in text if x.isalpha() and x not in _COMMON}
    held = {"CJK" if x in ("HIRAGANA", "KATAKANA", "HANGUL") else x for x in rest | (scripts & {"LATIN", "GREEK", "CYRILLIC"})}
    return len(held) <= 1


@lru_cache(maxsize=1 << 16)
def _character(g: str, reading: str) -> tuple[str, int] | None:
    """(the character that the sequence stands for, what it says); None where it is no character."""
    back = byte_of(reading)
    if any(x not in back for x in g):
        return None
    try:
        c = bytes(back[x] for x in g).decode("utf-8")
    except UnicodeDecodeError:
        return None
    if len(c) != 1 or unicodedata.category(c) in ("Cn", "Co", "Cs") or unicodedata.category(c) == "Cc" and len(g) != 2:
        return None
    return c, _weight(g, c, reading)


def _spans(text: str, reading: str) -> list[tuple[int, int, str]]:
    """Matched spans (start, end, original) of one reading from left to right, without overlap."""
    places: dict[int, tuple[int, str, int]] = {}
    for end, size in automaton(reading).iter(text):
        start = end - 1
        if start + size <= len(text) and (got := _character(text[start : start + size], reading)):
            places[start] = (size, *got)
    out: list[tuple[int, int, str]] = []
    i = 0
    for start in sorted(places):
        if start < i:
            continue
        i = start
        parts, said = [], 0
        while i in places:
            size, c, weight = places[i]
            before, after = text[max(0, i - 1) : i], text[i + size : i + size + 1]
            if weight == PROOF and size == 2 and text[i + 1] in CLOSING and not after.isalpha() and before.isupper():
                weight = HINT
            if weight == PROOF and all(map(_drawn, text[i : i + size])) and any(map(_drawn, before + after)):
                weight = HINT  # part of a drawing
            said += weight
            parts.append(c)
            i += size
        if said > HINT and _one_script("".join(parts)):
            out.append((start, i, "".join(parts)))
    return out


def mend(text: str) -> tuple[str, bool]:
    """(text with every matched span replaced, whether there was one), for repeated misreading again and again."""
    hit = False
    while True:
        # the reading that explains most of the text goes first; another part may have another one
        spans = max((_spans(text, r) for r in READ_OF_UTF8), key=lambda x: sum(e - s for s, e, _ in x))
        if not spans:
            return text, hit
        hit = True
        text = replaced(text, spans)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with the spans (ascending, apart) replaced and everything else as it was."""
    out, last = [], 0
    for s, e, c in spans:
        out += [text[last:s], c]
        last = e
    return "".join(out) + text[last:]


def tokens(text: str) -> list[str]:
    """The words with characters beyond ASCII, in composed form, without punctuation at their ends."""
    return [w for w in (unicodedata.normalize("NFC", x.strip(_EDGES)) for x in text.split()) if w and not w.isascii()]


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def _mixed(run: str) -> bool:
    """Letters of two scripts in one word; a Greek letter as its first one is a symbol there."""
    scripts = [x for x in map(_script, run) if x in ("LATIN", "GREEK", "CYRILLIC")]
    if len(scripts) > 1 and scripts[0] == "GREEK" and "GREEK" not in scripts[1:]:
        scripts = scripts[1:]
    return len(set(scripts)) > 1


def _listed(run: str) -> bool:
    """Accented capital vowels only: a list of letters or an abbreviation, as no word in capitals has four of them in a row."""
    return run.isupper() and all(unicodedata.normalize("NFD", c)[0] in "AEIOUY" for c in run)


def suspicious(word: str) -> bool:
    """Signs of misreading in a word whose original is not known.

    What no language writes: letters of two scripts in one word; four or more letters that
    are all accented (a word of another script read as Latin); between two letters a sign
    that is a letter elsewhere; a no-break space's first byte at the end of a word in small
    letters; a lone rare Cyrillic letter, as symbols become.
    """
    for run in re.findall(r"[^\W\d_]+", word):
        if _mixed(run):
            return True
        if len(run) >= 4 and all("\u00c0" <= c <= "\u00ff" for c in run) and not _listed(run):
            return True
    return bool(_IN_WORD.search(word) or _TAIL.search(word) or _ALONE.search(word))


def joints(word: str) -> list[str]:
    """The pairs of adjoining letters, one of them beyond ASCII (^ and $ are the ends); "*" for a sign of misreading or a symbol beside a letter."""
    out = {p for run in re.findall(r"[^\W\d_]+", word.lower()) for p in map("".join, zip("^" + run, run + "$")) if not p.isascii()}
    beside = any(unicodedata.category(a) in ("Sk", "Sm", "Sc", "So", "No") and b.isalpha() for a, b in (*zip(word, word[1:]), *zip(word[1:], word)))
    inside = any(not b.isascii() and unicodedata.category(b)[0] in "PSCZ" and b not in "\u00b7\u2019\u2010\u2011\u2013\u2014\u2026" and a.isalpha() and c.isalpha() for a, b, c in zip(word, word[1:], word[2:]))
    return sorted(out) + ["*"] * (beside or inside or suspicious(word))


def _shown(word: str) -> Iterator[str]:
    """What the word looks like after one misreading, through every pair of encodings, with lost bytes left out."""
    for w in WRITTEN:
        try:
            data = word.encode(w)
        except UnicodeEncodeError:
            continue
        for r in READ:
            if r == w:
                continue
            for errors in ("strict", "ignore"):
                try:
                    g = _read(data, r, errors)
                except UnicodeDecodeError:
                    continue
                for form in (g, _LOST.sub("", g)):
                    yield unicodedata.normalize("NFC", form.replace("\u00a0", " ").strip())


def garbled_forms(word: str) -> set[str]:
    """The forms of a word as :func:`tokens` shows them, without those that would fit too many words."""
    out = {f.strip(_EDGES) for f in _shown(word)}
    return {f for f in out if len(f) >= max(LEAST_FORM, LEAST_LEFT * len(word)) and not f.isascii() and f != word}


@lru_cache(maxsize=1 << 14)
def _whole_forms(word: str) -> frozenset[str]:
    """The forms of a word with the signs at their ends, which may be its own first or last letter."""
    return frozenset(_shown(word))


def put_back(text: str, changes: dict[str, str | None]) -> str:
    """The text with the words that have an original replaced where they stand as words of their own.

    Words are compared in composed form; a sign at a word's end goes with it where it is
    one of the word's own letters, misread.
    """
    spans = []
    for m in re.finditer(r"\S+", text):
        raw = m[0]
        core = raw.strip(_EDGES)
        original = changes.get(unicodedata.normalize("NFC", core)) if core else None
        if not original:
            continue
        left = len(raw) - len(raw.lstrip(_EDGES))
        right = left + len(core)
        wide = ((a, b) for a in range(left + 1) for b in range(len(raw), right - 1, -1) if (a, b) != (left, right))
        a, b = next(((a, b) for a, b in wide if unicodedata.normalize("NFC", raw[a:b]) in _whole_forms(original)), (left, right))
        spans.append((m.start() + a, m.start() + b, original))
    return replaced(text, spans)


def _scan(texts: DataFrame) -> DataFrame:
    """text, n -> text, n, mended, hit, lost, words."""
    schema = "text string, n long, mended string, hit boolean, lost boolean, words array<string>"
    out = pa.schema([("text", pa.string()), ("n", pa.int64()), ("mended", pa.string()), ("hit", pa.bool_()), ("lost", pa.bool_()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            got = [(t, False) if t.isascii() else mend(t) for t in texts]
            lost = [bool(_LOST.search(m)) for m, _ in got]
            # words next to lost characters are no evidence and have no original
            words = [tokens(m) for m, _ in got]
            columns = [b.column(0), b.column(1), [m for m, _ in got], [h for _, h in got], lost, words]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return texts.select("text", F.col("n").cast("long")).mapInArrow(run, schema)


def _forms(vocabulary: DataFrame) -> DataFrame:
    """word, support, support_texts -> garbled, word, support, support_texts."""
    out = pa.schema([("garbled", pa.string()), ("word", pa.string()), ("support", pa.int64()), ("support_texts", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(g, v, n, k) for w, n, k in zip(*(c.to_pylist() for c in b.columns)) for v in {w, w.upper()} for g in garbled_forms(v)}
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out) if rows else pa.RecordBatch.from_pylist([], schema=out)

    return vocabulary.select("word", F.col("support").cast("long"), F.col("support_texts").cast("long")).mapInArrow(run, "garbled string, word string, support long, support_texts long")


def _signs(words: DataFrame) -> DataFrame:
    """Adds ``odd``: the word shows signs of misreading."""
    odd = F.pandas_udf(lambda s: s.map(suspicious), "boolean")
    return words.withColumn("odd", odd("word"))


def _plausible(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, plausible of the words and originals of the pairs: whether they have joints and all of them stand in sound words outside the pairs."""
    joined = F.pandas_udf(lambda s: s.map(joints), "array<string>")
    evidence = F.pandas_udf(lambda s: s.map(lambda w: [] if "*" in (j := joints(w)) else j), "array<string>")
    sides = pairs.select("word").union(pairs.select("original")).distinct()
    alone = known.where("sound > 0").join(sides, "word", "left_anti")
    held = alone.select(F.explode(evidence("word")).alias("joint")).distinct().withColumn("held", F.lit(True))
    each = sides.withColumn("joints", joined("word")).select("word", F.explode_outer("joints").alias("joint")).join(held, "joint", "left")
    return each.groupBy("word").agg(F.bool_and(F.col("held").isNotNull()).alias("plausible"))


def mend_texts(texts: DataFrame, ratio: float = 4.0) -> DataFrame:
    """text, n, restored, recovered of the garbled ones among the rows (text, n): n counts the text's occurrences.

    ``restored`` has the matched spans and words replaced, and nothing else; ``recovered``
    is true where that changed the text, nothing was lost and no sign of misreading is left.
    ``ratio`` is how much more
    frequent, case aside, a sound word must be than a form that it may replace, in
    distinct texts, or in rows where texts do not say the opposite.  Where one of the two
    alone is a plausible word that decides, whatever the counts.
    """
    scanned = written(_scan(texts))
    fold = F.lower("word")
    uses = scanned.select("n", "hit", "lost", F.explode(F.array_distinct("words")).alias("word"))
    sound = ~F.col("hit") & ~F.col("lost")
    each = uses.groupBy("word").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.when(sound, F.col("n")).otherwise(0)).alias("sound"),
        F.count_if(sound).alias("sound_texts"),
    )
    support = each.groupBy(fold.alias("fold")).agg(F.sum("sound").alias("support"), F.sum("n").alias("uses"), F.sum("sound_texts").alias("support_texts"), F.sum("texts").alias("uses_texts"))
    known = written(each.withColumn("fold", fold).join(support, "fold"))
    forms = _forms(known.where("support > 0").select("word", "support", "support_texts")).select("garbled", F.col("word").alias("original"), F.col("support").alias("strength"), F.col("support_texts").alias("strength_texts"))
    pairs = written(known.join(forms, F.col("word") == F.col("garbled")).select("word", "uses", "uses_texts", "original", "strength", "strength_texts"))
    plausible = written(_plausible(known, pairs))
    judged = pairs.join(plausible, "word").join(plausible.select(F.col("word").alias("original"), F.col("plausible").alias("original_plausible")), "original")
    better, worse = ~F.col("plausible") & F.col("original_plausible"), F.col("plausible") & ~F.col("original_plausible")
    by_texts, against = F.col("strength_texts") >= F.col("uses_texts") * ratio, F.col("uses_texts") >= F.col("strength_texts") * ratio
    best = (
        judged.where(better | ~worse & (by_texts | (F.col("strength") >= F.col("uses") * ratio) & ~against))
        .groupBy("word")
        .agg(F.max(F.struct(better.alias("better"), "strength", "original"))["original"].alias("original"))
    )
    marked = written(_signs(known.select("word", "uses")).join(best, "word", "left").where("original is not null or odd").select("word", "original"))
    words = (
        scanned.select("text", F.explode(F.array_distinct("words")).alias("word"))
        .join(marked, "word")
        .groupBy("text")
        .agg(F.collect_list(F.struct("word", "original")).alias("changes"))  # at most the words of one text
    )
    return _restored(scanned.join(words, "text", "left").where(F.col("hit") | F.col("lost") | F.col("changes").isNotNull()))


def _restored(marked: DataFrame) -> DataFrame:
    """text, n, mended, hit, lost, changes -> text, n, restored, recovered."""
    out = pa.schema([("text", pa.string()), ("n", pa.int64()), ("restored", pa.string()), ("recovered", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, mended, lost, changes = (b.column(k).to_pylist() for k in (0, 2, 3, 4))
            restored, good = [], []
            for t, m, gone, c in zip(texts, mended, lost, changes):
                x = put_back(m, {w["word"]: w["original"] for w in c}) if c else m
                restored.append(x)
                good.append(x != t and not gone and not any(map(suspicious, tokens(x))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(restored, pa.string()), pa.array(good, pa.bool_())], schema=out)

    return marked.select("text", "n", "mended", "lost", "changes").mapInArrow(run, "text string, n long, restored string, recovered boolean")


def garbled(rows: DataFrame) -> DataFrame:
    """table_name, row_no, text, restored, recovered of the garbled rows of (table_name, row_no, text).

    Null and empty texts are sound; repeated rows count each.  Texts are counted before
    they are shuffled; on the way back to the rows texts that very many rows have, by that
    count, are joined in parts.
    """
    held = rows.where("text <> ''")
    found = written(mend_texts(held.groupBy("text").agg(F.count(F.lit(1)).alias("n"))))
    return spread_join(held, found, ["text"], "n", F.col("row_no")).select("table_name", "row_no", "text", "restored", "recovered")


def _columns(tables: dict[str, DataFrame], fields: dict[str, str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (tables[t].select(F.lit(t).alias("table_name"), F.col("row_no").cast("long").alias("row_no"), F.col(c).alias("text")) for t, c in fields.items()))


def garbled_names(tables: dict[str, DataFrame]) -> DataFrame:
    """The garbled stop names and sign texts."""
    return garbled(_columns(tables, {"stops": "stop_name", "pathways": "signposted_as"}))
