import pytest

from trellisq.llm import mojibake as M

SOUND = ["Cuesta de la Alegría", "CORAÇÃO DA SERRA", "AÇÃO & MÃOS", "Pavelló ©entral", "Rampa 5 € 10", "Nº 7 – Cocheras", "« La Verrière »", "Depósito 3½", "İncirli Çeşme", "Til·lers", "Площадь Липовая", "Πύλη Λεύκας", "Café ™ Corner", "Sector ±0", "“MAÇÃ”", "plain ascii", "", "Monteé", "Øreby Ånger"]


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_is_left_alone(text):
    assert M.mend(text) == (text, False)
    assert not any(M.suspicious(w) for w in M.tokens(text))


@pytest.mark.parametrize("text", [t for t in SOUND if not t.isascii() and t != "“MAÇÃ”"])
@pytest.mark.parametrize("reading", ["cp1252", "latin-1"])
@pytest.mark.parametrize("times", [1, 2])
def test_round_trip(text, reading, times):
    bad = text
    for _ in range(times):
        bad = M._read(bad.encode("utf-8"), reading)
    assert M.mend(bad) == (text, True)


@pytest.mark.parametrize("reading", ["cp437", "cp850", "mac_roman", "iso8859-15"])
def test_other_readings(reading):
    text = "Plaça del Carbó – Липовая"
    assert M.mend(text.encode().decode(reading)) == (text, True)


def test_only_matched_spans_change():
    assert M.mend("cÃ´té – ok") == ("côté – ok", True)


def test_signs():
    for bad in ("NussschlцЯchen", "Ïåðåóëîê", "Kˆhlergasse", "LanternÂ", "Ђ", "3Ѕ"):
        assert M.suspicious(bad)
    assert not M.suspicious("3½") and not M.suspicious("Til·lers") and not M.suspicious("і") and not M.suspicious("Ёлка")


def test_table(spark):
    sound = ["Plac Dębowa", "Ulica Dębowa", "Torre del Carbó", "Липовая"] * 20
    bad = {"Plac Dêbowa": "Plac Dębowa", "Torre del CarbÃ³": "Torre del Carbó", "Ëèïîâàÿ": "Липовая", "Cam�": None}
    rows = [("t", i, t) for i, t in enumerate([*sound, None, "", *bad, *bad])]
    got = M.garbled(spark.createDataFrame(rows, "table_name string, row_no long, text string")).collect()
    assert sorted((r.row_no, r.text) for r in got) == sorted((n, t) for _, n, t in rows if t in bad)
    for r in got:
        assert r.recovered == (bad[r.text] is not None)
        if r.recovered:
            assert r.restored == bad[r.text]
    assert M.garbled(spark.createDataFrame([], "table_name string, row_no long, text string")).count() == 0


@pytest.mark.parametrize("times", [1, 5, 400])
def test_garbled_name_more_frequent_than_its_original(spark, times):
    sound = ["Plac Dębowa", "Rondo Żurawia", "Kłęby", "Dęby", "Stare Żuki", "Tête d'Or", "Pêche", "Gödöllő"]
    bad = {"Plac Dêbowa": "Plac Dębowa", "Rondo ¯urawia": "Rondo Żurawia"}
    rows = [("t", i, t) for i, t in enumerate([*sound, *sound, *list(bad) * times])]
    got = M.garbled(spark.createDataFrame(rows, "table_name string, row_no long, text string")).collect()
    assert sorted(r.row_no for r in got) == [n for _, n, t in rows if t in bad]
    assert all(r.recovered and r.restored == bad[r.text] for r in got)


def test_repeated_garbled_name_against_distinct_texts(spark):
    # no other word tells which letters join: the distinct texts do
    sound = [f"{x} Dębowa" for x in ("Plac", "Ulica", "Rondo", "Brama")]
    rows = [("t", i, t) for i, t in enumerate([*sound, *["Plac Dêbowa"] * 50])]
    got = M.garbled(spark.createDataFrame(rows, "table_name string, row_no long, text string")).collect()
    assert sorted(r.row_no for r in got) == list(range(4, 54)) and {r.restored for r in got} == {"Plac Dębowa"}


def test_rare_joint_is_no_proof_against_a_symbol_inside(spark):
    # the joint of the sound word stands nowhere else; the form has a quotation mark in place of its letter
    sound = ["Rua do Balão", "Praça do Balão", "Ponte do Balão", "Largo do Balão", "Saída"] * 5
    rows = [("t", i, t) for i, t in enumerate([*sound, "Largo do Bal„o"])]
    got = M.garbled(spark.createDataFrame(rows, "table_name string, row_no long, text string")).collect()
    assert [(r.row_no, r.restored) for r in got] == [(25, "Largo do Balão")]


SCRIPTS = ["محطة القطار", "תחנה מרכזית", "東京駅", "서울역", "สถานีกลาง", "სადგური", "Πύλη ᾿Αθηνᾶ", "🚉 Stop 🚇", "Կայարան", "स्टेशन", "አዲስ አበባ"]


@pytest.mark.parametrize("text", SCRIPTS)
@pytest.mark.parametrize("reading", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
def test_every_script_comes_back(text, reading):
    bad = M._read(text.encode("utf-8"), reading)
    assert M.mend(bad) == (text, True)
    assert M.mend(f"Sala 3 – {bad} (norte)") == (f"Sala 3 – {text} (norte)", True)


@pytest.mark.parametrize("word", ["Ïåðåóëîê", "ÏÅÐÅÓËÎÊ", "Ëåýêáò", "Ðëáôåßá", "Ñòàíöèÿ"])
def test_words_of_another_script_are_no_sequences(word):
    assert M.mend(word) == (word, False) and M.suspicious(word)


def test_a_lone_drawn_pair_is_a_misread_sign():
    assert M.mend("Nusstor ┬╖ 6") == ("Nusstor · 6", True) and M.mend("──┬──┐ └─┬─┘") == ("──┬──┐ └─┬─┘", False)


@pytest.mark.parametrize("text", ["Πύλη Λεύκας", "Выход Мост Мельничная", "Переулок"])
@pytest.mark.parametrize("times", [2, 3])
def test_other_scripts_misread_again(text, times):
    bad = text
    for _ in range(times):
        bad = M._read(bad.encode("utf-8"), "latin-1")
    assert M.mend(bad) == (text, True)


@pytest.mark.parametrize("times", [3, 10, 14])
def test_misread_many_times(times):
    bad = "ë"
    for _ in range(times):
        bad = M._read(bad.encode("utf-8"), "cp1252")
    assert M.mend(f"Zoë {bad}") == ("Zoë ë", True)


MORE_SOUND = [
    "Cañón×Río", "ab²cd", "βeta", "ÀÉÈÙ", "l’été « ça va »", "« c’est terminé…»", "voilà « ceci »", "„Ärger“ – „Öl“", "“Évora”", "¿Qué? ¡Así!", "20 °C à l’ombre", "Straße—Größe", "MENÜ–KARTE",
    "ÍNDICE—Ñandú", "──┬──┐", "kg·m²", "naïve façade", "Ağrı Dağı", "Đà Nẵng", "Kraków–Łódź", "São João", "Þingvellir", "Ελλάδα", "Київ", "東京", "שלום", "سلام", "5×7", "½ litre", "§ 12 ¶ 3", "π≈3",
]


@pytest.mark.parametrize("text", MORE_SOUND)
def test_unusual_but_sound_text(spark, text):
    assert M.mend(text) == (text, False)
    assert not any(M.suspicious(w) for w in M.tokens(text))


def test_restoration_touches_only_the_garbled_word(spark):
    import unicodedata

    sound = ["Dęb", "Stary Dęb", "Dęb 2", "Plac Dębowa", "Ulica Dębowa", "Rondo Dębowa", "Brama Dębowa", "Dêbara", "Rue Dêbara", "Pont Dêbara", "Quai Dêbara", "Dęby", "Zęb", "Kłęb"] * 3
    nfd = unicodedata.normalize("NFD", "Plac Dêbowa")
    bad = {"Dêb Dêbara": "Dęb Dêbara", nfd: "Plac Dębowa", "(Dêb), Dêbara": "(Dęb), Dêbara"}
    rows = [("t", i, t) for i, t in enumerate([*sound, *bad])]
    got = {r.text: r for r in M.garbled(spark.createDataFrame(rows, "table_name string, row_no long, text string")).collect()}
    assert {t: r.restored for t, r in got.items()} == bad
    assert all(r.recovered for r in got.values())


def test_a_words_own_letter_at_its_end():
    # the first letter is shown as a sign that is otherwise punctuation
    bad = "École".encode("cp1252").decode("mac_roman")
    assert M.put_back(f"Rue {bad} 3", {M.tokens(bad)[0] if M.tokens(bad) else bad.strip(M._EDGES): "École"}) == "Rue École 3"
    assert M.put_back("(Dêb), Dêbara", {"Dêb": "Dęb"}) == "(Dęb), Dêbara"
    assert M.put_back("a  b\tc", {"b": None}) == "a  b\tc"


def test_recovered_means_that_nothing_is_left(spark):
    rows = [("t", 1, "Ïëîùàäü"), ("t", 2, "CafÃ© Ïëîùàäü"), ("t", 3, "ï¿½tage"), ("t", 4, "CafÃ©")]
    got = {r.row_no: (r.restored, r.recovered) for r in M.garbled(spark.createDataFrame(rows, "table_name string, row_no long, text string")).collect()}
    assert got[2] == ("Café Ïëîùàäü", False) and got[4] == ("Café", True)
    assert got[1][1] is False and got[3][1] is False


def test_a_hot_text_is_joined_in_parts(spark, monkeypatch):
    from trellisq.operators import skew

    rows = [("t", i, "CafÃ©") for i in range(50)] + [("t", 99, "sound")]
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("inner", 6))
    got = M.garbled(spark.createDataFrame(rows, "table_name string, row_no long, text string")).collect()
    assert sorted(r.row_no for r in got) == list(range(50))
