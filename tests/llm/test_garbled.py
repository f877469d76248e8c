from __future__ import annotations

import itertools

import pytest

from cairn.llm.garbled import MARGINS, ON_PURPOSE, _ngram_counts, candidates, chains, fit, garble, margin_sums, repair, restore, validated_margin

CLEAN = [
    "Die Übersicht über die größten Gärten während der Prüfung erklärt die Fußnote für ältere Geräte.",
    "La bibliothèque précise la légende après la deuxième relecture, à cause de la reliure abîmée.",
    "La sección añadida explica el catálogo según el método; además, el índice está más allá.",
    "A introdução não contém a secção; a publicação está à espera da última versão em português.",
    "The librarian’s note doesn’t say so – it isn’t there; the café’s “menu” costs € 12,50 ™ © § °C.",
    "индекс и каталог", "κατάλογος", "索引 検索", "LE RÉGLAGE GRÂCE À L’ÉTUDE ÉTAIT PRÊT", "A VERSÃO DA SECÇÃO",
]
GARBLED = [
    ("Die größten Gärten während der Prüfung", "utf-8", "cp1252"), ("La bibliothèque précise la légende", "utf-8", "latin-1"), ("según el método además", "utf-8", "mac_roman"),
    ("a publicação está à espera", "utf-8", "cp850"), ("après la deuxième relecture", "cp1252", "cp1251"), ("la sección añadida", "cp1252", "mac_roman"), ("doesn’t say so", "utf-8", "cp437"),
]


def corpus(spark, extra=()):
    data = [(i, CLEAN[i % len(CLEAN)], "x", 1) for i in range(400)]
    return spark.createDataFrame(data + [(1000 + k, t, "y", 2) for k, t in enumerate(extra)], "doc_id long, text string, restored string, garbled int")


@pytest.mark.parametrize("text,written,read", GARBLED)
def test_round_trip(text, written, read):
    wrong = garble(text, written, read)
    assert wrong != text and repair(wrong, read, written) == text and (read, written) in chains()


def test_candidates():
    assert candidates("prÃ¼ft")["prüft"] == "cp1252>utf-8"
    twice = garble(garble("é", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert candidates(twice)["é"] == "cp1252>utf-8x2"
    assert repair("plain ü", "cp1252", "utf-8") is None and not any(">utf-8" in c for c in candidates("prüft").values())


def test_found_and_restored(spark):
    extra = [f"Before it. {garble(t, w, r)} and after it." for t, w, r in GARBLED]
    extra += ["Die gr��ten Fehler", garble(garble("La bibliothèque précise", "utf-8", "cp1252"), "utf-8", "cp1252"), None, "", "   ", "plain ascii", garble("für ältere ", "utf-8", "cp1252") * 3000]
    df = corpus(spark, extra)
    got = {r.doc_id: r for r in restore(df).collect()}
    wrong = {1000 + k for k in range(len(GARBLED) + 2)} | {1000 + len(extra) - 1}
    assert set(got) == wrong
    for k, (t, _, _) in enumerate(GARBLED):
        assert got[1000 + k].restored == f"Before it. {t} and after it." and got[1000 + k].lost == 0
    lost = got[1000 + len(GARBLED)]
    assert lost.restored == "Die gr��ten Fehler" and lost.lost == lost.garbled == 1
    assert got[1000 + len(GARBLED) + 1].restored == "La bibliothèque précise"
    assert got[1000 + len(extra) - 1].restored == "für ältere " * 3000


def test_a_rare_symbol_is_no_evidence(spark):
    # the letter that the symbol's byte is elsewhere is far more frequent than the symbol
    data = [(i, "à la bibliothèque, à cause de la reliure abîmée à part") for i in range(600)] + [(1000 + i, "it costs € 12,50 ™") for i in range(3)]
    assert restore(spark.createDataFrame(data, "doc_id long, text string")).count() == 0


def test_empty_and_null(spark):
    df = corpus(spark)
    counts, margin = fit(df)
    assert margin > 0 and counts.shape[0] == 5
    assert restore(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "prÃ¼ft"), (1, None), (2, "prÃ¼ft"), (2, "prÃ¼ft")], "doc_id long, text string")
    assert [r.doc_id for r in restore(nulls, fitted=(counts, margin)).collect()] == [2, 2]


def test_the_margin_is_validated_on_all_words(spark):
    """A false alarm counts, whichever of very many words it is."""
    clean = [f"{a}{b}ü{c}{d}" for a, b, c, d in itertools.product(("gr", "pr", "br", "st", "fl", "kl", "tr", "sp"), "aeiou", ("ft", "ck", "nd", "rt", "lz", "ng", "ß", "ll"), ("", "e", "en", "er", "es", "ig", "lich", "ung"))]
    words = spark.createDataFrame([(w, 1.0) for w in clean], "word string, n double")
    counts = _ngram_counts(words)
    sums = margin_sums(counts, words)
    garbled = sum((x := garble(w, wr, r)) is not None and x != w for w in clean for r, wr in ON_PURPOSE)
    assert len(clean) > 2500 and sorted(r.margin for r in sums) == sorted(MARGINS)
    assert all((r["false"], r.weight, r.garbled) == (0.0, len(clean), garbled) for r in sums)
    for w in ("grüft", "klückung", "spründen", "trürtlich"):
        more = words.unionByName(spark.createDataFrame([(garble(w, "utf-8", "cp1252"), 5.0)], words.schema))
        wrong = margin_sums(counts, more)
        assert all((r["false"], r.weight) == (5.0, len(clean) + 5.0) for r in wrong if r.margin < 8) and validated_margin(wrong) >= 8
    assert validated_margin(margin_sums(counts, words.limit(0))) == MARGINS[-1]


def test_hot_mistakes_stay_mistakes(spark):
    # half of the texts are clean; one garbled text is copied, or a source has one mistake throughout
    clean = [(i, f"{CLEAN[1]} Folio {i} à côté de la bibliothèque.", f"s{i % 40}") for i in range(400)]
    wrong = garble("La bibliothèque précise la légende après la relecture", "cp1252", "mac_roman")
    copied = [(1000 + i, wrong, f"s{i % 40}") for i in range(200)]
    of_one_source = [(2000 + i, f"{wrong} {i}", "hot") for i in range(200)]
    for extra in (copied, of_one_source):
        df = spark.createDataFrame(clean + extra, "doc_id long, text string, source string")
        got = {r.doc_id: r.restored for r in restore(df, source="source").collect()}
        assert set(got) == {i for i, _, _ in extra}
        assert all(t.startswith("La bibliothèque précise la légende après la relecture") for t in got.values())


RUSSIAN = ["Индекс и каталог архива", "Привет мир, документ и отчет о работе", "В новом разделе описан порядок хранения", "Записи и страницы книги лежат в архиве"]


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman"])
@pytest.mark.parametrize("known", [True, False])
def test_cyrillic_read_as_latin(spark, read, known):
    """With clean Cyrillic in the corpus or without; what is meant stays."""
    meant = [(i, RUSSIAN[i % 4], "x", 0) for i in range(200 * known)] + [(500, "Дата: 5 мая, цена 3 € ™ — «да»", "x", 0), (501, "ÀÂÇÉÈÊËÎÏÔÙÛÜ", "x", 0), (502, "áéíóú", "x", 0)]
    wrong = [(600 + k, f"A note. {garble(t, 'cp1251', read)}. End of it, voilà.", "y", 0) for k, t in enumerate(RUSSIAN)]
    df = corpus(spark).unionByName(spark.createDataFrame(meant + wrong, corpus(spark).schema).selectExpr("doc_id + 5000 AS doc_id", "text", "restored", "garbled"))
    got = {r.doc_id: r.restored for r in restore(df).collect()}
    assert set(got) == {5600 + k for k in range(4)}
    assert [got[5600 + k] for k in range(4)] == [f"A note. {t}. End of it, voilà." for t in RUSSIAN]


def test_a_lone_word_of_a_known_script(spark):
    df = corpus(spark).unionByName(spark.createDataFrame([(5000 + i, RUSSIAN[i % 4], "x", 0) for i in range(200)] + [(6000, garble("архива", "cp1251", "cp1252"), "x", 0)], corpus(spark).schema))
    assert [(r.doc_id, r.restored) for r in restore(df).collect()] == [(6000, "архива")]


def test_control_characters_are_evidence(spark):
    df = corpus(spark, [garble("the “menu” isn’t – there", "cp1252", "latin-1"), "a line\x85 and a line"])
    assert [(r.doc_id, r.restored) for r in restore(df).collect()] == [(1000, "the “menu” isn’t – there")]
