from __future__ import annotations

import random

from pyspark.sql import functions as F

from cairn.llm.languages import apart, document_languages, fit, label_code, mislabelled, mixed, passages, sentences
from tests.conftest import rows

#: A few ordinary sentences of each language, of which texts are made.
LINES = {
    "en": ["The old library keeps every report that the committee wrote.", "She walked slowly through the quiet streets of the town.", "We should have finished this work before the winter came.", "Nobody knows whether the answer was right or wrong.", "The weather in the north is colder than they had thought."],
    "de": ["Die alte Bibliothek bewahrt jeden Bericht, den der Ausschuss geschrieben hat.", "Sie ging langsam durch die stillen Straßen der kleinen Stadt.", "Wir hätten diese Arbeit vor dem Winter beenden sollen.", "Niemand weiß, ob die Antwort richtig oder falsch war.", "Das Wetter im Norden ist kälter, als man gedacht hatte."],
    "fr": ["La vieille bibliothèque conserve chaque rapport que le comité a écrit.", "Elle marchait lentement dans les rues calmes de la petite ville.", "Nous aurions dû finir ce travail avant que l’hiver arrive.", "Personne ne sait si la réponse était juste ou fausse.", "Le temps dans le nord est plus froid que ce qu’on pensait."],
}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(LINES[lang]) for _ in range(n))


#: Languages of other scripts and of other letters.
OTHERS = {
    "el": ["Η παλιά βιβλιοθήκη φυλάσσει κάθε έκθεση που έγραψε η επιτροπή.", "Περπατούσε αργά στους ήσυχους δρόμους της μικρής πόλης.", "Κανείς δεν ξέρει αν η απάντηση ήταν σωστή ή λάθος."],
    "ru": ["Старая библиотека хранит каждый отчет, который написал комитет.", "Она медленно шла по тихим улицам маленького города.", "Никто не знает, был ли ответ правильным или ложным."],
    "pl": ["Stara biblioteka przechowuje każdy raport, który napisała komisja.", "Szła powoli cichymi ulicami małego miasteczka.", "Nikt nie wie, czy odpowiedź była słuszna, czy błędna."],
    "tr": ["Eski kütüphane, komitenin yazdığı her raporu saklıyor.", "Küçük kasabanın sessiz sokaklarında yavaşça yürüdü.", "Cevabın doğru mu yanlış mı olduğunu kimse bilmiyor."],
    "zh": ["旧图书馆保存着委员会写的每一份报告。 ", "她慢慢地走过小镇安静的街道，天气比他们想的更冷。 ", "没有人知道答案是对的还是错的，我们应该在冬天之前完成这项工作。 "],
}


def documents(spark):
    data = []
    for k in range(90):
        lang = ("en", "de", "fr")[k % 3]
        label = "nl" if k in (2, 34, 63) else {0: None, 1: "fr" if lang != "fr" else "en"}.get(k % 30, lang)
        data.append((f"d{k}", text(lang, 12, k), label, "x"))
    return spark.createDataFrame(data, "docId string, text string, language string, chars string")


def test_label_spellings(spark):
    cases = {"en": "en", "EN": "en", " en-US ": "en", "en_GB": "en", "eng": "en", "English": "en", "deu": "de", "ger": "de", "German": "de", "pt-BR": "pt", "unknown": None, "und": None, "": None, "n/a": None, "xx": None, "klingon": None, "eu": "eu", "eu-ES": "eu", "zz9": None, "Ukrainian": "uk", None: None, "nl": "nl"}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string").select("i", label_code(F.col("x")))
    assert [r[1] for r in sorted(df.collect())] == list(cases.values())


def test_held_out_sentences(spark):
    profiles = fit(documents(spark))
    assert profiles.languages == ["de", "en", "fr"]
    held = {
        "en": "Nobody thought that the old streets of the town were quiet before the winter, and the committee should have known whether the report was finished or not.",
        "de": "Niemand hätte gedacht, dass die alten Straßen der Stadt vor dem Winter so still waren, und der Ausschuss sollte wissen, ob der Bericht richtig geschrieben war.",
        "fr": "Personne ne pensait que les vieilles rues de la ville étaient calmes avant l’hiver, et le comité aurait dû savoir si le travail était fini ou non.",
    }
    for lang, line in held.items():
        for t in (line, line.upper(), f"12 {line} 99"):
            (a, b, got, sure), *_ = profiles.verdicts([t])[0]
            assert profiles.languages[got] == lang and 0 < sure <= 1
    assert profiles.verdicts(["", "12 34 !!", "\n\n"]) == [[], [], []]


def test_mixed_and_mislabelled(spark):
    docs = documents(spark)
    profiles = fit(docs)
    german = text("de", 3, 1)
    chunks = [
        ("c1", "d0", text("en", 6, 1) + " " + german + " " + text("en", 2, 2)), ("c2", "d0", text("en", 4, 3)), ("c3", "d1", text("de", 5, 4)), ("c4", "d2", None), ("c5", "d2", ""), ("c6", "d2", "123"),
        ("c7", "d3", text("en", 3, 5) + " He said «ja, das ist gut» and left the room."), (None, "d4", german), ("c8", None, german), ("c9", "d5", text("fr", 800, 6)),
    ]
    df = spark.createDataFrame([(*c, "x") for c in chunks], "chunkId string, docId string, chunkText string, owner string")
    found = passages(df, profiles, "chunkId", "docId", "chunkText")
    by = {r.id: r for r in found.collect()}
    assert set(by) == {c[0] for c in chunks if c[0]} and by["c4"].chars == by["c5"].chars == by["c6"].chars == {}
    assert [s.lang for s in by["c1"].segments] == ["en", "de", "en"] and chunks[0][2][by["c1"].segments[1].start : by["c1"].segments[1].end] == german
    assert [r[:2] for r in rows(mixed(found))] == [("c1", "de"), ("c1", "en")] and set(by["c9"].chars) == {"fr"}
    assert dict(r[:2] for r in rows(document_languages(found))) == {"d0": "en", "d1": "de", "d3": "en", "d5": "fr"}
    wrong = {r.id: r.lang for r in mislabelled(docs, found).collect()}
    # d0 has no label, d1's names another language, d3 and d5 are right, d2 has no text
    assert wrong == {"d0": "en", "d1": "de"}


def test_nothing_to_learn_from(spark):
    docs = documents(spark)
    empty = fit(docs.limit(0))
    df = spark.createDataFrame([("c", "d", "Some words.")], "chunkId string, docId string, chunkText string")
    assert empty.languages == [] and passages(df, empty, "chunkId", "docId", "chunkText").first().segments == []
    assert passages(df.limit(0), fit(docs), "chunkId", "docId", "chunkText").count() == 0


def test_sentences():
    t = "One is here. Two 3.5 follows! “Three?” Four (Fig. 2) ends"
    assert [t[a:b] for a, b in sentences(t)][:2] == ["One is here.", "Two 3.5 follows!"] and sentences("") == [] and sentences("  \n ") == []


def test_other_scripts_and_rare_languages(spark):
    """Half a percent of the documents are enough for a language, and letters are told apart in any script."""
    r = random.Random(7)
    lines = LINES | OTHERS
    make = lambda lang, n: " ".join(r.choice(lines[lang]) for _ in range(n))
    data = [(f"d{k}", make(("en", "de", "fr")[k % 3], 10), ("en", "de", "fr")[k % 3]) for k in range(1000)]
    data += [(f"{lang}{k}", make(lang, 12), lang) for lang in OTHERS for k in range(5)]
    # labels that no document of theirs bears rightly
    data += [(f"w{k}", make(("en", "de", "fr")[k % 3], 10), "it") for k in range(12)]
    profiles = fit(spark.createDataFrame(data, "docId string, text string, language string"))
    assert profiles.languages == sorted(lines)
    for lang in lines:
        (_, _, got, _), *_ = profiles.verdicts([make(lang, 3)])[0]
        assert profiles.names[got] == lang
    ranked = dict(zip(profiles.languages, profiles.ranked))
    assert apart(ranked["el"], ranked["ru"]) > 0.9 and apart(ranked["pl"], ranked["tr"]) > 0.4


def test_a_language_without_a_profile_is_none(spark):
    docs = documents(spark)
    profiles = fit(docs)
    chunks = [("c1", "d1", " ".join(OTHERS["ru"])), ("c2", "d2", " ".join(OTHERS["tr"] * 2)), ("c3", "d3", text("en", 5, 1) + " " + " ".join(OTHERS["el"]))]
    found = passages(spark.createDataFrame(chunks, "chunkId string, docId string, chunkText string"), profiles, "chunkId", "docId", "chunkText")
    assert dict(r[:2] for r in rows(document_languages(found))) == {"d1": "und", "d2": "und", "d3": "en"}
    assert mixed(found).count() == 0 and {r.id for r in mislabelled(docs, found).collect()} <= {"d3"}


def test_one_language_under_two_names(spark):
    data = [(f"d{k}", text("en", 12, k), "en") for k in range(40)] + [(f"x{k}", text("en", 12, 100 + k), "nl") for k in range(20)] + [(f"f{k}", text("fr", 12, k), "fr") for k in range(20)]
    assert fit(spark.createDataFrame(data, "docId string, text string, language string")).languages == ["en", "fr"]
