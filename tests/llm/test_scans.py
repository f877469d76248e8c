from __future__ import annotations

import random

from pyspark.sql import functions as F

from cairn.llm.scans import CONFUSIONS, _value, anagram_value, corrections, edge_lines, learned_confusions, repair, scan_noise, shapes, vocabulary
from tests.conftest import rows

#: A paragraph in which the words are frequent, wrapped as a page would be.
LINES = ["The library keeps a register of every manuscript that the", "curator describes after the survey. The register and the", "manuscript are kept by the curator in the northern branch", "of the library, and the survey describes the register for", "the reading room of the northern branch of the library."]
PLAIN = " ".join(LINES)


def table(spark, texts):
    return spark.createDataFrame([(i, f"doc{i}", t, "x") for i, t in texts], "chunkId string, docId string, chunkText string, kind string")


def page(*inserted, lines=LINES):
    out = list(lines)
    for at, line in inserted:
        out.insert(at, line)
    return "\n".join(out)


BACKGROUND = [(f"b{k}", PLAIN) for k in range(12)]


def noise(spark, texts, titles=None):
    found, repaired = scan_noise(table(spark, [*BACKGROUND, *texts]), titles)
    return {(i, k) for i, k in rows(found)}, dict(rows(repaired))


def test_values(spark):
    df = spark.createDataFrame([("straße",), ("a",), ("",)], "w string").select(anagram_value(F.col("w")))
    assert [r[0] for r in df.collect()] == [_value("straße"), _value("a"), 0]


def test_corrections(spark):
    words = [("register", 100, 1), ("rnanuscript", 1, 0), ("manuscript", 90, 0), ("regist3r", 1, 0), ("reg1ster", 1, 0), ("1ibrary", 2, 0), ("library", 50, 0), ("wicle", 1, 1), ("wide", 80, 0), ("tide", 3, 0), ("retsiger", 1, 0), ("cllstance", 1, 0), ("distance", 60, 0), ("索引索引", 9, 0)]
    got = {r.wrong: (r.right, r.changes) for r in corrections(spark.createDataFrame(words, "word string, n long, capital long")).collect()}
    # wicle is a name, regist3r no known confusion, an anagram none; 1 stands for l, not for i
    assert got == {"rnanuscript": ("manuscript", 1), "1ibrary": ("library", 1), "cllstance": ("distance", 2)}
    assert corrections(spark.createDataFrame([], "word string, n long, capital long")).count() == 0
    assert len(CONFUSIONS) == len(set(CONFUSIONS))


def test_edge_lines():
    def kinds(*inserted, title=None):
        return [k for k in edge_lines(page(*inserted).split("\n"), title) if k]

    assert kinds() == []
    for line in ("12", "    12", "Page 3 / 9", "- 4 -", "— 175 —", "[7]", "xii", "Seite 5", "P. 8"):
        assert kinds((2, line)) == ["page_no"], line
    assert kinds((2, "MORSIL WORKING NOTES")) == ["header"]
    # words that look like numerals, and a year, are text
    for line in ("civil", "civic", "ill", "mix", "2019", "v"):
        assert kinds((2, line)) == [], line
    assert kinds((0, "2019")) == ["page_no"] and kinds((2, "1041"), (4, "- 1042 -")) == ["page_no", "page_no"]
    assert kinds((2, "NOTES OF LODI | 45")) == kinds((0, "45  Lodi Quarterly · Vol. 3")) == ["both"]
    assert kinds((2, "A Short Title of Its Own"), title="A Short Title of Its Own") == ["header"]
    assert kinds((5, "A Short Title of Its Own"), title="A Short Title of Its Own") == ["header"]
    # numbers and capitals within the text are none
    assert edge_lines(["page 55 of the", "register, see 12"], None) == ["", ""] and edge_lines(["ALL IN CAPITALS HERE", "AND SO ARE THESE LINES"], None) == ["", ""]


def test_shapes():
    assert shapes("Proc. Lodi 1998") == ["proc. X #$"] and shapes("Rasu et al. — A title") == ["X et al.", "X et al. —"]
    assert shapes("Anna Berta Carla went") == ["X X X went"] and shapes("word") == shapes("") == []


def test_headers_by_their_shape(spark):
    """Headers of many documents, in any words, have a shape that breaks the flow of the lines."""
    head = [(f"h{k}", page((1 + k % 4, f"Ann. {name} {k}"))) for k, name in enumerate(["Lodi", "Rasu", "Morsil", "Tavo", "Kelim", "Pona", "Sirut", "Bevo"] * 2)]
    # an ordinary beginning is none, however often it stands at a line's start
    plain = [(f"p{k}", page(lines=[LINES[0], f"curator {k} describes after the survey. The register and", *LINES[2:]])) for k in range(16)]
    found, repaired = noise(spark, [*head, *plain])
    assert found == {(i, "header") for i, _ in head} and set(repaired.values()) == {PLAIN}


def test_confusions_that_no_table_has(spark):
    """q for g and x for v, and one of two characters, are learned from the texts."""
    r = random.Random(8)
    stems = ["".join(r.choice("bdfglmnprstv") + r.choice("aeiou") for _ in range(r.randrange(3, 6))) for _ in range(400)]
    often, rare = stems[:200], stems[200:]
    texts = [(f"t{k}", " ".join(r.choice(often) for _ in range(150)) + f" {r.choice(rare)} end.") for k in range(300)]
    for k in range(300):
        words = texts[k][1].split(" ")
        for at in r.sample(range(140), 5):
            words[at] = words[at].replace("g", "q", 1) if k % 2 else words[at].replace("v", "x", 1)
        texts[k] = (f"t{k}", " ".join(words))
    df = table(spark, texts)
    assert {("q", "g"), ("x", "v")} <= set(learned_confusions(vocabulary(df, "chunkText"), least=40))
    assert learned_confusions(vocabulary(df.limit(0), "chunkText")) == []


def test_names_that_differ_in_a_syllable(spark):
    """Misread and misspelt forms of one name are no confusion that makes another name of them."""
    r = random.Random(3)
    parts = ["ba", "ce", "di", "fo", "gu", "ki", "lo", "mu"]
    names = sorted({a + b + c for a in parts for b in parts for c in parts if len({a, b, c}) == 3})
    counts = {w: [200, 200] for w in r.sample(names, 200)}
    for w in list(counts):
        counts.setdefault(w.replace("e", "c", 1), [2, 2])
        at = r.randrange(1, len(w) - 1)
        counts.setdefault(w[:at] + w[at + 1] + w[at] + w[at + 2 :], [1, 1])
    words = spark.createDataFrame([(w, n, c) for w, (n, c) in counts.items()], "word string, n long, capital long")
    assert learned_confusions(words) == [("c", "e")]


def test_many_confusions_are_not_in_the_plan(spark):
    """The plan, which the driver holds, is as long with 214 confusions as with 16; all are applied, pairs too."""
    letters = "bdfgjkpqvxyz"
    more = tuple((a + b, c + d) for a in letters for b in letters for c, d in ("ae", "io", "ua") if a < b)
    words = spark.createDataFrame([("rnanuscript", 1, 0), ("manuscript", 90, 0), ("lbdrarfz", 1, 0), ("laerario", 90, 0)], "word string, n long, capital long")
    assert len(CONFUSIONS) + len(more) == 214
    few, many = corrections(words), corrections(words, confusions=(*CONFUSIONS, *more))
    length = lambda df: len(df._jdf.queryExecution().toString())
    assert length(many) < 1.5 * length(few) + 10_000
    assert rows(few) == [("rnanuscript", "manuscript", 1)] and rows(many) == [("lbdrarfz", "laerario", 2), ("rnanuscript", "manuscript", 1)]


def test_first_and_last_words(spark):
    clean = [(f"c{k}", f"{PLAIN} Folio {k}.") for k in range(40)]
    found, repaired = noise(spark, [*clean, ("first", PLAIN.replace("The", "Tne", 1)), ("a", "Rnanuscript of the library. " + PLAIN), ("z", PLAIN + " It was the rnanuscript."), ("cut", "rnanuscript of the library. " + PLAIN)])
    assert {i for i, k in found if k == "chars"} == {"a", "z"} and repaired["z"].endswith("It was the manuscript.")


def test_kinds_and_repair(spark):
    cut = ["The library keeps a register of every manu-", "  script that the", *LINES[1:]]
    texts = [
        ("head", page((2, "MORSIL WORKING NOTES"))), ("page", page((3, "- 12 -"))), ("both", page((1, "LODI QUARTERLY NOTES | 12"))), ("hyphen", page(lines=cut)),
        ("across", page((1, "Page 7"), lines=cut)), ("lost", PLAIN.replace("register of", "regi\xad ster of")), ("plainlost", PLAIN.replace("describes", "desc- ribes", 1)), ("chars", PLAIN.replace("curator", "cur@tor", 1).replace("manuscript", "rnanuscript", 1)),
        ("wrapped", page()), ("null", None), ("empty", ""), ("list", PLAIN + " The pre- and post-war registers."), ("name", PLAIN + " It was Wicle and Fp16 who came."),
    ]
    found, repaired = noise(spark, texts)
    assert found == {("head", "header"), ("page", "page_no"), ("both", "header"), ("both", "page_no"), ("hyphen", "hyphen"), ("across", "hyphen"), ("across", "page_no"), ("lost", "hyphen"), ("plainlost", "hyphen"), ("chars", "chars")}
    assert set(repaired) == {i for i, _ in found} and set(repaired.values()) == {PLAIN}


def test_copies_of_a_misread_text(spark):
    clean = [(f"c{k}", f"{PLAIN} Folio {k}.") for k in range(40)]
    copies = [(f"w{k}", PLAIN.replace("curator", "cur@tor")) for k in range(20)]
    found, _ = noise(spark, [*clean, *copies])
    assert found == {(i, "chars") for i, _ in copies}


def test_titles_and_compounds(spark):
    titles = spark.createDataFrame([("doct", "The Survey of the North"), ("docq", None)], "docId string, title string")
    compound = page(lines=["The well-known library keeps the well-known register, the well-", "known manuscript and", *LINES[1:]])
    found, _ = noise(spark, [("t", page((2, "The Survey of the North"))), ("q", page()), ("w", compound)], titles)
    assert found == {("t", "header")}


def test_empty_and_long(spark):
    found, repaired = scan_noise(table(spark, BACKGROUND).limit(0))
    assert found.count() == repaired.count() == 0
    found, _ = noise(spark, [("long", page((2, "12"), lines=LINES * 3000)), (None, page((2, "12")))])
    assert found == {("long", "page_no")}


def test_repair_keeps_case():
    assert repair("The Rnanuscript and RNANUSCRIPT", None, {"rnanuscript": "manuscript"}) == "The Manuscript and MANUSCRIPT"
