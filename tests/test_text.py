from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions.text import chat_role, collapse_whitespace, language, language_of, model_dimension, normalize, title
from tests.conftest import DATA


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x"))).first()[0]


def test_normalize_each_step(spark):
    cases = {
        "so­ft": "soft",
        "list -\n  item": "list item",
        "hy-\nphen": "hyphen",
        "a b c d": "a b c d",
        "ﬀﬁﬂﬃﬄ": "fffiflffiffl",
        "a\u0001b\u0085c\U0001f600d\te": "a b c d e",
        "a  \t b\nc": "a b\nc",
        " \n x \n ": "x",
        "": "",
    }
    got = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", normalize(F.col("x"))).collect()
    assert [r[1] for r in sorted(got)] == list(cases.values())
    assert one(spark, None, normalize) is None


def test_collapse_whitespace_and_title(spark):
    assert one(spark, "This   is \t\x0b\f\r\n test   ", collapse_whitespace) == "This is test"
    assert one(spark, "\x01 x \x02", collapse_whitespace) == "x"
    assert one(spark, "  A title \nrest", title) == "A title"
    assert one(spark, "no line feed", title) == "no line feed"


def test_language_contract(spark):
    assert one(spark, None, language) == "unknown"
    assert one(spark, "", language) == "unknown"
    assert one(spark, "12 34 %%", language) == "unknown"
    texts = {"en": "the cat and the dog are in the house", "fr": "le chat et le chien sont dans la maison avec nous", "de": "die Katze und der Hund sind in dem Haus", "es": "el gato y el perro están en la casa de los", "pt": "o gato e o cachorro não estão na casa do homem"}
    for code, text in texts.items():
        assert one(spark, text, language) == code
    more = {"ru": "Привет, это новый документ", "uk": "Це новій документ і звіт", "bg": "Това е нов документ от съвета", "ja": "これは新しい文書です", "zh": "这是一份新文件", "el": "Το νέο έγγραφο", "ko": "이것은 새 문서", "he": "זה מסמך חדש", "ar": "هذا مستند جديد", "it": "il documento che non è della biblioteca", "nl": "het is een van de boeken met niet veel", "tr": "bu bir belge ve daha çok olan", "pl": "nie jest to na stole, oraz się dla nich"}
    for code, text in more.items():
        assert language_of(text) == code
    # only the first 1000 characters count
    assert one(spark, "der die das und " * 70 + "the of and to in " * 900, language) == "de"


def test_language_against_labels(spark):
    """Labels that come with the texts, not with the detector."""
    df = spark.read.parquet(f"{DATA}/documents.parquet").where("lang IS NOT NULL AND length(text) > 100")
    right = df.where(language(F.col("text")) == F.col("lang")).count()
    assert right >= 0.97 * df.count() > 0


def test_dimension_and_role(spark):
    for name, dim in (("x-small", 384), ("x-medium", 768), ("x-large", 1024), ("other", 1024)):
        assert one(spark, name, model_dimension) == dim
    for role, want in (("system", "system"), ("assistant", "assistant"), ("user", "user"), ("tool", "user"), (None, "user")):
        assert one(spark, role, chat_role) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t-­ ﬁé\u0001", max_size=30), min_size=1, max_size=20))
def test_normalize_against_plain_python(spark, texts):
    def plain(s):
        s = s.replace("­", "")
        s = re.sub(r"-[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*", "", s)
        s = s.replace(" ", " ").replace("ﬁ", "fi")
        s = re.sub("[^ -~ -￿\n]", " ", s)
        return re.sub(r"[ \t\r]+", " ", s).strip(" \n")

    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", normalize(F.col("x")))
    assert [r[1] for r in sorted(df.collect())] == [plain(t) for t in texts]
