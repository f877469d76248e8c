"""Text functions: column expressions, native but for the language."""

from __future__ import annotations

from functools import cache, reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What stands between the pages of an extracted document.
PAGE_BREAK = "======\n\n======"
#: Typographic ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Frequent function words of a language.
FUNCTION_WORDS = {
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es werden aus nach bei einer wird vor über ohne",
    "en": "the of and to in that for it as was with be by on not at are this have from or which were when more if out while each",
    "es": "de la que el en y los se del las un por con no una su para al lo como más pero sin sobre este entre según desde",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce aux mais sans selon",
    "pt": "de a o que e do da em um para com não uma os no na por mais as dos como das ao à sem mesmo pelo",
    "da": "og det ikke til med på være blev af hun",
    "it": "il di che non per sono della con anche gli",
    "nl": "het een van niet met voor zijn naar ook wordt",
    "pl": "nie się jest na że do jak przez oraz dla",
    "sv": "och att det som för inte med till är av",
    "tr": "ve bir bu için ile olarak daha çok olan gibi",
}
#: Scripts that tell a language, and letters that tell the languages of one script, the
#: first that occurs; the last has none.
SCRIPTS = {
    "Arabic": {"ar": ""}, "Cyrillic": {"uk": "іїєґ", "ru": "ыэё", "bg": "ъ", "ru ": ""}, "Devanagari": {"hi": ""}, "Greek": {"el": ""},
    "Han": {"zh": ""}, "Hangul": {"ko": ""}, "Hebrew": {"he": ""}, "Thai": {"th": ""},
}


def collapse_whitespace(text: Column) -> Column:
    """Runs of ASCII white space become one space; characters up to U+0020 go from both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalize(text: Column) -> Column:
    """Clean extracted text, in this order: soft hyphens go; a hyphen at a line end joins the
    lines; fixed-width and narrow spaces become spaces; ligatures become letters; any other
    character outside the printable part of the basic plane becomes a space; runs of blanks
    become one, line feeds stay; ends are trimmed."""
    out = F.replace(text, F.lit("­"), F.lit(""))
    out = F.regexp_replace(out, r"-[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*", "")
    out = F.translate(out, "   ", "   ")
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), out)
    out = F.regexp_replace(out, "[^\\x{20}-\\x{7E}\\x{A0}-\\x{FFFF}\\n]", " ")
    return F.btrim(F.regexp_replace(out, r"[ \t\r]+", " "), F.lit(" \n"))


def title(text: Column) -> Column:
    """The first line, without spaces around it."""
    return F.trim(F.substring_index(text, "\n", 1))


def chunk_id(doc_id: Column, index: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc_id, index.cast("string"), start.cast("string"), end.cast("string")), 256)


@cache
def _language_tables() -> tuple:
    known: dict[str, list[str]] = {}
    for code, listed in FUNCTION_WORDS.items():
        for w in listed.split():
            known.setdefault(w, []).append(code)
    scripts = [(regex.compile(rf"\p{{{name}}}"), codes) for name, codes in SCRIPTS.items()]
    return known, regex.compile(r"[\p{L}']+"), regex.compile(r"\p{L}"), scripts, regex.compile(r"[\p{Hiragana}\p{Katakana}]"), regex.compile(r"\p{Han}"), regex.compile(r"[^\x00-\u024f]")


def language_of(text: str | None, sample: int = 1000) -> str:
    """The language of a text's first ``sample`` characters.

    A script that holds more than half of the letters tells it, with the letters of one language
    where several share the script (any kana is Japanese). Otherwise it is the language with the most
    function words. 'unknown' for null and empty texts and where nothing tells; ties go to the code
    that sorts first.
    """
    if not text:
        return "unknown"
    known, word, letter, scripts, kana, han, beyond = _language_tables()
    low = text[:sample].lower()
    if beyond.search(low):
        letters = len(letter.findall(low))
        if 2 * (len(kana.findall(low)) + len(han.findall(low))) > letters and kana.search(low):
            return "ja"
        for script, codes in scripts:
            if 2 * len(script.findall(low)) > letters:
                return next(c.strip() for c, own in codes.items() if not own or any(x in low for x in own))
    score: dict[str, int] = {}
    for w in word.findall(low):
        for code in known.get(w, ()):
            score[code] = score.get(code, 0) + 1
    return min(score, key=lambda c: (-score[c], c)) if score else "unknown"


@F.pandas_udf(StringType())
def _languages(texts: pd.Series) -> pd.Series:
    return texts.map(language_of, na_action=None)


def language(text: Column, sample: int = 1000) -> Column:
    """:func:`language_of`, on Arrow batches: looking up each word once is ten times as fast as
    native expressions, which go through the words for each language."""
    return _languages(F.substring(text, 1, sample))


def model_dimension(model: Column) -> Column:
    """Width of a model's vectors by the size in its name; 1024 where it names none."""
    return F.when(model.contains("small"), 384).when(model.contains("medium"), 768).otherwise(1024)


def chat_role(role: Column) -> Column:
    """Roles other than user, system and assistant count as user; so does null."""
    return F.when(role.isin("user", "system", "assistant"), role).otherwise("user")
