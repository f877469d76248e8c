"""Noise in text from scanned pages, and its repair into continuous paragraphs.

Misrecognised characters: a word's anagram value is the sum of the fifth powers of its code
points, so a confusion of characters changes it by a fixed difference, wherever in the word it
is. Rare words are joined with frequent ones by value plus difference, in SQL; a hit is verified
on the strings, and a word's corrections are ranked. Which confusions there are is learned from the
vocabulary: of the frequent words that hold the right characters, a good share has a rare double
with the wrong ones, which chance and inflection don't make. Running headers and page numbers are
lines that don't belong to the flow of wrapped lines around them; a header's shape, its names and
numbers masked, is one that breaks the flow in most of the texts that have it. A hyphen at a line
end is noise if the vocabulary has the word without it rather than with it.
"""

from __future__ import annotations

import difflib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.words import bit_filter
from cairn.operators.spread import spread_join
from cairn.session import drop_table, work_table

#: Usual confusions, what is recognised and what stands on the page, for texts too few
#: to learn from; :func:`learned_confusions` adds those of the scans at hand, in either direction.
CONFUSIONS = (
    ("c", "e"), ("@", "a"), ("f", "t"), ("l", "i"), ("0", "o"), ("ii", "u"), ("5", "s"), ("1", "l"), ("cl", "d"),
    ("rn", "m"), ("9", "g"), ("b", "h"), ("6", "b"), ("vv", "w"), ("h", "li"), ("m", "rn"),
)
#: A correction needs this count and this many times the count of the word it corrects.
LEAST_COUNT, RATIO = 5, 20
#: A confusion is learned from words with this count: so many of them at least, and this share of
#: those with the right characters, need a rare double with the wrong ones.
LEARN_COUNT, LEARN_WORDS, LEARN_SHARE = 100, 5, 0.2
#: Frequent words up to which they are sent to every task that learns.
BROADCAST_WORDS = 5_000
#: A line's shape is a header's if surely (2.5 %) more than this share of its lines break the flow.
ODD_SHARE = 0.45
#: Share of capitals above which a word may be a name, and below which its correction is none.
NAME, ORDINARY = 0.5, 0.1
#: Shortest word corrected; shortest corrected by two confusions.
SHORTEST, SHORTEST_TWICE = 4, 6
#: Marks of a divided word: hyphen, soft hyphen, not sign, non-breaking and true hyphen.
MARKS = "-­¬‑‐"
#: Bits of the filter that tells which words may have a correction: its size doesn't grow.
FILTER_BITS = 1 << 24
#: Distinct words a task counts before it hands them on.
FLUSH = 200_000

_WORD = re.compile(r"(?:[^\W_]|@|(?<=[^\W\d_])[|!$](?=[^\W\d_]))+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
#: A page number that says so, and a bare one.
_PAGE = re.compile(rf"^\s*(?:[-—–\[(]\s*)?(?:(?:page|seite|página|pagina|pág\.|pag\.|p\.|s\.)\s*)?(\d{{1,4}}(?:\s*/\s*\d{{1,4}})?|{_ROMAN})(?:\s*[-—–\])])?\s*$", re.I)
_BARE = re.compile(rf"^\s*(\d{{1,4}}|{_ROMAN})\s*$", re.I)
_WITH_PAGE = re.compile(r"^\s*\d{1,4}\s{2,}\S.*$|^.*\S\s+\|\s+\d{1,4}\s*$")
_STOP = re.compile(r"[.!?…:;]['\"”’»)\]]*\s*$")
_BROKEN = re.compile(rf"([^\W_]+)[{MARKS}]\s*$")
_LOST_BREAK = re.compile(rf"([^\W\d_]+)([{MARKS}]) ([^\W\d_]+)")
_DIGITS = re.compile(r"\d+")
_BEGIN = re.compile(r"\s*([^\W_]+)")
#: After a hyphen these words continue a list, not the word.
_LISTS = frozenset("and or to und oder bis et ou y e o u".split())


def _shout(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 6 and all(c == c.upper() for c in letters)


def _like_title(line: str, title: str | None) -> bool:
    line = line.strip().lower()
    if not title or len(line) < 12:
        return False
    start = title.strip().lower()[: len(line)]
    return len(line) - len(start) <= 1 and difflib.SequenceMatcher(None, line, start, autojunk=False).ratio() >= 0.85


def _token(word: str) -> str:
    """A word of a shape: numbers and names are masked, abbreviations are not."""
    word = _DIGITS.sub("#", word)
    return "X" if word[:1].isupper() and word.isalpha() else word.lower()


def shapes(line: str) -> list[str]:
    """How a line begins, with three words and with four, and all of a shorter one.

    Three names alone say nothing of a line that goes on.
    """
    words = [_token(w) for w in line.split()[:5]]
    begins = [" ".join(words[:k]) for k in (3, 4) if k < len(words) or k == len(words) == 4]
    return [x for x in begins if x.strip("X ")] + ([" ".join(words) + "$"] if 1 < len(words) < 4 else [])


def _natural(a: str, b: str, width: int) -> bool:
    """Would wrapping break after ``a`` before ``b``?"""
    first = b.split()
    return len(a.rstrip()) <= width + 3 and len(a.rstrip()) + 1 + len(first[0] if first else "") > width - 3


def _width(lines: list[str], flow: list[int]) -> int:
    """The width that the lines of the flow are wrapped at; 0 if it can't be told."""
    inner = [len(lines[i].rstrip()) for i in flow[:-1] if not _BROKEN.search(lines[i])]
    return min(max(inner), sorted(inner)[len(inner) // 2] + 10) if inner else 0


def line_shapes(lines: list[str]) -> list[tuple[str, bool]]:
    """``(shape, does it break the flow)`` of the lines that don't end a sentence."""
    flow = [i for i, x in enumerate(lines) if x.strip() and not _PAGE.match(x)]
    width = _width(lines, flow)
    if not width:
        return []
    breaks = [not _natural(lines[i], lines[j], width) and not _BROKEN.search(lines[i]) for i, j in zip(flow, flow[1:])]
    return [(s, (k < len(breaks) and breaks[k]) or (k > 0 and breaks[k - 1])) for k, i in enumerate(flow) if not _STOP.search(lines[i]) for s in shapes(lines[i])]


def _bare_pages(lines: list[str]) -> set[int]:
    """Lines of nothing but a number that are page numbers.

    A short numeral and a number of four digits may be words of the text. They need to stand at an
    edge; or else a numeral to have room in the line before it, which wrapping would have used, and
    a number its neighbour among the text's page numbers.
    """
    values = {i: m.group(1) for i, x in enumerate(lines) if (m := _PAGE.match(x))}
    filled = [i for i, x in enumerate(lines) if x.strip()]
    numbers = {int(v) for v in values.values() if v.isdigit()}
    out = set()
    for i, v in values.items():
        if _BARE.match(lines[i]) and (len(v) == 4 if v.isdigit() else len(v) < 3) and i not in (filled[0], filled[-1]):
            near = v.isdigit() and {int(v) - 1, int(v) + 1} & numbers
            room = not v.isdigit() and len(lines[i - 1].rstrip()) + 1 + len(v) <= max(len(x.rstrip()) for x in lines)
            if not near and not room:
                continue
        out.add(i)
    return out


def edge_lines(lines: list[str], title: str | None = None, header: Callable[[str], bool] = lambda line: False) -> list[str]:
    """For each line '', 'header', 'page_no' or 'both'; ``header`` knows the shapes of headers."""
    n = len(lines)
    kind = [""] * n
    if n < 2:
        return kind
    loud = sum(map(_shout, lines)) > n / 2
    pages = _bare_pages(lines)
    for i, line in enumerate(lines):
        if i in pages:
            kind[i] = "page_no"
        elif _WITH_PAGE.match(line) and not _STOP.search(line):
            kind[i] = "both"
        elif _STOP.search(line) is None and (header(line) or _shout(line) and not loud):
            kind[i] = "header"
    flow = [i for i in range(n) if not kind[i]]
    width = _width(lines, flow)
    if not width:
        return kind
    for at, i in enumerate(flow[:-1]):
        line, after = lines[i], lines[flow[at + 1]]
        odd = not _natural(line, after, width) and not _BROKEN.search(line)
        if _like_title(line, title) and (i or odd):
            kind[i] = "header"
        elif odd and not _STOP.search(line) and line.strip() and not _BARE.match(line):
            cut = line != line.rstrip() and len(line.rstrip()) < width - 3  # a header cut to a length
            before = lines[flow[at - 1]]
            inserted = at and _natural(before, after, width) and not kind[flow[at - 1]] and (line.strip()[:1].isupper() or line.strip()[:1].isdigit()) and not _STOP.search(before) and after.strip()[:1].islower()
            if cut or inserted:
                kind[i] = "header"
    if len(flow) > 1 and _like_title(lines[flow[-1]], title) and not _STOP.search(lines[flow[-1]]):
        kind[flow[-1]] = "header"
    return kind


def divided(lines: list[str], kind: list[str]) -> list[tuple[int, int, str, str, str]]:
    """``(line, next line, left, mark, right)`` of words that may be divided at a line end."""
    flow = [i for i in range(len(lines)) if not kind[i]]
    out = []
    for i, j in zip(flow, flow[1:]):
        m, b = _BROKEN.search(lines[i]), _BEGIN.match(lines[j])
        if m and b and not m.group(1).isdigit() and (b.group(1)[0].islower() or m.group(1).isupper()):
            out.append((i, j, m.group(1), lines[i].rstrip()[-1], b.group(1)))
    return out


def lost_breaks(text: str) -> list[tuple[int, int, str, str, str]]:
    return [(m.start(), m.end(), *m.groups()) for m in _LOST_BREAK.finditer(text) if m.group(3).lower() not in _LISTS]


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """``(word, n, capital)``: lower-cased words and hyphenated compounds of all rows, their
    count, and how often they begin with a capital (but aren't all capitals).

    Shapes of lines are counted along: ``word`` is the shape after a line feed, ``capital`` then
    the number of its lines that break the flow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()  # of words as they are written
        lines: Counter[tuple[str, bool]] = Counter()

        def flush() -> pa.RecordBatch:
            low, capital = [w.lower() for w in counts], [w[:1].isupper() and not (len(w) > 1 and w.isupper()) for w in counts]
            names, n = low + ["\n" + s for s, _ in lines], [*counts.values(), *lines.values()]
            odd = [n * c for n, c in zip(counts.values(), capital)] + [n * c for (_, c), n in lines.items()]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(odd, pa.int64())], ["word", "n", "capital"])
            counts.clear()
            lines.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(_WORD.findall(t))
                if "-" in t:
                    counts.update(_COMPOUND.findall(t))
                if "\n" in t:
                    lines.update(line_shapes(t.split("\n")))
                if len(counts) + len(lines) >= FLUSH:
                    yield flush()
        yield flush()

    return texts.select(F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(run, "word string, n long, capital long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("capital").alias("capital"))


def anagram_value(word: Column) -> Column:
    """Sum of the fifth powers of the code points; of Latin words, which keeps it a BIGINT."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a + F.pow(F.ascii(c).cast("double"), F.lit(5.0)).cast("long"))


def _value(s: str) -> int:
    return sum(ord(c) ** 5 for c in s)


def header_shapes(words: DataFrame) -> DataFrame:
    """``(word)``: the shapes of headers, by the lower bound of the share of lines that break the flow."""
    n, p = F.col("n"), F.col("capital") / F.col("n")
    z = 1.96
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return words.where(F.col("word").startswith("\n")).where(low > ODD_SHARE).select("word")


def confusion_table(words: DataFrame, least: int = LEARN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``(wrong, right)`` confusions of one or two characters that the vocabulary shows.

    A confusion's share tells it from inflection and chance: a scanner mistakes the same characters
    in any word, while few words have a rare neighbour by any other replacement. Letters that only
    changed places are a typist's. A rare word counts for its best explanation only, which is a
    change of places or a usual confusion, else the one with the greatest share: names that differ
    in a syllable would else show as many confusions as there are pairs of syllables, each by
    misread forms of the other name.
    """
    latin = _latin(words).where(f"length(word) >= {SHORTEST}").select("word", "n")
    often = latin.where((F.col("n") >= least) & F.col("word").rlike("^[^0-9@|!$]+$"))
    at = F.expr("explode(filter(flatten(transform(sequence(1, 2), k -> transform(sequence(1, length(word)), i -> struct(i, k)))), x -> x.i + x.k - 1 <= length(word)))")
    key = F.concat(F.expr("substring(word, 1, x.i - 1)"), F.lit("*"), F.expr("substring(word, x.i + x.k, 40)"))
    cut = lambda df: df.select("word", "n", at.alias("x")).select("word", "n", key.alias("key"), F.expr("substring(word, x.i, x.k)").alias("part"))
    right = cut(often).toDF("right", "many", "key", "good")
    pairs = cut(latin.where(F.col("n") * ratio <= (often.agg(F.max("n")).first()[0] or 0)))
    pairs = pairs.join(F.broadcast(right) if often.count() <= BROADCAST_WORDS else right, "key").where((F.col("many") >= F.col("n") * ratio) & (F.col("part") != F.col("good")))
    longer = (F.length("part") > 1) | (F.length("good") > 1)
    same_end = (F.left("part", F.lit(1)) == F.left("good", F.lit(1))) | (F.right("part", F.lit(1)) == F.right("good", F.lit(1)))
    pairs = work_table(pairs.where(~(longer & same_end)).select("word", "right", "part", "good").distinct(), "neighbours")
    held = right.groupBy("good").agg(F.count_distinct("right").alias("held"))

    def shared(df: DataFrame) -> DataFrame:
        seen = df.groupBy("part", "good").agg(F.count_distinct("right").alias("seen")).where(F.col("seen") >= LEARN_WORDS)
        return seen.join(held, "good").withColumn("share", F.col("seen") / F.col("held")).where(F.col("seen") >= LEARN_SHARE * F.col("held")).select("part", "good", "share")

    places = F.reverse("part") == F.col("good")
    first = places | F.concat_ws(" ", "part", "good").isin([f"{w} {r}" for w, r in CONFUSIONS])
    explained = pairs.join(shared(pairs), ["part", "good"], "left").where(first | F.col("share").isNotNull())
    best = Window.partitionBy("word").orderBy(first.desc(), F.desc_nulls_last("share"), F.length("part") + F.length("good"), "part", "good")
    found = shared(explained.withColumn("k", F.rank().over(best)).where("k = 1").select("word", "right", "part", "good"))
    out = work_table(found.where(~places).select(F.col("part").alias("wrong"), F.col("good").alias("right")), "confusions")
    drop_table(pairs)
    return out


def learned_confusions(words: DataFrame, least: int = LEARN_COUNT, ratio: int = RATIO) -> list[tuple[str, str]]:
    """The rows of :func:`confusion_table`, sorted."""
    return sorted((r.wrong, r.right) for r in confusion_table(words, least, ratio).collect())


def _latin(words: DataFrame) -> DataFrame:
    return words.where(rf"length(word) BETWEEN {SHORTEST - 1} AND 40 AND word RLIKE '^[0-9@|!$a-zß-öø-ɏ]+$'")


def corrections(words: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO, confusions: tuple[tuple[str, str], ...] = CONFUSIONS, learned: DataFrame | None = None) -> DataFrame:
    """``(wrong, right, changes)``: each rare word's best correction.

    Ranked by fewest confusions, then by the frequency of the word it becomes, then by that word.
    ``learned`` has ``(wrong, right)`` of more confusions. The confusions are a table that a word's
    parts are joined with, twice for two of them; neither they nor their pairs are in the plan.
    """
    spark = words.sparkSession
    latin = _latin(words).withColumn("value", anagram_value(F.col("word")))
    frequent = latin.where((F.col("n") >= least) & F.col("word").rlike("^[^0-9@|!$]+$")).select(F.col("word").alias("right"), F.col("n").alias("many"), (F.col("capital") / F.col("n")).alias("right_capital"), "value")
    rare = latin.where(f"length(word) >= {SHORTEST}").select(F.col("word").alias("wrong"), "n", (F.col("capital") / F.col("n")).alias("capital"), "value")
    table = spark.createDataFrame([(k, w, r) for k, (w, r) in enumerate(confusions)], "place int, w string, r string")
    if learned is not None:
        more = learned.toDF("w", "r").join(table, ["w", "r"], "left_anti")
        table = table.unionByName(more.select(F.lit(len(confusions)).alias("place"), "w", "r"))
    table = work_table(table.withColumn("step", anagram_value(F.col("r")) - anagram_value(F.col("w"))), "confusions")
    size = table.agg(F.count(F.lit(1)), F.max(F.length("w"))).first()

    def shift(df: DataFrame, times: int) -> DataFrame:
        """Each row with every confusion of which its word holds the wrong characters."""
        parts = F.expr(f"explode(array_distinct(flatten(transform(sequence(1, least({size[1] or 1}, length(wrong))), k -> transform(sequence(1, length(wrong) - k + 1), i -> substring(wrong, i, k))))))")
        steps = table.toDF(*[f"{c}{times}" for c in ("place", "part", "r", "step")])
        return df.withColumn(f"part{times}", parts).join(F.broadcast(steps) if size[0] <= BROADCAST_WORDS else steps, f"part{times}")

    once = shift(rare, 1)
    order = lambda k: F.struct(F.col(f"place{k}").alias("place"), F.col(f"part{k}").alias("w"), F.col(f"r{k}").alias("r"))
    twice = shift(once.where(f"length(wrong) >= {SHORTEST_TWICE}"), 2).where(order(1) <= order(2))
    shifted = once.select("wrong", "n", "capital", F.array("part1").alias("w"), F.array("r1").alias("r"), F.lit(1).alias("changes"), (F.col("value") + F.col("step1")).alias("value"))
    shifted = shifted.unionByName(twice.select("wrong", "n", "capital", F.array("part1", "part2").alias("w"), F.array("r1", "r2").alias("r"), F.lit(2).alias("changes"), (F.col("value") + F.col("step1") + F.col("step2")).alias("value")))
    hits = shifted.join(frequent, "value").where((F.col("many") >= F.col("n") * ratio) & (F.col("wrong") != F.col("right")))
    # misreading keeps the case: what is mostly capitalised, unlike its correction, is a name
    hits = hits.where(~((F.col("capital") > NAME) & (F.col("right_capital") < ORDINARY)))
    # on the strings: the confusions, at some places, make one of the other
    verified = hits.where(_reaches(F.col("wrong"), F.col("right"), F.col("w"), F.col("r"), F.col("changes")))
    rank = Window.partitionBy("wrong").orderBy("changes", F.desc("many"), "right")
    return verified.withColumn("k", F.row_number().over(rank)).where("k = 1").select("wrong", "right", "changes")


def _replaced(s: Column, wrong: Column, right: Column) -> Column:
    """All strings that one replacement of ``wrong`` in ``s`` by ``right`` gives."""
    places = F.filter(F.sequence(F.lit(1), F.length(s)), lambda p: F.substring(s, p, F.length(wrong)) == wrong)
    return F.transform(places, lambda p: F.concat(F.substring(s, F.lit(1), p - 1), right, F.substring(s, p + F.length(wrong), F.length(s))))


def _reaches(s: Column, goal: Column, w: Column, r: Column, changes: Column) -> Column:
    once = _replaced(s, w[0], r[0])
    return F.when(changes == 1, F.array_contains(once, goal)).otherwise(F.exists(once, lambda x: F.array_contains(_replaced(x, w[1], r[1]), goal)))


def _bit(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % FILTER_BITS


def _filter(words: DataFrame) -> bytes:
    """A bit for each word of the only column."""
    return bit_filter(words, lambda column: np.fromiter(map(_bit, column.to_pylist()), np.uint64, len(column)), FILTER_BITS)


class _Known:
    """Is a word in a filter? Answers are remembered."""

    def __init__(self, bits: bytes):
        self.bits, self.seen = bits, {}

    def __call__(self, word: str) -> bool:
        if word not in self.seen:
            if len(self.seen) >= FLUSH:
                self.seen.clear()
            k = _bit(word)
            self.seen[word] = bool(self.bits[k >> 3] >> (7 - (k & 7)) & 1)
        return self.seen[word]

    def header(self, line: str) -> bool:
        return any(self("\n" + s) for s in shapes(line))


def _whole_words(text: str) -> list[str]:
    """The words of a text, lower-cased, without those at its ends that may be cut.

    A text that begins with a small letter may begin within a word, one that ends with a letter or
    digit may end within one.
    """
    found = _WORD.findall(text.lower())
    begin, end = text[:1].islower(), text[-1:].isalnum()
    return found[int(begin) : len(found) - int(end)]


def scan_noise(texts: DataFrame, titles: DataFrame | None = None, id_col: str = "chunkId", owner: str = "docId", text: str = "chunkText") -> tuple[DataFrame, DataFrame]:
    """``(noise, repaired)``: ``(id, kind)`` and ``(id, text)``.

    ``texts`` has one row per id; ``titles`` has ``(owner, title)``, one row per owner, as a
    document's title may be its running header. kind is 'hyphen', 'chars', 'header' or 'page_no',
    one row each. Repaired are the rows with noise: edge lines are gone, divided words joined,
    words corrected, lines joined. Null and empty texts have no noise; rows with a null id are
    left out.
    """
    spark = texts.sparkSession
    src = texts.select(F.col(id_col).cast("string").alias("id"), F.col(owner).alias("owner"), F.col(text).alias("text")).where("id IS NOT NULL AND length(text) > 0")
    if titles is None:
        src = src.withColumn("title", F.lit(None).cast("string"))
    else:
        # a document may hold very many of the rows; its title is compared with lines
        src = spread_join(src, titles.toDF("owner", "title").withColumn("title", F.substring("title", 1, 400)), ["owner"], "id", "left")
    rows = work_table(src.select("id", "title", "text"), "texts")
    # copies of a text count once: a misread word in one doesn't become frequent
    words = work_table(vocabulary(rows.select("text").distinct(), "text"), "words")
    fixes = work_table(corrections(words, learned=confusion_table(words)), "corrections")
    # two filters of FILTER_BITS / 8 bytes
    shared = spark.sparkContext.broadcast((_filter(fixes.select("wrong")), _filter(header_shapes(words))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, shape = map(_Known, shared.value)
        for batch in batches:
            out = []
            for i, title, t in zip(*(c.to_pylist() for c in batch.columns)):
                lines = t.split("\n")
                kind = edge_lines(lines, title, shape.header)
                found = {k for k in kind if k}
                hints = [(k, "", "", "") for k in ("header", "page_no") if k in found or "both" in found]
                splits = divided(lines, kind) if len(lines) > 1 else []
                hints += [("hyphen", a, m, b) for _, _, a, m, b in splits]
                # a break that is lost shows up in any layout
                hints += [("lost", a, m, b) for line in lines for _, _, a, m, b in lost_breaks(line)]
                hints += [("chars", w, "", "") for w in set(_whole_words(t)) if maybe(w)]
                out += [(i, *h) for h in hints]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(5)], ["id", "kind", "a", "mark", "b"])

    hints = work_table(rows.mapInArrow(look, "id string, kind string, a string, mark string, b string"), "hints")
    lines = hints.where("kind IN ('header', 'page_no')").select("id", "kind")
    # a misread word may stand in very many copies
    chars = spread_join(hints.where("kind = 'chars'").select("id", F.col("a").alias("wrong")), fixes, ["wrong"], "id").select("id", "wrong", "right")
    cut = hints.where("kind IN ('hyphen', 'lost')").select("id", "kind", "mark", F.lower("a").alias("a"), F.lower("b").alias("b"))
    known = words.select("word", "n")
    cut = cut.join(known.toDF("whole", "n_whole"), F.concat("a", "b") == F.col("whole"), "left").join(known.toDF("dashed", "n_dashed"), F.concat_ws("-", "a", "b") == F.col("dashed"), "left")
    whole, dashed = F.coalesce("n_whole", F.lit(0)), F.coalesce("n_dashed", F.lit(0))
    # a plain hyphen needs evidence: the word is there without it, or nowhere with it
    noise = (F.col("mark") != "-") | F.when(F.col("kind") == "hyphen", dashed <= whole).otherwise((whole > 0) & (dashed <= whole))
    cut = cut.where(noise).select("id", "a", "b")
    found = lines.unionByName(cut.select("id", F.lit("hyphen").alias("kind"))).unionByName(chars.select("id", F.lit("chars").alias("kind"))).distinct()
    # A text's own fixes are no more than its words.
    per_text = (
        chars.select("id", F.struct(F.col("wrong").alias("k"), F.col("right").alias("v")).alias("fix"))
        .unionByName(cut.select("id", F.struct(F.concat_ws("\n", "a", "b").alias("k"), F.lit("").alias("v")).alias("fix")))
        .unionByName(lines.select("id", F.lit(None).cast("struct<k:string,v:string>").alias("fix")))
        .groupBy("id")
        .agg(F.collect_set("fix").alias("fixes"))
    )

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = _Known(shared.value[1])
        for batch in batches:
            texts_ = [repair(t, title, {f["k"]: f["v"] for f in fx}, shape.header) for title, t, fx in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_, pa.string())], ["id", "text"])

    repaired = rows.join(per_text, "id").select("id", "title", "text", "fixes").mapInArrow(mend, "id string, text string")
    return found, repaired


def repair(text: str, title: str | None, fixes: dict[str, str], header: Callable[[str], bool] = lambda line: False) -> str:
    """A text as one continuous paragraph, by the fixes found for it."""
    lines = text.split("\n")
    kind = edge_lines(lines, title, header)
    joins = {i for i, _, a, _, b in divided(lines, kind) if f"{a}\n{b}".lower() in fixes}
    parts: list[str] = []
    glue = False
    for i, line in enumerate(lines):
        if kind[i]:
            continue
        line = line.strip()
        if i in joins:
            line = line[:-1]
        parts.append(line if glue or not parts else " " + line)
        glue = i in joins
    out = "".join(parts)
    for a, b, left, _, right in reversed(lost_breaks(out)):
        if f"{left}\n{right}".lower() in fixes:
            out = out[:a] + left + right + out[b:]

    def correct(m: re.Match) -> str:
        new = fixes.get(m.group().lower())
        if not new:
            return m.group()
        return new.upper() if m.group().isupper() else new.capitalize() if m.group()[:1].isupper() else new

    return re.sub(r"[ \t]+", " ", _WORD.sub(correct, out)).strip()
