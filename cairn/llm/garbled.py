"""Garbled text from a wrong character encoding.

Text that was written in one encoding and read in another shows up in the words that hold
characters beyond ASCII. Every such word has, for each chain of encode and decode that turns it
into other text, a possible original. Character n-gram models of clean records score the word and
its candidates; the likeliest candidate is accepted if it beats the word by more than a margin
that is validated on clean words and on clean words garbled on purpose. A replacement character
is a garbled sequence whose original can't be restored.
"""

from __future__ import annotations

import codecs
import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cairn.session import drop_table, work_table

#: Longest n-gram, slots of each order's table of counts (a bound on the model's size), smoothing.
ORDER, SLOTS, WEIGHT = 4, 1 << 18, 0.7
#: Encodings a text may have been read in by mistake, and those it may have been written in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")
WRITTEN_IN = ("utf-8", "cp1252", "mac_roman", "cp850", "cp437", "cp1251")
#: Times a text may have gone through the same mistake.
TWICE = 2
#: ASCII letters, or letters of the original's own script, that a word needs to show a mistake
#: between single-byte encodings.
LEAST_LETTERS, LEAST_FOREIGN = 2, 3
#: A text needs so many different words that only another script explains, to be garbled without
#: the model knowing that script.
LEAST_SCRIPT = 2
#: Gain beyond which a word is left out of the clean ones before the model is counted again.
CLEAN_GAIN = 4.0
#: A word is left out as well if a possible original has this many times its count.
BROADER = 6
#: The margins tried; false alarms allowed among clean words; words that a task of validation judges.
MARGINS, FALSE_RATE, TASK_WORDS = (4.0, 5.0, 6.0, 8.0, 10.0, 12.0), 0.0005, 200
#: The mistakes, as (read as, written in), that clean words are garbled by for validation.
ON_PURPOSE = (("cp1252", "utf-8"), ("mac_roman", "cp1252"), ("cp850", "utf-8"), ("cp1251", "cp1252"))
#: Log-odds for a chain that ends in UTF-8: bytes that aren't UTF-8 are seldom valid as such.
VALID = 4.0
#: A word as the model sees it: no ASCII white space, at least one character beyond ASCII.
TOKEN = re.compile(r"[^\x00-\x20\x7f]*[^\x00-\x7f][^\x00-\x20\x7f]*")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOST = "�"
#: A word of Cyrillic letters in the case of running text.
_CYRILLIC_WORD = re.compile("[А-ЯЁ]?[а-яё]{3,}")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_VOWEL, _CONSONANT = re.compile("[аеёиоуыэюя]", re.I), re.compile("[б-джзй-нп-тф-щ]", re.I)
#: Control characters that no text has; U+0085 may be a line break.
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_CACHE = 200_000


@functools.cache
def _table(encoding: str) -> str:
    """The 256 characters of an encoding; bytes that it leaves undefined stand for themselves."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@functools.cache
def _to_bytes(encoding: str):
    return codecs.charmap_build(_table(encoding))


def repair(text: str, read_as: str, written_in: str) -> str | None:
    """What ``text`` was, had it been written in one encoding and read in another; None: it wasn't."""
    try:
        raw = codecs.charmap_encode(text, "strict", _to_bytes(read_as))[0]
        out = raw.decode("utf-8") if written_in == "utf-8" else codecs.charmap_decode(raw, "strict", _table(written_in))[0]
    except UnicodeError:
        return None
    return None if out == text else out


def garble(text: str, written_in: str, read_as: str) -> str | None:
    """The reverse, for validation; None if the encodings don't have the characters."""
    try:
        return codecs.charmap_decode(text.encode(written_in), "strict", _table(read_as))[0]
    except UnicodeEncodeError:
        return None


@functools.cache
def chains() -> tuple[tuple[str, str], ...]:
    return tuple((r, w) for w in WRITTEN_IN for r in READ_AS if r != w)


def candidates(word: str) -> dict[str, str]:
    """Possible original -> the chain that gives it."""
    out: dict[str, str] = {}
    for r, w in chains():
        now = word
        for times in range(1, TWICE + 1):
            now = repair(now, r, w)
            if now is None or not any(c > "\x7f" for c in now):
                if now is not None:
                    out.setdefault(now, f"{r}>{w}" + f"x{times}" * (times > 1))
                break
            if any("\x7f" <= c < "\xa0" for c in now) and w != "utf-8":
                break  # control characters are no text
            out.setdefault(now, f"{r}>{w}" + f"x{times}" * (times > 1))
            if w != "utf-8":
                break
    out.pop(word, None)
    return out


def another_script(word: str, original: str) -> bool:
    """Is ``original`` a Cyrillic word where ``word`` holds no letter of ASCII or Cyrillic?

    Four letters in a row with accents, and none without, that make such a word in another encoding
    are hardly ever meant.
    """
    if any(c.isascii() and c.isalpha() for c in word) or _CYRILLIC.search(word):
        return False
    return bool(_CYRILLIC_WORD.fullmatch(original) and _VOWEL.search(original) and _CONSONANT.search(original))


def suspicious(word: str) -> bool:
    """Clean words hardly ever are valid UTF-8, or words of another script, under another encoding."""
    if any(repair(word, r, "utf-8") is not None for r in READ_AS):
        return True
    if any(c.isascii() and c.isalpha() for c in word):
        return False
    others = (repair(word, r, "cp1251") for r in READ_AS if r != "cp1251")
    return any(x is not None and another_script(word, x) for x in others)


def _slots(word: str) -> Iterator[tuple[int, int]]:
    """``(order, slot)`` of every n-gram of a word between its edges."""
    s = "\x02" + word.casefold() + "\x03"
    for i in range(1, len(s)):
        for n in range(1, ORDER + 1):
            if i - n + 1 >= 0:
                yield n, zlib.crc32(s[i - n + 1 : i + 1].encode("utf-8", "replace")) % SLOTS


class Model:
    """Interpolated character n-grams; an n-gram's context is counted as the sum over its n-grams."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # [ORDER + 1, SLOTS]; row 0 unused
        self.total = max(1.0, float(counts[1].sum()))
        self.known: dict[str, float] = {}

    def score(self, word: str) -> float:
        """Log-likelihood of the word."""
        if word in self.known:
            return self.known[word]
        s = "\x02" + word.casefold() + "\x03"
        out, c = 0.0, self.counts
        for i in range(1, len(s)):
            p = (c[1][zlib.crc32(s[i].encode("utf-8", "replace")) % SLOTS] + 0.01) / (self.total + 1000)
            for n in range(2, ORDER + 1):
                if i - n + 1 < 0:
                    break
                gram = s[i - n + 1 : i + 1]
                context = c[n - 1][zlib.crc32(gram[:-1].encode("utf-8", "replace")) % SLOTS] if gram[:-1] != "\x02" else self.total / 6
                seen = c[n][zlib.crc32(gram.encode("utf-8", "replace")) % SLOTS]
                # few sightings of the context say little: the weight grows with them
                weight = WEIGHT * context / (context + 3.0)
                p = weight * min(1.0, seen / max(context, 1.0)) + (1 - weight) * p
            out += math.log(p)
        if len(self.known) >= _CACHE:
            self.known.clear()
        self.known[word] = out
        return out

    def best(self, word: str) -> tuple[float, str, str]:
        """``(gain, original, chain)`` of the likeliest candidate; words of another script go first."""
        own = self.score(word)
        out, place = (-math.inf, "", ""), (False, -math.inf)
        for text, chain in candidates(word).items():
            gain = self.score(text) - own + VALID * (">utf-8" in chain)
            if (now := (another_script(word, text), gain)) > place:
                out, place = (gain, text, chain), now
        return out


def telling(word: str, chain: str, original: str) -> bool:
    """Can the word alone show that the chain happened?

    Valid UTF-8 is evidence in itself, and so are control characters. Between single-byte encodings
    there is else only the n-grams', which need letters: ASCII ones around the odd character, or an
    original of a script of its own. A lone symbol may be meant, however rare it is.
    """
    if ">utf-8" in chain or sum(c.isascii() and c.isalpha() for c in word) >= LEAST_LETTERS:
        return True
    if chain == "latin-1>cp1252":
        return _CONTROL.search(word) is not None and _CONTROL.search(original) is None
    return len(_CYRILLIC.findall(original)) >= LEAST_FOREIGN and not _CYRILLIC.search(word) and all(_CYRILLIC.match(c) for c in original if c.isalpha())


def _core(token: str) -> tuple[int, int]:
    """The part of a token without ASCII punctuation around it."""
    left = len(token) - len(token.lstrip(_EDGE))
    right = len(token.rstrip(_EDGE))
    return left, right


def _tokens(text: str) -> Iterator[tuple[int, int, str]]:
    for m in TOKEN.finditer(text):
        a, b = _core(m.group())
        if a < b:
            yield m.start() + a, m.start() + b, m.group()[a:b]


def _clean_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(origin, word, n)`` of ``(text, origin, copies)``: words beyond ASCII of clean records.

    Clean are those without a lost character whose words aren't mostly valid UTF-8, or words of
    another script, under another encoding. A few such words occur by chance; they don't count.
    """
    odd: dict[str, bool] = {}
    counts: Counter[tuple[int, str]] = Counter()

    def flush() -> pa.RecordBatch:
        origins, words = [o for o, _ in counts], [w for _, w in counts]
        out = pa.RecordBatch.from_arrays([pa.array(origins, pa.int64()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["origin", "word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text, origin, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if LOST in text:
                continue
            own = [w for _, _, w in _tokens(text)]
            for w in own:
                if w not in odd:
                    odd[w] = suspicious(w)
            good = [w for w in own if not odd[w]]
            if 2 * len(good) > len(own):
                for w in good:
                    counts[origin, w] += copies
            if len(odd) >= _CACHE:
                odd.clear()
        if len(counts) >= _CACHE:
            yield flush()
    yield flush()


def damped_words(documents: DataFrame, text: str, source: str | None) -> DataFrame:
    """``(word, n)`` of the clean words, where neither copies nor a source weigh by their number.

    All copies of a text belong to one of their sources, and a source's count of a word
    counts by its logarithm, in sixteenths, whose sums are exact. Without sources each text is one.
    """
    texts = documents.select(F.col(text).cast("string").alias("text"), F.xxhash64(source or text).alias("origin")).where(r"text RLIKE '[^\\x00-\\x7F]'")
    texts = texts.groupBy("text").agg(F.min("origin").alias("origin"), F.count(F.lit(1)).alias("copies"))
    own = texts.mapInArrow(_clean_words, "origin long, word string, n long").groupBy("origin", "word").agg(F.sum("n").alias("n"))
    return own.groupBy("word").agg(F.sum(1 + F.floor(16 * F.log2("n")) / 16).alias("n"))


def _ngram_counts(words: DataFrame) -> np.ndarray:
    """The model's table: at most ORDER * SLOTS numbers, whatever the corpus' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ORDER + 1, SLOTS))
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for o, s in _slots(w):
                    table[o, s] += n
        o, s = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(o * SLOTS + s, pa.int64()), pa.array(table[o, s])], ["slot", "n"])

    rows = words.select("word", "n").mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((ORDER + 1) * SLOTS, np.float32)
    table[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return table.reshape(ORDER + 1, SLOTS)


def margin_sums(counts: np.ndarray, clean: DataFrame) -> list[Row]:
    """``(margin, false, weight, found, garbled)``: what each margin does to the clean words, all of them.

    ``false`` of ``weight`` are false alarms, ``found`` of ``garbled`` the words garbled on purpose that
    are beyond the margin. The words are judged by the tasks; these sums come to the driver.
    """
    shared = clean.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, margins = Model(shared.value), np.array(MARGINS)
        sums = np.zeros((len(MARGINS), 4))
        for batch in batches:
            judged = [(w, n, *model.best(w)) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            gains = np.array([(gain, n) for w, n, gain, original, chain in judged if telling(w, chain, original)]).reshape(-1, 2)
            trial = [x for w, *_ in judged for r, wr in ON_PURPOSE if (x := garble(w, wr, r)) and x != w]
            found = np.array([model.best(x)[0] for x in trial])
            for k, m in enumerate(margins):
                sums[k] += gains[gains[:, 0] > m, 1].sum(), gains[:, 1].sum(), (found > m).sum(), len(found)
        yield pa.RecordBatch.from_arrays([pa.array(margins), *(pa.array(x) for x in sums.T)], ["margin", "false", "weight", "found", "garbled"])

    # the table is small and the work on a word is not
    spread = clean.select("word", "n").repartition(1 + clean.count() // TASK_WORDS, "word")
    rows = spread.mapInArrow(run, "margin double, false double, weight double, found double, garbled double")
    return rows.groupBy("margin").agg(*[F.sum(c).alias(c) for c in ("false", "weight", "found", "garbled")]).collect()


def validated_margin(sums: list[Row]) -> float:
    """The smallest margin with at most FALSE_RATE false alarms among clean words, by weight.

    Margins with equally few are told apart by the share found of the words garbled on purpose.
    """
    good = [r for r in sums if r["false"] <= FALSE_RATE * (r.weight or 1)]
    if not good:
        return MARGINS[-1]
    return max((round(r.found / max(1, r.garbled), 2), r.margin) for r in good)[1]


class Judge:
    def __init__(self, counts: np.ndarray, margin: float):
        self.model, self.margin = Model(counts), margin
        self.known: dict[str, tuple[float, str, str]] = {}

    def best(self, word: str) -> tuple[float, str, str]:
        if word not in self.known:
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[word] = self.model.best(word)
        return self.known[word]

    def fix(self, text: str) -> tuple[str, int, int, list[str]]:
        """``(restored, garbled sequences, those lost for good, chains)``."""
        if text.isascii():
            return text, 0, 0, []
        found = [(a, b, w, *self.best(w)) for a, b, w in _tokens(text) if LOST not in w]
        foreign = {(w, chain) for _, _, w, _, fixed, chain in found if another_script(w, fixed)}
        often = Counter(chain for _, chain in foreign)
        sure = {x[5] for x in found if x[3] > self.margin and telling(x[2], x[5], x[4])} | {c for c, n in often.items() if n >= LEAST_SCRIPT}
        # beside a sure case of a chain, any gain by the same chain will do
        taken = {k: (x[4], x[5]) for k, x in enumerate(found) if x[5] in sure and (x[3] > 0 or (x[2], x[5]) in foreign)}
        if sure & often.keys():
            self._between(text, found, taken)
        out, at, n = [], 0, 0
        for k in sorted(taken):
            a, b = found[k][:2]
            out += [text[at:a], taken[k][0]]
            at, n = b, n + 1
        lost = sum(LOST in w for _, _, w in _tokens(text))
        return "".join([*out, text[at:]]), n + lost, lost, sorted(sure)


    def _between(self, text: str, found: list[tuple], taken: dict[int, tuple[str, str]]) -> None:
        """Words too short to tell, next to words of another script, are of the same one."""
        for order in (range(1, len(found)), range(len(found) - 2, -1, -1)):
            for k in order:
                near = k - 1 if order.step > 0 else k + 1
                if k in taken or near not in taken or not all(map(_CYRILLIC.match, filter(str.isalpha, taken[near][0]))):
                    continue
                first, last = sorted((k, near))
                if any(c.isalpha() for c in text[found[first][1] : found[last][0]]):
                    continue
                fixed = repair(found[k][2], *taken[near][1].split(">"))
                if fixed and any(map(_CYRILLIC.match, fixed)) and all(map(_CYRILLIC.match, filter(str.isalpha, fixed))):
                    taken[k] = fixed, taken[near][1]


_READY: dict = {}


def fit(documents: DataFrame, text: str = "text", source: str | None = None) -> tuple[np.ndarray, float]:
    """The n-gram counts of the clean words of all records, and the validated margin.

    Records most of whose words are valid UTF-8, or of another script, under another encoding are
    left out at first;
    then the words with a far more frequent original; then those that the first model takes for
    garbled, and the model is counted again.
    """
    words = work_table(damped_words(documents, text, source), "words")

    def originals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(w, n, x) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x, chain in candidates(w).items() if telling(w, chain, x)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string()))], ["wrong", "n", "right"])

    pairs = words.mapInArrow(originals, "wrong string, n double, right string")
    frequent = words.select(F.col("word").alias("right"), F.col("n").alias("many"))
    garbled = pairs.join(frequent, "right").where(F.col("many") >= BROADER * F.col("n")).select(F.col("wrong").alias("word")).distinct()
    broad = work_table(words.join(garbled, "word", "left_anti"), "broad_words")
    first = words.sparkSession.sparkContext.broadcast(_ngram_counts(broad))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(first.value)
        for batch in batches:
            judged = [(w, *model.best(w)) for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array([gain <= CLEAN_GAIN or not telling(w, chain, original) for w, gain, original, chain in judged], pa.bool_()))

    clean = work_table(broad.mapInArrow(keep, "word string, n double"), "clean_words")
    counts = _ngram_counts(clean)
    margin = validated_margin(margin_sums(counts, clean))
    for table in (words, broad, clean):
        drop_table(table)
    return counts, margin


def restore(documents: DataFrame, id_col: str = "doc_id", text: str = "text", source: str | None = None, fitted: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """``(doc_id, restored, garbled, lost, chains)`` of the records with garbled text.

    ``garbled`` counts the sequences (words), ``lost`` those that hold a replacement character
    and keep it; the rest of the text is as it was. Null, empty and clean texts give no row; rows
    with a null id are left out; repeated rows give repeated rows. ``source`` names the column of
    a record's origin, if there is one.
    """
    counts, margin = fitted or fit(documents, text, source)
    shared = documents.sparkSession.sparkContext.broadcast((counts, margin))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).where(r"doc_id IS NOT NULL AND text RLIKE '[^\\x00-\\x7F]'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _READY.get("of") is not shared:
            _READY.update(of=shared, judge=Judge(*shared.value))
        judge = _READY["judge"]
        for batch in batches:
            out = [(i, *judge.fix(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            out = [x for x in out if x[2]]
            types = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["doc_id", "restored", "garbled", "lost", "chains"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, restored string, garbled int, lost int, chains array<string>")
