"""Languages of documents and of the passages of mixed ones, by rank-order profiles.

A language's profile is the list of its most frequent character n-grams, the most frequent
first. A sentence is ranked alike, and its distance to a profile is the sum of how far each of
its n-grams is out of place there. Characters are told apart by their code points, in any script.

Profiles are fitted on a bounded sample of the documents of each label. A label is a language,
however rare, if the profiles of one half of the sample place most of its documents of the other
half under it; labels that are wrong scatter over the languages their documents are in. Profiles
are then fitted anew on the documents that were placed under their own label. A sentence that is
far from all profiles is in none of these languages.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.sampling import hash_sample
from cairn.session import drop_table, work_table

#: n-grams of a profile; labelled documents of each label that profiles are fitted on, about.
PROFILE, TRAIN_ROWS = 400, 300
#: A label needs this share of its documents placed under it to be a language.
LEAST_KEPT = 0.5
#: A profile nearer than this to that of a more frequent label is the same language under another name.
TWIN = 0.15
#: A sentence of so many letters is in a known language if this share of its n-grams is in the profile;
#: shorter ones that lack it count together, if they are half of a text.
FAR_LETTERS, LEAST_KNOWN = 60, 0.68
#: Characters of sentences that make a passage count; letters that a sentence needs for its own verdict.
LEAST_CHARS, LEAST_LETTERS = 100, 15
#: Characters laid end to end for one round of sorting.
PIECE = 400_000
#: What a language is called that no profile is near to.
UNKNOWN = "und"

#: Two-letter code: three-letter codes and English name.
CODES = {
    "ar": "ara arabic", "bg": "bul bulgarian", "cs": "ces cze czech", "da": "dan danish", "de": "deu ger german", "el": "ell gre greek", "en": "eng english",
    "es": "spa spanish", "fi": "fin finnish", "fr": "fra fre french", "he": "heb hebrew", "hi": "hin hindi", "hu": "hun hungarian", "it": "ita italian",
    "ja": "jpn japanese", "ko": "kor korean", "nl": "nld dut dutch", "no": "nor norwegian", "pl": "pol polish", "pt": "por portuguese", "ro": "ron rum romanian",
    "ru": "rus russian", "sv": "swe swedish", "tr": "tur turkish", "uk": "ukr ukrainian", "zh": "zho chi chinese",
}
#: Labels that name no language.
PLACEHOLDERS = ("", "unknown", "und", "n/a", "na", "none", "null", "xx", "mul", "zxx", "-", "?")
#: Where a sentence may end: its mark, closing quotes, blanks, and a beginning.
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+(?=[^\W\d_a-zà-öø-ÿ]|[\d\"'«“„(¿¡\[])|\n\s*\n\s*")


def label_code(label: Column) -> Column:
    """The two-letter code that a label spells in any way; null for placeholders and the unknown.

    A code of two letters that isn't listed stands for itself.
    """
    names = {c: c for c in CODES} | {x: c for c, xs in CODES.items() for x in xs.split()}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    low = F.lower(F.trim(label))
    first = F.regexp_extract(low, r"^([a-z]+)[-_ ].*", 1)
    code = F.regexp_extract(low, r"^([a-z]{2})(?:[-_ ].*)?$", 1)
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, first), F.when(~low.isin(*PLACEHOLDERS) & ~code.isin(*PLACEHOLDERS), code))


#: Code points, and one more than their number: the radix of an n-gram's code.
_POINTS, _RADIX = 0x110000, 0x110001
_BIGRAM, _UNIGRAM = _RADIX**3, _RADIX**3 + _RADIX**2


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_POINTS)), bool, _POINTS)


def _points(text: str) -> np.ndarray:
    """Code points of a text, 0 for what is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[points], points, 0).astype(np.int64)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def sentences(text: str) -> list[tuple[int, int]]:
    """Half-open ranges of a text's sentences, without the blanks between them."""
    out, at = [], 0
    for m in _END.finditer(text):
        end = m.start() + len(m.group().rstrip())
        if end > at:
            out.append((at, end))
        at = m.end()
    if at < len(text):
        end = at + len(text[at:].rstrip())
        if end > at:
            out.append((at, end))
    return out


def _grams(text: str) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 whose middle, or only, character is a letter."""
    c = np.concatenate([[0], _points(text), [0]])
    one = np.flatnonzero(c)
    left, mid, right = c[one - 1], c[one], c[one + 1]
    return np.concatenate([_UNIGRAM + mid, _BIGRAM + mid * _RADIX + right, (left * _RADIX + mid) * _RADIX + right])


def _characters(gram: int) -> tuple[int, ...]:
    """The code points of an n-gram."""
    if gram >= _UNIGRAM:
        return (gram - _UNIGRAM,)
    if gram >= _BIGRAM:
        return divmod(gram - _BIGRAM, _RADIX)
    return (*divmod(gram // _RADIX, _RADIX), gram % _RADIX)


class Profiles:
    """Profiles of some languages; ``names`` has one more, that of what is near to none."""

    def __init__(self, languages: list[str], ranked: list[list[int]]):
        self.languages, self.ranked, self.size = languages, ranked, PROFILE
        self.names = [*languages, UNKNOWN]
        self._ready = False

    def __getstate__(self):
        return {"languages": self.languages, "ranked": self.ranked}

    def __setstate__(self, state):
        self.__init__(**state)

    def _prepare(self) -> None:
        """Tables from characters to the vocabulary of all profiles, level by level."""
        grams: dict[int, int] = {}
        for k in range(PROFILE):  # the order of the vocabulary: frequent ones first
            for r in self.ranked:
                if k < len(r):
                    grams.setdefault(r[k], len(grams))
        spelled = {g: _characters(g) for g in grams}
        alphabet = sorted({c for cs in spelled.values() for c in cs if c})
        wide = len(alphabet) + 2  # and what is no letter, and letters that no profile has
        self.classes = np.where(_letters(), wide - 1, 0).astype(np.uint16)
        self.classes[alphabet] = np.arange(1, wide - 1)
        own = {0: 0} | {c: i for i, c in enumerate(alphabet, 1)}
        self.one, self.two = np.full(wide, -1, np.int32), np.full((wide, wide), -1, np.int32)
        self.begin = np.zeros((wide, wide), np.int32)
        starts = sorted({(own[cs[0]], own[cs[1]]) for cs in spelled.values() if len(cs) == 3})
        for i, at in enumerate(starts, 1):
            self.begin[at] = i
        self.three = np.full((len(starts) + 1, wide), -1, np.int32)
        for g, i in grams.items():
            cs = [own[c] for c in spelled[g]]
            if len(cs) == 1:
                self.one[cs[0]] = i
            elif len(cs) == 2:
                self.two[cs[0], cs[1]] = i
            else:
                self.three[self.begin[cs[0], cs[1]], cs[2]] = i
        self.ranks = np.full((len(self.languages), max(1, len(grams))), PROFILE, np.int32)
        for lang, r in enumerate(self.ranked):
            for k, g in enumerate(r[:PROFILE]):
                self.ranks[lang, grams[g]] = k
        self._ready = True

    def _found(self, text: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where a text's letters are, and the number in the vocabulary, or -1, of the 1-, 2- and 3-gram there."""
        c = np.concatenate([[0], self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], [0]])
        one = np.flatnonzero(c)
        left, mid, right = c[one - 1], c[one], c[one + 1]
        return one - 1, [self.one[mid], self.two[mid, right], self.three[self.begin[left, mid], right]]

    def distances(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each part of a lower-cased text, the parts beginning at ``starts``: the mean
        out-of-place distance to every profile, as a share of the largest; its letters; and
        the share of its n-grams that are in the nearest profile."""
        if not self._ready:
            self._prepare()
        parts, v = len(starts), self.ranks.shape[1]
        at, found = self._found(text)
        part_of = np.repeat(np.arange(parts, dtype=np.int64), np.diff(np.append(starts, len(text))))[at]
        letters = np.bincount(part_of, minlength=parts)
        keys = [part_of[g >= 0] * v + g[g >= 0] for g in found]
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        out = np.ones((parts, len(self.languages)))
        if not len(key):
            return out, letters, np.zeros(parts)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        part, gram = np.divmod(key[first], v)
        # the ranks of a part: by count, then by the vocabulary's order
        order = np.sort((part * (1 << 20) + (1 << 20) - 1 - np.minimum(count, (1 << 20) - 1)) * v + gram)
        gram = order % v
        part = (order // v) >> 20
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        rank = np.arange(len(part)) - np.repeat(begin, np.diff(np.append(begin, len(part))))
        n = np.diff(np.append(begin, len(part)))
        for lang, ranks in enumerate(self.ranks):
            place = ranks[gram]
            off = np.where(place == self.size, self.size, np.minimum(np.abs(place - rank), self.size))
            out[part[begin], lang] = np.add.reduceat(off, begin) / (n * self.size)
        nearest, known = out.argmin(axis=1), np.zeros(parts)
        for g in found:
            hit = np.flatnonzero(g >= 0)
            own = part_of[hit]
            known += np.bincount(own[self.ranks[nearest[own], g[hit]] < self.size], minlength=parts)
        return out, letters, known / (3 * np.maximum(letters, 1))

    def verdicts(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """For each text the sentences ``(start, end, language, confidence)``, the language by its
        place in ``names``; a text without letters has none. Sentences too short for a verdict of
        their own take their neighbour's."""
        spans = [sentences(t) for t in texts]
        joined, starts = [], []
        at = 0
        for t, ss in zip(texts, spans):
            low = _lower(t)
            for a, b in ss:
                joined.append(low[a:b])
                starts.append(at)
                at += b - a + 1
        if not joined:
            return [[] for _ in texts]
        dist, letters, known = self.distances("\n".join(joined), np.array(starts))
        order = np.argsort(dist, axis=1, kind="stable")
        best = order[:, 0]
        rows = np.arange(len(dist))
        low_, next_ = dist[rows, best], dist[rows, order[:, min(1, dist.shape[1] - 1)]]
        sure = np.where(next_ > 0, 1 - low_ / np.maximum(next_, 1e-9), 0.0)
        verdict = np.where((letters >= LEAST_LETTERS) & (low_ < 1), best, -1)
        count = np.array([len(ss) for ss in spans])
        text_of = np.repeat(np.arange(len(texts)), count)
        doubtful = (letters >= LEAST_LETTERS) & (known < LEAST_KNOWN)
        odd, all_ = (np.bincount(text_of, weights=w, minlength=len(texts)) for w in (letters * doubtful, letters))
        together = doubtful & ((odd >= FAR_LETTERS) & (2 * odd >= all_))[text_of]
        verdict[doubtful & (letters >= FAR_LETTERS) | together | (letters >= LEAST_LETTERS) & (low_ >= 1)] = len(self.languages)
        out, k = [], 0
        for ss in spans:
            own = []
            for a, b in ss:
                own.append([a, b, int(verdict[k]), float(sure[k])])
                k += 1
            last = next((x[2] for x in own if x[2] >= 0), -1)
            for x in own:
                if x[2] < 0:
                    x[2] = last
                last = x[2]
            out.append([tuple(x) for x in own if x[2] >= 0])
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(code, half, gram, n)`` over ``(code, half, text)``."""
    for batch in batches:
        texts: dict[tuple[str, int], list[str]] = {}
        for code, half, text in zip(*(c.to_pylist() for c in batch.columns)):
            texts.setdefault((code, half), []).append(_lower(text))
        for (code, half), parts in texts.items():
            g, n = np.unique(_grams("\n".join(parts)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([code] * len(g), pa.string()), pa.array(np.full(len(g), half, np.int32)), pa.array(g), pa.array(n)], ["code", "half", "gram", "n"])


def _profiles(sample: DataFrame, halves: tuple[int, ...]) -> list[Profiles]:
    """Profiles of each half of a sample ``(code, half, text)``, on the driver: PROFILE rows a language."""
    counts = sample.select("code", "half", "text").mapInArrow(_count, "code string, half int, gram long, n long").groupBy("code", "half", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("code", "half").orderBy(F.desc("n"), "gram"))
    top: dict[tuple[int, str], list[int]] = {}
    for r in sorted(counts.withColumn("r", rank).where(F.col("r") <= PROFILE).collect(), key=lambda r: r.r):
        top.setdefault((r.half, r.code), []).append(r.gram)
    out = []
    for h in halves:
        languages = sorted(c for half, c in top if half == h)
        out.append(Profiles(languages, [top[h, c] for c in languages]))
    return out


def apart(a: list[int], b: list[int]) -> float:
    """Out-of-place distance of two profiles, as a share of the largest."""
    place = {g: k for k, g in enumerate(b[:PROFILE])}
    return sum(min(abs(place[g] - k), PROFILE) if g in place else PROFILE for k, g in enumerate(a[:PROFILE])) / (PROFILE * max(1, len(a[:PROFILE])))


def fit(documents: DataFrame, id_col: str = "docId", text: str = "text", label: str = "language", rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles of the languages that labels name, from about ``rows`` labelled documents of each.

    Of repeated rows of an id one counts. A label that a single document bears can't be confirmed
    and has no profile; documents in a language without one are left without a verdict.
    """
    labelled = documents.select(F.col(id_col).alias("id"), label_code(F.col(label)).alias("code"), F.col(text).alias("text")).where("id IS NOT NULL AND code IS NOT NULL AND length(text) >= 200")
    some = hash_sample(labelled, "id", rows, "code").groupBy("id").agg(F.max(F.struct("code", "text")).alias("r"))
    place = F.row_number().over(Window.partitionBy("r.code").orderBy(F.xxhash64("id"), "id"))  # over a sample
    sample = work_table(some.select("id", F.col("r.code").alias("code"), F.col("r.text").alias("text"), (place % 2).cast("int").alias("half")).repartition(8), "labelled")
    halves = _profiles(sample, (0, 1))
    # the same language under a second name: the name that fewer documents bear goes
    names = {r[0]: r[1] for r in labelled.groupBy("code").count().collect()}
    order = sorted(names, key=lambda c: (-names[c], c))
    ranked = [dict(zip(h.languages, h.ranked)) for h in halves]
    twin = lambda a, b: any(a in r and b in r and apart(r[a], r[b]) < TWIN for r in ranked)
    good: list[str] = []
    for c in order:
        if not any(twin(c, x) for x in good):
            good.append(c)
    halves = [Profiles([c for c in h.languages if c in good], [r[c] for c in h.languages if c in good]) for h, r in zip(halves, ranked)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, texts, half = (c.to_pylist() for c in batch.columns)
            own = np.zeros(len(codes), bool)
            for h in (0, 1):
                judge, mine = halves[1 - h], [i for i, x in enumerate(half) if x == h]
                for i, spans in zip(mine, judge.verdicts([texts[i] for i in mine]) if judge.languages else []):
                    weight = np.zeros(len(judge.names))
                    for a, b, lang, _ in spans:
                        weight[lang] += b - a
                    own[i] = bool(weight.any()) and judge.names[int(weight.argmax())] == codes[i]
            yield batch.filter(pa.array(own))

    kept = work_table(sample.mapInArrow(keep, sample.schema), "kept")
    counted = {r[0]: r[1] for r in sample.groupBy("code").count().collect()}
    left = {r[0]: r[1] for r in kept.groupBy("code").count().collect()}
    languages = [c for c, n in left.items() if n >= LEAST_KEPT * counted[c]]
    out = _profiles(kept.where(F.col("code").isin(languages)).withColumn("half", F.lit(0)), (0,))[0] if languages else Profiles([], [])
    drop_table(sample)
    drop_table(kept)
    return out


def passages(texts: DataFrame, profiles: Profiles, id_col: str, owner: str, text: str) -> DataFrame:
    """``(id, owner, segments, chars)`` of every row.

    ``segments`` are the runs of sentences in one language, ``array<struct<start, end, lang,
    confidence>>`` in code points of the text, 'und' where no profile is near; ``chars`` maps a language to the characters of its
    sentences. Null, empty and letterless texts have none. Rows with a null id are left out.
    """
    src = texts.select(F.col(id_col).alias("id"), F.col(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id IS NOT NULL")
    shared = texts.sparkSession.sparkContext.broadcast(profiles)  # PROFILE n-grams a language
    segment = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            ids, owners, texts_ = (c.to_pylist() for c in batch.columns)
            at = size = 0
            for i, t in enumerate(texts_):
                size += len(t)
                if size < PIECE and i < len(texts_) - 1:
                    continue
                segments, chars = [], []
                for spans in p.verdicts(texts_[at : i + 1]) if p.languages else [[]] * (i + 1 - at):
                    runs: list[list] = []
                    total: dict[str, int] = {}
                    for a, b, lang, sure in spans:
                        name = p.names[lang]
                        total[name] = total.get(name, 0) + b - a
                        if runs and runs[-1][2] == name:
                            r = runs[-1]
                            r[3] += sure * (b - a)
                            r[4] += b - a
                            r[1] = b
                        else:
                            runs.append([a, b, name, sure * (b - a), b - a])
                    segments.append([{"start": r[0], "end": r[1], "lang": r[2], "confidence": round(r[3] / r[4], 4)} for r in runs])
                    chars.append(list(total.items()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : i + 1], pa.string()), pa.array(owners[at : i + 1], pa.string()), pa.array(segments, pa.list_(segment)), pa.array(chars, pa.map_(pa.string(), pa.int32()))], ["id", "owner", "segments", "chars"])
                at, size = i + 1, 0

    return src.select(F.col("id").cast("string"), F.col("owner").cast("string"), "text").mapInArrow(run, "id string, owner string, segments array<struct<start:int,end:int,lang:string,confidence:double>>, chars map<string,int>")


def document_languages(found: DataFrame) -> DataFrame:
    """``(owner, lang, confidence)``: the language most characters of an owner's rows are in, and
    its share of them. Equal shares go to the code that sorts first. 'und' is what no profile is
    near to."""
    chars = found.where("owner IS NOT NULL").select("owner", F.explode("chars").alias("lang", "n")).groupBy("owner", "lang").agg(F.sum("n").alias("n"))
    best = chars.groupBy("owner").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("b"), F.sum("n").alias("all"))
    return best.select("owner", F.col("b.lang").alias("lang"), (-F.col("b.n") / F.col("all")).alias("confidence"))


def mislabelled(documents: DataFrame, found: DataFrame, id_col: str = "docId", label: str = "language") -> DataFrame:
    """``(id, label, lang, confidence)``: documents whose label is missing or names another language.
    Where the text is in no known language, nothing is said against the label."""
    labels = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("owner"), F.col(label).alias("label"))
    joined = labels.join(document_languages(found).where(F.col("lang") != UNKNOWN), "owner")
    return joined.where(~label_code(F.col("label")).eqNullSafe(F.col("lang"))).select(F.col("owner").alias("id"), "label", "lang", "confidence")


def mixed(found: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``(id, lang, chars)``: rows with at least ``least`` characters in two or more known languages."""
    many = F.map_filter("chars", lambda k, n: (n >= least) & (k != UNKNOWN))
    return found.where(F.size(many) > 1).select("id", F.explode(many).alias("lang", "chars"))
