"""Languages of documents and of stretches in them, by rank-order n-gram profiles (problem 9).

A profile lists the most frequent character n-grams of a language in order of rank. A text is compared with it by the
out-of-place distance: over the text's own most frequent n-grams, how far each stands from its rank in the profile,
with the profile's length for those it lacks, divided by the greatest possible distance.

Profiles are trained on distinct labelled texts, at most ``SAMPLE_DOCS`` of a language, taken by hash. Labels may be wrong
and texts mixed, so they are trained twice: the first profiles mark the stretches of the sample, and the second are
made from the stretches that agree with their label.

Stretches are found word by word: a word's cost in a language is the mean place of its n-grams there, on a log scale;
the cheapest sequence of languages (Viterbi) pays for every change, less after a sentence's end. That places the cuts;
a stretch's language is the one whose profile is least out of place from it, and neighbours of one language are joined.

Defined results: null texts and texts without letters have no language and confidence 0; a label that names no known
language is missing. Texts of more than ``PIECE`` words are decoded in pieces of that size, cut at sentences where they
can be, and joined again; nothing is left out. Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarmill.functions.keys import strip
from sonarmill.llm.words import words_and_gaps
from sonarmill.session import cut_lineage, spread

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
#: Names of each language: ISO 639-1, ISO 639-2, English.
NAMES = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pt": ("pt", "por", "portuguese"),
    "ru": ("ru", "rus", "russian"),
}
SAMPLE_DOCS = 2000
PROFILE = 4000
TEXT_PROFILE = 300
SIZES = (1, 2, 3, 4)
PIECE = 4000
#: Texts that are judged at once, and words times texts that are decoded at once.
BATCH, BLOCK_CELLS = 1024, 200_000
#: Cost of a change of language inside a sentence and at its end, in units of a word's log place.
CHANGE, CHANGE_AT_END = 6.0, 2.0
_END = re.compile(r"[.!?;:\n()\"“”«»]")
_MARKUP = re.compile(r"<[!/]?[a-zA-Z][^<>]{0,300}>|&#?[a-zA-Z0-9]{1,10};|https?://\S+")


def label_language(label: Column | str) -> Column:
    """The two-letter code a label names; null where it is missing or names nothing known."""
    head = F.regexp_extract(F.lower(strip(label)), "^([a-z]+)(?:[-_].*)?$", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(head.isin(*names), code).otherwise(out)
    return out


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


class _Ends(dict):
    """Whether a sentence ends in a gap between words."""

    def __missing__(self, gap: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        self[gap] = out = bool(_END.search(gap))
        return out


_ENDS = _Ends()


def _words_and_ends(text: str | None) -> tuple[tuple[str, ...], list[bool]]:
    """Words, and of each whether a sentence ends after it. What is left of markup counts as a gap."""
    if not text:
        return (), []
    found = words_and_gaps(_MARKUP.sub(" ", text) if "<" in text or "&" in text or "http" in text else text)
    if not found:
        return (), []
    words, gaps = zip(*found, strict=True)
    return words, list(map(_ENDS.__getitem__, gaps))


def tokens(text: str | None) -> list[tuple[str, bool]]:
    return list(zip(*_words_and_ends(text), strict=True))


class _Words(dict):
    """A number for each word; what is known of it is worked out once."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> int:
        self[word] = out = self.learn(word)
        return out


class Profiles:
    """Rank-order profiles of several languages. N-grams are numbered, those of the profiles first, in order of their names.

    A worker keeps of each distinct word its cost in every language and the numbers of its n-grams, and counts n-grams of
    many stretches at once by sorting numbers.
    """

    def __init__(self, ranked: dict[str, list[str]]):
        self.languages = [x for x in sorted(ranked) if ranked[x]]
        known = sorted({g for x in self.languages for g in ranked[x][:PROFILE]})
        self.rows = {gram: i for i, gram in enumerate(known)}
        # the last row is that of n-grams that no profile has
        self.places = np.full((len(known) + 1, len(self.languages)), PROFILE, np.float64)
        for i, language in enumerate(self.languages):
            for place, gram in enumerate(ranked[language][:PROFILE]):
                self.places[self.rows[gram], i] = place
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = dict(self.rows)
        self.words = _Words(self._learn)
        self.costs = np.zeros((1024, len(self.languages)))
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(16_384, np.int64), 0

    def ranked(self) -> dict[str, list[str]]:
        grams = list(self.rows)
        return {x: [grams[g] for g in np.argsort(self.places[:-1, i], kind="stable") if self.places[g, i] < PROFILE] for i, x in enumerate(self.languages)}

    def forget(self, most: int = 500_000) -> None:
        """Drops what is known of words if that is much; numbers given before are then void."""
        if len(self.words) > most or len(self.numbers) - len(self.rows) > 4 * most:
            self._clear()

    def _learn(self, word: str) -> int:
        """The number of a new word. Words with digits belong to no language: they cost nothing and have no n-grams."""
        at = len(self.words)
        if at >= len(self.costs):
            self.costs, self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.costs, self.first, self.size))
        if any(c.isdigit() for c in word):
            return at
        own = [self.numbers.setdefault(g, len(self.numbers)) for g in grams(word)]
        if self.languages:
            costs = np.log1p(self.places[np.minimum(own, len(self.rows))]).mean(0)
            self.costs[at] = costs - costs.min()
        if word.isalpha():
            while self.used + len(own) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(own)] = own
            self.first[at], self.size[at] = self.used, len(own)
            self.used += len(own)
        return at

    def numbered(self, words) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def _grams(self, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``stretch, n-gram`` of every n-gram of the words, which belong to the stretches ``of``."""
        size = self.size[words]
        at = np.arange(size.sum()) + np.repeat(self.first[words] - (np.cumsum(size) - size), size)
        return np.repeat(of, size), self.flat[at]

    def counts(self, words: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs, by its number."""
        return np.bincount(self._grams(words, np.zeros(len(words), np.int64))[1], minlength=len(self.numbers))

    def distances(self, words: np.ndarray, of: np.ndarray, n: int, most: int = TEXT_PROFILE) -> np.ndarray:
        """Out-of-place distance, from 0 to 1, of each of ``n`` stretches' most frequent n-grams to every profile; 1 without n-grams.

        Of n-grams equally frequent those of the profiles come first, in order of their names.
        """
        out = np.ones((n, len(self.languages)))
        stretch, gram = self._grams(words, of)
        if not len(gram):
            return out
        many, top = len(self.numbers), 1 << 20
        code = stretch * many + gram
        code.sort()
        edge = np.flatnonzero(np.diff(code, prepend=-1))
        often = np.minimum(np.diff(np.append(edge, len(code))), top - 1)
        # n-grams of a stretch from the most frequent down
        order = (code[edge] // many * top + (top - 1 - often)) * many + code[edge] % many
        order.sort()
        stretch, gram = order // (many * top), order % many
        begin = np.flatnonzero(np.diff(stretch, prepend=-1))
        rank = np.arange(len(stretch)) - np.repeat(begin, np.diff(np.append(begin, len(stretch))))
        stretch, gram, rank = stretch[rank < most], gram[rank < most], rank[rank < most]
        places = self.places[np.minimum(gram, len(self.rows))]
        apart = np.where(places >= PROFILE, PROFILE, np.abs(places - rank[:, None]))
        begin = np.flatnonzero(np.diff(stretch, prepend=-1))
        held = np.diff(np.append(begin, len(stretch)))
        out[stretch[begin]] = np.add.reduceat(apart, begin, axis=0) / held[:, None] / PROFILE
        return out

    def decode(self, sentences: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The cheapest sequence of languages for each of several texts, given as numbers of words and ends of sentences."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(sentences)
        order = sorted(range(len(sentences)), key=lambda i: len(sentences[i][0]), reverse=True)
        while order:
            longest = len(sentences[order[0]][0])
            if not longest:
                break
            take = max(1, BLOCK_CELLS // longest)
            own, order = order[:take], order[take:]
            rows, ends = np.full((len(own), longest), -1), np.zeros((len(own), longest), bool)
            for k, i in enumerate(own):
                n = len(sentences[i][0])
                rows[k, :n], ends[k, :n] = sentences[i]
            costs = np.where((rows >= 0)[:, :, None], self.costs[rows], 0.0).transpose(1, 0, 2)
            price = np.where(ends, CHANGE_AT_END, CHANGE).T
            total = costs[0].copy()
            came = np.empty((longest, *total.shape), np.int8)
            stay, line = np.arange(total.shape[1], dtype=np.int8)[None, :], np.arange(len(own))
            for j in range(1, longest):
                best = total.argmin(1)
                change = (total[line, best] + price[j - 1])[:, None]
                moved = change < total
                came[j] = np.where(moved, best[:, None], stay)
                total = np.minimum(total, change) + costs[j]
            at = total.argmin(1)
            path = np.empty((longest, len(own)), np.int64)
            for j in range(longest - 1, -1, -1):
                path[j] = at
                if j:
                    at = came[j, line, at]
            for k, i in enumerate(own):
                out[i] = path[: len(sentences[i][0]), k]
        return out


def _confidence(apart: np.ndarray, held: int) -> float:
    """How much nearer one profile is than the nearest other: 0.5 for a tie, up to 1."""
    rest = np.delete(apart, held)
    return round(float(np.clip(0.5 + (rest.min() - apart[held]) / max(1e-9, rest.min() + apart[held]), 0, 1)), 6) if len(rest) else 1.0


def _pieces(ends: list[bool]) -> list[tuple[int, int]]:
    out, start = [], 0
    while len(ends) - start > PIECE:
        stop = next((i + 1 for i in range(start + PIECE - 1, start + PIECE // 2, -1) if ends[i]), start + PIECE)
        out.append((start, stop))
        start = stop
    return [*out, (start, len(ends))] if start < len(ends) or not out else out


def _ranges(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all spans, and the number of the span that each belongs to."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin, end = np.array(spans, np.int64).T
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size), np.repeat(np.arange(len(spans)), size)


class Judged:
    """Several texts cut into stretches: of each text ``(first word, end, number of its language, distances)``."""

    def __init__(self, profiles: Profiles, texts: list[str | None]):
        self.profiles = profiles
        found = [_words_and_ends(t) for t in texts]
        own = [profiles.numbered(words) for words, _ in found]
        size = np.array([len(x) for x in own], np.int64)
        self.first = np.cumsum(size) - size
        self.flat = np.concatenate(own) if own else np.empty(0, np.int64)
        cuts = [_pieces(ends) for _, ends in found]
        paths = iter(profiles.decode([(w[a:b], np.array(e[a:b], bool)) for w, (_, e), c in zip(own, found, cuts, strict=True) for a, b in c]))
        spans = []
        for i, c in enumerate(cuts):
            path = np.concatenate([next(paths) for _ in c])
            edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)] if len(path) else []
            spans += [(i, a, b) for a, b in zip(edges, edges[1:], strict=False)]
        apart = self.distances([(i, a, b) for i, a, b in spans])
        merged: list[tuple[int, int, int, np.ndarray]] = []
        again = []
        for (i, a, b), x in zip(spans, apart, strict=True):
            if x.min() >= 1 and not self._letters(i, a, b):
                continue
            if merged and merged[-1][0] == i and merged[-1][2] == a and int(merged[-1][3].argmin()) == int(x.argmin()):  # one stretch after all
                merged[-1] = (i, merged[-1][1], b, x)
                if not again or again[-1] != len(merged) - 1:
                    again.append(len(merged) - 1)
            else:
                merged.append((i, a, b, x))
        for k, x in zip(again, self.distances([merged[k][:3] for k in again]), strict=True):
            merged[k] = (*merged[k][:3], x)
        self.stretches: list[list[tuple[int, int, int, np.ndarray]]] = [[] for _ in texts]
        for i, a, b, x in merged:
            self.stretches[i].append((a, b, int(x.argmin()), x))

    def _span(self, i: int, a: int, b: int) -> tuple[int, int]:
        return int(self.first[i]) + a, int(self.first[i]) + b

    def _letters(self, i: int, a: int, b: int) -> bool:
        a, b = self._span(i, a, b)
        return bool(self.profiles.size[self.flat[a:b]].any())

    def distances(self, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """Distances of stretches ``(text, first word, end)``."""
        out = [np.ones((0, len(self.profiles.languages)))]
        for start in range(0, len(spans), 4096):  # so that text, count and n-gram fit into one number
            at, of = _ranges([self._span(*s) for s in spans[start : start + 4096]])
            out.append(self.profiles.distances(self.flat[at], of, len(spans[start : start + 4096])))
        return np.concatenate(out)

    def words(self, i: int, a: int, b: int) -> np.ndarray:
        a, b = self._span(i, a, b)
        return self.flat[a:b]


def judged(profiles: Profiles, texts: list[str | None]) -> Judged:
    profiles.forget()
    return Judged(profiles, texts)


def stretches(profiles: Profiles, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
    """For each text its stretches ``(first word, end, language, confidence)``."""
    if not profiles.languages:
        return [[] for _ in texts]
    return [[(a, b, profiles.languages[held], _confidence(x, held)) for a, b, held, x in own] for own in judged(profiles, texts).stretches]


# Spark


def ranked_profiles(rows: DataFrame) -> dict[str, list[str]]:
    """Profiles from ``language, gram, n``: at most ``PROFILE`` n-grams of each language reach the driver."""
    counted = rows.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    order = F.struct((-F.col("n")).alias("m"), F.col("gram").alias("gram"))
    # the largest of each of 64 parts first, so that no task sorts a language's n-grams alone
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    near = counted.withColumn("r", F.row_number().over(Window.partitionBy("language", part).orderBy(order))).where(F.col("r") <= PROFILE)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(order))).where(F.col("r") <= PROFILE)
    out: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    for row in top.select("language", "gram", "r").orderBy("language", "r").toLocalIterator():
        out[row["language"]].append(row["gram"])
    return out


def _counted(profiles: Profiles, by: dict[str, np.ndarray]) -> pd.DataFrame:
    names = np.array(list(profiles.numbers), object)
    parts = [pd.DataFrame({"language": language, "gram": names[np.flatnonzero(n)], "n": n[n > 0]}) for language, n in by.items()]
    return pd.concat(parts) if parts else pd.DataFrame({"language": pd.Series(dtype=str), "gram": pd.Series(dtype=str), "n": pd.Series(dtype="int64")})


def _added(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None or len(a) == len(b):
        return b if a is None else a + b
    return np.pad(a, (0, max(0, len(b) - len(a)))) + np.pad(b, (0, max(0, len(a) - len(b))))


def sampled(documents: DataFrame, text: str, label: str, sample: int = SAMPLE_DOCS) -> DataFrame:
    """``(text, language)``: of each language the ``sample`` distinct labelled texts of the lowest hashes, or all if there are fewer.

    Labels are counted first; texts are then read for those hashes that are low enough to be among them, and only hashes
    are compared. Where copies make them too few, more are looked at. Texts that aren't chosen never leave their scan.
    """
    labelled = documents.select(F.col(text).alias("text"), label_language(label).alias("language")).where("language IS NOT NULL AND text IS NOT NULL AND text <> ''")
    place = F.shiftrightunsigned(F.xxhash64("text"), 1)
    known = {r["language"]: r["n"] for r in documents.select(label_language(label).alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n")).collect()}  # one row for each language
    share = {x: min(1.0, (1.2 * sample + 200) / n) for x, n in known.items()}
    while True:
        limit = F.lit(-1).cast("bigint")
        for x, part in share.items():
            limit = F.when(F.col("language") == x, F.lit(min(int(part * 2**63), 2**63 - 1))).otherwise(limit)
        low = labelled.withColumn("place", place).where(F.col("place") <= limit)
        ranked = low.select("language", "place").distinct().withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy("place")))
        picked = [(r["language"], r["place"]) for r in ranked.where(F.col("r") <= sample).collect()]  # at most `sample` numbers for each language
        got = Counter(x for x, _ in picked)
        short = [x for x in share if share[x] < 1 and got[x] < sample]
        if not short:
            break
        share.update({x: min(1.0, 4 * share[x]) for x in short})
    chosen = documents.sparkSession.createDataFrame(picked, "language string, place bigint")
    return low.join(F.broadcast(chosen), ["language", "place"]).groupBy("language", "place").agg(F.first("text").alias("text")).select("text", "language", "place")


def train(documents: DataFrame, text: str, label: str, sample: int = SAMPLE_DOCS) -> Profiles:
    """Profiles from at most ``sample`` labelled documents of each language, trained twice (see above)."""
    chosen = cut_lineage(sampled(documents, text, label, sample).repartition(4 * len(LANGUAGES), "place"))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Profiles({})
        for frame in frames:
            known.forget()
            by: dict[str, np.ndarray] = {}
            for language, texts in frame.groupby("language")["text"]:
                by[language] = _added(by.get(language), known.counts(known.numbered([w for t in texts for w in _words_and_ends(t)[0]])))
            yield _counted(known, by)

    schema = "language string, gram string, n bigint"
    rough = documents.sparkSession.sparkContext.broadcast(ranked_profiles(chosen.mapInPandas(first, schema)))

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles(rough.value)
        for frame in frames:
            found = judged(profiles, frame["text"].tolist())
            own: dict[str, list[np.ndarray]] = {}
            for i, language in enumerate(frame["language"]):
                own.setdefault(language, []).extend(found.words(i, a, b) for a, b, held, _ in found.stretches[i] if profiles.languages[held] == language)
            yield _counted(profiles, {x: profiles.counts(np.concatenate(w)) for x, w in own.items() if w})

    return Profiles(ranked_profiles(chosen.mapInPandas(second, schema)))


SEGMENTS = "doc_id bigint, label string, first_word int, end_word int, lang string, confidence double, doc_lang string, doc_confidence double"


def identify(documents: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``SEGMENTS``: the stretches of each document, with the language of most of its words and its confidence.

    A document without a stretch gives one row with nulls. The document's confidence compares its own most frequent
    n-grams with all profiles.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles.ranked())
    columns = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles(shared.value)
        for frame in frames:
            keys, labels, texts = frame["doc_id"].tolist(), frame["label"].tolist(), frame["text"].tolist()
            for start in range(0, len(keys), BATCH):
                ids, known, own = keys[start : start + BATCH], labels[start : start + BATCH], texts[start : start + BATCH]
                found = judged(profiles, own) if profiles.languages else None
                spans = [x for x in (found.stretches if found else [[] for _ in own])]
                several = [i for i, x in enumerate(spans) if len(x) > 1]
                whole = dict(zip(several, found.distances([(i, spans[i][0][0], spans[i][-1][1]) for i in several]), strict=True)) if several else {}
                rows = []
                for i, (k, named) in enumerate(zip(ids, known, strict=True)):
                    if not spans[i]:
                        rows.append((k, named, None, None, None, None, None, 0.0))
                        continue
                    share: Counter = Counter()
                    for a, b, held, _ in spans[i]:
                        share[held] += b - a
                    main = max(share, key=lambda x: (share[x], x))
                    sure = _confidence(whole[i] if i in whole else spans[i][0][3], main)
                    rows += [(k, named, a, b, profiles.languages[held], _confidence(x, held), profiles.languages[main], round(sure * share[main] / sum(share.values()), 6)) for a, b, held, x in spans[i]]
                out = pd.DataFrame(rows, columns=columns)
                yield out.astype({"first_word": "Int32", "end_word": "Int32"})

    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), label_language(label).alias("label"), F.col(text).alias("text"))
    return spread(rows).mapInPandas(run, SEGMENTS)
