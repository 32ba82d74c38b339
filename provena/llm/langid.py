"""Language identification by words first, and shorter and shorter n-grams after."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import freed, mix64, share, slices

#: Documents that a model is fitted on, at most (about as many of each language).
FIT_DOCS = 6_000
#: How often the sample must hold a word or n-gram for the model to know it.
FIT_COUNT = 2
#: Longest n-gram.
LONGEST = 4
#: Words whose scores a worker remembers, and code points that it scores in one go.
REMEMBERED, TOGETHER = 100_000, 500_000
#: Score under which a filter takes the language as unknown.
LEAST = 0.5
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """All n-grams of the word between marks of its start and end."""
    w = f"\x02{word}\x03"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words end to end, and the length of each."""
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return mix64(chars.astype(np.uint64) + np.uint64(1)), np.fromiter(map(len, words), np.int64, len(words))


def _longer(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those without their last code point, and that one's."""
    with np.errstate(over="ignore"):
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class LanguageModel:
    """Log frequencies of words and n-grams by language, in a few arrays.

    ``tables[0]`` are words, ``tables[n]`` n-grams: a matrix of a row for each unit and a
    column for each language. Words are found by name, n-grams by sorted 64-bit hashes.
    """

    def __init__(self, langs: list[str], units: list[str], counts: np.ndarray) -> None:
        """counts: a row for each unit and a column for each language; a unit is ``0`` and a
        word, or n and an n-gram."""
        self.langs = langs
        kind = np.array([int(u[0]) for u in units], np.int64)
        self.words: dict[str, int] = {}
        self.tables, self.keys = [], []
        for n in range(LONGEST + 1):
            at = np.flatnonzero(kind == n)
            c = np.asarray(counts, np.float64).reshape(len(units), len(langs))[at]
            table = np.log((c + 0.1) / (c.sum(0) + 0.1 * (len(at) + 1))).astype(np.float32)
            names = [units[i][1:] for i in at.tolist()]
            if n == 0:
                self.words = {w: i for i, w in enumerate(names)}
                self.tables.append(table - table.mean(1, keepdims=True) if len(at) else table)
                self.keys.append(np.empty(0, np.uint64))
                continue
            h = np.zeros(len(names), np.uint64)
            chars, _ = _laid_out(names)
            for k in range(n):
                h = _longer(h, chars[k::n])
            order = np.argsort(h)
            self.keys.append(h[order])
            self.tables.append(table[order])

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log score by language, less the row's mean. A known word
        has its own; of another, the mean over its places of the longest known n-gram that
        starts there; 0 if none does."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        own = np.array([self.words.get(w, -1) for w in words], np.int64)
        known, rest = np.flatnonzero(own >= 0), np.flatnonzero(own < 0)
        out[known] = self.tables[0][own[known]]
        if not len(rest):
            return out
        chars, lens = _laid_out([f"\x02{words[i]}\x03" for i in rest.tolist()])
        ends = np.cumsum(lens)
        left = np.repeat(ends, lens) - np.arange(len(chars))
        sums = np.zeros((len(chars), len(self.langs)), np.float32)
        depth = np.zeros(len(chars), np.int64)
        h, place = np.zeros(len(chars), np.uint64), np.flatnonzero(left > 1)
        for n in range(1, LONGEST + 1):
            place = place[left[place] >= n]
            h[place] = _longer(h[place], chars[place + (n - 1)])
            keys = self.keys[n]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, h[place]), len(keys) - 1)
            hit = keys[at] == h[place]
            sums[place[hit]] = self.tables[n][at[hit]]
            depth[place[hit]] = n
        starts = ends - lens
        total = np.add.reduceat(sums, starts)
        count = np.add.reduceat((depth > 0).astype(np.float32), starts)
        total -= total.mean(1, keepdims=True)
        out[rest] = total / np.maximum(count, 1)[:, None]
        return out


class Scorer:
    """A model with the scores of the words it has met, up to ``REMEMBERED``."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)), np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language of one text and its score."""
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its score: the share of it among the exponentials of
        the mean word score times the root of the number of words. ``und`` and 0 if the text
        is null or has no letter, or the model has no language. Ties go to the first by name."""
        out, some, n = [], [], 0
        for t in texts:
            some.append(letters(t) if t else [])
            n += len(t or "")
            if n > TOGETHER:
                out += self._some(some)
                some, n = [], 0
        return out + self._some(some)

    def _some(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.at) > REMEMBERED:
            self._forget()
        new = list(set().union(*texts).difference(self.at))
        if new:
            a = len(self.at)
            self.at.update(zip(new, range(a, a + len(new)), strict=True))
            if a + len(new) > len(self.rows):
                more = np.zeros((2 * (a + len(new)), len(self.model.langs)), np.float32)
                more[:a] = self.rows[:a]
                self.rows = more
            self.rows[a : a + len(new)] = self.model.score(new)
        out, get = [], self.at.__getitem__
        for words in texts:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            idx = np.fromiter(map(get, words), np.int32, len(words))
            s = self.rows[idx].sum(0, dtype=np.float64) / np.sqrt(len(words))
            best = int(np.argmax(s))
            out.append((self.model.langs[best], float(1 / np.exp(s - s[best]).sum())))
        return out


def fit(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Fits a model on a bounded sample of the labelled rows that ``where`` admits.

    The sample holds about ``fit_docs`` documents, chosen by a hash of the id, each
    language up to an equal share. Counting runs on the executors; the driver gets the
    units that stand ``FIT_COUNT`` times or more in the sample, with all languages' counts.
    """
    rows = docs.where(where).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null and t is not null")
    have = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}  # one row a language
    if not have:
        return LanguageModel([], [], np.zeros((0, 0)))
    langs = sorted(have)
    rate = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(fit_docs / len(langs) / have[l]))])
    chosen = rows.where(share(5, "i") < F.element_at(rate, F.col("l"))).select("l", "t")
    out = pa.schema([("l", pa.string()), ("unit", pa.string()), ("n", pa.int64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letters(text))
            for lang, seen in words.items():
                got: Counter = Counter()
                for w, n in seen.items():
                    got["0" + w] += n
                    for k in range(1, LONGEST + 1):
                        for g in grams(w, k):
                            got[f"{k}{g}"] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(list(got)), pa.array(list(got.values()), pa.int64())], schema=out)

    by_lang = [F.sum(F.when(F.col("l") == x, F.col("n")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)]
    units = chosen.mapInArrow(freed(go), "l string, unit string, n long").groupBy("unit").agg(*by_lang, F.sum("n").alias("n")).where(F.col("n") >= FIT_COUNT)
    got = units.drop("n").toArrow().sort_by("unit")
    return LanguageModel(langs, got.column("unit").to_pylist(), np.stack([got.column(f"c{i}").to_numpy() for i in range(len(langs))], axis=1))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of whole texts. A null or letterless text is ``und``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)
        for b in slices(batches):
            got = score.many(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(freed(go), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose language is known with ``least`` or more; a scan, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)
        for b in slices(batches):
            got = score.many(b.column(at).to_pylist())
            yield b.filter(pa.array([g[0] != UNKNOWN and g[1] >= least for g in got], pa.bool_()))

    return docs.mapInArrow(freed(go), docs.schema)
