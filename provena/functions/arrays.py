"""What Spark's lambdas are slow at, as Arrow functions of whole batches: prints, counts of grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from provena.functions import lexicons as lex

try:  # half the time of hashlib's
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: n-gram size and the window in which the least hash is kept.
SIZES = {3: 2, 5: 4, 7: 4}
#: Words of a source's normal form under which its text itself is taken.
NORMAL_WORDS = 4
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_OTHERS = {"en": re.compile("[^a-zA-Z]"), "uz": re.compile("[^a-zA-Z']"), "ru": re.compile("[^Ѐ-ӿ]")}
_NO_LETTERS = re.compile("[^a-zA-ZЀ-ӿ']+")
_STOPS = {k: frozenset(v) for k, v in lex.STOP_WORDS.items()}


def _stem(low: str) -> str:
    return next((low[: -len(s)] for s in lex.UZ_SUFFIXES if low.endswith(s) and len(low) - len(s) >= 3), low)


def normal_form(text: str, lang: str) -> str:
    """``text.normal_form`` of one text by the rules of en, uz or ru."""
    w = text.split()
    plain = [x for x in w if x.isalpha()]
    if lang == "uz":
        kept = [_stem(x.lower()) for x in w if x.isalpha() or "'" in x]
    elif lang == "ru":
        kept = [x.lower() for x in w if _CYRILLIC.search(x)]
    else:
        return " ".join(plain).lower()
    return " ".join(plain).lower() if len(kept) < max(5, len(w) * 0.4) else " ".join(kept)


def match_tokens(norm: str, lang: str) -> list[str]:
    """``text.match_tokens`` of one normal form."""
    other, stops = _OTHERS[lang], _STOPS[lang]
    latin = lang != "ru"
    bare = (w if latin and w.isascii() and w.isalpha() else other.sub("", w) for w in norm.lower().split())
    return [w for w in bare if len(w) > 2 and w not in stops]


@F.arrow_udf(ArrayType(StringType()))
def sentences(text: pa.Array, least: pa.Array, ends: pa.Array) -> pa.Array:
    """``text.sentences``."""
    out = []
    for t, n, e in zip(text, least.to_pylist(), ends.to_pylist(), strict=True):
        t = t.as_py()
        parts = [] if t is None else map(str.strip, re.split(rf"(?<=[{e}])\s+", t.strip()))
        out.append(None if t is None else [s for s in parts if len(s.split()) >= n])
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(StringType())
def sentence_hash(sentence: pa.Array) -> pa.Array:
    """``text.sentence_hash``."""
    bare = (None if s is None else _NO_LETTERS.sub(" ", s.lower()).strip(" ") for s in sentence.to_pylist())
    return pa.array([None if s is None else md5(s.encode()).hexdigest()[:16] for s in bare], pa.string())


@F.arrow_udf(ArrayType(StringType()))
def sentence_grams(sentence: pa.Array, lang: pa.Array) -> pa.Array:
    """The distinct grams of a sentence's tokens: of five, or all but one if there are fewer;
    null for under four tokens."""
    out = []
    for s, k in zip(sentence.to_pylist(), lang.to_pylist(), strict=True):
        t = [] if s is None else match_tokens(s, k)
        n = min(5, len(t) - 1)
        out.append(list(dict.fromkeys(map(" ".join, zip(*(t[i:] for i in range(n)), strict=False)))) if len(t) >= 4 else None)
    return pa.array(out, pa.list_(pa.string()))


def gram_hashes(tokens: list[str], n: int) -> np.ndarray:
    """``text.gram_hash`` of the runs of n tokens: md5 as a number, modulo 1e9."""
    runs = map(" ".join, zip(*(tokens[i:] for i in range(n)), strict=False))
    part = np.frombuffer(b"".join([md5(g.encode()).digest() for g in runs]), ">u4").reshape(-1, 4).astype(np.int64)
    h = part[:, 0] % 10**9
    for i in (1, 2, 3):
        h = (h * ((1 << 32) % 10**9) + part[:, i]) % 10**9
    return h


def winnowed(h: np.ndarray, window: int) -> list[int]:
    """``text.winnow``: the distinct least hashes of all windows, in order; of fewer hashes all of them."""
    if len(h) >= window:
        h = np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
    return list(dict.fromkeys(h.tolist()))


def lists(values: Iterable[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int64()))


@F.arrow_udf(StructType([StructField("norm", StringType()), StructField("n_tokens", IntegerType()), *[StructField(f"f{n}", ArrayType(LongType())) for n in SIZES]]))
def prints(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
    """A text's normal form, its number of tokens, and winnowed hashes by size; nothing for null.
    A source whose normal form is too short stands lower-cased."""
    norms, counts, found = [], [], {n: [] for n in SIZES}
    for t, k, s in zip(text, lang, source, strict=True):
        t, k = t.as_py(), k.as_py()
        norm = None if t is None else normal_form(t, k)
        if norm is not None and s.as_py() and len(norm.split()) < NORMAL_WORDS:
            norm = t.lower()
        tokens = [] if norm is None else match_tokens(norm, k)
        norms.append(norm)
        counts.append(None if norm is None else len(tokens))
        for n, window in SIZES.items():
            found[n].append(winnowed(gram_hashes(tokens, n), window))
    cols = [pa.array(norms, pa.string()), pa.array(counts, pa.int32()), *map(lists, found.values())]
    return pa.StructArray.from_arrays(cols, ["norm", "n_tokens", *[f"f{n}" for n in SIZES]])


# Perplexity and variety

_PPL_WORD = re.compile("[a-zA-ZЀ-ӿ']{2,}")
#: Documents whose runs are counted in one go.
TOGETHER = 256


def run_counts(g: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of ``n`` values of ``g`` from ``start`` on: how many distinct ones, how many
    that occur again, and the sum of c log2 c over their counts."""
    top, runs = int(g.max(initial=0)) + 1, len(start)
    at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    key = np.sort(np.repeat(np.arange(runs), n) * top + g[at])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    c, run = np.diff(first, append=len(key)), key[first] // top
    total = lambda x: np.bincount(run, x, runs)
    return np.bincount(run, minlength=runs), total(c > 1), total(c * np.log2(c))


def perplexities_of(docs: list[tuple[list[str], int]]) -> list[np.ndarray]:
    """For each document's parts and window: the pseudo-perplexity of every run of so many parts."""
    known: dict[str, int] = {}
    ids, starts, ends, runs = [], [], [], []
    for parts, window in docs:
        at = [len(ids)]
        for p in parts:
            ids += [known.setdefault(w, len(known)) for w in _PPL_WORD.findall(p.lower())]
            at.append(len(ids))
        starts += at[: len(at) - window]
        ends += at[window:]
        runs.append(len(at) - window)
    one = np.array(ids, np.int64)
    start, n = np.array(starts, np.int64), np.array(ends, np.int64) - np.array(starts, np.int64)
    v = len(known) + 1
    pairs = np.unique(one[:-1] * v + one[1:], return_inverse=True)[1] if len(one) > 1 else one[:0]
    triples = np.unique(pairs[:-1] * v + one[2:], return_inverse=True)[1] if len(one) > 2 else one[:0]
    distinct, _, _ = run_counts(one, start, n)
    n2, n3 = np.maximum(n - 1, 0), np.maximum(n - 2, 0)
    d2, again2, cl = run_counts(pairs, start, n2)
    d3, again3, _ = run_counts(triples, start, n3)
    t = np.maximum(n2, 1)
    h = np.where(d2 > 0, (np.log2(t) - cl / t) / np.maximum(np.log2(np.maximum(d2, 1)), 1), 0)
    raw = 20 + h * 60 + distinct / np.maximum(n, 1) * 30 - again2 / np.maximum(d2, 1) * 40 - again3 / np.maximum(d3, 1) * 30
    return np.split(np.where(n < 5, 50.0, np.clip(raw, 5.0, 150.0)), np.cumsum(runs)[:-1])


@F.arrow_udf(ArrayType(DoubleType()))
def perplexities(parts: pa.Array, window: pa.Array) -> pa.Array:
    """The pseudo-perplexity of each run of ``window`` parts of a text, in order; the largest, as in
    the SQL, if the part is null."""
    out: list[np.ndarray] = []
    for i in range(0, len(parts), TOGETHER):
        some = parts[i : i + TOGETHER].to_pylist()
        found = perplexities_of([([p or "" for p in ps], w) for ps, w in zip(some, window[i : i + TOGETHER].to_pylist(), strict=True)])
        out += [np.array([150.0]) if ps == [None] else p for ps, p in zip(some, found, strict=True)]
    return pa.array(out, pa.list_(pa.float64()))


@F.arrow_udf(StructType([StructField("mattr", DoubleType()), StructField("again", DoubleType())]))
def variety(words: pa.Array, window: pa.Array) -> pa.Array:
    """The mean share of distinct words of all windows (null if there is but one), and of a text's
    distinct runs of three the share that occurs again (null if there is none)."""
    moving, again = [], []
    for ws, w in zip(words, window.to_pylist(), strict=True):
        ws = ws.as_py() or []
        c, n = Counter(zip(ws, ws[1:], ws[2:], strict=False)), len(ws)
        again.append(sum(x > 1 for x in c.values()) / len(c) if c else None)
        if n <= w:
            moving.append(None)
            continue
        # a place counts in the windows in which it is its word's first
        last: dict[str, int] = {}
        before = np.empty(n, np.int64)
        for i, x in enumerate(ws):
            before[i] = last.get(x, -1)
            last[x] = i
        at = np.arange(n)
        firsts = np.minimum(at, n - w) - np.maximum(np.maximum(at - w + 1, before + 1), 0) + 1
        moving.append(int(np.maximum(firsts, 0).sum()) / (w * (n - w + 1)))
    return pa.StructArray.from_arrays([pa.array(moving, pa.float64()), pa.array(again, pa.float64())], ["mattr", "again"])


# Quality and tokens of the index

_INDEX_WORD = re.compile("[a-zA-ZЀ-ӿ']{3,}")
_NO_LETTER = re.compile("[^a-zA-ZЀ-ӿ]")
_INDEX_STOPS = frozenset(lex.INDEX_STOPS)


def quality(text: str, w: list[str]) -> float:
    """``corpus.quality`` of a text and its lower-case words."""
    n = max(len(w), 1)
    ttr, long = len(set(w)) / n, sum(map(len, w)) / n
    if len(w) < 20 or sum(map(str.isalpha, text)) / max(len(text), 1) < 0.40 or ttr < 0.20 or long < 2.5 or long > 18:
        return 0.0
    return float(np.floor((0.5 * min(len(w) / 300, 1.0) + 0.5 * min((ttr - 0.2) / 0.6, 1.0)) * 10**3 + 0.5) / 10**3)


@F.arrow_udf(StructType([StructField("n_words", IntegerType()), StructField("quality", DoubleType()), StructField("fingerprint", StringType())]))
def scores(text: pa.Array) -> pa.Array:
    """A text's number of words, quality and fingerprint; none, 0 and that of nothing for null."""
    n, q, f = [], [], []
    for t in text:
        t = t.as_py() or ""
        w = t.lower().split()
        n.append(len(w))
        q.append(quality(t, w))
        f.append(md5(" ".join([_NO_LETTER.sub("", x) for x in w[:200]]).encode()).hexdigest())
    return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(q, pa.float64()), pa.array(f, pa.string())], ["n_words", "quality", "fingerprint"])


@F.arrow_udf(ArrayType(StringType()))
def index_tokens(text: pa.Array) -> pa.Array:
    """``text.index_tokens``."""
    return pa.array([None if t is None else [w for w in _INDEX_WORD.findall(t.lower()) if w not in _INDEX_STOPS] for t in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StructType([StructField("v", StringType()), StructField("n", IntegerType())])))
def tally(values: pa.Array) -> pa.Array:
    """``text.tally`` of words, in order of appearance."""
    rows = [Counter(x or ()) for x in values.to_pylist()]
    ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    each = pa.StructArray.from_arrays([pa.array([w for c in rows for w in c], pa.string()), pa.array([n for c in rows for n in c.values()], pa.int32())], ["v", "n"])
    return pa.ListArray.from_arrays(ends, each)
