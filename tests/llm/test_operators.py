"""Each operator against brute force on small inputs, and on odd ones."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provena.llm import chat, langid, linededup, minhash, mixing, pieces, pivots, quality, queries, simhash, tokencounts
from provena.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu".split()


def text_of(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n))


def odd_docs(spark, **more):
    rng = random.Random(1)
    long = text_of(rng, 30_000)
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "  \t\n ", None, "a", 5), (None, "word word", "en", "a", 9), (4, long, "en", "b", len(long)), (5, long, "de", "b", len(long)), (5, long, "de", "b", len(long)), (6, "¿¡!? 123", None, None, 8), (7, "ünï cödé \U0001f600 x", "de", "c", 12), (8, "x" * 20_000, "en", "c", 20_000)]
    return spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("k"), "gone": F.lit(1), "reps": F.lit(2), **more})


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(7, 7), (None, 4)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def brute_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split() if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50, 1600):
        t = text_of(rng, n).upper() if n % 2 else text_of(rng, n)
        assert simhash.simhash(t) == brute_simhash(t)
    base = [text_of(rng, 60) for _ in range(40)]
    texts = base + [b + " " + text_of(rng, 1) for b in base for _ in range(3)] + base[:5] + ["", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    fp = [brute_simhash(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if (fp[i] ^ fp[j]).bit_count() <= 2]
    want = brute_components(range(len(fp)), pairs)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp[i], want[i]) for i in want}


@pytest.mark.parametrize(("shard", "leaf"), [(60, 8), (60, 10**9), (10**9, 8)])
def test_vantage_shards_lose_no_pair(spark, shard, leaf):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 900, dtype=np.int64).astype(np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    dense = np.uint64(12345) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))
    fp = np.unique(np.concatenate([base, near, dense]))
    pairs = [(i, j) for i in range(len(fp)) for j in (np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= 2) + i + 1).tolist()]
    want = brute_components(range(len(fp)), pairs)
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(fp.view(np.int64))], "fp long, rep long")
    comp = {r[0]: r[1] for r in components(simhash.link(df, shard=shard, leaf=leaf)).collect()}
    assert {i: comp.get(i, i) for i in want} == want
    tree = simhash.ShardTree(fp, 16)
    assert tree.shards > 4
    at = [set() for _ in fp]
    for r, s in zip(*tree.route(fp), strict=True):
        at[r].add(s)
    assert all(at[i] & at[j] for i, j in pairs)


def test_simhash_odd(spark):
    docs = odd_docs(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[1].fp == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 6, 7, 8]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


@pytest.mark.parametrize(("listed", "tile", "block"), [(None, None, None), (0, 16, 16)])
def test_near_copies_match_brute_force(spark, monkeypatch, listed, tile, block):
    """Also with every group taken as dense and dealt to small tiles and blocks."""
    if listed is not None:
        for name, value in (("LISTED", listed), ("TILE", tile), ("BLOCK", block)):
            monkeypatch.setattr(simhash, name, value)
    rng = random.Random(8)
    texts = [text_of(rng, n).split() for n in [3, 5, 8] * 4 + [40, 90, 200] * 10]
    for base in texts[12:30]:
        for edits in (1, 1, 2, 4, 9):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = text_of(rng, 1)
            texts.append(t)
    texts += [["same"] * 6 + t for t in texts[:40]] + [texts[20], [], []]
    grams = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])]
    want = brute_components(range(len(texts)), pairs)
    wide = [(i, j) for i, j in pairs if (brute_simhash(" ".join(texts[i])) ^ brute_simhash(" ".join(texts[j]))).bit_count() > 2]
    assert len(wide) > 40
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.first for r in simhash.near_copies(docs).collect()} == want
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("j", [0, 1])
def test_near_copies_are_searched_by_vantage_points(monkeypatch, j):
    """A group's pairs come from the branches of its fingerprints, which lose none and spare most comparisons."""
    rng = np.random.default_rng(4)
    bits = np.repeat(rng.integers(0, 2, (12, 256), dtype=np.uint8), 100, axis=0)
    bits ^= rng.random(bits.shape) < 0.06
    loose = rng.integers(0, 2, (40, 256), dtype=np.uint8)
    fp = np.packbits(np.concatenate([bits, loose]), axis=1).view(np.uint64)
    n = len(fp)
    tile = {"comp": np.arange(n), "n": np.full(n, 50), "sh": rng.permutation(n) + 7, "block": rng.integers(0, j + 1, n), "i": np.zeros(n, np.int32), "j": np.full(n, j, np.int32)}
    tile |= {f: fp[:, k].view(np.int64) for k, f in enumerate(simhash.FPS)}
    sh, block = tile["sh"], tile["block"]
    near = [(a, b) for a in range(n) for b in np.flatnonzero(np.bitwise_count(fp[a] ^ fp).sum(1) <= 68).tolist() if a != b]
    want = {(sh[a], sh[b]) for a, b in near if (block[a] < block[b] if j else sh[a] < sh[b])}
    assert len(want) > 20_000
    seen = []

    def spy(*args, real=simhash.branches, **kw):
        for at in real(*args, **kw):
            seen.append(at)
            yield at

    monkeypatch.setattr(simhash, "branches", spy)
    monkeypatch.setattr(simhash, "LISTED", 10**6)
    got = simhash._close(68, 0.8, leaf=50)(tile)
    assert set(zip(got["a"].tolist(), got["b"].tolist(), strict=True)) == want and len(got["a"]) == len(want)
    assert (got["kind"] == 0).all()
    assert sum(len(at) ** 2 for at in seen) < n * n / 3
    # a dense group is joined whole: those with a pair, no others
    monkeypatch.setattr(simhash, "LISTED", 1)
    got = simhash._close(68, 0.8, leaf=50)(tile)
    assert (got["kind"] == 1).all() and sorted(got["b"].tolist()) == sorted({x for pair in want for x in pair})


def test_near_copies_of_short_texts(spark):
    """Four shingles of five differ in the most bits of all sizes; the radius of the search must still hold them."""
    rng = random.Random(17)
    texts = []
    while len(texts) < 4:
        w = text_of(rng, 9).split()
        a, b = (simhash.wide_simhash(simhash.shingle_set(" ".join(x))) for x in (w, w[:8]))
        if len(set(w)) == 9 and sum((x ^ y) % 2**64 >> k & 1 for x, y in zip(a, b, strict=True) for k in range(64)) > 68:
            texts += [" ".join(w), " ".join(w[:8])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.first for r in simhash.near_copies(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


# Embeddings


def test_pivots_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 16))
    near = np.repeat(base[:40], 5, axis=0) + rng.normal(size=(200, 16)) * 0.08
    x = np.concatenate([base, near, base[:10], base[:3] * 7])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, [float("inf")] * 16), (None, [1.0] * 16), (n + 5, []), (n + 6, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(n, dtype=bool)
    for tile in (1024, 32):
        got = {r.vec_id: r for r in pivots.near_duplicates(df, tile=tile).collect()}
        assert len(got) == len(rows)
        found = sum(got[i].n_links for i in range(n))
        assert found <= links.sum() and found >= 0.97 * links.sum()
        assert all(got[i].n_links <= links[i].sum() for i in range(n))
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(n, n + 7))
        assert got[None].component_id is None and not got[None].kept
    assert pivots.near_duplicates(df.limit(0)).count() == 0
    assert pivots.near_duplicates(df.where("vec_id = 3")).collect()[0].kept


def test_pivots_recall_near_the_bound(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[:300] + rng.normal(size=(300, 64)) * 0.045
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([x, y]))]
    u = np.concatenate([x, y])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum() - len(u)
    got = sum(r.n_links for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert links > 300 and 0.9 * links <= got <= links


def test_pivots_widths_copies_and_recall_with_many_pivots(spark):
    """Two lengths of vectors, repeated ids, clashing names; recall at the bound with as many
    pivots as a table of a million vectors has."""
    rng = np.random.default_rng(5)
    short, long = rng.normal(size=(2, 8)), rng.normal(size=(30, 16))
    short[1] = short[0] + 0.01
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(long)] + [(100, [float(v) for v in short[0]]), (101, [float(v) for v in short[1]]), (102, [float(v) for v in short[1]]), (102, [float(v) for v in short[1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "n", "rep", "key", "kept", "list", "node")})
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pivots.near_duplicates(df).collect() if r.vec_id >= 100)
    assert got == [(100, 3, 100), (101, 3, 100), (102, 3, 100), (102, 3, 100)]
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = rng.normal(size=(2048, 64))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    for c in (0.90, 0.92):
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        y = c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z, axis=1, keepdims=True)
        k = pivots.nearest_of(len(p))
        a, b = (np.argsort(-(v @ p.T), axis=1)[:, :k] for v in (x, y))
        assert np.mean((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= pivots.SHARED) > 0.95


# Lines


def brute_lines(docs):
    def close(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) > len(b):
            a, b = b, a
        i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    seen, out = [], {}
    for i, t in sorted(docs):
        kept = []
        for line in t.split("\n"):
            s = line.strip(" \t\n\r\x0b\x0c")
            if not s or not any(close(s, x) for x in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(8)
    pool = [text_of(rng, rng.randint(1, 12)) for _ in range(60)]

    def line():
        s = rng.choice(pool)
        k, i = rng.randrange(5), rng.randrange(len(s))
        if k == 0:
            s = s[:i] + s[i + 1 :]
        elif k == 1:
            s = s[:i] + "é" + s[i:]
        elif k == 2:
            s = s[:i] + "z" + s[i + 1 :]
        return rng.choice(["", " ", "\t"]) + s

    docs = [(i, "\n".join(rng.choice([line(), "", line(), text_of(rng, 9)]) for _ in range(8))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOCS)
    got = linededup.dedup_lines(df, report=True)
    rows = {r.doc_id: r for r in got.collect()}
    want = brute_lines(docs)
    assert {i: r.text for i, r in rows.items()} == want
    assert all(r.n_chars == len(r.text) and r.lines_out == (r.text.count("\n") + 1 if r.lines_out else 0) for r in rows.values())


def test_lines_odd(spark):
    docs = odd_docs(spark)
    docs = docs.withColumns({c: F.lit(1) for c in ("gonel", "gonei", "place", "kept", "new", "pos", "h1", "line")})
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = {(r.doc_id, i): r.text for i, r in enumerate(sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id)))}
    assert texts[(1, 0)] is None and texts[(2, 1)] == "" and texts[(5, 4)] == "" and texts[(5, 5)] == ""
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "ab\nc\n\nabc"), (2, "x\nab \nzzzz"), (None, "zzz\nyyyy"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(short).collect()} == {1: "ab\nc\n", 2: "zzzz", None: "yyyy", 3: None}
    own, less = linededup.deletion_keys("abca")
    assert linededup.deletion_keys("bca")[0][0] == less[0] and linededup.deletion_keys("aca")[0][0] == less[1]


# Languages


def test_language_model(spark):
    units = ["0the", "0der", "3the", "3der", "1e"]
    model = langid.LanguageModel(["a", "b"], units, np.array([[9, 0], [0, 9], [9, 0], [0, 9], [5, 5]]))
    score = langid.Scorer(model)
    assert score("The") == score("the") and score("the")[0] == "a" and score("der")[0] == "b"
    assert score("xthex")[0] == "a" and score("derder")[0] == "b"
    assert score(None) == score("12 !") == score("") == ("und", 0.0)
    assert all(0 <= score(t)[1] <= 1 for t in ("the der", "zzz", "the " * 5000))


def test_language_matches_brute_force(spark):
    """Every prediction anew, word by word, from counts that are taken from the texts here."""
    rng = random.Random(6)
    tongues = {"de": "der und nicht straße über", "en": "the and not street over", "xx": "zu ümlaut né \u0436\u0437 the"}
    rows = [(i, " ".join(rng.choices(tongues[x].split() + [text_of(rng, 1)], k=rng.randint(1, 30))), x, "s", 0) for i, x in enumerate(rng.choices(list(tongues), k=150))]
    rows += [(900, None, "de", "s", 0), (901, "1 2", "en", "s", 0), (902, "Unbekannt \U0001d400", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    langs = sorted(tongues)
    counts: dict[str, Counter] = {}
    for _, t, x, _, _ in rows:
        for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split() if x else []:
            m = f"\x02{w}\x03"
            for u in ["0" + w] + [f"{k}{m[i:i + k]}" for k in range(1, 5) for i in range(len(m) - k + 1)]:
                counts.setdefault(u, Counter())[x] += 1
    counts = {u: c for u, c in counts.items() if c.total() > 1}
    total = {k: [sum(c[x] for u, c in counts.items() if u[0] == k) for x in langs] for k in "01234"}
    size = Counter(u[0] for u in counts)

    def log_of(u):
        return [math.log((counts[u][x] + 0.1) / (total[u[0]][i] + 0.1 * (size[u[0]] + 1))) for i, x in enumerate(langs)]

    def word(w):
        if "0" + w in counts:
            got = [log_of("0" + w)]
        else:
            m = f"\x02{w}\x03"
            longest = [next((f"{k}{m[i:i + k]}" for k in range(min(4, len(m) - i), 0, -1) if f"{k}{m[i:i + k]}" in counts), None) for i in range(len(m) - 1)]
            got = [log_of(u) for u in longest if u] or [[0.0] * 3]
        mean = [sum(x) / len(got) for x in zip(*got, strict=True)]
        return [x - sum(mean) / 3 for x in mean]

    model = langid.fit(docs, F.lit(True), fit_docs=10**6)
    for r in langid.predict(docs, model).collect():
        words = "".join(c if c.isalpha() else " " for c in (dict((i, t) for i, t, *_ in rows)[r.doc_id] or "").lower()).split()
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        s = [sum(x) / math.sqrt(len(words)) for x in zip(*map(word, words), strict=True)]
        assert abs(r.score - 1 / sum(math.exp(x - max(s)) for x in s)) < 1e-4
        assert s[langs.index(r.lang_pred)] > max(s) - 1e-4


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    got = langid.predict(docs, langid.fit(docs, ~out)).join(docs.select("doc_id", "lang", out.alias("o")), "doc_id").where("o").collect()
    assert len(got) > 150
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = odd_docs(spark)
    model = langid.fit(odd, F.lit(True))
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    kept = langid.keep_known(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3, 6}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.predict(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(odd.limit(0), F.lit(True))).collect()} == {"und"}


# Pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def all_segmentations(v, unit):
    if not unit:
        yield (), 0.0
    for j in range(1, len(unit) + 1):
        if unit[:j] in v.ids:
            for ids, w in all_segmentations(v, unit[j:]):
                yield (v.ids[unit[:j]], *ids), w + v.weight[v.ids[unit[:j]]]


def test_pieces_distribution(vocabulary):
    v = vocabulary
    all_ = dict(all_segmentations(v, "▁dere"))
    total = math.log(sum(math.exp(w) for w in all_.values()))
    n = 6000
    got = pieces.Sampler(v, 2)(["dere"] * n, list(range(n)))
    first = Counter(tuple(g[0][0].tolist()) for g in got)
    second = Counter(tuple(g[1][0].tolist()) for g in got)
    p = {k: math.exp(w - total) for k, w in all_.items()}
    q = {k: sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k) for k in p}
    for k in p:
        assert abs(first[k] / n - p[k]) < 4 * math.sqrt(p[k] / n) + 1e-3
        assert abs(second[k] / n - q[k]) < 4 * math.sqrt(q[k] / n) + 1e-3
    for g in got[:200]:
        assert g[0][2] > g[1][2]
        for ids, logp, _, incl in g:
            assert abs(logp - (all_[tuple(ids.tolist())] - total)) < 1e-4 and incl <= 0
    # inverse inclusion weights estimate sums over all segmentations without bias
    n_all = [sum(math.exp(-x[3]) * math.exp(x[1]) for x in g) for g in got]
    assert abs(np.mean(n_all) - 1) < 0.02


def test_pieces_are_distinct_exhaustive_and_exact(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = vocabulary
    n = len(list(all_segmentations(v, "▁then")))
    got = pieces.Sampler(v, n + 5)(["then"], [1])[0]
    assert len(got) == n == len({tuple(g[0].tolist()) for g in got}) and got[0][3] == 0.0
    texts = ["", " ", "a  b", "  lead", "tail ", "x\n y\t", "▁", "a▁b ▁▁ c\x00\U0001f600", "日本語 ñandú", "y" * 5000, "﷐", "word " * 3000]
    for k in (1, 3):
        s = pieces.Sampler(v, k)
        for t, g in zip(texts, s(texts, list(range(len(texts)))), strict=True):
            assert len({tuple(x[0].tolist()) for x in g}) == len(g)
            for x in g:
                assert v.decode(x[0].tolist()) == t
                if "▁" not in t:
                    assert sp.decode(x[0].tolist()) == t
        again = pieces.Sampler(v, k)(texts[::-1], list(range(len(texts)))[::-1])[::-1]
        for a, b in zip(again, s(texts, list(range(len(texts)))), strict=True):
            assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]


def test_no_piece_reaches_across_units(vocabulary):
    v = vocabulary
    pairs = {p[i : i + 2] for p in v.ids for i in range(len(p) - 1)}
    rng = random.Random(9)
    seen = sorted(set("".join(v.ids)) - {"▁"})
    for _ in range(300):
        text = "".join(rng.choices(seen + list("  \n\t.,;'\"()_-09é\U0001f600\u3042▁") * 20, k=120)) + " don't (stop)... a_b\r\n"
        units = v.units(text)
        assert "".join(u or "▁" for u in units) == "▁" + text.replace(" ", "▁")
        for a, b in zip(units, units[1:], strict=False):
            assert a is None or b is None or a[-1] + b[0] not in pairs


def test_pieces_do_not_depend_on_texts_met_before(vocabulary):
    rng = random.Random(8)
    texts = [text_of(rng, rng.randint(1, 400)) + " ünï \n\x00 " + str(i) for i in range(60)]
    used = pieces.Sampler(vocabulary, 2, remembered=500)
    used([text_of(rng, 5_000)], [99])
    together = used(texts, list(range(60)))
    for i in range(60):
        alone = pieces.Sampler(vocabulary, 2)([texts[i]], [i])[0]
        assert [(a.tolist(), *b) for a, *b in alone] == [(a.tolist(), *b) for a, *b in together[i]]


def test_pieces_odd(spark):
    docs = odd_docs(spark)
    got = pieces.encode(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.decodes for r in rows)
    assert all(len(r.segmentations) == 1 and r.n_pieces == 0 for r in rows if r.doc_id in (1, 2))
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in pieces.decode(got.where("doc_id is not null")).collect():
        assert r.text == (texts[r.doc_id] or "")
    assert pieces.encode(docs.limit(0)).count() == 0


# Chat


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "a\\b\\z\\e\\", "<\\z|im_end|>", "", None, "<<SYS>>x<</SYS>>", "<|", "\U0001f600<s>é", "x" * 50_000]
    rows = [(i // 4, i % 4, ["user", "assistant", None, "odd\nrole<|im_start|>"][i % 4], t) for i, t in enumerate(hard * 2)] + [(None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    turns = chat.turns_of_rows(df)
    shown = chat.format_turns(turns).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = shown.collect()
    assert len(got) == 6
    for r in got:
        assert [(t.role, t.text) for t in r.back] == [(t.role, t.text) for t in r.turns]
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == len(r.turns)
    assert chat.format_turns(chat.turns_of_rows(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    tables = [
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<from:string,value:string>>"),
        spark.createDataFrame([("q", "a", 1)], "instruction string, output string, id long"),
        spark.createDataFrame([(1, "q", "a")], "id long, prompt string, completion string"),
    ]
    names = []
    for t in tables:
        (r,) = chat.canonical(t).collect()
        names.append(r.layout)
        assert [(x.role, x.text) for x in r.turns] == want
    assert names == ["messages", "shared", "instruction", "completion"]
    (r,) = chat.canonical(spark.createDataFrame([(1, "q", "more", None)], "id long, instruction string, input string, output string")).collect()
    assert [(x.role, x.text) for x in r.turns] == [("user", "q\nmore"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, 2)], "id long, other long"))
    raw = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"output":"a","instruction":"q"}', '{"instruction":"q","input":"","output":"a"}', '{"question":"q","answer":"a"}', '{"prompt":"q","response":"a"}', '{"x":1}', "no json", None]
    got = {r.id: r for r in chat.canonical_json(spark.createDataFrame(list(enumerate(raw)), "id long, raw string")).collect()}
    assert all([(x.role, x.text) for x in got[i].turns] == want for i in range(6))
    assert all(got[i].layout is None and got[i].turns is None for i in (6, 7, 8))


def test_chat_more_than_a_layout(spark):
    """Fields beside a layout's, empty arrays, own mappings, and clashing names."""
    raw = ['{"messages":[]}', '{"messages":[{"role":"user","content":"q","weight":1},{"role":"gpt","content":null}],"id":7}', '{"id":1,"prompt":"q","response":"a","layout":"x","raw":{"b":1}}', '{"say":"q","fingerprint":"f"}', '{"messages":["q"]}', "[]", '{"prompt":"q","response":"a","completion":"c"}']
    rows = spark.createDataFrame(list(enumerate(raw)), "id long, raw string")
    own = (*chat.MAPPINGS, chat.Mapping("said", ("say",), "array(named_struct('role', 'user', 'text', coalesce(say, '')))"))
    got = {r.id: r for r in chat.canonical_json(rows, mappings=own).collect()}
    turns = lambda i: None if got[i].turns is None else [(t.role, t.text) for t in got[i].turns]
    assert [got[i].layout for i in range(7)] == ["messages", "messages", "prompt and response", "said", None, None, "completion"]
    assert turns(0) == [] and turns(1) == [("user", "q"), ("assistant", "")] and turns(2) == [("user", "q"), ("assistant", "a")] and turns(3) == [("user", "q")] and turns(4) is None
    assert got[2].fingerprint == chat.fingerprint_of(["id", "prompt", "response", "layout", "raw"]) and len({r.fingerprint for r in got.values()}) == 7
    typed = spark.createDataFrame([(1, [("user", "q", 1.0)], "z")], "id long, messages array<struct<role:string,content:string,weight:double>>, other string")
    (r,) = chat.canonical(typed).collect()
    assert r.layout == "messages" and [(t.role, t.text) for t in r.turns] == [("user", "q")]
    with pytest.raises(ValueError, match="disagree"):
        chat.canonical_json(rows, mappings=(*chat.MAPPINGS, chat.Mapping("odd", ("messages",), "array()")))
    named = spark.createDataFrame([(1, [("user", "q")], 2, 3)], "id long, turns array<struct<role:string,text:string>>, safe int, _safe int")
    (r,) = chat.format_turns(named).collect()
    assert (r.safe, r._safe) == (2, 3) and r.formatted == f"{chat.OPEN}user\nq{chat.CLOSE}\n"
    twice = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    (r,) = chat.canonical(twice, "conv_id").collect()
    assert len(r.turns) == 2


def test_chat_rows_by_turn(spark, tmp_path):
    rows = [(1, 10, "assistant", "c"), (1, 2, "user", "b"), (1, None, None, "a"), (2, 0, "user", None), (None, 0, "human", "n")]
    want = {1: [("", "a"), ("user", "b"), ("assistant", "c")], 2: [("user", "")], None: [("human", "n")]}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.canonical(df, "conv_id").collect()
    assert {r.id: [(t.role, t.text) for t in r.turns] for r in got} == want and {r.layout for r in got} == {"rows by turn"}
    raw = df.select(F.col("conv_id").alias("id"), F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("raw"))
    other = spark.createDataFrame([(2, '{"question":"q","answer":"a"}'), (2, '{"question":"q","answer":"a"}'), (3, "{}")], "id long, raw string")
    got = chat.canonical_json(raw.union(other)).collect()
    assert len(got) == 6 and sum(r.layout == "question" for r in got) == 2
    assert {r.id: [(t.role, t.text) for t in r.turns] for r in got if r.layout == "rows by turn"} == want
    # the query asks the fingerprint: a table of a layout that no mapping has is refused
    df.withColumnRenamed("turn", "place").write.parquet(f"{tmp_path}/conversations.parquet")
    with pytest.raises(ValueError, match="no mapping"):
        queries.op6_chat_formatting(spark, str(tmp_path))


# Quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = quality.fit(docs, labels, ~out)
    rows = quality.score(docs, model).where(out).join(labels, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    above = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert above > 0.97
    assert np.mean([r.quality == int(r.score >= 0.3) for r in rows]) > 0.95
    odd = odd_docs(spark)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd.limit(0), model).count() == 0
    none = quality.fit(odd, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_quality_matches_brute_force(spark):
    """Every score anew from the model's dictionaries, piece by piece, and the fit's calibration."""
    import zstandard

    rng = random.Random(12)
    good = [text_of(rng, rng.randint(20, 200)) for _ in range(80)]
    bad = ["buy now " * rng.randint(3, 60) + text_of(rng, 3) for _ in range(80)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good + bad + ["", None, "x"])]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    tools = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.bad, model.good)]

    def size(tool, data):
        return sum(len(tool.compress(data[i : i + quality.PIECE])) for i in range(0, len(data), quality.PIECE))

    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, t, *_ in rows:
        data = (t or "").encode()
        x = (size(tools[0], data) - size(tools[1], data)) / len(data) if data else None
        want = model.empty if x is None else 1 / (1 + math.exp(-max(-30, min(30, model.slope * x + model.offset))))
        assert got[i] == pytest.approx(want)
    # the curve is where the weighted likelihood of the labels is largest
    held = [(i, float(i < 80)) for i in range(160)]

    def loss(slope, offset):
        total = 0.0
        for i, y in held:
            data = rows[i][1].encode()
            z = slope * (size(tools[0], data) - size(tools[1], data)) / len(data) + offset
            total += math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z))
        return total

    assert loss(model.slope, model.offset) < min(loss(0.0, 0.0), loss(model.slope / 20, model.offset), loss(-model.slope, model.offset))
    assert min(got[i] for i in range(80)) > max(got[i] for i in range(80, 160))
    twice = quality.fit(docs.union(docs.limit(5)), labels.union(labels.limit(5)), F.lit(True))
    assert 0 <= quality.QualityScorer(twice)("x") <= 1


# Mixing


def brute_targets(sizes, epochs=3.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > epochs * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / total for s in free}
        for s in over:
            fixed[s] = epochs * sizes[s]
        left = sum(sizes.values()) - sum(fixed.values())


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, rng.randint(0, 40)), "en", rng.choice(["a", "a", "a", "b", "c", "é", "Z", None]), 0) for i in range(900)] + [(5000, None, "en", "zero", 0), (5001, text_of(rng, 300), "en", "one", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.reps <= 3
        taken[r.source] += r.size * r.reps
    for s, w in want.items():
        assert abs(taken[s] - w) <= max(r.size for r in got if r.source == s)
    again = {r.id: r.reps for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.id: r.reps for r in got}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in again.items() if n})


def test_mixing_odd(spark):
    docs = odd_docs(spark)
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).count() > 0
    assert mixing.mix(docs.limit(0)).count() == 0


# Token counts


def test_rollup(spark, tmp_path):
    import tiktoken  # noqa: F401

    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    old = tokencounts.token_counts(docs).unionByName(tokencounts.word_counts(docs))
    words = {r.id: r.tokens for r in old.where("tokenizer = 'words/1'").collect()}
    assert words[1] == 0 and words[4] == 30_000
    moved = docs.where("doc_id != 7").withColumn("text", F.when(F.col("doc_id") == 4, "short now").otherwise(F.col("text"))).withColumn("lang", F.when(F.col("doc_id") == 8, "fr").otherwise(F.col("lang")))
    new = tokencounts.token_counts(moved).unionByName(tokencounts.word_counts(moved))
    rollup = tokencounts.TokenRollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.apply("1", tokencounts.inserts(old)) and not rollup.apply("1", tokencounts.inserts(old))
    delta = tokencounts.changes(old, new)
    assert rollup.apply("2", delta)

    def direct(counts):
        return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in counts.groupBy("source", "lang", "tokenizer").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).collect()}

    def held():
        return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}

    assert held() == direct(new)
    rollup.compact()
    assert held() == direct(new) and not rollup.apply("2", delta)
    assert rollup.apply("3", tokencounts.deletes(new)) and held() == {}
    with pytest.raises(ValueError):
        rollup.apply("a/b", delta)
    assert tokencounts.token_counts(docs.limit(0)).count() == 0


def test_token_totals_match_brute_force(spark, tmp_path):
    """The query's three states against tiktoken and dictionaries."""
    import base64

    import tiktoken

    with open(tokencounts.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(4)
    texts = [text_of(rng, rng.randint(0, 40)) + rng.choice(["", " ", "\n\t "]) for _ in range(40)] + ["", None, "  ", "same", "same ", "same"]
    rows = [(i if i != 7 else None, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "a", 0)] * 2
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    count = {tokencounts.VERSION: lambda t: len(encode(t)), "words/1": lambda t: len(t.split())}

    def totals(docs):
        out = {}
        for _, t, lang, source, _ in docs:
            for name, n in count.items():
                d, k = out.get((source, lang, name), (0, 0))
                out[(source, lang, name)] = (d + 1, k + n(t or ""))
        return out

    trimmed = [(i, t and t.strip(" \t\n\r\x0b\x0c"), *x) for i, t, *x in rows]
    least = {}
    for i, t, *_ in trimmed:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    distinct = [r for r in trimmed if r[0] is None or r[0] == least[r[1] or ""]]
    want = {"loaded": totals(rows), "revised": totals(trimmed), "distinct": totals(distinct)}
    got = {}
    for r in queries.op9_token_counts(spark, str(tmp_path)).collect():
        got.setdefault(r.state, {})[(r.source, r.lang, r.tokenizer)] = (r.docs, r.tokens)
    assert got == want


# Fingerprints


def test_minhash_estimates(spark):
    rng = random.Random(9)
    errors = []
    for n in (20, 150, 900):
        for _ in range(40):
            a = text_of(rng, n)
            b = minhash.edited(a, text_of(rng, n))
            s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
            errors.append(minhash.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) - len(s[0] & s[1]) / len(s[0] | s[1]))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    f = minhash.fingerprint("one two three")
    assert len(f) == 256 and (minhash.unpacked(minhash.packed(f)) == f).all()
    assert minhash.packed(minhash.fingerprint("")) == "" and minhash.likeness(f, minhash.fingerprint("")) == 0.0
    assert minhash.likeness(f, f) == 1.0


def test_minhash_next(spark):
    rng = random.Random(4)
    texts = {i: text_of(rng, rng.randint(0, 30)) for i in rng.sample(range(10_000), 120)} | {3: None, 10_001: "é\U0001f600" * 9}
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS).repartition(5)
    ids = sorted(texts)
    got = {r.doc_id: r for r in minhash.with_edited(df).collect()}
    assert sorted(got) == ids
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        own, following = texts[a] or "", texts[b] or ""
        changed = minhash.edited(own, following)
        assert got[a].n_chars == len(own)
        assert got[a].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[a].fingerprint == minhash.packed(minhash.fingerprint(own))
        assert got[a].edited_fingerprint == minhash.packed(minhash.fingerprint(changed))
        assert got[a].near_next == minhash.likeness(minhash.fingerprint(own), minhash.fingerprint(following))
    odd = odd_docs(spark)
    assert minhash.with_edited(odd).count() == odd.count()
    assert minhash.with_edited(odd.where("doc_id = 4")).count() == 1
    assert minhash.with_edited(odd.limit(0)).count() == 0
    assert minhash.fingerprints(odd).count() == odd.count()
