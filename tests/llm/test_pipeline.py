"""The pipeline's stages and the registered queries on the smallest tables."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provena.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    names = docs.columns
    clean = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == names
        if k == 0:
            assert docs.count() >= 0.95 * clean.where("text rlike '[A-Za-z]'").count()
    assert docs.count() == corpus_pipeline.run(spark, SF).count() > 0


WORDS = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu".split()


def words(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(2, 4))) for _ in range(n))


def test_stages_match_brute_force(spark, tmp_path):
    """Each stage's rows against what plain Python keeps of the stage's own input, and odd rows:
    nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(21)
    lines = [words(rng, 12) for _ in range(40)]
    rows = [(i, "\n".join(rng.choices(lines, k=2) + [words(rng, rng.randint(8, 60)) for _ in range(3)]), rng.choice(["en", "de"]), rng.choice(["a", "b", None]), 0) for i in range(60)]
    near = words(rng, 200).split()
    rows += [(100 + k, " ".join(near[:k] + ["zzz"] + near[k + 1 :]), "en", "a", 0) for k in (20, 90, 150)]
    rows += [(200, None, None, None, None), (201, "", "en", "b", 0), (202, " \n ", None, None, 1), (None, words(rng, 30), "en", "a", 3), (203, "¿ 12 !", "en", "a", 2), (204, words(rng, 20_000), "de", "b", 9), (205, rows[0][1], "en", "a", 0), (206, "same text " + rows[3][1], "en", "c", 0), (206, "same text " + rows[3][1], "en", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(1) for c in ("gone", "gonel", "place", "kept", "new", "key", "reps", "h1", "sh", "fp", "first", "prefix", "line", "size", "n", "x")}
    docs = docs.withColumns(clash)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
        after = out.collect()
        key = lambda r: (r.doc_id, r.text, r.source)
        have = Counter(map(key, after)) if k < 4 else None
        if k == 0:
            assert have == Counter(key(r) for r in before if r.text and any(c.isalpha() for c in r.text))
        if k == 1:
            seen, want = [], Counter()
            order = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in before})
            texts = {}
            for late, i, t in order:
                kept = []
                for line in t.split("\n"):
                    s = line.strip(" \t\n\r\x0b\x0c")
                    if not s or not any(one_edit(s, x) for x in seen):
                        kept.append(line)
                    if s:
                        seen.append(s)
                texts[(late, i, t)] = "\n".join(kept)
            for r in before:
                want[(r.doc_id, texts[(r.doc_id is None, r.doc_id or 0, r.text)], r.source)] += 1
            assert have == want
        if k == 2:
            sets = [shingles(r.text) for r in before]
            up = list(range(len(before)))
            for a, b in itertools.combinations(range(len(before)), 2):
                if before[a].doc_id is not None and before[b].doc_id is not None and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    x, y = root(up, a), root(up, b)
                    up[max(x, y)] = min(x, y)
            least = {}
            for a, r in enumerate(before):
                if r.doc_id is not None:
                    least[root(up, a)] = min(r.doc_id, least.get(root(up, a), r.doc_id))
            drop = {r.doc_id for a, r in enumerate(before) if r.doc_id is not None and r.doc_id != least[root(up, a)]}
            assert have == Counter(key(r) for r in before if r.doc_id not in drop)
            assert drop
        if k == 3:
            size = Counter()
            for r in before:
                size[r.source] += len((r.text or "").split())
            taken = Counter()
            for (i, t, s), n in have.items():
                taken[s] += n * len((t or "").split())
                assert n <= 3 * Counter(map(key, before))[(i, t, s)]
            want = targets(size)
            for s in size:
                # as near as whole documents come
                assert abs(taken[s] - want[s]) <= max(len((r.text or "").split()) for r in before if r.source == s) / 2 + 1e-6
        if k == 4:
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before) and all(r.decodes for r in after)
        docs = out
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def root(up, x):
    while up[x] != x:
        x = up[x]
    return x


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() > 0
