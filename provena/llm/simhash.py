"""SimHash fingerprints and exact near-duplicate linking with vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import Union, by_group, cut, freed, held, meet, mix64, share, slices, small, spent
from provena.llm.components import components

#: Distinct fingerprints that a shard of the tree is meant to own, and how many of them are sampled to
#: grow the tree. The driver holds a node and ``SAMPLED`` fingerprints for each shard.
SHARD, SAMPLED = 16_384, 16
#: Fingerprints of a branch that are compared with each other outright.
LEAF = 256
#: Differing bits at which fingerprints link.
RADIUS = 2
#: Near copies of the pipeline: words of a shingle, and the least Jaccard similarity of two sets of shingles.
COPY_WORDS, COPY_LEAST = 5, 0.8
#: Differing bits of 256 beyond which two sets aren't compared. At similarity 0.8 a bit differs with odds of at most
#: 0.1875 (four shingles of five; 0.162 for any other sizes with up to 89 in common, by enumeration), so 48 are expected
#: and, with independent bits, over 84 in one of 37 million such pairs, of other sizes one of 70 billion.
COPY_RADIUS = 84
#: Fingerprints of a branch that are compared with each other outright, each of four words.
COPY_LEAF = 128
#: Documents from which common shingles are learnt, and how many must hold one. They only order the shingles.
COMMON_SAMPLE, COMMON = 4_000, 20
#: Pairs for each member of a group that are listed and verified one by one; a group with more is compared whole.
LISTED = 8
#: Members of a tile of a group, and members and shingles of a block of a dense cluster.
TILE, BLOCK, BLOCK_SHINGLES = 4_096, 512, 131_072


def simhash(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one whole text.

    Words are those of the text with A-Z lower-cased; shingles are ``k`` words joined
    by a space, repeats included; fewer words make one shingle of all, none gives 0.
    A bit is set if more than half the shingles' XXH64 have it.
    """
    h = _hashes(text, k, seed)
    return _majority(h) if len(h) else 0


def _hashes(text: str | None, k: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if n else [], np.uint64)
    buf = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.empty(n, np.int64)
    starts[0], starts[1:] = 0, ends[:-1]
    digest = xxhash.xxh64_intdigest
    m = n - k + 1
    view = memoryview(buf)
    return np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[:m].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, m)


def _majority(h: np.ndarray) -> int:
    m = len(h)
    rows = h.view(np.uint8).reshape(m, 8)
    if m > 1500:
        counts = np.concatenate([np.bincount(rows[:, j], minlength=256) @ _BITS for j in range(8)])
    else:
        counts = np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view(np.uint64)[0])


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of whole texts; fp is the fingerprint's bits as a signed long.

    A null text counts as empty. Only the two columns leave the scan.
    """
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freed(go), "doc_id long, fp long")


class ShardTree:
    """A vantage-point tree whose leaves are shards.

    A node keeps a vantage fingerprint v and a radius m; what lies within m of v goes
    inside, the rest outside. Two fingerprints at distance r or less have distances to
    v that differ by r at most (triangle inequality), so a fingerprint whose distance
    is so near m that a partner may lie across is sent both ways. For pairs it is
    enough that both reach half the radius: with h = ceil(r / 2), those with
    m - h < d <= m + h go both ways, and any linked pair meets in one child at least.
    """

    def __init__(self, sample: np.ndarray, shards: int, radius: int = RADIUS, seed: int = 7) -> None:
        self.half = (radius + 1) // 2
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, radius, inside, outside; shards are < 0
        self.shards = 0
        self.root = self._grow(np.asarray(sample, np.uint64), max(1, shards), np.random.default_rng(seed))

    def _leaf(self) -> int:
        self.shards += 1
        return -self.shards

    def _grow(self, at: np.ndarray, shards: int, rng: np.random.Generator) -> int:
        if shards < 2 or len(at) < 4:
            return self._leaf()
        best = None
        for v in rng.choice(at, min(12, len(at)), replace=False):
            counts = np.bincount(np.bitwise_count(at ^ v), minlength=66)
            below = np.cumsum(counts) / len(at)
            for m in range(64):
                if 0.3 <= below[m] <= 0.7:
                    band = counts[max(0, m - self.half + 1) : m + self.half + 1].sum() / len(at)
                    cost = band + 0.5 * abs(below[m] - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, v, m, below[m])
        if best is None:
            return self._leaf()
        _, v, m, _ = best
        near = np.bitwise_count(at ^ v) <= m
        k = len(self.nodes)
        self.nodes.append((0, 0, 0, 0))
        a = self._grow(at[near], shards // 2, rng)
        b = self._grow(at[~near], shards - shards // 2, rng)
        self.nodes[k] = (int(v), m, a, b)
        return k

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the shards they go to; a row near a boundary goes to several."""
        rows, shards = [], []
        todo = [(self.root, np.arange(len(fps)))]
        while todo:
            k, idx = todo.pop()
            if not len(idx):
                continue
            if k < 0:
                rows.append(idx)
                shards.append(np.full(len(idx), -k - 1))
                continue
            v, m, a, b = self.nodes[k]
            d = np.bitwise_count(fps[idx] ^ np.uint64(v)).astype(np.int64)
            todo += [(a, idx[d <= m + self.half]), (b, idx[d > m - self.half])]
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(shards)


def _labels(near: np.ndarray) -> np.ndarray:
    """The smallest position that each row of a symmetric matrix reaches."""
    n = len(near)
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        low = np.where(near, label[None], n).min(1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _apart(fp: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ from one; a fingerprint of several words is a row."""
    d = np.bitwise_count(fp ^ v)
    return d.astype(np.int64) if fp.ndim == 1 else d.sum(1, dtype=np.int64)


def _halves(d: np.ndarray, half: int) -> tuple[float, int] | None:
    """The radius that leaves least on the larger side, if that is 0.9 of the rows or fewer."""
    radii = np.unique(np.quantile(d, [0.35, 0.5, 0.65], method="lower")).tolist()
    most, m = min((max(np.mean(d <= m + half), np.mean(d > m - half)), m) for m in radii)
    return (most, m) if most <= 0.9 else None


def _peels(d: np.ndarray, half: int) -> tuple[float, int] | None:
    """The radius, of all, that leaves fewest pairs on both sides, if that is 0.98 of them or fewer:
    where most distances are alike, a vantage point still parts its own cluster from the rest."""
    upto = np.cumsum(np.bincount(d, minlength=int(d.max()) + 1)) / len(d)
    m = np.arange(len(upto))
    near, far = upto[np.minimum(m + half, len(upto) - 1)], 1 - np.where(m < half, 0, upto[np.maximum(m - half, 0)])
    pairs = near * near + far * far
    k = int(pairs.argmin())
    return (pairs[k], k) if pairs[k] <= 0.98 else None


def branches(fp: np.ndarray, radius: int, leaf: int = LEAF, seed: int = 7, split: Callable[[np.ndarray, int], tuple[float, int] | None] = _halves) -> Iterator[np.ndarray]:
    """Positions of fingerprints by branch of a vantage-point search: any two within ``radius``
    stand together in one branch at least.

    A branch is split by the distance to one of its fingerprints, and what lies within half
    the radius of the boundary goes both ways, so that every pair meets in one of the two
    (see ``ShardTree``). Branches of up to ``leaf``, and those for which ``split`` finds no
    radius for any vantage point, are given out as they are.
    """
    if len(fp) <= leaf:
        yield np.arange(len(fp))
        return
    half = (radius + 1) // 2
    rng = np.random.default_rng(seed)
    todo = [np.arange(len(fp))]
    while todo:
        at = todo.pop()
        best = None
        if len(at) > leaf:
            some = fp[at] if len(at) <= 4096 else fp[rng.choice(at, 4096, replace=False)]
            for v in rng.choice(some, 8):
                got = split(_apart(some, v), half)
                if got is not None and (best is None or got[0] < best[0]):
                    best = (*got, v)
        if best is not None:
            d = _apart(fp[at], best[2])
            near, far = at[d <= best[1] + half], at[d > best[1] - half]
            if max(len(near), len(far)) < len(at):
                todo += [near, far]
                continue
        yield at


def vantage_links(fp: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(a, b)``, a < b, of fingerprints that are joined by links of ``radius``: their
    closure is that of all pairs within ``radius``. The rows of each of the ``branches`` are
    compared outright, in blocks.
    """
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for at in branches(fp, radius, leaf, seed):
        for i in range(0, len(at), 1024):
            for j in range(i, len(at), 1024):
                x, y = at[i : i + 1024], at[j : j + 1024]
                rows = np.concatenate([x, y]) if j > i else x
                label = _labels(np.bitwise_count(fp[rows][:, None] ^ fp[rows][None]) <= radius)
                far = np.flatnonzero(label != np.arange(len(rows)))
                got.append((rows[label[far]], rows[far]))
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*got, strict=True))
    return np.minimum(a, b), np.maximum(a, b)


def _shard_links(radius: int, leaf: int):
    """Links inside one shard, as stars: each row to the smallest id it is joined with there."""

    def work(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        order = np.argsort(g["rep"], kind="stable")
        fp, rep = g["fp"][order].view(np.uint64), g["rep"][order]
        found = Union(len(fp))
        a, b = vantage_links(fp, radius, leaf)
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            found.link(p, q)
        roots = found.roots()
        far = roots != np.arange(len(fp))
        return {"a": rep[roots[far]], "b": rep[far]} if far.any() else None

    return work


def link(fps: DataFrame, shard: int = SHARD, sampled: int = SAMPLED, leaf: int = LEAF) -> DataFrame:
    """``(a, b)`` links between the ids of distinct fingerprints ``(fp, rep)``, a written table.

    Joining them gives every pair within two bits: a vantage-point tree, grown from a
    sample, deals the fingerprints to shards, rows near a boundary to each shard that may
    hold a partner, and each shard is searched by vantage points of its own. The number
    of shards follows that of the fingerprints; only the tree goes to the executors.
    """
    spark = fps.sparkSession
    n = fps.count()
    shards = max(1, math.ceil(n / shard))
    chosen = fps.where(share(11, "fp") < min(1.0, shards * sampled / max(1, n))) if shards > 1 else fps.limit(0)
    got = np.array([r[0] for r in chosen.select("fp").toLocalIterator()], np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(ShardTree(got, shards))
    out = pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("rep", pa.int64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows, shards = tree.value.route(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(fp[rows]), pa.array(rep[rows])], schema=out)

    dealt = fps.select("fp", "rep").mapInArrow(freed(go), "shard int, fp long, rep long")
    return cut(by_group(dealt, ["shard"], _shard_links(RADIUS, leaf), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    component_id is the smallest doc_id reachable by links of two differing bits or
    fewer, itself included. Documents without words have fingerprint 0 and link like
    any other. Equal fingerprints are collapsed before the search, so groups of exact
    copies cost one row. A null id gets the component of its fingerprint; repeated
    rows stay repeated; an empty table gives no row.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    links = link(reps.where("rep is not null"))
    comp = components(links)
    of_fp = cut(reps.join(comp, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n"))
    out = held(meet(fps, of_fp, "fp", fps.count()).select("doc_id", "fp", "component_id"))
    spent(fps, reps, links, comp, of_fp)
    return out


def shingle_set(text: str | None, k: int = COPY_WORDS, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text without words has the one hash 0."""
    h = np.unique(_hashes(text, k, seed))
    return h if len(h) else np.zeros(1, np.uint64)


def _common(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents of a sample hold, 50,000 at most."""
    n = texts.count()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), k).view(np.int64))], names=["h"])

    some = texts.where(share(17, "text") < COMMON_SAMPLE / max(1, n)).select("text").mapInArrow(freed(go), "h long")
    got = some.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(50_000)
    return np.sort(np.array([r[0] for r in got.collect()], np.int64).view(np.uint64))


FPS = [f"f{i}" for i in range(4)]


def wide_simhash(h: np.ndarray) -> list[int]:
    """Four 64-bit SimHash fingerprints of a set of hashes, as signed longs."""
    with np.errstate(over="ignore"):
        salted = [h, *(mix64(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i)) for i in range(1, 4))]
    return [x - ((x >> 63) << 64) for x in map(_majority, salted)]


def _close(radius: int, least: float, leaf: int = COPY_LEAF):
    """Of a tile of a group, searched by vantage points: ``(0, a, b)`` for pairs that may be similar
    and aren't yet in one component or, if these are more than ``LISTED`` for each member,
    ``(1, a, b)`` that joins the members concerned to one of them."""

    def work(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        comp, n, sh, block = g["comp"], g["n"], g["sh"], g["block"]
        fps = [g[f].view(np.uint64) for f in FPS]
        one = g["i"][0] == g["j"][0]
        most = LISTED * len(sh)
        few: list[np.ndarray] = []
        count, some, dense = 0, np.zeros(len(sh), bool), False
        for at in branches(np.stack(fps, 1), radius, leaf, split=_peels):
            step = max(1, 2_000_000 // len(at))
            for k in range(0, len(at), step):
                x, y = at[k : k + step, None], at[None]
                may = comp[x] != comp[y]
                may &= np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-9
                may &= (sh[x] < sh[y]) if one else (block[x] == g["i"][0]) & (block[y] == g["j"][0])
                a, b = np.nonzero(may)
                a, b = at[a + k], at[b]
                apart = sum(np.bitwise_count(f[a] ^ f[b]).astype(np.int64) for f in fps)
                a, b = a[apart <= radius], b[apart <= radius]
                some[a] = some[b] = True
                if len(a) and not dense:
                    few.append(a * len(sh) + b)
                    count += len(a)
                    if count > most:  # a pair near a boundary is found on both sides
                        few = [np.unique(np.concatenate(few))]
                        count = len(few[0])
                        dense = count > most
        if not count:
            return None
        if dense:
            b = sh[some]
            return {"kind": np.ones(len(b), np.int32), "a": np.full(len(b), b.min()), "b": b}
        a, b = np.divmod(np.unique(np.concatenate(few)) if len(few) > 1 else few[0], len(sh))
        return {"kind": np.zeros(len(a), np.int32), "a": sh[a], "b": sh[b]}

    return work


def _similar(least: float):
    """Links of a tile of a dense cluster, as stars, from the overlaps of all its sets."""

    def work(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        sh, start = np.unique(g["sh"], return_index=True)
        sets = [np.frombuffer(g["shingles"][k], np.uint64) for k in start]
        n = np.array([len(x) for x in sets])
        _, col, held_by = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = held_by > 1
        place = np.cumsum(shared) - 1
        row, col = row[shared[col]], place[col[shared[col]]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        same = np.zeros((len(sets), len(sets)), np.float32)
        width = 2048
        edges = np.searchsorted(col, np.arange(0, int(shared.sum()) + width, width))
        for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            has = np.zeros((len(sets), width), np.float32)
            has[row[x:y], col[x:y] - k * width] = 1
            same += has @ has.T
        label = _labels(same >= least * (n[:, None] + n[None] - same) - 1e-9)
        far = np.flatnonzero(label != np.arange(len(sets)))
        return {"a": sh[label[far]], "b": sh[far]} if len(far) else None

    return work


def _tiles(block: Column, blocks: Column) -> Column:
    """The tiles ``(i, j)`` that a row of ``block`` belongs to; rows of any two blocks meet in one."""
    return F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda c: F.struct(F.least(block, c).alias("i"), F.greatest(block, c).alias("j"))))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COPY_WORDS, least: float = COPY_LEAST, radius: int = COPY_RADIUS) -> DataFrame:
    """``(doc_id, first)`` of rows with an id: first is the smallest id that is reachable by
    pairs whose sets of ``k``-word shingles have a Jaccard similarity of ``least`` or more.

    At such a radius a tree over all sets parts next to nothing, so it isn't the tree that
    deals them to shards but their prefixes: under any order of all shingles, two sets that
    are similar share one of the first n - ceil(least * n) + 1 of each. Each shard's
    fingerprints are searched by vantage points, and pairs of similar size and within
    ``radius`` are verified on the whole sets. The first vantage point of a shard is its
    smallest set; what links to it is one component and needn't be compared again. The rest
    is split by further vantage points (``branches``), and the pairs in different components
    are listed, unless they are more than ``LISTED`` for each set: such dense groups are
    gathered to clusters, whose sets are compared whole, block by block, so that no pairs
    are written for them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    common = docs.sparkSession.sparkContext.broadcast(_common(texts, k))
    out = pa.schema([("doc_id", pa.int64()), ("sh", pa.int64()), *((f, pa.int64()) for f in FPS), ("n", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t.as_py(), k) for t in b.column(1)]
            first = []
            for h in sets:
                late = np.isin(h, common.value, assume_unique=True)
                first.append(np.concatenate([h[~late], h[late]])[: len(h) - math.ceil(least * len(h) - 1e-9) + 1].view(np.int64))
            sh = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            fps = np.array([wide_simhash(h) for h in sets], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sh), *(pa.array(fps[:, i]) for i in range(4)), pa.array([len(h) for h in sets], pa.int64()), pa.array(first, pa.list_(pa.int64()))], schema=out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("sh", pa.int64()), ("shingles", pa.binary())])
        for b in slices(batches):
            sets = [shingle_set(t.as_py(), k) for t in b.column(0)]
            sh = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sh), pa.array([h.tobytes() for h in sets], pa.binary())], schema=kind)

    def same(a: pa.Array, b: pa.Array) -> pa.Array:
        sets = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True))
        found = ((len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in sets)
        return pa.array([s >= least * (n - s) - 1e-9 for s, n in found], pa.bool_())

    rows = cut(texts.mapInArrow(freed(go), "doc_id long, sh long, f0 long, f1 long, f2 long, f3 long, n long, prefix array<long>"))
    sets = cut(rows.groupBy("sh").agg(F.min("doc_id").alias("rep"), *(F.first(f).alias(f) for f in FPS), F.first("n").alias("size"), F.count("*").alias("n")))
    one = rows.join(sets.select("sh", F.col("rep").alias("doc_id")), ["sh", "doc_id"], "left_semi").select("sh", "prefix")
    keys = one.select(F.explode("prefix").alias("key"), "sh")
    live = cut(keys.groupBy("key").agg(F.min("sh").alias("low"), F.max("sh").alias("high"), F.count("*").alias("c")).where("low != high").drop("high"))
    met = cut(keys.join(small(live), "key"))
    spent(live)

    def fetched(which: DataFrame) -> DataFrame:
        """The whole sets of ``sh``, read from the texts of their first documents."""
        need = cut(sets.join(which, "sh", "left_semi").select(F.col("rep").alias("doc_id")))
        full = cut(texts.join(small(need), "doc_id", "left_semi").select("text").mapInArrow(freed(whole), "sh long, shingles binary").dropDuplicates(["sh"]))
        spent(need)
        return full

    def verified(pairs: DataFrame) -> DataFrame:
        full = fetched(pairs.select(F.explode(F.array("a", "b")).alias("sh")))
        both = pairs.join(full.select(F.col("sh").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("sh").alias("b"), F.col("shingles").alias("y")), "b")
        out = cut(both.where(F.arrow_udf(same, "boolean")("x", "y")).select("a", "b"))
        spent(full)
        return out

    side = lambda x: sets.select(F.col("sh").alias(x), *(F.col(f).alias(f"{f}_{x}") for f in FPS), F.col("size").alias(f"n_{x}"))
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in FPS])
    stars = met.where("low != sh").select(F.col("low").alias("a"), F.col("sh").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    stars = stars.where(apart <= radius).where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
    stars = cut(stars.select("a", "b"))
    links = verified(stars)
    of = components(links)
    left = cut(met.join(of, F.col("sh") == F.col("node"), "left").select("key", "sh", "c", F.coalesce("component", "sh").alias("comp")))
    open_ = cut(left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key"))
    blocks = F.ceil(F.col("c") / TILE).cast("int")
    left = left.join(small(open_), "key", "left_semi").join(sets.select("sh", *FPS, F.col("size").alias("n")), "sh").withColumn("block", F.pmod(F.xxhash64("sh", F.lit(5)), blocks).cast("int"))
    tiled = left.select("key", _tiles(F.col("block"), blocks).alias("t"), "block", "sh", "comp", *FPS, "n").select("key", "t.i", "t.j", "block", "sh", "comp", *FPS, "n")
    found = cut(by_group(tiled, ["key", "i", "j"], _close(radius, least), "kind int, a long, b long"))
    pairs = cut(found.where("kind = 0").select("a", "b").distinct())
    more = verified(pairs)

    dense = components(found.where("kind = 1"))
    sizes = dense.join(sets.select(F.col("sh").alias("node"), "size"), "node")
    blocks = F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK)).cast("int")
    clusters = cut(sizes.groupBy("component").agg(blocks.alias("blocks"), F.count("*").alias("n")))
    full = fetched(dense.select(F.col("node").alias("sh")))
    members = cut(meet(dense, clusters, "component", dense.count()))
    members = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    members = members.select(F.col("node").alias("sh"), "component", _tiles(F.col("block"), F.col("blocks")).alias("t")).join(full, "sh")
    whole_links = cut(by_group(members.select("component", "t.i", "t.j", "sh", "shingles"), ["component", "i", "j"], _similar(least), "a long, b long"))
    spent(of, met, stars, found, pairs, open_, dense, clusters, full)

    of = components(links.unionByName(more).unionByName(whole_links))
    at = cut(sets.join(of, F.col("sh") == F.col("node"), "left").select("sh", "rep", "n", F.coalesce("component", "sh").alias("comp")))
    lowest = at.groupBy("comp").agg(F.min("rep").alias("first"))
    first = cut(at.join(lowest, "comp").select("sh", "first", "n"))
    out = held(meet(rows.select("doc_id", "sh"), first, "sh", rows.count()).select("doc_id", "first"))
    spent(rows, sets, links, more, whole_links, of, at, first)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without ``near_copies``: of each component the smallest id stays.

    Columns are those of ``docs``. Rows that repeat the kept id are that document and
    stay. Rows with a null id are kept, as nothing tells them apart.
    """
    drop = near_copies(docs, id_col, text_col).where("doc_id != first").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(small(drop), id_col, "left_anti").select(*docs.columns)
