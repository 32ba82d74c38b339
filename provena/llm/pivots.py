"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import Union, by_group, cut, freed, held, meet, share, slices, small, spent
from provena.llm.components import components

#: Reference points: about two for each root of the number of vectors, within these bounds and
#: these bytes, as they go to every task.
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES = 64, 16_384, 64 << 20
#: Nearest pivots that describe a vector (one more for each doubling of the pivots beyond ``FEW``), and
#: how many of them two vectors have to share.
NEAREST, FEW, SHARED = 6, 512, 2
#: Cosine at which vectors link.
COSINE = 0.9
#: Rows of an inverted list that one tile holds; longer lists are dealt to pairs of tiles.
TILE = 1_024
#: Lists are numbered by their two pivots, the lower one times this.
STEP = 1 << 20
#: What single precision may add to the error of a cosine of rounded vectors.
SLACK = 1e-5


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)``: v the vector at unit length in double precision, or null if it is
    null, zero, or holds a null or a component that isn't finite."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.col("x").isNotNull() & F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    # a power of the largest component is taken out first, so that squares stay finite
    top = F.array_max(F.transform("x", F.abs))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).withColumn("x", F.when(fine, F.col("x"))).withColumn("top", top)
    rows = rows.withColumn("x", F.when(F.col("top") > 0, F.transform("x", lambda c: c / F.col("top"))))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    return rows.select("vec_id", F.when(F.col("x").isNotNull(), F.transform("x", lambda c: c / norm)).alias("v"))


def nearest_of(pivots: int, nearest: int = NEAREST, few: int = FEW) -> int:
    """How many pivots describe a vector: with more pivots two near vectors share fewer of theirs."""
    return nearest + max(0, math.ceil(math.log2(max(pivots, 1) / few)))


def choose_pivots(units: DataFrame, n: int, width: int, most: int = MOST_PIVOTS, seed: int = 3) -> np.ndarray:
    """Unit vectors of a seeded sample of at most ``most`` rows, no two nearer than 0.6."""
    m = int(min(most, PIVOT_BYTES // (8 * max(width, 1)), max(LEAST_PIVOTS, 2 * n**0.5)))
    got = units.where(share(seed, "rep") < 1.5 * m / max(n, 1)).orderBy(share(seed, "rep")).limit(m).select("v").collect()
    kept = np.empty((len(got), width))
    k = 0
    for r in got:
        v = np.array(r[0])
        if not k or (kept[:k] @ v).max() < 0.6:
            kept[k] = v
            k += 1
    return kept[:k]


def describe(units: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """``(rep, n, q, err, near, list)`` of units ``(rep, n, v)``: q the vector in half precision
    and err how far that is from it; near the numbers of the nearest pivots in order; list
    a number for each pair of them."""
    held_ = units.sparkSession.sparkContext.broadcast(pivots)
    k = min(nearest, len(pivots))
    pairs = list(combinations(range(k), 2)) or [(0, 0)]
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    out = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("q", pa.binary()), ("err", pa.float64()), ("near", pa.binary()), ("list", pa.list_(pa.int64()))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held_.value
        for batch in slices(batches):
            v = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            near = np.argsort(-(v @ p.T), axis=1, kind="stable")[:, :k].astype(np.int32)
            x, y = near[:, a].astype(np.int64), near[:, b].astype(np.int64)
            lists = np.minimum(x, y) * STEP + np.maximum(x, y)
            q = v.astype(np.float16)
            err = np.linalg.norm(v - q.astype(np.float64), axis=1)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * lists.shape[1]), pa.array(lists.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(err), pa.array([r.tobytes() for r in near], pa.binary()), listed], schema=out)

    return units.select("rep", "n", "v").mapInArrow(freed(go), "rep long, n long, q binary, err double, near binary, list array<long>")


def _tile_links(cosine: float):
    """Links inside one tile, or across the two sides of a pair of tiles.

    A pair stands in the list of each pair of pivots that both have; only the lowest of
    those lists counts it. What the rounded vectors leave open is said as ``(1, a, b)``, to
    be verified; of the rest ``(0, rep, low, links)`` has each row's count, and the
    smallest row that it is joined with in the tile."""

    def work(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        if len(g["rep"]) < 2:
            return None
        order = np.argsort(g["rep"], kind="stable")
        rep, side, n_copies, err = g["rep"][order], g["side"][order], g["n"][order], g["err"][order]
        v = np.stack([np.frombuffer(x, np.float16) for x in g["q"][order]]).astype(np.float32)
        near = np.stack([np.frombuffer(x, np.int32) for x in g["near"][order]])
        own, m = int(g["list"][0]), len(rep)
        across = int(g["i"][0]) != int(g["j"][0])
        counts = np.zeros(m, np.int64)
        joined = Union(m)
        open_: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, 2_000_000 // m)
        for i in range(0, m, step):
            c = v[i : i + step] @ v[i:].T
            room = err[i : i + step, None] + err[None, i:] + SLACK
            x, y = np.nonzero(c >= cosine - room)
            sure = c[x, y] >= cosine + room[x, y]
            x, y = x + i, y + i
            ok = x < y
            if across:
                ok &= side[x] != side[y]
            x, y, sure = x[ok], y[ok], sure[ok]
            # the two lowest pivots that a pair shares name the list that counts it
            for k in range(0, len(x), 200_000):
                p, q, s = x[k : k + 200_000], y[k : k + 200_000], sure[k : k + 200_000]
                both = (near[p][:, :, None] == near[q][:, None, :]).any(2)
                low = np.sort(np.where(both, near[p], STEP), axis=1)[:, :2].astype(np.int64)
                first = low[:, 0] * STEP + (low[:, 1] if low.shape[1] > 1 else low[:, 0]) == own
                p, q, s = p[first], q[first], s[first]
                open_.append((rep[p[~s]], rep[q[~s]]))
                p, q = p[s], q[s]
                np.add.at(counts, p, n_copies[q])
                np.add.at(counts, q, n_copies[p])
                # linking to a new root only once a row keeps dense tiles cheap
                for t, u in zip(p.tolist(), q.tolist(), strict=True):
                    if joined.up[u] != joined.up[t]:
                        joined.link(t, u)
        has = counts > 0
        a, b = (np.concatenate([x[k] for x in open_]) if open_ else np.empty(0, np.int64) for k in (0, 1))
        if not has.any() and not len(a):
            return None
        return {"kind": np.repeat(np.array([0, 1], np.int32), [has.sum(), len(a)]), "a": np.concatenate([rep[has], a]), "b": np.concatenate([rep[joined.roots()[has]], b]), "links": np.concatenate([counts[has], np.zeros(len(a), np.int64)])}

    return work


def linked(units: DataFrame, n: int, width: int, cosine: float = COSINE, nearest: int = NEAREST, most_pivots: int = MOST_PIVOTS, tile: int = TILE) -> DataFrame:
    """``(a, b, links)`` of the written table ``units`` (``rep, n, v``), n vectors of one width:
    a's links that one tile or one verified pair found, and a row b that it is joined with."""
    pivots = choose_pivots(units, n, width, most_pivots)
    if not len(pivots):
        pivots = np.array([r[0] for r in units.limit(LEAST_PIVOTS).select("v").collect()])
    k = nearest_of(len(pivots), nearest)
    if len(pivots) < k:  # few directions: corner points make up the number
        pivots = np.concatenate([pivots, np.eye(width)[: k - len(pivots)]])
    told = cut(describe(units, pivots, k))
    listed = told.select("rep", F.explode("list").alias("list"))
    sizes = cut(listed.groupBy("list").count().where("count > 1").select("list", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    posted = listed.join(small(sizes), "list").withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    dealt = posted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("list", "rep", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), (F.col("t") > F.col("o")).cast("int").alias("side"))
    full = dealt.join(told.select("rep", "n", "q", "err", "near"), "rep")
    found = cut(by_group(full, ["list", "i", "j"], _tile_links(cosine), "kind int, a long, b long, links long"))
    pairs = found.where("kind = 1").select("a", "b")
    side = lambda x: units.select(F.col("rep").alias(x), F.col("v").alias(f"v{x}"), F.col("n").alias(f"n{x}"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    real = pairs.join(side("a"), "a").join(side("b"), "b").where(dot >= cosine)
    both = F.explode(F.array(F.struct("a", "b", F.col("nb").alias("links")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("na").alias("links"))))
    out = cut(found.where("kind = 0").select("a", "b", "links").unionByName(real.select(both.alias("x")).select("x.*")))
    spent(told, sizes, found)
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, nearest: int = NEAREST, most_pivots: int = MOST_PIVOTS, tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Vectors are compared with those of the same length, each length with an index of its
    own. A vector is described by its nearest pivots of a seeded sample and stands in the
    inverted list of each pair of them: two vectors are compared if they share two
    pivots, and link if their cosine in double precision is ``cosine`` or more. Lists
    carry vectors in half precision; what that leaves open is verified on the vectors.
    Equal vectors are collapsed first, by a 128-bit hash, and count as linked; rows that
    repeat an id count as vectors of their own. A long list is cut into tiles of about
    ``tile`` rows by a hash; pairs of tiles are tasks of their own, so no task grows with a
    list. Tiles return counts and a star, not pairs. Vectors that are null, zero or not
    finite link with nothing. A null id gets a null component and no links. An empty
    table gives no row; other columns, whatever their names, are left aside.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vector_col)
    rows = cut(rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"), F.size("v").alias("d")))
    good = rows.where("v is not null and vec_id is not null")
    units = cut(good.groupBy("h1", "h2", "d").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    widths = [(r[0], r[1]) for r in units.groupBy("d").count().orderBy("d").collect()]  # a row for each length of vectors
    parts = []
    for d, n in widths:
        if n > 1:
            alike = units.where(F.col("d") == d)
            parts.append(linked(alike, n, d, cosine, nearest, most_pivots, tile))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "a long, b long, links long")
    comp = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    told = units.join(links, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    told = cut(told.select(F.struct("h1", "h2", "d").alias("key"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "n"))
    done = meet(good.select("vec_id", F.struct("h1", "h2", "d").alias("key")), told, "key", good.count()).select("vec_id", F.col("n_links").cast("long"), "component_id")
    alone = rows.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = held(done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
    spent(rows, units, *parts, comp, told)
    return out
