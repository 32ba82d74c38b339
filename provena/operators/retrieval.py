"""Ranked retrieval: BM25 over postings, cosine over vectors, and their fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import arrays
from provena.functions import text as tx
from provena.operators.corpus import ranked
from provena.tables import cut, held, small, spent

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, RRF_DENSE = 60, 1.5


def postings(docs: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, dl)``; each document counts its own terms, without a shuffle."""
    rows = docs.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode(arrays.tally("tokens")).alias("x"))
    return rows.select("doc_id", F.col("x.v").alias("term"), F.col("x.n").cast("long").alias("tf"), "dl")


def doc_stats(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size("tokens").cast("long").alias("dl"))


def term_stats(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``(term, df, idf)``. A negative idf becomes epsilon times the mean over all terms.

    ``n_docs`` is one row with ``n``, and so is the mean; both are joined as such.
    """
    raw = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs))
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best k above 0.01 of each query.

    ``docs`` holds ``doc_id, tokens``; ``queries`` ``query_id, text``. Only postings of
    query terms are joined. A term repeated in a query counts each time.
    """
    post = cut(postings(docs))
    totals = doc_totals(post)
    terms = cut(term_stats(post, totals.select("n")))
    out = held(bm25_over(post, terms, totals, queries, k))
    spent(post, terms)
    return out


def doc_totals(post: DataFrame) -> DataFrame:
    """One row: the number of documents and their average length, from postings."""
    each = post.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    return each.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25_over(post: DataFrame, terms: DataFrame, totals: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    """``bm25`` over stored postings, term statistics and totals. Few terms are broadcast, so that
    the postings stay where they are read."""
    asked = queries.select("query_id", F.explode(tx.tally(tx.index_tokens(F.col("text")))).alias("x")).select("query_id", F.col("x.v").alias("term"), F.col("x.n").alias("qtf"))
    hit = post.join(small(asked.join(terms, "term")), "term").crossJoin(F.broadcast(totals.select("avgdl")))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = hit.groupBy("query_id", "doc_id").agg(F.sum(part).alias("raw")).where("raw > 0.01").withColumn("score", tx.rounded(F.col("raw"), 6)).drop("raw")
    return ranked(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(c: str) -> F.Column:
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return tx.let(norm, lambda n: F.when(n > 0, F.transform(c, lambda x: x.cast("double") / n)))


#: Query vectors that a block holds, and blocks that are sent at once.
QUERY_BLOCK, QUERY_BLOCKS = 512, 32


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, above: float = 0.45, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, vec_id, cosine, rank)`` of the exact k nearest above a cosine.

    ``queries`` (``query_id, q``) go to the vectors' tasks as matrices of at most
    ``block * QUERY_BLOCKS`` rows, so that vectors stay where they are read; more go one
    batch after the other. A task keeps of each query what may be among its k nearest.
    """
    q = cut(queries.select("query_id", unit("q").alias("q")).where("q is not null").withColumn("block", F.floor(F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)))))
    v = vectors.select("vec_id", unit("embedding").alias("v")).where("v is not null")
    parts = max(1, math.ceil(q.count() / (block * QUERY_BLOCKS)))
    found = None
    for i in range(parts):
        got = searched(v, q.where(F.pmod("block", F.lit(parts)) == i).select("query_id", "q"), k, above)
        found = got if found is None else found.unionByName(got)
    out = held(ranked(found, ["query_id"], [F.desc("cosine"), F.asc("vec_id")], k))
    spent(q)
    return out


def matrices(rows: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(places, matrix)`` of the rows of each length; vectors of other lengths don't compare."""
    rows = pa.chunked_array(rows.chunks, pa.list_(pa.float64())).combine_chunks()
    sizes, flat = np.diff(rows.offsets.to_numpy()), rows.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out.append((at, flat[first[at][:, None] + np.arange(n)]))
    return out


#: Vectors and queries that are multiplied at once, and what a cosine may lose to rounding.
TILE, SLACK = 4_096, 2e-6


def searched(v: DataFrame, queries: DataFrame, k: int, above: float, centres: np.ndarray | None = None, probe: int = 0) -> DataFrame:
    """``(query_id, vec_id, cosine)``: of each task what may be among the k nearest of a query above
    a cosine, to six digits. ``v`` holds ``vec_id, v`` and ``queries`` ``query_id, q``, at unit length.

    With ``centres``, ``v`` has a column ``cell``, and a query sees its ``probe`` nearest cells.
    """
    spark = v.sparkSession
    asked = queries.toArrow()
    ids = asked["query_id"].combine_chunks()
    tiles = []
    for at, m in matrices(asked["q"]):
        for i in range(0, len(at), TILE // 8):
            some, seen = m[i : i + TILE // 8], None
            if centres is not None:
                s = some @ centres.T
                order = np.lexsort((np.broadcast_to(np.arange(s.shape[1]), s.shape), -s), axis=1)[:, :probe]
                seen = np.zeros(s.shape, bool)
                np.put_along_axis(seen, order, True, axis=1)
            tiles.append((at[i : i + TILE // 8], some, seen))
    own: dict = {}
    for j, x in enumerate(ids.to_pylist()):
        own.setdefault(x, []).append(j)
    sent = spark.sparkContext.broadcast((ids, tiles, own))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tiles, own = sent.value
        least = [np.full(len(at), above - SLACK) for at, _, _ in tiles]
        for b in (b.slice(i, TILE) for b in batches for i in range(0, b.num_rows, TILE)):
            names = b["vec_id"]
            mine = [own.get(x, ()) for x in names.to_pylist()] if own else []
            for rows, m in matrices(pa.chunked_array([b["v"]])):
                for t, (at, some, seen) in enumerate(tiles):
                    if some.shape[1] != m.shape[1]:
                        continue
                    c = np.nan_to_num(some @ m.T, nan=0.0)
                    place = {int(j): i for i, j in enumerate(at)}
                    for i, r in enumerate(rows):
                        for j in mine[r]:
                            if j in place:
                                c[place[j], i] = -np.inf
                    if seen is not None:
                        c[~seen[:, b["cell"].to_numpy(zero_copy_only=False)[rows]]] = -np.inf
                    if c.shape[1] >= k:
                        least[t] = np.maximum(least[t], np.partition(c, -k, axis=1)[:, -k] - SLACK)
                    i, j = np.nonzero(c >= least[t][:, None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[i])), names.take(pa.array(rows[j])), pa.array(c[i, j])], ["query_id", "vec_id", "c"])

    kinds = dict(queries.dtypes) | dict(v.dtypes)
    got = v.mapInArrow(go, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, c double")
    return got.select("query_id", "vec_id", tx.rounded(F.col("c"), 6).alias("cosine")).where(F.col("cosine") > above)


def fuse(lexical: DataFrame, dense: DataFrame, k: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of two ``(query_id, doc_id, rank)`` lists, to six digits."""
    a = lexical.select("query_id", "doc_id", (1.0 / (RRF_K + F.col("rank"))).alias("part"))
    b = dense.select("query_id", "doc_id", (RRF_DENSE / (RRF_K + F.col("rank"))).alias("part"))
    both = a.unionByName(b).groupBy("query_id", "doc_id").agg(tx.rounded(F.sum("part"), 6).alias("score"))
    return ranked(both, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


#: Share of the cells that a query visits; see the README for the recall it gives.
PROBED = 0.75


def cells(vectors: DataFrame, n: int | None = None, seed: int = 1):
    """An inverted-file index: the k-means model and ``vectors`` with their cell.

    There are ``sqrt(rows)`` cells, between 8 and 256, unless ``n`` says how many.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("features", array_to_vector(unit("embedding")))
    k = n or min(256, max(8, round(math.sqrt(vectors.count()))))
    model = KMeans(k=k, seed=seed, maxIter=8, distanceMeasure="cosine", predictionCol="cell").fit(rows)
    return model, model.transform(rows).drop("features")


def probe_cells(model, indexed: DataFrame, queries: DataFrame, probe: int | None = None, k: int = 20, above: float = 0.45) -> DataFrame:
    """Nearest neighbours among the rows of each query's ``probe`` nearest cells, by default
    the share ``PROBED`` of all; with as many as there are cells the search is exact."""
    centres = np.array(model.clusterCenters())
    q = queries.select("query_id", unit("q").alias("q")).where("q is not null")
    v = indexed.select("vec_id", "cell", unit("embedding").alias("v")).where("v is not null")
    found = searched(v, q, k, above, centres, probe or math.ceil(PROBED * len(centres)))
    return ranked(found, ["query_id"], [F.desc("cosine"), F.asc("vec_id")], k)
