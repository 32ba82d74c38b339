"""Document fingerprints: one-permutation MinHash with optimal densification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import cut, mix64, share, spent

#: Words of a shingle, bins, and bits kept of each bin's least hash.
SHINGLE, BINS, BITS = 5, 256, 4
#: Characters of a range of documents that one task edits.
RANGE = 64_000_000
_PAIRS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
_ORDERS: dict[int, np.ndarray] = {}


def _orders(bins: int) -> np.ndarray:
    """For each bin the other bins in a random order: where an empty one borrows."""
    if bins not in _ORDERS:
        rng = np.random.default_rng(20_17)
        _ORDERS[bins] = np.stack([rng.permutation(bins) for _ in range(bins)])
    return _ORDERS[bins]


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words; of fewer words, of all of them; none of no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m, k = (n - k + 1, k) if n > k else (1, n)
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64(k))
        for j in range(k):
            h += (w[j : j + m] ^ _PAIRS[(j + 3) % 8]) * _PAIRS[j % 8]
            h ^= h >> np.uint64(29)
    return mix64(h)


def fingerprint(text: str, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> np.ndarray:
    """The low bits of each bin's least shingle hash, as small numbers; of a text without
    words an empty array.

    A shingle's high bits choose its bin, once; an empty bin takes over the value of the
    first bin that isn't, in a random order of its own (optimal densification), so that
    two texts agree in a bin with the probability of their Jaccard similarity.
    """
    h = shingle_hashes(text, k)
    if not len(h):
        return np.empty(0, np.uint8)
    h.sort()
    shift = np.uint64(64 - (bins - 1).bit_length())
    at = np.searchsorted(h, np.arange(bins, dtype=np.uint64) << shift)
    least = h[np.minimum(at, len(h) - 1)]
    full = (least >> shift) == np.arange(bins, dtype=np.uint64)
    full &= at < len(h)
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _orders(bins)[empty]
        least[empty] = least[order[np.arange(len(empty)), full[order].argmax(1)]]
    return (mix64(least) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(values: np.ndarray, bits: int = BITS) -> str:
    """Lowercase hex of the low bits, bin after bin; empty for a text without words."""
    if not len(values):
        return ""
    rows = np.unpackbits(values[:, None], axis=1)[:, 8 - bits :]
    return np.packbits(rows.reshape(-1)).tobytes().hex()


def unpacked(text: str, bits: int = BITS) -> np.ndarray:
    """What ``packed`` packed."""
    if not text:
        return np.empty(0, np.uint8)
    raw = np.unpackbits(np.frombuffer(bytes.fromhex(text), np.uint8))
    rows = raw[: len(raw) // bits * bits].reshape(-1, bits)
    return np.packbits(np.concatenate([np.zeros((len(rows), 8 - bits), np.uint8), rows], axis=1), axis=1)[:, 0]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """Estimated Jaccard similarity: the share of equal bins less what chance makes equal,
    2^-bits of the unlike, within 0 and 1. Two texts without words are alike, one isn't."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    chance = 1.0 / (1 << bits)
    return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1.0 - chance))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint)`` of whole texts; a null text counts as empty."""
    out = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(fingerprint(t.as_py() or "", bins, bits, k), bits) for t in b.column(1)], pa.string())], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(go, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, id, tail, text)`` such that within a partition, sorted, the row after each
    is the next document; rows marked ``tail`` only stand after the last of a part.

    Ids are cut into ranges of about equal numbers of characters, by quantiles of a sample
    in which a document stands by its length: ranges of ``RANGE`` characters, and as many as
    the session shuffles to at least. Each range's texts go to one task in one shuffle,
    with a copy of the next range's first document; a range's first id is all that the
    driver sees of it. Null ids come last, and after the last document the first follows
    again.
    """
    spark = docs.sparkSession
    ids = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("w")))
    total = ids.agg(F.sum(F.col("w") + 1)).first()[0] or 1
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / RANGE))
    known = ids.where("id is not null").where(share(53, "id") < (F.col("w") + 1) * F.lit(200 * parts / total))
    cuts = known.select(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    def placed(ids_: pa.Array) -> np.ndarray:
        part = np.searchsorted(cuts, ids_.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(ids_.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, part).astype(np.int32)

    number = F.arrow_udf(lambda x: pa.array(placed(x)), "int")
    firsts = sorted((r[0], r[1]) for r in ids.select("id", number("id").alias("part")).groupBy("part").agg(F.min("id")).collect())
    spent(ids)
    # the part before, for the first id of each part
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    def ends(x: pa.Array) -> pa.Array:
        own = x.to_pylist()
        return pa.array([before.get(i) for i in own], pa.int32())

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("part", number("id")).withColumn("end", F.arrow_udf(ends, "int")("id"))
    tail = F.col("end")
    spread = rows.withColumn("x", F.explode(F.when(tail.isNull(), F.array(F.struct("part", F.lit(False).alias("tail")))).otherwise(F.array(F.struct("part", F.lit(False).alias("tail")), F.struct(tail.alias("part"), F.lit(True).alias("tail"))))))
    spread = spread.select("x.part", F.col("id").isNull().alias("last"), "id", "x.tail", "text")
    return spread.repartition(parts, "part").sortWithinPartitions("part", "tail", "last", "id", F.xxhash64("text"))


def edited(text: str, following: str) -> str:
    """The text with its last half's code points replaced by as many of the next one's first."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n] if n else text


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)`` for each row of ``docs``.

    The next document is that of the next id (equal ids by the text's hash, null ids
    last), after the last the first. A null text counts as empty. Equal texts have equal
    fingerprints. A text of one code point is edited to itself; a lone document is its
    own next.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for b in batches:
            # tails have a part's first text; of several rows with one id the first counts
            for part, i, tail, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                text = text.as_py() or ""
                if held is not None and held[0] == part:
                    print_ = fingerprint(text, bins, bits, k)
                    _, own_id, own, own_print = held
                    changed = edited(own, text)
                    new_print = own_print if changed == own else fingerprint(changed, bins, bits, k)
                    rows.append((own_id, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), packed(own_print, bits), packed(new_print, bits), likeness(own_print, new_print, bits), likeness(own_print, print_, bits)))
                    held = None if tail else (part, i, text, print_)
                elif not tail:
                    held = (part, i, text, fingerprint(text, bins, bits, k))
                if len(rows) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return with_next(docs, id_col, text_col).mapInArrow(go, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
