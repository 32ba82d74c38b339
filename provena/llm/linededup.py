"""Near-duplicate lines across documents by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from provena.llm.common import cut, free_name, freed, held, mix64, small, spent

#: White space that is left out of a line's ends.
BLANK = " \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _place(id_col: str, text_col: str) -> Column:
    """Where a row stands in the order of the corpus, as one number: by id (null last), then
    the text's hash. A decimal, so that its minimum needs no sort."""
    own = F.col(id_col).cast("long")
    late = F.shiftrightunsigned(F.xxhash64(text_col), 2).cast("decimal(19,0)")
    at = F.coalesce(own, F.lit(0)).cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + late
    return (F.when(own.isNull(), F.lit(str(1 << 126)).cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")) + at).cast("decimal(38,0)")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(place, pos, h1, h2, line)`` for each line that isn't blank."""
    t = docs.select(_place(id_col, text_col).alias("place"), F.col(text_col).alias("text")).where("text is not null")
    rows = t.select("place", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    rows = rows.select("place", "pos", F.btrim("raw", F.lit(BLANK)).alias("line")).where("line != ''")
    return rows.select("place", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), "line")


def _halves() -> list[Column]:
    """Four keys; lines one edit apart have one of them in common.

    Of two lines of n or n + 1 code points, m = n // 2 at least stand unchanged at the
    start (the first and third key) or at the end. A line of 2m + 1 has m as its class, one
    of 2m also m - 1, so that any two lines that may be one edit apart share a class.
    """
    n = F.length("line")
    m = F.floor(n / 2).cast("int")

    def keys(c: Column) -> list[Column]:
        head = F.xxhash64(F.lit(0), c, F.substring(F.col("line"), F.lit(1), c))
        tail = F.xxhash64(F.lit(1), c, F.col("line").substr(n - c + 1, c))
        return [head, tail]

    return [*keys(m), *(F.when(n % 2 == 0, k) for k in keys(m - 1))]


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h1, h2, first, k0, k1, k2, k3)`` of each distinct line: two hashes, the place of the
    first document that has it, and its halves. Numbers only, summed up before the shuffle."""
    lines = lines_of(docs, id_col, text_col).select("place", "h1", "h2", *(k.alias(f"k{i}") for i, k in enumerate(_halves())))
    return lines.groupBy("h1", "h2").agg(F.min("place").alias("first"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)))


def deletion_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line and of it without each of its code points in turn, in O(length)."""
    c = mix64(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(c)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BASE)]), dtype=np.uint64)[:n]
        upto = np.concatenate([[np.uint64(0)], np.cumsum(c * power, dtype=np.uint64)])
        whole = upto[-1]
        without = upto[:-1] + (whole - upto[1:]) * _INVERSE
        own = mix64(np.array([whole ^ np.uint64(n)], np.uint64))
        return own, mix64(without ^ np.uint64(n - 1))


def _variants(near: DataFrame) -> DataFrame:
    """``(key, tag)``: tag is four times ``nid`` plus a role. Role 0 is the line itself, 1 the line
    without a character, 2 that variant and the place of the character together.

    ``near`` holds ``nid, line, sides``: bit 1 of sides says that the line's start stands
    in another line, bit 2 that its end does; the edit is then in the other part, and only
    that part's deletions are emitted.
    """
    out = pa.schema([("key", pa.int64()), ("tag", pa.int64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for nid, line, sides in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own, less = deletion_keys(line)
                n = len(less)
                # a part that stands in another line has n // 2 - 1 code points or more
                some = np.zeros(n, bool)
                if sides & 1:
                    some[max(0, n // 2 - 1) :] = True
                if sides & 2:
                    some[: n - max(0, n // 2 - 1)] = True
                places = np.flatnonzero(some)
                with np.errstate(over="ignore"):
                    placed = mix64(less[places] + _BASE * (places + 1).astype(np.uint64))
                less = np.unique(less[places])
                key = np.concatenate([own, less, placed]).view(np.int64)
                tag = 4 * nid + np.repeat(np.array([0, 1, 2], np.int64), [1, len(less), len(placed)])
                for a in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 100_000]), pa.array(tag[a : a + 100_000])], schema=out)

    return near.select("nid", "line", "sides").mapInArrow(freed(go), "key long, tag long")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key stands in more than one."""
    last = None  # the last row, and whether it is out
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        keep = same.copy()
        keep[:-1] |= same[1:]
        if last is not None and last[0].column(0)[0].as_py() == key[0]:
            keep[0] = True
            if not last[1]:
                yield last[0]
        got = np.flatnonzero(keep)
        if len(got):
            yield b.take(pa.array(got))
        last = (b.slice(len(key) - 1, 1), bool(keep[-1]))


def _candidates(lines: DataFrame) -> DataFrame:
    """``(h1, h2, first, sides)`` of the ``distinct_lines`` that share a half with a different line."""
    half = lines.select("h1", "h2", "first", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("i", "half")).where("half is not null")
    live = cut(half.groupBy("half").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x != y").select("half"))
    side = F.when(F.col("i") % 2 == 0, 1).otherwise(2)
    found = half.join(small(live), "half", "left_semi").groupBy("h1", "h2").agg(F.min("first").alias("first"), F.bit_or(side).alias("sides"))
    out = cut(found)
    spent(live)
    return out


def earlier_neighbours(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(h1, h2)`` of lines with a different line within one edit that stands earlier.

    ``lines`` are the ``distinct_lines`` of ``docs``. Lines that share no half with another
    are left out first (that loses no pair); texts are fetched for the rest only, which emit
    their deletion neighbourhood. Two lines are one edit apart exactly if one is the other
    without a character (roles 0 and 1 meet in a key) or both are equal but for the
    character at one place (role 2 meets). In a key the earliest line answers for all its
    members, so no pairs are listed; the edit distance to it is then verified on the texts.
    Variants are dealt once and sorted by key, so a key's members stand together and those
    that meet none are dropped as they stream by.
    """
    some = _candidates(lines)
    texts = lines_of(docs, id_col, text_col).join(small(some), ["h1", "h2"]).where("place = first")
    near = texts.groupBy("h1", "h2").agg(F.struct(F.first("first").alias("first"), F.min("pos").alias("pos")).alias("occ"), F.first("line").alias("line"), F.first("sides").alias("sides"))
    near = cut(near.withColumn("nid", F.monotonically_increasing_id()))
    sorted_ = _variants(near).repartition("key").sortWithinPartitions("key")
    met = cut(sorted_.mapInArrow(_met, sorted_.schema))
    keys = met.select("key", (F.col("tag") % 4).alias("role"), F.shiftright("tag", 2).alias("nid")).join(near.select("nid", "h1", "h2", "occ"), "nid")
    best = lambda role: F.min(F.when(F.col("role") == role, F.struct("occ", "nid")))
    groups = keys.groupBy("key").agg(best(0).alias("own"), best(1).alias("less"), best(2).alias("placed"))
    other = F.when(F.col("role") == 0, F.col("less")).when(F.col("role") == 1, F.col("own")).otherwise(F.col("placed"))
    found = keys.join(groups, "key").select("nid", "occ", other.alias("o")).where("o is not null and o.occ < occ").select("nid", F.col("o.nid").alias("other")).distinct()
    pairs = found.join(near.select("nid", "h1", "h2", "line"), "nid").join(near.select(F.col("nid").alias("other"), F.col("line").alias("line2")), "other")
    out = cut(pairs.where(F.levenshtein("line", "line2", 1) == 1).select("h1", "h2").distinct())
    spent(some, near, met)
    return out


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(place, kept)``: of each document that keeps lines, the hashes of those it keeps.

    A line is kept by the first document that has it, unless a different line within one
    edit (insertion, deletion or substitution of a code point) stands earlier in the
    corpus, whether or not that line is itself dropped.
    """
    lines = cut(distinct_lines(docs, id_col, text_col))
    gone = earlier_neighbours(docs, lines, id_col, text_col)
    stay = lines.select("h1", "h2", "first").join(small(gone), ["h1", "h2"], "left_anti")
    out = held(stay.groupBy(F.col("first").alias("place")).agg(F.collect_list("h1").alias("kept")))
    spent(lines, gone)
    return out


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("n", LongType())]))
def _without(text: pa.Array, kept: pa.Array) -> pa.Array:
    """Texts with their blank lines and the first of each kept line, and the number of these."""
    texts, counts = [], []
    for t, k in zip(text.cast(pa.binary()).to_pylist(), kept, strict=True):
        if t is None:
            texts.append(None)
            counts.append(0)
            continue
        left = set(k.values.to_pylist()) if k.is_valid else set()
        out = []
        for raw in t.split(b"\n"):
            line = raw.strip(BLANK.encode())
            if line:
                h = xxhash.xxh64_intdigest(line, 42)
                h -= (h >> 63) << 64
                if h not in left:
                    continue
                left.remove(h)
            out.append(raw)
        texts.append(b"\n".join(out))
        counts.append(len(out))
    return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["text", "n"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with the lines that repeat an earlier one dropped from their texts.

    Lines end at ``\\n``, are compared without white space at their ends, and keep it;
    blank lines always stay. Of equal lines and of lines one edit apart, however short,
    the later go. Order is by id (null last), then text, then place. A null text stays
    null; a text may become empty, its row stays. Rows equal in id and text are the same
    document and are treated alike. An empty table gives no row. Other columns pass
    unchanged, whatever their names, but ``n_chars`` is counted anew if there. With
    ``report``, columns ``lines_in`` and ``lines_out`` follow.
    """
    names = docs.columns
    at, kept, new = (free_name(names, x) for x in ("place", "kept", "new"))
    lists = kept_lines(docs, id_col, text_col).select(F.col("place").alias(at), F.col("kept").alias(kept))
    joined = docs.withColumn(at, _place(id_col, text_col)).join(lists, at, "left").withColumn(new, _without(F.col(text_col), F.col(kept)))
    text = F.col(new)["text"]
    cols = {text_col: text.alias(text_col)}
    if "n_chars" in names:
        cols["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    out = [cols.get(c, F.col(c)) for c in names]
    if report:
        n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n")))
        out += [n.cast("long").alias("lines_in"), F.col(new)["n"].alias("lines_out")]
    return joined.select(*out)
