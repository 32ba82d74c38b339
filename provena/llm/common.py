"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.tables import cut, held, meet, shared_dir, small, spent, spread

__all__ = ["Union", "bucket_of", "by_group", "columns_of", "cut", "free_name", "freed", "held", "meet", "mix64", "runs", "share", "shared_dir", "slices", "small", "spent", "spread"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def free_name(taken: list[str], base: str) -> str:
    """A column name that is not in ``taken``."""
    low, name = {c.lower() for c in taken}, base
    while name.lower() in low:
        name += "_"
    return name


def bucket_of(id_col: str) -> F.Column:
    """crc32 of an id's decimal text, the split key of the train and held-out folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def share(seed: int, *cols) -> F.Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)).cast("double") / F.lit(float(1 << 53))


def freed(go: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``go`` for ``mapInArrow``, after which a worker gives the memory it doesn't use back to the
    system, so that workers that wait for the next stage hold little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from go(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that little is held of them at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Numpy arrays of a batch without nulls; list columns become matrices."""
    out = {}
    for name, col in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
            flat = col.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of rows that stand together, one at a time; a group may span batches."""
    held: list[dict[str, np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns_of(batch)
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(cols[k][a] for k in keys)
            if held and key != last:
                yield _joined(held)
                held = []
            last = key
            held.append({n: c[a:b] for n, c in cols.items()})
    if held:
        yield _joined(held)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def by_group(df: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """Runs ``work`` on each group of ``keys``, which must be of bounded size.

    One shuffle and one sort; groups then stream through Arrow batches, without the
    cost of an Arrow stream for each that ``applyInPandas`` has.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []
        n = 0
        for group in runs(batches, keys):
            got = work(group)
            if got is None or not len(got[names[0]]):
                continue
            kept.append(got)
            n += len(got[names[0]])
            if n > 20_000:
                yield _batch(kept, arrow)
                kept, n = [], 0
        if kept:
            yield _batch(kept, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(freed(go), schema)


def _batch(parts: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(p[f.name]) for p in parts]), f.type) for f in arrow], schema=arrow)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


class Union:
    """Union-find over a bounded number of rows; roots are the smallest positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.fromiter((self.root(i) for i in range(len(self.up))), np.int64, len(self.up))
