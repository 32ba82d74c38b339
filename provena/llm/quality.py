"""A quality classifier of two zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import share

#: Labelled documents that a model is fitted on, at most; half of them good, half bad.
FIT_DOCS = 3_000
#: Bytes of a dictionary, and bytes of text that are compressed at a time.
DICTIONARY, PIECE = 16_384, 512
LEVEL = 3


class QualityModel:
    """Dictionaries of bad and good text and the curve from size difference to score."""

    def __init__(self, bad: bytes, good: bytes, slope: float, offset: float, empty: float) -> None:
        self.bad, self.good, self.slope, self.offset, self.empty = bad, good, slope, offset, empty


class QualityScorer:
    """Scores texts with a model; holds the compressors."""

    def __init__(self, model: QualityModel) -> None:
        self.model = model
        make = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.tools = [make(model.bad), make(model.good)] if model.bad and model.good else []

    def difference(self, data: bytes) -> float | None:
        """Bytes that the bad dictionary needs more than the good, for each byte of the
        whole text, compressed piece by piece; None for an empty text."""
        if not data or not self.tools:
            return None
        view = memoryview(data)
        bad, good = (t.compress for t in self.tools)
        more = 0
        for i in range(0, len(data), PIECE):
            part = view[i : i + PIECE]
            more += len(bad(part)) - len(good(part))
        return more / len(data)

    def __call__(self, text: str | None) -> float:
        """A score from 0 to 1, higher if good is likelier. A null or empty text scores the
        share of good among the emptiest texts fitted, or among all if none was."""
        x = self.difference((text or "").encode("utf-8", "surrogatepass"))
        if x is None:
            return self.model.empty
        return float(1 / (1 + np.exp(-np.clip(self.model.slope * x + self.model.offset, -30, 30))))


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    parts = [p for p in parts if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(parts)[:DICTIONARY]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge on the scaled slope."""
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (y - p)) - np.array([0.01, 0.0]) * b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.01, 1e-6])
        step = np.linalg.solve(hess, grad)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS) -> QualityModel:
    """Fits a model on a bounded sample of the labelled documents that ``where`` admits.

    Of each label up to half of ``fit_docs`` are taken by a hash of the id. Every other
    one goes into its label's dictionary, the rest calibrate the score, weighted back to
    the labels' shares. Documents with null text or label are left out; of an id with
    several labels the smallest counts. Without both labels every score is the share of
    good among what is there, or 0.5.
    """
    y = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").groupBy("i").agg(F.min("y").alias("y"))
    y = y.where(F.expr("i is not null")).withColumnRenamed("i", id_col).where(where).withColumnRenamed(id_col, "i")
    have = {r[0]: r[1] for r in y.groupBy("y").count().collect()}
    if len(have) < 2:
        alone = float(sum(k for k in have)) if have else 0.5
        return QualityModel(b"", b"", 0.0, 0.0, alone)
    rate = F.when(F.col("y") == 1, fit_docs / 2 / have[1]).otherwise(fit_docs / 2 / have[0])
    chosen = y.where(share(29, "i") < rate)
    # the sample's size is bounded, and so is what is broadcast
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(chosen.limit(2 * fit_docs)), "i")
    rows = texts.select(F.pmod(F.xxhash64("i", F.lit(31)), F.lit(2)).alias("part"), "y", "t", "i").orderBy("i").collect()
    rows = [(r[0], r[1], r[2].encode("utf-8", "surrogatepass")) for r in rows]
    bad, good = (_dictionary([t for p, q, t in rows if p == 0 and q == label]) for label in (0, 1))
    model = QualityModel(bad, good, 0.0, 0.0, have[1] / (have[0] + have[1]))
    scorer = QualityScorer(model)
    held = [(scorer.difference(t), q, len(t)) for p, q, t in rows if p == 1]
    held = [x for x in held if x[0] is not None]
    if len({q for _, q, _ in held}) == 2:
        x, q = np.array([a[0] for a in held]), np.array([a[1] for a in held], float)
        total = have[0] + have[1]
        weight = np.where(q == 1, have[1] / total / q.mean(), have[0] / total / (1 - q.mean()))
        model.slope, model.offset = _logistic(x, q, weight)
    return model


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of whole texts; the model is two dictionaries and three numbers."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = QualityScorer(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([scorer(t.as_py()) for t in b.column(1)], pa.float64())], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(go, "doc_id long, score double")
