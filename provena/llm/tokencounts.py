"""Token totals kept by deltas: additive rollups with idempotent batch commits."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.mixing import word_count

#: Where the vocabulary lies on every machine, and the name under which its counts go.
RANKS, VERSION = "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_50k/1"
#: The pattern by which that vocabulary's texts are cut before merging (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def token_counts(docs: DataFrame, path: str = RANKS, version: str = VERSION, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``(id, source, lang, tokenizer, tokens, digest)`` of whole texts; null texts have none.

    digest is the md5 of the text, by which later changes of a document show. Rows pass
    as they are, repeated ones included.
    """
    out = pa.schema([("id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("digest", pa.string()), ("tokens", pa.int64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py() or "")) for t in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64())], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), F.col(text_col).alias("t"))
    got = rows.mapInArrow(go, "id long, source string, lang string, digest string, tokens long")
    return got.select("id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens", "digest")


def word_counts(docs: DataFrame, version: str = "words/1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The same of runs between ASCII white space, without Python."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.lit(version).alias("tokenizer"), word_count(F.col(text_col)).alias("tokens"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"))


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes that add documents: one document and its tokens."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes that take documents away."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes between two states of the counts.

    What only one state has is inserted or deleted; a revised count, or a document that
    moved to another source or language, is both. Rows are compared by id, keys and count
    as often as they stand, so repeated ids and rows, and null ids, need no care.
    """
    rows = old.select("id", *KEYS, "tokens", F.lit(-1).alias("sign")).unionByName(new.select("id", *KEYS, "tokens", F.lit(1).alias("sign")))
    net = rows.groupBy("id", *KEYS, "tokens").agg(F.sum("sign").alias("docs")).where("docs != 0")
    return net.select(*KEYS, "docs", (F.col("tokens") * F.col("docs")).alias("tokens"))


class TokenRollup:
    """Totals by source, language and tokenizer version under a folder that all share.

    A batch of signed changes is summed before it is written, so a batch is as small as
    the totals. Its rows are written to a folder of their own; the commit is a file with
    the batch's name, which tells that folder and which a file system creates once only:
    of two drivers with the same batch one commits, and rows without such a file are never
    read. A task that is lost is run again by Spark, and a driver that is lost runs the
    batch again under the same name; neither counts twice. Totals are the sum over all
    open batches, or over the last compaction and the batches it has not taken up.
    """

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.home}/{p}")
        self._fs = jvm.org.apache.hadoop.fs.Path(self.home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self._path(kind)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _told(self, kind: str, name: str) -> str:
        """The folder that a file tells."""
        stream = self._fs.open(self._path(f"{kind}/{name}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def _mark(self, kind: str, name: str, folder: str) -> bool:
        """Creates the file ``name`` that tells ``folder``; False if there is one."""
        self._fs.mkdirs(self._path(kind))
        try:
            stream = self._fs.create(self._path(f"{kind}/{name}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self._fs.exists(self._path(f"{kind}/{name}")):
                return False
            raise
        stream.writeUTF(folder)
        stream.close()
        return True

    def _commit(self, rows: DataFrame, kind: str, name: str) -> bool:
        folder = f"rows/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.home}/{folder}")
        done = self._mark(kind, name, folder)
        if not done:
            self._fs.delete(self._path(folder), True)
        return done

    def apply(self, batch: str, signed: DataFrame) -> bool:
        """Commits a batch of signed changes; False if its name was committed before."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"{batch!r} can't name a batch: letters, digits, _ . - only")
        if any(self._fs.exists(self._path(f"{kind}/{batch}")) for kind in ("done", "open")):
            return False
        summed = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return self._commit(summed.select(*KEYS, F.col("docs").cast("long"), F.col("tokens").cast("long")), "open", batch)

    def _base(self) -> DataFrame | None:
        """The last compaction: totals, and the names of the batches that were open then."""
        names = self._names("bases")
        return self.spark.read.schema(f"{SCHEMA}, batch string").parquet(f"{self.home}/{self._told('bases', names[-1])}") if names else None

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)``, without rows in which nothing is left."""
        base = self._base()
        taken = set() if base is None else {r[0] for r in base.where("batch is not null").select("batch").collect()}
        folders = [f"{self.home}/{self._told('open', b)}" for b in self._names("open") if b not in taken]
        rows = self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)
        if base is not None:
            rows = rows.unionByName(base.where("batch is null").drop("batch"))
        summed = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Sums all open batches into one base; reading then takes the base and later batches.

        The base has the names of the batches it holds, and each of them is then moved from
        the open to the done; if the driver is lost in between, both places tell that it
        was committed, and the base that it is in the totals. Only open batches are listed.
        """
        names = self._names("open")
        listed = self.spark.createDataFrame([(b,) for b in names], "batch string")
        rows = self.totals().withColumn("batch", F.lit(None).cast("string")).unionByName(listed, allowMissingColumns=True)
        if self._commit(rows, "bases", f"{len(self._names('bases')):08d}"):
            for b in names:
                folder = self._told("open", b)
                self._mark("done", b, folder)
                self._fs.delete(self._path(f"open/{b}"), False)
                self._fs.delete(self._path(folder), True)

    def drop(self) -> None:
        """Deletes the whole rollup."""
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.home), True)
