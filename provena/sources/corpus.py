"""Corpus files in and out: JSON documents, text, JSON lines, XML feeds, index tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions import text as tx
from provena.operators import retrieval
from provena.operators.corpus import ranked

DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "source", "url", "doi", "lang", "text", "full_text")])
DIRECTORIES = ("human", "ai", "uz", "ru", "en")


def read_documents(spark: SparkSession, root: str, directories: tuple[str, ...] = DIRECTORIES, per_directory: int | None = 5000, least_words: int = 20) -> DataFrame:
    """Documents of ``root/<directory>/*.json``, one pretty-printed object a file.

    Missing directories are passed over, and so are files that aren't JSON. A missing
    id or title is the file's stem, a missing source the directory; ``full_text`` stands
    in for an empty text. ``per_directory`` bounds the files of each (None: all), and
    texts under ``least_words`` are left out.
    """
    jvm = spark.sparkContext._jvm
    out = None
    for d in directories:
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{d}")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            continue
        raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/{d}/*.json")
        stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
        full = lambda c: F.nullif(F.col(c), F.lit(""))
        rows = raw.select(
            F.coalesce(full("id"), stem).alias("id"), F.coalesce("title", stem).alias("title"), F.coalesce("source", F.lit(d)).alias("source"),
            F.coalesce("url", F.lit("")).alias("url"), F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("lang", F.lit(d)).alias("lang"),
            F.coalesce(full("text"), F.col("full_text"), F.lit("")).alias("text"), F.lit(d).alias("directory"), F.col("_metadata.file_name").alias("file"),
        )
        if per_directory is not None:
            rows = ranked(rows, ["directory"], [F.asc("file")], per_directory).drop("rank")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "id string, title string, source string, url string, doi string, lang string, text string, directory string")
    return out.drop("file").where(tx.n_words(F.col("text")) >= least_words)


def save_documents(docs: DataFrame, path: str, stored: DataFrame | None = None) -> DataFrame:
    """Appends documents that ``stored`` lacks as JSON, by language; returns what was new.

    Ids are the first 12 digits of the md5 of the text's first 200 characters; titles are
    cut at 200 characters, texts at 5000. Texts under 20 words and empty titles go.
    """
    rows = docs.where((tx.n_words(F.col("text")) >= 20) & (F.coalesce("title", F.lit("")) != ""))
    rows = rows.withColumn("id", F.substring(F.md5(F.substring("text", 1, 200)), 1, 12)).dropDuplicates(["lang", "id"])
    if stored is not None:
        rows = rows.join(stored.select("lang", "id"), ["lang", "id"], "left_anti")
    rows = rows.withColumn("title", F.substring("title", 1, 200)).withColumn("text", F.substring("text", 1, 5000))
    rows.write.mode("append").partitionBy("lang").json(path)
    return rows


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(name, text)`` of files by suffix: txt as it is, docx by its paragraphs, pdf through
    pypdf where that is installed (else empty); others are empty."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def go(batches):
        for pdf in batches:
            yield pdf.assign(text=[extract(n, c) for n, c in zip(pdf["name"], pdf["content"], strict=True)])[["name", "text"]]

    return files.mapInPandas(go, "name string, text string")


def extract(name: str, data: bytes) -> str:
    """The text of one file."""
    import io
    import zipfile
    from xml.etree import ElementTree

    kind = name.lower().rpartition(".")[2]
    if kind == "txt":
        return data.decode("utf-8", "ignore")
    if kind == "docx":
        try:
            body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return ""
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p"))
    if kind == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError:
            return ""
        return " ".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
    return ""


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed: ``(title, url, text)``, text the title and the summary."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("title string, summary string, link array<struct<_href:string,_title:string>>").load(path)
    pdf = F.filter("link", lambda x: x["_title"] == "pdf")
    return rows.select(tidy(F.col("title")).alias("title"), F.element_at(pdf, 1)["_href"].alias("url"), tidy(F.concat_ws(". ", "title", "summary")).alias("text"))


def read_medline(texts: DataFrame) -> DataFrame:
    """Abstracts of a plain-text listing (column ``text``): numbered blocks of three lines
    or more; the first line is the title."""
    blocks = texts.select(F.explode(F.split("text", r"\n\n\d+\.")).alias("block"))
    lines = F.filter(F.transform(F.split(tx.strip(F.col("block")), "\n"), tx.strip), lambda x: x != "")
    rows = blocks.select("block", lines.alias("lines")).where(F.size("lines") >= 3)
    return rows.select(F.element_at("lines", 1).alias("title"), tidy(F.col("block")).alias("text"))


def read_papers(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Rows of a paper search's JSON pages: ``(title, text, url, doi)``; papers without an
    abstract are left out."""
    schema = "data array<struct<title:string,abstract:string,url:string,externalIds:struct<DOI:string>>>"
    p = raw.select(F.explode(F.from_json(json_col, schema)["data"]).alias("p"))
    return p.where("p.abstract is not null").select(F.col("p.title").alias("title"), tidy(F.concat_ws(". ", "p.title", "p.abstract")).alias("text"), F.coalesce("p.url", F.lit("")).alias("url"), F.coalesce("p.externalIds.DOI", F.lit("")).alias("doi"))


def read_works(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Rows of a DOI registry's JSON pages: ``(title, text, url, doi, lang)``; languages
    other than uz, ru and en count as en."""
    schema = "message struct<items:array<struct<title:array<string>,abstract:string,DOI:string,language:string>>>"
    p = raw.select(F.explode(F.from_json(json_col, schema)["message"]["items"]).alias("p")).where("p.abstract is not null")
    lang = F.substring(F.coalesce("p.language", F.lit("en")), 1, 2)
    return p.select(F.element_at("p.title", 1).alias("title"), tidy(F.col("p.abstract")).alias("text"), F.when(F.coalesce("p.DOI", F.lit("")) != "", F.concat(F.lit("https://doi.org/"), F.col("p.DOI"))).otherwise("").alias("url"), F.coalesce("p.DOI", F.lit("")).alias("doi"), F.when(lang.isin("uz", "ru", "en"), lang).otherwise("en").alias("lang"))


def tidy(c) -> F.Column:
    """Tags become spaces, white space is collapsed."""
    return tx.strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), f"{tx.SPACE}+", " "))


def write_index(docs: DataFrame, path: str) -> None:
    """The ranked index as tables (documents, postings, terms) and a manifest of counts.

    ``docs`` holds ``doc_id, tokens``. Each call writes a version of its own, and its
    manifest last: readers keep to the newest version that has one, so that none sees a
    half-written index.
    """
    spark = docs.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    home = f"{path}/{version}"
    retrieval.postings(docs).write.parquet(f"{home}/postings")
    docs.select("doc_id", F.size("tokens").cast("long").alias("dl")).write.parquet(f"{home}/docs")
    post, stats = spark.read.parquet(f"{home}/postings"), spark.read.parquet(f"{home}/docs")
    retrieval.term_stats(post, stats.agg(F.count("*").alias("n"))).write.parquet(f"{home}/terms")
    _sums(post, stats).write.json(f"{home}/manifest")


def _sums(post: DataFrame, stats: DataFrame) -> DataFrame:
    a = post.agg(F.count("*").alias("postings"), F.bit_xor(F.xxhash64("doc_id", "term", "tf")).alias("check"))
    return a.crossJoin(stats.agg(F.count("*").alias("docs"), F.sum("dl").alias("words")))


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """``(docs, postings, terms)`` of the newest version, or None if none has a manifest or it doesn't agree."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/*/manifest/_SUCCESS")
    done = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    if not len(done):
        return None
    path = max(str(x.getPath().getParent().getParent().toString()) for x in done)
    docs, post, terms = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "terms"))
    told = spark.read.schema("postings long, check long, docs long, words long").json(f"{path}/manifest").first()
    return (docs, post, terms) if _sums(post, docs).first() == told else None
