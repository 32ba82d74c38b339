"""Quality, admission, first-wins dedup and audit of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import arrays
from provena.functions import text as tx

LEAST_WORDS = 20


def quality(c: Column) -> Column:
    """0 for texts that are short, have few letters, repeat themselves or have odd words;
    else half for length and half for the variety of words, to three digits."""
    w = tx.words(F.lower(c))
    n = F.size(w)
    some = F.greatest(n, F.lit(1))
    ttr = F.size(F.array_distinct(w)) / some
    letters = F.regexp_count(c, F.lit(r"\p{L}")) / F.greatest(F.length(c), F.lit(1))
    long = F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)) / some
    score = 0.5 * F.least(n / 300, F.lit(1.0)) + 0.5 * F.least((ttr - 0.2) / 0.6, F.lit(1.0))
    bad = (n < LEAST_WORDS) | (letters < 0.40) | (ttr < 0.20) | (long < 2.5) | (long > 18)
    return F.when(c.isNull() | bad, 0.0).otherwise(tx.rounded(score, 3))


def scored(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``quality`` and ``fingerprint``."""
    rows = tx.pinned(docs, scores_=arrays.scores("text"))
    return rows.select(*docs.columns, "scores_.*")


def grade(q: Column) -> Column:
    return F.when(q > 0.7, "excellent").when(q > 0.3, "good").when(q > 0, "poor").otherwise("rejected")


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. Its id is found by a pre-aggregated minimum, so a key
    with many rows doesn't meet in one task."""
    firsts = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first_")).select(F.col("first_." + order[0]).alias(order[0]))
    return rows.join(firsts, order[0], "left_semi")


def admitted(docs: DataFrame) -> DataFrame:
    """What the ranked index takes: some quality, then the first of each fingerprint, then
    ten tokens or more. A short first copy thus shadows later ones."""
    rows = scored(docs).where("quality > 0")
    firsts = rows.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "quality")).alias("at")).select("at.doc_id", "at.quality")
    texts = docs.select("doc_id", "text", "lang").join(firsts, "doc_id")
    return tx.pinned(texts, tokens=arrays.index_tokens("text")).where(F.size("tokens") >= 10)


def audit(docs: DataFrame, *keys: str) -> DataFrame:
    """Counts, average words (truncated), grades and repeats, by ``keys`` or over all."""
    n = lambda g: F.count_if(grade(F.col("quality")) == g).alias(g)
    return scored(docs).groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.floor(F.sum("n_words") / F.count("*")).cast("long").alias("avg_words"),
        *[n(g) for g in ("excellent", "good", "poor", "rejected")],
        (F.count("*") - F.count_distinct("fingerprint")).alias("duplicates"),
    )


def audit_issues(docs: DataFrame, languages: tuple[str, ...] = ("uz", "ru", "en")) -> DataFrame:
    """One row: what is wrong with the corpus as a whole."""
    counts = audit(docs).crossJoin(docs.agg(*[F.count_if(F.col("lang") == k).alias("n_" + k) for k in languages]))
    rules = [F.when(F.col("n_" + k) == 0, f"{k} is missing") for k in languages]
    rules += [F.when(F.col("total") < 1000, "too few documents"), F.when(F.col("n_uz") < 200, "too few uz documents"), F.when(F.col("rejected") > F.col("total") * 0.3, "over 30 % rejected"), F.when(F.col("duplicates") > 0, "duplicates")]
    return counts.select("total", "duplicates", "rejected", F.array_join(F.array_compact(F.array(*rules)), "; ").alias("issues"))


def audit_rollup(docs: DataFrame) -> DataFrame:
    """Totals by language and source with subtotals, ``*`` for all."""
    rows = scored(docs).select("lang", "source", "quality", "n_words")
    g = rows.rollup("lang", "source").agg(F.count("*").alias("total"), F.count_if(F.col("quality") > 0).alias("usable"), F.sum("n_words").alias("words"), F.grouping_id().alias("level"))
    star = lambda c, least: F.when(F.col("level") >= least, "*").otherwise(F.coalesce(c, F.lit("?"))).alias(c)
    return g.select(star("lang", 3), star("source", 1), "total", "usable", "words")


# Stores of documents


def new_documents(incoming: DataFrame, stored: DataFrame, least: int = LEAST_WORDS, head: int = 200, lower: bool = False, chars: int = 12, scope: tuple[str, ...] = (), trim: bool = False) -> DataFrame:
    """What a store takes of ``incoming``: enough words, and an id, the start of the md5 of
    the text's first ``head`` characters, that isn't stored; one of each id.

    With ``scope`` (as category and language) an id counts within it only, and ``trim``
    leaves out white space at the ends first.
    """
    text = tx.strip(F.col("text")) if trim else F.col("text")
    start = F.substring(F.lower(text) if lower and trim else text, 1, head)
    keys = [*scope, "id"]
    rows = incoming.where(tx.n_words(F.col("text")) >= least).withColumn("id", F.substring(F.md5(F.lower(start) if lower else start), 1, chars))
    rows = rows.join(stored.select(*keys), keys, "left_anti")
    firsts = rows.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"))
    return rows.join(firsts, [*keys, "doc_id"], "left_semi")


def human_texts(docs: DataFrame, target: int, least: int = 30) -> DataFrame:
    """The first ``target`` documents of each language with ``least`` words or more."""
    return ranked(docs.where(tx.n_words(F.col("text")) >= least), ["lang"], [F.asc("doc_id")], target).drop("rank")


def category_label(category: Column, prefix: bool = False) -> Column:
    """0 (human), 0.5 (mixed) or 1 by what a category's name contains, or how it begins."""
    has = category.startswith if prefix else category.contains
    return F.when(has("human"), 0.0).when(has("mixed"), 0.5).otherwise(1.0)


def upsert(table: DataFrame, changes: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """``table`` after inserting ``changes``: rows with a known key replace (or are ignored)."""
    if replace:
        return table.join(changes.select(key), key, "left_anti").unionByName(changes)
    return table.unionByName(changes.join(table.select(key), key, "left_anti"))


def training_rows(docs: DataFrame, labels: DataFrame, prefix: bool = False) -> DataFrame:
    """Rows for training: the label as 0 (human), 0.5 (mixed) or 1, and its name. ``prefix`` says
    that a category's name must begin with the label's, not only contain it."""
    kind = category_label(F.col("category"), prefix)
    rows = docs.join(labels, "doc_id").withColumn("label", kind)
    name = F.when(F.col("label") == 0, "human").when(F.col("label") == 0.5, "mixed").otherwise("ai")
    return rows.select("doc_id", "text", "label", name.alias("label_str"), "lang", "category", tx.n_words(F.col("text")).alias("word_count"))


def turns_once(conversations: DataFrame) -> DataFrame:
    """Turns without those whose text, by fingerprint, an earlier turn has."""
    rows = conversations.withColumn("fingerprint", tx.fingerprint(F.coalesce("text", F.lit(""))))
    firsts = rows.groupBy("fingerprint").agg(F.min(F.struct("conv_id", "turn")).alias("at"), F.count("*").alias("copies"))
    return firsts.select("at.conv_id", "at.turn", "fingerprint", "copies")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their ``rank``; Spark prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
