"""Pages and web hits: text of HTML, likeness, key sentences, and the boost of a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import lexicons as lex
from provena.functions import text as tx
from provena.operators.corpus import ranked


def page_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``."""
    return pages.select("page_id", "url", tx.page_text(F.col("html")).alias("text"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the lower-case words in percent, to a digit."""
    sets = [F.array_distinct(tx.words(F.lower(c))) for c in (a, b)]
    return tx.rounded(tx.jaccard(*sets) * 100, 1)


def page_likeness(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``(page_id, doc_id, similarity, error)`` of pairs ``(page_id, html, doc_id, text)``;
    a page under 50 characters is an error."""
    rows = pages.join(docs, "pair").withColumn("page", tx.page_text(F.col("html")))
    short = F.length("page") < 50
    return rows.select("page_id", "doc_id", F.when(short, 0.0).otherwise(likeness(F.col("page"), F.col("text"))).alias("similarity"), F.when(short, "too short").alias("error"))


def key_sentences(docs: DataFrame, k: int = 5) -> DataFrame:
    """``(doc_id, sentence, score, rank)``: the k sentences of 8 to 30 words with the most
    words that aren't stop words; of equals the first."""
    parts = F.filter(tx.sentences(F.col("text"), 8), lambda s: tx.n_words(s) <= 30)
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "sentence"))
    stops = tx.strings(lex.KEY_STOPS)
    score = F.size(F.filter(tx.words(F.lower("sentence")), lambda w: ~F.array_contains(stops, w)))
    return ranked(rows.withColumn("score", score.cast("long")), ["doc_id"], [F.desc("score"), F.asc("pos")], k).drop("pos")


def web_scores(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, matched, web_score)``: the share of asked sentences with a hit."""
    found = hits.select("sentence").distinct().withColumn("hit", F.lit(1))
    g = asked.join(found, "sentence", "left").groupBy("doc_id").agg(F.count_distinct("sentence").alias("n_sentences"), F.count_distinct(F.when(F.col("hit") == 1, F.col("sentence"))).alias("matched"))
    return g.withColumn("web_score", tx.rounded(F.col("matched") / F.col("n_sentences") * 100, 1))


def boosted(overall: Column, web_score: Column) -> Column:
    """The verdict's percentage raised by 30 % of a web score over 30, 20 at most, to 100."""
    more = F.least(F.lit(20.0), 0.3 * web_score)
    return F.when(web_score > 30, tx.rounded(F.least(F.lit(100.0), overall + more), 1)).otherwise(overall)


def web_matches(hits: DataFrame, shown: int = 10) -> DataFrame:
    """``(doc_id, url, title, sentence, rank)``: the first hits of each document, in order of
    their sentences and places. ``hits`` holds ``doc_id, rank, place, url, title, sentence``."""
    rows = hits.withColumnRenamed("rank", "sentence_rank")
    return ranked(rows, ["doc_id"], [F.asc("sentence_rank"), F.asc("place"), F.asc("url")], shown).drop("sentence_rank", "place")


def with_web(matches: DataFrame, found: DataFrame, scores: DataFrame, least: float = 30.0, most: int = 3) -> DataFrame:
    """``(doc_id, document, source, url, score)``: matches of the corpus and, if the web score is
    above ``least``, the first hits of the web with that score."""
    web = found.where(F.col("rank") <= most).join(scores.where(F.col("web_score") > least), "doc_id")
    web = web.select("doc_id", F.coalesce("title", F.lit("Web source")).alias("document"), F.lit("internet").alias("source"), "url", tx.rounded(F.col("web_score"), 1).alias("score"))
    return matches.select("doc_id", "document", "source", "url", "score").unionByName(web)


def escaped(c: Column) -> Column:
    """Text for HTML."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def highlight_html(highlights: DataFrame) -> DataFrame:
    """``(sub_id, copied, total, html)``: sentences in order, those copied in a span of their class."""
    body = F.when(F.col("render_class").isNotNull(), F.concat(F.lit('<span class="'), "render_class", F.lit('">'), escaped(F.col("sentence")), F.lit("</span>"))).otherwise(escaped(F.col("sentence")))
    g = highlights.groupBy("sub_id").agg(F.count_if("is_plagiarism").alias("copied"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct("pos", body.alias("h")))).alias("x"))
    return g.select("sub_id", "copied", "total", F.array_join(F.transform("x", lambda x: x["h"]), " ").alias("html"))


def worded(messages: DataFrame, asked: DataFrame, default: str = "uz") -> DataFrame:
    """``asked`` (``key, lang, vars``) with ``message``: the key's text in the language, else in the
    default one, else the key itself, with each ``{name}`` of the map ``vars`` filled in."""
    own = messages.select("key", "lang", F.col("message").alias("own_"))
    usual = messages.where(F.col("lang") == default).select("key", F.col("message").alias("usual_"))
    rows = asked.join(F.broadcast(own), ["key", "lang"], "left").join(F.broadcast(usual), "key", "left")
    text = F.aggregate(F.map_entries("vars"), F.coalesce("own_", "usual_", "key"), lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return rows.withColumn("message", F.coalesce(text, "own_", "usual_", "key")).drop("own_", "usual_")
