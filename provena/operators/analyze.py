"""The whole analysis of submitted texts: language, cleaning, candidates, copying, authorship, risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.operators import corpus, detector, retrieval
from provena.operators import similarity as sim
from provena.tables import cut, held, spent

#: Characters that a request must and may have, and words under which a text isn't analysed.
LEAST_CHARS, MOST_CHARS, LEAST_WORDS = 20, 200_000, 5
#: Documents that the index proposes for each submission.
CANDIDATES = 30


def refusal(text: Column, least_words: int = LEAST_WORDS) -> Column:
    """Why a text isn't analysed: too short, too long, too few words; null if it is."""
    n = F.length(tx.strip(text))
    rules = F.when(text.isNull() | (n < LEAST_CHARS), "too short").when(F.length(text) > MOST_CHARS, "too long")
    return rules.when(tx.n_words(text) < least_words, "too few words")


def prepared(subs: DataFrame) -> DataFrame:
    """``(sub_id, original, error, lang, hidden, text)`` of ``sub_id, text``.

    The language is that of the text as it came. Look-alikes are made plain, the
    bibliography and quotations are cut; if that leaves under eight words or 35 % of
    them, the text stays with them.
    """
    rows = subs.select("sub_id", F.col("text").alias("original"), refusal(F.col("text")).alias("error"), tx.language(F.col("text")).alias("lang"), tx.hidden_characters(F.col("text")).alias("hidden"))
    rows = tx.pinned(rows, plain=tx.plain_letters(F.col("original")))
    rows = tx.pinned(rows, cleaned=tx.clean(F.col("plain")))
    enough = tx.n_words(F.col("cleaned")) >= F.greatest(F.lit(8), tx.n_words(F.col("original")) * 0.35)
    return rows.withColumn("text", F.when(enough, F.col("cleaned")).otherwise(F.col("plain"))).drop("plain", "cleaned")


def candidates(subs: DataFrame, docs: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """``(sub_id, doc_id)``: the k documents that the ranked index finds for each text."""
    return retrieval.bm25(corpus.admitted(docs), subs.select(F.col("sub_id").alias("query_id"), "text"), k).select(F.col("query_id").alias("sub_id"), "doc_id")


def analyze(subs: DataFrame, docs: DataFrame, only: DataFrame | None = None, semantic: DataFrame | None = None, detected: DataFrame | None = None, k: int = 10) -> DataFrame:
    """One row for each submission ``(sub_id, text)`` against ``docs`` (``doc_id, lang, text``).

    ``only`` may hold the candidate pairs, otherwise the ranked index proposes them.
    ``semantic`` may be ``semantic_score``'s result, ``detected`` the detector's (with
    ``sub_id``); without them there is no semantic score, and the detector runs without
    models. Texts that are refused get a row with ``error`` and zeros.
    """
    rows = cut(prepared(subs))
    good = rows.where("error is null")
    only = cut(candidates(good, docs) if only is None else only)
    top = sim.matches(good.select("sub_id", "lang", "text"), docs, k, only)
    scores = sim.overall(good.select("sub_id", "lang", "text", "original"), docs, semantic.select("sub_id", "semantic") if semantic is not None else None, k, top)
    sents = sim._aggregate(good.select("sub_id", "lang", "text"), docs, top).select("sub_id", "total_sents", "matched_sents")
    found = top.groupBy("sub_id").agg(F.count("*").alias("n_matches"), F.min_by("doc_id", "rank").alias("best_doc"))
    ai = detector.detect(good.select(F.col("sub_id").alias("doc_id"), "lang", "text")).withColumnRenamed("doc_id", "sub_id") if detected is None else detected
    out = rows.join(scores, "sub_id", "left").join(sents, "sub_id", "left").join(found, "sub_id", "left")
    out = out.join(ai.select("sub_id", "ai_probability", F.col("verdict").alias("ai_verdict")), "sub_id", "left")
    if semantic is not None:
        out = out.join(semantic, "sub_id", "left")
    else:
        out = out.withColumns({"semantic": F.lit(0.0), "translation_found": F.lit(False), "paraphrase_found": F.lit(False)})
    zero = ("lexical", "aggregate", "lex_max", "overall", "semantic", "ai_probability", "n_matches", "total_sents", "matched_sents")
    out = out.na.fill(0, list(zero)).na.fill(False, ["is_plagiarism", "translation_found", "paraphrase_found"])
    said, level, risk = sim.risks(F.col("overall"), F.col("ai_probability"), F.col("hidden.is_manipulated"), F.col("paraphrase_found"), F.col("translation_found"), F.col("is_plagiarism"))
    ok = F.col("error").isNull()
    shown = out.select(
        "sub_id", "error", F.col("lang").alias("language"), "overall", "lexical", "semantic", "aggregate", "threshold", "is_plagiarism", "n_matches", "best_doc",
        "matched_sents", "total_sents", "ai_probability", "ai_verdict", F.col("hidden.manipulation_score").alias("manipulation_score"),
        F.when(ok, F.array_join(said, ", ")).otherwise("").alias("risks"), F.when(ok, level).alias("level"), F.when(ok, risk).alias("risk"),
    )
    done = held(shown)
    spent(rows, only)
    return done


def report(analysis: DataFrame, matches: DataFrame, highlights: DataFrame, subs: DataFrame) -> DataFrame:
    """What a printed report shows of each submission: its analysis, the five best sources,
    eight copied sentences of 120 characters, and the text's first 500."""
    best = matches.where("rank <= 5").groupBy("sub_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score"))).alias("sources"))
    copied = corpus.ranked(highlights.where("is_plagiarism"), ["sub_id"], [F.asc("pos")], 8)
    copied = copied.groupBy("sub_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("sentence", 1, 120).alias("s")))), lambda x: x["s"]).alias("copied"))
    rows = analysis.join(subs.select("sub_id", shortened(F.col("text"), 500).alias("sample")), "sub_id")
    rows = rows.join(best, "sub_id", "left").join(copied, "sub_id", "left")
    return rows.withColumn("copied", F.coalesce("copied", F.array().cast("array<string>")))


def shortened(c: Column, n: int) -> Column:
    """The first n characters, with a sign if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def cache_key(c: Column) -> Column:
    """The key of a text's stored result."""
    return F.substring(F.sha2(c, 256), 1, 20)


def check_rows(analysis: DataFrame, subs: DataFrame, now: Column) -> DataFrame:
    """Rows of the history of checks: a preview of 150 characters, the verdict and the whole
    analysis as JSON. Submissions without a user leave none; refused ones neither."""
    rows = analysis.where("error is null").join(subs.where("user_id is not null").select("sub_id", "user_id", "filename", F.col("text").alias("t")), "sub_id")
    whole = F.to_json(F.struct(*[F.col(c) for c in analysis.columns]))
    return rows.select("user_id", F.concat(F.substring("t", 1, 150), F.lit("…")).alias("text_preview"), "filename", "language", F.col("overall").alias("plagiarism"), F.col("ai_probability").alias("ai_prob"), "is_plagiarism", whole.alias("result_json"), now.alias("created_at"))


def used_up(users: DataFrame, checks: DataFrame) -> DataFrame:
    """``users`` with ``checks_used`` raised by the number of their new checks."""
    n = checks.groupBy("user_id").agg(F.count("*").alias("n_"))
    return users.join(n, "user_id", "left").withColumn("checks_used", F.col("checks_used") + F.coalesce("n_", F.lit(0))).drop("n_")
