"""Estimates of machine authorship from features: layers, calibrations, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import lexicons as lex
from provena.functions import text as tx
from provena.operators import features as ft


def _least(x: Column, most: float = 1.0) -> Column:
    return F.least(x, F.lit(most))


def _zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def _c(name: str) -> Column:
    return F.col(name)


def stylometric(lang: Column) -> Column:
    """The style layer, 0 to 1; two more signals count in Uzbek."""
    s = [
        _least(_c("connector_density") / 0.8),
        _zero(1 - _c("hedging_density") * 3),
        _zero(1 - _c("burstiness") * 2.5),
        _least(_c("formulaic_density") / 0.5),
        _zero(1 - _c("sent_len_std") / 12),
        _least(_c("passive_ratio") / 0.6),
        F.when((_c("ttr") >= 0.40) & (_c("ttr") <= 0.65), 1.0).otherwise(0.0),
        _zero(1 - (_c("question_ratio") + _c("exclamation_ratio")) * 5),
        _least(_c("uz_apostrophe_error") * 5),
        _least(_c("uz_template_starts") * 3),
    ]

    def blend(k: str) -> Column:
        w = lex.STYLE_WEIGHTS[k]
        return sum((a * b for a, b in zip(s, w, strict=False)), F.lit(0.0)) / sum(w)

    return tx.by_lang(lang, {k: blend(k) for k in ("en", "uz", "ru")})


def statistical() -> Column:
    """The statistical layer, 0 to 1."""
    parts = [
        (_zero(1 - _c("burstiness") * 2), 0.15),
        (_least(_c("artificial_burst") * 2), 0.10),
        (F.when((_c("ttr") >= 0.42) & (_c("ttr") <= 0.62), 1.0).otherwise(0.3), 0.08),
        (_least(_c("connector_density") / 0.6), 0.12),
        (_zero(1 - _c("hedging_density") * 4), 0.08),
        (_least(_c("certainty_density") / 0.3), 0.08),
        (_least(_c("formulaic_density") / 0.4), 0.12),
        (_zero(1 - _c("sent_len_std") / 10), 0.10),
        (_c("para_uniformity"), 0.05),
        (_least(_c("intro_concl_sim") * 3), 0.05),
        (_least(_c("repeated_trigram_ratio") * 5), 0.04),
        (_zero(1 - (_c("question_ratio") + _c("exclamation_ratio")) * 5), 0.03),
    ]
    return sum((a * b for a, b in parts), F.lit(0.0))


#: Weights of the layers (statistical, model, perplexity, style) by the models at hand.
WEIGHTS = {
    "none": (0.45, 0.0, 0.0, 0.55),
    "transformer": (0.20, 0.50, 0.0, 0.30),
    "transformer+perplexity": (0.15, 0.40, 0.25, 0.20),
    "trained": (0.12, 0.55, 0.0, 0.33),
    "trained+perplexity": (0.10, 0.45, 0.25, 0.20),
}


def model_layer(transformer: Column | None = None, trained: Column | None = None) -> Column:
    """The model layer: 0.6 of the trained classifier's score and 0.4 of the transformer's; one
    alone counts whole, and 0.5 stands for none. A trained score below 0 means it has none."""
    if trained is None:
        return F.lit(0.5) if transformer is None else transformer
    both = trained if transformer is None else transformer * 0.4 + trained * 0.6
    return F.when(trained >= 0, both).otherwise(F.lit(0.5) if transformer is None else transformer)


def guessed_language(c: Column) -> Column:
    """ru, uz or en from a text's first 500 characters, for texts that come without a language."""
    s = F.substring(c, 1, 500)
    count = lambda p: F.regexp_count(s, F.lit(p))
    known = F.size(F.array_intersect(F.split(F.regexp_replace(F.lower(s), "[^a-zA-Z']", " "), " +"), tx.strings(lex.DETECTOR_UZ_WORDS)))
    cyr = count(r"[\x{400}-\x{4FF}]") / F.greatest(count(r"\p{L}"), F.lit(1))
    return F.when(cyr > 0.30, "ru").when(count("[oOgG]'") >= 2, "uz").when(known >= 2, "uz").otherwise("en")


def with_language(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lang`` guessed where it is null or ``auto``."""
    return docs.withColumn("lang", F.when(F.coalesce("lang", F.lit("auto")) == "auto", guessed_language(F.col("text"))).otherwise(F.col("lang")))


def verdict_label(verdict: Column, lang: Column) -> Column:
    """A verdict in words of the language, English for those without; null for other verdicts."""
    return tx.by_lang(lang, {k: F.element_at(F.create_map(*[F.lit(x) for pair in v.items() for x in pair]), verdict) for k, v in lex.VERDICTS.items()})


def detect(docs: DataFrame, models: str = "none", model_score: Column | None = None) -> DataFrame:
    """A row for each document: layers, ``confidence``, ``ai_probability`` (0 to 100) and
    ``verdict`` (ai, mixed, human, too_short).

    ``models`` says which layers weigh, ``model_score`` gives the model's (a column of
    ``docs``, 0.5 if none). Documents under ten words are too short; their layers are null.
    """
    rows = ft.features(docs)
    rows = rows.withColumn("model_", F.lit(0.5)) if model_score is None else rows.join(docs.select("doc_id", model_score.alias("model_")), "doc_id")
    rows = rows.join(ft.profile(docs).select("doc_id", "flatness", "periodicity"), "doc_id", "left")
    rows = rows.withColumn("n", tx.n_words(F.col("text")))
    rows = rows.withColumns({"statistical": statistical(), "stylometric": stylometric(F.col("lang")), "perplexity": F.col("flatness") * 0.7 + F.col("periodicity") * 0.3})
    names = ("statistical", "model_", "perplexity", "stylometric")
    w = WEIGHTS[models]
    blend = sum((_c(a) * b for a, b in zip(names, w, strict=True)), F.lit(0.0)) / sum(w)
    active = F.array(*[_c(a) for a, b in zip(names, w, strict=True) if b > 0])
    rows = rows.withColumn("confidence", tx.rounded(_least(_zero(1.0 - ft.deviation(active))), 3))
    p, n = F.col("p"), F.col("n")
    rows = rows.withColumn("p", tx.rounded(_least(_zero(blend * 100), 100.0), 1))
    academic = (_c("passive_ratio") > 0.25) & (_c("connector_density") < 0.15) & (_c("formulaic_density") < 0.1) & (p > 35)
    rows = rows.withColumn("p", F.when(academic, tx.rounded(p * (1.0 - _least(_c("passive_ratio") * 0.5, 0.35)), 1)).otherwise(p))
    unmarked = (_c("connector_density") == 0) & (_c("formulaic_density") == 0) & (_c("certainty_density") == 0) & (p > 35)
    rows = rows.withColumn("p", F.when(unmarked, tx.rounded(p * 0.60, 1)).otherwise(p))
    pull = F.when(n < 20, 0.15).when(n < 40, 0.45).when(n < 80, 0.7).otherwise(1.0)
    rows = rows.withColumn("p", F.when(n < 80, tx.rounded(50 + (p - 50) * pull, 1)).otherwise(p))
    rows = rows.withColumn("confidence", F.least("confidence", F.when(n < 20, 0.15).when(n < 40, 0.35).when(n < 80, 0.55).when(n < 150, 0.8).otherwise(1.0)))
    human = (_c("burstiness") > 0.25) & (_c("burstiness") < 0.55) & (_c("artificial_burst") > 0.2) & (_c("connector_density") > 0.15)
    rows = rows.withColumn("p", F.when(human, tx.rounded(_least(p + _least(_c("artificial_burst") * 30, 15.0), 100.0), 1)).otherwise(p))
    short = n < 50
    verdict = F.when((n < 25) & (F.col("confidence") < 0.3), "too_short").when(p >= F.when(short, 70).otherwise(65), "ai").when(p >= F.when(short, 48).otherwise(42), "mixed").otherwise("human")
    few = n < 10
    shown = lambda c: F.when(~few, tx.rounded(F.col(c)))
    return rows.select("doc_id", "lang", n.cast("long").alias("n_words"), shown("statistical").alias("layer_statistical"), shown("stylometric").alias("layer_stylometric"), shown("perplexity").alias("layer_perplexity"), F.when(few, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.when(few, 0.0).otherwise(p).alias("ai_probability"), F.when(few, "too_short").otherwise(verdict).alias("verdict"))


#: Words from which a sentence is scored, and from which the transformer is asked.
SENTENCE_WORDS, TRANSFORMER_WORDS = 5, 10


def blended(h: Column, n: Column, trained: Column | None = None, transformer: Column | None = None) -> Column:
    """A sentence's score from its marks ``h``, the trained classifier's score of the sentence
    with its neighbours, and the transformer's (0.5 for fewer than ten words)."""
    t = None if transformer is None else F.when(n >= TRANSFORMER_WORDS, transformer).otherwise(0.5)
    alone = h if t is None else t * 0.60 + h * 0.40
    if trained is None:
        return alone
    return F.when(trained >= 0, trained * 0.65 + h * 0.35 if t is None else trained * 0.50 + h * 0.25 + t * 0.25).otherwise(alone)


def sentence_contexts(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, pos, s, context)`` of each sentence of texts of 30 words or more; the
    context is the sentence between those before and after it."""
    rows = tx.pinned(docs.where(tx.n_words(F.col("text")) >= 30).select("doc_id", "lang", "text"), ss=tx.feature_sentences(F.col("text")))
    both = F.transform("ss", lambda s, i: F.struct(s.alias("s"), F.concat_ws(" ", F.get("ss", i - 1), s, F.get("ss", i + 1)).alias("context")))
    return rows.select("doc_id", "lang", F.posexplode(both).alias("pos", "x")).select("doc_id", "lang", "pos", "x.s", "x.context")


def sentences(docs: DataFrame, trained: Column | None = None, transformer: Column | None = None, most: int | None = None) -> DataFrame:
    """``(doc_id, pos, ai_score, label)`` for each sentence of documents of 30 words or more.

    ``trained`` and ``transformer`` may be scores computed from ``s``, ``context`` and
    ``lang``; ``most`` bounds the sentences shown of a document.
    """
    rows = tx.pinned(sentence_contexts(docs), low=F.lower("s"), n=tx.n_words(F.col("s")))
    low, n = F.col("low"), F.col("n")
    hits = lambda table: tx.by_lang(F.col("lang"), {k: tx.contained(low, v) for k, v in table.items()})
    raw = (hits(lex.CONNECTORS) * 0.25 + hits(lex.CERTAINTIES) * 0.15 + hits(lex.FORMULAS) * 0.35) / F.greatest(F.lit(1.0), n / 15)
    score = F.when(n < SENTENCE_WORDS, 0.0).otherwise(blended(_least(raw), n, trained, transformer))
    label = F.when(n < SENTENCE_WORDS, "human").when(score >= 0.65, "ai").when(score >= 0.40, "mixed").otherwise("human")
    out = rows.select("doc_id", "pos", tx.rounded(score, 3).alias("ai_score"), label.alias("label"))
    return out if most is None else out.where(F.col("pos") < most)


def sentence_share(docs: DataFrame) -> DataFrame:
    """``(doc_id, sentences, ai_sentences, ai_ratio)``."""
    g = sentences(docs).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(F.col("label") == "ai").alias("ai_sentences"))
    return g.withColumn("ai_ratio", tx.rounded(F.col("ai_sentences") / F.col("sentences"), 3))


def simple(docs: DataFrame) -> DataFrame:
    """The older detector of four yes-or-no signals: ``(doc_id, ai_probability, verdict)``."""
    parts = F.filter(F.split("text", "[.!?]"), lambda s: tx.n_words(s) > 2)
    rows = docs.select("doc_id", "text", "lang", F.transform(parts, lambda s: tx.n_words(s).cast("double")).alias("lens"), tx.words(F.lower("text")).alias("w"))
    rows = rows.withColumn("m", ft.mean(F.col("lens")))
    burst = F.when((F.size("lens") >= 3) & (F.col("m") > 0), ft.deviation(F.col("lens")) / F.col("m")).otherwise(0.5)
    some = F.greatest(F.size("lens"), F.lit(1))
    density = F.size(F.filter("w", lambda x: F.array_contains(tx.strings(lex.SIMPLE_CONNECTORS), x))) / some
    variety = F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1))
    long = F.aggregate("lens", F.lit(0.0), lambda s, x: s + x) / some
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    style = (yes((long >= 15) & (long <= 28)) + yes((variety >= 0.40) & (variety <= 0.65)) + yes(density > 0.5) + yes(burst < 0.25)) / 4
    p = tx.rounded(_least(_zero((0.5 * 0.55 + style * 0.45) * 100), 100.0), 1)
    return rows.select("doc_id", p.alias("ai_probability"), F.when(p >= 68, "ai").when(p >= 42, "mixed").otherwise("human").alias("verdict"))
