"""27 style features of a text, its n-gram perplexity, and the layers built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import arrays
from provena.functions import lexicons as lex
from provena.functions import text as tx

WINDOW = 50


def mean(a: Column) -> Column:
    """Null if there is nothing."""
    return tx.let(a, lambda t: F.when(F.size(t) > 0, F.aggregate(t, F.lit(0.0), lambda s, x: s + x) / F.size(t)))


def deviation(a: Column) -> Column:
    """Of the whole population."""
    spread = lambda t, m: F.sqrt(F.aggregate(t, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.greatest(F.size(t), F.lit(1)))
    return tx.let(a, lambda t: tx.let(mean(t), lambda m: spread(t, m)))


def echo(a: Column) -> Column:
    """The largest autocorrelation of lags 2 to 4, sign dropped; 0 if nothing varies."""

    def of(t: Column) -> Column:
        norm = F.aggregate(t, F.lit(0.0), lambda s, x: s + x * x)

        def lag(k: int) -> Column:
            n = F.greatest(F.size(t) - k, F.lit(0))
            both = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(k + 1), n), lambda x, y: x * y)
            return F.abs(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / norm)

        return F.when(norm > 0, F.greatest(lag(2), F.when(F.size(t) > 3, lag(3)).otherwise(0.0), F.when(F.size(t) > 4, lag(4)).otherwise(0.0))).otherwise(0.0)

    centred = tx.let(a, lambda t: tx.let(mean(t), lambda m: F.transform(t, lambda x: x - m)))
    return tx.let(centred, of)


def _base(docs: DataFrame) -> DataFrame:
    sents = tx.split_sentences(F.col("text"))
    rows = tx.pinned(docs.select("doc_id", "lang", "text"), sents=sents, w=tx.feature_words(F.col("text")), low=F.lower("text"))
    lens = F.transform("sents", lambda s: tx.n_words(s).cast("double"))
    rows = tx.pinned(rows, lens=F.when(F.size("sents") > 0, lens).otherwise(F.array(F.lit(0.0))))
    return rows.withColumn("n_words", F.greatest(F.size("w"), F.lit(1))).withColumn("n_sents", F.greatest(F.size("sents"), F.lit(1)))


def moving_variety(h: Column, window: int = WINDOW) -> Column:
    """The mean share of distinct values of an array over all its windows.

    A place counts in the windows in which it is its value's first: from the place after
    the last one of that value, or the window's reach, up to the place itself. With places
    sorted by value, the one before stands beside, and no window is built.
    """
    w = F.lit(window)

    def of(s: Column) -> Column:
        n = F.size(s)

        def firsts(x: Column, i: Column) -> Column:
            last = F.get(s, i - 1)
            after = F.when(last["h"] == x["h"], last["p"] + 1).otherwise(0)
            return F.greatest(F.least(x["p"], n - w) - F.greatest(F.lit(0), x["p"] - w + 1, F.coalesce(after, F.lit(0))) + 1, F.lit(0))

        total = F.aggregate(F.transform(s, firsts), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(n > w, total / (w * (n - w + 1)))

    return tx.let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), of)


def repeats(grams: Column) -> Column:
    """A struct of an array's ``share`` of distinct values that occur again (null if it is
    empty), and the ``entropy`` of its values in bits over the largest it could be."""

    def of(c: Column) -> Column:
        n = F.transform(c, lambda x: x["n"].cast("double"))
        d, t = F.size(c), F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        cl = F.aggregate(n, F.lit(0.0), lambda a, x: a + x * F.log2(x))
        again = F.size(F.filter(c, lambda x: x["n"] > 1))
        some = F.struct((again / d).alias("share"), ((F.log2(t) - cl / t) / F.greatest(F.log2(d), F.lit(1.0))).alias("entropy"))
        return F.when(d > 0, some)

    return tx.let(tx.tally(grams), of)


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, text, <27 features>)`` of documents with ``doc_id, lang, text``."""
    b = _base(docs)
    m = mean(F.col("lens"))
    b = b.withColumn("sent_len_mean", m).withColumn("sent_len_std", deviation(F.col("lens")))
    b = b.withColumn("sent_len_min", F.array_min("lens")).withColumn("sent_len_max", F.array_max("lens")).withColumn("sent_len_range", F.col("sent_len_max") - F.col("sent_len_min"))
    b = b.withColumn("burstiness", F.when(F.col("sent_len_mean") > 0, F.col("sent_len_std") / F.col("sent_len_mean")).otherwise(0.0))
    n = F.size("lens")
    diffs = F.zip_with(F.slice("lens", F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice("lens", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: F.abs(x - y))
    b = b.withColumn("diffs", diffs).withColumn("artificial_burst", F.when(n >= 6, echo(F.col("diffs"))).otherwise(0.0))
    b = b.withColumn("ttr", F.size(F.array_distinct("w")) / F.col("n_words"))
    wl = F.transform("w", lambda x: F.length(x).cast("double"))
    b = b.withColumn("wl", wl).withColumn("word_len_mean", F.when(F.size("w") > 0, mean(F.col("wl"))).otherwise(F.lit(float("nan"))))
    b = b.withColumn("word_len_std", F.when(F.size("w") > 0, deviation(F.col("wl"))).otherwise(F.lit(float("nan"))))
    low, lang, sents = F.col("low"), F.col("lang"), F.col("n_sents")
    hits = lambda table: tx.by_lang(lang, {k: tx.contained(low, v) for k, v in table.items()})
    b = b.withColumns({"connector_density": hits(lex.CONNECTORS) / sents, "hedging_density": hits(lex.HEDGES) / sents, "certainty_density": hits(lex.CERTAINTIES) / sents, "formulaic_count": hits(lex.FORMULAS).cast("double")})
    count = lambda p: F.regexp_count("text", F.lit(p))
    passive = F.when(lang == "en", count(lex.PASSIVES["en"])).when(lang == "ru", count(lex.PASSIVES["ru"])).otherwise(count(lex.PASSIVES["uz"]))
    b = b.withColumns({"formulaic_density": F.col("formulaic_count") / sents, "passive_ratio": passive / sents, "question_ratio": count(r"\?") / sents, "exclamation_ratio": count("!") / sents})
    paras = F.filter(F.transform(F.split("text", "\n\n"), tx.strip), lambda p: F.length(p) > 20)
    b = b.withColumn("paras", paras).withColumn("pl", F.transform("paras", lambda p: tx.n_words(p).cast("double"))).withColumn("pm", mean(F.col("pl")))
    b = b.withColumn("para_uniformity", F.when(F.size("paras") < 2, 0.5).otherwise(F.when(F.col("pm") > 0, 1.0 - deviation(F.col("pl")) / F.col("pm")).otherwise(1.0)))
    ends = tx.jaccard(F.array_distinct(tx.feature_words(F.element_at("paras", 1))), F.array_distinct(tx.feature_words(F.element_at("paras", -1))))
    b = b.withColumn("intro_concl_sim", F.when(F.size("paras") >= 3, ends).otherwise(0.0))
    b = b.withColumn("contraction_ratio", F.when(lang == "en", count(lex.CONTRACTIONS) / F.col("n_words")).otherwise(0.0))
    starts = F.transform("sents", lambda s: F.lower(F.regexp_extract(s, f"[^{tx.SPACE[1:-1]}]+", 0)))
    b = b.withColumn("starts", F.sort_array(starts))
    # in sorted order, the longest run of equal starts
    run = F.aggregate("starts", F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best")), lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"], s["n"] + 1).otherwise(1).alias("n"), F.greatest(s["best"], F.when(x == s["last"], s["n"] + 1).otherwise(1)).alias("best")), lambda s: s["best"])
    b = b.withColumn("start_repetition", F.when(F.size("sents") >= 4, run / sents).otherwise(0.0))
    wrong, right = count(lex.UZ_APOSTROPHES), count("o'") + count("g'")
    uz = lambda x: F.when(lang == "uz", x).otherwise(0.0)
    b = b.withColumns({"uz_apostrophe_error": uz(wrong / F.greatest(right + wrong, F.lit(1))), "uz_hisoblanadi_density": uz(count(lex.UZ_COPULA) / sents), "uz_template_starts": uz(count(lex.UZ_OPENINGS) / F.greatest(F.size("paras"), F.lit(1)))})
    b = b.withColumn("variety", arrays.variety("w", F.lit(WINDOW)))
    rows = b.withColumns({"mattr": F.coalesce("variety.mattr", "ttr"), "repeated_trigram_ratio": F.coalesce("variety.again", F.lit(0.0))})
    return rows.select("doc_id", "lang", "text", *[F.col(f).cast("double").alias(f) for f in lex.FEATURES])


def perplexity_of(words: int | Column, vocabulary: Column, h: Column, two: Column, three: Column) -> Column:
    """The pseudo-perplexity, 5 to 150; 50 for fewer than five words."""
    raw = 20 + h * 60 + vocabulary * 30 - two * 40 - three * 30
    return F.when(words < 5, 50.0).otherwise(F.greatest(F.lit(5.0), F.least(F.lit(150.0), raw)))


PPL_WORD = r"[a-zA-Z\x{400}-\x{4FF}']{2,}"


def word_hashes(c: Column) -> Column:
    """Hashes of a text's words, in order."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(PPL_WORD), F.lit(0)), lambda w: F.xxhash64(w))


def perplexity_from(hashes: Column) -> Column:
    """The pseudo-perplexity from repeats and entropy of a text's own n-grams; words by hash."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def of(h: Column) -> Column:
        two, three = repeats(tx.gram_hashes(h, 2)), repeats(tx.gram_hashes(h, 3))
        variety = F.size(F.array_distinct(h)) / F.greatest(F.size(h), F.lit(1))
        return tx.let(two, lambda g: tx.let(three["share"], lambda t: perplexity_of(F.size(h), variety, zero(g["entropy"]), zero(g["share"]), zero(t))))

    return tx.let(hashes, of)


def perplexity(docs: DataFrame) -> DataFrame:
    """``(doc_id, perplexity)``."""
    return docs.select("doc_id", F.coalesce(perplexity_from(word_hashes(F.col("text"))), F.lit(50.0)).alias("perplexity"))


def profile(docs: DataFrame, window: int = 3) -> DataFrame:
    """``(doc_id, flatness, periodicity, mean_ppl, n_windows)`` of perplexities over runs of
    three sentences; of fewer than five sentences the whole text's. Words are split once
    a sentence; a run's are those of its sentences, so a text is read once and stays whole.
    Runs are counted by sorting those of many texts together (``arrays.perplexities``)."""
    rows = tx.pinned(docs.select("doc_id", "text"), s=tx.split_sentences(F.col("text")))
    n = F.size("s")
    rows = rows.withColumn("long", n >= window + 2)
    long = F.coalesce("long", F.lit(False))
    parts = F.when(long, F.col("s")).otherwise(F.array("text"))
    rows = tx.pinned(rows, p=arrays.perplexities(parts, F.when(long, window).otherwise(1))).withColumn("m", mean(F.col("p")))
    flat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - deviation(F.col("p")) / F.col("m")))
    return rows.select(
        "doc_id",
        F.when(F.col("long"), tx.rounded(flat)).otherwise(0.5).alias("flatness"),
        F.when(F.col("long") & (F.size("p") >= 6), tx.rounded(echo(F.col("p")))).otherwise(0.0).alias("periodicity"),
        tx.rounded(F.col("m"), 2).alias("mean_ppl"),
        F.size("p").cast("long").alias("n_windows"),
    )
