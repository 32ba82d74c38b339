"""Synthetic rows and texts: feature profiles, paraphrases, noise, mixtures. All are seeded
by row, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import lexicons as lex
from provena.functions import text as tx

LABELS = {"human": 0.0, "ai": 1.0, "humanized": 1.0}


def chance(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the parts' values."""
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11).cast("double") / float(1 << 53)


def picked(values: list[str], at: Column) -> Column:
    return F.element_at(tx.strings(values), (F.floor(at * len(values)) + 1).cast("int"))


def profiles(spark: SparkSession) -> DataFrame:
    """``(profile, feature, mean, std)``."""
    rows = [(p, f, float(m), float(s)) for p, own in lex.PROFILES.items() for f, (m, s) in own.items()]
    return spark.createDataFrame(rows, "profile string, feature string, mean double, std double")


def synthetic(spark: SparkSession, profile: str, n: int, noise: float = 0.0, seed: int = 7) -> DataFrame:
    """``n`` rows of features drawn from a profile, negative values cut at 0; ``noise``
    widens each deviation by up to that share."""
    cols = []
    for i, (f, (m, s)) in enumerate(lex.PROFILES[profile].items()):
        wide = F.lit(float(s)) * (1 + noise * F.rand(seed * 1000 + i))
        cols.append(F.greatest(F.lit(0.0), m + F.randn(seed * 2000 + i) * wide).alias(f))
    return spark.range(n).select("id", F.lit(profile).alias("profile"), F.lit(LABELS[profile]).alias("label"), *cols)


def training_set(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Human and ai rows, half as many humanized, and a third as many of each with noise."""
    out = synthetic(spark, "human", n, 0, seed)
    for i, (p, k, noise) in enumerate((("ai", n, 0.0), ("humanized", n // 2, 0.0), ("human", n // 3, 0.25), ("ai", n // 3, 0.25))):
        out = out.unionByName(synthetic(spark, p, k, noise, seed + i + 1))
    return out


def train(rows: DataFrame, seed: int = 7, trees: int = 200, rounds: int = 150):
    """A pipeline of scaled features and three classifiers; their mean probability votes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = rows.count()
    out = lambda k: {"featuresCol": "scaled", "labelCol": "label", "predictionCol": f"{k}_p", "rawPredictionCol": f"{k}_r", "probabilityCol": k}
    return Pipeline(stages=[
        VectorAssembler(inputCols=lex.FEATURES, outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        RandomForestClassifier(numTrees=trees, maxDepth=12, minInstancesPerNode=5, seed=seed, **out("rf")),
        LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=100, **out("lr")),
        GBTClassifier(featuresCol="scaled", labelCol="label", predictionCol="gb_p", maxIter=rounds, maxDepth=6, stepSize=0.1, seed=seed).setRawPredictionCol("gb_r").setProbabilityCol("gb"),
    ]).fit(rows)


def vote(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``ai_probability``, 0 to 1."""
    from pyspark.ml.functions import vector_to_array

    share = lambda k: vector_to_array(k)[1]
    scored = model.transform(rows).withColumn("ai_probability", (share("rf") + share("lr") + share("gb")) / 3)
    return scored.select(*rows.columns, "ai_probability")


def save_model(model, path: str, metrics: dict[str, float] | None = None) -> None:
    """The pipeline and beside it its features, metrics and version, as one row of JSON."""
    import json

    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    about = json.dumps({"features": lex.FEATURES, "metrics": metrics or {}, "version": "2.0"})
    SparkSession.getActiveSession().createDataFrame([(about,)], "value string").write.mode("overwrite").text(f"{path}/about")


def load_model(path: str):
    """``(model, about)`` as ``save_model`` left them; an error if they aren't there."""
    import json

    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    about = json.loads(SparkSession.getActiveSession().read.text(f"{path}/about").first()[0])
    if about["features"] != lex.FEATURES:
        raise ValueError("the model was trained on other features")
    return PipelineModel.load(f"{path}/model"), about


def predict_from_text(model, docs: DataFrame) -> DataFrame:
    """``(doc_id, ai_probability)`` of texts (``doc_id, lang, text``)."""
    from provena.operators import features

    return vote(model, features.features(docs).na.fill(0.0)).select("doc_id", "ai_probability")


def importances(model) -> list[tuple[str, float]]:
    """Features by the forest's importance, the ten first."""
    rf = next(s for s in model.stages if s.__class__.__name__.startswith("RandomForest"))
    return sorted(zip(lex.FEATURES, rf.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:10]


def cross_validated(rows: DataFrame, folds: int = 5, seed: int = 7) -> tuple[float, float]:
    """Mean and deviation of a forest's accuracy over folds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    pipe = Pipeline(stages=[VectorAssembler(inputCols=lex.FEATURES, outputCol="features"), RandomForestClassifier(numTrees=20, maxDepth=8, seed=seed)])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed).fit(rows)
    return cv.avgMetrics[0], cv.stdMetrics[0]


def paraphrase(text: Column, lang: Column, key: Column, p: float = 0.6, seed: int = 0) -> Column:
    """The first occurrence of each known word, with probability p, by its synonym, in order;
    a later pair may replace what an earlier one put in."""

    return _replaced(text, lang, key, p, seed, lex.SYNONYMS, text)


def _replaced(text: Column, lang: Column, key: Column, p: float, seed: int, table: dict, other: Column | None) -> Column:
    def fold(k: str) -> Column:
        out = text
        for i, (old, new) in enumerate(table[k]):
            pattern = F.when(chance(key, F.lit(i), seed=seed) < p, rf"(?isU)^(.*?)\b\Q{old}\E\b").otherwise("(?!)")
            out = F.regexp_replace(out, pattern, F.lit(f"$1{new}"))
        return out

    return F.when(lang == "uz", fold("uz")).when(lang == "ru", fold("ru")).when(lang == "en", fold("en")).otherwise(fold("en") if other is None else other)


def reworded(text: Column, lang: Column, key: Column, p: float = 0.5, seed: int = 0) -> Column:
    """As ``paraphrase``, with pairs that build on one another, and English's for other languages."""
    return _replaced(text, lang, key, p, seed, lex.CHAINED_SYNONYMS, None)


def humanized(text: Column, lang: Column, key: Column, seed: int = 0) -> Column:
    """A short remark before each sentence but the first whose number a seeded draw of 3 to 5 divides."""

    def one(k: str) -> Column:
        s = F.split(tx.strip(text), f"(?<=[.!?]){tx.SPACE}+")
        every = lambda i: (3 + F.floor(chance(key, i, seed=seed) * 3)).cast("int")
        said = F.transform(s, lambda x, i: F.when((i > 0) & (i % every(i) == 0), F.concat_ws(" ", picked(lex.REMARKS[k], chance(key, i, seed=seed + 1)), x)).otherwise(x))
        return F.array_join(said, " ")

    return tx.by_lang(lang, {k: one(k) for k in ("en", "uz", "ru")})


def filled(template: Column, topic: Column) -> Column:
    """A template with each ``{name}`` that the map ``topic`` has replaced by its value."""
    return F.aggregate(F.map_entries(topic), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def composed(parts: Column, fragments: Column, topic: Column, key: Column, seed: int = 0) -> Column:
    """A text from a template of parts: one that starts with ``{name}`` of the map ``fragments``
    becomes one of that name's sentences, by a seeded draw; all are filled from ``topic``."""

    def one(part: Column, i: Column) -> Column:
        choices = F.element_at(fragments, F.regexp_extract(part, r"^\{(\w+)\}", 1))
        drawn = F.get(choices, F.floor(chance(key, i, seed=seed) * F.size(choices)).cast("int"))
        return filled(F.coalesce(drawn, part), topic)

    return F.array_join(F.transform(parts, one), " ")


def texts_by_template(spark: SparkSession, templates: DataFrame, fragments: DataFrame, topics: DataFrame, n: int, kind: str, seed: int = 0) -> DataFrame:
    """``(lang, id, text)``: n texts of a kind (human or ai) for each language.

    ``templates`` holds ``kind, lang, parts``, ``fragments`` ``lang, name, choices`` and
    ``topics`` ``lang, topic`` (a map); a template and a topic are drawn for each text.
    Human texts get ``noisy`` remarks. The three tables are lists that someone wrote, and are broadcast.
    """
    t = templates.where(F.col("kind") == kind).groupBy("lang").agg(F.sort_array(F.collect_list("parts")).alias("ts"))
    f = fragments.groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "choices")))).alias("fs"))
    o = topics.groupBy("lang").agg(F.collect_list("topic").alias("os"))
    rows = spark.range(n).crossJoin(F.broadcast(t.join(o, "lang").join(f, "lang", "left")))
    at = lambda c, k: F.get(c, F.floor(chance("lang", "id", seed=seed + k) * F.size(c)).cast("int"))
    rows = tx.pinned(rows, parts=at("ts", 1), topic=at("os", 2))
    key = F.concat_ws(":", F.lit(kind), "lang", "id")
    none = F.create_map().cast("map<string,array<string>>")
    rows = tx.pinned(rows, text=composed(F.col("parts"), F.coalesce("fs", none), F.col("topic"), key, seed))
    text = noisy(F.col("text"), F.col("lang"), key, seed) if kind == "human" else F.col("text")
    return rows.select("lang", "id", text.alias("text"))


def build_dataset(spark: SparkSession, templates: DataFrame, fragments: DataFrame, topics: DataFrame, target: int = 5000, seed: int = 0) -> DataFrame:
    """``(category, lang, id, text)``: for each language a tenth of ``target`` human texts, as many
    ai texts, half as many paraphrased and a third as many mixed."""
    n = target // 10
    made = lambda kind, k, s: texts_by_template(spark, templates, fragments, topics, k, kind, seed + s)
    key = F.concat_ws(":", "lang", "id")
    human = made("human", n, 0).select(F.concat(F.lit("human/"), "lang", F.lit("_gen")).alias("category"), "lang", "id", "text")
    ai = made("ai", n, 10).select(F.lit("ai/local_gen").alias("category"), "lang", "id", "text")
    para = made("ai", n // 2, 20).select(F.lit("paraphrase/synonym").alias("category"), "lang", "id", paraphrase(F.col("text"), F.col("lang"), key, seed=seed).alias("text"))
    both = made("human", n // 3, 30).join(made("ai", n // 3, 40).withColumnRenamed("text", "ai"), ["lang", "id"])
    mix = both.select(F.lit("mixed/50_50").alias("category"), "lang", "id", interleaved(F.col("text"), F.col("ai"), key, seed).alias("text"))
    return human.unionByName(ai).unionByName(para).unionByName(mix)


def variants(texts: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """``(key, lang, category, text)``: the three rewritten forms of each ai text."""
    c, lang, k = F.col("text"), F.col("lang"), F.col(key)
    forms = {"synonym": reworded(c, lang, k, seed=seed), "restructure": restructured(c, k, seed=seed), "humanize": humanized(c, lang, k, seed)}
    each = F.explode(F.array(*[F.struct(F.lit(f"paraphrase/{n}").alias("category"), x.alias("text")) for n, x in forms.items()]))
    return texts.select(key, "lang", each.alias("x")).select(key, "lang", "x.category", "x.text")


def mixtures(human: DataFrame, ai: DataFrame, target: int = 500, ratios: tuple[float, ...] = (0.3, 0.5, 0.7), seed: int = 0) -> DataFrame:
    """``(lang, category, text)``: for each language and ratio, ``target / 9`` mixtures at most, of
    texts drawn by a seeded order on both sides. Both hold ``lang, text``."""
    from provena.operators.corpus import ranked

    n = target // 9
    each = F.explode(F.array(*[F.lit(x) for x in ratios])).alias("ratio")
    drawn = lambda d, s: ranked(d.select("lang", "text", each), ["lang", "ratio"], [F.xxhash64("text", "ratio", F.lit(seed + s)).asc(), F.asc("text")], n)
    both = drawn(human, 1).join(drawn(ai, 2).withColumnRenamed("text", "ai"), ["lang", "ratio", "rank"])
    text = F.lit(None).cast("string")
    for x in ratios:
        text = F.when(F.col("ratio") == x, mixed(F.col("text"), F.col("ai"), x, F.concat_ws(":", "lang", "rank"), seed)).otherwise(text)
    name = F.format_string("mixed/%d_%d", F.round(F.col("ratio") * 100).cast("int"), F.round((1 - F.col("ratio")) * 100).cast("int"))
    return both.select("lang", name.alias("category"), text.alias("text"))


def noisy(text: Column, lang: Column, key: Column, seed: int = 0) -> Column:
    """A short remark before some sentences, and at times a question at the end."""

    def one(k: str) -> Column:
        s = F.split(text, f"(?<=[.!?]){tx.SPACE}+")
        said = F.transform(s, lambda x, i: F.when(chance(key, i, seed=seed) < 0.15, F.concat_ws(" ", picked(lex.FILLERS[k], chance(key, i, seed=seed + 1)), x)).otherwise(x))
        end = F.when(chance(key, seed=seed + 2) < 0.2, F.array(picked(lex.TAGS[k], chance(key, seed=seed + 3)))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(said, end), " ")

    return tx.by_lang(lang, {k: one(k) for k in ("en", "uz", "ru")})


def restructured(text: Column, key: Column, p: float = 0.5, seed: int = 0) -> Column:
    """Sentences of over ten words are, with probability p, cut in two at the middle."""
    s = F.split(text, f"(?<=[.!?]){tx.SPACE}+")

    def halve(x: Column, i: Column) -> Column:
        w = tx.words(x)
        half = F.floor(F.size(w) / 2).cast("int")
        two = F.concat(F.array_join(F.slice(w, F.lit(1), half), " "), F.lit(". "), F.initcap(F.element_at(w, half + 1)), F.lit(" "), F.array_join(F.slice(w, half + 2, F.size(w)), " "))
        return F.when((F.size(w) > 10) & (chance(key, i, seed=seed) < p), two).otherwise(x)

    return F.array_join(F.transform(s, halve), " ")


def interleaved(human: Column, ai: Column, key: Column, seed: int = 0) -> Column:
    """Sentences of both in turn, each kept with even odds; the human text if none is."""
    s = [F.split(c, f"(?<=[.!?]){tx.SPACE}+") for c in (human, ai)]
    kept = [_kept(c, key, seed + j) for j, c in enumerate(s)]
    both = F.flatten(F.transform(F.arrays_zip(kept[0].alias("h"), kept[1].alias("a")), lambda x: F.array(x["h"], x["a"])))
    out = F.array_join(F.array_compact(both), " ")
    return F.when(out == "", human).otherwise(out)


def _kept(c: Column, key: Column, seed: int) -> Column:
    return F.transform(c, lambda x, i: F.when(chance(key, i, seed=seed) > 0.5, x))


def mixed(human: Column, ai: Column, ratio: float, key: Column, seed: int = 0) -> Column:
    """As many sentences as both have on average: the ratio from the ai text, the rest from
    the human one, in seeded order."""
    h, a = (F.split(c, f"(?<=[.!?]){tx.SPACE}+") for c in (human, ai))
    total = F.greatest(F.size(h), F.size(a))
    n = F.floor(total * ratio).cast("int")
    some = F.concat(F.slice(a, F.lit(1), n), F.slice(h, F.lit(1), F.greatest(total - n, F.lit(0))))
    order = F.array_sort(F.transform(some, lambda x, i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("k"), x.alias("x"))))
    return F.array_join(F.transform(order, lambda x: x["x"]), " ")


def topics_by_prompts(topics: DataFrame, prompts: DataFrame, most: int | None = None) -> DataFrame:
    """Each topic with each prompt of its language, ``{topic}`` filled in; ``most`` bounds
    them by language."""
    rows = topics.join(prompts, "lang").withColumn("prompt", F.replace("template", F.lit("{topic}"), F.col("topic")))
    if most is None:
        return rows
    from provena.operators.corpus import ranked

    return ranked(rows, ["lang"], [F.xxhash64("topic", "template").asc(), F.asc("topic"), F.asc("template")], most).drop("rank")
