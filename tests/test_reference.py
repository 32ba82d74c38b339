"""Rules of the text functions and operators on hand-made fixtures."""

import inspect
import math
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from provena import catalog
from provena.functions import arrays
from provena.functions import text as tx
from provena.operators import accounts, analyze, corpus, detector, features, generation, history, retrieval, web
from provena.operators import similarity as sim
from provena.sources import corpus as files
from provena.streaming import state

SF = "/root/testdata/sf0.001"


def one(spark, text, make, lang="en"):
    return spark.createDataFrame([(1, text, lang)], "doc_id long, text string, lang string").select(make(F.col("text")).alias("x")).first()["x"]


def test_language(spark):
    cases = {"o'zbek va g'oya": "uz", "plain english words": "en", "it’s and he’s": "uz", "русский текст здесь": "ru", "muhim natija": "uz", "": "en"}
    for text, want in cases.items():
        assert one(spark, text, tx.language) == want


def test_hidden_characters(spark):
    hidden = lambda t: one(spark, t, tx.hidden_characters)
    assert hidden("plain latin text with оne").manipulation_score == 5
    assert hidden("ооо latin text that is long enough").is_manipulated
    r = hidden("zero​width")
    assert r.invisible == 1 and r.manipulation_score == 15 and r.is_manipulated
    assert hidden("обычный русский текст").manipulation_score == 0
    assert one(spark, "оk​é", tx.plain_letters) == "oké"


def test_clean(spark):
    assert one(spark, "a\nb\nMy preferences are\nc", tx.clean) == "a\nb"
    for n, hit in ((9, False), (10, True), (300, True), (301, False)):
        assert ("[Q]" in one(spark, "w " * 900 + '"' + "x" * n + '"', tx.clean)) == hit
    assert one(spark, "so p < 0.05 and n = 20 here", tx.clean) == "so [STD] and [STD] here"


def test_stems_and_tokens(spark):
    uz = lambda t: one(spark, t, lambda c: tx.normal_form(c, F.lit("uz")))
    assert uz("kitoblardan kelmoqda bordan uydagi yangi") == "kitob kel bor uydagi yangi"
    assert one(spark, "The cat, sat! on a Mat mat", lambda c: tx.match_tokens(c, F.lit("en"))) == ["cat", "sat", "mat", "mat"]
    ru = one(spark, "экономика и право", lambda c: tx.match_tokens(c, F.lit("ru")))
    assert ru == ["экономика", "право"]
    # look-alikes made Latin are lost to the Russian tokenizer
    assert one(spark, "экономика и право", lambda c: tx.match_tokens(tx.plain_letters(c), F.lit("ru"))) == ["экнмик"]
    assert one(spark, "abc", tx.gram_hash) == 922803570


def test_quality_edges(spark):
    words = lambda n: " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    q = lambda t: one(spark, t, corpus.quality)
    assert q(words(19)) == 0 and q(words(20)) > 0 and q(words(400)) == 1.0
    assert q("same " * 100) == 0 and q("ab " * 50) == 0 and q("") == 0 and q(None) == 0
    assert q("12345678 " * 30) == 0
    # texts of ten words over and over have no quality
    assert q("one two three four five six seven eight nine ten " * 20) == 0


def test_admission_order(spark):
    short, good = "to be or is it we do he in on " * 3, " ".join(f"token{chr(97 + i)}" for i in range(25))
    rows = [(1, good), (2, good), (3, short), (4, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus.admitted(docs).collect()] == [1]


def brute_winnow(h, w):
    return set(h) if len(h) < w else {min(h[i : i + w]) for i in range(len(h) - w + 1)}


@settings(max_examples=15, deadline=None)
@given(h=st.lists(st.integers(0, 50), max_size=30), w=st.integers(2, 4))
def test_winnow(spark, h, w):
    got = spark.createDataFrame([(h,)], "h array<long>").select(tx.winnow(F.col("h"), w)).first()[0]
    assert set(got) == brute_winnow(h, w) and len(got) == len(set(got))


@settings(max_examples=8, deadline=None)
@given(words=st.lists(st.text("abcdeKİΣéßжяЙ'-1 \u00a0", max_size=9) | st.sampled_from(["kitoblardan", "the", "o'qish", "экономика", "running", "\x1c"]), max_size=40), lang=st.sampled_from(["en", "uz", "ru"]), source=st.booleans())
def test_prints_match_the_columns(spark, words, lang, source):
    """Prints are made outside the columns' lambdas and are the same."""
    text = " ".join(words)
    df = spark.createDataFrame([(1, lang, text), (2, lang, None)], "doc_id long, lang string, text string")
    norm = tx.normal_form(F.col("text"), F.col("lang"))
    want = df.select("doc_id", "lang", F.when(F.lit(source) & (tx.n_words(norm) < 4), F.lower("text")).otherwise(norm).alias("norm"))
    want = want.withColumn("t", tx.match_tokens(F.col("norm"), F.col("lang")))
    want = want.select("norm", F.size("t").alias("n_tokens"), *[tx.winnow(F.transform(tx.ngrams(F.col("t"), n), tx.gram_hash), w).alias(f"f{n}") for n, w in sim.SIZES.items()]).where("norm is not null").first()
    got = {r.doc_id: r for r in sim.prints(df, "doc_id", source).collect()}
    assert tuple(got[1][c] for c in want.asDict()) == tuple(want)
    assert got[2].norm is None and got[2].f3 == got[2].f5 == got[2].f7 == []
    (g,) = sim.with_grams(df.where("doc_id = 1").withColumnRenamed("text", "sentence")).collect() or [None]
    tokens = df.where("doc_id = 1").select(tx.match_tokens(F.col("text"), F.col("lang"))).first()[0]
    n = min(5, len(tokens) - 1)
    assert (g.grams if g else None) == (list(dict.fromkeys(" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))) if len(tokens) >= 4 else None)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prints_are_made_once(spark):
    """No lambda hashes grams, and the queries on pairs read stored prints."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "md5" not in plan_of(sim.prints(docs, "doc_id"))
    for name in ("winnow_pair_score", "tfidf_pair_cosine"):
        plan = plan_of(catalog.QUERIES[name](spark, SF))
        assert "prints" not in plan and "Join" not in plan


def test_few_submissions_stay_out_of_shuffles(spark):
    """What the submissions ask for goes to the corpus, not the corpus's grams over the network."""
    subs = spark.createDataFrame([(1, "en", "These seven quite ordinary words stand here together.")], "sub_id long, lang string, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    top = spark.createDataFrame([(1, 5)], "sub_id long, doc_id long")
    for df in (sim.exact_sentences(subs, docs), sim.similar_sentences(subs, docs), sim._aggregate(subs, docs, top), sim.shared_prints(sim.prints(subs, "sub_id"), sim.prints(docs, "doc_id"))):
        assert "broadcast" in plan_of(df)


def test_copies_score_high(spark):
    copy = " ".join(f"{a}{b}ing" for a in ("walk", "talk", "read", "sing", "jump") for b in ("er", "ab", "cd", "ef", "gh", "ij")) + "."
    docs = spark.createDataFrame([(1, "en", copy), (2, "en", "something else entirely stands in this other text.")], "doc_id long, lang string, text string")
    subs = docs.where("doc_id = 1").withColumnRenamed("doc_id", "sub_id")
    (m,) = sim.matches(subs, docs).collect()
    assert m.doc_id == 1 and m.score == 100.0
    (o,) = sim.overall(subs, docs).collect()
    assert o.overall == 100.0 and o.is_plagiarism and o.aggregate == 100.0
    got = sim.highlights(subs, docs).collect()
    assert [r.match_type for r in got] == ["exact"]


def test_matching_by_the_submissions_language(spark):
    """A source is read by the submission's rules, whatever its own tag is; sources under 20
    words are no sources; one whose normal form is too short stands as it is, lower-cased."""
    copy = " ".join(f"{a}{b}ing" for a in ("walk", "talk", "read", "sing", "jump") for b in ("er", "ab", "cd", "ef", "gh", "ij")) + "."
    marked = " ".join(f"alpha{c}1," for c in "abcdefghijklmnopqrstuv")
    rows = [(1, "ru", copy), (2, "uz", copy), (3, "en", " ".join(copy.split()[:8])), (4, "en", marked)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    subs = spark.createDataFrame([(1, "en", copy), (2, "fr", copy)], "sub_id long, lang string, text string")
    got = {(r.sub_id, r.doc_id): r.score for r in sim.matches(subs, docs).collect()}
    assert got == {(i, j): 100.0 for i in (1, 2) for j in (1, 2)}
    only = spark.createDataFrame([(1, 2)], "sub_id long, doc_id long")
    assert [(r.sub_id, r.doc_id) for r in sim.matches(subs, docs, only=only).collect()] == [(1, 2)]
    assert sorted(r.doc_id for r in sim.sources(docs, ["en"]).collect()) == [1, 2, 4]
    p = {r.doc_id: r for r in sim.prints(sim.sources(docs, ["en"]), "doc_id", source=True).collect()}
    assert p[4].norm == marked and p[4].n_tokens == 22 and p[1].norm != copy


def test_russian_and_uzbek_match(spark):
    ru = "экономика страны развивается быстро потому новые заводы строятся каждый месяц рабочие получают хорошую зарплату школы открываются города растут дороги ремонтируются"
    uz = "kitoblardan o'qish bolalarga foydali maktablarda o'qituvchilar yangi darslarni tayyorlaydi shaharlarda kutubxonalar ochilmoqda yoshlar kelajakni qurmoqda ilmiy ishlar rivojlanmoqda dehqonlar paxta yetishtirmoqda"
    docs = spark.createDataFrame([(1, "en", ru), (2, "en", uz)], "doc_id long, lang string, text string")
    subs = spark.createDataFrame([(1, "ru", ru), (2, "uz", uz)], "sub_id long, lang string, text string")
    assert {(r.sub_id, r.doc_id): r.score for r in sim.matches(subs, docs).collect()} == {(1, 1): 100.0, (2, 2): 100.0}
    f = {r.doc_id: r for r in features.features(spark.createDataFrame([(1, "Кроме того, дом ремонтируется. Возможно, это безусловно так и есть!", "ru"), (2, "It's here and they don't care. We've gone.", "en")], "doc_id long, text string, lang string")).collect()}
    assert f[1].connector_density == 0.5 and f[1].hedging_density == 0.5 and f[1].certainty_density == 0.5 and f[1].passive_ratio == 0.5
    assert f[2].contraction_ratio == pytest.approx(3 / 8)


def test_analysis(spark):
    source = " ".join(f"{a}{b}ing" for a in ("walk", "talk", "read", "sing", "jump") for b in ("er", "ab", "cd", "ef", "gh", "ij")) + "."
    docs = spark.createDataFrame([(1, "en", source), (2, "en", " ".join(f"other{chr(97 + i)} word{chr(97 + i)}" for i in range(20))), (3, "en", " ".join(f"third{chr(97 + i)} text{chr(97 + i)}" for i in range(20)))], "doc_id long, lang string, text string")
    subs = spark.createDataFrame([(1, source), (2, "tiny"), (3, "x" * 30), (4, None), (5, source.replace("a", "а", 1) + "\nReferences\n" + "cut this away " * 3)], "sub_id long, text string")
    got = {r.sub_id: r for r in analyze.analyze(subs, docs).collect()}
    assert [got[i].error for i in range(1, 6)] == [None, "too short", "too few words", "too short", None]
    r = got[1]
    assert (r.overall, r.aggregate, r.best_doc, r.threshold, r.is_plagiarism, r.level) == (100.0, 100.0, 1, 27, True, "critical") and r.risks.startswith("plagiarism")
    assert got[5].best_doc == 1 and got[5].overall == 100.0 and got[5].manipulation_score == 5
    assert got[2].overall == 0 and got[2].risks == "" and got[2].level is None
    log = analyze.check_rows(analyze.analyze(subs, docs), subs.withColumns({"user_id": F.when(F.col("sub_id") < 3, 7), "filename": F.lit("f")}), F.current_timestamp())
    (c,) = log.collect()
    assert c.user_id == 7 and c.text_preview == source[:150] + "…" and '"overall":100.0' in c.result_json
    users = spark.createDataFrame([(7, 2), (8, 0)], "user_id int, checks_used long")
    assert {u.user_id: u.checks_used for u in analyze.used_up(users, log).collect()} == {7: 3, 8: 0}
    semantic = spark.createDataFrame([(1, 90.0, True, False)], "sub_id long, semantic double, translation_found boolean, paraphrase_found boolean")
    (x,) = analyze.analyze(subs.where("sub_id = 1"), docs, semantic=semantic).collect()
    assert x.overall == 95.5 and "translation" in x.risks
    hl = sim.highlights(subs.where("sub_id = 1").withColumn("lang", F.lit("en")), docs)
    top = sim.matches(subs.where("sub_id = 1").withColumn("lang", F.lit("en")), docs)
    (p,) = analyze.report(analyze.analyze(subs.where("sub_id = 1"), docs), top, hl, subs).collect()
    assert p.copied == [source[:120]] and p.sources[0].doc_id == 1 and p.sample == source
    (h,) = web.highlight_html(hl).collect()
    assert (h.copied, h.total, h.html) == (1, 1, f'<span class="exact">{source}</span>')


def test_accounts(spark):
    rows = [(1, " Ann ", "A@b.uz ", "secret"), (2, "B", "b@b.uz", "secret"), (3, "Bob", "b@b.uz", "12345"), (4, "Bob", "no mail", "123456"), (5, None, None, None), (6, "Eve", "a@B.uz", "secret")]
    asked = spark.createDataFrame(rows, "user_id long, name string, email string, password string")
    err = {r[0]: r[1] for r in asked.select("user_id", accounts.registration_error(F.col("name"), F.col("email"), F.col("password"))).collect()}
    assert err == {1: None, 2: "name", 3: "password", 4: "email", 5: "name", 6: None}
    users = spark.createDataFrame([(9, "Old", "old@b.uz")], "user_id long, name string, email string")
    assert [tuple(r) for r in accounts.registered(users, asked).collect()] == [(1, "Ann", "a@b.uz")]
    assert accounts.registered(accounts.registered(users, asked), asked).count() == 0
    new = accounts.updated(users, spark.createDataFrame([(9, None), (1, "x")], "user_id long, name string"), "user_id").collect()
    assert [tuple(r) for r in new] == [(9, None, "old@b.uz")]


def test_words_of_the_interface(spark):
    m = spark.createDataFrame([("hi", "uz", "Salom {name}"), ("hi", "en", "Hello {name}"), ("bye", "uz", "Xayr")], "key string, lang string, message string")
    q = spark.createDataFrame([("hi", "en", {"name": "A"}), ("bye", "en", {}), ("none", "ru", None)], "key string, lang string, vars map<string,string>")
    assert {r.key: r.message for r in web.worded(m, q).collect()} == {"hi": "Hello A", "bye": "Xayr", "none": "none"}
    for text, want in {"o'zbek va g'oya": "uz", "plain words": "en", "русский": "ru", "tadqiqot natija": "uz"}.items():
        assert one(spark, text, detector.guessed_language) == want
    label = lambda v, k: spark.range(1).select(detector.verdict_label(F.lit(v), F.lit(k))).first()[0]
    assert label("ai", "ru") == "Написано ИИ" and label("human", "fr") == "Human-written" and label("too_short", "en") is None


def test_model_blends(spark):
    blend = lambda *a: spark.range(1).select(detector.blended(*[F.lit(x) if x is not None else None for x in a])).first()[0]
    assert blend(0.4, 12) == 0.4 and blend(0.4, 12, -1.0) == 0.4
    assert blend(0.4, 12, 0.8) == pytest.approx(0.66) and blend(0.4, 12, None, 0.9) == pytest.approx(0.7)
    assert blend(0.4, 12, 0.8, 0.9) == pytest.approx(0.725) and blend(0.4, 9, 0.8, 0.9) == pytest.approx(0.625)
    layer = lambda *a: spark.range(1).select(detector.model_layer(*[F.lit(x) if x is not None else None for x in a])).first()[0]
    assert layer() == 0.5 and layer(0.7) == 0.7 and layer(None, 0.9) == 0.9 and layer(0.5, 1.0) == pytest.approx(0.8) and layer(0.3, -1.0) == 0.3


def test_layers_by_hand(spark):
    row = dict.fromkeys(features.lex.FEATURES, 0.0) | {"burstiness": 0.2, "ttr": 0.5, "connector_density": 0.3, "formulaic_density": 0.1, "sent_len_std": 3.0, "para_uniformity": 0.5, "passive_ratio": 0.3}
    df = spark.createDataFrame([row]).withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("uz"))))
    got = {r.lang: r for r in df.select("lang", detector.statistical().alias("st"), detector.stylometric(F.col("lang")).alias("sy")).collect()}
    assert got["en"].st == pytest.approx(0.6 * 0.15 + 0.08 + 0.5 * 0.12 + 0.08 + 0.25 * 0.12 + 0.7 * 0.10 + 0.5 * 0.05 + 0.03)
    assert got["en"].sy == pytest.approx((0.375 * 0.12 + 0.10 + 0.5 * 0.15 + 0.2 * 0.12 + 0.75 * 0.12 + 0.5 * 0.10 + 0.08 + 0.08) / 0.87)
    assert got["uz"].sy == pytest.approx(0.375 * 0.08 + 0.08 + 0.5 * 0.12 + 0.2 * 0.15 + 0.75 * 0.10 + 0.5 * 0.08 + 0.07 + 0.07)


def test_templates_and_models(spark, tmp_path):
    templates = spark.createDataFrame([("human", "en", ["{intro}", "I like {name}."]), ("ai", "en", ["Moreover, {name} is {kind}.", "It is {kind}."])], "kind string, lang string, parts array<string>")
    fragments = spark.createDataFrame([("en", "intro", ["So {name}.", "Well {name}."])], "lang string, name string, choices array<string>")
    topics = spark.createDataFrame([("en", {"name": "tea", "kind": "hot"}), ("en", {"name": "ice", "kind": "cold"})], "lang string, topic map<string,string>")
    rows = generation.build_dataset(spark, templates, fragments, topics, 600).collect()
    n = {}
    for r in rows:
        n[r.category] = n.get(r.category, 0) + 1
        assert "{" not in r.text
    assert n == {"human/en_gen": 60, "ai/local_gen": 60, "paraphrase/synonym": 30, "mixed/50_50": 20}
    assert {r.text for r in rows if r.category == "ai/local_gen"} == {"Moreover, tea is hot. It is hot.", "Moreover, ice is cold. It is cold."}
    docs = spark.createDataFrame([(i, "en", "This is important. Two. Three. Four. Five. Six. Seven.") for i in range(60)], "doc_id long, lang string, text string")
    v = generation.variants(docs).collect()
    said = [r.text for r in v if r.category == "paraphrase/synonym"]
    # one word goes the whole chain in about a quarter of the texts
    assert len(v) == 180 and 5 <= sum("crucial" in x for x in said) <= 25 and any("significant" in x for x in said)
    assert sum(r.text != docs.first().text for r in v if r.category == "paraphrase/humanize") > 30
    mixes = generation.mixtures(docs, docs, target=90).collect()
    assert {r.category for r in mixes} == {"mixed/30_70", "mixed/50_50", "mixed/70_30"} and len(mixes) == 30
    train = generation.training_set(spark, 40)
    model = generation.train(train, trees=3, rounds=2)
    generation.save_model(model, str(tmp_path / "m"), {"accuracy": 0.5})
    again, about = generation.load_model(str(tmp_path / "m"))
    assert about["metrics"] == {"accuracy": 0.5}
    key = lambda m: [r.ai_probability for r in generation.predict_from_text(m, docs.limit(3)).orderBy("doc_id").collect()]
    assert key(model) == key(again) and all(0 <= p <= 1 for p in key(model))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        generation.load_model(str(tmp_path / "none"))
    assert len(generation.importances(model)) == 10
    accuracy, spread = generation.cross_validated(train.select("label", *features.lex.FEATURES), folds=2)
    assert 0.5 < accuracy <= 1 and spread >= 0


def test_nearest_in_batches(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(60, 8))
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T - 2 * np.eye(60)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-c[i])[:5] if c[i][j] > 0.2}
    monkeypatch.setattr(retrieval, "QUERY_BLOCKS", 2)
    for block in (512, 8):
        assert {(r.query_id, r.vec_id) for r in retrieval.nearest(v, q, 5, 0.2, block).collect()} == want


def test_best_of_matches_pairs(spark):
    """Matrix products find what comparing each pair finds: ties, other lengths, null vectors, and
    one's own sentence left out. The plans compare no pairs row by row."""
    import numpy as np

    x = np.random.default_rng(5).integers(-2, 3, size=(40, 3)).astype(float)
    rows = [(i, i % 7, [float(y) for y in r[: 2 if i % 9 == 0 else 3]] if i % 11 else None) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "src_pos long, doc_id long, w array<double>").withColumn("w", retrieval.unit("w")).withColumn("src_lang", F.lit("en"))
    subs = v.where("src_pos % 5 = 0").select(F.col("src_pos").alias("sub_id"), F.lit(0).alias("pos"), F.col("w").alias("v"), F.lit("ru").alias("sub_lang"), F.col("src_pos").alias("but"))
    pairs = v.crossJoin(subs).where("src_pos != but and size(v) = size(w)")
    key = lambda df: sorted((r.sub_id, r.pos, r.doc_id, r.t.cos, r.t.p, r.t.src_lang, r.k) for r in df.collect())
    got = key(sim.best_of(subs, v))
    assert got == key(sim.best_sources(pairs)) and len(got) > 30
    for name in ("semantic_pair_match", "semantic_best_source"):
        plan = plan_of(catalog.QUERIES[name](spark, SF))
        assert "MapInArrow" in plan and "Join Cross" not in plan


def test_thresholds_and_risks(spark):
    n = spark.createDataFrame([(99,), (100,), (800,), (801,)], "n int")
    got = [[r[0] for r in n.select(sim.threshold(F.col("n"), F.lit(k))).collect()] for k in ("uz", "ru", "en", "fr")]
    assert got == [[32, 27, 27, 24], [30, 25, 25, 22], [27, 22, 22, 19], [30, 25, 25, 22]]
    risks = lambda p, ai, *f: n.limit(1).select(*sim.risks(F.lit(p), F.lit(ai), *map(F.lit, f))).first()
    assert risks(10.0, 0.0, False, False, False)[1:] == ("minimal", "low")
    assert risks(61.0, 0.0, False, False, False)[1:] == ("critical", "critical")
    assert risks(10.0, 56.0, True, False, False)[2] == "critical" and risks(10.0, 56.0, False, False, False)[2] == "high"
    assert risks(21.0, 0.0, False, False, False)[2] == "medium"


def test_semantic(spark):
    rows = [(1, 2, 0, 0, [1.0, 0.0], [1.0, 0.0], "en", "ru"), (1, 3, 0, 0, [1.0, 0.0], [0.9, 0.43588989], "en", "en"), (1, 4, 0, 0, [1.0, 0.0], [0.82, 0.5723635], "en", "en"), (1, 5, 0, 0, [1.0, 0.0], [0.5, 0.8660254], "en", "en")]
    df = spark.createDataFrame(rows, "sub_id long, doc_id long, pos int, src_pos int, v array<double>, w array<double>, sub_lang string, src_lang string")
    assert {r.doc_id: r.kind for r in sim.semantic_matches(df).collect()} == {2: "translation", 3: "paraphrase", 4: "similar"}


def test_bm25_floor(spark):
    docs = spark.createDataFrame([(1, ["aaa", "bbb"]), (2, ["aaa", "ccc"]), (3, ["aaa"])], "doc_id long, tokens array<string>")
    terms = {r.term: r.idf for r in retrieval.term_stats(retrieval.postings(docs), docs.agg(F.count("*").alias("n"))).collect()}
    raw = {t: math.log(3 - d + 0.5) - math.log(d + 0.5) for t, d in (("aaa", 3), ("bbb", 1), ("ccc", 1))}
    assert terms["bbb"] == pytest.approx(raw["bbb"]) and terms["aaa"] == pytest.approx(0.25 * sum(raw.values()) / 3)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_cells_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    pair = lambda name: {(r.query_id, r.vec_id) for r in catalog.QUERIES[name](spark, d).collect()}
    exact, got = pair("vector_topk_cosine"), pair("vector_cells_topk")
    print(f"recall of {len(exact)} neighbours on {sf}: {len(exact & got) / len(exact):.3f}")
    assert len(exact & got) >= 0.9 * len(exact)


def test_features(spark):
    text = "Furthermore, the test was created by us. It isn't hard! Is it? Moreover the test was made again, perhaps."
    docs = spark.createDataFrame([(1, text, "en"), (2, "", "en"), (3, "Bugungi kunda o`zbek muhim hisoblanadi. Katta kitob yozildi bugun.", "uz")], "doc_id long, text string, lang string")
    f = {r.doc_id: r for r in features.features(docs).collect()}
    r = f[1]
    assert r.connector_density == pytest.approx(2 / 3) and r.hedging_density == pytest.approx(1 / 3)
    assert r.passive_ratio == pytest.approx(1 / 3) and r.contraction_ratio == pytest.approx(1 / 19)
    assert r.question_ratio == pytest.approx(1 / 3) and r.sent_len_max == 7
    assert math.isnan(f[2].word_len_mean) and f[2].sent_len_mean == 0
    assert f[3].uz_apostrophe_error == 1.0 and f[3].uz_hisoblanadi_density == 0.5 and f[3].uz_template_starts == 1.0 and f[3].passive_ratio == 0.5


def test_moving_variety(spark):
    words = [f"w{(i * i) % 37}" for i in range(140)]
    want = sum(len(set(words[i : i + 50])) / 50 for i in range(91)) / 91
    df = spark.createDataFrame([(1, words)], "doc_id long, w array<string>")
    assert df.select(features.moving_variety(F.col("w")).alias("mattr")).first().mattr == pytest.approx(want)


ODD = ["", None, "One two three. Four five six! Seven eight nine? Ten it's eleven. Twelve one two three.", "Так было и есть здесь. " * 9 + "A b c d. İstanbul ΣΑΣ don't. The end of it.", "word " * 60 + ". " + "one two three four. " * 30]


def test_counts_match_the_columns(spark):
    """Perplexity, variety and sentence hashes are counted outside the columns' lambdas, with the same results."""
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    s, w = tx.feature_sentences(F.col("text")), tx.feature_words(F.col("text"))
    runs = F.transform(F.sequence(F.lit(0), F.size("s") - 3), lambda i: F.array_join(F.slice("s", i + 1, 3), " "))
    texts = docs.withColumn("s", s).withColumn("runs", F.when(F.size("s") >= 5, runs).otherwise(F.array("text")))
    want = texts.select("doc_id", F.transform("runs", lambda x: F.coalesce(features.perplexity_from(features.word_hashes(x)), F.lit(50.0))).alias("p"))
    got = texts.select("doc_id", arrays.perplexities(F.when(F.size("s") >= 5, F.col("s")).otherwise(F.array("text")), F.when(F.size("s") >= 5, 3).otherwise(1)).alias("p"))
    want = {r.doc_id: r.p for r in want.collect()}
    assert {r.doc_id: pytest.approx(r.p) for r in got.collect()} == want and max(map(len, want.values())) > 25
    h = F.transform(w, lambda x: F.xxhash64(x))
    both = docs.where("text is not null").select(arrays.variety(w, F.lit(50)).alias("x"), features.moving_variety(h).alias("m"), features.repeats(tx.gram_hashes(h, 3))["share"].alias("a"), arrays.sentence_hash("text").alias("h"), tx.sentence_hash(F.col("text")).alias("g"))
    for r in both.collect():
        assert r.h == r.g and (r.x.mattr is None) == (r.m is None) and (r.x.again is None) == (r.a is None)
        assert (r.x.mattr or 0) == pytest.approx(r.m or 0) and (r.x.again or 0) == pytest.approx(r.a or 0)
    odd = docs.withColumn("text", F.concat(F.lit("\x1c A b c.\u00a0 D e f…\x85g h i j!?  k. "), "text", F.lit(" . .")))
    for least, ends in ((3, ".!?…"), (4, ".!?")):
        for r in odd.unionByName(docs).select(tx.split_sentences(F.col("text"), least, ends).alias("a"), tx.sentences(F.col("text"), least, ends).alias("b")).collect():
            assert r.a == r.b
    assert {r.doc_id: r.n_windows for r in features.profile(docs).collect()} == {i: len(p) for i, p in want.items()}


def test_scores_and_postings_match_the_columns(spark):
    """Quality, fingerprints, tokens and their counts aren't made by lambdas, and are the same."""
    more = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)) for n in (19, 20, 150, 400)] + ["12345678 " * 30, "ab " * 50, "Zażółć, gęślą-jaźń! " * 9 + "x y zz. И ещё слова."]
    docs = spark.createDataFrame(list(enumerate(ODD + more)), "doc_id long, text string")
    c = F.col("text")
    want = docs.select("doc_id", F.coalesce(tx.n_words(c), F.lit(0)).alias("n_words"), corpus.quality(c).alias("quality"), tx.fingerprint(F.coalesce(c, F.lit(""))).alias("fingerprint"))
    assert sorted(corpus.scored(docs).drop("text").collect()) == sorted(want.collect())
    rows = docs.where("text is not null").select("doc_id", tx.index_tokens(c).alias("want"), arrays.index_tokens(c).alias("tokens"))
    assert all(r.want == r.tokens for r in rows.collect())
    counted = rows.select("doc_id", F.explode(tx.tally(F.col("want"))).alias("x")).select("doc_id", "x.v", "x.n")
    post = retrieval.postings(rows).select("doc_id", "term", "tf")
    assert sorted(map(tuple, post.collect())) == sorted(map(tuple, counted.collect())) and "lambda" not in plan_of(post) + plan_of(corpus.scored(docs))


def test_detector_reads_texts_once(spark):
    """Runs aren't counted by lambdas, sentences are lower-cased once, adjacent passives all count."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    assert "xxhash64" not in plan_of(features.profile(docs)) and "xxhash64" not in plan_of(features.features(docs))
    assert plan_of(detector.sentences(docs)).count("lower(") == 1 and plan_of(detector.detect(docs)).count("Join") == 1
    (f,) = features.features(spark.createDataFrame([(1, "It is inged is heed by them.", "en")], "doc_id long, text string, lang string")).collect()
    assert f.passive_ratio == 2


def test_detect(spark):
    ai = "Furthermore, it is important to note that this clearly plays a crucial role. " * 14
    docs = spark.createDataFrame([(1, ai, "en"), (2, "too few words", "en"), (3, "word " * 12, "en")], "doc_id long, text string, lang string")
    r = {x.doc_id: x for x in detector.detect(docs).collect()}
    assert r[2].verdict == "too_short" and r[2].ai_probability == 0
    assert (r[1].ai_probability, r[1].verdict) == (54.9, "mixed") and r[3].confidence <= 0.15
    s = {x.doc_id: x for x in detector.sentence_share(docs).collect()}
    assert s[1].ai_ratio > 0.9 and 3 not in s
    assert detector.simple(docs).count() == 3


def test_web(spark):
    page = "<script>x < y</script><STYLE>a</STYLE><style>b</style><p>one&amp;two</p>"
    assert one(spark, page, tx.page_text) == "a one&amp;two"
    got = spark.range(1).select(web.boosted(F.lit(50.0), F.lit(30.0)), web.boosted(F.lit(50.0), F.lit(100.0)), web.boosted(F.lit(95.0), F.lit(60.0))).first()
    assert tuple(got) == (50.0, 70.0, 100.0)


def test_history(spark):
    e = spark.createDataFrame([(i, 1, f"2024-01-01 00:00:{i:02d}") for i in range(21)], "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    p = history.page(e, F.lit(1), 2, 20).collect()
    assert [r.event_id for r in p] == [0] and p[0].pages == 2 and not p[0].has_next and p[0].has_prev
    assert history.page(e, F.lit(1), 1, 51).count() == 21 and history.page(e, F.lit(1), 1, 0).count() == 1
    a = spark.createDataFrame([("k", i, False) for i in (0, 1, 2, 3, 5000)] + [("j", 0, False), ("j", 1, True), ("j", 2, False)], "key string, s long, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.key: r.refused for r in history.lockouts(a, most=2).collect()} == {"k": 2, "j": 0}
    assert {r.key: r.hits for r in history.cache_hits(a, ttl=2).collect()} == {"k": 2, "j": 2}
    s = spark.createDataFrame([(1, 9), (1, 10), (1, 11)], "user_id long, s long").withColumn("expires_at", F.timestamp_seconds("s"))
    assert history.live_sessions(s, s.select("user_id").distinct(), F.timestamp_seconds(F.lit(10))).count() == 1


def test_generation(spark):
    docs = spark.createDataFrame([(i, "This is important and important. Big things help us.", "en") for i in range(200)], "doc_id long, text string, lang string")
    out = [r[0] for r in docs.select(generation.paraphrase(F.col("text"), F.col("lang"), F.col("doc_id"))).collect()]
    assert out == [r[0] for r in docs.select(generation.paraphrase(F.col("text"), F.col("lang"), F.col("doc_id"))).collect()]
    share = sum("significant and important" in x for x in out) / 200
    assert 0.45 < share < 0.75
    noisy = docs.select(generation.noisy(F.col("text"), F.col("lang"), F.col("doc_id")), generation.restructured(F.col("text"), F.col("doc_id")), generation.interleaved(F.col("text"), F.col("text"), F.col("doc_id")), generation.mixed(F.col("text"), F.lit("A one. A two."), 0.5, F.col("doc_id")))
    assert all(all(r) for r in noisy.collect())
    rows = generation.training_set(spark, 30)
    assert rows.count() == 30 + 30 + 15 + 10 + 10 and rows.where("burstiness < 0").count() == 0
    assert generation.profiles(spark).count() == 81


def test_ensemble_is_trained_whole(spark, monkeypatch):
    small, seen = generation.train, {}
    usual = {k: v.default for k, v in inspect.signature(small).parameters.items() if k in ("trees", "rounds")}

    def train(rows, seed=7, **given):
        seen.update(usual | given, rows=rows.count())
        return small(rows.sample(0.02, seed), seed, trees=2, rounds=1)

    monkeypatch.setattr(generation, "train", train)
    got = catalog.QUERIES["ensemble_train"](spark, SF).collect()
    # a class has 5,000 rows; half as many are humanized, a third of two classes noisy
    assert seen == {"trees": 200, "rounds": 150, "rows": 5000 * 2 + 2500 + 1666 * 2} and sum(r.n for r in got) == seen["rows"]


def test_files(spark, tmp_path):
    import json

    (tmp_path / "uz").mkdir()
    text = "so'z " * 25
    for i, d in enumerate([{"id": "a", "text": text}, {"id": "", "full_text": text}, {"id": "c", "text": "short"}]):
        (tmp_path / "uz" / f"f{i}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "uz" / "bad.json").write_text("{")
    got = {r.id: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "f1"} and got["a"].source == "uz" and got["a"].title == "f0"
    docs = spark.createDataFrame([("t", text, "en"), ("t", text, "en")], "title string, text string, lang string")
    new = files.save_documents(docs, str(tmp_path / "store"))
    assert new.count() == 1 and files.save_documents(docs, str(tmp_path / "store2"), new).count() == 0
    index = spark.createDataFrame([(1, ["aaa", "bbb"]), (2, ["bbb"])], "doc_id long, tokens array<string>")
    files.write_index(index, str(tmp_path / "index"))
    assert files.read_index(spark, str(tmp_path / "index"))[1].count() == 3
    assert files.read_index(spark, str(tmp_path / "none")) is None
    (tmp_path / "t.txt").write_text("hello")
    assert files.read_texts(spark, str(tmp_path / "t.txt")).first().text == "hello"
    (tmp_path / "feed.xml").write_text("<feed><entry><title>T</title><summary>a  b</summary><link href='u' title='pdf'/></entry></feed>")
    r = files.read_atom(spark, str(tmp_path / "feed.xml")).first()
    assert (r.title, r.url, r.text) == ("T", "u", "T. a b")
    papers = spark.createDataFrame([('{"data":[{"title":"A","abstract":"x <b>y</b>"},{"title":"B"}]}',)], "raw string")
    assert [r.text for r in files.read_papers(papers).collect()] == ["A. x y"]


def test_streams(spark, tmp_path):
    # times after the epoch: a row at the first watermark, which is 0, counts as late
    rows = spark.createDataFrame([("k", 1000 + i * 10, False, 1) for i in range(8)], "key string, s long, ok boolean, user_id long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "in"))

    def run(make):
        name = "q" + uuid.uuid4().hex
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sum(r.refused for r in run(lambda s: state.lockouts(s, most=3))) == 5
    assert sum(r.hit for r in run(lambda s: state.cache(s, ttl=25))) == 5
    # a window closes when a later time is seen: the last one stays open
    got = run(lambda s: state.rate_limits(s, 1, "20 seconds", late="0 seconds"))
    assert [(r.start.timestamp(), r.n, r.limited) for r in sorted(got, key=lambda r: r.start)] == [(1000, 2, True), (1020, 2, True), (1040, 2, True)]
    got = run(lambda s: state.sessions(s, "5 seconds", late="0 seconds"))
    assert [(r.start.timestamp(), r.n) for r in sorted(got, key=lambda r: r.start)] == [(1000 + i * 10, 1) for i in range(7)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"ensemble_train"}))
def test_queries_have_schemas(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns
