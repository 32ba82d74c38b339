"""The whole analysis and what stands around it: requests, reports, accounts, labels, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import lexicons as lex
from provena.functions import text as tx
from provena.operators import accounts, analyze, corpus, detector, generation, web
from provena.operators import similarity as sim
from provena.plans import corpus_queries as cq
from provena.plans import feature_queries as fq
from provena.plans import other_queries as oq
from provena.plans import similarity_queries as sq
from provena.plans import sql
from provena.plans.registry import Registry, table

r = Registry()
R = sql.rounded


def _subs(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("sub_id"), "text")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "text")


# The submissions of the tables are plain English that cleaning leaves as it is.
_CANDIDATES = cq.BM25.replace("where rank <= 25", f"where rank <= {analyze.CANDIDATES}") + ", cand as (select query_id as sub_id, doc_id from bm)"
_COPIED = sq.OVERALL.replace("from ta join tb using (n, h) group by all", "from ta join tb using (n, h) join cand using (sub_id, doc_id) group by all")
_JUDGED = fq._detected("none").replace("from documents", "from (select item_id as doc_id, 'en' as lang, text from benchmark)")
_ANALYSIS = f"""{_CANDIDATES}, {_COPIED},
an as (select ov.*, coalesce(ag.total, 0) as total_sents, coalesce(ag.matched, 0) as matched_sents, coalesce(tp.n, 0) as n_matches, tp.best_doc from ov left join ag using (sub_id)
  left join (select sub_id, count(*) as n, min_by(doc_id, rank) as best_doc from top group by sub_id) tp using (sub_id))"""
_RISKS = "(overall >= threshold)::int + (ai_probability > 55)::int"


@r.query(f"""{_ANALYSIS} select sub_id, 'en' as language, overall, aggregate, threshold, overall >= threshold as is_plagiarism, n_matches, coalesce(best_doc, -1) as best_doc, matched_sents, total_sents, 0 as manipulation_score,
  case when overall < 20 then 'minimal' when overall < 40 then 'low' when overall < 60 then 'high' else 'critical' end as level from an""")
def analyze_copying(spark, d):
    a = analyze.analyze(_subs(spark, d), _docs(spark, d))
    a = a.withColumn("best_doc", F.coalesce("best_doc", F.lit(-1).cast("long")))
    return a.select("sub_id", "language", "overall", "aggregate", "threshold", "is_plagiarism", "n_matches", "best_doc", "matched_sents", "total_sents", "manipulation_score", "level")


@r.query(f"with {_JUDGED} select doc_id as sub_id, ai_probability, verdict as ai_verdict from det")
def analyze_authorship(spark, d):
    return analyze.analyze(_subs(spark, d), _docs(spark, d)).select("sub_id", "ai_probability", "ai_verdict")


@r.query(f"""select doc_id, case when text is null or len({sql.strip('text')}) < 20 then 'too short' when len(text) > 200000 then 'too long' when len({sql.words('text')}) < 5 then 'too few words' end as error from documents""")
def request_guards(spark, d):
    return _docs(spark, d).select("doc_id", analyze.refusal(F.col("text")).alias("error"))


@r.query("select doc_id, substr(sha256(text), 1, 20) as cache_key, md5(substr(text, 1, 150) || '…') as preview, md5(case when len(text) > 500 then substr(text, 1, 500) || '…' else text end) as sample from documents")
def result_keys(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", analyze.cache_key(c).alias("cache_key"), F.md5(F.concat(F.substring(c, 1, 150), F.lit("…"))).alias("preview"), F.md5(analyze.shortened(c, 500)).alias("sample"))


@r.query()
def analysis_report(spark, d):
    subs, docs = _subs(spark, d), _docs(spark, d)
    rows = analyze.prepared(subs).where("error is null").select("sub_id", "lang", "text")
    only = analyze.candidates(rows, docs)
    top = sim.matches(rows, docs, 10, only)
    shown = sim.highlights(rows, docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi"))
    return analyze.report(analyze.analyze(subs, docs, only), top, shown, subs)


@r.query()
def check_log(spark, d):
    subs = _subs(spark, d).withColumns({"user_id": F.when(F.col("sub_id") % 4 > 0, F.col("sub_id") % 4), "filename": F.lit(None).cast("string")})
    return analyze.check_rows(analyze.analyze(subs.select("sub_id", "text"), _docs(spark, d)), subs, F.lit("2024-01-20 00:00:00").cast("timestamp"))


@r.query(f"""with {sq.SIMILAR}, z as (select *, {R('c / (na + nb - c) * 100')} as best from pr),
mm as (select sub_id, pos, best from (select *, row_number() over (partition by sub_id, pos order by best desc, doc_id, src_pos) as k from z) where k = 1),
ee as (select distinct hash from sb), hl as (select sa.sub_id, case when ee.hash is not null then 100.0 else coalesce(best, 0) end as score from sa left join ee using (hash) left join mm on mm.sub_id = sa.sub_id and mm.pos = sa.pos)
select sub_id, count(*) filter (score >= 65) as copied, count(*) as total from hl group by sub_id""")
def highlight_summary(spark, d):
    return web.highlight_html(sim.highlights(_subs(spark, d).withColumn("lang", F.lit("en")), _docs(spark, d))).select("sub_id", "copied", "total")


# Accounts: customers stand for users


_MAIL = "lower(replace(c_name, '#', case c_custkey % 7 when 0 then ' ' else '@' end)) || case c_custkey % 5 when 0 then '' else '.uz' end"
_PASS = "repeat('x', (c_custkey % 9)::int)"


@r.query(f"""with q as (select c_custkey, {_MAIL} as email, {_PASS} as pass, case c_custkey % 11 when 0 then 'a' else c_name end as name from customer)
select c_custkey, case when len(name) < 2 then 'name' when len(pass) < 6 then 'password' when not regexp_matches(trim(email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') then 'email' end as error from q""")
def registration_checks(spark, d):
    c = table(spark, d, "customer")
    rows = c.selectExpr("c_custkey", "lower(replace(c_name, '#', case c_custkey % 7 when 0 then ' ' else '@' end)) || case c_custkey % 5 when 0 then '' else '.uz' end as email", "repeat('x', cast(c_custkey % 9 as int)) as pass", "case c_custkey % 11 when 0 then 'a' else c_name end as name")
    return rows.select("c_custkey", accounts.registration_error(F.col("name"), F.col("email"), F.col("pass")).alias("error"))


@r.query("select event_id, user_id from events where ts + interval 2 day > timestamp '2024-01-15 00:00:00' and event_type <> 'click'")
def valid_tokens(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", (F.col("ts") + F.expr("interval 2 days")).alias("expires_at"), (F.col("event_type") == "click").alias("used"))
    return accounts.valid_tokens(t, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "user_id")


@r.query("""with m as (select user_id, max(case when event_type = 'signup' then ts end) as seen from events group by user_id)
select c_custkey as user_id, seen is not null as email_verified, epoch_us(seen) as verified_us from customer left join m on user_id = c_custkey""")
def email_status(spark, d):
    meta = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("verified_at"))
    meta = meta.withColumn("email_verified", F.col("verified_at").isNotNull())
    s = accounts.email_status(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), meta)
    return s.select("user_id", "email_verified", F.unix_micros(F.col("verified_at").cast("timestamp")).alias("verified_us"))


@r.query("""with m as (select user_id, count(*) as n, max(ts) as seen from events where event_type = 'view' group by user_id)
select c_custkey, c_name, coalesce(n, 0)::bigint as checks_used, coalesce(epoch_us(seen), 0)::bigint as last_login from customer left join m on user_id = c_custkey""")
def account_updates(spark, d):
    users = table(spark, d, "customer").select("c_custkey", "c_name", F.lit(0).cast("long").alias("checks_used"), F.lit(0).cast("long").alias("last_login"))
    seen = table(spark, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("checks_used"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_login"))
    return accounts.updated(users, seen, "c_custkey")


# Languages, labels, sentences


@r.query(f"""with a as (select doc_id, substr(text, 1, 500) as s from documents)
select doc_id, case when {sql.count('s', '[\\x{400}-\\x{4FF}]')} / greatest({sql.count('s', '\\p{L}')}, 1) > 0.30 then 'ru' when {sql.count('s', "[oOgG]''")} >= 2 then 'uz'
  when len(list_intersect(string_split_regex(regexp_replace(lower(s), '[^a-zA-Z'']', ' ', 'g'), ' +'), {sql.strings(lex.DETECTOR_UZ_WORDS)})) >= 2 then 'uz' else 'en' end as guessed from a""")
def detector_language(spark, d):
    return _docs(spark, d).select("doc_id", detector.guessed_language(F.col("text")).alias("guessed"))


_LABELS = " ".join(f"when '{k}' then '{v}'" for k, v in lex.VERDICTS["en"].items())


@r.query(f"with {fq._detected('none')} select doc_id, case verdict {_LABELS} end as label from det")
def verdict_labels(spark, d):
    return detector.detect(_docs(spark, d)).select("doc_id", detector.verdict_label(F.col("verdict"), F.col("lang")).alias("label"))


_SENTS = f"""cs as materialized (select doc_id, {sql.sentences('text', 3, '.!?…')} as ss from documents where len({sql.words('text')}) >= 30),
cx as (select doc_id, unnest(ss) as s, unnest(range(len(ss)))::int as pos, unnest(list_transform(range(1, (len(ss) + 1)::bigint), lambda i: array_to_string(list_slice(ss, greatest(i - 1, 1), i + 1), ' '))) as context from cs)"""


@r.query(f"with {_SENTS} select doc_id, count(*) as n, md5(string_agg(context, '|' order by pos)) as contexts from cx group by doc_id")
def sentence_contexts(spark, d):
    x = detector.sentence_contexts(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "context"))).alias("x"))
    return x.select("doc_id", "n", F.md5(F.array_join(F.transform("x", lambda x: x["context"]), "|")).alias("contexts"))


_N = f"len({sql.words('s')})"


@r.query(f"""with {_SENTS}, cy as (select doc_id, pos, case when {_N} < 5 then 0.0 else least(len(context) / 400, 1.0) * 0.50 + least(1.0, {fq.H} / greatest(1.0, {_N} / 15)) * 0.25 + (case when {_N} >= 10 then 0.8::double else 0.5::double end) * 0.25 end as sc, {_N} as n from cx)
select doc_id, pos, {R('sc', 3)} as ai_score, case when n < 5 then 'human' when sc >= 0.65 then 'ai' when sc >= 0.40 then 'mixed' else 'human' end as label from cy where pos < 20""")
def ai_sentences_with_models(spark, d):
    # a length stands for the trained classifier's score, a number for the transformer's
    trained = F.least(F.length("context") / 400, F.lit(1.0))
    return detector.sentences(_docs(spark, d), trained, F.lit(0.8), most=20)


# Web matches and stores


_HITS = f"""{oq.KEYS}, hh as (select k.doc_id, k.rank as sr, x.place, 'u' || (k.doc_id % 50) || '/' || x.place as url from keys k, (values (1), (2), (3)) x(place) where k.doc_id % 3 = 0)"""


@r.query(f"with {_HITS} select doc_id, url, rank from (select doc_id, url, row_number() over (partition by doc_id order by sr, place, url)::bigint as rank from hh) where rank <= 10")
def web_matches(spark, d):
    # three made-up hits for each key sentence of every third document stand for a search's
    k = web.key_sentences(_docs(spark, d)).where("doc_id % 3 = 0")
    h = k.select("doc_id", "rank", "sentence", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("place"))
    h = h.withColumn("url", F.concat(F.lit("u"), F.expr("doc_id % 50"), F.lit("/"), "place")).withColumn("title", F.lit(None).cast("string"))
    return web.web_matches(h).select("doc_id", "url", F.col("rank").cast("long").alias("rank"))


@r.query(f"select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as k from documents where len({sql.words('text')}) >= 30) where k <= 100")
def human_texts(spark, d):
    return corpus.human_texts(_docs(spark, d), 100).select("doc_id", "lang")


@r.query(f"""with q as (select doc_id, lang, source, substr(md5(substr(lower({sql.strip('text')}), 1, 300)), 1, 12) as id from documents where len({sql.words('text')}) >= 20)
select min(doc_id) as doc_id, coalesce(lang, '?') as lang, coalesce(source, '?') as source, id from q group by all""")
def sample_store(spark, d):
    docs = table(spark, d, "documents").na.fill("?", ["lang", "source"])
    got = corpus.new_documents(docs, docs.limit(0).withColumn("id", F.lit("")), head=300, lower=True, scope=("lang", "source"), trim=True)
    return got.select("doc_id", "lang", "source", "id")


# Rewritten and mixed texts


@r.query()
def text_variants(spark, d):
    return generation.variants(_docs(spark, d))


@r.query()
def mixtures(spark, d):
    docs = _docs(spark, d)
    return generation.mixtures(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))
