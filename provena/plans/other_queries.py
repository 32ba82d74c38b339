"""Queries on pages, histories, limits, and generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.operators import generation, history, web
from provena.plans import sql
from provena.plans.registry import Registry, table

r = Registry()
R = sql.rounded


@r.query(f"select page_id, md5({sql.page_text('html')}) as digest, len({sql.words(sql.page_text('html'))})::bigint as n_words from pages")
def html_to_text(spark, d):
    p = web.page_texts(table(spark, d, "pages"))
    return p.select("page_id", F.md5("text").alias("digest"), tx.n_words(F.col("text")).cast("long").alias("n_words"))


@r.query(f"""with p as (select page_id, {sql.page_text('html')} as t from pages), w as (select page_id, doc_id, t, list_distinct({sql.words('lower(t)')}) as a, list_distinct({sql.words('lower(text)')}) as b from p join documents on page_id = doc_id)
select page_id, doc_id, case when len(t) < 50 or len(a) = 0 or len(b) = 0 then 0 else {R('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 100', 1)} end as similarity, case when len(t) < 50 then 'too short' end as error from w""")
def page_jaccard(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html", F.col("page_id").alias("pair"))
    return web.page_likeness(pages, table(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("pair")))


STOPS = sql.strings("the a an is are was were in on at va bu bilan da и в на с".split())
KEYS = f"""k0 as (select doc_id, unnest(s) as sentence, unnest(range(len(s))) as pos from (select doc_id, list_filter({sql.sentences('text', 8)}, lambda s: len({sql.words('s')}) <= 30) as s from documents)),
k1 as (select *, len(list_filter({sql.words('lower(sentence)')}, lambda w: not list_contains({STOPS}, w))) as score from k0),
keys as (select doc_id, sentence, score, row_number() over (partition by doc_id order by score desc, pos) as rank from k1 qualify rank <= 5)"""


@r.query(f"with {KEYS} select doc_id, sentence, score::bigint as score, rank::bigint as rank from keys")
def key_sentences(spark, d):
    k = web.key_sentences(table(spark, d, "documents"))
    return k.select("doc_id", "sentence", "score", F.col("rank").cast("long").alias("rank"))


@r.query(f"""with {KEYS}, h as (select distinct sentence from keys where doc_id % 3 = 0),
g as (select doc_id, count(distinct keys.sentence) as n, count(distinct h.sentence) as m from keys left join h on h.sentence = keys.sentence group by doc_id), w as (select *, {R('m / n * 100', 1)} as ws from g)
select doc_id, n as n_sentences, m as matched, ws as web_score, case when ws > 30 then {R('least(100, 40 + least(20, 0.3 * ws))', 1)} else 40.0 end as overall from w""")
def web_boost(spark, d):
    # what every third document asks for stands for the hits of a search
    k = web.key_sentences(table(spark, d, "documents"))
    s = web.web_scores(k, k.where("doc_id % 3 = 0").select("sentence"))
    return s.withColumn("overall", web.boosted(F.lit(40.0), F.col("web_score")))


NOW = "2024-01-20 00:00:00"


@r.query(f"select event_id, user_id, c_name, ts + interval 3 day as expires_at from events join customer on user_id = c_custkey where ts + interval 3 day > timestamp '{NOW}'")
def session_user_join(spark, d):
    s = table(spark, d, "events").select("event_id", "user_id", (F.col("ts") + F.expr("interval 3 days")).alias("expires_at"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return history.live_sessions(s, users, F.lit(NOW).cast("timestamp")).select("event_id", "user_id", "c_name", "expires_at")


@r.query("""with u as (select user_id from events group by user_id order by count(*) desc, user_id limit 1), o as (select * from events where user_id = (select user_id from u)), t as (select count(*) as total from o)
select event_id, user_id, total, ceil(total / 20)::bigint as pages, 1 < ceil(total / 20) as has_next, false as has_prev from (select * from o order by ts desc, event_id desc limit 20), t""")
def history_page(spark, d):
    e = table(spark, d, "events")
    top = e.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    return history.page(e, F.lit(top), 1, 20).select("event_id", "user_id", "total", "pages", "has_next", "has_prev")


@r.query(f"select (select count(*) from events) as checks, {R('(select avg(value) from events)')} as avg_value, (select count(*) from customer) as users")
def stats_counts(spark, d):
    s = history.stats(table(spark, d, "events"), table(spark, d, "customer"))
    return s.select("checks", tx.rounded(F.col("avg_value")).alias("avg_value"), "users")


@r.query("select event_id, used, used <= 3 as allowed, greatest(3 - used, 0) as left from (select event_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as used from events)".replace("as left", 'as "left"'))
def usage_quota(spark, d):
    return history.usage(table(spark, d, "events")).select("event_id", "used", "allowed", "left")


@r.query("select time_bucket(interval 1 hour, ts) as start, user_id, count(*) as n, count(*) > 1 as limited from events group by 1, 2")
def rate_limit_window(spark, d):
    return history.rate_limits(table(spark, d, "events"), 1, "1 hour")


@r.query("""with recursive e as (select event_type || ':' || (user_id % 10)::varchar as key, ts, row_number() over (partition by event_type || ':' || (user_id % 10)::varchar order by ts) as k from events),
w as (select key, k, ts as set_at, 0 as hit from e where k = 1 union all
  select e.key, e.k, case when e.ts - w.set_at <= interval 3600 second then w.set_at else e.ts end, (e.ts - w.set_at <= interval 3600 second)::int from w join e on e.key = w.key and e.k = w.k + 1)
select key, count(*) as requests, sum(hit)::bigint as hits from w group by key""")
def cache_hit_rate(spark, d):
    e = table(spark, d, "events").select(F.concat_ws(":", "event_type", F.expr("user_id % 10")).alias("key"), "ts")
    return history.cache_hits(e)


@r.query("""with recursive e as (select user_id as key, ts, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_type <> 'error') as k from events),
w as (select key, k, case when ok then 0 else 1 end as fails, ts as since, 0 as refused from e where k = 1 union all
  select key, k, case when f >= 2 then f when ok then 0 else f + 1 end, case when f = 0 then ts else since end, refused + (f >= 2)::int from (
    select e.key, e.k, e.ok, e.ts, w.since, w.refused, case when w.fails > 0 and e.ts - w.since > interval 86400 second then 0 else w.fails end as f from w join e on e.key = w.key and e.k = w.k + 1))
select key, count(*) as attempts, max(refused)::bigint as refused from w group by key""")
def lockout_sessions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", (F.col("event_type") != "error").alias("ok"))
    return history.lockouts(e, 2, 86_400)


@r.query(f"select event_id from events where not (ts + interval 1 day < timestamp '{NOW}' and event_type = 'click')")
def token_purge(spark, d):
    t = table(spark, d, "events").select("event_id", (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"), (F.col("event_type") == "click").alias("used"))
    return history.purged(t, F.lit(NOW).cast("timestamp"), "verifications").select("event_id")


@r.query()
def synthetic_profiles(spark, d):
    rows = generation.training_set(spark, 3000)
    return rows.groupBy("profile", "label").agg(F.count("*").alias("n"), tx.rounded(F.avg("burstiness"), 2).alias("burstiness"))


@r.query()
def paraphrase(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", generation.paraphrase(F.col("text"), F.col("lang"), F.col("doc_id")).alias("text"))


@r.query()
def mixed_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("ai"))
    return docs.join(other, "doc_id").select("doc_id", generation.mixed(F.col("text"), F.col("ai"), 0.5, F.col("doc_id")).alias("text"))


@r.query()
def ensemble_train(spark, d):
    rows = generation.training_set(spark, 5000).coalesce(6)
    model = generation.train(rows)
    voted = generation.vote(model, rows)
    return voted.groupBy("profile").agg(F.count("*").alias("n"), F.count_if((F.col("ai_probability") >= 0.5) == (F.col("label") == 1)).alias("right"))
