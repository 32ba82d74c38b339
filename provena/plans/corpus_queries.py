"""Queries on corpora and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.operators import corpus, retrieval
from provena.plans import sql
from provena.plans.registry import Registry, table

r = Registry()
S = f"with {sql.SCORED}"


@r.query(f"{S} select doc_id, n_words::bigint as n_words from scored where n_words >= 20")
def corpus_min_words(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.n_words(F.col("text")).cast("long").alias("n_words")).where("n_words >= 20")


@r.query(f"{S} select doc_id, quality, {sql.GRADE} as grade from scored")
def corpus_quality_score(spark, d):
    return corpus.scored(table(spark, d, "documents")).select("doc_id", "quality", corpus.grade(F.col("quality")).alias("grade"))


@r.query(f"{S} select min(doc_id) as doc_id, fingerprint, count(*) as copies from scored group by fingerprint")
def corpus_dedup_fingerprint(spark, d):
    rows = corpus.scored(table(spark, d, "documents"))
    return rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


AUDIT = "count(*) as total, (sum(n_words) // count(*))::bigint as avg_words, " + ", ".join(f"count(*) filter ({sql.GRADE} = '{g}') as {g}" for g in ("excellent", "good", "poor", "rejected")) + ", count(*) - count(distinct fingerprint) as duplicates"


@r.query(f"{S} select lang, {AUDIT} from scored group by lang")
def audit_by_lang(spark, d):
    return corpus.audit(table(spark, d, "documents"), "lang")


@r.query(f"{S} select source, {AUDIT} from scored group by source")
def audit_sources(spark, d):
    return corpus.audit(table(spark, d, "documents"), "source")


@r.query(f"{S} select {sql.GRADE} as grade, count(*) as n from scored group by 1")
def audit_quality_hist(spark, d):
    rows = corpus.scored(table(spark, d, "documents"))
    return rows.groupBy(corpus.grade(F.col("quality")).alias("grade")).agg(F.count("*").alias("n"))


@r.query(f"{S} select {AUDIT} from scored")
def audit_avg_words_dups(spark, d):
    return corpus.audit(table(spark, d, "documents"))


@r.query(f"""{S} select case when grouping(lang) = 1 then '*' else coalesce(lang, '?') end as lang,
  case when grouping(source) = 1 then '*' else coalesce(source, '?') end as source, count(*) as total,
  count(*) filter (quality > 0) as usable, sum(n_words)::bigint as words from scored group by rollup(lang, source)""")
def audit_rollup(spark, d):
    return corpus.audit_rollup(table(spark, d, "documents"))


@r.query(f"""{S}, a as (select {AUDIT}, count(*) filter (lang = 'uz') as n_uz, count(*) filter (lang = 'ru') as n_ru,
  count(*) filter (lang = 'en') as n_en from scored)
select total, duplicates, rejected, array_to_string(list_filter([case when n_uz = 0 then 'uz is missing' end,
  case when n_ru = 0 then 'ru is missing' end, case when n_en = 0 then 'en is missing' end,
  case when total < 1000 then 'too few documents' end, case when n_uz < 200 then 'too few uz documents' end,
  case when rejected > total * 0.3 then 'over 30 % rejected' end, case when duplicates > 0 then 'duplicates' end],
  lambda x: x is not null), '; ') as issues from a""")
def audit_issues(spark, d):
    return corpus.audit_issues(table(spark, d, "documents"))


@r.query(f"{S}, {sql.ADMITTED} select doc_id, quality, len(tokens)::bigint as n_tokens from admitted")
def index_admission(spark, d):
    return corpus.admitted(table(spark, d, "documents")).select("doc_id", "quality", F.size("tokens").cast("long").alias("n_tokens"))


POSTINGS = f"{S}, {sql.ADMITTED}, post as (select doc_id, unnest(tokens) as term from admitted), tfs as (select doc_id, term, count(*) as tf from post group by all)"
TERMS = f"""{POSTINGS}, raw as (select term, count(*) as df, ln((select count(*) from admitted) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tfs group by term),
terms as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw)"""


@r.query(f"{TERMS} select term, df, {sql.rounded('idf', 6)} as idf from terms")
def bm25_term_stats(spark, d):
    docs = corpus.admitted(table(spark, d, "documents"))
    terms = retrieval.term_stats(retrieval.postings(docs), docs.agg(F.count("*").alias("n")))
    return terms.select("term", "df", tx.rounded(F.col("idf"), 6).alias("idf"))


@r.query(f"{POSTINGS} select doc_id, count(*) as terms, sum(tf)::bigint as dl, max(tf) as max_tf from tfs group by doc_id")
def bm25_doc_stats(spark, d):
    post = retrieval.postings(corpus.admitted(table(spark, d, "documents")))
    return post.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("dl"), F.max("tf").alias("max_tf"))


BM25 = f"""{TERMS}, q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({sql.index_tokens('text')}) as term from benchmark) group by all),
hits as (select query_id, tfs.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / (select avg(len(tokens)) from admitted)))) as raw
  from q join terms using (term) join tfs using (term) join admitted on tfs.doc_id = admitted.doc_id group by all),
bm as (select * from (select query_id, doc_id, {sql.rounded('raw', 6)} as score, row_number() over (partition by query_id order by {sql.rounded('raw', 6)} desc, doc_id) as rank from hits where raw > 0.01) where rank <= 25)"""


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, d):
    return retrieval.bm25(corpus.admitted(table(spark, d, "documents")), _asked(spark, d), 25)


@r.query(f"{BM25} select query_id, doc_id, {sql.rounded('score', 4)} as score, rank::bigint as rank from bm")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("query_id", "doc_id", tx.rounded(F.col("score"), 4).alias("score"), F.col("rank").cast("long").alias("rank"))


COS = """u as (select vec_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
k as (select a.vec_id as query_id, b.vec_id, floor(list_dot_product(a.v, b.v) / (a.n * b.n) * 1000000 + 0.5) / 1000000 as cosine
  from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)"""
#: Queries of a vector search are the rows whose id is divisible by 100, against all rows.
DENSE = f"{COS}, dense as (select * from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from k where cosine > {{above}}) where rank <= 20)"


def _nearest(spark, d, above):
    v = table(spark, d, "embeddings")
    return retrieval.nearest(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 20, above)


@r.query(f"with {DENSE.format(above=0.2)} select query_id, vec_id, {sql.rounded('cosine', 4)} as cosine, rank::bigint as rank from dense")
def vector_topk_cosine(spark, d):
    return _nearest(spark, d, 0.2).select("query_id", "vec_id", tx.rounded(F.col("cosine"), 4).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@r.query(f"""{BM25}, {DENSE.format(above=0.2)}, both_ as (
  select query_id, doc_id, 1.0::double / (60 + rank) as part from bm union all
  select (query_id // 100) as query_id, vec_id, 1.5::double / (60 + rank) from dense),
fused as (select query_id, doc_id, {sql.rounded('sum(part)', 6)} as score from both_ group by all)
select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::bigint as rank from fused) where rank <= 20""")
def rrf_fusion(spark, d):
    # items and vectors are paired by number, as the tables hold no vectors of items
    dense = _nearest(spark, d, 0.2).select(F.expr("query_id div 100").alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    return retrieval.fuse(_bm25(spark, d), dense, 20).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@r.query()
def vector_cells_topk(spark, d):
    v = table(spark, d, "embeddings")
    model, indexed = retrieval.cells(v)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.probe_cells(model, indexed, q, above=0.2)


@r.query("""with s as (select doc_id, text, lang, source, n_chars, substr(md5(substr(text, 1, 200)), 1, 12) as id from documents
  where len(regexp_extract_all(text, '[^\\s]+')) >= 20 and source <> 'src0'),
t as (select substr(md5(substr(text, 1, 200)), 1, 12) as id from documents where source = 'src0')
select min(doc_id) as doc_id, id from s where id not in (select id from t where id is not null) group by id""")
def dedup_against_store(spark, d):
    docs = table(spark, d, "documents")
    stored = docs.where("source = 'src0'").select(F.substring(F.md5(F.substring("text", 1, 200)), 1, 12).alias("id"))
    return corpus.new_documents(docs.where("source != 'src0'"), stored).select("doc_id", "id")


CATEGORY = "case when quality = 1 and toxic = 0 then 'human' when quality = 1 then 'mixed' else 'ai' end"
TRAINING = f"""t as (select doc_id, lang, {CATEGORY} as category, case {CATEGORY} when 'human' then 0.0 when 'mixed' then 0.5 else 1.0 end::double as label,
  len(regexp_extract_all(text, '[^\\s]+')) as word_count from documents join labels using (doc_id))"""


def _training(spark, d):
    cat = F.when(F.expr("quality = 1 and toxic = 0"), "human").when(F.col("quality") == 1, "mixed").otherwise("ai")
    return corpus.training_rows(table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", cat.alias("category")))


@r.query(f"with {TRAINING} select doc_id, lang, category, label, case label when 0 then 'human' when 0.5 then 'mixed' else 'ai' end as label_str, word_count::bigint as word_count from t")
def training_export(spark, d):
    return _training(spark, d).drop("text").withColumn("word_count", F.col("word_count").cast("long"))


@r.query(f"with {TRAINING} select lang, category, count(*) as n, sum(word_count)::bigint as words from t group by grouping sets ((lang, category), (lang), ())")
def label_balance(spark, d):
    t = _training(spark, d)
    return t.groupingSets([["lang", "category"], ["lang"], []], "lang", "category").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"))


@r.query(f"""select min((conv_id, turn)).conv_id as conv_id, min((conv_id, turn)).turn as turn, fingerprint, count(*) as copies
from (select conv_id, turn, {sql.fingerprint("coalesce(text, '')")} as fingerprint from conversations) group by fingerprint""".replace("min((conv_id, turn))", "min({'conv_id': conv_id, 'turn': turn})"))
def conversation_dedup(spark, d):
    return corpus.turns_once(table(spark, d, "conversations"))


@r.query("""with n as (select c_custkey, c_name, c_acctbal + 1 as c_acctbal from customer where c_nationkey = 3
  union all select c_custkey + 10000000, c_name, c_acctbal from customer where c_nationkey = 4)
select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from n) union all select * from n""")
def upsert_merge(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal")
    new = c.where("c_nationkey = 3").selectExpr("c_custkey", "c_name", "c_acctbal + 1 as c_acctbal").union(c.where("c_nationkey = 4").selectExpr("c_custkey + 10000000", "c_name", "c_acctbal"))
    return corpus.upsert(c.drop("c_nationkey"), new, "c_custkey")
