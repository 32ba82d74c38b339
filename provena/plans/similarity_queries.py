"""Queries on texts and their likeness. Submissions are ``benchmark``, the corpus is ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import lexicons as lex
from provena.functions import text as tx
from provena.operators import similarity as sim
from provena.plans import sql
from provena.plans.registry import Registry, table
from provena.tables import cut, spent

r = Registry()
R = sql.rounded


def _subs(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("sub_id"), F.lit("en").alias("lang"), "text")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "text")


MARKS = "len(regexp_extract_all(s, '[oOgG]'''))+len(regexp_extract_all(s, '[\\x{02bb}\\x{2019}]'))"


@r.query(f"""with a as (select doc_id, text, substr(text, 1, 800) as s from documents),
b as (select doc_id, text, greatest({sql.count('s', '\\p{L}')}, 1) as alpha, {sql.count('s', '[\\x{400}-\\x{4FF}]')} as cyr, {sql.count('s', '[a-zA-Z]')} as lat, {MARKS} as marks,
  len(list_intersect(string_split_regex(regexp_replace(lower(s), '[^a-zA-Z'']', ' ', 'g'), ' +'), {sql.strings(lex.UZ_WORDS)})) as known from a)
select doc_id, case when coalesce(text, '') = '' then 'en' when cyr / alpha > 0.30 then 'ru' when marks >= 2 then 'uz' when known >= 2 then 'uz'
  when lat / alpha > 0.55 and marks = 0 and known = 0 then 'en' when lat > cyr then 'en' when cyr > 0 then 'ru' else 'uz' end as detected from b""")
def lang_detect(spark, d):
    return _docs(spark, d).select("doc_id", tx.language(F.col("text")).alias("detected"))


@r.query(f"""with a as (select doc_id, {sql.count('text', '[\\x{400}-\\x{4FF}]')} as cyr,
  len(list_filter(string_split(text, ''), lambda x: (unicode(x) < 32 or unicode(x) = 173 or unicode(x) between 127 and 159 or unicode(x) between 8203 and 8207 or unicode(x) = 65279) and x not in (chr(9), chr(10), chr(13)))) as inv from documents)
select doc_id, 0 as homoglyphs, inv::int as invisible, least(inv * 15, 100)::int as manipulation_score, inv * 15 >= 15 as is_manipulated from a where cyr = 0""")
def unicode_scan(spark, d):
    # the tables hold no Cyrillic; what look-alikes do is tested on fixtures
    return _docs(spark, d).select("doc_id", tx.hidden_characters(F.col("text")).alias("x")).select("doc_id", "x.*")


@r.query()
def unicode_normalize(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.plain_letters(F.col("text")).cast("binary")).alias("digest"))


BIB = "|".join(lex.BIBLIOGRAPHY)


@r.query(f"""with l as (select doc_id, string_split(text, chr(10)) as lines from documents),
c as (select doc_id, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(lower(x), '{BIB}')), true), 0) as cutoff, lines from l),
t as (select doc_id, array_to_string(case when cutoff > 0 then list_slice(lines, 1, cutoff - 1) else lines end, chr(10)) as cut from c),
q as (select doc_id, cut, regexp_replace(regexp_replace(regexp_replace(regexp_replace(cut, '"[^"]{{10,300}}"', '[Q]', 'g'), '«[^»]{{10,300}}»', '[Q]', 'g'), '(?i)p\\s*[<>=]\\s*0\\.\\d+', '[STD]', 'g'), '(?i)n\\s*=\\s*\\d+', '[STD]', 'g') as o from t)
select doc_id, md5(case when len({sql.words('o')}) >= len({sql.words('cut')}) * 0.4 then {sql.strip('o')} else o end) as digest, len({sql.words('o')})::bigint as n_words from q""")
def clean_text(spark, d):
    rows = _docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("c"))
    return rows.select("doc_id", F.md5(F.col("c").cast("binary")).alias("digest"), tx.n_words(F.col("c")).cast("long").alias("n_words"))


@r.query(f"""with n as (select doc_id, {sql.words('text')} as w, {sql.normal_form('text')} as norm from documents),
t as (select doc_id, norm, {sql.match_tokens('norm')} as tokens from n)
select doc_id, md5(norm) as digest, len(tokens)::bigint as n_tokens, md5(array_to_string(tokens, ' ')) as tokens_digest from t""")
def normalize_tokens(spark, d):
    rows = _docs(spark, d).select("doc_id", "lang", tx.normal_form(F.col("text"), F.col("lang")).alias("norm")).withColumn("t", tx.match_tokens(F.col("norm"), F.col("lang")))
    return rows.select("doc_id", F.md5("norm").alias("digest"), F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_digest"))


def _prints_sql(source: str, id_sql: str, id_col: str, name: str, shortest: str = "") -> str:
    f = ", ".join(f"{sql.winnow(f'h{n}', w)} as f{n}" for n, w in sim.SIZES.items())
    h = ", ".join(f"list_transform(g{n}, lambda g: {sql.gram_hash('g')}) as h{n}" for n in sim.SIZES)
    g = ", ".join(f"{sql.ngrams('tokens', n)} as g{n}" for n in sim.SIZES)
    norm = sql.normal_form('text')
    if shortest:
        source, norm = f"(select * from {source} where len({sql.words('text')}) >= 20)", f"case when len({sql.words(norm)}) < 4 then lower(text) else {norm} end"
    return f"""{name}n as materialized (select {id_sql} as {id_col}, {norm} as norm from {source}),
{name}t as materialized (select {id_col}, norm, {sql.match_tokens('norm')} as tokens from {name}n),
{name}g as materialized (select {id_col}, norm, len(tokens) as n_tokens, {g} from {name}t),
{name}h as materialized (select {id_col}, norm, n_tokens, {h} from {name}g),
{name} as materialized (select {id_col}, norm, n_tokens, {f} from {name}h)"""


PA, PB = _prints_sql("benchmark", "item_id", "sub_id", "pa"), _prints_sql("documents", "doc_id", "doc_id", "pb")
SOURCES = _prints_sql("documents", "doc_id", "doc_id", "pb", "sources")


@r.query(f"""with t as (select doc_id, {sql.match_tokens(sql.normal_form('text'))} as tokens from documents),
g as (select doc_id, unnest({sql.ngrams('tokens', 5)}) as g from t)
select doc_id, count(*) as n, min({sql.gram_hash('g')}) as low, sum({sql.gram_hash('g')})::bigint as total from g group by doc_id""")
def ngram_hash(spark, d):
    t = _docs(spark, d).select("doc_id", tx.match_tokens(tx.normal_form(F.col("text"), F.col("lang")), F.col("lang")).alias("t"))
    g = t.select("doc_id", F.explode(tx.ngrams(F.col("t"), 5)).alias("g")).select("doc_id", tx.gram_hash(F.col("g")).alias("h"))
    return g.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.sum("h").alias("total"))


@r.query(f"with {PB} select doc_id, n_tokens::bigint as n_tokens, len(f3)::bigint as n3, len(f5)::bigint as n5, len(f7)::bigint as n7, coalesce(list_sum(f5), 0)::bigint as sum5 from pb")
def winnow_fingerprints(spark, d):
    p = sim.prints(_docs(spark, d), "doc_id")
    return p.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), *[F.size(f"f{n}").cast("long").alias(f"n{n}") for n in (3, 5, 7)], F.aggregate("f5", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum5"))


def _tall(p: str, i: str) -> str:
    return " union all ".join(f"select {i}, {n} as n, unnest(f{n}) as h from {p}" for n in sim.SIZES)


W = {3: "case when l < 20 then 0.40 when l < 60 then 0.20 else 0.15 end", 5: "case when l < 20 then 0.60 when l < 60 then 0.45 else 0.40 end", 7: "case when l < 20 then 0.0 when l < 60 then 0.35 else 0.45 end"}
WS = {n: f"(case when l >= {n} then {w} else 0.0 end)::double" for n, w in W.items()}
PAIRS = f"""{PA}, {SOURCES}, ta as ({_tall('pa', 'sub_id')}), tb as ({_tall('pb', 'doc_id')}),
m as (select sub_id, doc_id, count(*) filter (n = 3) as s3, count(*) filter (n = 5) as s5, count(*) filter (n = 7) as s7 from ta join tb using (n, h) group by all),
x as (select m.*, least(pa.n_tokens, pb.n_tokens) as l, len(pa.f3) as a3, len(pa.f5) as a5, len(pa.f7) as a7, len(pb.f3) as b3, len(pb.f5) as b5, len(pb.f7) as b7 from m join pa using (sub_id) join pb using (doc_id)),
y as (select *, {' + '.join(f'{w} * (case when a{n} + b{n} - s{n} > 0 then s{n} / (a{n} + b{n} - s{n}) else 0 end)' for n, w in WS.items())} as total, {' + '.join(WS.values())} as used from x),
wp as (select sub_id, doc_id, s3 + s5 + s7 as n_shared, case when l >= 3 and used > 0 then {R('total / used * 100')} else 0.0 end as winnow from y)"""


@r.query(f"with {PAIRS} select * from wp")
def winnow_pair_score(spark, d):
    a, b = sim.stored_prints(_subs(spark, d), _docs(spark, d))
    pairs = cut(sim.winnow_pairs(a, b).drop("lang"))
    spent(a, b)
    return pairs


def _grams(p: str, i: str, name: str) -> str:
    g = " union all ".join(f"select {i}, unnest({sql.ngrams('w', n)}) as g from {name}w" for n in (1, 2, 3))
    return f"{name}w as (select {i}, regexp_extract_all(lower(norm), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from {p} where {i} in (select {i} from wp)), {name} as (select {i}, g, 1 + ln(count(*)) as t from ({g}) group by all)"


ONCE = repr((0.4054651081081644 + 1) ** 2) + "::double"
TFIDF = f"""{PAIRS}, {_grams('pa', 'sub_id', 'ga')}, {_grams('pb', 'doc_id', 'gb')},
na as (select sub_id, sum(t * t) as na from ga group by sub_id), nb as (select doc_id, sum(t * t) as nb from gb group by doc_id),
sh as (select wp.sub_id, wp.doc_id, sum(ga.t * gb.t) as ab, sum(ga.t * ga.t) as aa, sum(gb.t * gb.t) as bb from wp join ga using (sub_id) join gb on gb.doc_id = wp.doc_id and gb.g = ga.g group by all),
tf as (select wp.*, coalesce({R(f'ab / (sqrt((na - aa) * {ONCE} + aa) * sqrt((nb - bb) * {ONCE} + bb)) * 100')}, 0) as tfidf from wp left join sh using (sub_id, doc_id) left join na using (sub_id) left join nb using (doc_id))"""


@r.query(f"with {TFIDF} select sub_id, doc_id, {R('tfidf', 2)} as tfidf from tf")
def tfidf_pair_cosine(spark, d):
    a, b = sim.stored_prints(_subs(spark, d), _docs(spark, d))
    pairs = cut(sim.winnow_pairs(a, b))
    scores = cut(sim.tfidf_pairs(pairs, a, b).select("sub_id", "doc_id", tx.rounded(F.col("tfidf"), 2).alias("tfidf")))
    spent(a, b, pairs)
    return scores


MATCHES = f"""{TFIDF}, sc as (select *, {R('(winnow * 0.60 + tfidf * 0.40) * 0.70 + greatest(winnow, tfidf) * 0.30', 2)} as score from tf),
s1 as (select * replace ({R('score', 1)} as score) from sc where score >= 12),
top as (select sub_id, doc_id, score, rank from (select *, row_number() over (partition by sub_id order by score desc, doc_id) as rank from s1) where rank <= 10)"""


@r.query(f"with {MATCHES} select sub_id, doc_id, score, rank::bigint as rank from top")
def plagiarism_matches(spark, d):
    return sim.matches(_subs(spark, d), _docs(spark, d)).select("sub_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _sents(source: str, i: str, as_: str, name: str) -> str:
    s = sql.sentences("text", 4)
    return f"{name}0 as (select {i} as {as_}, {s} as s from {source}), {name} as (select {as_}, pos, s as sentence, {sql.sentence_hash('s')} as hash from (select {as_}, unnest(s) as s, unnest(range(len(s))) as pos from {name}0))"


SA, SB = _sents("benchmark", "item_id", "sub_id", "sa"), _sents("documents", "doc_id", "doc_id", "sb")


@r.query(f"with {SA}, {SB}, f as (select hash, min({{'d': doc_id, 'p': pos}}) as x from sb group by hash) select sub_id, pos::int as pos, hash, x.d as doc_id, x.p::int as src_pos from sa join f using (hash)")
def sentence_exact_match(spark, d):
    return sim.exact_sentences(_subs(spark, d), _docs(spark, d))


def _sgrams(name: str, i: str) -> str:
    return f"{name}t as (select {i}, pos, {sql.match_tokens('sentence')} as tk from {name}), {name}g as (select {i}, pos, list_distinct({sql.ngrams('tk', 'least(5, len(tk) - 1)')}) as gs from {name}t where len(tk) >= 4), {name}u as (select {i}, pos, len(gs) as n, unnest(gs) as g from {name}g)"


SIMILAR = f"""{SA}, {SB}, {_sgrams('sa', 'sub_id')}, {_sgrams('sb', 'doc_id')},
pr as (select sub_id, sau.pos, doc_id, sbu.pos as src_pos, count(*) as c, any_value(sau.n) as na, any_value(sbu.n) as nb from sau join sbu using (g) group by all)"""


@r.query(f"""with {SIMILAR}, z as (select *, {R('c / (na + nb - c) * 100')} as best from pr)
select sub_id, pos::int as pos, best, doc_id, src_pos::int as src_pos from (select *, row_number() over (partition by sub_id, pos order by best desc, doc_id, src_pos) as k from z) where k = 1""")
def sentence_best_similar(spark, d):
    return sim.similar_sentences(_subs(spark, d), _docs(spark, d))


@r.query(f"""with {SIMILAR}, z as (select *, {R('c / (na + nb - c) * 100')} as best from pr),
m as (select sub_id, pos, best, doc_id as md from (select *, row_number() over (partition by sub_id, pos order by best desc, doc_id, src_pos) as k from z) where k = 1),
e as (select hash, min(doc_id) as ed from sb group by hash),
h as (select sa.sub_id, sa.pos, case when ed is not null then 100.0 else coalesce(best, 0) end as score, case when ed is not null then 'exact' when best >= 65 then 'similar' when best > 0 then 'low' end as match_type, coalesce(ed, md) as doc_id
  from sa left join e using (hash) left join m on m.sub_id = sa.sub_id and m.pos = sa.pos)
select sub_id, pos::int as pos, {R('score', 1)} as match_score, score >= 65 as is_plagiarism, match_type, coalesce(doc_id, -1) as doc_id,
  case when score < 65 then null when match_type = 'exact' then 'exact' when score >= 75 then 'similar' else 'low' end as render_class from h""")
def sentence_highlights(spark, d):
    rows = sim.highlights(_subs(spark, d), _docs(spark, d)).drop("sentence")
    return rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))


AGG = f"""{MATCHES}, {SIMILAR},
ex as (select distinct sa.sub_id, sa.pos from sa join sb using (hash) join top on top.sub_id = sa.sub_id and top.doc_id = sb.doc_id),
nr as (select distinct pr.sub_id, pr.pos from pr join top on top.sub_id = pr.sub_id and top.doc_id = pr.doc_id where c * 100 >= 65 * (na + nb - c)),
hit as (select sub_id, count(*) as matched from (select * from ex union select * from nr) group by sub_id),
ag as (select n.sub_id, n.total, coalesce(matched, 0) as matched from (select sub_id, count(*) as total from sa group by sub_id) n left join hit using (sub_id))"""


@r.query(f"with {AGG} select sub_id, total as total_sents, matched as matched_sents, {R('matched / total * 100', 1)} as aggregate from ag")
def doc_aggregate(spark, d):
    return sim.aggregate(_subs(spark, d), _docs(spark, d))


THRESHOLD = "22 + case when len(regexp_extract_all(text, '[^\\s]+')) < 100 then 5 when len(regexp_extract_all(text, '[^\\s]+')) > 800 then -3 else 0 end"
OVERALL = f"""{AGG}, o as (select item_id as sub_id, coalesce(lex_max, 0) as m, coalesce({R('matched / total * 100', 1)}, 0) as a, ({THRESHOLD})::int as threshold
  from benchmark left join (select sub_id, max(score) as lex_max from top group by sub_id) x on x.sub_id = item_id left join ag on ag.sub_id = item_id),
ov as (select sub_id, m as lex_max, a as aggregate, case when a > 0 and m > 0 then {R('0.65 * a + 0.35 * m', 1)} else greatest(a, m) end as overall, threshold from o)"""


@r.query(f"with {OVERALL} select sub_id, lex_max, aggregate, overall, threshold, overall >= threshold as is_plagiarism from ov")
def plagiarism_overall(spark, d):
    return sim.overall(_subs(spark, d), _docs(spark, d)).drop("lexical")


@r.query(f"""with {OVERALL} select sub_id, case when overall < 20 then 'minimal' when overall < 40 then 'low' when overall < 60 then 'high' else 'critical' end as level,
  case when overall > 60 then 'critical' when overall >= threshold then 'high' when overall > 20 then 'medium' else 'low' end as risk from ov""")
def risk_levels(spark, d):
    no = F.lit(False)
    _, level, risk = sim.risks(F.col("overall"), F.lit(0.0), no, no, no, F.col("is_plagiarism"))
    return sim.overall(_subs(spark, d), _docs(spark, d)).select("sub_id", level.alias("level"), risk.alias("risk"))


VECTORS = """v as (select vec_id, label, case vec_id % 5 when 0 then 'ru' else 'en' end as lang, embedding::double[] as e from embeddings),
u as (select *, sqrt(list_dot_product(e, e)) as n from v),
p as (select a.vec_id as sub_id, b.label as doc_id, b.vec_id as src, a.lang as sl, b.lang as dl, floor(list_dot_product(a.e, b.e) / (a.n * b.n) * 1000000 + 0.5) / 1000000 as c from u a join u b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
t as (select * from (select *, row_number() over (partition by sub_id, doc_id order by c desc, src) as k from p) where k = 1),
m as (select *, case when c < 0.8 then 0 when sl <> dl then 3 when c >= 0.88 then 2 else 1 end as kind from t)"""


def _best(spark, d):
    # a vector whose id is divisible by 100 stands for a submission of one sentence, a label for a
    # document and its vectors for that one's sentences; every fifth vector counts as Russian
    from provena.operators import retrieval

    v = table(spark, d, "embeddings").select("vec_id", "label", F.when(F.expr("vec_id % 5 = 0"), "ru").otherwise("en").alias("lang"), retrieval.unit("embedding").alias("w"))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("sub_id"), F.lit(0).alias("pos"), F.col("w").alias("v"), F.col("lang").alias("sub_lang"), F.col("vec_id").alias("but"))
    return sim.best_of(asked, v.select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("src_pos"), "w", F.col("lang").alias("src_lang")))


@r.query(f"""with {VECTORS} select sub_id, doc_id::bigint as doc_id, 1::bigint as n, 1::bigint as matched, 100.0::double as overlap, c as best, (['similar', 'paraphrase', 'translation'])[kind] as kind from m where kind > 0""")
def semantic_pair_match(spark, d):
    return sim.semantic_matches(None, _best(spark, d))


@r.query(f"""with {VECTORS}, h as (select sub_id, doc_id, src, {R('c * 100', 1)} as score, kind from m where kind > 0)
select sub_id, doc_id::bigint as doc_id, src as src_pos, score, (['similar', 'paraphrase', 'translation'])[kind] as type, rank from (select *, row_number() over (partition by sub_id order by score desc, doc_id)::bigint as rank from h) where rank <= 10""")
def semantic_matches_top(spark, d):
    return sim.semantic_top(None, best=_best(spark, d)).select("sub_id", "doc_id", "src_pos", "score", "type", F.col("rank").cast("long").alias("rank"))


@r.query(f"""with {VECTORS} select sub_id, doc_id::bigint as doc_id, src as src_pos, {R('c')} as cosine, kind from m""")
def semantic_best_source(spark, d):
    t = _best(spark, d)
    return t.select("sub_id", "doc_id", (-F.col("t.p")).alias("src_pos"), tx.rounded(F.col("t.cos")).alias("cosine"), F.col("k").alias("kind"))
