"""Pieces of DuckDB SQL that several checks use."""

from __future__ import annotations

from provena.functions import lexicons as lex


def rounded(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '[^\\s]+')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def sentences(c: str, least: int, ends: str = ".!?") -> str:
    parts = f"string_split(regexp_replace({strip(c)}, '([{ends}])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter({parts}, lambda s: len({words('s')}) >= {least})"


def feature_words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_'']{{2,}}')"


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def index_tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-zA-Z\\x{{400}}-\\x{{4FF}}'']{{3,}}'), lambda t: not list_contains({strings(lex.INDEX_STOPS)}, t))"


def match_tokens(c: str) -> str:
    """Of languages other than uz and ru."""
    return f"list_filter(list_transform({words(c)}, lambda w: regexp_replace(lower(w), '[^a-zA-Z]', '', 'g')), lambda w: len(w) > 2 and not list_contains({strings(lex.STOP_WORDS['en'])}, w))"


def normal_form(c: str) -> str:
    """Of languages other than uz and ru."""
    kept = f"list_transform(list_filter({words(c)}, lambda w: regexp_matches(w, '^\\p{{L}}+$')), lambda w: lower(w))"
    return f"array_to_string({kept}, ' ')"


def ngrams(t: str, n: str | int) -> str:
    return f"(case when len({t}) >= {n} then list_transform(range(1, (len({t}) - {n} + 2)::bigint), lambda i: array_to_string(list_slice({t}, i, i + {n} - 1), ' ')) else []::varchar[] end)"


def gram_hash(c: str) -> str:
    return f"(concat('0x', md5({c}))::uhugeint % 1000000000)::bigint"


def winnow(h: str, w: int) -> str:
    return f"list_distinct(case when len({h}) < {w} then {h} else list_transform(range(1, (len({h}) - {w} + 2)::bigint), lambda i: list_min(list_slice({h}, i, i + {w} - 1))) end)"


def fingerprint(c: str) -> str:
    return f"md5(array_to_string(list_transform(list_slice({words(f'lower({c})')}, 1, 200), lambda w: regexp_replace(w, '[^a-zA-Z\\x{{400}}-\\x{{4FF}}]', '', 'g')), ' '))"


def sentence_hash(c: str) -> str:
    return f"substr(md5(trim(regexp_replace(regexp_replace(lower({c}), '[^a-zA-Z\\x{{400}}-\\x{{4FF}}'']', ' ', 'g'), ' +', ' ', 'g'))), 1, 16)"


def page_text(c: str) -> str:
    return strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")


def contained(low: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({low}, '" + p.replace("'", "''") + "')::int" for p in phrases) + ")"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


SCORED = f"""scored as (
  select *, coalesce(len(w), 0) as n_words,
    case when text is null or len(w) < 20 or letters / len(text) < 0.4 or ttr < 0.2 or long < 2.5 or long > 18 then 0
      else {rounded("0.5 * least(len(w) / 300, 1.0) + 0.5 * least((ttr - 0.2) / 0.6, 1.0)", 3)} end as quality,
    {fingerprint("coalesce(text, '')")} as fingerprint
  from (select *, len(list_distinct(w)) / len(w) as ttr, list_sum(list_transform(w, lambda x: len(x))) / len(w) as long,
      {count("text", "\\p{L}")} as letters
    from (select *, {words("lower(text)")} as w from documents)))"""

GRADE = "case when quality > 0.7 then 'excellent' when quality > 0.3 then 'good' when quality > 0 then 'poor' else 'rejected' end"

ADMITTED = f"""admitted as (
  select doc_id, quality, {index_tokens("text")} as tokens from scored
  where quality > 0 and doc_id in (select min(doc_id) from scored where quality > 0 group by fingerprint)
    and len({index_tokens("text")}) >= 10)"""
