"""Text functions as column expressions: splitting, tokens, cleaning, hashes, language."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from provena.functions import arrays
from provena.functions import lexicons as lex

#: White space of any script, and letters, digits and the underscore of any.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A column that a lambda refers to may be
    put in its place by the optimizer and then be computed for each element."""
    return F.transform(F.array(value), body)[0]


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, whatever is built on them: a generator
    of one row stands between, which the optimizer doesn't look through."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """What stands between white space."""
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE[1:-1]}]+"), F.lit(0))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{SPACE[1:-1]}]+"))


def sentences(c: Column, least: int, ends: str = ".!?") -> Column:
    """Sentences of ``least`` words or more; they end at one of ``ends`` before white space."""
    parts = F.transform(F.split(strip(c), f"(?<=[{ends}]){SPACE}+"), strip)
    return F.filter(parts, lambda s: n_words(s) >= least)


def feature_sentences(c: Column) -> Column:
    return sentences(c, 3, ".!?…")


def split_sentences(c: Column, least: int = 3, ends: str = ".!?…") -> Column:
    """``sentences`` without lambdas, to be pinned."""
    return arrays.sentences(c, F.lit(least), F.lit(ends))


def feature_words(c: Column) -> Column:
    """Lower-case words of two characters or more, apostrophes included."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_']{2,}"), F.lit(0))


def index_tokens(c: Column) -> Column:
    """Tokens of the ranked index: Latin or Cyrillic, three characters or more, no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-zA-Z\x{400}-\x{4FF}']{3,}"), F.lit(0)), lambda t: ~t.isin(lex.INDEX_STOPS))


def by_lang(lang: Column, table: dict[str, Column]) -> Column:
    """What ``table`` has for the language, English's for those it lacks."""
    out = table["en"]
    for k, v in table.items():
        if k != "en":
            out = F.when(lang == k, v).otherwise(out)
    return out


def match_tokens(c: Column, lang: Column) -> Column:
    """Tokens for matching: words stripped to the language's letters, three or more, no stops."""

    def one(k: str, other: str) -> Column:
        bare = F.transform(words(c), lambda w: F.regexp_replace(F.lower(w), other, ""))
        return F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(lex.STOP_WORDS[k]))

    return by_lang(lang, {"en": one("en", "[^a-zA-Z]"), "uz": one("uz", "[^a-zA-Z']"), "ru": one("ru", r"[^\x{400}-\x{4FF}]")})


def normal_form(c: Column, lang: Column, lemmas: Column | None = None) -> Column:
    """Words stemmed (uz) or lower-cased, joined by spaces.

    ``lemmas`` may map a lower-case word to its base form; without it words stay. What
    has foreign characters is dropped; if under 40 % or five words are left, the words
    of letters are taken as they are.
    """
    w = words(c)
    base = lambda x: F.coalesce(F.element_at(lemmas, F.lower(x)), F.lower(x)) if lemmas is not None else F.lower(x)
    plain = lambda x: x.rlike(r"^\p{L}+$")

    def stem(x: Column) -> Column:
        low = F.lower(x)
        out = low
        for s in reversed(lex.UZ_SUFFIXES):
            out = F.when(low.endswith(s) & (F.length(low) - len(s) >= 3), F.substring(low, F.lit(1), F.length(low) - len(s))).otherwise(out)
        return out

    kept = by_lang(lang, {
        "en": F.transform(F.filter(w, plain), base),
        "uz": F.transform(F.filter(w, lambda x: plain(x) | x.contains("'")), stem),
        "ru": F.transform(F.filter(w, lambda x: x.rlike(r"[\x{400}-\x{4FF}]")), base),
    })
    least = F.greatest(F.lit(5), F.size(w) * 0.4)
    return F.array_join(let(kept, lambda k: F.when(F.size(k) < least, F.transform(F.filter(w, plain), F.lower)).otherwise(k)), " ")


@F.pandas_udf(StringType())
def compose(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def plain_letters(c: Column) -> Column:
    """Look-alikes become Latin, invisible characters go, the rest is composed."""
    mapped = F.translate(c, lex.HOMOGLYPHS[0] + lex.INVISIBLE, lex.HOMOGLYPHS[1])
    return F.regexp_replace(compose(mapped), r"[\x{200b}-\x{200f}\x{feff}]", "")


def clean(c: Column) -> Column:
    """The text up to its bibliography, quotations and statistics replaced by marks.

    The first line that contains a marker, and all after it, is cut. If under 40 % of
    the words are left, ends are not stripped.
    """
    lines = F.split(c, r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    marked = F.transform(lines, lambda x: F.lower(x).rlike("|".join(lex.BIBLIOGRAPHY)))
    first = F.coalesce(F.array_position(marked, True), F.lit(0))
    cut = F.array_join(F.when(first > 0, F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(lines), "\n")
    out = cut
    for pattern, mark in ((r'"[^"]{10,300}"', "[Q]"), ("«[^»]{10,300}»", "[Q]"), (rf"(?i)p{SPACE}*[<>=]{SPACE}*0\.\p{{Nd}}+", "[STD]"), (rf"(?i)n{SPACE}*={SPACE}*\p{{Nd}}+", "[STD]")):
        out = F.regexp_replace(out, pattern, mark)
    return F.when(n_words(out) >= n_words(cut) * 0.4, strip(out)).otherwise(out)


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def language(c: Column) -> Column:
    """uz, ru or en by the share of Cyrillic, apostrophes and known words in 800 characters."""
    s = F.substring(c, 1, 800)
    alpha = F.greatest(_count(s, r"\p{L}"), F.lit(1))
    cyr, lat = _count(s, r"[\x{400}-\x{4FF}]"), _count(s, "[a-zA-Z]")
    marks = _count(s, r"[oOgG]'") + _count(s, r"[\x{02bb}\x{2019}]")
    known = F.size(F.array_intersect(F.split(F.regexp_replace(F.lower(s), "[^a-zA-Z']", " "), " +"), strings(lex.UZ_WORDS)))
    guess = F.when(lat > cyr, "en").when(cyr > 0, "ru").otherwise("uz")
    rules = F.when(F.coalesce(c, F.lit("")) == "", "en").when(cyr / alpha > 0.30, "ru").when(marks >= 2, "uz").when(known >= 2, "uz")
    return rules.when((lat / alpha > 0.55) & (marks == 0) & (known == 0), "en").otherwise(guess)


def hidden_characters(c: Column) -> Column:
    """A struct: homoglyphs, invisible, manipulation_score (0 to 100), is_manipulated.

    A Cyrillic look-alike is suspicious in a Latin text, and in a mixed one if Latin
    prevails within five characters; invisible and control characters are always.
    """
    alpha = F.greatest(_count(c, r"\p{L}"), F.lit(1))
    cyr, lat = _count(c, r"[\x{400}-\x{4FF}]") / alpha, _count(c, "[a-zA-Z]") / alpha
    look = f"[{lex.HOMOGLYPHS[0]}]"
    near = lambda t, i: F.array_join(F.slice(t, F.greatest(i - 4, F.lit(1)), F.least(i + 6, F.lit(11))), "")
    voted = let(F.split(c, ""), lambda t: F.size(F.filter(F.transform(t, lambda x, i: x.rlike(look) & (_count(near(t, i), "[a-zA-Z]") > _count(near(t, i), r"[\x{400}-\x{4FF}]"))), lambda b: b)))
    seen = _count(c, look)
    sus = F.when(seen == 0, 0).when(lat > 0.60, seen).when(cyr > 0.60, 0).otherwise(voted)
    inv = _count(c, r"[\p{Cf}\p{Cc}&&[^ \n\t\r]]")
    score = F.least((sus + inv * 3) * 5, F.lit(100))
    return F.struct(sus.alias("homoglyphs"), inv.alias("invisible"), score.alias("manipulation_score"), (score >= 15).alias("is_manipulated"))


def fingerprint(c: Column) -> Column:
    """md5 of the first 200 words, lower-cased, stripped to letters."""
    first = F.slice(words(F.lower(c)), 1, 200)
    return F.md5(F.array_join(F.transform(first, lambda w: F.regexp_replace(w, r"[^a-zA-Z\x{400}-\x{4FF}]", "")), " "))


def sentence_hash(c: Column) -> Column:
    low = F.regexp_replace(F.lower(c), r"[^a-zA-Z\x{400}-\x{4FF}']", " ")
    return F.substring(F.md5(strip(F.regexp_replace(low, " +", " "))), 1, 16)


def gram_hash(c: Column) -> Column:
    """md5 as a number, modulo 1e9, by Horner's rule over its four 32-bit parts."""
    h = F.md5(c)
    part = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    base = (1 << 32) % 10**9
    out = part(1) % 10**9
    for i in (9, 17, 25):
        out = (out * base + part(i)) % 10**9
    return out


def ngrams(tokens: Column, n: int | Column) -> Column:
    """Runs of n tokens joined by spaces; none if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n

    def runs(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def tally(values: Column) -> Column:
    """``(v, n)`` of each distinct value of an array and how often it stands there, by value.

    The array, which holds no null, is sorted and cut where the value changes, so a text's own
    counts need no shuffle. (``array_sort`` would call a lambda for each comparison.)
    """

    def cut(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return let(starts, lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(n + 1)), lambda x, y: F.struct(F.get(s, x - 1).alias("v"), (y - x).alias("n"))))

    def some(s: Column) -> Column:
        return F.when(F.size(s) > 0, cut(s)).otherwise(F.slice(F.transform(s, lambda x: F.struct(x.alias("v"), F.lit(1).alias("n"))), 1, 0))

    return let(F.sort_array(values), some)


def gram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the runs of n values; none if there are fewer. A run of one is the value."""
    if n == 1:
        return tokens
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    runs = F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(n)]))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def winnow(hashes: Column, window: int) -> Column:
    """The distinct least hashes of all windows; of fewer hashes all of them."""

    def mins(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - window + 1, F.lit(1))), lambda i: F.array_min(F.slice(h, i, window)))
        return F.array_distinct(F.when(F.size(h) < window, h).otherwise(each))

    return let(hashes, mins)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def page_text(html: Column) -> Column:
    """Scripts, styles and tags dropped, white space collapsed; entities stay."""
    c = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?s)<style[^>]*>.*?</style>", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), f"{SPACE}+", " "))


def contained(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains."""
    out = F.lit(0)
    for p in phrases:
        out = out + text.contains(p).cast("int")
    return out


def rounded(c: Column, digits: int = 4) -> Column:
    """Half up, by a formula that other engines share."""
    return F.floor(c * 10**digits + 0.5) / 10**digits
