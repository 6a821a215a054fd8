"""Text scalars. Unicode normal forms have no built-in: one Arrow UDF makes them, all else is native."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that show nothing; white space as the web's regular expressions have it.
INVISIBLE = "\u00AD\u200B\u200C\u200D\u200E\u200F\u2060\u2061\u2062\u2063\u2064\uFEFF"
SPACE = "[\\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Cyrillic and Greek letters that look like Latin ones, in pairs; symbols that stand for letters in a word.
LOOK_ALIKE = ("авсенкмортухѕіјԁԛԝαβεικνορτυχγς", "abcehkmoptyxsijdqwabeikvoptuxys")
LEET = ("0134578@$!|+(€£", "oieastbasiitcel")
SCRIPTS = "Latin Cyrillic Greek Arabic Hebrew Han Hiragana Katakana Hangul Thai Devanagari".split()

_LEET_RUN, _ANY_LEET, _ANY_LIKE = re.compile(r"[^a-z\s]+(?=[a-z])"), re.compile(f"[{re.escape(LEET[0])}]"), re.compile(f"[{LOOK_ALIKE[0]}]")
_LIKE, _LEETS = str.maketrans(*LOOK_ALIKE), str.maketrans(*LEET)


def _unleet(m: re.Match) -> str:
    at = m.start()
    return m[0].translate(_LEETS) if at and "a" <= m.string[at - 1] <= "z" else m[0]


def _odd(text: str) -> list[str]:
    """The different characters of a text but ASCII ones."""
    return [c for c in set(text) if c > "\x7f"]


def _match_form(text: str) -> str:
    """Decomposed, without invisible characters and marks, lower-cased, look-alikes and interior symbols folded."""
    if text.isascii():
        s = text.lower()
    else:
        s = unicodedata.normalize("NFKD", text)
        for c in _odd(s):
            if c in INVISIBLE or unicodedata.category(c) == "Mn":
                s = s.replace(c, "")
        s = s.lower()
        s = s.translate(_LIKE) if _ANY_LIKE.search(s) else s
    return _LEET_RUN.sub(_unleet, s) if _ANY_LEET.search(s) else s


def _marks(text: str) -> tuple[int, int]:
    if text.isascii():
        return 0, len(text)
    parts = unicodedata.normalize("NFD", text)
    marks = sum(parts.count(c) for c in _odd(parts) if unicodedata.category(c) == "Mn")
    return marks, len(parts) - marks


def _forms(text: str | None) -> tuple:
    if text is None:
        return None, None, 0, 0
    return unicodedata.normalize("NFKC", text), _match_form(text), *_marks(text)


_FORMS = T.StructType([T.StructField(n, k) for n, k in (("nfkc", T.StringType()), ("folded", T.StringType()), ("marks", T.IntegerType()), ("base", T.IntegerType()))])


@F.pandas_udf(_FORMS)
def unicode_forms(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(map(_forms, text), columns=["nfkc", "folded", "marks", "base"])


@F.udf(T.StructType(_FORMS.fields[1:]))
def match_forms(text):
    """unicode_forms without the compatibility form. Texts of any length come in small lots, so a worker holds few of them."""
    return (None, 0, 0) if text is None else (_match_form(text), *_marks(text))


NOT_ASCII = r"[^\x00-\x7F]"
#: Any character but ASCII, the letters of Latin-1, dashes and curly quotation marks: those are their own compatibility form and take
#: part in no composition without a combining mark, which is none of them.
NOT_STABLE = "[^\\x00-\\x7F\\u00C0-\\u00FF\\u2013\\u2014\\u2018\\u2019\\u201C\\u201D]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in text], dtype=object)


def sanitize_visible(text: Column) -> Column:
    """Compatibility form without invisible characters, white space to one space. Texts of characters that are their own form,
    whatever stands beside them, don't cross to Python."""
    return visible(F.coalesce(nfkc(F.when(~is_ascii(text) & text.rlike(NOT_STABLE), text)), text))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_arrays(texts: pd.Series) -> pd.Series:
    form = lambda t: None if t is None else unicodedata.normalize("NFKC", t)
    return pd.Series([None if ts is None else [form(t) for t in ts] for ts in texts], dtype=object)


def nfkc_all(texts: Column) -> Column:
    """The compatibility forms of an array of texts; only arrays with others than ASCII ones cross to Python."""
    odd = F.exists(texts, lambda t: t.rlike(NOT_ASCII))
    return F.coalesce(_nfkc_arrays(F.when(odd, texts)), texts)


#: White space whose presence asks for the pattern SPACE: doubled or other than a plain space.
_ODD_ASCII = ("  ", "\t", "\n", "\x0b", "\f", "\r")
_ODD_SPACE = (*_ODD_ASCII, "\u0085", "\u00a0", "\u1680", *(chr(c) for c in range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff")


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def visible(text: Column) -> Column:
    """Without invisible characters, white space to one space, trimmed. Plain searches go first: patterns are slow on long texts."""
    any_of = lambda t, found: reduce(Column.__or__, [F.contains(t, F.lit(x)) for x in found])
    strip = lambda t: reduce(lambda u, c: F.replace(u, F.lit(c), F.lit("")), INVISIBLE, t)
    odd = lambda t: F.when(is_ascii(t), any_of(t, _ODD_ASCII)).otherwise(any_of(t, _ODD_SPACE))
    plain = lambda t: F.trim(F.when(odd(t), F.regexp_replace(t, f"{SPACE}+", " ")).otherwise(t))
    return once(once(text, lambda t: F.when(is_ascii(t), t).otherwise(strip(t))), plain)


SEPARATORS = rf"{SPACE[:-1]}._\-*~`'\"^]+"


#: Separators but a plain space that stands alone, which stays as it is.
_TO_SPACE = rf"{SEPARATORS[:-1]}*".replace(r"\s", r"\t\n\x0B\f\r")[:-1] + f"{SEPARATORS[:-1]}*| {SEPARATORS}"


def finish_match(folded: Column) -> Column:
    """The native end of normalising: runs of three cut to two, separators to one space."""
    runs = F.regexp_replace(folded, r"(?s)(.)\1{2,}", "$1$1")
    return F.trim(F.regexp_replace(runs, _TO_SPACE, " "))


_RUNS, _SEPARATORS = re.compile(r"(?s)(.)\1{2,}"), re.compile(SEPARATORS.replace(r"\s", r" \t\n\x0b\f\r"))


def match_text(text: str, runs: bool = True) -> str:
    """normalize_for_match for those who are in Python anyway; runs: whether there may be runs of three."""
    folded = _match_form(text)
    return _SEPARATORS.sub(" ", _RUNS.sub(r"\1\1", folded) if runs else folded).strip(" ")


def normalize_for_match(text: Column) -> Column:
    return finish_match(match_forms(text)["folded"])


def fingerprint_of(normalized: Column) -> Column:
    bare = F.regexp_replace(F.replace(normalized, F.lit(" "), F.lit("")), r"[^\p{L}\p{N}]+", "")  # a plain search goes first
    return F.when(normalized.rlike(r"[\p{L}\p{N}]"), bare).otherwise(normalized)


def fingerprint(text: Column) -> Column:
    return fingerprint_of(normalize_for_match(text))


def collapse_letter_spacing(normalized: Column) -> Column:
    """The text without spaces if at least four tokens, most of them single characters; else null."""
    tokens = F.filter(F.split(normalized, " "), lambda t: t != "")
    single = lambda ts: F.size(F.filter(ts, lambda t: F.length(t) == 1))
    return once(tokens, lambda ts: F.when((F.size(ts) >= 4) & (single(ts) >= 0.6 * F.size(ts)), F.array_join(ts, "")))


MENTION = rf"(?:^|{SPACE}|\()@[A-Za-z0-9_.-]{{2,32}}"


def count_mentions(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_count(text, F.lit(MENTION))).otherwise(0)


#: Endings that make a bare host a link.
_ENDINGS = "com|net|org|io|gg|ru|cn|xyz|top|link|me|co|tv|info|biz|online|site"
URL = rf"(?i)(?<![A-Za-z0-9_])(?:https?://|www\.)[^\s<>\"']+|(?<![A-Za-z0-9_])[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.(?:{_ENDINGS})(?![A-Za-z0-9_])(?:/[^\s<>\"']*)?"


#: What each link has: it costs little to look for.
_LINK_SIGN = rf"(?i)\.(?:(?<=w\.)|(?:{_ENDINGS})(?![A-Za-z0-9_]))"


def extract_urls(text: Column) -> Column:
    found = F.when(F.contains(text, F.lit("://")) | text.rlike(_LINK_SIGN), F.regexp_extract_all(text, F.lit(URL), F.lit(0)))
    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda u: F.lower(u)))


def scripts_used(text: Column) -> Column:
    return F.filter(F.array(*(F.when(text.rlike(rf"\p{{Is{s}}}"), F.lit(s)) for s in SCRIPTS)), lambda s: s.isNotNull())


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text between spaces, in time linear in its length."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(...))"), F.lit(1)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two trigram arrays; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


_EDGE_L, _EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Identifiers in the order in which they are taken out.
IDENTIFIERS = (
    (r"(?<![A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9_.+-]*@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]{2,}(?<=[A-Za-z0-9_])", "[redacted-email]"),
    (rf"{_EDGE_L}\d[\d\s().-]{{7,}}\d{_EDGE_R}", "[redacted-phone]"),
    (rf"{_EDGE_L}(?:\d{{1,3}}\.){{3}}\d{{1,3}}{_EDGE_R}", "[redacted-ip]"),
    (r"(?<![A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9_-]{30,}[A-Za-z0-9_](?![A-Za-z0-9_])", "[redacted-token]"),
    (rf"{_EDGE_L}\d{{13,19}}{_EDGE_R}", "[redacted-number]"),
)


def redact_identifiers(text: Column) -> Column:
    for pattern, token in IDENTIFIERS:
        text = F.regexp_replace(text, pattern, token.replace("$", r"\$"))
    return text


def was_redacted(text: Column) -> Column:
    return redact_identifiers(text) != text


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(max(0, n - 1))), F.lit("…"))).otherwise(text)


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def version_label(version: Column) -> Column:
    return F.left(F.regexp_replace(version, r"[^A-Za-z0-9.+-]", ""), F.lit(32))


def char_anomalies(text: Column, forms: Column, normalized: Column, scripts: bool = True) -> Column:
    """Struct of counts and ratios that show hidden or disguised writing; forms: unicode_forms(text). Plain searches go before patterns."""
    plain = is_ascii(text)  # without invisible characters and other scripts
    # characters are counted as what is left without the others, so that no array of them is made
    left = lambda t, others: F.length(F.regexp_replace(t, others, ""))
    letters, caps = left(F.replace(text, F.lit(" "), F.lit("")), r"\P{L}+"), left(text, r"\P{Lu}+")
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1+"), F.lit(0))  # of two at least
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: F.length(w) >= 2)
    others = "[[^\\x00-\u036F]&&[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS if s != "Latin") + "]]"  # none of them has letters below
    mixed = F.filter(words, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(others))
    return F.struct(
        F.when(plain, 0).otherwise(F.regexp_count(text, F.lit(f"[{INVISIBLE}]"))).alias("invisible"),
        (~plain & text.rlike(f"[{INVISIBLE}]") & text.rlike("\\p{L}[\u00AD\u200B\u200C\u200D\u2060\uFEFF]+\\p{L}")).alias("invisible_in_word"),
        (forms["marks"] / F.greatest(forms["base"], F.lit(1))).alias("mark_ratio"),
        F.coalesce(caps / F.greatest(letters, F.lit(1)), F.lit(0.0)).alias("caps_ratio"),
        F.greatest(F.array_max(F.transform(runs, lambda r: F.length(r))), F.when(text != "", 1).otherwise(0)).alias("longest_run"),
        F.when(text != "", left(text, rf"[A-Za-z0-9 \p{{L}}\p{{N}}{SPACE[1:]}+") / utf16_length(text)).otherwise(0.0).alias("symbol_ratio"),
        F.when(~plain & text.rlike(others), F.size(mixed)).otherwise(0).alias("mixed_words"),
        *([scripts_used(text).alias("scripts")] if scripts else []),
        collapse_letter_spacing(normalized).isNotNull().alias("letter_spaced"),
    )


#: SQL functions of the same meaning as the Columns of this package, as Spark's own SQL functions; they stay native.
SQL_FUNCTIONS = {
    "half_up": "(x DOUBLE, places INT) RETURNS DOUBLE RETURN floor(x * pow(10, places) + 0.5) / pow(10, places)",
    "clamp": "(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE RETURN least(greatest(nanvl(x, low), low), high)",
    "saturate": "(n DOUBLE, threshold DOUBLE, whole DOUBLE) RETURNS DOUBLE RETURN CASE WHEN whole <= threshold THEN if(n <= threshold, 0D, 1D) ELSE least(greatest((n - threshold) / (whole - threshold), 0D), 1D) END",
    "decay": "(value DOUBLE, elapsed_ms DOUBLE, half_life_ms DOUBLE) RETURNS DOUBLE RETURN if(half_life_ms <= 0 OR elapsed_ms <= 0, value, value * pow(0.5, elapsed_ms / half_life_ms))",
    "utf16_length": "(t STRING) RETURNS INT RETURN CAST(length(encode(t, 'UTF-16BE')) / 2 AS INT)",
    "truncate_text": "(t STRING, n INT) RETURNS STRING RETURN if(length(t) > n, concat(left(t, greatest(0, n - 1)), '…'), t)",
    "similarity": "(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN if(size(a) = 0 OR size(b) = 0, 0D, size(array_intersect(a, b)) / size(array_union(a, b)))",
    "event_handle": "(user_id STRING) RETURNS STRING RETURN upper(left(sha2(concat('tidewatch:', user_id), 256), 6))",
    "incident_name": "(user_id STRING, room_id STRING, start_ms BIGINT) RETURNS STRING RETURN concat('INC-', date_format(timestamp_millis(start_ms), 'yyyyMMdd'), '-', left(sha2(concat_ws('|', user_id, room_id, start_ms), 256), 8))",
}


def _literal(text: str) -> str:
    """A SQL string of just these characters."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _text_functions() -> dict[str, str]:
    """SQL functions over texts, from the same patterns as the Columns. Those that end in _of take normalized texts, as
    unicode_forms(t).folded gives them to finish_match."""
    redacted, seen = "t", "filter(array({}), s -> s IS NOT NULL)"
    for pattern, token in IDENTIFIERS:
        redacted = f"regexp_replace({redacted}, {_literal(pattern)}, {_literal(token)})"
    scripts = ", ".join(f"if(t RLIKE {_literal(rf'\p{{Is{s}}}')}, '{s}', NULL)" for s in SCRIPTS)
    bare = f"regexp_replace(t, {_literal(r'[^\p{L}\p{N}]+')}, '')"
    tokens = "filter(split(t, ' '), x -> x <> '')"
    finished = f"regexp_replace(regexp_replace(t, {_literal(r'(?s)(.)\1{2,}')}, '$1$1'), {_literal(SEPARATORS)}, ' ')"
    return {
        "redact_identifiers": f"(t STRING) RETURNS STRING RETURN {redacted}",
        "finish_match": f"(t STRING) RETURNS STRING RETURN trim({finished})",
        "fingerprint_of": f"(t STRING) RETURNS STRING RETURN if({bare} <> '', {bare}, t)",
        "letters_joined_of": f"(t STRING) RETURNS STRING RETURN if(size({tokens}) >= 4 AND size(filter({tokens}, x -> length(x) = 1)) >= 0.6D * size({tokens}), array_join({tokens}, ''), NULL)",
        "count_mentions": f"(t STRING) RETURNS INT RETURN coalesce(regexp_count(t, {_literal(MENTION)}), 0)",
        "extract_urls": f"(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(transform(regexp_extract_all(coalesce(t, ''), {_literal(URL)}, 0), u -> lower(u)))",
        "scripts_used": f"(t STRING) RETURNS ARRAY<STRING> RETURN {seen.format(scripts)}",
        "trigrams": f"(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(regexp_extract_all(concat(' ', t, ' '), {_literal('(?s)(?=(...))')}, 1))",
        "version_label": f"(t STRING) RETURNS STRING RETURN left(regexp_replace(t, {_literal('[^A-Za-z0-9.+-]')}, ''), 32)",
        "is_ascii": "(t STRING) RETURNS BOOLEAN RETURN length(t) = octet_length(t)",
    }


#: SQL functions over arrays of numbers.
ARRAY_FUNCTIONS = {
    "noisy_or": "(c ARRAY<DOUBLE>) RETURNS DOUBLE RETURN floor((1 - aggregate(c, 1D, (a, x) -> a * (1 - least(greatest(nanvl(x, 0D), 0D), 1D)))) * 10000 + 0.5) / 10000",
    "array_mean": "(x ARRAY<DOUBLE>) RETURNS DOUBLE RETURN if(size(x) > 0, aggregate(x, 0D, (a, v) -> a + v) / size(x), 0D)",
    "array_cv": """(x ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(x, named_struct('n', 0D, 'mean', 0D, 'm2', 0D),
  (a, v) -> named_struct('n', a.n + 1, 'mean', a.mean + (v - a.mean) / (a.n + 1), 'm2', a.m2 + (v - a.mean) * (v - a.mean) * a.n / (a.n + 1)), a -> if(a.n < 2 OR a.mean = 0, 0D, sqrt(a.m2 / (a.n - 1)) / a.mean))""",
    "deltas": "(x ARRAY<BIGINT>) RETURNS ARRAY<BIGINT> RETURN if(size(x) > 1, zip_with(slice(x, 2, size(x) - 1), slice(x, 1, size(x) - 1), (b, a) -> b - a), CAST(array() AS ARRAY<BIGINT>))",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary functions for SQL: the Unicode forms and the ones above. Returns their names."""
    spark.udf.register("unicode_forms", unicode_forms)
    made = {**SQL_FUNCTIONS, **_text_functions(), **ARRAY_FUNCTIONS}
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return ["unicode_forms", *made]
