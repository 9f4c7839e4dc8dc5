"""Text functions as Column expressions, except where a Python function is named as such.

Missing input gives a missing result unless a function says otherwise.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English words of listings that carry no identity.
STOP_WORDS = (
    "about", "after", "again", "also", "and", "any", "are", "back", "been", "before", "between", "but", "can", "custom", "description", "details", "direct", "from", "free", "fresh", "get",
    "has", "have", "high", "into", "item", "its", "just", "like", "listing", "more", "most", "new", "not", "only", "order", "our", "out", "please", "product", "quality", "sale", "same",
    "ship", "shipping", "specified", "stealth", "test", "that", "the", "their", "this", "title", "too", "use", "very", "was", "with", "you", "your",
)
#: Ranges of Han characters: the basic block, with extension A, and with the supplementary planes.
HAN_BASIC, HAN_BMP, HAN_ALL = "\\u4e00-\\u9fff", "\\u3400-\\u9fff", "\\u3400-\\u9fff\\x{20000}-\\x{323AF}"
CONTACTS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9][0-9() .-]{6,}[0-9]",
    "telegram": r"(?i)(?:t\.me/|telegram[: ]+@?)[A-Za-z0-9_]{4,}",
    "wickr": r"(?i)wickr(?: me)?[: ]+[A-Za-z0-9_.-]{3,}",
    "qq": r"(?i)\bqq[: ]*[1-9][0-9]{4,11}",
    "wechat": r"(?i)(?:wechat|weixin|wx)[: ]+[A-Za-z0-9_-]{5,}",
}


def collapse_space(x: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def alias_key(x: Column) -> Column:
    """An alias without outer white space, in lower case; missing gives ""."""
    return F.lower(collapse_space(F.coalesce(x, F.lit(""))))


def soft_alias(x: Column) -> Column:
    """An alias without a trailing "(NN%)" and without anything but letters and digits."""
    return F.regexp_replace(F.regexp_replace(alias_key(x), r"\s*\([0-9]+(\.[0-9]+)?%\)\s*$", ""), r"(?U)[^\p{L}\p{N}]+", "")


def has_han(x: Column, ranges: str = HAN_BASIC) -> Column:
    return x.rlike(f"[{ranges}]")


def han_count(x: Column, ranges: str = HAN_BASIC) -> Column:
    return F.regexp_count(x, F.lit(f"[{ranges}]"))


def signature(x: Column) -> Column:
    """What near-equal texts have in common: Latin letters, digits and basic Han of Han texts, others as lower-case words joined by a blank."""
    lowered = F.lower(x)
    han = F.regexp_replace(lowered, f"[^0-9A-Za-z{HAN_BASIC}]+", "")
    words = F.array_join(F.regexp_extract_all(lowered, F.lit(r"([a-z0-9]+)")), " ")
    return F.when(has_han(x), han).otherwise(words)


def clipped(x: Column, most: int, *, strip: bool = True) -> Column:
    """At most ``most`` characters; a cut text ends with "..." in place of its last three."""
    head = F.substring(x, 1, most - 3)
    return F.when(F.length(x) > most, F.concat(F.rtrim(head) if strip else head, F.lit("..."))).otherwise(x)


def fingerprint(x: Column) -> Column:
    """A key fingerprint as upper-case hex digits; "" if there are none."""
    return F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "(?i)^0x|[^0-9A-Fa-f]", ""))


def short_fingerprint(x: Column) -> Column:
    """The last 16 digits after "0x"; "" if there are fewer."""
    full = fingerprint(x)
    return F.when(F.length(full) >= 16, F.concat(F.lit("0x"), F.right(full, F.lit(16)))).otherwise("")


def id_list(x: Column) -> Column:
    """All whole numbers of a text, each once, in the order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)")), lambda v: v.cast("bigint")))


def contact_key(kind: Column, value: Column, least_digits: int = 7) -> Column:
    """A contact in the form in which equal ones are equal; null if it is too short to be one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    handle = F.lower(F.regexp_replace(value, r"(?i)^.*(?:t\.me/|[: ]+)@?|^@", ""))
    return (
        F.when(kind == "email", F.lower(F.trim(value)))
        .when(kind == "phone", F.when(F.length(digits) >= least_digits, digits))
        .when(kind == "qq", F.when(F.length(digits).between(5, 12), digits))
        .otherwise(F.when(F.length(handle) >= 3, handle))
    )


def contacts(x: Column, kinds: dict[str, str] | None = None) -> Column:
    """All contacts of a text as an array of (kind, raw), key blocks blanked out first."""
    clean = F.regexp_replace(x, "(?s)-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----", " ")

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(clean, F.lit(f"({pattern})")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("raw")))

    return F.array_distinct(F.concat(*(named(k, p) for k, p in (kinds or CONTACTS).items())))


def url_key(x: Column, most_parts: int = 2, excluded: tuple[str, ...] = ()) -> Column:
    """Host without "www." and the first path parts, in lower case; null for excluded hosts and what is no URL."""
    rest = F.regexp_extract(F.lower(x), r"^[a-z][a-z0-9+.-]*://([^?#]+)", 1)
    host = F.regexp_replace(F.substring_index(rest, "/", 1), r"^www\.", "")
    parts = F.slice(F.filter(F.slice(F.split(rest, "/"), 2, 1000), lambda p: p != ""), 1, most_parts)
    return F.when((rest == "") | host.isin(*excluded) if excluded else rest == "", None).otherwise(F.concat_ws("/", F.array(host), parts))


def sentences(x: Column, long: int = 240) -> Column:
    """Sentences, cut at ends of lines and after . ! ? and their full-width forms; those over ``long`` also at commas."""
    cut = F.transform(F.split(x, "[\\n\\r]+|(?<=[.!?。！？])\\s*"), lambda s: collapse_space(s))
    clauses = F.flatten(F.transform(cut, lambda s: F.when(F.length(s) > long, F.transform(F.split(s, "[,;，；]+"), lambda p: collapse_space(p))).otherwise(F.array(s))))
    return F.filter(clauses, lambda s: s != "")


def words(x: Column) -> Column:
    """Lower-case Latin words of a letter and 2 to 23 letters or digits, without stop words."""
    found = F.regexp_extract_all(F.lower(x), F.lit("([a-z][a-z0-9]{2,23})"))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def is_contentful(x: Column) -> Column:
    """Whether a segment says enough to tell entities apart: 10 Han characters, 40 Latin letters and digits, or 7 words."""
    n = lambda p: F.regexp_count(x, F.lit(p))
    return (n(f"[{HAN_BASIC}]") >= 10) | (n("[A-Za-z0-9]") >= 40) | (n("[A-Za-z0-9]+") >= 7)


def segments(x: Column, long: int = 240) -> Column:
    """The sentences of a text in one line, cut at 。！？!?；;, those over ``long`` characters with commas at these too."""
    cut = F.filter(F.transform(F.split(collapse_space(x), "[。！？!?；;]+"), lambda s: F.trim(s)), lambda s: s != "")
    parts = lambda s: F.filter(F.transform(F.split(s, "[，,]+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.flatten(F.transform(cut, lambda s: F.when((F.length(s) > long) & (F.size(parts(s)) > 1), parts(s)).otherwise(F.array(s))))


def cut_hard(x: Column, most: int) -> Column:
    """At most ``most`` characters without blanks at the end of a cut."""
    return F.when(F.length(x) > most, F.rtrim(F.substring(x, 1, most))).otherwise(x)


def alias_relation(a: Column, b: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(a) | blank(b), "alias_missing").when(a == b, "same_alias").otherwise("different_alias")


def candidate_scope(a: Column, b: Column) -> Column:
    return F.when(alias_relation(a, b) == "same_alias", "same_alias_identity_continuity").otherwise("sockpuppet_primary")


def first_present(*parts: Column) -> Column:
    """The first text that is not blank; "" without any."""
    return F.coalesce(*(F.when(F.trim(p.cast("string")) != "", F.trim(p.cast("string"))) for p in parts), F.lit(""))


def number_token(x: Column) -> Column:
    """A number between 0 and 1 as part of a name: 0.735 gives 0735, 0.72054 gives 072054."""
    return F.regexp_replace(F.regexp_replace(F.format_number(x, "0.000000"), "\\.", ""), "(?<=.{4})0+$", "")


def word_pairs(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def char_grams(x: Column, n: int) -> Column:
    """All runs of n characters, with repeats; none for shorter texts."""
    size = F.length(x)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def han_grams(x: Column) -> Column:
    """All runs of two and of three characters inside runs of Han characters, with repeats."""
    runs = F.regexp_extract_all(x, F.lit(f"([{HAN_BMP}]{{2,}})"))
    return F.flatten(F.transform(runs, lambda r: F.concat(char_grams(r, 2), char_grams(r, 3))))


def spaced(x: Column) -> Column:
    """A text in lower case with one blank between words, "" if it is missing: equal for texts that differ in wrapping alone."""
    return F.lower(collapse_space(F.coalesce(x, F.lit(""))))


def visible_text(x: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(x, "(?is)<!--.*?-->|<(script|style)[^>]*>.*?</\\1>", " ")
    return collapse_space(F.regexp_replace(bare, "(?s)<[^>]*>", " "))


def first_number(x: Column) -> Column:
    """The first number of a text, with its sign. A comma in it is a decimal point."""
    return F.regexp_replace(F.regexp_extract(x, r"([-+]?[0-9]+(?:[.,][0-9]+)?)", 1), ",", ".").try_cast("double")


def first_whole(x: Column) -> Column:
    """The first number of a text without its fraction."""
    n = first_number(x)
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("bigint")


def hours(x: Column) -> Column:
    """Hours online: the number before the Chinese word for hours, else the first number of the text."""
    said = F.regexp_extract(collapse_space(x), "([0-9]+)\\s*小时", 1)
    return F.when(said != "", said.try_cast("bigint")).otherwise(first_whole(x))


def good_and_risk(x: Column) -> Column:
    """The two counts of "good:risk" as a struct, with the ordinary or the mathematical colon; null without them."""
    good, risk = (F.regexp_extract(x, "([0-9]+)\\s*[∶:]\\s*([0-9]+)", i).try_cast("bigint") for i in (1, 2))
    return F.when(good.isNotNull() & risk.isNotNull(), F.struct(good.alias("good"), risk.alias("risk")))


#: Characters that are no part of a visible text.
BLANK = "\\p{Z}\\t-\\r\\x1c-\\x1f\\x85"


def style(title: Column, description: Column) -> Column:
    """Lengths without needless blanks, shares of digits and marks among visible characters and of capitals among letters, line ends."""
    title, description = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    both = F.concat(title, F.lit(" "), description)
    n = lambda pattern: F.regexp_count(both, F.lit(pattern))
    ratio = lambda a, b: F.coalesce(F.when(b > 0, F.round(a / b, 6)), F.lit(0.0))
    visible, letters = n(f"[^{BLANK}]"), n("\\p{L}")
    return F.struct(
        F.length(collapse_space(title)).alias("title_length"), F.length(collapse_space(description)).alias("description_length"), ratio(n("\\p{Nd}"), visible).alias("digits"),
        ratio(n(f"[^{BLANK}\\p{{L}}\\p{{N}}]"), visible).alias("punctuation"), ratio(n("\\p{Lu}"), letters).alias("upper"), F.regexp_count(both, F.lit("\n")).alias("line_ends"),
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and the SHA-1 of the parts with unit separators between them; missing parts are ""."""
    return F.concat(F.lit(prefix), F.sha1(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))))


def pair_key(a: Column, b: Column) -> Column:
    """The same key for a pair in either order."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def truthy(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit("")))).isin("1", "true", "yes", "y")


def listed(x: Column, separator: str = "||") -> Column:
    """The non-blank items of a delimited list."""
    return F.filter(F.transform(F.split(x, "\\Q" + separator + "\\E"), lambda v: F.trim(v)), lambda v: v != "")


def key_block_digest(x: Column) -> Column:
    return F.sha2(F.regexp_replace(x, r"(?U)\s+", ""), 256)


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility form of Unicode; Spark has no function for it."""
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """HTML entities as characters; Spark has no function for it."""
    return x.map(lambda v: None if v is None else html.unescape(v))


@F.pandas_udf(T.StringType())
def casefolded(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else v.strip().casefold())


@F.pandas_udf(T.IntegerType())
def common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring, by growing runs along the diagonals."""

    def one(x: str | None, y: str | None) -> int:
        x, y = x or "", y or ""
        best, runs = 0, {}
        for ch in x:
            runs = {j + 1: runs.get(j, 0) + 1 for j, other in enumerate(y) if other == ch}
            best = max(best, max(runs.values(), default=0))
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def aliases_related(a: Column, b: Column, most_edits: int = 2, least_share: float = 0.6) -> Column:
    """Equal, one inside the other, a few edits apart, or with a long common run."""
    x, y = soft_alias(a), soft_alias(b)
    shorter = F.least(F.length(x), F.length(y))
    close = F.levenshtein(x, y, most_edits).between(0, most_edits)
    inside = (shorter >= 4) & (F.contains(x, y) | F.contains(y, x))
    run = (shorter >= 5) & (common_run(x, y) >= shorter * least_share)
    return F.when(shorter == 0, False).otherwise((x == y) | inside | ((shorter >= 5) & close) | run)
