"""Scalar functions over addresses and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIMMED = " \t\n\r"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x: str | Column) -> Column:
    """Lower case of A-Z only; other letters stay."""
    return F.translate(col(x), UPPER, LOWER)


def n_bytes(x: str | Column) -> Column:
    """UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(col(x)), F.lit(0)).cast("long")


def trimmed(x: str | Column) -> Column:
    return F.btrim(col(x), F.lit(TRIMMED))


def hostname(url: str | Column) -> Column:
    """What stands between '://' and the next '/', port, query and case included; null without '://'."""
    url = col(url)
    return F.when(F.instr(url, "://") > 0, F.substring_index(_after_scheme(url), "/", 1))


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def origin(url: str | Column) -> Column:
    """Scheme and host; the whole address if it has no path; null without '://'."""
    url = col(url)
    scheme = F.substring(url, F.lit(1), F.instr(url, "://") + 2)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.substring_index(_after_scheme(url), "/", 1)))


def is_third_party(href: str | Column, base: str | Column) -> Column:
    """Whether an address names another host than the page's; relative ones never do."""
    href = col(href)
    relative = href.startswith("/") | href.startswith(".")
    host, own = hostname(href), hostname(base)
    return F.when(relative | host.isNull(), F.lit(False)).otherwise(~host.eqNullSafe(own))


def is_internal(href: str | Column, base: str | Column) -> Column:
    """Links that start with '/' or '#' or name the page's own host."""
    href = col(href)
    same = F.coalesce(hostname(href) == hostname(base), F.lit(False))
    return href.startswith("/") | href.startswith("#") | same


def truncated(url: str | Column, size: int = 12) -> Column:
    """The address without its scheme, cut to ``size`` bytes; a character that the cut breaks becomes U+FFFD."""
    cut = F.substring(F.regexp_replace(col(url), "^https?://", "").cast("binary"), 1, size)
    return F.make_valid_utf8(cut.cast("string"))


def csv_detail(x: str | Column) -> Column:
    """A CSV field, quoted only if it holds a comma, a quote or a line feed."""
    x = col(x)
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def path_of(target: str | Column) -> Column:
    """A request target without its query."""
    return F.substring_index(col(target), "?", 1)


def query_of(target: str | Column) -> Column:
    target = col(target)
    at = F.instr(target, "?")
    return F.when(at > 0, F.substring(target, at + 1, F.length(target))).otherwise(F.lit(""))


def get_param(query: str | Column, name: str) -> Column:
    """The first value of a parameter; pairs without '=' are skipped; null if there is none."""
    pairs = F.split(col(query), "&")
    return F.try_element_at(
        F.transform(F.filter(pairs, lambda p: p.startswith(name + "=")), lambda p: F.substring(p, len(name) + 2, 1 << 30)), F.lit(1)
    )


def segment(path: str | Column, i: int) -> Column:
    """The i-th part of a path, from 0; null beyond its end."""
    return F.get(F.split(F.regexp_replace(col(path), "^/", ""), "/"), F.lit(i))


def normalised_phrase(x: str | Column) -> Column:
    """A keyword as it is looked for: trimmed, A-Z in lower case."""
    return ascii_lower(trimmed(x))


def n_ascii_words(x: str | Column) -> Column:
    """Runs of ASCII letters; other letters split words."""
    return F.coalesce(F.regexp_count(col(x), F.lit("[A-Za-z]+")), F.lit(0)).cast("long")


def contains_ci(text: str | Column, phrase: str | Column) -> Column:
    """Substring test that ignores ASCII case; an empty phrase is in every text, null text holds none but that."""
    return F.contains(F.coalesce(ascii_lower(text), F.lit("")), ascii_lower(phrase))


def n_occurrences(text: str | Column, phrase: str | Column) -> Column:
    """Occurrences of a phrase, ASCII case ignored, left to right without overlap; 0 for an empty phrase."""
    text, phrase = F.coalesce(ascii_lower(text), F.lit("")), ascii_lower(phrase)
    cut = F.length(text) - F.length(F.replace(text, phrase, F.lit("")))
    return F.when(F.length(phrase) > 0, F.floor(cut / F.length(phrase))).otherwise(F.lit(0)).cast("long")


def density_permille(text: str | Column, phrase: str | Column, total_words: str | Column) -> Column:
    """Occurrences times the phrase's words, per thousand words of the text, rounded down; 0 for texts without words."""
    hits = n_occurrences(text, phrase) * n_ascii_words(phrase) * 1000
    total = col(total_words)
    return F.when(total > 0, F.floor(hits / total)).otherwise(F.lit(0)).cast("long")


def clamped(score: Column) -> Column:
    """A score held between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def regressed(before: str | Column, after: str | Column, by: int = 5) -> Column:
    return col(before) - col(after) >= by


def is_question(text: str | Column, prefixes: list[str]) -> Column:
    """A trimmed heading that ends with '?' or starts with a question word and a space."""
    t = trimmed(text)
    low = ascii_lower(t)
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | low.startswith(p)
    return (t != "") & (t.endswith("?") | starts)


def score_band(score: str | Column) -> Column:
    score = col(score)
    return F.when(score >= 80, "good").when(score >= 50, "warn").otherwise("poor")


def resolved_redirect(location: str | Column) -> Column:
    """Only absolute locations are followed."""
    location = col(location)
    return F.when(location.startswith("http://") | location.startswith("https://"), location)


def percent_decoded(x: str | Column) -> Column:
    """%XX and '+' decoded where the escape is whole; other text stays as it is.

    Spark's decoder rejects malformed escapes, so percent signs that start no
    escape are escaped themselves before it runs.
    """
    safe = F.regexp_replace(col(x), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), col(x))


def epoch_micros_of_seconds(ts: str | Column) -> Column:
    """Microseconds since the epoch, rounded to whole seconds."""
    return F.round(F.unix_micros(col(ts)) / 1e6).cast("long") * 1000000
