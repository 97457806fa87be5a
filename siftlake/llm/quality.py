"""Quality rules with line-first cleaning, in DataFrame functions only.

Every line of a document is judged by itself: punctuation (a short line that
does not end a sentence, or a line of marks), navigation (a row of menu items)
and boilerplate (a line that is a notice and nothing else, in four languages:
marks, spaces and digits at its ends do not count, words around it do, so prose
that speaks of cookies stays). Failing lines are removed first; then a document
is rejected if it has lost too much of its text.

Nulls and odd rows: a null text counts as empty; it has no words and fails the
base rule. Blank lines pass and lose nothing. Repeated rows are judged alike. A
very long text is judged in its row, in n log n. An empty table gives an empty
table. Own columns keep their names and values: a result whose name is taken
carries an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.text import SPACE, WORD, free_name, whole, words
from siftlake.session import table

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Notices that are a whole line, in lower case and without what EDGES has at its ends.
NOTICES = (
    "cookie", "cookies", "cookie policy", "we use cookies", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "copyright", "enable javascript", "javascript is required", "lorem ipsum", "subscribe", "subscribe now",
    "newsletter", "click here", "read more", "sign in", "sign up", "log in", "datenschutz", "nutzungsbedingungen",
    "alle rechte vorbehalten", "impressum", "abonnieren", "mehr lesen", "anmelden", "politique de confidentialité",
    "conditions d'utilisation", "tous droits réservés", "s'abonner", "lire la suite", "se connecter", "política de privacidad",
    "términos de uso", "todos los derechos reservados", "suscríbete", "leer más", "iniciar sesión",
)
EDGES = SPACE + ".,:;!?|>»•·*#-–—()[]\"©0123456789"
#: A line of fewer words must end a sentence, with one of these characters.
MIN_OPEN_WORDS = 8
ENDS = ".!?\"')]…。”’:;"
#: Shares of a line's words or characters from which it is made of marks or menu items.
MAX_SYMBOL_SHARE, MAX_SHOUT_SHARE, MAX_BAR_SHARE = 0.1, 0.3, 0.2
#: A document that loses more than this share of its visible characters is rejected.
MAX_LOST = 0.5


def _visible(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    out = text.contains(phrases[0])
    for phrase in phrases[1:]:
        out = out | text.contains(phrase)
    return out


def line_fails(line: Column) -> Column:
    """Whether the rules remove this line; false for blank lines. Dear tests come behind cheap ones that rule them out."""
    body = F.btrim(line, F.lit(SPACE))
    n = F.regexp_count(body, F.lit(WORD))
    marks = (_symbols(body) > 0) & (_symbols(body) > _visible(body) * MAX_SYMBOL_SHARE)
    shouts = body.contains("!!") & (F.regexp_count(body, F.lit("!!")) > n * MAX_SHOUT_SHARE)
    open_end = ~F.substring(body, -1, 1).isin(*ENDS) & (n < MIN_OPEN_WORDS)
    navigation = _says(body, ("|", "»", ">", "•", "·")) & (n >= 3) & (F.regexp_count(body, F.lit(r"(^|\s)[|»>•·](\s|$)")) > n * MAX_BAR_SHARE)
    notice = F.btrim(F.lower(body), F.lit(EDGES)).isin(*NOTICES)
    return (body != "") & (open_end | shouts | marks | navigation | notice)


def repeated_window_words(df: DataFrame, words_col: str, out: str, window: int = WINDOW) -> DataFrame:
    """Add the number of words that stand in a window of ``window`` words found twice or more in the row.

    Word hashes are combined in pairs, pairs of pairs and so on to hashes of the
    longest runs of a power of two; if all of those differ, no window repeats.
    Otherwise windows are hashed from two such runs that cover them and sorted
    within the row; neighbours with one hash are repeats, and the stretches they
    cover are measured in order of position. The work is n log n in the row's
    words and nothing leaves the row.
    """
    both = lambda c, gap: F.transform(
        F.slice(c, F.lit(1), F.greatest(F.size(c) - gap, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(c, i + gap))
    )
    df = df.withColumn("_runs", F.when(F.size(words_col) > window, F.transform(words_col, lambda w: F.xxhash64(w))))
    size = 1
    while 2 * size < window:
        df = df.withColumn("_runs", both("_runs", size))
        size *= 2
    differ = F.size(F.array_distinct("_runs")) == F.size("_runs")
    df = df.withColumn("_hashes", F.when(~differ, both("_runs", window - size)))
    df = df.withColumn("_sorted", F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    found = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn("_found", F.array_sort(F.transform(found, lambda x: x["i"])))
    steps = F.transform(
        "_found", lambda i, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), i - F.get("_found", k - 1)))
    )
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0).cast("long"))).drop("_runs", "_hashes", "_sorted", "_found")


def quality(docs: DataFrame) -> DataFrame:
    """Add the counts, the base rule's verdict, the cleaned text, the share lost and the final verdict. Narrow: no shuffle."""
    own = docs.columns
    df = docs.select(F.struct(*own).alias("_doc"), whole("text").alias("_text"))
    df = df.withColumn("_words", words(F.col("_text"))).withColumn("_lines", F.split("_text", "\n"))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": _symbols(F.col("_text")).cast("long"),
            "_filled": F.filter("_lines", lambda line: F.btrim(line, F.lit(SPACE)) != ""),
            "clean_text": F.array_join(F.filter("_lines", lambda line: ~line_fails(line)), "\n"),
        }
    )
    df = repeated_window_words(df, "_words", "n_repeat_words")
    whole_left = F.octet_length("clean_text") == F.octet_length("_text")
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long"),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "lost_share": F.when(whole_left | (F.col("word_chars") == 0), F.lit(0.0)).otherwise(
                1 - _visible(F.col("clean_text")) / F.col("word_chars")
            ),
        }
    )
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MAX_LOST))
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost_share", "kept")
    field = lambda c: F.col("_doc").getField(c).alias(c)
    return df.select(*map(field, own), *[F.col(c).alias(free_name(c, own)) for c in results])


def op9_line_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts for every document."""
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP9_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
win as (
  select r, i, list_slice(w, i, i + 7) as g
  from (select r, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)
),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
cov as (select r, least(8, coalesce(lead(i) over (partition by r order by i) - i, 8)) as c from rep),
reps as (select r, sum(c)::bigint as n_repeat_words from cov group by r),
lines as (
  select r, l, trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as b
  from (select r, unnest(string_split(text, chr(10))) as l from d)
),
judged as (
  select r, l, b, len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) as n,
    len(regexp_replace(b, '[\x20\x09-\x0D]', '', 'g')) as vis,
    len(regexp_extract_all(b, '[#*$%&|<>]')) as sym,
    len(regexp_extract_all(b, '!!')) as shouts,
    len(regexp_extract_all(b, '(^|\s)[|»>•·](\s|$)')) as bars
  from lines
),
fails as (
  select r, l, b, vis, b <> '' and (
    sym > vis * 0.1 or shouts > n * 0.3
    or (n < 8 and not regexp_matches(b, '[.!?"'')\]…。”’:;]$'))
    or (n >= 3 and bars > n * 0.2)
    or trim(lower(b), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '.,:;!?|>»•·*#-–—()[]"©0123456789') in ({notices})
  ) as fail from judged
),
per as (
  select r, sum(case when fail then vis else 0 end) as lost, sum(vis) as vis,
    count(*) filter (where b <> '') - count(distinct l) filter (where b <> '') as n_dup_lines
  from fails group by r
)
select d.doc_id, len(w.w)::bigint as n_words, per.vis::bigint as word_chars,
  len(regexp_extract_all(d.text, '[#*$%&|<>]'))::bigint as n_symbols,
  per.n_dup_lines::bigint as n_dup_lines, coalesce(reps.n_repeat_words, 0)::bigint as n_repeat_words,
  len(w.w) < 20 or 100 * coalesce(reps.n_repeat_words, 0) > 30 * len(w.w) as base_failed,
  not (len(w.w) < 20 or 100 * coalesce(reps.n_repeat_words, 0) > 30 * len(w.w))
    and (per.vis = 0 or 1 - (per.vis - per.lost) / per.vis <= 0.5) as kept
from d join w using (r) join per using (r) left join reps using (r)
""".replace("{notices}", ", ".join("'" + x.replace("'", "''") + "'" for x in NOTICES))
