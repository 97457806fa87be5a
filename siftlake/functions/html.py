"""Tokens, attributes, elements and texts of HTML pages, as column expressions.

A page is cut into tokens by one expression, from left to right: comments and
other markup declarations, scripts and styles with their content, tags, and
text. What stands inside one token cannot begin another, so ``<!--`` in a script
or in a quoted value is no comment. Attributes are taken out of each start tag
once, in one pass, and character references are decoded once, left to right.

``structure`` finds where elements begin and end: a fold over the page's tags
that keeps the open elements on a stack. A start tag first ends what it cannot
stand in (``ENDS``), an end tag closes the last element of its name and all in
it, unless an open element of a higher rank (``RANKS``) lies between, and what
is left ends with the page. The fold gives the bounds of the elements that texts
are taken from. Its cost is that of the tags times the depth, which is bounded by
``DEPTH`` as in browsers, and of the found bounds times the root of their number.

Any text can stand in a page, so the expressions neither recurse nor go back:
repeated groups are possessive, which the matcher runs as loops whatever a
tag's length. What lacks its end goes to the end of the page, a tag up to the
next '<'.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions.dims import SKIPPED_TAGS
from siftlake.functions.text import ascii_lower, col, trimmed

#: What stands between a tag's name and its '>'.
ATTRIBUTES = r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
#: A comment, which ``<!-->`` and ``<!--->`` are too, and other markup that is no content.
COMMENT = r"<!--(?:-?>|.*?(?:-->|\z))"
DECLARATION = r"<[!?][^>]*+(?:>|\z)|</(?![a-z])[^>]*+(?:>|\z)"


def _raw(tag: str) -> str:
    return rf"<{tag}(?![^\s/<>]){ATTRIBUTES}(?<!/)>.*?(?:</{tag}\s*+>|\z)"


TEXT = r"(?:[^<]++|<(?![a-z!?/]))++"
TOKEN = rf"(?is){COMMENT}|{DECLARATION}|{_raw('script')}|{_raw('style')}|</?[a-z][^\s<>/=]*+{ATTRIBUTES}>|{TEXT}|<"
#: A token's name: of a start tag its element, of an end tag that behind '/'.
NAME = r"^<(/?[a-zA-Z][^\s<>/=]*+)"
OPEN = rf"(?s)^<[a-zA-Z]++{ATTRIBUTES}>"
ATTRIBUTE = r"(?s)[^\s=/>\"'][^\s=/>]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+"
REFERENCE = r"[^&]++|&#[xX][0-9a-fA-F]++;?+|&#[0-9]++;?+|&[a-zA-Z][a-zA-Z0-9]*+;|&"
SPACES = " \t\n\r\f"

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Open elements that a start tag ends while they are innermost, by the tag.
ENDS: dict[str, tuple[str, ...]] = {
    "body": ("head", "title"),
    "a": ("a",),
    "li": ("li", "p", *HEADINGS),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "option": ("option",),
    "optgroup": ("option", "optgroup"),
    "td": ("td", "th", "p", "a", "b", "i", "span", "font"),
    "th": ("td", "th", "p", "a", "b", "i", "span", "font"),
    "tr": ("td", "th", "tr", "p"),
    **{t: ("td", "th", "tr", "p", "thead", "tbody", "tfoot") for t in ("thead", "tbody", "tfoot")},
    "table": ("p", "a", *HEADINGS),
    "p": ("p", *HEADINGS),
    **{t: ("p", *HEADINGS) for t in HEADINGS},
    **{
        t: ("p",)
        for t in "address article aside blockquote center details div dl fieldset figure footer form header hr main menu nav ol pre section ul".split()
    },
}
#: An end tag does not reach past an open element of a higher rank; names not listed have rank 1.
RANKS = {"p": 0, "div": 2, "td": 3, "th": 3, "tr": 4, "thead": 5, "tbody": 5, "tfoot": 5, "table": 6, "head": 7, "body": 7, "html": 8}
#: Elements that lie deeper are not told apart from their surroundings.
DEPTH = 256


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _literals(known: dict) -> Column:
    return F.create_map(*[F.lit(y) for item in known.items() for y in item])


def _number(reference: Column) -> Column:
    """The character of a numeric reference; empty for what is no character."""
    digits = F.rtrim(F.substring(reference, 3, 1 << 20), F.lit(";"))
    is_hex = ascii_lower(F.substring(digits, 1, 1)) == "x"
    plain = F.ltrim(F.when(is_hex, F.substring(digits, 2, 1 << 20)).otherwise(digits), F.lit("0"))
    # no character has more digits
    code = F.when(is_hex & (F.length(plain) <= 6), plain).when(~is_hex & (F.length(plain) <= 7), F.conv(plain, 10, 16))
    n = F.conv(code, 16, 10).cast("int")
    good = n.isin(9, 10, 13) | n.between(0x20, 0xD7FF) | n.between(0xE000, 0xFFFD) | n.between(0x10000, 0x10FFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(F.lit(""))


def decoded(x: Column) -> Column:
    """Character references decoded: those with a name of HTML 4 (and &apos;) and a semicolon, and numeric ones."""
    names = {f"&{name};": chr(n) for name, n in name2codepoint.items()} | {"&apos;": "'"}
    one = lambda p: (
        F.when(~p.startswith("&"), p).when(p.startswith("&#") & (F.length(p) > 2), _number(p)).otherwise(F.coalesce(F.try_element_at(_literals(names), p), p))
    )
    parts = F.transform(F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(0)), one)
    return F.when(x.contains("&"), F.array_join(parts, "")).otherwise(x)


def tokens(page: str | Column) -> Column:
    """The tokens of a page in order, as (name, token, text): scripts and styles have their content as text, tags and comments none."""
    page = F.coalesce(col(page), F.lit(""))
    named = lambda t: F.when(t.startswith("<"), ascii_lower(F.regexp_extract(t, NAME, 1))).otherwise(F.lit(""))
    cut = F.transform(F.regexp_extract_all(page, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(named(t).alias("name"), t.alias("token")))
    none = lambda t: t.startswith("<!") | t.startswith("<?") | t.startswith("</")

    def text(k: Column) -> Column:
        raw = F.when(k["name"].isin("script", "style"), _raw_body(k["token"])).otherwise(F.lit(""))
        return F.when(k["name"] != "", raw).when(none(k["token"]), F.lit("")).otherwise(decoded(k["token"]))

    return F.transform(cut, lambda k: F.struct(k["name"].alias("name"), k["token"].alias("token"), text(k).alias("text")))


def _raw_body(token: Column) -> Column:
    """What stands between a script's or style's tags; empty for a tag that ends itself."""
    inner = F.substring(token, F.length(F.regexp_extract(token, OPEN, 0)) + 1, F.length(token))
    return F.regexp_replace(inner, r"(?i)</(?:script|style)\s*+>$", "")


def attributes(token: Column, name: Column) -> Column:
    """The attributes of a start tag in order, as (name, value): names in lower case, empty values where there are none."""
    is_raw = name.isin("script", "style")
    tag = F.when(is_raw, F.regexp_extract(token, OPEN, 0)).otherwise(token)
    inner = F.substring(tag, F.length(name) + 2, F.length(tag) - F.length(name) - 2)

    def one(a: Column) -> Column:
        at = F.instr(a, "=")
        value = F.btrim(F.substring(a, at + 1, F.length(a)), F.lit(SPACES))
        quoted = value.startswith('"') | value.startswith("'")
        value = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        known = F.when(at == 0, a).otherwise(F.substring(a, F.lit(1), at - 1))
        return F.struct(ascii_lower(F.rtrim(known, F.lit(SPACES))).alias("name"), F.when(at == 0, F.lit("")).otherwise(decoded(value)).alias("value"))

    # most tags have none
    found = F.transform(F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(0)), one)
    return F.when(F.length(inner) > 1, found).otherwise(F.array().cast("array<struct<name:string,value:string>>"))


def elements(page_tokens: str | Column) -> Column:
    """The start tags in order, as (tag, attrs, body); scripts and styles have their content as body."""
    starts = F.filter(col(page_tokens), lambda k: (k["name"] != "") & ~k["name"].startswith("/"))
    return F.transform(starts, lambda k: F.struct(k["name"].alias("tag"), attributes(k["token"], k["name"]).alias("attrs"), k["text"].alias("body")))


def attr(element: Column, name: str) -> Column:
    """An attribute's value: null if absent, empty without a value; the first of several counts."""
    return F.try_element_at(F.filter(element["attrs"], lambda a: a["name"] == name), F.lit(1))["value"]


def has(element: Column, name: str) -> Column:
    return F.exists(element["attrs"], lambda a: a["name"] == name)


_OPEN_TYPE = "struct<name:string,at:int,rank:int,wanted:boolean,skipped:boolean>"
_BOUNDS_TYPE = "struct<name:string,first:int,last:int>"


def structure(page_tokens: str | Column) -> Column:
    """The bounds (name, first, last) of all titles, headings, links and bodies and of the outermost skipped elements.

    ``first`` is the number of the start tag's token and ``last`` of the first token behind the element's content.
    """
    page_tokens = col(page_tokens)
    skipped = [t for t in SKIPPED_TAGS if t not in ("script", "style")]
    texts = ("title", "a", "body", *HEADINGS)
    ends = _literals({t: "".join(f" {x} " for x in xs) for t, xs in ENDS.items()})
    ranks = _literals(RANKS)
    tags = F.filter(
        F.transform(page_tokens, lambda k, i: F.struct(k["name"].alias("name"), i.alias("at"), k["token"].endswith("/>").alias("empty"))),
        lambda e: (e["name"] != "") & ~e["empty"] & ~e["name"].isin("script", "style", *VOID),
    )

    def told(e: Column, ends_one: Column, name: Column) -> Column:
        """A tag with what the tables say of its name, looked up once and not at each open element."""
        rank = F.coalesce(F.try_element_at(ranks, name), F.lit(1))
        return F.struct(
            name.alias("name"), e["at"].alias("at"), ends_one.alias("ends_one"), rank.alias("rank"),
            F.when(~ends_one, F.try_element_at(ends, name)).alias("ends"),
            name.isin(*texts).alias("wanted"), name.isin(*skipped).alias("skips"), name.isin("html", "head", "body").alias("once"),
        )

    bare = lambda n: F.when(n.startswith("/"), F.substring(n, 2, 1 << 20)).otherwise(n)
    tags = F.transform(tags, lambda e: _let(bare(e["name"]), lambda name: told(e, e["name"].startswith("/"), name)))
    last_where = lambda open_, test: F.coalesce(F.array_max(F.transform(open_, lambda x, j: F.when(test(x), j + 1).otherwise(F.lit(0)))), F.lit(0))

    def kept_by_start(open_: Column, e: Column) -> Column:
        """How many open elements stay open at a start tag."""
        stays = lambda x: ~F.contains(e["ends"], F.concat(F.lit(" "), x["name"], F.lit(" ")))
        return F.when(e["ends"].isNull(), F.size(open_)).otherwise(last_where(open_, stays))

    def kept_by_end(open_: Column, e: Column) -> Column:
        barred = lambda m: F.exists(F.slice(open_, m + 1, F.size(open_) - m), lambda x: x["rank"] > e["rank"])
        reached = _let(last_where(open_, lambda x: x["name"] == e["name"]), lambda m: F.when((m == 0) | barred(m), F.size(open_)).otherwise(m - 1))
        # most end tags close the innermost element
        return F.when(F.try_element_at(open_, F.lit(-1))["name"] == e["name"], F.size(open_) - 1).otherwise(reached)

    def closed(open_: Column, kept: Column, at: Column) -> Column:
        gone = F.filter(F.slice(open_, kept + 1, F.size(open_) - kept), lambda x: x["wanted"])
        return F.transform(gone, lambda x: F.struct(x["name"].alias("name"), x["at"].alias("first"), at.alias("last")))

    def opened(open_: Column, e: Column) -> Column:
        """The open elements with one more."""
        inside = F.coalesce(F.try_element_at(open_, F.lit(-1))["skipped"], F.lit(False))
        wanted = e["wanted"] | (e["skips"] & ~inside)
        new = F.struct(e["name"].alias("name"), e["at"].alias("at"), e["rank"].alias("rank"), wanted.alias("wanted"), (e["skips"] | inside).alias("skipped"))
        again = e["once"] & F.exists(open_, lambda x: x["name"] == e["name"])
        return F.when((F.size(open_) >= DEPTH) | again, open_).otherwise(F.concat(open_, F.array(new)))

    def step(state: Column, e: Column) -> Column:
        open_, found = state["open"], state["found"]

        def moved(kept: Column) -> Column:
            # most tags close nothing
            rest = F.when(kept == F.size(open_), open_).otherwise(F.slice(open_, F.lit(1), kept))
            more = F.when(kept == F.size(open_), found).otherwise(F.concat(found, closed(open_, kept, e["at"])))
            return F.struct(F.when(e["ends_one"], rest).otherwise(_let(rest, lambda o: opened(o, e))).alias("open"), more.alias("found"))

        return _let(F.when(e["ends_one"], kept_by_end(open_, e)).otherwise(kept_by_start(open_, e)), moved)

    def folded(tags: Column) -> Column:
        """All bounds. A fold copies its state at each step, so found bounds are handed over once a block; blocks are as many as a block has tags."""
        size = F.greatest(F.ceil(F.sqrt(F.size(tags))), F.lit(1)).cast("int")
        blocks = F.sequence(F.lit(0), F.floor(F.size(tags) / size).cast("int"))
        empty = F.array().cast(f"array<{_BOUNDS_TYPE}>")
        start = F.struct(F.array().cast(f"array<{_OPEN_TYPE}>").alias("open"), F.array().cast(f"array<array<{_BOUNDS_TYPE}>>").alias("found"))
        taken = lambda s, more: F.concat(s["found"], F.array(more))
        block = lambda s, j: F.aggregate(
            F.slice(tags, j * size + 1, size),
            F.struct(s["open"].alias("open"), empty.alias("found")),
            step,
            lambda x: F.struct(x["open"].alias("open"), taken(s, x["found"]).alias("found")),
        )
        return F.aggregate(blocks, start, block, lambda s: F.flatten(taken(s, closed(s["open"], F.lit(0), F.size(page_tokens)))))

    # elements in the order of their start tags
    by_first = lambda b: F.sort_array(F.transform(b, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["name"].alias("name"))))
    return by_first(_let(tags, folded))


def inner_text(page_tokens: str | Column, bounds: Column) -> Column:
    """The text between an element's bounds, untrimmed."""
    inside = F.slice(col(page_tokens), bounds["first"] + 2, bounds["last"] - bounds["first"] - 1)
    return F.array_join(F.transform(inside, lambda k: k["text"]), "")


def _named(bounds: str | Column, *names: str) -> Column:
    return F.filter(col(bounds), lambda x: x["name"].isin(*names))


def title(page_tokens: str | Column, bounds: str | Column) -> Column:
    """The text of the first title, untrimmed; null if there is none."""
    first = F.try_element_at(_named(bounds, "title"), F.lit(1))
    return F.when(first.isNotNull(), inner_text(page_tokens, first))


def headings(page_tokens: str | Column, bounds: str | Column) -> Column:
    """(level, text) of h1 to h6 in order, text trimmed and possibly empty."""
    one = lambda x: F.struct(F.substring(x["name"], 2, 1).cast("int").alias("level"), trimmed(inner_text(page_tokens, x)).alias("text"))
    return F.transform(_named(bounds, *HEADINGS), one)


def anchor_texts(page_tokens: str | Column, bounds: str | Column) -> Column:
    """The trimmed texts of links."""
    return F.transform(_named(bounds, "a"), lambda x: trimmed(inner_text(page_tokens, x)))


def body_text(page_tokens: str | Column, bounds: str | Column) -> Column:
    """The text of the first body, a space behind each part, without the skipped elements; scripts and styles are none of it.

    A page without a body tag has its body behind its head's end, or else all but its titles is body.
    """
    page_tokens, bounds = col(page_tokens), col(bounds)
    place = lambda name: F.array_position(F.transform(page_tokens, lambda k: k["name"]), name)
    body = F.try_element_at(_named(bounds, "body"), F.lit(1))
    head_end = place("/head").cast("int")
    ended = lambda name: F.when(place(name) > 0, place(name).cast("int") - 1)
    implied = F.struct((head_end - 1).alias("first"), F.coalesce(F.least(ended("/body"), ended("/html")), F.size(page_tokens)).alias("last"), F.lit("body").alias("name"))
    skips = lambda whole: F.filter(
        bounds,
        lambda x: (x["first"] > whole["first"]) & (x["first"] < whole["last"]) & (x["name"].isin(*SKIPPED_TAGS) | ((whole["first"] < 0) & (x["name"] == "title"))),
    )
    # what lies between the skipped elements
    begin = lambda cut, i, whole: F.coalesce(F.get(cut, i - 1)["last"], whole["first"] + 1)
    between = lambda cut, whole: F.concat(
        F.transform(cut, lambda x, i: F.struct(begin(cut, i, whole).alias("a"), x["first"].alias("b"))),
        F.array(F.struct(begin(cut, F.size(cut), whole).alias("a"), whole["last"].alias("b"))),
    )
    part = lambda r: F.filter(F.slice(page_tokens, r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0))), lambda k: (k["name"] == "") & (k["text"] != ""))
    parts = lambda whole: F.flatten(F.transform(_let(skips(whole), lambda cut: between(cut, whole)), part))
    return F.array_join(F.transform(_let(F.coalesce(body, implied), parts), lambda k: F.concat(k["text"], F.lit(" "))), "")
