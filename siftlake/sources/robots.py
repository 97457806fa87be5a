"""robots.txt texts as rules, and paths against rules: inside the row without a shuffle, or a table of rules against a table of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import ascii_lower


def parsed_robots(df: DataFrame, body: str = "body", agent: str = "SiteAuditBot") -> DataFrame:
    """Add sitemaps, disallowed, allowed and crawl_delay_ms.

    A group for the agent replaces the wildcard group wholly; every User-agent
    line opens a group of its own; the delay is the last one in either group.
    """
    lines = F.filter(
        F.transform(F.split(F.coalesce(F.col(body), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))),
        lambda x: (x != "") & ~x.startswith("#") & x.contains(":"),
    )
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            ascii_lower(F.btrim(F.substring_index(x, ":", 1), F.lit(" \t"))).alias("k"),
            F.btrim(F.substring(x, F.instr(x, ":") + 1, F.length(x)), F.lit(" \t")).alias("v"),
        ),
    )
    df = df.withColumn("_pairs", pairs)
    # A group runs from its User-agent line to the next; lines before the first are of none. Slices keep this linear in the lines.
    n = F.size("_pairs")
    opens = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.try_element_at("_pairs", i)["k"] == "user-agent", F.lit(False)))
    df = df.withColumn("_opens", F.concat(F.array(F.lit(1)), opens, F.array(n + 1)))

    def group(start: Column, end: Column, i: Column) -> Column:
        agent_line = F.try_element_at("_pairs", start)["v"]
        g = F.when(i == 0, F.lit("none")).when(ascii_lower(agent_line) == agent.lower(), F.lit("own")).when(agent_line == "*", F.lit("any"))
        rows = F.slice("_pairs", start, F.greatest(end - start, F.lit(0)))
        return F.transform(rows, lambda p: F.struct(g.otherwise(F.lit("other")).alias("g"), p["k"].alias("k"), p["v"].alias("v")))

    ends = F.slice("_opens", F.lit(2), F.size("_opens") - 1)
    spans = F.arrays_zip(F.slice("_opens", F.lit(1), F.size("_opens") - 1).alias("start"), ends.alias("end"))
    df = df.withColumn("_rows", F.flatten(F.transform(spans, lambda x, i: group(x["start"], x["end"], i))))
    used = F.when(F.exists("_rows", lambda r: r["g"] == "own"), F.lit("own")).otherwise(F.lit("any"))
    values = lambda key: F.transform(F.filter("_rows", lambda r: (r["k"] == key) & (r["g"] == F.col("_used"))), lambda r: r["v"])
    delays = F.transform(
        F.filter("_rows", lambda r: (r["k"] == "crawl-delay") & r["g"].isin("own", "any") & r["v"].try_cast("double").isNotNull()),
        lambda r: (r["v"].try_cast("double") * 1000).cast("long"),
    )
    return (
        df.withColumn("_used", used)
        .withColumn("sitemaps", F.transform(F.filter("_rows", lambda r: r["k"] == "sitemap"), lambda r: r["v"]))
        .withColumn("disallowed", values("disallow"))
        .withColumn("allowed", values("allow"))
        .withColumn("crawl_delay_ms", F.coalesce(F.try_element_at(delays, F.lit(-1)), F.lit(0)))
        .drop("_pairs", "_opens", "_rows", "_used")
    )


def is_allowed(path: str) -> Column:
    """The longest matching rule decides, allow wins ties; empty rules match nothing."""
    longest = lambda rules: F.coalesce(
        F.array_max(F.transform(F.filter(rules, lambda r: (r != "") & F.col(path).startswith(r)), lambda r: F.octet_length(r))), F.lit(0)
    )
    return (longest("disallowed") == 0) | (longest("allowed") >= longest("disallowed"))


def rule_rows(parsed: DataFrame, host: str) -> DataFrame:
    """host, rule and allow, a row for each rule of parsed robots texts."""
    one = lambda c, allow: F.transform(c, lambda r: F.struct(r.alias("rule"), F.lit(allow).alias("allow")))
    rows = parsed.select(F.col(host).alias("host"), F.explode(F.concat(one("disallowed", False), one("allowed", True))).alias("r"))
    return rows.select("host", "r.rule", "r.allow")


def allowed_by_rules(addresses: DataFrame, rules: DataFrame, salts: int = 16) -> DataFrame:
    """``addresses``(host, path, ...) with a column allowed, by a table of rules(host, rule, allow).

    An address meets the rules by equality of its prefixes, of those lengths
    that its host's rules have, so no pair is made but of rules that match.
    Paths are made distinct first. A hot host, or a prefix such as "/" that all
    its paths share, is dealt over ``salts`` parts by a hash of the path, and
    the rules, distinct by then, are repeated for each.

    The longest rule decides, by bytes; allow wins ties; empty and null rules
    match nothing; a null host or path and a host without rules are allowed;
    repeated rules count once and repeated addresses keep their rows.
    """
    known = rules.filter((F.col("rule") != "") & F.col("host").isNotNull()).groupBy("host", "rule").agg(
        F.max(F.col("allow").cast("int")).alias("allows"), F.min(F.col("allow").cast("int")).alias("least")
    )
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    lengths = known.groupBy("host").agg(F.collect_set(F.length("rule")).alias("lengths")).select("host", "lengths", salt)
    known = known.select("host", "rule", "allows", "least", salt)
    pairs = addresses.filter("host is not null and path is not null").select("host", "path").distinct()
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
    fit = F.filter("lengths", lambda n: n <= F.length("path"))
    prefixes = pairs.join(lengths, ["host", "salt"]).select("host", "path", "salt", F.explode(fit).alias("n"))
    prefixes = prefixes.select("host", "path", "salt", F.substring("path", F.lit(1), F.col("n")).alias("rule"))
    longest = lambda c: F.coalesce(F.max(F.when(c, F.octet_length("rule"))), F.lit(0))
    met = prefixes.join(known, ["host", "salt", "rule"]).groupBy("host", "path").agg(
        longest(F.col("least") == 0).alias("barred"), longest(F.col("allows") == 1).alias("let")
    )
    barred = met.filter("barred > 0 and let < barred").select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    found = addresses.join(barred, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return found.withColumn("allowed", F.col("_host").isNull()).drop("_host", "_path")
