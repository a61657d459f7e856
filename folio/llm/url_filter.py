"""URL filters: host-suffix and path-prefix expressions matched by short hash prefixes, then by full digests.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with the rule's.
Each url is expanded into its host's suffixes at label bounds (no longer than any rule's host), crossed with the path prefixes whose lengths occur
in the rule table. Expressions and rules meet in an equi-join on the first 32 bits of their SHA-256; the full
digest then confirms, and the longest rule wins. Of equally long rules the one with the longer host wins, then
blocking before allowing.

Rules that share a short prefix are gathered in one row of the join, so an expression never multiplies.

The rule table is broadcast only if it has at most ``BROADCAST_RULES`` rules, counted first. Larger tables are
joined by shuffle: each expression gets one of ``SALTS`` salts by its url's id and path, and the rules are copied
once for each salt, so the expressions of a host with a third of all pages are spread over as many tasks. A url has
as many expressions as its host has suffixes of no more labels than a rule's host, times the distinct path lengths of the
rules that its path reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower, let

BROADCAST_RULES = 100_000
SALTS = 16
PREFIX = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """The suffixes of the host, itself included, that start at a label and have ``most`` labels at most."""

    def of(labels: Column) -> Column:
        last = F.slice(labels, F.greatest(F.size(labels) - most, F.lit(0)) + 1, most)
        return let(last, lambda t: F.transform(F.sequence(F.lit(1), F.size(t)), lambda k: F.array_join(F.slice(t, k, F.size(t)), ".")))

    return let(F.split(host, r"\."), of)


def digests(rules: DataFrame) -> DataFrame:
    """Rules with their digest, its short prefix and their precedence; rules with a null host, path or verdict never fit."""
    key = F.sha2(F.concat_ws(" ", "rule_host", "rule_path").cast("binary"), 256)
    given = rules.where("rule_host is not null and rule_path is not null and verdict is not null")
    given = given.select(ascii_lower(F.col("rule_host")).alias("rule_host"), "rule_path", "verdict").distinct()
    best = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict"))
    return given.select(key.alias("rule_digest"), F.substring(key, 1, PREFIX).alias("prefix"), F.length("rule_path").alias("path_size"), F.size(F.split("rule_host", r"\.")).alias("labels"), best.alias("best"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule (or null), verdict (the rule's, else ``default``).

    A null url, or one without ``://``, has an empty host and path and fits no rule with a host. Null and repeated
    ids keep their rows; other columns are not read. ``rules`` has rule_host, rule_path and verdict; an empty table
    leaves every verdict to ``default``.
    """
    keyed = digests(rules)
    figures = keyed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path_size")).alias("sizes"), F.max("labels").alias("labels")).first()
    sizes = F.array(*(F.lit(n) for n in figures.sizes)).cast("array<int>")
    found = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    paths = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(host_suffixes(F.col("host"), figures.labels or 1), lambda h: F.transform(paths, lambda p: F.sha2(F.concat_ws(" ", h, p).cast("binary"), 256))))
    asked = found.select("id", "host", "path", F.posexplode_outer(pairs).alias("k", "digest")).withColumn("prefix", F.substring("digest", 1, PREFIX))
    keyed = keyed.groupBy("prefix").agg(F.collect_list(F.struct("rule_digest", "best")).alias("candidates"))
    on = ["prefix"]
    if figures.n <= broadcast_rules:
        keyed = F.broadcast(keyed)
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
        keyed = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = ["prefix", "salt"]
    met = asked.join(keyed, on, "left")
    # one row for each (id, host, path): rows that repeat one are counted by their first expression and given back below
    confirmed = F.array_max(F.transform(F.filter("candidates", lambda c: c["rule_digest"] == F.col("digest")), lambda c: c["best"]))
    judged = met.groupBy("id", "host", "path").agg(F.max(confirmed).alias("best"), F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("rows"))
    out = judged.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return out.drop("copy").withColumnRenamed("id", id_col)
