"""URL filtering by a path-template tree, in DataFrame expressions only.

Per host, variable path segments (numbers, dates, long hexadecimal or digit-rich
names) become wildcards, as do literal segments with little support. From the
deepest level up, sibling branches whose share of bad labels does not differ
significantly from that of all siblings together are merged into one wildcard
branch. A template is rejected where its labelled purity, smoothed towards the
whole table's, is too low. Explicit rules come before the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import ascii_lower, materialize

#: (host and its subdomains, start of the path, verdict): fixed values.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SALTS = 32


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(domain + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def pattern(path: Column, depth: int | None = 3) -> Column:
    """The path's first ``depth`` segments (None: all), the variable ones as wildcards, with what the rest is like."""
    shape = F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when(s.rlike(r"^[0-9]+$"), F.lit("*"))
        .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("*."), F.substring_index(s, ".", -1)))
        .when(s.rlike(r"^[0-9A-Fa-f-]{12,}$") | (F.length(F.regexp_replace(s, "[^0-9]", "")) >= 4), F.lit("*"))
        .otherwise(s),
    )
    if depth is None:
        return shape
    return F.concat(F.slice(shape, 1, depth), F.when(F.size(shape) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))


def url_number(path: Column) -> Column:
    """The last number in the path: the document that a page shows, by which labels are found."""
    return F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long")


def template_tree(
    urls: DataFrame, *, depth: int | None = 3, support: int = 5, z: float = 1.96, prior: float = 10.0, purity: float = 0.5
) -> DataFrame:
    """(host, pattern, template, labelled, bad, smoothed, method_verdict) of each pattern.

    ``urls``: host, pattern, bad (true, false or null where there is no label).
    ``depth``: levels that are judged; None: as many as the longest pattern has.
    ``support``: literals with fewer pages become wildcards. ``z``: siblings within so
    many standard errors of their common rate merge. ``prior``: weight, in labels, of
    the table's own rate: at a rate of 0.2 it takes five labels, all bad, to fall below one half.
    ``purity``: below it a template is rejected. All counts are
    over all rows, aggregated before they are shuffled; what comes out has a row for
    each pattern, not for each page.
    """
    counts = materialize(
        urls.groupBy("host", "pattern").agg(
            F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
        ),
        "patterns",
    )
    if depth is None:
        depth = counts.agg(F.coalesce(F.max(F.size("pattern")), F.lit(0)).alias("levels")).first()["levels"]
    tree = counts.withColumn("template", F.col("pattern"))
    for level in range(depth):  # rare literals, from the top, so that a branch is counted below what it has become
        tree = materialize(tree.withColumn("node", F.slice("template", 1, level + 1)), "tree")
        seen = tree.groupBy("host", "node").agg(F.sum("pages").alias("node_pages"))
        rare = (F.size("template") > level) & (F.col("node_pages") < support)
        tree = tree.join(seen, ["host", "node"]).withColumn("template", F.when(rare, wildcard(level)).otherwise(F.col("template"))).drop("node", "node_pages")
    for level in reversed(range(depth)):  # similar siblings, from the bottom
        tree = materialize(tree.withColumn("parent", F.when(F.size("template") > level, wildcard(level)).otherwise(F.col("template"))), "tree")
        own = tree.groupBy("host", "parent", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
        up = own.groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
        rate = (F.col("all_b") + 0.5) / (F.col("all_n") + 1.0)
        off = F.abs(F.col("b") - F.col("n") * rate) / F.sqrt(rate * (1.0 - rate) * F.greatest(F.col("n"), F.lit(1)))
        alike = own.join(up, ["host", "parent"]).select("host", "template", (off <= z).alias("alike"))
        tree = tree.join(alike, ["host", "template"]).withColumn("template", F.when(F.col("alike"), F.col("parent")).otherwise(F.col("template")))
        tree = tree.drop("alike", "parent")
    tree = materialize(tree, "tree")
    total = tree.agg(F.coalesce((F.sum("bad") + 0.0) / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("g")).first()["g"]
    judged = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    smoothed = 1.0 - (F.col("b") + prior * total) / (F.col("n") + prior)
    judged = judged.select("host", "template", F.col("n").alias("template_labelled"), F.col("b").alias("template_bad"), smoothed.alias("smoothed_purity"))
    says = F.when(F.col("smoothed_purity") < purity, "block").otherwise("allow")
    return tree.join(judged, ["host", "template"]).select("host", "pattern", "template", "template_labelled", "template_bad", "smoothed_purity", says.alias("method_verdict"))


def wildcard(level: int) -> Column:
    return F.transform("template", lambda s, i: F.when(i == level, F.lit("*")).otherwise(s))


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, *, depth: int | None = None, **tree) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template, smoothed_purity.

    ``labels``: label_id, bad (boolean; of several for one id, bad wins; null: no
    label). Null or odd urls have an empty host and path and are judged as one such
    template. Empty tables give no rows; without labels the method allows all. Rows
    that repeat are judged alike. Extra columns are ignored. Templates are joined by
    host and pattern, dealt over salts, since one host may hold a third of all pages.
    ``depth``: only so many segments of a path are told apart; None: all.
    """
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("pattern", pattern(F.col("path"), depth))
    if labels is None:
        labelled = urls.withColumn("bad", F.lit(None).cast("boolean"))
    else:
        known = labels.where("label_id is not null and bad is not null").groupBy(F.col("label_id").cast("long").alias("label_id")).agg(F.max("bad").alias("bad"))
        labelled = urls.withColumn("label_id", url_number(F.col("path"))).join(known, "label_id", "left")
    found = template_tree(labelled.select("host", "pattern", "bad"), depth=depth, **tree)
    dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<int>")))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    rows = urls.withColumn("salt", salt).join(dealt, ["host", "pattern", "salt"], "left")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.col("method_verdict")).alias("verdict"),
        F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), "smoothed_purity",
    )
