"""Planning of page and site archives: budgets, de-duplication, shards. Metadata moves, bodies don't."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.functions import html, urls
from webstrata.operators import order
from webstrata.operators.folds import fold
from webstrata.sources.tables import written

#: Bounds of one page's archive: fixed values.
MOST_FILES, MOST_INPUT = 100, 50 * 1024 * 1024
ENTRY_OVERHEAD = 256


@dataclass
class PagePlan:
    """What one page's archive holds so far. The page's URL is looked into when a resource asks for it."""

    final_url: str
    size: int
    files: int = 1
    known: dict[tuple, str] = field(default_factory=dict)

    @cached_property
    def origin(self) -> tuple[str, str]:
        return site_of(self.final_url)

    @cached_property
    def used(self) -> set[str]:
        return {urls.local_path(self.final_url, "text/html").lower()}


def site_of(url: str) -> tuple[str, str]:
    return urls.site_and_path(url)[:2]


def clone_plan(resources: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_INPUT) -> DataFrame:
    """(page_id, ordinal, source_url, local_path, skip) of each page's resources, in order.

    resources: page_id, final_url, html_bytes, ordinal, source_url, resource_type, mime,
    body_bytes (null: none), body_sha256, skip_reason, is_visual. A resource that does
    not fit is left out whole and costs nothing, so the choice is sequential.
    """

    def start(r: dict) -> PagePlan:
        return PagePlan(r["final_url"], r["html_bytes"] or 0)

    def choose(p: PagePlan, r: dict) -> tuple[str | None, str | None]:
        if r["skip_reason"] is not None or r["body_bytes"] is None:
            return None, r["skip_reason"] or "BODY_UNAVAILABLE"
        if not r["is_visual"] and site_of(r["source_url"]) != p.origin:
            return None, "EXTERNAL_ORIGIN"
        # stylesheets with relative references mean other things at other places
        key = (r["body_sha256"], r["mime"], r["source_url"] if r["resource_type"] == "stylesheet" else "")
        if key in p.known:
            return p.known[key], None
        if p.files >= most_files:
            return None, "FILE_COUNT_BUDGET_EXCEEDED"
        if p.size + r["body_bytes"] > most_bytes:
            return None, "CLONE_INPUT_BUDGET_EXCEEDED"
        p.known[key] = free_path(urls.local_path(r["source_url"], r["mime"]), p.used)
        p.files, p.size = p.files + 1, p.size + r["body_bytes"]
        return p.known[key], None

    def step(p: PagePlan, r: dict) -> tuple:
        return r["page_id"], r["ordinal"], r["source_url"], *choose(p, r)

    return fold(resources, ["page_id"], ["ordinal", "source_url", "body_bytes"], start, step, "page_id string, ordinal int, source_url string, local_path string, skip string")


def free_path(path: str, used: set[str]) -> str:
    candidate, k = path, 0
    while (low := candidate.lower()) in used:
        k += 1
        stem, extension = posixpath.splitext(path)
        candidate = f"{stem}_{k}{extension}"
    used.add(low)
    return candidate


def completeness(plan: DataFrame) -> DataFrame:
    """(page_id, completeness): the first of budget, truncation and gaps that a page has."""
    budget = F.max(F.coalesce(F.col("skip").isin("FILE_COUNT_BUDGET_EXCEEDED", "CLONE_INPUT_BUDGET_EXCEEDED"), F.lit(False)))
    gaps = F.max(F.col("skip").isNotNull())
    cut = F.max(F.coalesce("was_truncated", F.lit(False))) if "was_truncated" in plan.columns else F.lit(False)
    code = F.when(budget, "BUDGET_LIMITED").when(cut, "TRUNCATED_RESOURCE").when(gaps, "RESOURCE_GAPS").otherwise("COMPLETE")
    return plan.groupBy("page_id").agg(code.alias("completeness"))


def layout_representatives(pages: DataFrame) -> DataFrame:
    """Adds ``representative``: first by ordinal and id of its role, template and fingerprint; pages without a design stand alone."""
    design = F.col("semantic_role").isNotNull()
    key = F.when(design, F.struct("semantic_role", "route_template", F.coalesce("layout_fingerprint", F.lit("FINGERPRINT_UNAVAILABLE")).alias("f"), F.lit("").alias("p")))
    key = key.otherwise(F.struct(F.lit("").alias("semantic_role"), F.lit("").alias("route_template"), F.lit("LEGACY").alias("f"), F.col("page_id").alias("p")))
    rows = pages.withColumn("_key", key)
    first = rows.groupBy("job_id", "_key").agg(F.min(F.struct("ordinal", "page_id")).alias("_first"))
    joined = rows.join(first, ["job_id", "_key"])
    return joined.withColumn("representative", F.struct("ordinal", "page_id") == F.col("_first")).select(*pages.columns, "representative")


def asset_dedup(files: DataFrame) -> DataFrame:
    """Adds ``canonical_path`` to files (job_id, kind, path, sha256, content_type, file_no): equal assets share the first path.

    Equal: same hash and same extension, or MIME type where the path has none. CSS is left to css_alias_closure.
    """
    extension = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.when(extension != "", extension).otherwise(F.lower(F.trim(F.substring_index("content_type", ";", 1))))
    rows = files.withColumn("_kind", kind)
    asset = (F.col("kind") == "RESOURCE") & ~F.coalesce(F.col("content_type").startswith("text/css"), F.lit(False))
    first = rows.where(asset).groupBy("job_id", "sha256", "_kind").agg(F.min_by("path", F.struct("file_no", "path")).alias("_first"))
    out = rows.withColumn("_asset", asset).join(first, ["job_id", "sha256", "_kind"], "left")
    return out.select(*files.columns, F.when(F.col("_asset"), F.coalesce("_first", "path")).otherwise(F.col("path")).alias("canonical_path"))


def css_alias_closure(css: DataFrame, paths: DataFrame) -> DataFrame:
    """(job_id, path, source_url, canonical_path, body): stylesheets whose rewritten texts are equal become one.

    css: job_id, path, source_url, body. paths: job_id, url, path of all archived
    resources. A stylesheet is read once, as a template with places for its references,
    and rewritten once, at the end. In between, stylesheets are classes: two are equal if
    their templates are and what stands in their places; where that is a stylesheet, its
    class does. Each round compares hashes of a template and the classes in its places,
    so that classes that meet make those which refer to them meet in the next round; a
    chain of imports takes a round a link, import cycles end when a round joins nothing.
    """
    sheet = ["job_id", "path", "source_url"]
    read = written(css.select(*sheet, html.css_templates(F.col("body"), F.col("source_url")).alias("t")).select(*sheet, "t.template", "t.places"))
    places = read.select(*sheet, F.posexplode("places").alias("place", "p")).select(*sheet, "place", "p.*")
    one_path = paths.groupBy("job_id", "url").agg(F.min("path").alias("local"))
    for url in ("target", "plain"):
        places = places.join(one_path.select("job_id", F.col("url").alias(url), F.col("local").alias(f"{url}_path")), ["job_id", url], "left")
    places = written(places.select(*sheet, "place", F.coalesce("target_path", "plain_path").alias("local"), "suffix", "otherwise"))
    sheets = read.select(*sheet, "template")
    state = written(sheets.select(*sheet, F.col("path").alias("canonical_path")))
    while True:
        alias = state.groupBy("job_id", F.col("path").alias("local")).agg(F.min("canonical_path").alias("to"))
        stands = F.coalesce(F.concat(F.coalesce("to", "local"), "suffix"), "otherwise")
        filled = places.join(alias, ["job_id", "local"], "left").groupBy(*sheet).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("place", stands.alias("stands"))))), 256).alias("filled"))
        keyed = order.same(sheets, filled, sheet, "left").select(*sheet, F.concat_ws(" ", "template", "filled").alias("key"))
        first = keyed.groupBy("job_id", "key").agg(F.min("path").alias("canonical_path"))
        moved = order.same(keyed, state.select(*sheet, F.col("canonical_path").alias("was")), sheet).join(first, ["job_id", "key"])
        moved = written(moved.select(*sheet, "canonical_path", "was"))
        if moved.where("canonical_path <> was").limit(1).count() == 0:
            break
        state = moved.drop("was")
    known = places.where("local is not null").join(alias, ["job_id", "local"], "left").select(*sheet, "place", F.coalesce("to", "local").alias("to"))
    urls_of = read.select(*sheet, F.posexplode("places").alias("place", "p")).select(*sheet, "place", "p.target")
    pairs = order.same(known, urls_of, [*sheet, "place"]).groupBy(*sheet).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("target", "to")))).alias("known"))
    own = order.same(order.same(css.select(*sheet, "body"), moved.drop("was"), sheet), pairs, sheet, "left")
    return own.select(*sheet, "canonical_path", html.rewrite_css(F.col("body"), F.col("source_url"), F.col("known")).alias("body"))


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(job_id, path, canonical_path, problem): where chains of aliases (job_id, path, to) end.

    Paths are equal whatever their case. Chains are followed by pointer jumping, so that
    their length doubles each round. A chain that comes back to itself ends nowhere: its
    paths, and those that lead to them, are a problem.
    """
    folded = aliases.where(F.lower("path") != F.lower("to")).groupBy("job_id", F.lower("path").alias("key")).agg(F.min(F.struct("path", "to")).alias("first"))
    state = written(folded.select("job_id", "key", "first.path", F.col("first.to").alias("at")))
    longest = state.count()
    while longest > 0:
        further = state.select("job_id", F.col("key").alias("stop"), F.col("at").alias("further"))
        jumped = state.withColumn("stop", F.lower("at")).join(further, ["job_id", "stop"], "left")
        state = written(jumped.select("job_id", "key", "path", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("open")))
        if state.where("open").limit(1).count() == 0:
            break
        longest //= 2
    ends = state.withColumn("stop", F.lower("at")).join(state.select("job_id", F.col("key").alias("stop"), F.lit(True).alias("loops")), ["job_id", "stop"], "left")
    return ends.select("job_id", "path", F.when(F.col("loops").isNull(), F.col("at")).alias("canonical_path"), F.when(F.col("loops"), "SITE_ARCHIVE_PATH_COLLISION").alias("problem"))


def archive_files(files: DataFrame) -> DataFrame:
    """One row per path whatever its case: job_id, path, sha256, bytes, file_no, collision (two contents on one path)."""
    rows = files.groupBy("job_id", F.lower("path").alias("_path")).agg(
        F.min_by("path", "file_no").alias("path"), F.min_by("sha256", "file_no").alias("sha256"), F.min_by("bytes", "file_no").alias("bytes"),
        F.min("file_no").alias("file_no"), (F.min("sha256") != F.max("sha256")).alias("collision"),
    )
    return rows.drop("_path")


def shard_plan(files: DataFrame, most_shard: int, most_total: int) -> DataFrame:
    """(job_id, path, shard, problem): files of a job in order go to the open shard, or to a new one where it is full.

    Whether a file opens a shard depends on all before it. Running sums give each file
    its place as if all stood in one line; the shard that a file would open ends before
    the file that covers the place one shard further on: its successor. From the first
    file on, successors of successors (of twice as many each round) are the files that
    open shards. A job's files may be in many tasks; a line is cut into blocks of a
    shard's size, which at most most_shard / 256 files can start in.
    """
    need = F.col("bytes") + ENTRY_OVERHEAD + 2 * F.octet_length("path")
    line = ["file_no", "path"]
    rows = order.running_totals(files.select("job_id", "path", "bytes", "file_no", need.alias("need")), ["job_id"], line, {"total": "bytes"})
    problem = F.when(F.col("need") > most_shard, "SITE_FILE_EXCEEDS_SHARD_BUDGET").when(F.col("total") > most_total, "SITE_ARCHIVE_BUDGET_EXCEEDED")
    rows = written(rows.withColumn("problem", problem))
    placed = order.running_totals(rows.where("problem is null"), ["job_id"], line, {"stop": "need"})
    placed = written(placed.select("job_id", *line, "stop", (F.col("stop") - F.col("need")).alias("start")))

    block = lambda c: F.expr(f"{c} div {most_shard}")
    own = F.struct("start", "stop")
    asked = placed.select("job_id", (F.col("start") + most_shard).alias("at"), F.lit(1).alias("kind"), "start", F.lit(None).cast("struct<start:bigint,stop:bigint>").alias("file"))
    there = placed.select("job_id", F.col("start").alias("at"), F.lit(0).alias("kind"), "start", own.alias("file"))
    upto = Window.partitionBy("job_id", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(there).withColumn("block", block("at")).withColumn("last", F.last("file", ignorenulls=True).over(upto)).where("kind = 1")
    ends = placed.groupBy("job_id", (block("start") + 1).alias("block")).agg(F.max(own).alias("before"))
    found = found.join(ends, ["job_id", "block"], "left").withColumn("file", F.coalesce("last", "before"))
    jump = written(found.where("file.stop > at").select("job_id", "start", F.col("file.start").alias("next")))
    opened = written(placed.where("start = 0").select("job_id", "start"))
    while True:
        more = opened.join(jump, ["job_id", "start"]).select("job_id", F.col("next").alias("start"))
        grown = written(opened.unionByName(more).distinct())
        if grown.count() == opened.count():
            break
        opened = grown
        jump = written(jump.join(jump.select("job_id", F.col("start").alias("next"), F.col("next").alias("further")), ["job_id", "next"]).select("job_id", "start", F.col("further").alias("next")))
    flagged = placed.join(opened.withColumn("opens", F.lit(1)), ["job_id", "start"], "left")
    numbered = order.running_totals(flagged.select("job_id", *line, F.coalesce("opens", F.lit(0)).alias("opens")), ["job_id"], line, {"shard": "opens"})
    left_out = rows.where("problem is not null").select("job_id", "path", F.lit(None).cast("int").alias("shard"), "problem")
    return numbered.select("job_id", "path", F.col("shard").cast("int").alias("shard"), F.lit(None).cast("string").alias("problem")).unionByName(left_out)


def object_dedup(objects: DataFrame) -> DataFrame:
    """One object per owner, hash, size and kind; never across owners."""
    rest = [c for c in objects.columns if c not in ("owner_id", "sha256", "bytes", "kind")]
    rows = objects.groupBy("owner_id", "sha256", "bytes", "kind").agg(F.min_by(F.struct(*rest), "object_id").alias("_row"), F.count(F.lit(1)).alias("copies"))
    return rows.select("owner_id", "sha256", "bytes", "kind", "_row.*", "copies")


def collectable_objects(objects: DataFrame, references: DataFrame, now: Column) -> DataFrame:
    due = objects.where((F.col("status") == "DELETE_PENDING") & (F.col("delete_after") <= now))
    return due.join(references.select("object_id"), "object_id", "left_anti")


def clone_counters(pages: DataFrame) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    done = F.count_if(is_("SUCCEEDED") | is_("FAILED"))
    return pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("candidates"), done.alias("processed"), F.count_if(is_("SUCCEEDED")).alias("succeeded"), F.count_if(is_("FAILED")).alias("failed"),
        F.count_if(is_("QUEUED")).alias("queued"), F.count_if(is_("RUNNING")).alias("running"), F.count_if(is_("CANCELLED")).alias("cancelled"),
        F.sum(F.when(is_("SUCCEEDED"), F.col("input_bytes")).otherwise(0)).alias("input_bytes"), F.floor(done * 100 / F.count(F.lit(1))).alias("percent"),
    )


def reason_counts(pages: DataFrame) -> DataFrame:
    """(job_id, reasons): a map of the reasons that occur, in order."""
    rows = pages.where("reason is not null").groupBy("job_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))


def archive_counts(pages: DataFrame) -> DataFrame:
    """Counts of a site archive and its completeness: failures, then cancellations, then gaps."""
    chosen = F.coalesce("representative", F.lit(False))
    code = (
        F.when(F.max(F.col("status") == "FAILED"), "PARTIAL_RENDER_FAILURE").when(F.max(F.coalesce(F.col("reason") == "CANCELLED", F.lit(False))), "PARTIAL_CANCELLED")
        .when(F.max(chosen & (F.col("resource_gaps") > 0)), "PARTIAL_RESOURCE_GAPS").otherwise("REPRESENTATIVE_COMPLETE")
    )
    group = F.when(chosen, F.concat_ws("\n", F.coalesce("semantic_role", F.lit("UNKNOWN")), F.coalesce("route_template", "local_path")))
    return pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("discovered"), F.count("reason").alias("rejected"), F.count_distinct(group).alias("grouped"),
        F.count_if("rendered").alias("rendered"), F.count_if(chosen).alias("packaged"), code.alias("completeness"),
    )


def clone_page_list(pages: DataFrame, *, after: int = -1, status: str | None = None, query: str = "", n: int = 50) -> DataFrame:
    out = pages.where(F.col("ordinal") > after)
    if status:
        out = out.where(F.col("status") == status)
    if query:
        out = out.where(F.contains(F.lower("url"), F.lit(query.lower())))
    return out.orderBy("ordinal").limit(n + 1)
