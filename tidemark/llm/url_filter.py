"""URL filter: given rules first, else a path-template tree per host (DataFrame functions).

Pages that a rule decides are the labelled ones. Paths of a host form a tree of segments; numbers and long identifiers
become wildcards by their form, other segments where a parent has many rare children. Branches whose labelled block
rates don't differ significantly from their parent's are merged into one pool. A template's purity is the block rate
of its pool, smoothed towards its parent's, and pages of a template that is pure enough are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

# The given rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Levels whose tables are read side by side before they are written as one.
SIDE_BY_SIDE = 32
#: A literal segment is variable if its parent has so many children and it holds less than this share of its pages.
CHILDREN, RARE = 20, 0.02
#: Strength of smoothing, rejected purity, and the significance bound of the two-rate test.
SMOOTH, PURE, Z = 4.0, 0.8, 2.58

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty when it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def _segments(path: Column) -> Column:
    """Path segments with numbers and long identifiers as wildcards."""
    own = F.split(F.regexp_replace(path, "^/", ""), "/")
    own = F.transform(own, lambda s: F.when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{12,}$"), F.lit("{id}"))
                      .otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(own)


def _with(done: DataFrame | None, level: DataFrame, k: int) -> DataFrame:
    """``done`` and the rows of level ``k``; plans stay short however deep the tree is."""
    both = level if done is None else done.unionByName(level)
    return written(both) if k % SIDE_BY_SIDE == SIDE_BY_SIDE - 1 else both


def _templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, segments, pages, labelled, blocked) with ``nodes``: the templates on the way to its own."""
    depth = shapes.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0]
    t = shapes.withColumn("at", F.lit("")).withColumn("nodes", F.array(F.lit("")))
    done = None
    for k in range(depth):                       # a path takes part in the levels it has
        done = _with(done, t.where(F.size("segments") == k), k)
        t = t.where(F.size("segments") > k).withColumn("child", F.get("segments", F.lit(k)))
        children = t.groupBy("host", "at", "child").agg(F.sum("pages").alias("own_pages"))
        parents = (children.groupBy("host", "at")
                   .agg(F.count(F.lit(1)).alias("n_children"), F.sum("own_pages").alias("all_pages")))
        rare = (children.join(parents, ["host", "at"])
                .where((F.col("n_children") >= CHILDREN) & (F.col("own_pages") < RARE * F.col("all_pages")))
                .select("host", "at", "child", F.lit(True).alias("rare")))
        step = F.concat("at", F.lit("/"), F.when(F.col("rare"), F.lit("{v}")).otherwise(F.col("child")))
        t = (t.join(rare, ["host", "at", "child"], "left")
             .withColumn("at", step).withColumn("nodes", F.concat("nodes", F.array("at")))
             .drop("child", "rare"))
        t = written(t)
    return _with(done, t, depth)


def template_purity(shapes: DataFrame) -> DataFrame:
    """(host, node, purity, evidence): smoothed block rate of every template, evidence its pool's labelled pages."""
    node = F.explode(F.transform("nodes", lambda x, i: F.struct(x.alias("node"), i.alias("depth"), F.get(
        "nodes", i - 1).alias("parent"))))
    nodes = written(shapes.select("host", "labelled", "blocked", node.alias("s"))
                    .groupBy("host", "s.node", "s.depth", "s.parent")
                    .agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")))
    top = shapes.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0)),
                     F.coalesce(F.max(F.size("nodes")), F.lit(0))).first()
    prior = (top[0] + 1.0) / (top[1] + 2.0)
    rate = lambda b, n, p: (b + SMOOTH * p) / (n + SMOOTH)
    level = (nodes.where("depth = 0")
             .select("host", "node", "labelled", "blocked",
                     rate(F.col("blocked"), F.col("labelled"), F.lit(prior)).alias("purity"),
                     F.col("labelled").alias("evidence")))
    done = level
    for k in range(1, top[2]):
        up = level.select("host", F.col("node").alias("parent"), F.col("purity").alias("p"),
                          F.col("labelled").alias("up_n"), F.col("blocked").alias("up_b"))
        c = nodes.where(F.col("depth") == k).join(up, ["host", "parent"])
        n, m = F.col("labelled"), F.col("up_n") - F.col("labelled")
        pooled = F.col("up_b") / F.col("up_n")
        apart = F.abs(F.col("blocked") / n - (F.col("up_b") - F.col("blocked")) / m)
        differs = F.when((n > 0) & (m > 0), apart > Z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m)))
        c = c.withColumn("alone", F.coalesce(differs, F.lit(False)))
        pool = (c.where("not alone").groupBy("host", "parent")
                .agg(F.sum("labelled").alias("pool_n"), F.sum("blocked").alias("pool_b")))
        c = c.join(pool, ["host", "parent"], "left")
        b = F.when(F.col("alone"), F.col("blocked")).otherwise(F.col("pool_b"))
        e = F.when(F.col("alone"), F.col("labelled")).otherwise(F.col("pool_n"))
        level = written(c.select("host", "node", "labelled", "blocked", rate(b, e, F.col("p")).alias("purity"),
                                 e.alias("evidence")))
        done = _with(done, level, k)
    return done.select("host", "node", "purity", "evidence")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict (allow or block), template,
    purity (null where a rule decides).

    The longest rule (host and path) that fits decides; a rule fits its host and all subdomains if the path starts
    with its path. Other pages are blocked if their template's purity is ``PURE`` or more on some labelled evidence,
    else allowed. A null url and one without ``://`` have an empty host and path and are judged like any other.
    Null page_ids and repeated rows are judged row by row. An empty table gives no rows."""
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("segments", _segments(F.col("path")))
    shapes = (p.groupBy("host", "segments")
              .agg(F.count(F.lit(1)).alias("pages"), F.count("hit.verdict").alias("labelled"),
                   F.count(F.when(F.col("hit.verdict") == "block", 1)).alias("blocked")))
    shapes = _templates(written(shapes))
    purity = template_purity(shapes)
    judged = (shapes.select("host", "segments", F.col("at").alias("node")).join(purity, ["host", "node"])
              .select("host", "segments", F.col("node").alias("template"), "purity", "evidence"))
    rejected = (F.col("purity") >= PURE) & (F.col("evidence") > 0)
    return (p.join(written(judged), ["host", "segments"], "left")
            .select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce(F.col("hit.verdict"), F.when(rejected, "block").otherwise("allow")).alias("verdict"),
                    "template", F.when(F.col("hit").isNull(), F.col("purity")).alias("purity")))
