"""URL filters: fixed host and path rules first, then a path-template tree learnt from labels.

The tree, per host: a path's segments are its levels. Segments with a digit and very long
ones become wildcards. Then level by level from the root: where a node's children are nearly all
different (``VARIABLE_CHILDREN`` of them or more, ``VARIABLE_SHARE`` of the node's pages or
more) they become one wildcard child, and the next level is judged below that.
Sibling templates, which differ in their last fixed segment only, are merged into one
branch when their share of bad pages does not differ significantly (two-proportion z test)
from that of the other siblings; that is done again until nothing moves, at most once for each
level. A template that is alone among the host's paths of its length has nothing to merge with.
A template is rejected when its purity, the share of bad pages smoothed towards its host's and
that towards the overall share, reaches ``REJECT_PURITY``. A template without a labelled page
takes the smoothed share of its parent, the branch that its siblings would share; where that has
none either, this is its host's. All of it is grouping and joining on (host, template): the
pages are reduced to templates first, so a host of any size is a few template rows.

Defined results: a null url, or one without ``://``, has an empty host and path and is
judged by the template of those; a null page id has no label; several labels of one id
count once, bad if any is; very long urls are judged whole (a path of many levels costs levels
only while ten paths share them); repeated rows each come back; of shares that tie, none differs;
empty tables give empty tables and a missing label table means that nothing is rejected. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.llm.common import read, store

#: (host, path prefix, verdict); a rule holds for the host and its subdomains.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"),
         ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILDCARD = "*"
LONG_SEGMENT = 40
VARIABLE_CHILDREN = 10
VARIABLE_SHARE = 0.3
MERGE_Z = 1.96
SMOOTHING = 4.0
REJECT_PURITY = 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as text) and its verdict, null where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = (F if name is None else name).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name.otherwise(none), verdict.otherwise(none))


def _segments(path: Column) -> Column:
    """Path levels, the plainly variable ones already as wildcards."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(
        s.rlike(r"[0-9]") | (F.length(s) > LONG_SEGMENT), F.lit(WILDCARD)).otherwise(s))


def _generalise(leaves: DataFrame) -> DataFrame:
    """``leaves(host, shape, segs, n, labelled, bad)`` with ``template``, level by level.

    A leaf is done at its last level, or where fewer than ``VARIABLE_CHILDREN`` leaves share its
    node: no level below can be variable then.
    """
    done = []
    active = leaves.withColumn("prefix", F.array().cast("array<string>"))
    while True:
        level = F.size("prefix")
        rows = active.withColumn("child", F.get("segs", level))
        nodes = (rows.groupBy("host", "prefix", "child").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("n"))
                     .groupBy("host", "prefix").agg(F.sum("leaves").alias("leaves"),
                                                    F.sum(F.when(F.col("child").isNotNull(), F.col("n"))).alias("pages"),
                                                    F.count("child").alias("children")))
        variable = (F.col("children") >= VARIABLE_CHILDREN) & (F.col("children") >= VARIABLE_SHARE * F.col("pages"))
        few = (F.col("leaves") < VARIABLE_CHILDREN) | F.col("child").isNull()
        rest = F.slice("segs", level + 1, F.size("segs"))
        step = F.when(few, rest).otherwise(F.array(F.when(variable, F.lit(WILDCARD)).otherwise(F.col("child"))))
        rows = store(rows.join(nodes, ["host", "prefix"]).select(
            "host", "shape", "segs", "n", "labelled", "bad", F.concat("prefix", step).alias("prefix"),
            few.alias("done")), "url-levels")
        done.append(rows.where("done"))
        active = rows.where("NOT done").drop("done")
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).select(
        "host", "shape", F.array_join("prefix", "/").alias("template"), "labelled", "bad")


def _parent(template: Column) -> Column:
    """The template with its last fixed segment as a wildcard."""
    segs = F.split(template, "/")
    last = F.array_max(F.transform(segs, lambda s, i: F.when(s != WILDCARD, i)))
    return F.when(last.isNull() | (template == ""), template).otherwise(F.array_join(
        F.transform(segs, lambda s, i: F.when(i == last, F.lit(WILDCARD)).otherwise(s)), "/"))


def _with_pool(t: DataFrame) -> DataFrame:
    """``t(host, template, labelled, bad)`` with its parent and the parent's sums."""
    t = t.withColumn("parent", _parent(F.col("template")))
    pool = t.groupBy("host", "parent").agg(F.sum("labelled").alias("all_labelled"),
                                           F.sum("bad").alias("all_bad"))
    return t.join(pool, ["host", "parent"])


def _sums(moves: DataFrame) -> DataFrame:
    return moves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def _merge_round(moves: DataFrame) -> DataFrame:
    """Move templates that do not differ from their siblings into the common branch.

    ``moves(host, first, template, labelled, bad)``: the branch ``template`` that each template
    ``first`` has come to; ``moved`` tells which rows this round moves.
    """
    t = _with_pool(_sums(moves))
    length = F.when(F.col("template") == "", 0).otherwise(F.size(F.split("template", "/")))
    t = t.withColumn("length", length)
    others = t.groupBy("host", "length").agg(F.count(F.lit(1)).alias("peers"))
    t = t.join(others, ["host", "length"])
    rest_n, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    # Null, so not different, where either side has no label.
    share = F.try_divide("all_bad", "all_labelled")
    one = F.lit(1.0)
    spread = share * (1 - share) * (F.try_divide(one, "labelled") + F.try_divide(one, rest_n))
    gap = F.abs(F.try_divide("bad", "labelled") - F.try_divide(rest_bad, rest_n))
    differs = (spread > 0) & (gap > MERGE_Z * F.sqrt(spread))
    stays = (F.col("peers") < 2) | F.coalesce(differs, F.lit(False))
    to = t.select("host", "template", F.when(stays, F.col("template")).otherwise(F.col("parent")).alias("branch"))
    return moves.join(to, ["host", "template"]).select(
        "host", "first", F.col("branch").alias("template"), "labelled", "bad",
        (F.col("branch") != F.col("template")).alias("moved"))


def template_tree(pages: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``(host, shape, template, purity, rejected)``: one row per host and path shape.

    ``pages(page_id, host, shape, segs)``; ``labels(doc_id, quality, toxic)``. ``purity`` is
    the smoothed share of bad pages (quality 0 or toxic 1).
    """
    p = pages.select("page_id", "host", "shape", "segs")
    if labels is None:
        p = p.withColumn("is_bad", F.lit(None).cast("int"))
    else:
        bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
        marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
            F.max(bad.cast("int")).alias("is_bad"))
        p = p.join(marks, "page_id", "left")
    leaves = p.groupBy("host", "shape", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("is_bad").alias("labelled"),
        F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    # Every step reads its input several times, so each is stored: these tables have one row
    # per host and shape, and the plans stay as small as one step.
    leaves = store(_generalise(store(leaves, "url-leaves")), "url-templates")
    moves = _sums(leaves).select("host", F.col("template").alias("first"), "template", "labelled", "bad")
    while True:
        moves = store(_merge_round(moves), "url-branches")
        if moves.where("moved").isEmpty():
            break
        moves = moves.drop("moved")
    t = _with_pool(_sums(moves))
    hosts = t.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    overall = hosts.agg(F.sum("hl").alias("labelled"), F.sum("hb").alias("bad")).first()
    base = F.lit(float(overall.bad / overall.labelled) if overall.labelled else 0.0)
    hosts = hosts.select("host", "hl", (
        (F.col("hb") + SMOOTHING * base) / (F.col("hl") + SMOOTHING)).alias("host_share"))
    own = F.col("labelled") > 0
    n, bad = (F.when(own, F.col(a)).otherwise(F.col(b)) for a, b in (("labelled", "all_labelled"), ("bad", "all_bad")))
    t = t.join(hosts, "host").withColumn("purity", (bad + SMOOTHING * F.col("host_share")) / (n + SMOOTHING))
    t = t.withColumn("rejected", (F.col("hl") > 0) & (F.col("purity") >= REJECT_PURITY))
    branch = moves.select("host", F.col("first").alias("template"), F.col("template").alias("branch")).join(
        t.select("host", F.col("template").alias("branch"), "purity", "rejected"), ["host", "branch"])
    return leaves.select("host", "shape", "template").join(branch, ["host", "template"]).select(
        "host", "shape", F.col("branch").alias("template"), "purity", "rejected")


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id",
                url_col: str = "url", rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` of every page."""
    host, path = host_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumn("segs", _segments(F.col("path")))
    p = p.withColumn("shape", F.array_join("segs", "/"))
    tree = template_tree(p, labels)
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", "shape", rule.alias("rule"), ruled.alias("ruled"))
    p = p.join(tree, ["host", "shape"], "left")
    learnt = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return p.select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", learnt).alias("verdict"), "template",
                    F.round("purity", 6).alias("purity"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page, learnt from the labels of the same ids."""
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"),
                       read(spark, sf_dir, "labels"))
