"""URL filters: a path-template tree, built with DataFrame operations alone.

Urls are first reduced to distinct (host, segments) with their counts, so a host with a third of all rows is a
few sums. Level by level below each host, down to the paths' ends, a segment stays literal if LEAST urls or more have it,
else it becomes `*`: too few to judge by themselves, whatever the size of the host. Literal siblings whose subtrees have the same make-up and whose labelled rates differ by no more than
chance are merged (`{first}`). A leaf template is rejected if its smoothed share of bad labels reaches `reject`.
Fixed rules come first: the longest that fits decides.

Defined results: a null url, or one without `://`, has an empty host and path; unlabelled templates are allowed;
repeated rows are judged each; an empty table gives no rows; extra columns are ignored. A template with fewer than
LEAST urls has no literal segments below it, so the levels end where no more urls share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, tidy

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LEAST = 8  # urls that a literal segment has at least
PRIOR = 4.0  # weight of the corpus' rate in a template's rate
DOUBT = 20.0  # good rows added to the corpus' rate
REJECT = 0.5
Z = 1.96


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is the outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def kind(seg: Column) -> Column:
    """A coarse class of a segment: none, number, word or mixed."""
    return F.when(seg.isNull(), "-").when(seg.rlike(r"^[0-9]+$"), "n").when(seg.rlike(r"^[^0-9]+$"), "w").otherwise("x")


def level(rows: DataFrame, d: int) -> DataFrame:
    """rows, all with a segment at level d, with it added to their templates."""
    at = rows.withColumn("seg", F.get("segs", F.lit(d)))
    after = F.get("segs", F.lit(d + 1))
    literal = at.groupBy("template", "seg").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.array_join(F.sort_array(F.collect_set(kind(after))), "").alias("make")
    ).filter(F.col("n") >= LEAST)
    # siblings are compared to those of the same make whose rates are in the same quarter, by one sum and not in pairs
    quarter = F.floor(4 * (F.col("bad") + 0.5) / (F.col("labelled") + 1)).cast("string")
    literal = stored(literal.withColumn("make", F.concat("make", F.lit(":"), quarter)), "url-children")
    groups = literal.groupBy("template", "make").agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("rate"))
    gap = F.abs(F.col("bad") - F.col("rate") * F.col("labelled"))
    alike = gap <= Z * F.sqrt(F.col("labelled") * F.col("rate") * (1 - F.col("rate")))
    judged = literal.join(groups, ["template", "make"]).withColumn("alike", alike)
    merged = judged.filter("alike").groupBy("template", "make").agg(F.min("seg").alias("first"), F.count("*").alias("k"))
    one = F.concat(F.lit("{"), "first", F.lit(":"), "make", F.lit("}"))
    named = judged.join(merged, ["template", "make"], "left").select("template", "seg", F.when(F.col("alike") & (F.col("k") > 1), one).otherwise(F.col("seg")).alias("name"))
    out = at.join(named, ["template", "seg"], "left").withColumn("template", F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*"))))
    return out.drop("seg", "name")


def leaves(urls: DataFrame) -> DataFrame:
    """(host, path, template) of each distinct url; urls: host, path, bad (1, 0 or null: not labelled)."""
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    now = stored(paths.withColumn("segs", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.col("host")), "url-paths")
    out, d = None, 0
    while True:
        # paths that end here, and those whose template too few urls share: the rest of theirs are wildcards
        shared = now.filter(F.size("segs") > d).groupBy("template").agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST).select("template")
        on = now.filter(F.size("segs") > d).join(shared, "template", "left_semi")
        rest = now.filter(F.size("segs") > d).join(shared, "template", "left_anti")
        rest = rest.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.size("segs") - d)))
        ended = now.filter(F.size("segs") <= d).unionByName(rest)
        out = ended if out is None else out.unionByName(ended)
        if shared.isEmpty():
            return out
        now = stored(level(on, d), "url-level")
        d += 1


@tidy
def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template. labels: page_id, bad (0 or 1)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = labels.filter("page_id is not null and bad is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").cast("int").alias("bad"))
    tree = stored(leaves(base.join(known, "page_id", "left")), "url-tree")
    stats = tree.groupBy("template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    overall = stats.agg((F.sum("bad") / (F.sum("labelled") + DOUBT)).alias("prior"))  # one row
    purity = (F.col("bad") + PRIOR * F.coalesce("prior", F.lit(0.0))) / (F.col("labelled") + PRIOR)
    rejected = stats.crossJoin(F.broadcast(overall)).select("template", ((F.col("labelled") > 0) & (purity >= REJECT)).alias("rejected"))
    by_path = tree.join(rejected, "template").select("host", "path", "template", "rejected")
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    out = base.join(by_path, ["host", "path"], "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template")
    return stored(out, "url-verdicts", keep=True)
