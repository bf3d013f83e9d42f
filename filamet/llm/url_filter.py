"""URL filter: host and path rules first, else a tree of path templates.  DataFrame functions only.

Paths become templates at all levels together.  Numbers are written ``{n}`` at once.  A segment stays
as it is if the path up to it is shared by at least LEAST_PAGES pages of the host, however many the host
has; the next one is variable and generalises to ``*``.  What follows stays if LEAST_PAGES pages with
the same leading part have it at that place, else it is variable too.  Good and bad labels are counted per
template.  Sibling templates whose good rate does not differ from that of all siblings (two-sided z
below ``SIMILAR``) are merged into one branch and judged together.  A branch is rejected if its smoothed
purity, the good rate drawn towards the host's and that towards the overall rate, is below LEAST_PURITY.

Everything after the first aggregation works on distinct shapes of paths, with counts.  The number of
jobs and the plan do not depend on the depth of the paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamet.llm.shared import ascii_lower, stored

LEAST_PAGES = 30  # a rate of so many is near enough to normal for the z test
SIMILAR = 2.0
PRIOR = 10.0
LEAST_PURITY = 0.6
Rule = tuple[str, str, str]  # verdict, host, path

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits a host or one of its parents and the start of the path, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fit = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fit, F.lit(h + p)).otherwise(name), F.when(fit, F.lit(says)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """All segments, with numbers as {n}."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "{n}"), "/")


def _prefixes(segs: Column) -> Column:
    """Hash of every prefix of the segments."""
    grow = lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.get(acc, F.size(acc) - 1), x)))
    return F.slice(F.aggregate(segs, F.array(F.lit(0).cast("long")), grow), F.lit(2), F.size(segs))


def _templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, segs, pages) -> (host, shape, template, parent), in two aggregations whatever the depth.

    The first counts prefixes and gives each shape the length of its leading part that stays; the second
    counts what follows the first variable segment by that part, position and segment.
    """
    hashed = shapes.select("host", "shape", "pages", "segs", _prefixes(F.col("segs")).alias("hs"))
    parts = hashed.select("host", "shape", "pages", F.explode("hs").alias("h"))
    often = parts.groupBy("host", "h").agg(F.sum("pages").alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "h")
    lead = parts.join(often, ["host", "h"], "left_semi").groupBy("host", "shape").agg(F.count(F.lit(1)).cast("int").alias("k"))
    k = F.coalesce("k", F.lit(0))
    led = stored(hashed.join(lead, ["host", "shape"], "left").select("host", "shape", "pages", "segs", k.alias("k"), F.coalesce(F.get("hs", k - 1), F.lit(0)).alias("base")), "url-leads")
    after = led.select("host", "shape", "pages", "k", "base", F.posexplode("segs").alias("pos", "seg"))
    common = after.where("pos > k").groupBy("host", "base", "pos", "seg").agg(F.sum("pages").alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "base", "pos", "seg", F.lit(True).alias("common"))
    name = F.when((F.col("pos") < F.col("k")) | (F.col("common") & (F.col("pos") > F.col("k"))), F.col("seg")).otherwise("*")
    named = after.join(common, ["host", "base", "pos", "seg"], "left").groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("name")))).alias("names"))
    path = lambda names: F.array_join(F.transform(names, lambda x: F.concat(F.lit("/"), x["name"])), "")
    return named.select("host", "shape", path(F.col("names")).alias("template"), path(F.slice("names", F.lit(1), F.size("names") - 1)).alias("parent"))


def template_verdicts(shapes: DataFrame) -> DataFrame:
    """(host, shape, segs, pages, good, labelled) -> (host, shape, template, purity, verdict)."""
    named = stored(_templates(shapes), "url-templates")
    counts = shapes.join(named, ["host", "shape"]).groupBy("host", "parent", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("n"))
    siblings = counts.groupBy("host", "parent").agg(F.sum("good").alias("pg"), F.sum("n").alias("pn"))
    tested = counts.join(siblings, ["host", "parent"])
    p = F.when(F.col("pn") > 0, F.col("pg") / F.col("pn")).otherwise(0.0)
    z = F.abs(F.col("good") - F.col("n") * p) / F.sqrt(F.greatest(F.col("n") * p * (1 - p), F.lit(1e-9)))
    branch = F.when((F.col("n") == 0) | (F.col("good") == F.col("n") * p) | (z < SIMILAR), F.lit("")).otherwise(F.col("template"))
    tested = tested.withColumn("branch", branch)
    merged = tested.groupBy("host", "parent", "branch").agg(F.sum("good").alias("bg"), F.sum("n").alias("bn"))
    hosts = counts.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("n").alias("hn"))
    overall = hosts.agg(F.sum("hg").alias("g"), F.sum("hn").alias("n")).first()
    rate = (overall["g"] or 0) / overall["n"] if overall["n"] else 1.0
    smooth = lambda g, n, prior: (F.col(g) + PRIOR * prior) / (F.col(n) + PRIOR)
    purity = merged.join(hosts, "host").withColumn("purity", smooth("bg", "bn", smooth("hg", "hn", F.lit(float(rate)))))
    found = tested.select("host", "parent", "template", "branch").join(purity.select("host", "parent", "branch", "purity"), ["host", "parent", "branch"])
    out = named.join(found, ["host", "parent", "template"])
    return out.select("host", "shape", "template", "purity", F.when(F.col("purity") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", label_key: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    ``labels`` has columns key and good (1 or 0); ``label_key`` is the page's key, by default its id.
    Rules are a short list given in code.  Null urls, and urls without ``://``, have an empty host
    and path and one template.  Null ids keep their row.  Repeated pages count each time; of labels
    given twice the lower one counts.  Without labels every template passes.  An empty table gives no
    rows.  Other columns are ignored.  A very long path is an array of its segments in one row.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), (F.col(id_col) if label_key is None else label_key).cast("long").alias("key"))
    base = base.withColumn("segs", segments(F.col("path")))
    # a shape goes by its digest, so that long paths are no keys
    base = stored(base.withColumn("shape", F.md5(F.array_join("segs", "/"))), "urls")
    known = labels.where("key is not null and good is not null").groupBy("key").agg(F.min(F.col("good").cast("int")).alias("good"))
    marks = base.where("key is not null").join(known, "key").groupBy("host", "shape").agg(F.sum("good").alias("good"), F.count("good").alias("labelled"))
    shapes = base.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.min("segs").alias("segs")).join(marks, ["host", "shape"], "left").fillna(0, ["good", "labelled"])
    judged = stored(template_verdicts(stored(shapes, "url-shapes")), "url-verdicts")
    rule, says = first_rule(F.col("host"), F.col("path"), rules)
    out = base.join(judged, ["host", "shape"])
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.col("verdict")).alias("verdict"), "template", "purity")
