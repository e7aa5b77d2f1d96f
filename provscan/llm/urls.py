"""URL filters: rules first, then a path-template tree per host, in DataFrame functions only.

Templates are learnt from the URLs themselves, level by level from the host
down. A node of a host's tree is the prefix already generalised, so below a
wildcard all branches are one. Segments are typed first (numbers, dates, long
hexadecimal strings); a node that has many different children, each with few
continuations, is variable, and its children become one wildcard. Only
different shapes count, never how often a page occurs.

Purity goes down the same tree. Branches of one parent are put in order of
their share of blocked pages, and neighbours that do not differ by more than
chance are merged, inner branches too: what follows merged branches is pooled.
A branch's purity is its share among labelled pages, smoothed towards its
parent's, and so on up to its host's and the corpus's; templates whose purity
is above the threshold are rejected. Labels are the verdicts of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provscan.llm.scratch import Scratch

#: (verdict, rule); a rule is a host and a path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
VARIABLE_LEAST = 8  #: different children from which a node may be variable
LEVELS = 16  #: levels of a tree; what is deeper is one last segment
Z = 1.96  #: neighbouring branches whose shares differ by no more standard errors are merged
SMOOTHING = 10.0  #: labelled pages that a parent's share counts as
THRESHOLD = 0.5
END = "<end>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host or a parent domain and starts the path; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def typed(segment: Column) -> Column:
    """A segment, or the class of those that vary by their form. A dot and what follows (.html) stay."""
    form = F.regexp_replace(segment, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(\.|$)", "<date>$1")
    form = F.regexp_replace(form, r"^[0-9]+(\.|$)", "<number>$1")
    form = F.regexp_replace(form, r"^[0-9a-f-]{16,}(\.|$)", "<hex>$1")
    return F.when(form == "*", "<star>").otherwise(form)


def shape_of(path: Column) -> Column:
    """Typed segments of a path, at most LEVELS of them: whatever is deeper is the last one."""
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), typed)
    return F.when(F.size(parts) <= LEVELS, parts).otherwise(F.concat(F.slice(parts, 1, LEVELS - 1), F.array(F.array_join(F.slice(parts, F.lit(LEVELS), F.size(parts)), "/"))))


def shapes(labelled: DataFrame) -> DataFrame:
    """(host, shape array<string>, known, bad): pages by host and typed path; one row for any number of alike pages."""
    return labelled.groupBy("host", "shape").agg(F.count("verdict").alias("known"), F.count_if(F.col("verdict") == "block").alias("bad"))


def templates(shaped: DataFrame, scratch: Scratch) -> DataFrame:
    """``shaped`` with its template: segments, * where the node above them is variable.

    A node has k different children and m different pairs of a child and what
    follows it; it is variable if k >= VARIABLE_LEAST and m / k <= sqrt(k).
    Each level is two aggregations and a join on (host, node): one row a node
    on the one side, so a host of very many shapes may be split on the other.
    """
    salts = int(shaped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(min(salts, 64) - 1)))
    now = shaped.withColumns({"made": F.array().cast("array<string>"), "salt": F.pmod(F.hash("shape"), F.lit(min(salts, 64)))})
    deepest = shaped.agg(F.max(F.size("shape"))).first()[0] or 0  # at most LEVELS
    for level in range(deepest):
        segment = F.get("shape", F.lit(level))
        live = now.where(F.size("shape") > level).select("host", "made", segment.alias("child"), F.coalesce(F.get("shape", F.lit(level + 1)), F.lit(END)).alias("next"))
        kids = live.distinct().groupBy("host", "made", "child").agg(F.count("*").alias("m"))
        nodes = kids.groupBy("host", "made").agg(F.count("*").alias("k"), F.sum("m").alias("m"))
        variable = nodes.where((F.col("k") >= VARIABLE_LEAST) & (F.col("m") <= F.col("k") * F.sqrt("k"))).select("host", "made", F.lit(True).alias("variable"))
        marked = now.join(variable.withColumn("salt", spread), ["host", "made", "salt"], "left")
        part = F.when(F.size("shape") > level, F.array(F.when(F.col("variable"), "*").otherwise(segment))).otherwise(F.array())
        now = scratch.write(marked.select("host", "shape", "known", "bad", F.concat("made", part).alias("made"), "salt"), f"level-{level}")
    return now.select("host", "shape", "known", "bad", F.col("made").alias("template"))


def _smooth(bad: Column, known: Column, prior: Column) -> Column:
    return (bad + F.lit(SMOOTHING) * prior) / (known + F.lit(SMOOTHING))


def _merged(nodes: DataFrame) -> DataFrame:
    """``nodes`` (host, branch, child, known, bad, prior) with the group that each child belongs to.

    Labelled children in order of their share (ties by name); a new group starts
    where two neighbours differ by more than Z standard errors of their pooled
    share. Children without labels are one group.
    """
    share = F.col("bad") / F.col("known")
    order = Window.partitionBy("host", "branch").orderBy("share", "child")
    labelled = nodes.where("known > 0").withColumn("share", share)
    labelled = labelled.withColumns({"known0": F.lag("known").over(order), "bad0": F.lag("bad").over(order)})
    pooled = (F.col("bad") + F.col("bad0")) / (F.col("known") + F.col("known0"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("known") + 1 / F.col("known0")))
    starts = F.coalesce(F.abs(F.col("share") - F.col("bad0") / F.col("known0")) > Z * error, F.lit(False))
    group = F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = labelled.withColumn("group", group.cast("string")).select(*nodes.columns, "group")
    return numbered.unionByName(nodes.where("known = 0").withColumn("group", F.lit("-")))


def purity(templated: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, template, share): the smoothed share of blocked pages of the branch that a template ends in."""
    by = templated.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    hosts = by.groupBy("host").agg(F.sum("known").alias("h_known"), F.sum("bad").alias("h_bad"))
    total = hosts.agg(_smooth(F.coalesce(F.sum("h_bad"), F.lit(0)), F.coalesce(F.sum("h_known"), F.lit(0)), F.lit(0.5)))
    hosts = hosts.select("host", _smooth(F.col("h_bad"), F.col("h_known"), total.scalar()).alias("share"))
    now = by.join(hosts, "host").select("host", "template", "known", "bad", F.lit("").alias("branch"), "share")
    now = scratch.write(now, "branches")
    deepest = now.agg(F.max(F.size("template"))).first()[0]
    for level in range(0 if deepest is None else deepest + 1):
        child = F.coalesce(F.get("template", F.lit(level)), F.lit(END))
        # A template that ended at an earlier level keeps its share.
        live = now.where(F.size("template") >= level).withColumn("child", child)
        nodes = live.groupBy("host", "branch", "child").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"), F.first("share").alias("prior"))
        grouped = _merged(nodes)
        shares = grouped.groupBy("host", "branch", "group").agg(_smooth(F.sum("bad"), F.sum("known"), F.first("prior")).alias("share"))
        placed = grouped.select("host", "branch", "child", "group").join(shares, ["host", "branch", "group"])
        told = live.drop("share").join(placed, ["host", "branch", "child"])
        told = told.select("host", "template", "known", "bad", F.concat_ws("/", "branch", "group").alias("branch"), "share")
        now = scratch.write(told.unionByName(now.where(F.size("template") < level)), f"purity-{level}")
    return now.select("host", "template", "share")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row of ``pages``.

    Null URLs and those without :// have an empty host and path and are judged
    like other pages of that host; a template without labels is judged by its
    parent, its host and the corpus. Null or repeated ids and repeated rows keep
    their rows; an empty table gives an empty result; only the two named columns
    are read. ``pages`` is read three times: for the table of shapes, from which
    the tree is learnt, for the pages that a rule decides, and for the others.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))
    rows = rows.withColumn("shape", shape_of(F.col("path")))
    templated = templates(scratch.write(shapes(rows), "shapes"), scratch)
    shares = purity(templated, scratch)
    judged = templated.join(shares, ["host", "template"]).select("host", "shape", F.when(F.col("share") > THRESHOLD, "block").otherwise("allow").alias("learnt"))
    judged = scratch.write(judged, "judged")
    # Only pages that no rule decides look their shape up; a hot shape is spread over salts.
    salts = min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64)
    salted = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    open_ = rows.where(F.col("rule").isNull()).drop("verdict").withColumn("salt", F.pmod(F.hash("id", "path"), F.lit(salts)))
    learnt = open_.join(salted, ["host", "shape", "salt"], "left").select("id", "host", "path", "rule", F.col("learnt").alias("verdict"))
    return rows.where(F.col("rule").isNotNull()).select("id", "host", "path", "rule", "verdict").unionByName(learnt)
