"""URL filters by a path-template tree for each host.

The tree of a host is grown level by level from the root; a level is one segment of the paths, and all segments count.

- Variable segments: a child of a node keeps its name if it holds at least NAMED of the node's urls, so a node has a few
  named children; all others (numbers, keys, slugs: however many pages there are, each is a small share) become
  wildcards by their class of writing.
- Similar branches: children of a node with the same class of writing, and the same usual classes in what follows, are
  merged where the Wilson intervals of their shares of blocked urls overlap. Children without labels say nothing against
  any share, so they join where all labelled ones of their kind have become one branch; else they form one of their own.

Labels are the urls that the host and path rules judge. A template, the way from the root to a path's end, is rejected
by its smoothed labelled purity: the share of blocked ones among its labelled urls, drawn towards PRIOR by STRENGTH urls;
templates without labels are allowed.

All steps are DataFrame operations on counts: urls are first counted by host and path, children by node and segment.
Both combine before the shuffle; a node, segment or page with a large share of all rows is looked up in a broadcast table
of at most a few such for each partition. There are as many rounds as the longest path has segments.

Defined results: a null url and one without `://` have empty host and path, no rule, and are judged like others of that
host; repeated pages are judged each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import looked_up, with_totals
from tessera.session import written

#: Share of a node's urls from which a child keeps its name.
NAMED = 1 / 16
#: Share of blocked urls towards which a template's share is drawn, and the number of urls which that is worth.
PRIOR, STRENGTH = 0.3, 4.0
#: Templates with a smoothed share of this much are rejected.
REJECT = 0.6
#: The labelling rules (host, path prefix, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def class_of(segment: Column) -> Column:
    """The class of writing of a segment: number, hexadecimal run, UUID, words, or mixed, with its file extension."""
    extension = F.regexp_extract(segment, r"(?s)[^.](\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(extension))
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "{u}")
        .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F]{12,}$"), "{h}")
        .when(stem.rlike(r"[0-9]"), "{x}")
        .otherwise("{w}")
    )
    return F.concat(kind, F.lower(extension))


def _wilson(blocked: Column, labelled: Column) -> tuple[Column, Column]:
    """The interval of the share of blocked urls, at 1.96 standard errors."""
    n, z = F.greatest(labelled, F.lit(1)).cast("double"), 1.96
    p = blocked / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


_COUNTS = ["n", "blocked", "labelled"]


def _branches(children: DataFrame) -> DataFrame:
    """(host, node, label, branch, name, purity, _rows) for the children (host, node, label, kind, after, counts) of all nodes."""
    groups = children.groupBy("host", "node", "label").agg(*[F.sum(c).alias(c) for c in _COUNTS], F.max("kind").alias("kind"), F.max_by("after", F.struct("n", "after")).alias("after"), F.count(F.lit(1)).alias("_rows"))
    low, high = _wilson(F.col("blocked"), F.col("labelled"))
    told = F.col("labelled") > 0
    alike = Window.partitionBy("host", "node", "kind", "after")  # a few named children, and one for each class of writing
    groups = groups.withColumns({"low": F.when(told, low).otherwise(2.0), "high": F.when(told, high)})
    rising = alike.orderBy("low", "label")
    before = F.max("high").over(rising.rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("begins", told & (before.isNull() | (F.col("low") > before)))
    groups = groups.withColumn("island", F.sum(F.col("begins").cast("int")).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    groups = groups.withColumn("islands", F.max("island").over(alike))
    groups = groups.withColumn("island", F.when(told | (F.col("islands") == 1), F.col("island")).otherwise(0))
    whole = Window.partitionBy("host", "node", "kind", "after", "island")
    purity = (F.sum("blocked").over(whole) + PRIOR * STRENGTH) / (F.sum("labelled").over(whole) + STRENGTH)
    name = F.when((F.count(F.lit(1)).over(whole) == 1) & F.col("label").startswith("="), F.substring("label", 2, 1 << 30)).otherwise(F.col("kind"))
    branch = F.xxhash64("node", "kind", "after", "island")
    return groups.select("host", "node", "label", branch.alias("branch"), name.alias("name"), purity.alias("purity"), "_rows")


def tree(urls: DataFrame) -> DataFrame:
    """(host, path, template, purity, rejected, _rows) for each path; urls: host, path and the struct `rule`. _rows counts its urls."""
    verdict = F.col("rule.verdict")
    counts = [F.count(F.lit(1)).alias("n"), F.count(F.when(verdict == "block", 1)).alias("blocked"), F.count(verdict).alias("labelled")]
    paths = urls.groupBy("host", "path").agg(*counts)
    rest = F.filter(F.split("path", "/"), lambda s: s != "")
    active = written(paths.select("host", "path", *_COUNTS, rest.alias("rest"), F.lit(0).cast("long").alias("node"), F.lit("").alias("template")))
    ended: list[DataFrame] = []
    while not ended or not active.isEmpty():
        segment = F.coalesce(F.get("rest", F.lit(0)), F.lit(""))  # empty where the path has ended
        here = active.withColumn("segment", segment)
        after = F.array_join(F.transform(F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1))), lambda s: F.regexp_extract(class_of(s), r"^\{.\}", 0)), "/")
        kinds = here.groupBy("host", "node", "segment", after.alias("after")).agg(*[F.sum(c).alias(c) for c in _COUNTS], F.count(F.lit(1)).alias("paths"))
        usual = F.max_by("after", F.struct("n", "after")).alias("after")
        children = kinds.groupBy("host", "node", "segment").agg(usual, *[F.sum(c).alias(c) for c in [*_COUNTS, "paths"]])
        children = with_totals(written(children), ["host", "node"], urls=F.sum("n"))
        kind = F.when(F.col("segment") == "", "").otherwise(class_of(F.col("segment")))
        label = F.when(F.col("segment") == "", "").when(F.col("n") >= NAMED * F.col("urls"), F.concat(F.lit("="), F.col("segment"))).otherwise(F.concat(F.lit("~"), kind))
        children = written(children.withColumns({"kind": kind, "label": label}))
        children = looked_up(children, written(_branches(children)), ["host", "node", "label"])
        placed = looked_up(here, children.select("host", "node", "segment", "branch", "name", "purity", F.col("paths").alias("_rows")), ["host", "node", "segment"])
        placed = written(placed)
        ended.append(placed.where(F.col("segment") == "").select("host", "path", "template", "purity", F.col("n").alias("_rows")))
        longer = placed.where(F.col("segment") != "")
        step = F.concat("template", F.lit("/"), "name")
        active = longer.select("host", "path", *_COUNTS, F.slice("rest", 2, F.size("rest")).alias("rest"), F.col("branch").alias("node"), step.alias("template"))
    found = reduce(DataFrame.unionByName, ended)
    return found.withColumn("template", F.when(F.col("template") == "", "/").otherwise(F.col("template"))).withColumn("rejected", F.col("purity") >= REJECT)


def judge(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, labels: Column | None = None) -> DataFrame:
    """(row, host, path, rule, verdict, template, purity): each page's verdict, its rule's or else its template's.

    labels, a condition on `row`, tells from which ruled pages the method may learn (all of them unless given).
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(url_col).alias("url"))
    urls = rows.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    learned = urls if labels is None else urls.withColumn("rule", F.when(labels, F.col("rule")))
    judged = looked_up(urls, written(tree(learned.select("host", "path", "rule"))), ["host", "path"])
    learnt = F.when(F.col("rejected"), "block").otherwise("allow")
    verdict = F.coalesce(F.col("rule.verdict"), learnt)
    return judged.select("row", "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"), learnt.alias("learnt"))
