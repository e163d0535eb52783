"""URL filtering by rules and by a tree of path templates per host.

Variable segments become wildcards, sibling branches whose labelled rates do
not differ are merged, and templates whose purity, smoothed towards that of the
branch above, is too low are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import join_salted, written

ANY = "*"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; ``rules`` are (rule, verdict) pairs.

    A rule ``host/path`` fits its host and all subdomains if the path starts
    with the rule's.  Rules are a parameter: a list of at most some hundreds.
    """
    which, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        which, what = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(verdict)).otherwise(what)
    return which, what


def masked(path: Column) -> Column:
    """The segments as an array; numbers and long hexadecimal ones are wildcards.

    A file extension stays, as in ``*.html``; a trailing slash shows as an empty last segment.
    """
    segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    variable = r"^(?:[0-9]+|[0-9a-fA-F-]{16,})((?:\.[A-Za-z]{1,5})?)$"
    return F.transform(segments, lambda s: F.regexp_replace(s, variable, r"*$1"))


def _generalise(tree: DataFrame, at: int, distinct_least: int, distinct_share: float, z: float, labelled_least: int) -> DataFrame:
    """Segment ``at`` (from 0): many rare values become ``*``; so do siblings that differ from the rest no more than chance has it."""
    segment, above = F.get("template", F.lit(at)), F.slice("template", 1, at)
    child = tree.select("host", above.alias("above"), segment.alias("segment"), "n", "labelled", "bad").filter("segment IS NOT NULL")
    child = child.groupBy("host", "above", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    parent = child.groupBy("host", "above").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
    )
    rate = F.try_divide("all_bad", "all_labelled")
    others, bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    enough = (F.col("labelled") >= labelled_least) & (others >= labelled_least)
    error = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), others)))
    alike = enough & (F.abs(F.try_divide("bad", "labelled") - F.try_divide(bad, others)) <= z * error + 1e-12)
    variable = (F.col("kinds") >= distinct_least) & (F.col("kinds") >= distinct_share * F.col("all_n"))
    merged = child.join(parent, ["host", "above"]).filter(variable | F.coalesce(alike, F.lit(False)))
    merged = merged.select("host", "above", "segment", F.lit(ANY).alias("to"))
    return (
        tree.withColumn("above", above)
        .withColumn("segment", segment)
        .join(merged, ["host", "above", "segment"], "left")
        .withColumn(
            "template",
            F.when(F.col("to").isNotNull(), F.transform("template", lambda x, i: F.when(i == at, F.lit(ANY)).otherwise(x))).otherwise(
                F.col("template")
            ),
        )
        .select("host", "shape", "template", "n", "labelled", "bad")
    )


def template_tree(
    urls: DataFrame,
    distinct_least: int = 20,
    distinct_share: float = 0.5,
    z: float = 1.96,
    labelled_least: int = 5,
    weight: float = 10.0,
    purity_least: float = 0.7,
) -> DataFrame:
    """host, shape, template, purity, rejected, n for every distinct (host, shape) of ``urls``.

    ``urls`` has host, shape (segments as ``masked`` gives them), bad (1, 0,
    or null without a label) and n (pages).  Level by level, down to the longest
    shape's last, a segment becomes a wildcard if its parent has at least
    ``distinct_least`` kinds of it, ``distinct_share`` of its pages, or if its
    rate of bad pages and that of its siblings, with ``labelled_least`` labels
    each, lie within ``z`` standard errors of their difference.  A branch with
    fewer labels keeps its name and leans on the branch above: purity = (good +
    weight * purity above) / (labelled + weight), and above a host's root stands
    the good rate of all labels.  A template with labels, or with
    ``labelled_least`` in the branch above, is rejected if its purity is under
    ``purity_least``.
    """
    n = F.col("n").cast("long")
    tree = urls.groupBy("host", "shape").agg(
        F.sum(n).alias("n"), F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), n)), F.lit(0)).alias("labelled"), F.coalesce(F.sum(F.col("bad") * n), F.lit(0)).alias("bad")
    )
    tree = written(tree.withColumn("template", F.col("shape")), "tree")
    sizes = sorted(r["size"] for r in tree.select(F.size("shape").alias("size")).distinct().collect())
    done = []
    for at in range(max(sizes, default=0)):
        tree = written(_generalise(tree, at, distinct_least, distinct_share, z, labelled_least), "tree")
        if at + 1 in sizes[:-1]:  # shapes that end here are settled; later levels read the longer ones only
            done.append(tree.filter(F.size("shape") == at + 1))
            tree = tree.filter(F.size("shape") > at + 1)
    for part in done:
        tree = tree.unionByName(part)
    tree = written(tree, "templates")
    overall = tree.agg((1 - F.try_divide(F.sum("bad"), F.sum("labelled"))).alias("good")).first()["good"]

    def smoothed(part: DataFrame, above: DataFrame | None, keys: list[str]) -> DataFrame:
        """Purity and labelled of the rows of ``part``, whose branch above is in ``up``, and labels_above, those of that branch."""
        if above is None:
            part = part.withColumn("prior", F.lit(1.0 if overall is None else float(overall))).withColumn("labels_above", F.lit(0).cast("long"))
        else:
            told = above.select("host", F.col("branch").alias("up"), F.col("purity").alias("prior"), F.col("labelled").alias("labels_above"))
            part = part.join(told, ["host", "up"])
        here = (F.col("labelled") - F.col("bad") + weight * F.col("prior")) / (F.col("labelled") + F.lit(weight))
        return part.select(*keys, here.alias("purity"), "labelled", "labels_above")

    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    branches = above = None
    for depth in range(max(sizes, default=0)):  # from each host's root down
        branch = tree.filter(F.size("template") > depth).groupBy("host", F.slice("template", 1, depth).alias("branch")).agg(*sums)
        branch = branch.withColumn("up", F.slice("branch", 1, max(depth - 1, 0)))
        above = written(smoothed(branch, above, ["host", "branch"]), "purity")
        branches = above if branches is None else branches.unionByName(above)
    leaves = tree.groupBy("host", "template").agg(*sums).withColumn("up", F.slice("template", F.lit(1), F.size("template") - 1))
    leaves = smoothed(leaves, branches, ["host", "template"])
    told = (F.col("labelled") > 0) | (F.col("labels_above") >= labelled_least)
    leaves = leaves.withColumn("rejected", told & (F.round("purity", 9) < purity_least)).drop("labelled", "labels_above")
    return tree.select("host", "shape", "template", "n").join(leaves, ["host", "template"])


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", **options
) -> DataFrame:
    """A row for each page: page_id, host, path, rule, template, purity, verdict (allow or block).

    ``labels`` has key and bad (1 or 0; of repeated keys the greatest counts); a page is labelled by
    the first all-digit segment of its path.  The longest fitting rule decides;
    without one, block if the page's template is rejected.  A null url, or one
    without ``://``, has empty host and path and no template, and is allowed.
    Ids may be null or repeat; an empty table gives no rows; other columns are
    ignored.
    """
    host, path = host_of(F.col(f"`{url_col}`").cast("string")), path_of(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", masked(F.col("path")))
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:[/.]|$)', 1), '') AS BIGINT)")
    keyed = rows.filter("host <> ''").select("host", "shape", number.alias("key"))
    counted = keyed.groupBy("host", "shape", "key").agg(F.count("*").alias("n"))
    once = labels.groupBy("key").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    # shapes without a number have no label: only the others meet the labels, so null keys never share a task
    labelled = counted.filter("key IS NOT NULL").join(once, "key", "left").select("host", "shape", "bad", "n")
    bare = counted.filter("key IS NULL").select("host", "shape", F.lit(None).cast("long").alias("bad"), "n")
    tree = written(template_tree(labelled.unionByName(bare), **options), "tree")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    other = F.when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    known = join_salted(rows.filter("host <> ''"), tree, ["host", "shape"], "n", rows.count(), ["page_id", "path"]).drop("n")
    return known.unionByName(rows.filter("host = ''"), allowMissingColumns=True).select(
        "page_id", "host", "path", rule.alias("rule"), F.array_join(F.col("template"), "/").alias("template"), "purity",
        F.coalesce(verdict, other).alias("verdict"),
    )
