"""URL filters: list rules, and a tree of path templates judged by labelled pages.

Paths become templates segment by segment.  Digits are a wildcard from the
start.  Then, host by host and from the first segment on, the branches below a
node are compared: a branch whose share of good labelled pages differs from that
of its siblings by no more than chance allows is merged into the wildcard
branch, one that differs stays.  A template is rejected if its purity, smoothed
towards its host's and that towards the whole table's, is below the threshold.

Only DataFrame functions are used.  Pages are added up by host and path form
first; a host that holds a third of all pages is so many rows as it has forms.

Defined cases: null urls and urls without ``://`` have an empty host and path
and are judged together; an unlabelled template takes its host's purity; with no
labels at all nothing is rejected; repeated rows are judged each; extra columns
stay out of the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioworks.session import cut_lineage, write_once

#: How many standard errors a branch differs from its siblings at least to stay, and its least labelled pages.
DIFFERENT, LEAST_LABELLED = 2.58, 5
#: Labelled pages that the smoothing counts as.
WEIGHT = 4.0
LEAST_PURITY = 0.5
ANY = "*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    fitting = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                      F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
               for v, h, p in rules]
    return F.array_max(F.array(*fitting))


def form_of(path: Column) -> Column:
    """The segments of a path with digits as wildcards."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", ANY))


def _rate(good: Column, n: Column, prior: Column) -> Column:
    return (good + WEIGHT * prior) / (n + WEIGHT)


def merged_templates(forms: DataFrame) -> DataFrame:
    """(host, form, good, labelled, template) for each row of ``forms``: (host, form array, good, labelled).

    Goes on level by level to the deepest form; forms that end leave the tree at
    the next cut, so a few deep paths do not keep all others in it.
    """
    tree = forms.withColumn("template", F.array().cast("array<string>"))
    ended = []
    deepest = forms.agg(F.max(F.size("form"))).first()[0] or 0
    for level in range(deepest):
        here = tree.withColumn("segment", F.get("form", F.lit(level)))
        branches = here.where(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(
            F.sum("good").alias("g"), F.sum("labelled").alias("n"))
        nodes = branches.groupBy("host", "template").agg(F.sum("g").alias("all_g"), F.sum("n").alias("all_n"))
        others_n, others_g = F.col("all_n") - F.col("n"), F.col("all_g") - F.col("g")
        pooled = F.col("all_g") / F.col("all_n")
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / others_n))
        differs = (F.col("n") >= LEAST_LABELLED) & (others_n >= LEAST_LABELLED) & (
            F.abs(F.try_divide(F.col("g"), F.col("n")) - F.try_divide(others_g, others_n)) > DIFFERENT * error)
        stay = branches.where("n > 0").join(nodes.where("all_n > 0"), ["host", "template"]).where("all_n > n").where(differs).select(
            "host", "template", "segment", F.lit(True).alias("stays"))
        tree = here.join(stay, ["host", "template", "segment"], "left").select(
            "host", "form", "good", "labelled",
            F.when(F.col("segment").isNull(), F.col("template"))
            .otherwise(F.concat("template", F.array(F.when(F.col("stays"), F.col("segment")).otherwise(F.lit(ANY))))).alias("template"))
        if level % 3 == 2:
            tree = cut_lineage(tree)
            ended.append(tree.where(F.size("form") <= level + 1))
            tree = tree.where(F.size("form") > level + 1)
    for part in ended:
        tree = tree.unionByName(part)
    return tree


def judged_templates(forms: DataFrame) -> DataFrame:
    """(host, form, template, purity, verdict)."""
    tree = write_once(merged_templates(forms), "url-tree")
    by_template = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("labelled").alias("n"))
    by_host = tree.groupBy("host").agg(F.sum("good").alias("host_g"), F.sum("labelled").alias("host_n"))
    whole = tree.agg(F.sum("good").alias("g"), F.sum("labelled").alias("n")).first()
    prior = ((whole["g"] or 0.0) + WEIGHT) / ((whole["n"] or 0.0) + WEIGHT)
    purity = _rate(F.col("g"), F.col("n"), _rate(F.col("host_g"), F.col("host_n"), F.lit(prior)))
    judged = by_template.join(by_host, "host").select("host", "template", purity.alias("purity"))
    return (tree.select("host", "form", "template").join(judged, ["host", "template"])
            .withColumn("verdict", F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow")))


def judged_pages(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 rules: Sequence[tuple[str, str, str]] = RULES, label_key: Column | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every page.

    ``labels`` has (key, good 0 or 1); ``label_key`` is the page's key in it, by
    default its id.  A key that is labelled more than once counts as its worst.
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                          (label_key if label_key is not None else F.col(id_col)).cast("long").alias("key"))
    parsed = parsed.withColumn("form", form_of(F.col("path")))
    known = labels.where("key IS NOT NULL AND good IS NOT NULL").groupBy("key").agg(F.min("good").alias("good"))
    # Keys are added up before the join, so a key or a form that many pages share is one row of it.
    shared = parsed.groupBy("host", "form", "key").agg(F.count("*").alias("n")).join(known, "key", "left")
    forms = shared.groupBy("host", "form").agg(
        F.sum(F.coalesce(F.col("good") * F.col("n"), F.lit(0))).cast("double").alias("good"),
        F.sum(F.when(F.col("good").isNotNull(), F.col("n")).otherwise(0)).cast("double").alias("labelled"))
    judged = judged_templates(write_once(forms, "url-forms"))
    fit = rule_for(F.col("host"), F.col("path"), rules)
    return (parsed.withColumn("fit", fit).join(judged, ["host", "form"])
            .select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.col("verdict")).alias("verdict"),
                    F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"))
