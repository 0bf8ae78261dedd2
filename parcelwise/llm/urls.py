"""URL filters by a path-template tree (operator 12). DataFrame and SQL functions only.

Rules state what is known: a rule (action, host, path) fits the host and its subdomains where the path starts with the
rule's; of those that fit, the longest (host and path together; then the longer host) decides. All other urls are judged
by what rules say about urls of the same template of their host:

1. *Generalise.* Level by level below each host, a segment stays literal if at least ``LEAST`` urls of its parent
   branch, and ``SHARE`` of them, have it; all others become ``*``. A parent so has at most 1 / ``SHARE`` literal
   children, and counts combine on the map side, so no host needs a task of its own. Levels below ``DEPTH`` become ``**``.
2. *Merge.* Literal siblings, in order of their blocked and allowed shares, join their neighbour unless a chi-squared
   test tells them apart (1 in 100) by label (blocked, allowed, unknown) or by the shape of the segment that follows
   (none, digits, with digits, other). A merged branch is written ``{a|b}``.
3. *Reject.* With b blocked and a allowed urls by rule in a template, its purity is ``(b + PRIOR * p) / (a + b + PRIOR)``, p
   the blocked share of all urls that rules decide (1/2 if none). A template with labelled urls and a purity of
   ``PURITY`` or more is rejected; a template that no rule touches is allowed.

Rows: every row is judged, equal rows alike. A null url or one without ``://`` has an empty host and path and a template of
its own (the empty one). A very long path is cut into segments like any other, by JVM functions. Of ties in the order of
siblings the segment's bytes decide. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.session import discard, materialize

Rule = tuple[str, str, str]

RULES: list[Rule] = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
DEPTH = 4
LEAST = 5
SHARE = 0.02
PRIOR = 4
PURITY = 0.8
#: 1 in 100 for two and three degrees of freedom.
LABEL_LIMIT, SHAPE_LIMIT = 9.21, 11.34
LABELS = ["blocked", "allowed", "unknown"]
SHAPES = ["ends", "digits", "mixed", "other"]
SALTS = 16
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host, path = (F.coalesce(F.regexp_extract(url, PARTS, i), F.lit("")) for i in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as host and path, its action), null where none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def chi_squared(cells: list[str], before: str) -> str:
    """SQL of the two-sample statistic of ``cells`` against the columns of that name with ``before`` in front."""
    n1, n2 = " + ".join(cells), " + ".join(before + c for c in cells)
    return " + ".join(
        f"CASE WHEN {c} + {before}{c} = 0 THEN 0.0D ELSE power(CAST({c} AS DOUBLE) * ({n2}) - CAST({before}{c} AS DOUBLE) * ({n1}), 2)"
        f" / (CAST({c} + {before}{c} AS DOUBLE) * ({n1}) * ({n2})) END"
        for c in cells
    )


def joined(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of rows with one row per key; a hot key's rows are dealt over ``SALTS`` partitions."""
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = big.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    return mine.join(salted, [*keys, "salt"], "left").drop("salt")


def branches(urls: DataFrame, level: int) -> DataFrame:
    """(host, template, segment, name): the literal segments of a level, ``name`` their branch after merging."""
    here = urls.where(F.size("segments") >= level)
    after = F.try_element_at("segments", F.lit(level + 1))
    shape = (
        F.when(after.isNull(), "ends").when(after.rlike("^[0-9]+$"), "digits").when(after.rlike("[0-9]"), "mixed").otherwise("other")
    )
    label = F.when(F.col("action") == "block", "blocked").when(F.col("action") == "allow", "allowed").otherwise("unknown")
    counted = (
        here.select("host", "template", F.element_at("segments", level).alias("segment"), shape.alias("shape"), label.alias("label"))
        .groupBy("host", "template", "segment")
        .agg(
            F.count("*").alias("n"),
            *[F.count_if(F.col("label") == c).alias(c) for c in LABELS],
            *[F.count_if(F.col("shape") == c).alias(c) for c in SHAPES],
        )
    )
    parents = here.groupBy("host", "template").agg(F.count("*").alias("total"))
    literal = (
        counted.where(F.col("n") >= LEAST)
        .withColumns({"page_id": F.col("segment"), "path": F.col("segment")})
        .transform(lambda c: joined(c, parents, ["host", "template"]))
        .where(F.col("n") >= SHARE * F.col("total"))
    )
    siblings = Window.partitionBy("host", "template").orderBy(F.col("blocked") / F.col("n"), F.col("allowed") / F.col("n"), "segment")
    apart = F.expr(f"old_n IS NULL OR {chi_squared(LABELS, 'old_')} >= {LABEL_LIMIT} OR {chi_squared(SHAPES, 'old_')} >= {SHAPE_LIMIT}")
    classes = (
        literal.withColumns({f"old_{c}": F.lag(c).over(siblings) for c in ["n", *LABELS, *SHAPES]})
        .withColumn("apart", apart.cast("int"))
        .withColumn("branch", F.sum("apart").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
    )
    written = F.replace(F.url_encode("segment"), F.lit("*"), F.lit("%2A"))
    names = F.sort_array(F.collect_list(written).over(Window.partitionBy("host", "template", "branch")))
    name = F.when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("{"), F.array_join(names, "|"), F.lit("}")))
    return classes.select("host", "template", "segment", name.alias("name"))


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (page_id, host, path, rule, action) with the template of each; a written table."""
    # the part before the first slash is always empty
    now = materialize(urls.withColumns({"segments": F.expr("slice(split(path, '/', -1), 2, length(path))"), "template": F.lit("")}))
    for level in range(1, DEPTH + 1):
        if now.where(F.size("segments") >= level).isEmpty():
            break
        found = joined(
            now.withColumn("segment", F.try_element_at("segments", F.lit(level))), branches(now, level), ["host", "template", "segment"]
        )
        longer = F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*")))
        step = materialize(
            found.withColumn("template", F.when(F.size("segments") >= level, longer).otherwise(F.col("template"))).select(*now.columns)
        )
        discard(now)
        now = step
    return now.withColumn("template", F.concat("template", F.when(F.size("segments") > DEPTH, "/**").otherwise("")))


def judge(pages: DataFrame, rules: list[Rule] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, template, rule, blocked, allowed, purity, verdict) of every row.

    ``blocked`` and ``allowed`` count the template's urls that rules decide.
    """
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    split = named.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    urls = templates(split.withColumns({"rule": rule, "action": action}))
    known = urls.agg(F.count_if(F.col("action") == "block").alias("blocked"), F.count("action").alias("n")).head()
    base = known.blocked / known.n if known.n else 0.5
    evidence = urls.groupBy("host", "template").agg(
        F.count_if(F.col("action") == "block").alias("blocked"), F.count_if(F.col("action") == "allow").alias("allowed")
    )
    n = F.col("blocked") + F.col("allowed")
    purity = (F.col("blocked") + PRIOR * base) / (n + PRIOR)
    learned = F.when((n > 0) & (F.col("purity") >= PURITY), "block").otherwise("allow")
    return (
        joined(urls, evidence.withColumn("purity", purity), ["host", "template"])
        .withColumn("verdict", F.coalesce("action", learned))
        .select("page_id", "host", "path", "template", "rule", "blocked", "allowed", "purity", "verdict")
    )
