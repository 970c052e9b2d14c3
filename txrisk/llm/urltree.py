"""Verdicts on pages by rules, and by the templates of their paths.

Host: what follows the first ``://`` up to ``/ ? #`` or the end, A-Z in lower
case; path: from there up to ``? #`` or the end. Null, or without ``://``: both empty.

Rules ``(host, path, verdict)`` fit a host and all its subdomains if the path starts with
the rule's; the longest wins. Pages without a rule are judged by the method:

1. Per host the paths form a tree of segments. Digits inside a segment become ``#``.
2. From the root on, the children of a node are of two kinds, with labelled pages below them or
   without, and only children of one kind are put together: labels say nothing about
   branches that have none. A node with ``MANY`` small children of a kind, of less than
   ``FEW`` pages each, has a variable segment, and these children become a wildcard. So do labelled
   branches that a chi-square test cannot tell from their labelled siblings, by their
   numbers of pages labelled bad, labelled good and not labelled; siblings with fewer than ``LEAST``
   pages together are not enough for the test. ``?`` is the wildcard of labelled
   children, ``??`` of others; no path holds a question mark.
3. A template is rejected if its share of bad among labelled pages, smoothed by one page of
   either kind, reaches ``REJECT``.

Labels are given as ``page_id, bad`` or, without them, are the verdicts of the rules.
The tree is built on counts of distinct shapes, so a host with very many pages is a few rows.
What all shapes of a node have in common is passed in one step, so there is one round of
jobs per level at which paths part, however long they are.

Ties between rules go to the longer host, then to block. Repeated page_ids and urls are judged one
by one, alike if the urls are; paths have any length; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import free, new_folder, stored

#: Small children from which a segment is variable, and pages below which a child is small.
MANY, FEW = 20, 3
#: Pages of labelled siblings below which the test says nothing.
LEAST = 6
#: The 95 % point of the chi-square distribution with two degrees of freedom.
ALIKE = 5.991
REJECT = 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of the distinct ``urls`` that a rule fits."""
    known = rules.select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).distinct()
    labels = F.split("host", "\\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fits = urls.select("host", "path", F.explode(ends).alias("r_host")).join(known, "r_host")
    fits = fits.where(F.startswith("path", "r_path"))
    rule = F.concat("r_host", "r_path")
    # Ties in length go to the longer host, then to "block".
    best = F.max(F.struct(F.length(rule), F.length("r_host"), "r_verdict", rule.alias("rule")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select(
        "host", "path", "b.rule", F.col("b.r_verdict").alias("verdict")
    )


def shapes(urls: DataFrame) -> DataFrame:
    """Add ``parts``: the generalised segments of ``path``, each with its slash."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    return urls.withColumn(
        "parts", F.transform(parts, lambda s: F.concat(F.lit("/"), F.regexp_replace(s, "[0-9]+", "#")))
    )


def chi_square() -> Column:
    """Child against its siblings over (bad, good, not labelled)."""
    total = F.lit(0.0)
    rest = F.col("p_n") - F.col("n")
    for k in ("bad", "good", "open"):
        both = F.col(f"p_{k}")
        e = both * F.col("n") / F.col("p_n")
        f = both * rest / F.col("p_n")
        d = F.col(k) - e
        total = total + F.when((e > 0) & (f > 0), d * d / e + d * d / f).otherwise(0.0)
    return total


_NODE = ["host", "template"]
_COUNTS = ["n", "bad", "good", "open"]


def _passed(df: DataFrame) -> DataFrame:
    """Every shape taken to where the shapes of its node part: the common beginning of the
    least and the greatest of them is common to all."""
    ends = df.groupBy(*_NODE).agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    same = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    common = F.when(first > 0, first - 1).otherwise(F.size("low")).cast("int")
    ends = ends.select(*_NODE, common.alias("common"))
    way = F.array_join(F.slice("rest", F.lit(1), F.col("common")), "")
    rest = F.slice("rest", F.col("common") + 1, F.size("rest"))
    return df.join(ends, _NODE).select(
        "host", "parts", *_COUNTS, F.concat("template", way).alias("template"), rest.alias("rest")
    )


def _named(df: DataFrame) -> DataFrame:
    """``host, template, step, token``: the children of all nodes, and what they are called."""
    kids = df.groupBy(*_NODE, "step").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    # What ends here is no child.
    kids = kids.where(F.col("step") != "").withColumn("labelled", F.col("bad") + F.col("good") > 0)
    small = F.col("n") < FEW
    kinds = kids.groupBy(*_NODE, "labelled").agg(
        F.count(F.lit(1)).alias("kids"), F.count_if(small).alias("smalls"),
        *[F.sum(c).alias(f"p_{c}") for c in _COUNTS],
    )
    variable = small & (F.col("smalls") >= MANY)
    alike = F.col("labelled") & (F.col("kids") > 1) & (F.col("p_n") >= LEAST) & (chi_square() < ALIKE)
    wildcard = F.when(F.col("labelled"), "/?").otherwise("/??")
    return kids.join(kinds, [*_NODE, "labelled"]).select(
        *_NODE, "step", F.when(variable | alike, wildcard).otherwise(F.col("step")).alias("token")
    )


def templates(counted: DataFrame) -> DataFrame:
    """``host, parts, template, bad, good`` (the template's) of all shapes.

    ``counted``: ``host, parts, n, bad, good``, one row a shape.
    """
    spark = counted.sparkSession
    df = counted.select(
        "host", "parts", *_COUNTS[:3], (F.col("n") - F.col("bad") - F.col("good")).alias("open"),
        F.lit("").alias("template"), F.col("parts").alias("rest"),
    )
    folder = new_folder(spark, "shapes")
    done = ["host", "parts", "template", "bad", "good"]
    # An empty first part, so that a table without pages has a result as well.
    df.limit(0).select(*done).write.parquet(folder)
    while True:
        # An absent segment and an empty one differ: "" and "/".
        df = stored(_passed(df).withColumn("step", F.coalesce(F.get("rest", F.lit(0)), F.lit(""))), "tree")
        df.where(F.col("step") == "").select(*done).write.mode("append").parquet(folder)
        df = df.where(F.col("step") != "")
        if df.isEmpty():
            break
        df = df.join(_named(df), [*_NODE, "step"]).select(
            "host", "parts", *_COUNTS, F.concat("template", "token").alias("template"),
            F.slice("rest", F.lit(2), F.size("rest")).alias("rest"),
        )
    every = spark.read.parquet(folder)
    stats = every.groupBy(*_NODE).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return every.drop("bad", "good").join(stats, _NODE)


def judged(pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, template, purity``."""
    host, path = host_and_path("url")
    flat = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    if labels is None:
        urls = flat.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    else:
        bad = labels.groupBy(F.col("page_id").alias("l_id")).agg(F.max(F.col("bad").cast("int")).alias("b"))
        marked = flat.join(bad, F.col("page_id") == F.col("l_id"), "left")
        urls = marked.groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("b") == 1).alias("bad"),
            F.count_if(F.col("b") == 0).alias("good"),
        )
    urls = stored(urls, "urls")
    fixed = stored(ruled(urls, rules), "ruled")
    if labels is None:
        n = F.col("n")
        urls = urls.join(fixed, ["host", "path"], "left").select(
            "host", "path", "n", F.when(F.col("verdict") == "block", n).otherwise(0).alias("bad"),
            F.when(F.col("verdict") == "allow", n).otherwise(0).alias("good"),
        )
    shaped = shapes(urls)
    keys = ["host", "parts"]
    counted = shaped.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    purity = (F.col("bad") + 1) / (F.col("bad") + F.col("good") + 2)
    tree = templates(stored(counted, "shapes")).select(*keys, "template", purity.alias("purity"))
    verdicts = (
        shaped.select(*keys, "path").join(tree, keys)
        .join(fixed, ["host", "path"], "left")
        .select(
            "host", "path", "rule", "template", "purity",
            F.coalesce("verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        )
    )
    verdicts = stored(verdicts, "verdicts")
    return flat.join(verdicts, ["host", "path"]).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity"
    )


def allowed(pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``pages``, all columns, without those that are blocked."""
    blocked = judged(pages, rules, labels).where(F.col("verdict") == "block")
    h, p = free(pages, "host"), free(pages, "path")
    blocked = stored(blocked.select(F.col("host").alias(h), F.col("path").alias(p)).distinct(), "blocked")
    host, path = host_and_path("url")
    return pages.join(blocked, (host == F.col(h)) & (path == F.col(p)), "left_anti")


def sql(rules: list[tuple[str, str, str]]) -> str:
    """The same in SQL for a short list of rules, labels from the rules: one segment at a time."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    chi = " + ".join(
        f"case when p_{k} * k_n > 0 and p_{k} * (p_n - k_n) > 0 then "
        f"((k_{k} - p_{k} * k_n / p_n) * (k_{k} - p_{k} * k_n / p_n)) / (p_{k} * k_n / p_n) + "
        f"((k_{k} - p_{k} * k_n / p_n) * (k_{k} - p_{k} * k_n / p_n)) / (p_{k} * (p_n - k_n) / p_n) else 0.0 end"
        for k in ("bad", "good", "open")
    )
    kid = "partition by host, template, step"
    kind = "partition by host, template, step = '', k_bad + k_good > 0"
    counts = ("n", "bad", "good", "open")
    return f"""
with recursive rules(r_host, r_path, r_verdict) as (values {values}),
rest as (
  select page_id, case when strpos(coalesce(url, ''), '://') > 0
    then substr(url, strpos(url, '://') + 3) else '' end r from pages),
cut as (select page_id, r, regexp_extract(r, '^[^/?#]*') h from rest),
flat as (
  select page_id, {lower.format("h")} host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') path from cut),
urls as (select host, path, count(*) n from flat group by all),
fits as (
  select host, path, r_host || r_path rule, r_verdict,
    row_number() over (partition by host, path
      order by length(r_host || r_path) desc, length(r_host) desc, r_verdict desc, r_host || r_path desc) k
  from urls join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)),
fixed as (select host, path, rule, r_verdict verdict from fits where k = 1),
shaped as (
  select host, path, n, verdict, rule,
    list_transform(string_split(regexp_replace(path, '^/', ''), '/'),
      lambda s: '/' || regexp_replace(s, '[0-9]+', '#', 'g')) p
  from urls left join fixed using (host, path)),
counted as (
  select host, p, sum(n)::double n, sum(case when verdict = 'block' then n else 0 end)::double bad,
    sum(case when verdict = 'allow' then n else 0 end)::double good,
    sum(case when verdict is null then n else 0 end)::double open
  from shaped group by host, p),
tree as (
  select host, p, n, bad, good, open, '' template, 1 depth from counted
  union all
  select host, p, n, bad, good, open,
    template || case when step <> '' and (
        (k_n < {FEW} and round(smalls) >= {MANY})
        or (k_bad + k_good > 0 and round(kids) > 1 and p_n >= {LEAST} and {chi} < {ALIKE}))
      then case when k_bad + k_good > 0 then '/?' else '/??' end else step end,
    depth + 1
  from (
    select *, sum(1.0 / shapes) over ({kind}) kids,
      sum(case when k_n < {FEW} then 1.0 / shapes else 0.0 end) over ({kind}) smalls,
      {", ".join(f"round(sum({c}) over ({kind})) p_{c}" for c in counts)}
    from (
      select *, count(*) over ({kid}) shapes, {", ".join(f"sum({c}) over ({kid}) k_{c}" for c in counts)}
      from (select *, case when depth <= len(p) then p[depth] else '' end step from tree where depth <= len(p) + 1)))),
done as (select host, p, bad, good, template from tree where depth = len(p) + 2),
stats as (
  select host, template, (sum(bad) + 1) / (sum(bad) + sum(good) + 2) purity from done group by all),
verdicts as (
  select host, path, rule, template, purity,
    coalesce(verdict, case when purity >= {REJECT} then 'block' else 'allow' end) verdict
  from shaped join done using (host, p) join stats using (host, template))
select page_id, host, path, rule, verdict, template, purity from flat join verdicts using (host, path)"""


def rules_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules as a table."""
    rows = [F.struct(*[F.lit(v).alias(c) for v, c in zip(r, ("host", "path", "verdict"))]) for r in rules]
    one = spark.range(1).select(F.explode(F.array(*rows)).alias("r"))
    return one.select("r.*")
