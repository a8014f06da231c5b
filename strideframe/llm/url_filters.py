"""URL filters by a path-template tree, in DataFrame operations only.

Every url's path is cut into segments; digit runs become ``#`` and long hex or
UUID runs ``%`` (variable by form).  Urls of equal form are one row with their
counts from then on.  The tree grows from the root, all hosts at once: at each
level a branch's share of bad labels is compared with that of all its siblings
together, itself left out, by a two-sample test.  A frequent branch that differs
by more than sampling explains keeps its literal segment.  The others merge by
likeness: those that are alike to their siblings into one wildcard branch ``*``,
rare ones that are worse into ``*+`` and rare ones that are better into ``*-``,
so a bad branch isn't lost among good ones for being rare.  The tree is as deep
as the deepest form: forms that have ended leave the loop, and so do those alone
in their branch, as a branch without siblings keeps its name on every level.

A template is rejected where its smoothed labelled purity, the bad share drawn
towards its host's share and this towards that of all labels, reaches
``reject``.  Explicit rules (host and subdomains, path prefix) come first; the
longest that fits decides.

Only per-form counts go through the levels; urls meet their form's verdict in
one equi-join, whose hot keys Spark's adaptive skew handling can split, as every
form is one row on the other side.

Defined results: a null url, or one without ``://``, has an empty host and path
and meets no rule; it is judged by the template of the empty path; rows that
repeat an id are judged each on its own; a host without labels takes the share
of all labels, and with no label at all nothing is rejected; a literal segment
that begins with ``*`` is named with ``%2A`` in its place; a url of any length
is cut into all its segments; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) from behind the first ``://`` and the path from behind it; both empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule (host and path in one string) and verdict of the longest of ``rules`` (host, path, verdict) that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in ordered]
    chain = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return chain([h + p for h, p, _ in ordered]), chain([v for *_, v in ordered])


def _form(path: Column) -> Column:
    """Segments with what is variable by form replaced."""
    plain = F.regexp_replace(path, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b[0-9a-f]{16,}\b", "%")
    return F.split(F.regexp_replace(F.regexp_replace(plain, r"^/", ""), r"[0-9]+", "#"), "/")


def template_tree(forms: DataFrame, *, least: int, z: float, depth: int | None = None) -> DataFrame:
    """``forms`` (host, form, n, labelled, bad; a row for each host and form) with ``template``.  ``depth``: levels at most beyond the first, all by default."""
    now, done, level = forms.withColumn("template", F.array().cast("array<string>")).withColumn("alone", F.lit(False)), [], 0
    while True:
        ended = F.col("alone") | (F.size("form") <= level)
        rest = F.transform(F.slice("form", level + 1, F.greatest(F.size("form") - level, F.lit(0))), lambda x: F.regexp_replace(x, r"^\*", "%2A"))
        done.append(now.where(ended).select(*forms.columns, F.concat("template", rest).alias("template")))
        now = now.where(~ended)
        if now.isEmpty() or (depth is not None and level > depth):
            break
        here = now.withColumn("at", F.concat_ws("/", "template")).withColumn("segment", F.get("form", F.lit(level)))
        branches = here.groupBy("host", "at", "segment").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")), F.count("*").alias("forms"))
        parents = branches.groupBy("host", "at").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        others, others_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        share = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
        gap = F.col("bad") / F.col("labelled") - others_bad / others
        differs = F.abs(gap) > z * F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / others))
        # -1, 0 or 1: better, alike, worse; a branch or siblings without labels are alike
        side = F.when((F.col("labelled") > 0) & (others > 0) & differs, F.signum(gap).cast("int")).otherwise(0)
        judged = branches.join(parents, ["host", "at"]).withColumn("side", side).withColumn("literal", (F.col("n") >= least) & (F.col("side") != 0))
        merged = judged.where(~F.col("literal")).groupBy("host", "at", "side").agg(F.count("*").alias("alike"))
        kept = judged.select("host", "at", "segment", "literal", "side", "forms").join(merged, ["host", "at", "side"], "left")
        # a branch with none to merge with keeps its name
        own = F.regexp_replace("segment", r"^\*", "%2A")
        wild = F.when(F.col("side") > 0, "*+").when(F.col("side") < 0, "*-").otherwise("*")
        kept = kept.select("host", "at", "segment", "forms", F.when(F.col("literal") | (F.col("alike") == 1), own).otherwise(wild).alias("name"))
        grown = here.join(kept, ["host", "at", "segment"])
        # the only form of a branch
        alone = (F.col("forms") == 1) & ~F.col("name").startswith("*")
        now = stage(grown.select(*forms.columns, F.concat("template", F.array("name")).alias("template"), alone.alias("alone")), f"tree-{level}")
        level += 1
    done.append(now.select(*forms.columns, "template"))
    return reduce(DataFrame.unionByName, done).withColumn("template", F.concat(F.lit("/"), F.concat_ws("/", "template")))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, least: int = 20, z: float = 2.6, prior: float = 4.0, reject: float = 0.5) -> DataFrame:
    """page id, host, path, rule, verdict, template and bad_share of each url.  ``label_col``: 1 for bad, 0 for good, null for none.  ``rules`` are a short list that becomes part of the expression."""
    host, path = host_and_path(url_col)
    label = F.col(label_col).cast("long") if label_col else F.lit(None).cast("long")
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), label.alias("label")).withColumn("form", _form(F.col("path")))
    forms = rows.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    forms = stage(forms, "forms")
    tree = stage(template_tree(forms, least=least, z=z), "tree")
    total = forms.agg(F.coalesce((F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0))), F.lit(0.0))).first()[0]
    hosts = forms.groupBy("host").agg(((F.sum("bad") + prior * F.lit(total)) / (F.sum("labelled") + prior)).alias("host_share"))
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).join(hosts, "host")
    shares = templates.select("host", "template", ((F.col("bad") + prior * F.col("host_share")) / (F.col("labelled") + prior)).alias("bad_share"))
    known = tree.select("host", "form", "template").join(shares, ["host", "template"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") >= reject, "block").otherwise("allow")
    return rows.join(known, ["host", "form"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("bad_share", 9).alias("bad_share"))
