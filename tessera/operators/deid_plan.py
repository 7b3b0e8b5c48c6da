"""De-identification in two steps: a plan of what changes, bound to the elements it was made of, and its application.

elements are rows (doc, tag, vr, requirement, values), one row for each tag of a document, values being texts. A plan is a
row for each document: a digest of its elements, the changes, and findings that keep it from being applied. `applied`
takes only plans whose digest is still that of the document, so a document that has changed meanwhile is left as it is,
whole, and told to be stale; applying a plan twice is stale, too, as the first time changes the digest. A document's
elements meet in one row, as its digest is of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import remapped_uid
from tessera.operators.workflow import element_actions

#: What stands for a value, by representation; other texts are ANONYMOUS (fixed values).
DUMMIES = {"DA": "19000101", "TM": "000000", "DT": "19000101000000", "IS": "0", "DS": "0", "US": "0", "UL": "0", "SS": "0", "SL": "0", "FL": "0", "FD": "0", "AS": "000Y", "CS": "NONE"}


def digests(elements: DataFrame) -> DataFrame:
    """(doc, digest): SHA-256 of a document's elements in order of tag."""
    one = F.struct("tag", "vr", F.coalesce("values", F.array().cast("array<string>")).alias("values"))
    return elements.groupBy("doc").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256).alias("digest"))


def _dummy(secret: str) -> Column:
    text = F.lit("ANONYMOUS")
    for vr, value in DUMMIES.items():
        text = F.when(F.col("vr") == vr, value).otherwise(text)
    of = F.when(F.col("vr") == "UI", remapped_uid(F.concat(F.lit("dummy:"), F.coalesce(F.get("values", F.lit(0)), F.lit(""))), secret)).otherwise(text)
    return F.array(of)


def planned(elements: DataFrame, profile: DataFrame, secret: str, cleaned: Column | None = None) -> DataFrame:
    """(doc, digest, changes, findings): changes are (tag, action, values) of all elements that don't stay as they are.

    profile has (tag, code); tags of odd groups that it doesn't name are removed. `cleaned` gives the values of
    elements to be cleaned, from the columns of elements; without it, or where it is null, there is the finding (tag, clean).
    A tag that a document has twice is the finding (tag, repeated). Sequences are given as rows of their own, or removed.
    """
    acts = element_actions(elements, profile)
    none = F.array().cast("array<string>")
    clean = cleaned if cleaned is not None else F.lit(None).cast("array<string>")
    new = F.when(F.col("action").isin("remove", "empty"), none).when(F.col("action") == "remap", F.transform("values", lambda v: remapped_uid(v, secret))).when(F.col("action") == "clean", clean).otherwise(_dummy(secret))
    each = acts.where("action <> 'keep'").select("doc", "tag", "action", new.alias("values"))
    changes = each.where("values IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("tag", "action", "values"))).alias("changes"))
    unclean = each.where("values IS NULL AND action = 'clean'").select("doc", "tag", F.lit("clean").alias("finding"))
    twice = elements.groupBy("doc", "tag").agg(F.count("*").alias("n")).where("n > 1").select("doc", "tag", F.lit("repeated").alias("finding"))
    findings = unclean.union(twice).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("tag", "finding"))).alias("findings"))
    empty = lambda c: F.coalesce(c, F.filter(F.col(c), lambda x: F.lit(False)), F.array().cast(f"array<struct<{'tag:string,action:string,values:array<string>' if c == 'changes' else 'tag:string,finding:string'}>>"))
    return digests(elements).join(changes, "doc", "left").join(findings, "doc", "left").select("doc", "digest", empty("changes").alias("changes"), empty("findings").alias("findings"))


def outcomes(elements: DataFrame, plans: DataFrame) -> DataFrame:
    """(doc, outcome, n_changed, n_removed): applied, stale (the document isn't the planned one any more), findings, or no plan."""
    met = digests(elements).join(plans.select("doc", F.col("digest").alias("_planned"), "changes", "findings"), "doc", "left")
    outcome = F.when(F.col("_planned").isNull(), "no plan").when(F.col("_planned") != F.col("digest"), "stale").when(F.size("findings") > 0, "findings").otherwise("applied")
    n = lambda test: F.when(F.col("outcome") == "applied", F.size(F.filter("changes", test))).otherwise(0)
    return met.withColumn("outcome", outcome).select("doc", "outcome", n(lambda c: c["action"] != "remove").alias("n_changed"), n(lambda c: c["action"] == "remove").alias("n_removed"))


def applied(elements: DataFrame, plans: DataFrame) -> DataFrame:
    """elements after the plans that hold; documents of other outcomes keep theirs."""
    ready = outcomes(elements, plans).where("outcome = 'applied'").select("doc")
    changes = plans.join(ready, "doc", "left_semi").select("doc", F.explode("changes").alias("c")).select("doc", F.col("c.tag").alias("tag"), F.col("c.action").alias("_action"), F.col("c.values").alias("_values"))
    met = elements.join(changes, ["doc", "tag"], "left").where("_action IS NULL OR _action <> 'remove'")
    return met.withColumn("values", F.when(F.col("_action").isNotNull(), F.col("_values")).otherwise(F.col("values"))).select(elements.columns)
