"""Checks of document trees against templates: nested and included ones, with conditions on other items of the tree.

items are rows (doc, item, parent, relationship, value_type, concept, text); items of a document are numbered in order, a
parent before what is below it (pre-order), and the top has no parent. rules are rows

    (template, rule, under, place, relationship, value_type, concept, least, most, requirement, condition, include)

that say what may lie below a container: below the template's own one where `under` is null, else below an item that the
rule `under` has met. A null relationship, value_type or concept meets any, a null `most` allows any number. requirement is
M (must be there, `least` times), U (may be), MC (must be there if its condition holds, and may not otherwise) or UC (may
be there only if its condition holds). A rule with `include` stands for all rules of that template.

conditions are rows (condition, scope, concept, text, absent): an item of that concept (and text, if one is given) is, or
with `absent` isn't, in the document or below the container (scope document or container, at any depth).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoints import checkpointed

RULE = ["relationship", "value_type", "concept", "least", "most", "requirement", "condition"]


def expanded(rules: DataFrame, deepest: int = 16) -> DataFrame:
    """rules without includes: an included template's rules stand where the include stood, under names like a/b; ValueError if includes go deeper than `deepest`, as those of themselves do."""
    of = ["template", "rule", "under", "place", *RULE, "include"]
    rows = rules.select(*(F.col(c).cast("string") if c in ("rule", "under") else F.format_string("%08d", F.col(c)) if c == "place" else F.col(c) for c in of)).toDF(*of)
    inner = rows.select(*(F.col(c).alias(f"_{c}") for c in of))
    for _ in range(deepest):
        rows = checkpointed(rows)
        includes = rows.where("include IS NOT NULL")
        if includes.isEmpty():
            return rows.drop("include")
        name = lambda c: F.concat("rule", F.lit("/"), F.col(c))
        added = includes.join(inner, F.col("include") == F.col("_template")).select(
            "template", name("_rule").alias("rule"), F.coalesce(name("_under"), "under").alias("under"), F.concat("place", F.lit("/"), "_place").alias("place"), *(F.col(f"_{c}").alias(c) for c in RULE), F.col("_include").alias("include")
        )
        rows = rows.where("include IS NULL").unionByName(added)
    raise ValueError(f"templates include one another more than {deepest} deep")


def intervals(items: DataFrame) -> DataFrame:
    """(doc, item, last): an item's whole tree is the items from it to `last`. Each round goes one level up, for all items at once."""
    up = checkpointed(items.select("doc", "item", "parent"))
    step = up.select("doc", F.col("item").alias("holder"), F.col("parent").alias("_above"))
    found = [up.select("doc", F.col("item").alias("holder"), "item")]
    level = up.where("parent IS NOT NULL").select("doc", F.col("parent").alias("holder"), "item")
    while not level.isEmpty():
        # of each holder the last item below it is enough
        level = checkpointed(level.groupBy("doc", "holder").agg(F.max("item").alias("item")))
        found.append(level)
        level = level.join(step, ["doc", "holder"]).where("_above IS NOT NULL").select("doc", F.col("_above").alias("holder"), "item")
    return reduce(DataFrame.union, found).groupBy("doc", F.col("holder").alias("item")).agg(F.max("item").alias("last"))


def _holding(frames: DataFrame, rules: DataFrame, items: DataFrame, conditions: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, item, condition): the conditions that hold for a frame's container, of those that its rules ask."""
    asked = frames.join(rules.where("condition IS NOT NULL").select("template", F.col("under").alias("_under"), "condition").distinct(), (frames["template"] == rules["template"]) & F.col("under").eqNullSafe(F.col("_under"))).select("doc", "item", "condition").distinct()
    each = asked.join(conditions, "condition").join(spans, ["doc", "item"])
    there = items.select("doc", F.col("item").alias("_item"), F.col("concept").alias("_concept"), F.col("text").alias("_text"))
    same = (each["doc"] == there["doc"]) & (F.col("concept") == F.col("_concept")) & (F.col("text").isNull() | (F.col("text") == F.col("_text"))) & ((F.col("scope") == "document") | F.col("_item").between(F.col("item") + 1, F.col("last")))
    met = each.join(there, same, "left_semi").select("doc", "item", "condition").withColumn("_met", F.lit(True))
    all_ = each.select("doc", "item", "condition", F.coalesce("absent", F.lit(False)).alias("absent")).join(met, ["doc", "item", "condition"], "left")
    return all_.where(F.coalesce("_met", F.lit(False)) != F.col("absent")).select("doc", "item", "condition")


def findings(items: DataFrame, rules: DataFrame, conditions: DataFrame, roots: DataFrame, deepest: int = 64) -> DataFrame:
    """(doc, item, rule, finding) of the documents that a template (roots: doc, item, template) doesn't hold for.

    An item is met by the first rule (by place) that allows its relationship, type and concept. Findings of an item: type or
    relationship (a rule has its concept, and none allows those), or unknown; of a container: missing, too many, and
    not allowed (there against its condition). Below an item without a rule nothing is checked. Each round goes a level
    down, for all documents at once. Roots whose template or item isn't there have the finding no template.
    """
    rules, items = checkpointed(expanded(rules)), checkpointed(items.select("doc", "item", "parent", "relationship", "value_type", "concept", "text"))
    spans = checkpointed(intervals(items))
    known = roots.join(rules.select("template").distinct(), "template", "left_semi").join(items.select("doc", "item"), ["doc", "item"], "left_semi")
    none = F.lit(None).cast("string")
    found = [roots.join(known, ["doc", "item", "template"], "left_anti").select("doc", "item", none.alias("rule"), F.lit("no template").alias("finding"))]
    frames = checkpointed(known.select("doc", "item", "template", none.alias("under")).distinct())
    below = items.where("parent IS NOT NULL").select("doc", F.col("parent").alias("item"), F.col("item").alias("child"), *(F.col(c).alias(f"_{c}") for c in ("relationship", "value_type", "concept")))
    for _ in range(deepest):
        if frames.isEmpty():
            return reduce(DataFrame.union, found)
        own = rules.select(F.col("template").alias("_template"), F.col("under").alias("_under"), "rule", "place", *RULE)
        ruled = checkpointed(frames.join(own, (F.col("template") == F.col("_template")) & F.col("under").eqNullSafe(F.col("_under"))).drop("_template", "_under"))
        any_ = lambda c: F.col(c).isNull() | (F.col(c) == F.coalesce(F.col(f"_{c}"), F.lit("")))
        pairs = frames.join(below, ["doc", "item"]).join(ruled.drop("template", "under"), ["doc", "item"], "left")
        fits = any_("concept") & any_("value_type") & any_("relationship") & F.col("rule").isNotNull()
        why = F.when(any_("concept") & F.col("rule").isNotNull(), F.when(~any_("value_type"), "type").when(~any_("relationship"), "relationship"))
        met = checkpointed(pairs.groupBy("doc", "item", "template", "under", "child").agg(F.min(F.when(fits, F.struct("place", "rule"))).alias("m"), F.min(F.when(why.isNotNull(), F.struct("place", "rule", why.alias("why")))).alias("w")))
        found.append(met.where("m IS NULL").select("doc", F.col("child").alias("item"), F.col("w.rule").alias("rule"), F.coalesce("w.why", F.lit("unknown")).alias("finding")))
        counts = met.where("m IS NOT NULL").groupBy("doc", "item", F.col("m.rule").alias("rule")).agg(F.count("*").alias("n"))
        holding = _holding(frames, rules, items, conditions, spans).withColumn("_holds", F.lit(True))
        each = ruled.join(counts, ["doc", "item", "rule"], "left").join(holding, ["doc", "item", "condition"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        holds, conditional = F.coalesce("_holds", F.lit(False)), F.col("requirement").isin("MC", "UC")
        needed = (F.col("requirement") == "M") | (F.col("requirement") == "MC") & holds
        wrong = F.when(conditional & ~holds & (F.col("n") > 0), "not allowed").when(needed & (F.col("n") < F.greatest(F.col("least"), F.lit(1))), "missing").when(F.col("n") > F.col("most"), "too many")
        found.append(each.withColumn("finding", wrong).where("finding IS NOT NULL").select("doc", "item", "rule", "finding"))
        deeper = rules.where("under IS NOT NULL").select("template", F.col("under").alias("_rule")).distinct()
        frames = checkpointed(met.where("m IS NOT NULL").select("doc", F.col("child").alias("item"), "template", F.col("m.rule").alias("_rule")).join(deeper, ["template", "_rule"], "left_semi").select("doc", "item", "template", F.col("_rule").alias("under")))
    raise RuntimeError(f"rules go more than {deepest} levels down")
