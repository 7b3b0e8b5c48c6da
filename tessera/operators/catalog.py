"""Catalogs of patients, studies, series and instances: statistics and conflicts in the hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(records: DataFrame, levels: list[str], size: str) -> DataFrame:
    """One row: records, bytes and the number of different values of each level, an absent value being one of them."""
    return records.agg(F.count("*").alias("n_records"), F.sum(F.coalesce(F.col(size), F.lit(0))).alias("total_size"), *(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"n_{c}") for c in levels))


def counts_by(records: DataFrame, *kinds: str) -> DataFrame:
    """(kind, value, n) for each value of each of the columns, in one pass: a row becomes one for each column before they are counted."""
    names = F.array(*map(F.lit, kinds))
    each = records.select(F.explode(F.zip_with(names, F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kinds)), lambda k, v: F.struct(k.alias("kind"), v.alias("value")))).alias("x"))
    return each.groupBy(F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def conflicts(records: DataFrame, child: list[str], parent: str) -> DataFrame:
    """Entities of a level that stand under more than one parent, with the number of parents and the least and largest."""
    return records.groupBy(*child).agg(F.count_distinct(parent).alias("n_parents"), F.min(parent).alias("first_parent"), F.max(parent).alias("last_parent")).where("n_parents > 1")


def duplicates(records: DataFrame, key: list[str]) -> DataFrame:
    """Identifiers that several records have, with their number."""
    return records.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def nested_counts(records: DataFrame, levels: list[str]) -> DataFrame:
    """For each entity of the first level the number of different entities of each lower one."""
    lower = [(c, F.count_distinct(F.struct(*levels[1 : k + 1])).alias(f"n_{c}")) for k, c in enumerate(levels) if k]
    return records.groupBy(levels[0]).agg(*(agg for _, agg in lower), F.count("*").alias("n_records"))


def dangling(edges: DataFrame, target: str, nodes: DataFrame, node: str) -> DataFrame:
    """References whose target isn't there."""
    return edges.join(nodes.select(F.col(node).alias(target)), target, "left_anti")


def reachable(edges: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """(source, target, depth): ancestors within `depth` steps, by the shortest way; cycles end as no pair is taken twice."""
    edges = edges.select(F.col(source).alias("source"), F.col(target).alias("target")).distinct()
    found = frontier = edges.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        steps = edges.select(F.col("source").alias("target"), F.col("target").alias("next"))
        frontier = frontier.join(steps, "target").select("source", F.col("next").alias("target")).distinct().join(found, ["source", "target"], "left_anti").withColumn("depth", F.lit(d))
        found = found.union(frontier)
    return found


def directory(records: DataFrame, levels: list[tuple[str, str, list[str]]]) -> DataFrame:
    """One row for each entity of each level: (level, path, n_records, n_children, consistent).

    levels: (name, key column, columns that all records of an entity share), from the top. The path holds the keys from
    the top to the entity. `consistent` says whether its records agree in those columns, absent values being one value.
    Entities are counted from their own rows, so a large parent is summed up before anything is shuffled.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    path = lambda k: F.array(*(text(key) for _, key, _ in levels[: k + 1]))
    shared = lambda columns: F.to_json(F.array(*(text(c) for c in columns))) if columns else F.lit("")
    each = records.select(F.explode(F.array(*(F.struct(F.lit(name).alias("level"), path(k).alias("path"), shared(columns).alias("shared")) for k, (name, _, columns) in enumerate(levels)))).alias("x")).select("x.*")
    nodes = each.groupBy("level", "path").agg(F.count("*").alias("n_records"), (F.min("shared") == F.max("shared")).alias("consistent"))
    children = nodes.where(F.size("path") > 1).groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.count("*").alias("n_children"))
    return nodes.join(children, "path", "left").select("level", "path", "n_records", F.coalesce("n_children", F.lit(0)).alias("n_children"), "consistent")


def several_roles(records: DataFrame, roles: list[str]) -> DataFrame:
    """(identifier, roles): identifiers that stand in more than one of the columns, which should name different kinds of things."""
    each = records.select(F.explode(F.array(*(F.struct(F.col(c).cast("string").alias("identifier"), F.lit(c).alias("role")) for c in roles))).alias("x")).select("x.*").where("identifier IS NOT NULL AND identifier <> ''")
    return each.groupBy("identifier").agg(F.array_sort(F.collect_set("role")).alias("roles")).where(F.size("roles") > 1)


def reference_kinds(references: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> DataFrame:
    """references with `kind`: what is wrong with a reference between items named by their paths (1.2.3), or ok.

    invalid: no path of positive numbers; self: its own item; ancestor: an item above it; missing: no such item.
    """
    path, at = F.coalesce(F.col(target), F.lit("")), F.col(source)
    there = nodes.select(F.col(node).alias(target)).distinct().withColumn("_there", F.lit(True))
    kind = F.when(~path.rlike(r"^[1-9][0-9]*([.][1-9][0-9]*)*\z"), "invalid").when(path == at, "self").when(at.startswith(F.concat(path, F.lit("."))), "ancestor").when(F.col("_there").isNull(), "missing").otherwise("ok")
    return references.join(there, target, "left").withColumn("kind", kind).drop("_there")


def prior_wanted(abstract: Column, relative: Column) -> Column:
    """Which earlier study a display asks for: 0 for the latest one, null if it asks for none.

    `abstract` (array of counts back, 1 the latest; the least stands, its sign doesn't matter) goes before `relative`
    (array of times, any of which but 0 asks for the latest).
    """
    steps = F.filter(F.transform(abstract, F.abs), lambda v: v != 0)
    return F.when(F.size(steps) > 0, F.array_min(steps) - 1).when(F.exists(relative, lambda v: v != 0), 0).cast("int")


def priors(studies: DataFrame, by: list[str], order: list[str], key: str, back: int = 0) -> DataFrame:
    """studies with `prior`: the key of the study that lies back + 1 before it in the order of its patient."""
    return studies.withColumn("prior", F.lag(key, back + 1).over(Window.partitionBy(*by).orderBy(*order)))


def resolved_path(root: str, parts: Column) -> Column:
    """The path below root of a file id in parts, which backslashes may divide further; null if nothing is left, or a part isn't a plain name."""
    names = F.filter(F.transform(F.flatten(F.transform(parts, lambda p: F.split(p, r"\\"))), lambda p: F.trim(p)), lambda p: p != "")
    plain = F.forall(names, lambda p: ~p.isin(".", "..") & ~p.rlike(r"[/:\x00-\x1F]"))
    return F.when((F.size(names) > 0) & plain, F.concat_ws("/", F.lit(root.rstrip("/")), names))


def added(records: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """records and the new ones, which take the place of those of the same key."""
    return records.join(new.select(*key), key, "left_anti").unionByName(new)


def removed(records: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """records without those of the keys given."""
    return records.join(gone.select(*key), key, "left_anti")
