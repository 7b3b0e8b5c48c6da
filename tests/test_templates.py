"""Templates with conditions and includes, on small trees."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import templates

ITEMS = "doc int, item int, parent int, relationship string, value_type string, concept string, text string"
RULES = "template string, rule string, under string, place int, relationship string, value_type string, concept string, least int, most int, requirement string, condition string, include string"
CONDITIONS = "condition string, scope string, concept string, text string, absent boolean"

R = [
    ("T", "head", None, 1, "HAS CONCEPT MOD", "CODE", "lang", 1, 1, "M", None, None), ("T", "group", None, 2, "CONTAINS", "CONTAINER", "group", 1, None, "M", None, None), ("T", "g", "group", 1, None, None, None, None, None, None, None, "G"),
    ("T", "note", None, 3, None, "TEXT", "note", 1, 1, "MC", "abnormal", None), ("T", "end", None, 4, None, "TEXT", "end", 0, 2, "UC", "no note", None),
    ("G", "size", None, 1, "CONTAINS", "NUM", "size", 1, 2, "M", None, None), ("G", "deep", None, 2, "CONTAINS", "CONTAINER", "deep", 0, 1, "U", None, None), ("G", "leaf", "deep", 1, None, "TEXT", None, 1, 1, "M", None, None), ("G", "unit", "size", 1, None, "CODE", "unit", 1, 1, "MC", "own", None),
]
C = [("abnormal", "document", "finding", "bad", False), ("no note", "document", "note", None, True), ("own", "container", "flag", None, False)]


def check(spark, docs, rules=R):
    rows = [(d, i, *v) for d, items in docs.items() for i, v in enumerate(items)]
    df = spark.createDataFrame(rows, ITEMS)
    roots = spark.createDataFrame([(d, 0, "T") for d in docs], "doc int, item int, template string")
    out = {d: set() for d in docs}
    for r in templates.findings(df, spark.createDataFrame(rules, RULES), spark.createDataFrame(C, CONDITIONS), roots).collect():
        out[r.doc].add((r.item, r.rule, r.finding))
    return out


TOP, LANG, GROUP = (None, None, "CONTAINER", "report", None), (0, "HAS CONCEPT MOD", "CODE", "lang", "en"), (0, "CONTAINS", "CONTAINER", "group", None)


def test_findings(spark):
    size = lambda p: (p, "CONTAINS", "NUM", "size", "1")
    docs = {
        1: [TOP, LANG, GROUP, size(2)],
        2: [TOP, GROUP, (1, "CONTAINS", "NUM", "other", "1"), (1, "CONTAINS", "CONTAINER", "deep", None), (3, "CONTAINS", "CODE", "x", None)],
        3: [TOP, LANG, GROUP, size(2), size(2), size(2), (2, None, "CODE", "finding", "bad"), GROUP],
        4: [TOP, LANG, GROUP, size(2), (0, None, "TEXT", "note", "n"), (0, None, "TEXT", "end", "e")],
        5: [TOP, (0, "CONTAINS", "CODE", "lang", None), GROUP, size(2), (3, "CONTAINS", "TEXT", "flag", None), size(2), (5, None, "TEXT", "flag", None), (5, None, "CODE", "unit", None), (0, None, "TEXT", "end", None), (0, None, "TEXT", "end", None), (0, None, "TEXT", "end", None)],
        6: [TOP, LANG, GROUP, size(2), (2, "CONTAINS", "CONTAINER", "deep", None), (4, "x", "TEXT", "any", None)],
    }
    assert check(spark, docs) == {
        1: set(),
        2: {(0, "head", "missing"), (1, "g/size", "missing"), (2, None, "unknown"), (3, "g/leaf", "missing"), (4, "g/leaf", "type")},
        3: {(0, "note", "missing"), (2, "g/size", "too many"), (6, None, "unknown"), (7, "g/size", "missing")},
        4: {(0, "note", "not allowed"), (0, "end", "not allowed")},
        5: {(0, "head", "missing"), (1, "head", "relationship"), (3, "g/unit", "missing"), (4, None, "unknown"), (6, None, "unknown"), (0, "end", "too many")},
        6: set(),
    }


def test_roots_without_a_template_and_includes_of_themselves(spark):
    items = spark.createDataFrame([(1, 0, *TOP)], ITEMS)
    roots = spark.createDataFrame([(1, 0, "X"), (1, 9, "T"), (2, 0, "T")], "doc int, item int, template string")
    rules, conditions = spark.createDataFrame(R, RULES), spark.createDataFrame(C, CONDITIONS)
    assert [tuple(r)[2:] for r in templates.findings(items, rules, conditions, roots).collect()] == [(None, "no template")] * 3
    assert templates.findings(items, rules, conditions, roots.limit(0)).count() == 0
    with pytest.raises(ValueError):
        templates.expanded(spark.createDataFrame([*R, ("G", "again", None, 9, *[None] * 7, "T")], RULES))
    assert {r.rule: r.under for r in templates.expanded(rules).where("template = 'T'").collect()} == {"head": None, "group": None, "note": None, "end": None, "g/size": "group", "g/deep": "group", "g/leaf": "g/deep", "g/unit": "g/size"}


def test_intervals(spark):
    rows = spark.createDataFrame([(d, i, p) for d in (1, 2) for i, p in enumerate([None, 0, 1, 2, 1, 0, 5])], "doc int, item int, parent int")
    found = {(r.doc, r.item): r["last"] for r in templates.intervals(rows.withColumn("x", F.lit(1))).collect()}
    assert found == {(d, i): e for d in (1, 2) for i, e in enumerate([6, 4, 3, 3, 4, 6, 6])}
