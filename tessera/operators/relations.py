"""What objects refer to: references with the role that their object's class gives them, each checked, findings beside the edges.

objects are rows (object, sop_class, and others of one's own), candidates the references found in them: (object, place,
study, series, sop_class, sop_instance, frames), also `segment`, true for those that name a segment of a measurement.
An object and its candidates are joined by `object`, each candidate by itself, so an object of very many references is
no more than many rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import is_uid, normal_uid

_P = "1.2.840.10008.5.1.4.1.1."
#: Classes of objects, what they are, the role of their references, whether they can be written anew, and whether a reference needs a study and a series (fixed values).
CLASSES = (
    (f"{_P}66.4", "seg", "source_image", True, False, True), (f"{_P}66.7", "seg", "source_image", True, False, True),
    (f"{_P}11.1", "gsps", "presentation_image", True, False, True), (f"{_P}88.59", "kos", "key_object", True, True, True),
    (f"{_P}481.3", "rtstruct", "contour_image", True, False, False), (f"{_P}481.2", "rtdose", "rt_object", False, False, False),
    (f"{_P}30", "parametric_map", "source_image", False, False, False),
    (f"{_P}88.22", "sr_measurement", "measurement_image", True, False, False), (f"{_P}88.33", "sr_measurement", "measurement_image", True, False, False), (f"{_P}88.34", "sr_measurement", "measurement_image", True, False, False),
    (f"{_P}11.6", "vps", "presentation_input", True, False, False), (f"{_P}11.7", "vps", "presentation_input", True, False, False), (f"{_P}11.9", "vps", "presentation_input", True, False, False), (f"{_P}11.10", "vps", "presentation_input", True, False, False), (f"{_P}11.11", "vps", "presentation_input", True, False, False),
    (f"{_P}66.1", "registration", "registration_source", False, False, False), (f"{_P}66.3", "registration", "registration_source", False, False, False),
)
#: Kinds of registrations, the more general ones last (fixed values).
REGISTRATIONS = ("RIGID", "RIGID_SCALE", "AFFINE")


def clean_uid(uid: Column) -> Column:
    """Without spaces and zero bytes around; empty for none."""
    return F.coalesce(F.trim(normal_uid(uid)), F.lit(""))


def _told(sop_class: Column, field: int, otherwise: Column) -> Column:
    """A field of CLASSES, by the class."""
    of: dict = {}
    for row in CLASSES:
        of.setdefault(row[field], []).append(row[0])
    return reduce(lambda rest, v: F.when(clean_uid(sop_class).isin(of[v]), F.lit(v)).otherwise(rest), of, otherwise)


def object_kind(sop_class: Column) -> Column:
    """What an object of a class is; an object of another class is an image, one without a class something else."""
    return _told(sop_class, 1, F.when(clean_uid(sop_class) == "", "other").otherwise("image"))


def is_editable(sop_class: Column) -> Column:
    return _told(sop_class, 3, F.lit(False))


def identified(objects: DataFrame, known: DataFrame, fields: list[str]) -> DataFrame:
    """objects with `kind` and `editable`, and each of the fields as the catalog `known` (object, fields) has it, else as the object itself."""
    named = known.dropDuplicates(["object"]).select("object", *(F.col(f).alias(f"_{f}") for f in fields))
    both = objects.join(named, "object", "left")
    first = lambda f: F.when(clean_uid(F.col(f"_{f}")) != "", clean_uid(F.col(f"_{f}"))).otherwise(clean_uid(F.col(f)))
    found = both.select(*(first(c).alias(c) if c in fields else F.col(c) for c in objects.columns))
    return found.withColumn("kind", object_kind(F.col("sop_class"))).withColumn("editable", is_editable(F.col("sop_class")))


def _finding(uid: Column, needed: Column, name: str) -> Column:
    return F.when(uid == "", F.when(needed, F.lit(f"missing_{name}"))).when(~is_uid(uid), F.lit(f"invalid_{name}"))


def resolved(objects: DataFrame, candidates: DataFrame) -> DataFrame:
    """(object, place, role, study, series, sop_class, sop_instance, frames, findings, valid): a row for each candidate of an object whose class has references.

    findings are the codes of what a reference lacks or has wrong, in order; a reference is valid without any. A study and
    a series are needed where the class says so, and must be identifiers wherever they are given. Of objects marked as
    `malformed` (a column that objects may have) only the references that aren't whole are told. Candidates of no
    object, or of images, have no row; a null object matches nothing.
    """
    malformed = F.coalesce(F.col("malformed"), F.lit(False)) if "malformed" in objects.columns else F.lit(False)
    own = objects.select("object", F.col("sop_class").alias("_class"), malformed.alias("_malformed")).withColumn("_role", _told(F.col("_class"), 2, F.lit(None))).where("_role IS NOT NULL")
    rows = candidates if "segment" in candidates.columns else candidates.withColumn("segment", F.lit(False))
    rows = rows.select("object", "place", *(clean_uid(F.col(c)).alias(c) for c in ("study", "series", "sop_class", "sop_instance")), "frames", F.coalesce("segment", F.lit(False)).alias("segment"))
    each = rows.join(own, "object")
    each = each.where(~F.col("_malformed") | ((F.col("sop_class") != "") | (F.col("sop_instance") != "")) & ~(is_uid(F.col("sop_class")) & is_uid(F.col("sop_instance"))))
    measured = _told(F.col("_class"), 1, F.lit("")) == "sr_measurement"
    role = F.when(measured & F.col("segment"), "segment").otherwise(F.col("_role"))
    needs = lambda field: _told(F.col("_class"), field, F.lit(False)) & ~F.col("_malformed")
    true = F.lit(True)
    findings = F.array_compact(F.array(_finding(F.col("sop_class"), true, "sop_class_uid"), _finding(F.col("sop_instance"), true, "sop_instance_uid"), _finding(F.col("study"), needs(4), "study_instance_uid"), _finding(F.col("series"), needs(5), "series_instance_uid")))
    return each.select("object", "place", role.alias("role"), "study", "series", "sop_class", "sop_instance", "frames", findings.alias("findings"), (F.size(findings) == 0).alias("valid"))


def referenced(edges: DataFrame, field: str) -> DataFrame:
    """(object, uid, place): the different identifiers of a field that an object's valid references name, at the place of the first."""
    return edges.where(F.col("valid") & (F.col(field) != "")).groupBy("object", F.col(field).alias("uid")).agg(F.min("place").alias("place"))


def references_to(edges: DataFrame, targets: DataFrame, field: str = "sop_instance") -> DataFrame:
    """The valid edges that lead to one of the targets (uid)."""
    return edges.where("valid").join(targets.select(clean_uid(F.col("uid")).alias(field)).distinct(), field, "left_semi")


def registration_types(items: DataFrame) -> DataFrame:
    """(object, type): the most general type of an object's registrations (object, type); null if none is known."""
    rank = reduce(lambda rest, k: F.when(F.col("type") == REGISTRATIONS[k], k + 1).otherwise(rest), range(len(REGISTRATIONS)), F.lit(None).cast("int"))
    return items.groupBy("object").agg(F.max(rank).alias("_r")).select("object", F.get(F.array(*map(F.lit, REGISTRATIONS)), F.col("_r") - 1).alias("type"))
