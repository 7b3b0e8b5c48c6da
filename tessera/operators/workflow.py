"""Workflow steps and their deliveries; de-identification and validation by tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .match import InvalidQuery


def claim_due(deliveries: DataFrame, now: Column, lease_seconds: int, order: list[str], limit: int) -> DataFrame:
    """The first `limit` deliveries that are due, leased: attempts counted up, state in-flight, with an end of the lease.

    Due are pending and failed ones whose next attempt has come, and those in flight whose lease has ended.
    """
    due = F.when(F.col("state").isin("pending", "failed"), F.coalesce(F.col("next_attempt"), now) <= now).when(F.col("state") == "in-flight", F.col("lease_until") <= now).otherwise(False)
    claimed = deliveries.where(due).orderBy(*order).limit(limit)
    return claimed.withColumn("attempts", F.col("attempts") + 1).withColumn("state", F.lit("in-flight")).withColumn("lease_until", now + F.make_interval(secs=F.lit(lease_seconds)))


def after_completion(attempts: Column, delivered: Column, most: int) -> Column:
    """The state of a delivery after an attempt."""
    return F.when(attempts > most, "exhausted").when(delivered, "delivered").when(attempts >= most, "exhausted").otherwise("failed")


def page_after(steps: DataFrame, sequence: str, after: int, limit: int) -> DataFrame:
    """The `limit` steps that follow one in sequence."""
    return steps.where(F.col(sequence) > after).orderBy(sequence).limit(limit)


def listed(rows: DataFrame, order: str, limit: int, after=None, **wanted) -> DataFrame:
    """The first `limit` rows in order, past `after`, whose columns hold the values wanted: one, or any of a list; an empty one asks nothing."""
    if limit <= 0:
        raise InvalidQuery("a list needs a positive limit")
    for column, value in wanted.items():
        values = [v for v in (value if isinstance(value, list | tuple | set) else [value]) if v not in ("", None)]
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return (rows if after is None else rows.where(F.col(order) > after)).orderBy(order).limit(limit)


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event columns, recipient) once for each subscription that an event matches.

    subscriptions: recipient, key (a column of events, as text), value. A recipient has all of its keys matched; one
    without keys gets nothing. Keys are few, the events' columns, so events are turned into (key, value) rows and joined.
    """
    keys = [c for c in events.columns if c != "event_id"]
    each = events.select("event_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys)))).alias("key", "value"))
    wanted = subscriptions.select("recipient", "key", "value").distinct()
    total = wanted.groupBy("recipient").agg(F.count_distinct("key").alias("_all"))
    met = each.join(wanted, ["key", "value"]).groupBy("event_id", "recipient").agg(F.count_distinct("key").alias("_met"))
    return met.join(total, "recipient").where("_met = _all").select("event_id", "recipient")


#: What a profile's action codes do to an attribute of each requirement type: 1, 2 and 3 (fixed values).
ACTIONS = {
    "X": ("remove", "remove", "remove"),
    "Z": ("empty", "empty", "empty"),
    "D": ("dummy", "dummy", "dummy"),
    "C": ("clean", "clean", "clean"),
    "U": ("remap", "remap", "remap"),
    "K": ("keep", "keep", "keep"),
    "Z/D": ("dummy", "empty", "empty"),
    "X/Z": ("empty", "empty", "remove"),
    "X/D": ("dummy", "remove", "remove"),
    "X/Z/D": ("dummy", "empty", "remove"),
    "X/Z/U*": ("remap", "empty", "remove"),
}


def action(code: str, requirement: int = 3) -> str:
    """What an action code does to an attribute of a requirement type."""
    if code not in ACTIONS or requirement not in (1, 2, 3):
        raise InvalidQuery(f"no such action: {code} of type {requirement}")
    return ACTIONS[code][requirement - 1]


def actions(spark: SparkSession) -> DataFrame:
    """(code, requirement, action): the same as a table, for joins with elements in rows."""
    return spark.createDataFrame([(c, k + 1, a) for c, kinds in ACTIONS.items() for k, a in enumerate(kinds)], "code string, requirement int, action string")


def deidentified(df: DataFrame, codes: dict[str, str], secret: str, requirements: dict[str, int] | None = None, clean: dict[str, Column] | None = None) -> DataFrame:
    """df with its columns treated by action codes and requirement types (3 where none is given).

    X gone, Z empty, D a dummy of the column's type, U a UID remapped, C what `clean` gives for the column; columns without
    a code are kept. An empty value is an empty text, or null in other types.
    """
    from tessera.functions.scalars import remapped_uid

    if unknown := set(codes.values()) - ACTIONS.keys():
        raise InvalidQuery(f"no such actions: {sorted(unknown)}")
    out = []
    for f in df.schema:
        what, kind = action(codes.get(f.name, "K"), (requirements or {}).get(f.name, 3)), f.dataType
        text = kind.typeName() == "string"
        if what == "remove":
            continue
        if what == "remap":
            out.append(remapped_uid(F.col(f.name).cast("string"), secret).alias(f.name))
        elif what == "clean":
            if f.name not in (clean or {}):
                raise InvalidQuery(f"no way to clean {f.name} is given")
            out.append(clean[f.name].alias(f.name))
        elif what == "empty":
            out.append((F.lit("") if text else F.lit(None).cast(kind)).alias(f.name))
        elif what == "dummy":
            dummy = F.lit("ANONYMOUS") if text else F.lit("1900-01-01").cast(kind) if kind.typeName() in ("date", "timestamp", "timestamp_ntz") else F.lit(0).cast(kind) if isinstance(kind, NumericType) else F.lit(None).cast(kind)
            out.append(dummy.alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def element_actions(elements: DataFrame, profile: DataFrame, default: str = "keep") -> DataFrame:
    """elements (tag, requirement, ...) with `action`, by a profile (tag, code) in rows; tags of odd groups that it doesn't name are private and removed."""
    table = profile.join(actions(elements.sparkSession), "code").select("tag", "requirement", "action")
    private = F.conv(F.substring("tag", 1, 4), 16, 10).cast("int") % 2 == 1
    return elements.join(table, ["tag", "requirement"], "left").withColumn("action", F.coalesce("action", F.when(private, "remove").otherwise(default)))


def shifted(date: Column, patient: Column, secret: str, days: int = 365) -> Column:
    """A date moved back by 1 to `days` days, the same number for all of a patient's dates."""
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(secret), F.lit(":"), patient.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.date_sub(date.cast("date"), (number % days + 1).cast("int"))


def findings(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code) for each rule, given as the condition that a row breaks it, in one pass."""
    broken = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items())), lambda c: c.isNotNull())
    return df.select(key, F.explode(broken).alias("code"))


#: What values of a representation look like, and the most characters they have (fixed values).
VR_RULES = {
    "AE": (r"[ -~]*", 16), "AS": (r"\d{3}[DWMY]", 4), "CS": (r"[A-Z0-9 _]*", 16), "DA": (r"\d{8}", 8), "DS": (r" *[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)? *", 16),
    "IS": (r" *[+-]?\d+ *", 12), "LO": (r"[^\\\x00-\x1a\x1c-\x1f]*", 64), "SH": (r"[^\\\x00-\x1a\x1c-\x1f]*", 16), "TM": (r"([01]\d|2[0-3])([0-5]\d([0-5]\d(\.\d{1,6})?)?)? *", 14), "UI": (r"[0-9.]*", 64),
}


def vr_findings(elements: DataFrame, key: str) -> DataFrame:
    """(key, tag, code) of elements (key, tag, vr, value) whose value is too long or isn't of its representation; empty values are right."""
    bad, long = F.lit(False), F.lit(False)
    for vr, (pattern, most) in VR_RULES.items():
        bad = bad | ((F.col("vr") == vr) & ~F.col("value").rlike(f"^(?:{pattern})\\z"))
        long = long | ((F.col("vr") == vr) & (F.length("value") > most))
    codes = F.filter(F.array(F.when(bad, F.lit("format")), F.when(long, F.lit("length"))), lambda c: c.isNotNull())
    return elements.where(F.col("value") != "").select(key, "tag", F.explode(codes).alias("code"))


def recipients(steps: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(step, recipient): who gets the news of each step: subscribers to it, and to all steps where they haven't unsubscribed from it.

    subscriptions: recipient, step (null for all), active; the one for a step stands before the one for all.
    """
    own = subscriptions.where("step IS NOT NULL")
    everywhere = subscriptions.where("step IS NULL AND active").select("recipient").distinct()
    all_ = steps.select("step").distinct().crossJoin(everywhere)  # as many rows as there are answers; Spark sends round the side that it knows to be small
    return own.where("active").join(steps.select("step").distinct(), "step").select("step", "recipient").union(all_.join(own.where("NOT active").select("step", "recipient"), ["step", "recipient"], "left_anti").select("step", "recipient")).distinct()


def kept_subscriptions(subscriptions: DataFrame, steps: DataFrame, most: int) -> DataFrame:
    """subscriptions (recipient, step or null for all, active, updated) without the unsubscriptions that say nothing any more.

    One stays while its step is there and its recipient subscribes to all steps, and of those the `most` latest stay; ties
    go to the larger recipient and step.
    """
    active, ended = subscriptions.where("active"), subscriptions.where("NOT active AND step IS NOT NULL")
    everywhere = active.where("step IS NULL").select("recipient").distinct()
    needed = ended.join(steps.select("step").distinct(), "step", "left_semi").join(everywhere, "recipient", "left_semi")
    return active.unionByName(needed.orderBy(F.desc("updated"), F.desc("recipient"), F.desc("step")).limit(most).select(*active.columns))


def report(findings: DataFrame, key: str) -> DataFrame:
    """(key, n_errors, n_warnings, codes): the findings (key, code, severity) of each key counted, with its codes in order."""
    n = lambda severity: F.count(F.when(F.col("severity") == severity, 1))
    return findings.groupBy(key).agg(n("error").alias("n_errors"), n("warning").alias("n_warnings"), F.array_sort(F.collect_set("code")).alias("codes"))


def purged(transactions: DataFrame, done_before: Column) -> DataFrame:
    """The transactions without those completed or failed before a time."""
    return transactions.where(~F.coalesce(F.col("state").isin("completed", "failed") & (F.col("finished") < done_before), F.lit(False)))


def swapped(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows (id, version, state) of a store after changes (id, expected, state): one takes effect where its expected version is the stored one.

    Of several changes of one row that expect the same version the one of the least state is taken. `applied` says whether a row changed.
    """
    wanted = changes.groupBy("id", F.col("expected").alias("version")).agg(F.min("state").alias("_new"))
    both = store.join(wanted, ["id", "version"], "left")
    applied = F.col("_new").isNotNull()
    return both.select("id", F.when(applied, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.coalesce("_new", "state").alias("state"), applied.alias("applied"))


def private_kept(elements: DataFrame, allowed: DataFrame, by: list[str]) -> DataFrame:
    """The elements (by, tag, creator, ...) without private ones that aren't allowed (tag, creator).

    A private tag is 8 hexadecimal digits of an odd group. Data elements are kept if their tag and creator are listed, and
    with a listed one the tag that reserves its block; a listed reserving tag needs no creator.
    """
    private = F.conv(F.substring("tag", 4, 1), 16, 10).cast("int") % 2 == 1
    data = F.substring("tag", 5, 4) >= "1000"
    named = allowed.select(F.upper("tag").alias("tag"), F.trim("creator").alias("creator"))
    reserving = named.select(F.when(data, F.concat(F.substring("tag", 1, 4), F.lit("00"), F.substring("tag", 5, 2))).otherwise(F.col("tag")).alias("tag")).distinct()
    listed = named.where(data).where("creator <> ''").distinct().withColumnRenamed("creator", "_creator").withColumn("_data", F.lit(True))
    blocks = reserving.withColumn("_block", F.lit(True))
    each = elements.withColumn("_creator", F.trim("creator")).join(listed, ["tag", "_creator"], "left").join(blocks, "tag", "left")
    return each.where(~private | F.coalesce("_data", "_block", F.lit(False))).select(*elements.columns)


def visual_risk(value: Column) -> Column:
    """(risk, value) of a burned-in or recognizable-features text: YES is present, NO absent, all else unknown; a text that is neither is given as OTHER."""
    one = F.upper(F.trim(value))
    risk = F.when(one == "YES", "present").when(one == "NO", "absent").otherwise("unknown")
    return F.struct(risk.alias("risk"), F.when(one.isin("YES", "NO"), one).when(value.isNotNull(), "OTHER").alias("value"))


def masked_regions(pixels: DataFrame, regions: DataFrame, by: list[str], value: str, fill: float) -> DataFrame:
    """pixels (by, y, x, value) with `fill` inside the regions (by, x, y, width, height) of their frame.

    The regions of a frame are few and travel as one array, so pixels meet them by frame and aren't multiplied.
    """
    own = regions.where("width > 0 AND height > 0").groupBy(*by).agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("_regions"))
    x, y = F.col("x"), F.col("y")
    inside = F.exists("_regions", lambda r: (x >= r["x"]) & (x < r["x"] + r["width"]) & (y >= r["y"]) & (y < r["y"] + r["height"]))
    return pixels.join(own, by, "left").withColumn(value, F.when(inside, F.lit(fill)).otherwise(F.col(value))).select(*pixels.columns)


def required_findings(instances: DataFrame, elements: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, tag) of the elements that an instance (key, sop_class) must have and hasn't; a rule (sop_class, tag) without a class is for all."""
    every = F.lit("*")
    wanted = rules.select(F.coalesce("sop_class", every).alias("_class"), "tag").distinct()
    each = instances.select(key, F.explode(F.array_distinct(F.array(F.coalesce("sop_class", every), every))).alias("_class"))
    return each.join(wanted, "_class").select(key, "tag").distinct().join(elements.select(key, "tag"), [key, "tag"], "left_anti")


def dictionary_findings(elements: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """(key, tag, code) of elements (key, tag, vr, n) that a dictionary (tag, vr, vm) is at odds with.

    vr may name several, as in "US or SS"; UN is never wrong. vm is a number of values, a range, or open, as in 1-n or 2-2n
    (at least two, and a multiple of two); no values are never wrong, nor are tags that the dictionary doesn't know.
    """
    known = elements.join(entries.select("tag", F.split("vr", " or ").alias("_vr"), "vm"), "tag")
    part = lambda k: F.nullif(F.regexp_extract("vm", r"^(\d+)(?:-(?:(\d+)|(\d*)n))?$", k), F.lit("")).cast("int")
    low, high, step = part(1), part(2), F.coalesce(part(3), F.lit(1))
    most = F.when(F.col("vm").endswith("n"), F.lit(2**31 - 1)).otherwise(F.coalesce(high, low))
    vr = F.when((F.col("vr") != "UN") & ~F.array_contains("_vr", F.col("vr")), "representation")
    number = F.when((F.col("n") > 0) & ((F.col("n") < low) | (F.col("n") > most) | (F.col("n") % step != 0)), "multiplicity")
    return known.select(key, "tag", F.explode(F.filter(F.array(vr, number), lambda c: c.isNotNull())).alias("code"))


def first_findings(findings: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first `most` findings of each key, and with each how many there are (n)."""
    w = Window.partitionBy(key)
    return findings.withColumn("n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(*order))).where(F.col("_k") <= most).drop("_k")
