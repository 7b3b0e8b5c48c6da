"""Masks as rows (segment, y, x): thresholds, set algebra, morphology, runs. All by joins and grouping on the pixel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import checkpointed

from . import graph

PIXEL = ["seg", "y", "x"]


def threshold(pixels: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Pixels whose value is in [low, high]."""
    return pixels.where(F.col(value).between(low, high)).select(*PIXEL).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).union(b.select(*PIXEL)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).intersect(b.select(*PIXEL))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).subtract(b.select(*PIXEL))


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select(*PIXEL).distinct().withColumn("_a", F.lit(1)).union(b.select(*PIXEL).distinct().withColumn("_a", F.lit(2)))
    return both.groupBy(*PIXEL).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def _around(mask: DataFrame) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))))
    return mask.select(*PIXEL).distinct().withColumn("_s", F.explode(steps)).select("seg", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))


def dilate(mask: DataFrame, rows: int, columns: int) -> DataFrame:
    """The pixels of the mask and their four neighbours inside the image."""
    return _around(mask).where((F.col("y") >= 0) & (F.col("y") < rows) & (F.col("x") >= 0) & (F.col("x") < columns)).distinct()


def erode(mask: DataFrame) -> DataFrame:
    """The pixels of the mask all of whose four neighbours are in it; those at the image's border have none outside."""
    return _around(mask).groupBy(*PIXEL).agg(F.count("*").alias("_n")).where("_n = 5").drop("_n")


def runs(mask: DataFrame) -> DataFrame:
    """(seg, y, x0, x1): the maximal runs x0 <= x < x1 of each row of the image."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("seg", "y").orderBy("x"))
    return mask.select(*PIXEL).distinct().withColumn("_i", island).groupBy("seg", "y", "_i").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_i")


def components(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """(seg, label, y, x0, x1): the runs of the mask with the number of their component, from 1, in order of its first run.

    Runs of neighbouring rows that touch are linked (also by a corner if `diagonal`), and the links make components.
    """
    reach = 1 if diagonal else 0
    r = runs(mask).withColumn("id", F.struct("seg", "y", "x0"))
    below = r.select("seg", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("id").alias("b"))
    links = r.join(below, ["seg", "y"]).where((F.col("x0") < F.col("b1") + reach) & (F.col("b0") < F.col("x1") + reach)).select(F.col("id").alias("a"), "b")
    named = r.join(graph.components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    firsts = named.select("seg", "label").distinct().withColumn("n", F.row_number().over(Window.partitionBy("seg").orderBy("label")))
    return named.join(firsts, ["seg", "label"]).select("seg", F.col("n").alias("label"), "y", "x0", "x1")


def component_sizes(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """(seg, label, pixels, and the corners of the box around) of each component."""
    return components(mask, diagonal).groupBy("seg", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def _labelled(tile: tuple[int, int, int], moves: list[tuple[int, int, int]]):
    """For each tile (its voxels' places `at`), the least place of each voxel's component within the tile."""
    full = tuple(n + 2 for n in tile)

    def one(at: list[int]) -> list[int]:
        none = int(np.prod(tile))
        label = np.full(full, none)
        inner = tuple(slice(1, n + 1) for n in tile)
        flat = np.full(none, none)
        flat[at] = at
        label[inner] = flat.reshape(tile)
        there = label < none
        while True:
            new = label.copy()
            for move in moves:
                for sign in (1, -1):
                    new[inner] = np.minimum(new[inner], label[tuple(slice(1 + sign * d, n + 1 + sign * d) for d, n in zip(move, tile, strict=True))])
            new[~there] = none
            old, own = label, new[inner].ravel()
            # a label's own label is at least as good
            own = np.where(own < none, np.append(own, none)[own], none)
            new[inner] = own.reshape(tile)
            label = new
            if (label == old).all():
                return own[at].tolist()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                piece = batch.slice(k, 64)
                roots = pa.array([one(a) for a in piece.column(4).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*piece.columns, roots], names=["seg", "tz", "ty", "tx", "at", "root"])

    return run


def volume_components(mask: DataFrame, corners: bool = False, tile: tuple[int, int, int] = (16, 16, 16)) -> DataFrame:
    """(seg, z, y, x, label) of the voxels (seg, z, y, x) of a volume, label being the number of their component, from 1, in order of its least voxel of all tiles' least ones.

    Voxels touch by their faces, with `corners` also by edges and corners. Components are found within tiles first, each by
    itself, and only those that touch across the borders of tiles are linked, so the rounds depend on tiles, not voxels.
    """
    sizes = dict(zip("zyx", tile, strict=True))
    ahead = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) > (0, 0, 0) and (corners or abs(z) + abs(y) + abs(x) == 1)]
    long = {c: F.col(c).cast("long").alias(c) for c in "zyx"}
    voxels = mask.select("seg", *long.values()).dropna(subset=list("zyx")).distinct()
    own = {c: F.floor(F.col(c) / n).cast("long") for c, n in sizes.items()}
    place = ((F.col("z") - own["z"] * sizes["z"]) * sizes["y"] + F.col("y") - own["y"] * sizes["y"]) * sizes["x"] + F.col("x") - own["x"] * sizes["x"]
    tiles = voxels.groupBy("seg", *(own[c].alias(f"t{c}") for c in "zyx")).agg(F.collect_list(place.cast("int")).alias("at"))
    kind = mask.schema["seg"].dataType.simpleString()
    local = tiles.mapInArrow(_labelled(tile, ahead), f"seg {kind}, tz long, ty long, tx long, at array<int>, root array<int>")
    each = local.select("seg", "tz", "ty", "tx", F.explode(F.arrays_zip("at", "root")).alias("p"))
    of = lambda p: (F.col("tz") * sizes["z"] + F.floor(p / (sizes["y"] * sizes["x"])), F.col("ty") * sizes["y"] + F.floor(p / sizes["x"]) % sizes["y"], F.col("tx") * sizes["x"] + p % sizes["x"])
    named = [v.cast("long").alias(c) for v, c in zip(of(F.col("p.at")), "zyx", strict=True)]
    root = F.struct("seg", *(v.cast("long").alias(c) for v, c in zip(of(F.col("p.root")), "zyx", strict=True)))
    rows = checkpointed(each.select("seg", *named, root.alias("root")))
    # steps that leave the tile
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for c, d in zip("zyx", m, strict=True))) for m in ahead))
    over = rows.withColumn("m", F.explode(steps))
    leaves = F.lit(False)
    for c, n in sizes.items():
        leaves = leaves | (F.floor(F.col(c) / n) != F.floor((F.col(c) + F.col(f"m.d{c}")) / n))
    met = over.where(leaves).select("seg", *((F.col(c) + F.col(f"m.d{c}")).alias(c) for c in "zyx"), F.col("root").alias("a"))
    links = met.join(rows.select("seg", *"zyx", F.col("root").alias("b")), ["seg", *"zyx"]).select("a", "b").distinct()
    labels = graph.components(links).select(F.col("node").alias("root"), F.col("label").alias("_best"))
    best = rows.select("root").distinct().join(labels, "root", "left").select("root", F.coalesce("_best", "root").alias("best"))
    numbers = best.select("best").distinct().withColumn("label", F.row_number().over(Window.partitionBy("best.seg").orderBy("best")))
    return rows.join(best.join(numbers, "best").select("root", "label"), "root").select("seg", "z", "y", "x", "label")


def flood(mask: DataFrame, seeds: DataFrame, diagonal: bool = False) -> DataFrame:
    """The runs of the components that hold a seed (seg, y, x)."""
    parts = components(mask, diagonal)
    hit = parts.join(seeds.select("seg", "y", F.col("x").alias("_x")).distinct(), ["seg", "y"]).where("_x >= x0 AND _x < x1").select("seg", "label").distinct()
    return parts.join(hit, ["seg", "label"], "left_semi")


def brush(seeds: DataFrame, radius: int, rows: int, columns: int) -> DataFrame:
    """The pixels of the image within a radius of the seeds (seg, y, x)."""
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius))
    near = seeds.select(*PIXEL).distinct().withColumn("_s", F.explode(steps)).select("seg", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))
    return near.where((F.col("y") >= 0) & (F.col("y") < rows) & (F.col("x") >= 0) & (F.col("x") < columns)).distinct()


def rasterized(polygons: DataFrame, rows: int, columns: int) -> DataFrame:
    """(seg, y, x): pixels whose centres lie inside the polygons (seg, points), by the even-odd rule, each row of the image on its own.

    An edge gives one crossing to each row between its ends, and the crossings of a row, in order, open and close its runs.
    """
    following = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    edges = polygons.where(F.size("points") >= 3).withColumn("_poly", F.monotonically_increasing_id()).select("seg", "_poly", F.explode(F.arrays_zip(F.col("points").alias("p"), following.alias("q"))).alias("e")).select("seg", "_poly", "e.p", "e.q").where("p.y <> q.y")
    low, high = F.least("p.y", "q.y"), F.greatest("p.y", "q.y")
    first, last = F.greatest(F.lit(0), F.ceil(low - F.lit(0.5))).cast("int"), F.least(F.lit(rows - 1), F.ceil(high - F.lit(0.5)) - 1).cast("int")
    each = edges.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    x = F.col("p.x") + (F.col("y") + F.lit(0.5) - F.col("p.y")) * (F.col("q.x") - F.col("p.x")) / (F.col("q.y") - F.col("p.y"))
    w = Window.partitionBy("seg", "_poly", "y").orderBy("_x")
    pairs = each.withColumn("_x", x.cast("double")).withColumn("_n", F.row_number().over(w)).withColumn("_to", F.lead("_x").over(w)).where("_n % 2 = 1 AND _to IS NOT NULL")
    x0, x1 = F.greatest(F.lit(0), F.ceil(F.col("_x") - F.lit(0.5))).cast("int"), F.least(F.lit(columns - 1), F.ceil(F.col("_to") - F.lit(0.5)) - 1).cast("int")
    return pairs.where(x0 <= x1).select("seg", "y", F.explode(F.sequence(x0, x1)).alias("x")).distinct()


def boundary(mask: DataFrame) -> DataFrame:
    """(seg, id, next, x, y, heading): the sides of pixels between a mask and what is outside, with the mask on the right.

    Each starts at the corner (x, y) and heads east, south, west or north (0 to 3); next is the one that it runs into. Where
    four meet, that is the one to the right, so pixels that touch by a corner have outlines of their own.
    """
    # fixed values: heading, the neighbour that must be outside, the corner a side starts at and the one it ends at
    sides = [(0, (-1, 0), (0, 0), (0, 1)), (1, (0, 1), (0, 1), (1, 1)), (2, (1, 0), (1, 1), (1, 0)), (3, (0, -1), (1, 0), (0, 0))]
    of = F.array(*(F.struct(F.lit(h).alias("h"), *(F.lit(v).alias(n) for n, v in zip(("ny", "nx", "ay", "ax", "by", "bx"), (*o, *a, *b), strict=True))) for h, o, a, b in sides))
    here = mask.select(*PIXEL).distinct()
    each = here.withColumn("s", F.explode(of)).withColumn("_y", F.col("y") + F.col("s.ny")).withColumn("_x", F.col("x") + F.col("s.nx"))
    free = each.join(here.select("seg", F.col("y").alias("_y"), F.col("x").alias("_x")), ["seg", "_y", "_x"], "left_anti")
    edges = checkpointed(free.select("seg", F.struct("y", "x", F.col("s.h").alias("h")).alias("id"), (F.col("y") + F.col("s.ay")).alias("y"), (F.col("x") + F.col("s.ax")).alias("x"), (F.col("y") + F.col("s.by")).alias("to_y"), (F.col("x") + F.col("s.bx")).alias("to_x"), F.col("s.h").alias("heading")))
    after = edges.select("seg", F.col("y").alias("to_y"), F.col("x").alias("to_x"), F.struct(F.col("heading"), F.col("id")).alias("_after"))
    turn = F.element_at(F.array(*map(F.lit, (1, 0, 3, 2))), (F.col("_after.heading") - F.col("heading") + 4) % 4 + 1)  # right, ahead, left
    return edges.join(after, ["seg", "to_y", "to_x"]).groupBy("seg", "id", "x", "y", "heading").agg(F.min_by("_after.id", turn).alias("next")).select("seg", "id", "next", "x", "y", "heading")


def contours(mask: DataFrame) -> DataFrame:
    """(seg, contour, place, x, y): the corners of each closed outline of a mask, in order; outlines of holes run the other way.

    An outline is named by its least side and starts there. Sides find their outline and place by doubling their reach each
    round, so rounds are as many as the logarithm of the longest outline, and lineage is cut by checkpoints.
    """
    edges = checkpointed(boundary(mask))
    state = edges.select("seg", "id", "next", F.least("id", "next").alias("least"))
    while True:
        ahead = state.select("seg", F.col("id").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        new = checkpointed(state.join(ahead, ["seg", "next"]).select("seg", "id", F.col("_next").alias("next"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("_less")))
        if new.where("_less").isEmpty():
            break
        state = new.drop("_less")
    named = edges.join(new.select("seg", "id", F.col("least").alias("contour")), ["seg", "id"])
    onward = F.when(F.col("next") != F.col("contour"), F.col("next"))
    left = checkpointed(named.select("seg", "id", "contour", onward.alias("next"), onward.isNotNull().cast("int").alias("left")))
    while not left.where("next IS NOT NULL").isEmpty():
        ahead = left.select("seg", F.col("id").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        left = checkpointed(left.join(ahead, ["seg", "next"], "left").select("seg", "id", "contour", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    came = edges.select("seg", F.col("next").alias("id"), F.col("heading").alias("_came"))
    corners = edges.join(came, ["seg", "id"]).where("heading <> _came").select("seg", "id", "x", "y").join(left, ["seg", "id"])
    order = Window.partitionBy("seg", "contour").orderBy(F.desc("left"))
    return corners.withColumn("place", F.row_number().over(order)).select("seg", "contour", "place", "x", "y")


def label_map(mask: DataFrame) -> DataFrame:
    """(y, x, label, n): each pixel's least segment and the number of segments that hold it; more than one can't be told by one label."""
    return mask.select(*PIXEL).distinct().groupBy("y", "x").agg(F.min("seg").alias("label"), F.count("*").alias("n"))
