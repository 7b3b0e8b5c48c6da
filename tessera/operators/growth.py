"""Growth from seeds over the voxels of images: competing regions, and ways of least cost.

Both look for the best way from a seed to each voxel, whose cost grows voxel by voxel. Images are cut into tiles. Each
round a tile that has better offers from its neighbours takes them, spreads them within itself until nothing changes (all
voxels at once, by arrays), and offers its border to the tiles beyond. Tiles that get no better offer rest. A round is
one grouping by tile, so the rounds are as many as the tiles that the longest best way comes through (and again, where
ways wind), not as its voxels: at most `rounds`, beyond which it is an error. A task holds one tile of bounded size.

Voxels are rows (seg, z, y, x, value); a plane has one z. Those without a value, or without a row, are no ground to grow on.
Repeated rows of a voxel count with their mean. Rows without a place are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoints import checkpointed

VOXEL = ["seg", "z", "y", "x"]
TILE = ["seg", "tz", "ty", "tx"]
#: Voxels of a tile along z, y, x: of a plane, of a volume.
PLANE, VOLUME = (1, 64, 64), (16, 16, 16)
#: Costs as near as this are equal.
EQUAL = 1e-12

#: (cost, value of the voxel left, value of the one entered, length of the step) -> cost
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]


def affinity(cost: np.ndarray, a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """Strength (minus the cost) lessened by the difference of the values, which are fractions of the contrast."""
    return cost * np.maximum(0, 1 - np.abs(a - b))


def penalty(cost: np.ndarray, a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """Cost and the step's length times the mean of the values, which are penalties."""
    return cost + length * (a + b) / 2


def faces(volume: bool) -> list[tuple[int, int, int]]:
    near = [(0, 0, -1), (0, 0, 1), (0, -1, 0), (0, 1, 0)]
    return [*near, (-1, 0, 0), (1, 0, 0)] if volume else near


def around(volume: bool) -> list[tuple[int, int, int]]:
    return [(z, y, x) for z in ((-1, 0, 1) if volume else (0,)) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) != (0, 0, 0)]


class _Tile:
    """Costs, steps and labels of a tile with a rim of one voxel, flat arrays made dense."""

    def __init__(self, shape: tuple[int, int, int], values: np.ndarray):
        self.shape, self.full = shape, tuple(n + 2 for n in shape)
        self.value = values.reshape(self.full)
        self.cost, self.steps, self.label = np.full(self.full, np.inf), np.zeros(self.full, np.int64), np.full(self.full, 1 << 62, np.int64)

    def better(self, cost: np.ndarray, steps: np.ndarray, label: np.ndarray, at) -> np.ndarray:
        """Is a way better than the one known? By cost, then by fewer steps, then by the lesser label."""
        old = self.cost[at]
        with np.errstate(invalid="ignore"):
            tie = np.isfinite(old) & (np.abs(cost - old) <= EQUAL)
        return np.isfinite(cost) & ~np.isnan(self.value[at]) & (((cost < old) & ~tie) | (tie & ((steps < self.steps[at]) | ((steps == self.steps[at]) & (label < self.label[at])))))

    def spread(self, rule: Rule, moves: list[tuple[tuple[int, int, int], float]], worst: float) -> None:
        """Relax all steps at once until nothing changes. The rim is entered but not left again."""
        inner = tuple(slice(1, n + 1) for n in self.shape)
        while True:
            changed = False
            for move, length in moves:
                to = tuple(slice(1 + d, n + 1 + d) for d, n in zip(move, self.shape, strict=True))
                with np.errstate(invalid="ignore"):
                    cost = rule(self.cost[inner], self.value[inner], self.value[to], length)
                cost = np.where(np.isfinite(self.cost[inner]) & (cost < worst), cost, np.inf)
                steps, label = self.steps[inner] + 1, self.label[inner]
                good = self.better(cost, steps, label, to)
                if good.any():
                    changed = True
                    for own, new in ((self.cost, cost), (self.steps, steps), (self.label, label)):
                        own[to][good] = new[good]
            if not changed:
                return


def _tiled(voxels: DataFrame, tile: tuple[int, int, int]) -> DataFrame:
    """(seg, tz, ty, tx, at, values): for each tile with ground its voxels' places in the tile with its rim, and their values."""
    sizes = dict(zip("zyx", tile, strict=True))
    # a voxel lies in its own tile and, at a border, in the rims of those beyond
    near = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / sizes[c]).cast("long") for d in (0, -1, 1))))
    rows = voxels.where(F.col("value").isNotNull() & reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in VOXEL))).groupBy(*VOXEL).agg(F.avg("value").alias("value"))
    for c in "zyx":
        rows = rows.withColumn(f"t{c}", F.explode(near(c)))
    place = lambda c: F.col(c) - F.col(f"t{c}") * sizes[c] + 1
    at = (place("z") * (sizes["y"] + 2) + place("y")) * (sizes["x"] + 2) + place("x")
    packed = F.collect_list(F.struct(at.cast("int").alias("at"), F.col("value").alias("value")))
    return rows.groupBy(*TILE).agg(packed.alias("p")).select(*TILE, F.col("p.at").alias("at"), F.col("p.value").alias("values"))


def _offers_of(rows: DataFrame, tile: tuple[int, int, int]) -> DataFrame:
    """(tile, offers) of rows (voxel, cost, steps, label): the best of each voxel, for the tile that it is in."""
    own = rows
    for c, n in zip("zyx", tile, strict=True):
        own = own.withColumn(f"t{c}", F.floor(F.col(c) / n).cast("long"))
    offer = F.struct("z", "y", "x", "cost", "steps", "label")
    return own.groupBy(*TILE, "z", "y", "x").agg(F.min(F.struct("cost", "steps", "label")).alias("b")).select(*TILE, "z", "y", "x", "b.*").groupBy(*TILE).agg(F.collect_list(offer).alias("offers"))


_WAYS = "costs array<double>, steps array<long>, labels array<long>, new array<struct<z:long,y:long,x:long,cost:double,steps:long,label:long>>, taken boolean"
_OFFER = pa.struct([(c, pa.int64()) for c in "zyx"] + [("cost", pa.float64()), ("steps", pa.int64()), ("label", pa.int64())])
_ARROW = (pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(_OFFER), pa.bool_())


def _round(tile: tuple[int, int, int], rule: Rule, moves: list[tuple[tuple[int, int, int], float]], worst: float, kind: str):
    names = [*TILE, "at", "values", "costs", "steps", "labels", "new", "taken"]
    full = tuple(n + 2 for n in tile)

    def one(row: dict) -> tuple:
        values = np.full(int(np.prod(full)), np.nan)
        values[row["at"]] = row["values"]
        t = _Tile(tile, values)
        inner = tuple(slice(1, n + 1) for n in tile)
        if row["costs"] is not None:
            for own, held in ((t.cost, row["costs"]), (t.steps, row["steps"]), (t.label, row["labels"])):
                own[:] = np.array(held).reshape(full)
        corner = np.array([row[f"t{c}"] * n for c, n in zip("zyx", tile, strict=True)])
        at = tuple(np.array([[o[c] for c in "zyx"] for o in row["offers"]]).T - corner[:, None] + 1)
        cost, steps, label = (np.array([o[c] for o in row["offers"]]) for c in ("cost", "steps", "label"))
        good = t.better(cost, steps, label, at)
        new: list[dict] = []
        if good.any():
            at = tuple(a[good] for a in at)
            t.cost[at], t.steps[at], t.label[at] = cost[good], steps[good], label[good]
            before = [own.copy() for own in (t.cost, t.steps, t.label)]
            t.spread(rule, moves, worst)
            rim = np.ones(full, bool)
            rim[inner] = False
            rim &= (t.cost != before[0]) | (t.steps != before[1]) | (t.label != before[2])
            for place in np.argwhere(rim):
                z, y, x = (place - 1 + corner).tolist()
                k = tuple(place)
                new.append({"z": z, "y": y, "x": x, "cost": float(t.cost[k]), "steps": int(t.steps[k]), "label": int(t.label[k])})
        return t.cost.ravel().tolist(), t.steps.ravel().tolist(), t.label.ravel().tolist(), new, bool(good.any())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8):
                piece = batch.slice(k, 8)
                out = list(zip(*map(one, piece.select([*TILE[1:], "at", "values", "costs", "steps", "labels", "offers"]).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in (*TILE, "at", "values")), *(pa.array(o, t) for o, t in zip(out, _ARROW, strict=True))], names=names)

    return run, f"seg {kind}, tz long, ty long, tx long, at array<int>, values array<double>, {_WAYS}"


def best_ways(voxels: DataFrame, seeds: DataFrame, rule: Rule, neighbours: list[tuple[int, int, int]], tile: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), worst: float = np.inf, rounds: int = 1000) -> DataFrame:
    """(seg, z, y, x, cost, steps, label) of the voxels that a way from a seed (seg, z, y, x, cost, label) reaches at a cost below `worst`; RuntimeError after `rounds` rounds.

    Of ways of equal cost the one of fewer steps counts, then that of the lesser label.
    """
    kind = voxels.schema["seg"].dataType.simpleString()
    moves = [(m, float(np.sqrt(sum((d * s) ** 2 for d, s in zip(m, spacing, strict=True))))) for m in neighbours]
    none = {"costs": "array<double>", "steps": "array<long>", "labels": "array<long>"}
    long = seeds.select("seg", *(F.col(c).cast("long").alias(c) for c in "zyx"), F.col("cost").cast("double").alias("cost"), F.lit(0).cast("long").alias("steps"), F.col("label").cast("long").alias("label"))
    voxels = voxels.select("seg", *(F.col(c).cast("long").alias(c) for c in "zyx"), F.col("value").cast("double").alias("value"))
    state = checkpointed(_tiled(voxels, tile).select(*TILE, "at", "values", *(F.lit(None).cast(t).alias(c) for c, t in none.items())))
    offers = _offers_of(long.dropna(), tile)
    run, schema = _round(tile, rule, moves, worst, kind)
    for _ in range(rounds):
        met = state.join(offers, TILE).select(*TILE, "at", "values", *none, "offers")
        done = checkpointed(met.mapInArrow(run, schema))
        taken = done.where("taken")
        if taken.isEmpty():
            rows = state.where(F.col("costs").isNotNull()).select(*TILE, F.posexplode(F.arrays_zip("costs", "steps", "labels")).alias("at", "w")).where(F.col("w.costs") < worst)
            full = [n + 2 for n in tile]
            place = {"z": F.floor(F.col("at") / (full[1] * full[2])), "y": F.floor(F.col("at") / full[2]) % full[1], "x": F.col("at") % full[2]}
            inside = reduce(lambda a, b: a & b, (place[c].between(1, n) for c, n in zip("zyx", tile, strict=True)))
            return rows.where(inside).select("seg", *((F.col(f"t{c}") * n + place[c] - 1).cast("long").alias(c) for c, n in zip("zyx", tile, strict=True)), F.col("w.costs").alias("cost"), F.col("w.steps").alias("steps"), F.col("w.labels").alias("label"))
        state = checkpointed(state.join(taken.select(*TILE), TILE, "left_anti").unionByName(taken.select(*TILE, "at", "values", *none)))
        offers = _offers_of(taken.select("seg", F.explode("new").alias("o")).select("seg", "o.*"), tile)
    raise RuntimeError(f"ways are not settled after {rounds} rounds")


FOREGROUND, BACKGROUND = 0, 1


def grow(voxels: DataFrame, foreground: DataFrame, background: DataFrame, volume: bool = False, tile: tuple[int, int, int] | None = None, rounds: int = 1000) -> DataFrame:
    """(seg, z, y, x, strength, label): the seeds' regions, that compete for the voxels (label 0 for the foreground, 1 for the background).

    A seed has the strength 1; a step to a neighbour (of four, in volumes six) keeps as much of it as the two values are alike,
    measured by the segment's contrast, and the stronger region takes the voxel. Where strengths are equal the
    region of fewer steps takes it, then the foreground; a voxel that is a seed of both is foreground. Segments without
    seeds of both kinds on ground aren't grown. ValueError if a value isn't finite.
    """
    bad = F.isnan("value") | (F.abs("value") == F.lit(float("inf")))
    ground = voxels.where(F.col("value").isNotNull())
    contrast = checkpointed(ground.groupBy("seg").agg((F.max("value") - F.min("value")).cast("double").alias("_c"), F.count(F.when(bad, 1)).alias("_bad")))
    if not contrast.where("_bad > 0").isEmpty():
        raise ValueError("a value isn't finite")
    own = lambda df, label: df.select(*VOXEL, F.lit(label).alias("label")).distinct()
    on = own(foreground, FOREGROUND).union(own(background, BACKGROUND)).join(ground.select(*VOXEL).distinct(), VOXEL, "left_semi")
    both = on.groupBy("seg").agg(F.count_distinct("label").alias("_n")).where("_n = 2").select("seg")
    seeds = on.join(both, "seg", "left_semi").groupBy(*VOXEL).agg(F.min("label").alias("label")).withColumn("cost", F.lit(-1.0))
    scaled = ground.join(both, "seg", "left_semi").join(contrast, "seg").select(*VOXEL, (F.col("value") / F.when(F.col("_c") > 0, F.col("_c")).otherwise(1.0)).alias("value"))
    ways = best_ways(scaled, seeds, affinity, faces(volume), tile or (VOLUME if volume else PLANE), worst=-EQUAL, rounds=rounds)
    return ways.select(*VOXEL, (-F.col("cost")).alias("strength"), F.col("label").cast("int").alias("label"))


def least_paths(voxels: DataFrame, ends: DataFrame, weight: float = 64.0, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), volume: bool = True, tile: tuple[int, int, int] | None = None, rounds: int = 1000) -> DataFrame:
    """(seg, place, z, y, x, cost): for each segment the way of least cost from its start to its end, place 0 being the start.

    ends has (seg, z0, y0, x0, z1, y1, x1), one row a segment. A step to one of all neighbours costs its length times the
    mean penalty of the two voxels, 1 + weight d**2, d being how far a value is from the mean of the ends' values, as a
    fraction of the segment's range. Segments whose ends aren't on ground, or aren't joined by it, have no rows.

    The way is followed back from the end: a voxel's step is the one that its cost comes from, and the steps, each
    known by itself, are put in order by doubling their reach, so the rounds are the logarithm of the longest way.
    """
    ground = voxels.where(F.col("value").isNotNull()).groupBy(*VOXEL).agg(F.avg("value").alias("value"))
    at = lambda k: ends.select("seg", *(F.col(f"{c}{k}").alias(c) for c in "zyx")).join(ground, VOXEL)
    middle = at(0).select("seg", F.col("value").alias("_v0")).join(at(1).select("seg", F.col("value").alias("_v1")), "seg")
    range_ = ground.groupBy("seg").agg((F.max("value") - F.min("value")).alias("_r"))
    off = (F.col("value") - (F.col("_v0") + F.col("_v1")) / 2) / F.when(F.col("_r") > 0, F.col("_r")).otherwise(1.0)
    costly = checkpointed(ground.join(middle, "seg").join(range_, "seg").select(*VOXEL, (1 + weight * off * off).alias("value")))
    moves = around(volume)
    seeds = at(0).select(*VOXEL, F.lit(0.0).alias("cost"), F.lit(0).alias("label"))
    ways = checkpointed(best_ways(costly, seeds, penalty, moves, tile or (VOLUME if volume else PLANE), spacing, rounds=rounds).join(costly, VOXEL).select(*VOXEL, "cost", "steps", "value"))

    # of each voxel the neighbour that its best way comes from: the one of the least (cost with the step, steps, place)
    length = lambda m: float(np.sqrt(sum((d * s) ** 2 for d, s in zip(m, spacing, strict=True))))
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for c, d in zip("zyx", m, strict=True)), F.lit(length(m)).alias("l")) for m in moves))
    onward = ways.withColumn("m", F.explode(steps)).select("seg", *((F.col(c) + F.col(f"m.d{c}")).alias(c) for c in "zyx"), F.struct("z", "y", "x").alias("from"), F.col("cost").alias("_cost"), F.col("steps").alias("_steps"), F.col("value").alias("_value"), "m.l")
    entered = onward.join(ways, VOXEL).where("_cost < cost")
    came = F.min_by("from", F.struct((F.col("_cost") + F.col("l") * (F.col("_value") + F.col("value")) / 2).alias("c"), "_steps", "from"))
    back = entered.groupBy(*VOXEL).agg(came.alias("next")).select("seg", F.struct("z", "y", "x").alias("id"), "next")
    links = checkpointed(back)
    path = at(1).select("seg", F.struct("z", "y", "x").alias("id"), F.lit(0).cast("long").alias("n")).join(ways.select("seg", F.struct("z", "y", "x").alias("id")), ["seg", "id"], "left_semi")
    path, reach = checkpointed(path), 1
    while True:  # links lead `reach` steps back; those of the path give as many voxels more
        more = checkpointed(path.join(links, ["seg", "id"]).select("seg", F.col("next").alias("id"), (F.col("n") + reach).alias("n")))
        if more.isEmpty():
            break
        path = checkpointed(path.union(more))
        ahead = links.select("seg", F.col("id").alias("next"), F.col("next").alias("_next"))
        links, reach = checkpointed(links.join(ahead, ["seg", "next"]).select("seg", "id", F.col("_next").alias("next"))), reach * 2
    last = path.groupBy("seg").agg(F.max("n").alias("_last"))
    return path.join(last, "seg").select("seg", (F.col("_last") - F.col("n")).alias("place"), "id.z", "id.y", "id.x").join(ways.select(*VOXEL, "cost"), VOXEL).select("seg", "place", "z", "y", "x", "cost")
