"""Growth from seeds, least-cost paths, distances, shapes across gaps and simplified outlines, against small brute-force runs."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import growth, masks, shapes

AROUND = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) != (0, 0, 0)]


def grown(values, seeds, moves):
    """Regions by a queue of the strongest, fewest steps, least label."""
    contrast = max(values.values()) - min(values.values()) or 1
    best, queue = {}, [(-1.0, 0, label, v) for v, label in seeds.items()]
    heapq.heapify(queue)
    while queue:
        cost, steps, label, v = heapq.heappop(queue)
        if v in best:
            continue
        best[v] = (-cost, label)
        for m in moves:
            n = tuple(a + b for a, b in zip(v, m, strict=True))
            if n in values and n not in best:
                s = -cost * max(0, 1 - abs(values[v] / contrast - values[n] / contrast))
                if s > 1e-12:
                    heapq.heappush(queue, (-s, steps + 1, label, n))
    return best


def image(r, shape, levels):
    return {(z, y, x): float(r.choice(levels)) for z in range(shape[0]) for y in range(shape[1]) for x in range(shape[2]) if r.random() > 0.05}


@pytest.mark.parametrize("volume", [False, True])
def test_grow_equals_a_queue(spark, volume):
    r = random.Random(6)
    shape, tile = ((5, 7, 9), (2, 3, 4)) if volume else ((1, 23, 19), (1, 5, 6))
    rows, front, back, want = [], [], [], {}
    moves = growth.faces(volume)
    for seg in "ab":
        values = image(r, shape, [0, 3, 10, 11, 40] if seg == "a" else [1.25, 7.5, 9.0625, 33.5])
        rows += [(seg, *v, e) for v, e in values.items()]
        places = r.sample(sorted(values), 9)
        seeds = {v: 1 for v in places[4:]} | {v: 0 for v in places[:5]}
        front += [(seg, *v) for v in places[:5]]
        back += [(seg, *v) for v in places[4:]]
        want |= {(seg, *v): w for v, w in grown(values, seeds, moves).items()}
    rows += [("none", 0, 0, 0, 1.0), ("a", None, 0, 0, 1.0), ("a", 90, 90, 90, None)]
    front.append(("none", 0, 0, 0))
    voxels = spark.createDataFrame(rows, "seg string, z int, y int, x int, value double")
    f, b = (spark.createDataFrame(s, "seg string, z int, y int, x int") for s in (front, back))
    found = growth.grow(voxels, f, b, volume, tile).collect()
    assert {tuple(v[:4]): v.label for v in found} == {k: label for k, (_, label) in want.items()}
    assert all(abs(v.strength - want[tuple(v[:4])][0]) < 1e-9 for v in found)
    with pytest.raises(RuntimeError):
        growth.grow(voxels, f, b, volume, tile, rounds=1)
    with pytest.raises(ValueError):
        growth.grow(voxels.withColumn("value", F.lit(float("nan"))), f, b)


def test_least_paths_equal_dijkstra(spark):
    r = random.Random(8)
    spacing, rows, ends, want = (2.0, 1.0, 1.5), [], [], {}
    for seg in (1, 2):
        values = image(r, (6, 9, 8), [0, 5, 30, 100])
        start, end = r.sample(sorted(values), 2)
        rows += [(seg, *v, e) for v, e in values.items()]
        ends.append((seg, *start, *end))
        seed, span = (values[start] + values[end]) / 2, max(values.values()) - min(values.values())
        cost = {v: 1 + 64 * ((e - seed) / span) ** 2 for v, e in values.items()}
        best, queue = {}, [(0.0, start)]
        while queue:
            c, v = heapq.heappop(queue)
            if v in best:
                continue
            best[v] = c
            for m in AROUND:
                n = tuple(a + b for a, b in zip(v, m, strict=True))
                if n in cost:
                    heapq.heappush(queue, (c + math.hypot(*(a * b for a, b in zip(m, spacing, strict=True))) * (cost[v] + cost[n]) / 2, n))
        want[seg] = (best[end], start, end, cost)
    rows += [(3, 0, 0, 0, 1.0), (3, 0, 0, 5, 1.0)]
    ends += [(3, 0, 0, 0, 0, 0, 5), (4, 0, 0, 0, 1, 1, 1)]
    voxels, e = spark.createDataFrame(rows, "seg long, z int, y int, x int, value double"), spark.createDataFrame(ends, "seg long, z0 int, y0 int, x0 int, z1 int, y1 int, x1 int")
    found = {}
    for p in growth.least_paths(voxels, e, spacing=spacing, tile=(2, 4, 3)).orderBy("seg", "place").collect():
        found.setdefault(p.seg, []).append(p)
    assert set(found) == {1, 2}
    for seg, (total, start, end, cost) in want.items():
        way = [(p.z, p.y, p.x) for p in found[seg]]
        assert way[0] == start and way[-1] == end and [p.place for p in found[seg]] == list(range(len(way)))
        steps = [math.hypot(*((a - b) * s for a, b, s in zip(v, w, spacing, strict=True))) * (cost[v] + cost[w]) / 2 for v, w in zip(way, way[1:], strict=False)]
        assert all(max(abs(a - b) for a, b in zip(v, w, strict=True)) == 1 for v, w in zip(way, way[1:], strict=False))
        assert abs(sum(steps) - total) < 1e-9 and abs(found[seg][-1].cost - total) < 1e-9


def field(pixels, rows, columns, y, x):
    """Signed distance by all pixels of the image."""
    inside = (y, x) in pixels
    others = [(a, b) for a in range(rows) for b in range(columns) if ((a, b) in pixels) != inside]
    d = min([math.hypot(a - y, b - x) for a, b in others], default=math.hypot(rows, columns))
    return d if inside else -d


def test_signed_distances(spark):
    r = random.Random(1)
    masks = {"a": {(r.randrange(2, 11), r.randrange(3, 9)) for _ in range(25)}, "full": {(y, x) for y in range(13) for x in range(10)}, "dot": {(0, 0)}}
    rows = [(k, *p) for k, m in masks.items() for p in m] + [("a", 50, 50)]
    found = shapes.signed_distances(spark.createDataFrame(rows, "seg string, y int, x int"), ["seg"], 13, 10).collect()
    assert len(found) > 100 and all(abs(p.distance - field(masks[p.seg], 13, 10, p.y, p.x)) < 1e-9 for p in found)
    assert {(p.seg, p.y, p.x) for p in found} >= {(k, *p) for k, m in masks.items() for p in m}


def half_up(v):
    return math.floor(v + 0.5)


def between(first, last, t, rows, columns):
    """The shape at t, by all pixels."""
    box = lambda m: (min(y for y, _ in m), min(x for _, x in m), max(y for y, _ in m), max(x for _, x in m))
    a, b = box(first), box(last)
    to = tuple(half_up(p + (q - p) * t) for p, q in zip(a, b, strict=True))

    def moved(mask, own):
        one = lambda v, k: half_up((to[k] + to[k + 2]) / 2) if own[k] == own[k + 2] else half_up(to[k] + (to[k + 2] - to[k]) * ((v - own[k]) / (own[k + 2] - own[k])))
        out = set()
        for y in {y for y, _ in mask}:
            xs = sorted(x for v, x in mask if v == y)
            starts = [x for x in xs if x - 1 not in xs]
            stops = [x for x in xs if x + 1 not in xs]
            for s, e in zip(starts, stops, strict=True):
                out |= {(one(y, 0), x) for x in range(one(s, 1), one(e, 1) + 1)}
        return out

    f, g = moved(first, a), moved(last, b)
    return {(y, x) for y in range(rows) for x in range(columns) if (1 - t) * field(f, rows, columns, y, x) + t * field(g, rows, columns, y, x) >= 0}


def test_interpolated(spark):
    disc = lambda cy, cx, r: {(y, x) for y in range(16) for x in range(14) if (y - cy) ** 2 + (x - cx) ** 2 <= r * r}
    stack = {("a", 0): disc(5, 5, 3), ("a", 3): disc(9, 8, 5) - disc(9, 8, 2), ("a", 4): {(2, 2)}, ("a", 9): {(12, 12), (12, 3), (13, 3)}, ("b", 1): disc(4, 4, 2)}
    rows = [(s, z, y, x) for (s, z), m in stack.items() for y, x in m] + [("b", 5, 99, 99)]
    found = {}
    for p in shapes.interpolated(spark.createDataFrame(rows, "seg string, z int, y int, x int"), 16, 14).collect():
        found.setdefault((p.seg, p.z), set()).add((p.y, p.x))
    want = {}
    for low, high in ((0, 3), (4, 9)):
        for z in range(low + 1, high):
            want[("a", z)] = between(stack[("a", low)], stack[("a", high)], (z - low) / (high - low), 16, 14)
    assert found == {k: v for k, v in want.items() if v}


def turning(points):
    while len(points) > 3:
        out = []
        for i, p in enumerate(points):
            a, b = points[i - 1], points[(i + 1) % len(points)]
            u, v = (p[0] - a[0], p[1] - a[1]), (b[0] - p[0], b[1] - p[1])
            if u[0] * v[1] - u[1] * v[0] == 0 and u[0] * v[0] + u[1] * v[1] >= 0:
                continue
            out.append(p)
        if len(out) == len(points):
            break
        points = out
    return points


def split(points, tolerance):
    if len(points) <= 2:
        return points

    def away(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        n = d[0] ** 2 + d[1] ** 2
        t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0
        return math.sqrt(sum((p[i] - (a[i] + t * d[i])) * (p[i] - (a[i] + t * d[i])) for i in (0, 1)))

    far = [away(p, points[0], points[-1]) for p in points[1:-1]]
    k = far.index(max(far)) + 1
    if far[k - 1] <= tolerance:
        return [points[0], points[-1]]
    return split(points[: k + 1], tolerance)[:-1] + split(points[k:], tolerance)


def simple(points, tolerance):
    points = turning(points)
    if len(points) < 4 or tolerance <= 0:
        return points
    n = range(len(points))
    ends = [min(n, key=lambda i: (points[i][0], i)), min(n, key=lambda i: (-points[i][0], i)), min(n, key=lambda i: (points[i][1], i)), min(n, key=lambda i: (-points[i][1], i))]
    d, _, a, b = max((((points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2), -k, i, j) for k, (i, j) in enumerate((i, j) for i in ends for j in ends if i != j))
    arc = lambda i, j: points[i : j + 1] if i <= j else points[i:] + points[: j + 1]
    out = split(arc(a, b), tolerance)[:-1] + split(arc(b, a), tolerance)[:-1]
    out = turning(out)
    return out if len(out) >= 3 else points


@pytest.mark.parametrize("tolerance", [0.0, 0.8, 2.5, 50.0])
def test_simplified(spark, tolerance):
    r = random.Random(9)
    outlines = {"square": [(0, 0), (4, 0), (8, 0), (8, 8), (0, 8), (0, 4)], "three": [(0, 0), (5, 0), (0, 5)]}
    for k in range(4):
        n = 10 + 20 * k
        outlines[f"star{k}"] = [(round((20 + r.randrange(9)) * math.cos(2 * math.pi * i / n)), round((20 + r.randrange(9)) * math.sin(2 * math.pi * i / n))) for i in range(n)]
    rows = [(k, i * 3, *p) for k, ps in outlines.items() for i, p in enumerate(ps)] + [("square", None, 1, 1), ("x", 1, None, 2)]
    found = {}
    for p in shapes.simplified(spark.createDataFrame(rows, "seg string, place int, x int, y int"), ["seg"], tolerance).orderBy("seg", "place").collect():
        found.setdefault(p.seg, []).append((p.x, p.y))
    assert found == {k: simple(ps, tolerance) for k, ps in outlines.items()}


@pytest.mark.parametrize("corners", [False, True])
def test_volume_components(spark, corners):
    r = random.Random(4)
    voxels = {(s, z, y, x) for s in "ab" for z in range(-3, 5) for y in range(7) for x in range(9) if r.random() < (0.25 if corners else 0.4)}
    moves = [m for m in AROUND if corners or sum(map(abs, m)) == 1]
    want, seen = set(), set()
    for v in voxels:
        if v in seen:
            continue
        part, todo = {v}, [v]
        while todo:
            s, *at = todo.pop()
            for m in moves:
                n = (s, *(a + b for a, b in zip(at, m, strict=True)))
                if n in voxels and n not in part:
                    part.add(n)
                    todo.append(n)
        seen |= part
        want.add(frozenset(part))
    df = spark.createDataFrame([*voxels, ("a", 0, None, 1), *list(voxels)[:5]], "seg string, z int, y int, x int")
    found = {}
    for v in masks.volume_components(df, corners, (2, 3, 4)).collect():
        found.setdefault((v.seg, v.label), set()).add((v.seg, v.z, v.y, v.x))
    assert {frozenset(p) for p in found.values()} == want
    for s in "ab":
        assert sorted(k for g, k in found if g == s) == list(range(1, sum(next(iter(p))[0] == s for p in want) + 1))
