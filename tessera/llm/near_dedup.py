"""Near-duplicate documents: DartMinHash signatures of weighted 5-word shingles, banded joining, exact verification.

1. Texts are lower-cased (A-Z) and cut into words. Equal word sequences are one *text*, named by a 64-bit hash; copies
   are joined to it by that hash and go no further.
2. DartMinHash. A shingle and its count span a strip of a plane of (shingle, weight, rank). Darts fall on the plane at
   random, but at the same places for every document: dyadic cells of weight and rank are seeded by shingle and cell,
   and hold a Poisson number of darts. Those below the document's weight and below a rank of about (k ln k + 2k) / weight
   are dealt to k coordinates, each of which keeps the dart of least rank (the rank limit is doubled while one is empty).
   Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
3. Bands of 4 coordinates make buckets. Each text is first compared with the smallest text of its buckets. In buckets that
   then still hold texts of different groups, however many, those outside the bucket's largest group are compared with all
   of the bucket. Both sides are cut into parts of about `CHUNK` texts and each part of the one meets each of the other, so no
   task gets a large bucket. A pair is compared in the first bucket that it shares.
   Before a comparison, which is exact (weighted Jaccard of all shingles), the signatures must agree in `AGREE` of the
   80 coordinates. So whether two texts are linked depends on these two alone, not on the size of their bucket or table.
   The work is in proportion to the rows of a bucket where these are one group, and to the texts outside the largest
   group times all texts where they are not.
4. Groups are the connected components of the links, found by large-star and small-star steps.

Recall: with 20 bands of 4, a pair of similarity 0.8 shares no bucket once in 38,000 times, and agrees in fewer than
`AGREE` coordinates once in 10,000 times; more similar ones far less often.

Nulls: a null text is a group of its own. Texts without words are copies if they are equal as they stand. Texts of 1 to
4 words are one shingle. Repeated rows get the same group. A null doc_id is never the name of a group that has another.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written
from .words import hashed, mix, normal

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
DARTS = K * np.log(K) + 2 * K
#: Coordinates that must agree before an exact comparison, texts of a part of a bucket.
AGREE, CHUNK = 50, 512
#: Shingles and darts, roughly, of the texts whose signatures a task makes at once; a text of more has a block of its own or ends one.
AT_ONCE = 80_000
FIRST = -4  # the first cell of ranks is (0, 2**FIRST], each next one ends at the next power of 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_cdf: dict[int, np.ndarray] = {}


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their counts, of a text's word hashes."""
    n = min(SHINGLE, len(words))
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(words) - n + 1
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = out * _STEP + words[k : k + size]
    return np.unique(mix(out), return_counts=True)


def _poisson(exponent: int) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2... darts in a cell of area 2**exponent."""
    if exponent not in _cdf:
        area = 2.0**exponent
        k = np.arange(1, int(area + 12 * np.sqrt(area) + 24))
        _cdf[exponent] = np.cumsum(np.exp(np.concatenate(([-area], -area + np.cumsum(np.log(area / k))))))
    return _cdf[exponent]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, limits: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, filled) of `count` documents, from the darts of rank below each document's limit."""
    ranks = 1 + np.maximum(0, np.ceil(np.log2(limits[docs]) - FIRST)).astype(np.int64)
    heights = 1 + np.ceil(np.log2(weights)).astype(np.int64)
    cells = ranks * heights
    of = np.repeat(np.arange(len(elements)), cells)
    k = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    rank, height = k % ranks[of], k // ranks[of]
    seed = mix(elements[of] + mix((rank * 64 + height).astype(np.uint64) + np.uint64(1)))
    exponent = np.where(rank == 0, FIRST, FIRST + rank - 1) + np.maximum(height - 1, 0)
    u, darts = _unit(seed), np.zeros(len(of), np.int64)
    for e in np.unique(exponent).tolist():
        own = exponent == e
        darts[own] = np.searchsorted(_poisson(e), u[own], side="right")
    at = np.repeat(np.arange(len(of)), darts)
    j = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(seed[at] + (j + 1).astype(np.uint64) * _STEP)
    rank, height, of = rank[at], height[at], of[at]
    low = lambda cell, first: np.where(cell == 0, 0.0, 2.0 ** (first + cell - 1))
    r = low(rank, FIRST) + _unit(mix(dart + np.uint64(1))) * np.where(rank == 0, 2.0**FIRST, 2.0 ** (FIRST + rank - 1))
    w = low(height, 0) + _unit(mix(dart + np.uint64(2))) * np.where(height == 0, 1.0, 2.0 ** (height - 1))
    hit = (r < limits[docs[of]]) & (w < weights[of])
    dart, r, doc = dart[hit], r[hit], docs[of[hit]]
    place = doc * K + (mix(dart + np.uint64(3)) % np.uint64(K)).astype(np.int64)
    order = np.argsort(-r, kind="stable")
    sig, filled = np.zeros(count * K, np.uint64), np.zeros(count * K, bool)
    sig[place[order]] = dart[order]  # the least rank comes last and stays
    filled[place] = True
    return sig.reshape(count, K), filled.reshape(count, K).all(axis=1)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """DartMinHash signatures (documents x K) of non-empty weighted sets."""
    out, factor, todo = np.zeros((len(sets), K), np.uint64), 1.0, np.arange(len(sets))
    while len(todo):
        own = [sets[i] for i in todo]
        limits = np.array([factor * DARTS / w.sum() for _, w in own])
        sig, filled = _throw(np.concatenate([e for e, _ in own]), np.concatenate([w for _, w in own]), np.repeat(np.arange(len(own)), [len(e) for e, _ in own]), limits, len(own))
        out[todo[filled]] = sig[filled]
        todo, factor = todo[~filled], factor * 2
    return out


def _node(text: str, buffer: bytes) -> int:
    words = buffer.split()
    return xxhash.xxh3_64_intdigest(b" ".join(words) if words else b" " + text.encode("utf-8", "replace")) - 2**63


def _sketch(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, node, signature in 32-bit numbers); a text met before in the same task has no signature again."""
    seen: set[int] = set()
    block: list[tuple] = []
    size = 0.0

    def done() -> Iterator[tuple]:
        if block:
            short = (signatures([s for *_, s in block]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for (key, node, _), own in zip(block, short.tolist(), strict=True):
                yield key, node, own

    for (key, text), buffer, _, _, words in hashed(rows):
        if text is None:
            yield key, None, []
            continue
        node = _node(text, buffer)
        if not len(words) or node in seen:
            yield key, node, []
            continue
        if len(seen) < 1_000_000:
            seen.add(node)
        e, w = shingles(words)
        block.append((key, node, (e, w)))
        size += len(e) + DARTS + w.sum() * 2.0**FIRST  # a text gets about DARTS darts, however short, and more where it repeats a shingle very often
        if size > AT_ONCE:
            yield from done()
            block, size = [], 0.0
    yield from done()


def _named(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(node, text), once for a text in a task as long as a million of them are remembered."""
    seen: set[int] = set()
    for (text,) in rows:
        node = _node(text, normal(text))
        if node not in seen:
            if len(seen) < 1_000_000:
                seen.add(node)
            yield node, text


def _sets(rows: Iterator[tuple]) -> Iterator[tuple]:
    for (node, sig, _), _, _, _, words in hashed(rows):
        e, w = shingles(words)
        yield node, sig, e.view(np.int64).tolist(), w.tolist()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of distinct elements with counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if both else 0.0


def _verify(similar: float):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, ea, wa, eb, wb in rows:
            big, small = max(sum(wa), sum(wb)), min(sum(wa), sum(wb))
            if small >= similar * big and similarity((np.array(ea), np.array(wa)), (np.array(eb), np.array(wb))) >= similar:
                yield a, b

    return run


def links(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of texts whose similarity is at least `similar`. Sets are read of the texts whose signatures agree enough."""
    sig = lambda end: sets.select(F.col("node").alias(end), F.col("sig").alias(f"s{end}"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    near = written(pairs.join(sig("a"), "a").join(sig("b"), "b").where(agree >= AGREE).select("a", "b"), "near")
    some = sets.join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    end = lambda end: some.select(F.col("node").alias(end), F.col("e").alias(f"e{end}"), F.col("w").alias(f"w{end}"))
    both = near.join(end("b"), "b").join(end("a"), "a")
    return written(map_rows(both.select("a", "b", "ea", "wa", "eb", "wb"), "a long, b long", _verify(similar), 500), "links")


def _is_stars(edges: DataFrame) -> bool:
    """Has every node of the edges (a, b) one b at most, and is no node an a of one and a b of another?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b): label is the smallest node of the component."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(edges):
        # large star: the larger neighbours of a node are linked to the least of it and its neighbours
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = written(small, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after more links: links between labels make components of labels, which are few."""
    if found.isEmpty():
        return labels
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
    named = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = components(named).select(F.col("node").alias("label"), F.col("label").alias("to"))
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return written(labels.union(ends).join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, band, node, label, n, top, rest): the members of buckets of several groups; n texts, all but `rest` of them of the group `top`."""
    m = members.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    sizes = m.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    of = sizes.groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("t")).where("n > t.c")
    return written(m.join(of.select("bucket", "n", F.col("t.label").alias("top"), (F.col("n") - F.col("t.c")).alias("rest")), "bucket"), "mixed")


def _attached(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members with the columns of sets, which are joined once for each text and not for each of its buckets."""
    own, more = [c for c in members.columns if c != "node"], [c for c in sets.columns if c != "node"]
    each = members.groupBy("node").agg(F.collect_list(F.struct(*own)).alias("m")).join(sets, "node")
    return each.select("node", *more, F.explode("m").alias("m")).select("node", "m.*", *more)


def _linked(cell: pa.Table, similar: float) -> Iterator[tuple[int, int]]:
    """Of each probe of a cell, one similar text of each other group at home there."""
    column = lambda name: cell[name].combine_chunks()
    node, label, band, top, home, probe = (column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "band", "top", "home", "probe"))
    sig = column("sig").flatten().to_numpy().reshape(len(node), BANDS, ROWS)
    offsets, e, w = column("e").offsets.to_numpy(), column("e").values.to_numpy().view(np.uint64), column("w").values.to_numpy()  # sorted as unsigned numbers
    total = np.add.reduceat(w, offsets[:-1])
    for i in np.flatnonzero(probe).tolist():
        # two texts outside the largest group meet twice
        near = home & (label != label[i]) & ((label == top) | (node > node[i])) & (np.minimum(total, total[i]) >= similar * np.maximum(total, total[i]))
        near = np.flatnonzero(near)
        same = sig[near] == sig[i]
        near = near[(same.sum(axis=(1, 2)) >= AGREE) & (same.all(axis=2).argmax(axis=1) == band[i])]
        if not len(near):
            continue
        own, weight = e[offsets[i] : offsets[i + 1]], w[offsets[i] : offsets[i + 1]]
        sizes = offsets[near + 1] - offsets[near]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(offsets[near] - starts, sizes)
        place = np.minimum(np.searchsorted(own, e[at]), len(own) - 1)
        both = np.add.reduceat(np.where(own[place] == e[at], np.minimum(weight[place], w[at]), 0), starts)
        similars = near[both / (total[near] + total[i] - both) >= similar]
        for k in similars[np.unique(label[similars], return_index=True)[1]].tolist():
            yield min(node[i], node[k]), max(node[i], node[k])


def _cells(members: DataFrame) -> DataFrame:
    """members with h, p, home and probe: their texts are at home in part h of their bucket, those outside its largest group are also probes of part p, and each part h meets each part p."""
    parts = lambda size: F.ceil(size / CHUNK)
    m = members.withColumns({"hs": parts(F.col("n")), "ps": parts(F.col("rest")), "is_probe": F.col("label") != F.col("top")})
    m = m.withColumns({"own_h": F.pmod(F.xxhash64("node"), F.col("hs")), "own_p": F.pmod(F.xxhash64("node", F.lit(1)), F.col("ps"))})
    upto = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    cell = lambda h, p, home, probe: F.struct(h.alias("h"), p.alias("p"), home.alias("home"), probe.alias("probe"))
    at_home = F.transform(upto("ps"), lambda p: cell(F.col("own_h"), p, F.lit(True), F.col("is_probe") & (p == F.col("own_p"))))
    away = F.transform(F.filter(upto("hs"), lambda h: F.col("is_probe") & (h != F.col("own_h"))), lambda h: cell(h, F.col("own_p"), F.lit(False), F.lit(True)))
    return m.select(*members.columns, F.explode(F.concat(at_home, away)).alias("cell")).select(*members.columns, "cell.*")


def _against_rest(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between the texts outside the largest group of each bucket and all texts of the bucket."""
    rows = _attached(_cells(members).select("bucket", "band", "h", "p", "node", "label", "top", "home", "probe"), sets)

    def run(cell: pa.Table) -> pa.Table:
        found = list(_linked(cell, similar))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return written(rows.groupBy("bucket", "h", "p").applyInArrow(run, "a long, b long"), "links")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row for each row of docs: key and class_id (the least key of its group)."""
    kind = docs.schema[key].dataType.simpleString()
    sketch = written(map_rows(docs.select(F.col(key).alias("key"), text), f"key {kind}, node long, sig array<int>", _sketch, 1000), "sketch")
    signed = sketch.where(F.size("sig") > 0)
    buckets = F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), *(F.get("sig", F.lit(b * ROWS + k)) for k in range(ROWS))).alias("bucket")) for b in range(BANDS)))
    all_ = signed.select("node", F.explode(buckets).alias("x")).select("x.bucket", "x.band", "node")
    shared = all_.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("bucket", "first")
    members = written(all_.join(shared, "bucket").distinct(), "members")
    nodes = written(signed.join(members.select("node").distinct(), "node", "left_semi").select("node", "sig").dropDuplicates(["node"]), "nodes")
    texts = map_rows(docs.where(F.col(text).isNotNull()).select(text), "node long, text string", _named, 500).join(nodes, "node").dropDuplicates(["node"])
    sets = written(map_rows(texts.select("node", "sig", "text"), "node long, sig array<int>, e array<long>, w array<int>", _sets, 500), "sets")

    pairs = members.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(links(pairs, sets, similar))
    labels = _joined(labels, _against_rest(_mixed(members, labels), sets, similar))

    rows = sketch.select("key", "node")
    names = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key")).join(labels, "node", "left").select("node", "key", F.coalesce("label", "node").alias("label"))
    best = names.groupBy("label").agg(F.min("key").alias("class_id"))
    named = names.join(best, "label").select("node", "class_id")
    return rows.join(named, "node", "left").select(F.col("key").alias(key), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"))
