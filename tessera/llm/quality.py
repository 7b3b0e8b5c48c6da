"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

The trees are grown on at most `sample` labelled rows of the training fold (those of the smallest hashes of doc_id),
whose statistics come to the driver, and flattened into arrays; tasks walk all trees for a batch of rows at once in
numpy. Statistics are of the text alone.

Nulls: a null text counts as empty and gets a score as any other. Labels that are null, or of documents that are absent,
are left out; a document labelled twice has its larger label. Without labels, or with one class only, every score is the
share of label 1 (0.5 if there is none). Each input row gives one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import labelled_sample, map_rows

STATISTICS = (
    "log_bytes", "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeated_neighbours", "distinct_pairs", "upper", "digits", "marks", "symbols", "pipes", "exclamations",
    "commas", "stops", "white", "high_bytes", "lines", "distinct_lines", "line_length", "capitalised", "words_with_marks", "sentence_length", "upper_words", "longest_run", "brackets", "url_marks", "dots_per_word",
)
_CLASS = np.zeros((256, 12), np.float64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"-()", b"#$%&*@^~=+<>\\_{}[]/", b"|", b"!", b",", b".?!", b" \t\n\r\v\f", bytes(range(128, 256)), b"()[]{}<>", b"/:@")):
    _CLASS[list(_chars), _k] = 1


def statistics(text: str) -> list[float]:
    """Numbers that describe the whole text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    upper, digits, marks, symbols, pipes, bangs, commas, stops, white, high, brackets, url = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS).tolist()
    words = raw.split()
    k = max(1, len(words))
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    same = run = longest = 0
    before = None
    for w in words:
        if w == before:
            same, run = same + 1, run + 1
            longest = max(longest, run)
        else:
            run = 0
        before = w
    lines = [x for x in raw.split(b"\n") if x.strip()]
    with_marks = sum(1 for w in words if w[-1] in b"#$%&*@^~=+|!")
    capital = sum(1 for w in words if 65 <= w[0] <= 90)
    upper_words = sum(1 for w in words if len(w) > 1 and w.isupper())
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(sizes.mean()), float((sizes > 12).mean()), float((sizes < 3).mean()), len(counts) / k, max(counts.values(), default=0) / k, same / k, len(set(zip(words, words[1:]))) / k, upper / n, digits / n, marks / n, symbols / n, pipes / k, bangs / k,
        commas / k, stops / k, white / n, high / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(len(raw) / max(1, len(lines))), capital / k, with_marks / k, np.log1p(k / (stops + 1)), upper_words / k, np.log1p(longest), brackets / k, url / k, raw.count(b"..") / k,
    ]


class Trees:
    """Boosted trees as flat arrays (trees x nodes): feature, threshold, left child, leaf value; a leaf is its own child."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray, base: float, depth: int):
        self.feature, self.threshold, self.left, self.value, self.base, self.depth = feature, threshold, left, value, base, depth

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0, least: float = 4.0) -> Trees:
        share = (y.sum() + 0.5) / (len(y) + 1)
        base, nodes = float(np.log(share / (1 - share))), 2 ** (depth + 1) - 1
        if len(y) == 0 or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.5
            base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
            return cls(np.zeros((1, 1), int), np.zeros((1, 1)), np.zeros((1, 1), int), np.zeros((1, 1)), base, 0)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])  # v <= cuts[b] in bins up to b
        score = np.full(len(y), base)
        shape = (trees, nodes)
        feature, threshold, left, value = np.zeros(shape, int), np.full(shape, np.inf), np.tile(np.arange(nodes), (trees, 1)), np.zeros(shape)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess, at = y - p, p * (1 - p), np.zeros(len(y), int)
            for node in range(nodes):
                own = np.flatnonzero(at == node)
                if not len(own):
                    continue
                g, h = grad[own], hess[own]
                value[t, node] = rate * g.sum() / (h.sum() + ridge)
                if node >= nodes // 2 or h.sum() < 2 * least / 4 or len(own) < 2 * least:
                    continue
                best = (1e-6, -1, -1)
                whole = g.sum() ** 2 / (h.sum() + ridge)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    b = binned[f, own]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, len(cuts[f]) + 1))[:-1] for w in (g, h, np.ones(len(own))))
                    gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - whole
                    gain[(ns < least) | (len(own) - ns < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
                _, f, k = best
                if f >= 0:
                    feature[t, node], threshold[t, node], left[t, node] = f, cuts[f][k], 2 * node + 1
                    at[own] = 2 * node + 1 + (binned[f, own] > k)
            score += value[t, at]
        return cls(feature, threshold, left, value, base, depth)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all trees take a step down at once."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), int)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = self.left[trees, at]
            right = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = np.where(down == at, at, down + right)
        return 1 / (1 + np.exp(-(self.base + self.value[trees, at].sum(axis=1))))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = 20_000, text: str = "text", **options) -> Trees:
    rows = map_rows(labelled_sample(docs, labels, target, sample, text).select("doc_id", "text", "y"), "id string, x array<double>, y double", lambda it: ((str(i), statistics(t), float(y)) for i, t, y in it)).collect()
    rows.sort(key=lambda r: r[0])
    return Trees.fit(np.array([r[1] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r[2] for r in rows], float), **options)


def score(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key and score."""
    held = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                x = np.array([statistics(t) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow[0].type), pa.array(held.value.predict(x))], schema=arrow)

    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
