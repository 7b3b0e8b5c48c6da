"""Toxicity: weak supervision by many lexicon and pattern voters, and a linear classifier on their posterior labels.

1. Voters. A list of insults in common use and some patterns (one hit, several hits, hits by length of text, hidden
   spellings), and a lexicon of words and word beginnings found in the labelled rows of the training fold: those that
   stand in several toxic rows and nearly never in others. Each entry of the lexicon is a voter of its own.
2. Label model. Voters fire or abstain; a row's own label, where it has one, is one more voter, that may be wrong.
   Expectation-maximisation estimates how often each fires in either class (its accuracy), and how often a label is toxic in
   either class; the correlations of voters within the classes are measured with the posteriors, and a voter counts the less
   the more of those correlated with it fire too. It starts from the rates in the labelled rows; from the second round
   on rows without a label add their evidence.
3. A logistic regression over words and beginnings of words is fitted to the posteriors of all these rows, and then scores
   every text.

All fitting is on at most `sample` labelled rows of the training fold and `unlabelled` rows of it that have no label (those of
the smallest hashes of doc_id), of which only the numbers of their features come to the driver. Scores are of the text
alone.

Nulls: a null text counts as empty; such texts get a score as any other. Labels that are null, or of documents that are
absent, are left out. Without labels the fixed list alone votes. Each input row gives one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_rows, train_fold

#: Insults in common use.
INSULTS = ("bastard", "clown", "coward", "cretin", "creep", "degenerate", "dimwit", "disgusting", "dumb", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "loser", "maggot", "moron", "parasite", "pathetic", "pig", "retard", "rubbish", "scum", "scumbag", "stupid", "trash", "ugly", "vermin", "vile", "worthless")
WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"\b(?:[a-z][0134@$*][a-z0134@$*]{2,}|(?:[a-z][.*_-]){3,}[a-z])\b")
LEAF = str.maketrans("0134@$", "oieaas")
FIXED = 5
THRESHOLD = 0.7
ENTRIES = 400
CLASSIFIER = 4000
#: What is taken for the labels before any is seen, as so many rows: right in 19 of 20. They are never believed to be better.
TRUST, TRUST_ROWS = 0.95, 20.0


def parts(word: str) -> tuple[str, ...]:
    """What a word shows: itself, and its first 4 to 6 letters."""
    return (word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n))


def shown(text: str) -> tuple[set[str], int, int]:
    """All that the words of a text show; number of insults; number of words."""
    words = WORD.findall(text.lower())
    counts = Counter(words)
    hits = sum(counts[w] for w in INSULTS if w in counts)
    return {p for w in counts for p in parts(w)}, hits, len(words)


def fixed_votes(text: str, seen: set[str], hits: int, n: int) -> list[bool]:
    """The voters that need no labels."""
    low = text.lower() if any(c in text for c in "0134@$*") else ""
    hidden = any(m[0].translate(LEAF) in INSULTS for m in HIDDEN.finditer(low)) if low else False
    return [hits > 0, hits > 1, sum(w in seen for w in INSULTS) > 2, hits > 0 and 50 * hits >= n, hidden]


def unnested(entries: list[str]) -> list[str]:
    """Of entries that say the same at different lengths (a word and its beginnings) only the first given; none that an insult begins with."""
    kept: list[str] = []
    stems, inner = set(), set()  # of the kept ones, and their beginnings
    for e in entries:
        stem = e.removesuffix("-")
        if e in INSULTS or not (stem in inner or any(stem[:n] in stems for n in range(4, len(stem) + 1)) or any(w.startswith(stem) for w in INSULTS)):
            kept.append(e)
            stems.add(stem)
            inner.update(stem[:n] for n in range(4, len(stem)))
    return kept


class LabelModel:
    """Class-conditional rates of voters that fire or abstain, with weights against repeated evidence."""

    def __init__(self, rates: np.ndarray, shared: np.ndarray, silent: np.ndarray, prior: float):
        self.rates, self.shared, self.silent, self.prior = rates, shared, silent, prior
        self.labels = np.array([1 - TRUST, TRUST])  # how often a label is toxic in either class

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, labels: np.ndarray, rounds: int = 12) -> tuple[LabelModel, np.ndarray]:
        """The model and each row's probability; votes: rows x voters, 0 or 1; start: first guess of the probability; labels: 1, 0, or -1 for none.

        Rows without a label count from the second round on, if any row has one.
        """
        p, none, known = start.astype(float), ~votes.any(axis=1), labels >= 0
        shared = np.zeros((votes.shape[1],) * 2)
        for r in range(rounds):
            own = known.astype(float) if r == 0 and known.any() else np.ones(len(votes))
            each = np.stack([(1 - p) * own, p * own])
            mass = each.sum(axis=1)
            rates = np.clip((each @ votes + 0.05) / (mass[:, None] + 1), 1e-6, 1 - 1e-6)
            silent = np.clip((each @ none + 0.05) / (mass + 1), 1e-6, 1 - 1e-6)
            told = (each @ (labels == 1) + TRUST_ROWS * np.array([1 - TRUST, TRUST])) / (each @ known + TRUST_ROWS)
            model = cls(rates, shared, silent, float(np.clip(mass[1] / mass.sum(), 1e-3, 1 - 1e-3)))
            model.labels = np.clip(told, 1 - TRUST, TRUST)
            if r % 4 == 0:
                model.shared = shared = model.correlations(votes, p)
            p = model.posterior(votes, labels)
        return model, p

    def correlations(self, votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The positive correlations of each two voters within the classes, the larger of both."""
        total = np.zeros((votes.shape[1],) * 2)
        for c, share in ((0, 1 - p), (1, p)):
            centred = votes - self.rates[c].astype(np.float32)
            cov = (centred * share.astype(np.float32)[:, None]).T @ centred / max(share.sum(), 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = cov / np.outer(sd, sd)
            np.fill_diagonal(rho, 0)
            total = np.maximum(total, rho)
        return total

    def posterior(self, votes: np.ndarray, labels: np.ndarray | int = -1) -> np.ndarray:
        """Labels and voters that fire give evidence by their rates, each the less the more it is correlated with the others that fire; the silence of one says nothing, that of all is evidence by its own rate."""
        fired = (votes * np.log(self.rates[1] / self.rates[0]) / (1 + votes @ self.shared)).sum(axis=1)
        quiet = np.where(votes.any(axis=1), 0, np.log(self.silent[1] / self.silent[0]))
        gold = np.where(labels == 1, np.log(self.labels[1] / self.labels[0]), np.where(labels == 0, np.log((1 - self.labels[1]) / (1 - self.labels[0])), 0))
        z = np.log(self.prior / (1 - self.prior)) + fired + quiet + gold
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Shows(dict):
    """word -> the entries of the model that it shows."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = tuple(p for p in parts(word) if p in self.weights)
        return out


class Linear:
    """bias + the sum of the weights of all that the text shows, through the logistic function."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.shows = weights, bias, _Shows(weights)

    def score(self, text: str) -> float:
        seen = {e for w in set(WORD.findall(text.lower())) for e in self.shows[w]}
        z = self.bias + sum(self.weights[s] for s in sorted(seen))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    def __reduce__(self):
        return Linear, (self.weights, self.bias)


def _features(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text, y in rows:
        seen, hits, n = shown(text)
        yield str(doc_id), y, fixed_votes(text, seen, hits, n), list(seen)


def _counted(rows: Iterator[tuple]) -> Iterator[tuple]:
    toxic, clean = Counter(), Counter()
    for _, y, _, seen in rows:
        if y >= 0:
            (toxic if y else clean).update(seen)
        if len(toxic) + len(clean) > 500_000:
            yield from ((s, toxic[s], clean[s]) for s in toxic.keys() | clean.keys())
            toxic.clear(), clean.clear()
    yield from ((s, toxic[s], clean[s]) for s in toxic.keys() | clean.keys())


def unlabelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int, text: str = "text") -> DataFrame:
    """(doc_id, text, y = -1) of at most `limit` documents of the training fold that have no label, those of the smallest hashes of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).select("doc_id").distinct()
    picked = docs.where(F.col("doc_id").isNotNull() & train_fold()).select("doc_id").distinct().join(known, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")).withColumn("y", F.lit(-1))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = 20_000, text: str = "text", unlabelled: int = 2000) -> Linear:
    from .common import written

    spark = docs.sparkSession
    picked = labelled_sample(docs, labels, target, sample, text).select("doc_id", "text", "y").unionByName(unlabelled_sample(docs, labels, target, unlabelled, text))
    rows = written(map_rows(picked, "id string, y int, votes array<boolean>, seen array<string>", _features, 500), "votes")
    sizes = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counts = map_rows(rows, "part string, n1 long, n0 long", _counted).groupBy("part").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    gain = F.log((F.col("n1") + 0.2) / (n1 + 1)) - F.log((F.col("n0") + 0.2) / (n0 + 1))
    both = written(counts.where(F.col("n1") + F.col("n0") >= 4).withColumn("gain", gain), "parts")
    told = F.col("n1") * F.col("gain")
    # the lexicon: in at least 4 toxic rows, and far more often than in others; the classifier's: less clear ones too
    pick = lambda most, least, rows: unnested([r[0] for r in both.where((F.col("n1") >= rows) & (F.col("gain") >= least)).orderBy(F.desc(told), "part").limit(most).select("part").collect()]) if n1 and n0 else []
    lexicon, chosen = pick(ENTRIES, 4.0, 4), pick(CLASSIFIER, 2.0, 3)
    # a listed word that the fold's clean rows use freely is no voter
    free = {r[0] for r in both.where(F.col("part").isin(*INSULTS) & (F.col("n0") >= 3) & (F.col("gain") < 2)).select("part").collect()} if n1 and n0 else set()
    names = list(dict.fromkeys(w for w in [*INSULTS, *lexicon, *chosen] if w not in free))
    place = spark.sparkContext.broadcast({s: k for k, s in enumerate(names)})

    def numbered(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, y, votes, seen in it:
            yield doc_id, y, votes, sorted(place.value[s] for s in seen if s in place.value)

    data = sorted(map_rows(rows, "id string, y int, votes array<boolean>, seen array<int>", numbered).collect())
    if not data:  # the fixed list alone
        return Linear(dict.fromkeys(INSULTS, 3.0), -2.0)
    at = {s: k for k, s in enumerate(names)}
    words = [at[s] for s in dict.fromkeys([*INSULTS, *lexicon]) if s in at]
    column = {w: k for k, w in enumerate(words)}
    votes = np.zeros((len(data), FIXED + len(words)), np.float32)
    for i, (_, _, v, seen) in enumerate(data):
        votes[i, :FIXED] = v
        votes[i, [FIXED + column[s] for s in seen if s in column]] = 1
    y = np.array([d[1] for d in data], float)
    if not (n1 and n0):  # labels of one class tell nothing
        y = np.full(len(y), -1.0)
    start = np.where(y < 0, np.where(votes.any(axis=1), 0.9, 0.1), np.clip(y, 0.02, 0.98))
    fires = votes.any(axis=0)
    _, p = LabelModel.fit(votes[:, fires], start, y)
    return fit_linear(names, [d[3] for d in data], p)


def fit_linear(names: list[str], rows: list[list[int]], p: np.ndarray, rounds: int = 500, rate: float = 0.5, decay: float = 2e-5) -> Linear:
    """Logistic regression on soft labels, by AdaGrad over all rows."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate([np.zeros(0, int), *map(np.asarray, rows)]).astype(int)
    w, bias, sq, sq_b = np.zeros(len(names)), float(np.log(p.mean() / (1 - p.mean()))) if 0 < p.mean() < 1 else 0.0, np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(at, w[cols], len(rows))
        err = p - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        grad = np.bincount(cols, err[at], len(names)) / len(rows) - decay * w
        sq += grad**2
        sq_b += err.mean() ** 2
        w += rate * grad / np.sqrt(sq)
        bias += rate * err.mean() / np.sqrt(sq_b)
    return Linear({s: float(x) for s, x in zip(names, w, strict=True) if abs(x) > 1e-3}, bias)


def score(docs: DataFrame, model: Linear, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_rows(rows, f"key {docs.schema[key].dataType.simpleString()}, score double", lambda it: ((k, held.value.score(t)) for k, t in it)).withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Linear, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; a null text stays null."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema, place = docs.schema, docs.columns.index(text)
    return map_rows(docs, schema, lambda it: (r for r in it if held.value.score(r[place] or "") < threshold), 500)
