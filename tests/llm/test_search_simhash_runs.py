"""Ranked search, covering SimHash and periodic runs against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import lexical, queries, runs, simhash
from tests.llm.test_llm_operators import DIR, MORE, odd, plain  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    """Brute force: docs (key, text), items (key, text)."""
    held = [(key, Counter(terms(text))) for key, text in docs]
    held = [(key, c, sum(c.values())) for key, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        wanted, scores = Counter(terms(text)), []
        for key, c, n in held:
            m = 25 + 75 * n * n_docs // length
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, key is None, key or 0))
        out += [(item, i + 1, None if none else key, -s) for i, (s, none, key) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{MORE}/benchmark.parquet").collect()]
    if not small:
        found = queries.op11_lexical(spark, MORE)
        assert dict(found.dtypes)["rank"] == "int"
    else:  # several blocks of queries, several windows and lists a task
        monkeypatch.setattr(lexical, "LIST", 7)
        docs = docs[:300]
        tables = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
        found = lexical.search(*tables, block=300)
    assert sorted(map(tuple, found.collect())) == sorted(ranked(docs, items))


def test_windows_are_cut_by_postings_and_skipped_only_where_nothing_is_lost(monkeypatch):
    class Held:
        def __init__(self, value):
            self.value = value

    random.seed(3)
    monkeypatch.setattr(lexical, "POSTINGS", 40)
    monkeypatch.setattr(lexical, "LIST", 3)
    docs = [(i % 90, " ".join(random.choices("abcdefgh", k=random.randint(1, 30)))) for i in range(400)]
    items = [(i, " ".join(random.choices("abcdefghij", k=6))) for i in range(12)]
    known = np.unique(np.array([h for _, _, t, _ in lexical._query_terms(iter(items)) for h in t], np.int64).view(np.uint64))
    index = list(lexical._index(Held(known))(iter(docs)))
    assert len({r[0] for r in index}) > 20 and max(len(r[2]) for r in index) <= 3
    df, n, length = np.zeros(len(known), np.int64), 0, 0
    for _, term, _, _, _, count, total in index:
        if term == lexical.DOCUMENTS:
            n, length = n + count, length + total
        else:
            df[term] += count
    places = [(i, np.searchsorted(known, np.array(t, np.int64).view(np.uint64)).tolist(), r) for i, (_, _, t, r) in enumerate(lexical._query_terms(iter(items)))]
    found = defaultdict(list)
    for number, id_, s in lexical._score(Held(places), Held((n, length, lexical.weights(n, df))), 5)(iter(index)):
        found[number].append((id_, s))
    want = ranked(docs, items, 5)
    assert {k: [s for _, s in v] for k, v in found.items()} == {k: [s for i, _, _, s in want if i == k] for k in found}
    assert {k: [d for d, _ in v] for k, v in found.items()} == {k: [d for i, _, d, _ in want if i == k] for k in found}


def test_search_of_odd_tables(spark, odd):  # noqa: F811
    items = spark.createDataFrame([(1, "some words", 0), (1, "some words", 0), (None, "WORD5 word5 item3", 0), (2, None, 0), (3, "", 0), (4, "nowhere", 0)], "item_id long, text string, number long")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = ranked(docs, [(1, "some words"), (1, "some words"), (None, "WORD5 word5 item3")])
    assert plain(map(tuple, lexical.search(odd, items).collect())) == plain(want)
    assert lexical.search(odd.limit(0), items).collect() == [] and lexical.search(odd, items.limit(0)).collect() == []


def print_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Least key of each row's component, over all pairs."""
    keys = defaultdict(list)
    for key, p in prints:
        keys[p].append(key)
    of = {p: p for p in keys}

    def root(p):
        while of[p] != p:
            of[p] = of[of[p]]
            p = of[p]
        return p

    own = sorted(keys)
    array = np.array(own, np.uint64)
    for i, p in enumerate(own):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3):
            of[root(own[i + 1 + j])] = root(p)
    least = defaultdict(list)
    for p, ks in keys.items():
        least[root(p)] += [k for k in ks if k is not None]
    return {p: min(least[root(p)], default=None) for p in keys}


def test_simhash_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], print_of(r["text"])) for r in rows]
    of = linked(prints)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op12_simhash(spark, MORE).collect()}
    assert found == {k: (f"{p:016x}", of[p]) for k, p in prints} and len(set(of.values())) < len(prints)


def test_covering_masks_miss_no_pair():
    random.seed(1)
    for positions in (list(range(64)), random.sample(range(64), 31), random.sample(range(64), 13)):
        masks = simhash.covering(positions)
        for _ in range(3000):
            apart = sum(1 << p for p in random.sample(positions, 3))
            assert any(not m & apart for m in masks)


@pytest.mark.parametrize("limit", [2, 5, 1 << 14])
def test_large_buckets_are_split_without_loss(spark, limit):
    random.seed(5)
    prints = {0}
    while len(prints) < 400:  # balls and chains of near fingerprints
        p = random.choice(list(prints)) if random.random() < 0.9 else random.getrandbits(64)
        for b in random.sample(range(64), random.randint(1, 4)):
            p ^= 1 << b
        prints.add(p)
    of = linked([(p, p) for p in prints])
    found = simhash.links(spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long"), limit).collect()
    assert all((r["a"] ^ r["b"]) for r in found)
    parent = {p: p for p in prints}

    def root(p):
        return p if parent[p] == p else root(parent[p])

    for r in found:
        a, b = (r[c] & (2**64 - 1) for c in "ab")
        parent[root(a)] = root(b)
    assert len({root(p) for p in prints}) == len(set(of.values()))
    assert {(of[p], root(p)) for p in prints} == {(of[root(p)], root(p)) for p in prints}


def test_simhash_of_odd_tables(spark, odd):  # noqa: F811
    rows = [(r["doc_id"], print_of(r["text"])) for r in odd.collect()]
    of = linked(rows)
    found = [tuple(r) for r in simhash.groups(odd).collect()]
    assert plain(found) == plain([(k, f"{p:016x}", of[p]) for k, p in rows])
    assert simhash.groups(odd.limit(0)).collect() == []


def all_runs(words):
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def repetitive(rng, n):
    out = []
    while len(out) < n:
        unit = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 7))]
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 40)]
    return out[:n]


@pytest.mark.parametrize("weak", [False, True])
def test_runs_equal_brute_force(monkeypatch, weak):
    if weak:  # hashes that mislead: equal for all words, so the words decide
        monkeypatch.setattr(runs, "prefix_hashes", lambda ids: np.zeros(len(ids) + 1, np.uint64))
    monkeypatch.setattr(runs, "PAIRS", 50)
    rng = random.Random(2)
    documents = [repetitive(rng, n) for n in (0, 1, 5, 6, 7, 40, 90, 200, 333)] + [[b"x"] * n for n in (5, 6, 30)] + [[b"x", b"y"] * 20, []]
    for words, found in zip(documents, runs.find_runs(documents), strict=True):
        assert [tuple(r) for r in found.tolist()] == all_runs(words)
    assert runs.find_runs([]) == []


def test_words_that_mislead_a_hash_of_powers():
    words = [b"a"]
    for _ in range(13):  # Thue and Morse: hashes of its blocks collide modulo powers of two
        words = words + [b"b" if w == b"a" else b"a" for w in words]
    assert [tuple(r) for r in runs.find_runs([words])[0].tolist()] == all_runs(words)


def planted(key, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(key, words):
    found = all_runs(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return (key, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_run_digests(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    short = [(r["doc_id"], r["text"]) for r in rows if len(r["text"]) < 20_000]
    found = {r["doc_id"]: tuple(r) for r in queries.op13_runs(spark, DIR).collect()}
    assert len(found) == len(rows) and all(found[k] == expected(k, planted(k, t)) for k, t in short)
    assert sum(found[k][1] > 0 for k, _ in short) > 5


def test_runs_of_odd_tables(spark, odd):  # noqa: F811
    want = [(r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in odd.collect()]
    found = runs.scan(odd).collect()
    assert plain([(r["doc_id"], r["n_words"]) for r in found]) == plain(want)
    assert runs.digest(runs.scan(odd.withColumn("text", F.lit("a b " * 9)))).first()["length"] == 18
    assert runs.digest(runs.scan(odd.limit(0))).collect() == []
