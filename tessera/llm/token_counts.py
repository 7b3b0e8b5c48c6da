"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

1. A pass over the texts counts pre-tokens; tasks sum them before the shuffle.
2. Each distinct pre-token is encoded once by the tokenizer library, and only the number of its pieces is kept.
3. A second pass has each document's pre-token frequencies. The most frequent pre-tokens (at most `local_words`, of at
   most 64 characters each: a table of bounded size) are looked up in the task, all others are joined by the pre-token.
   The frequent words are thus never shuffled by key, and no key of the join is hot.

Nulls: a null text counts as empty. Empty texts have 0 tokens. Repeated rows are counted row by row; rows with a null
doc_id are kept. An empty table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, row_ids, written

LIMIT = 1024
FLUSH = 300_000


@lru_cache
def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(path: str) -> regex.Pattern | None:
    """The added tokens, which the library finds in a text before it pre-tokenizes what is between them."""
    added = sorted((t.content for t in _library(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, added))) if added else None


def pre_tokens(path: str):
    """text -> (its pre-tokens, number of special tokens in it)."""
    words, special = regex.compile(public_tokenizers.PATTERN), _specials(path)

    def split(text: str) -> tuple[list[str], int]:
        if special is None or not special.search(text):
            return words.findall(text), 0
        parts = special.split(text)
        return [w for part in parts for w in words.findall(part)], len(parts) - 1

    return split


def _count_words(path: str):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        split, seen = pre_tokens(path), Counter()
        for (text,) in rows:
            seen.update(split(text)[0])
            if len(seen) > FLUSH:
                yield from seen.items()
                seen.clear()
        yield from seen.items()

    return run


def _pieces(path: str):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        library, batch = _library(path), []

        def encoded() -> Iterator[tuple]:
            for (word, n), e in zip(batch, library.encode_batch_fast([w for w, _ in batch], add_special_tokens=False), strict=True):
                yield word, n, len(e.ids)

        for row in rows:
            batch.append(row)
            if len(batch) == 2000:
                yield from encoded()
                batch = []
        yield from encoded()

    return run


def _frequencies(path: str, local):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        split, known, ids = pre_tokens(path), local.value, row_ids()
        for doc_id, text in rows:
            words, tokens = split(text)
            rest: list[str] = []
            for w in words:
                n = known.get(w)
                if n is None:
                    rest.append(w)
                else:
                    tokens += n
            yield next(ids), doc_id, len(text.encode("utf-8", "replace")), tokens, list(Counter(rest).items())

    return run


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT, local_words: int = 100_000) -> DataFrame:
    """One row for each row of docs: key, n_bytes, n_tokens, over_limit. tokenizer: path of a byte-level BPE .json file, present on every machine."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = map_rows(texts.select("text"), "word string, n long", _count_words(tokenizer)).groupBy("word").agg(F.sum("n").alias("n"))
    words = written(map_rows(counts, "word string, n long, pieces int", _pieces(tokenizer)), "words")

    # the frequent words: whole classes of log2(frequency), as many as local_words allows
    short = F.length("word") <= 64
    step = F.floor(F.log2("n") * 8)
    classes = sorted(words.where(short).groupBy(step.alias("c")).count().collect(), reverse=True)
    least, total = None, 0
    for c, n in classes:
        if (total := total + n) > local_words:
            break
        least = c
    frequent = short & (step >= least) if least is not None else F.lit(False)
    local = spark.sparkContext.broadcast({w: p for w, p in words.where(frequent).select("word", "pieces").collect()})

    rows = map_rows(texts, "row long, key string, n_bytes long, tokens long, rest array<struct<word:string,n:long>>".replace("key string", f"key {texts.schema['key'].dataType.simpleString()}"), _frequencies(tokenizer, local))
    # One entry more for each row carries the row itself; its word matches none, and differs for each row.
    own = F.struct(F.concat(F.lit("\0"), F.col("row").cast("string")).alias("word"), F.col("tokens").alias("n"))
    entries = rows.select("row", "key", "n_bytes", F.explode(F.concat(F.array(own), "rest")).alias("e")).select(
        "row", F.col("e.n").alias("n"), F.col("e.word").alias("word"), *(F.when(F.col("e.word").startswith("\0"), F.col(c)).alias(c) for c in ("key", "n_bytes"))
    )
    joined = entries.join(words.where(~frequent).select("word", "pieces"), "word", "left")
    pieces = F.when(F.col("pieces").isNotNull(), F.col("pieces")).when(F.col("n_bytes").isNotNull(), 1).otherwise(F.raise_error(F.lit("a word has no count")).cast("int"))
    return (
        joined.groupBy("row").agg(F.max("key").alias(key), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * pieces).alias("n_tokens"))
        .select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
