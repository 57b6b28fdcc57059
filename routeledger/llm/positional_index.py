"""Benchmark decontamination with a distributed positional inverted index of the corpus.

The index is two Parquet tables.  ``rows`` has a line per document: doc_id, its block
and the position of its first word within the block, and its number of words.  ``postings``
has a line per block and term: the sorted positions of the term in the block.  A
block is what one task read (at most ``BLOCK_WORDS`` words), so building takes no
shuffle and no list is longer than a block.  Documents of a block are set apart by
a gap, so an exact phrase never spans two.

A search turns the test texts into windows of terms.  Only lists of test terms are
read; they meet by block.  In a block a window starts from its rarest term, whose positions
minus the term's offset in the window are the candidate places, and its other terms'
lists, from rare to frequent, strike out places that they don't confirm.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as W
from .common import row_blocks, staged, text_buffer, texts, work_path

WINDOW, BLOCK_WORDS, GAP, SLICE = 13, 2_000_000, 64, 100_000


def _words(col: pa.Array):
    data, offsets = text_buffer(col)
    for i, j in row_blocks(offsets):
        hashes, at = W.words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], W.NOT_ALNUM)
        yield i, hashes.view(np.int64), at


def build(docs: DataFrame, path: str, gap: int = GAP) -> None:
    """Write the index of whole texts to ``path`` (lower-cased A-Z; null texts have no words).

    Every row is a document of its own, repeated doc_ids too; a document without
    words has its line in ``rows`` only.
    """
    def blocks(batches):
        block, n, held, lines = TaskContext.get().partitionId() << 32, 0, [], []

        def flush():
            terms = np.concatenate([h for h, _ in held]) if held else np.zeros(0, np.int64)
            places = np.concatenate([p for _, p in held]) if held else np.zeros(0, np.int32)
            order = np.argsort(terms, kind="stable")
            terms, places = terms[order], places[order]
            first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(terms)).astype(np.int32)), pa.array(places))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block)), pa.array(terms[first]), lists, pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int64())], NAMES)
            ids, starts, counts = (np.concatenate([x[k] for x in lines]) for k in range(3)) if lines else (np.zeros(0, object),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), block)), pa.nulls(len(starts), pa.int64()), pa.nulls(len(starts), pa.list_(pa.int32())), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], NAMES)

        for b in batches:
            ids = np.array(b.column(0).to_pylist(), object)
            for i, hashes, at in _words(b.column(1)):
                m = len(at) - 1
                start = n + at[:-1] + gap * np.arange(m)
                held.append((hashes, (np.repeat(start - at[:-1], np.diff(at)) + np.arange(len(hashes))).astype(np.int32)))
                lines.append((ids[i:i + m], start, np.diff(at)))
                n += len(hashes) + gap * m
                if n >= BLOCK_WORDS:
                    yield from flush()
                    block, n, held, lines = block + 1, 0, [], []
        if lines:
            yield from flush()

    NAMES = ["block", "term", "places", "doc_id", "start", "n_words"]
    made = texts(docs).mapInArrow(blocks, "block long, term long, places array<int>, doc_id long, start long, n_words long")
    made.withColumn("kind", F.when(F.col("start").isNull(), "postings").otherwise("rows")).write.partitionBy("kind").parquet(path)


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, postings) of an index."""
    made = spark.read.schema("block long, term long, places array<int>, doc_id long, start long, n_words long, kind string").parquet(path)
    return (made.where("kind = 'rows'").select("block", "doc_id", "start", "n_words"),
            made.where("kind = 'postings'").select("block", "term", "places"))


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, terms) for every run of ``size`` words of an item; an item of fewer words, but not none, is one window."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, hashes, at in _words(b.column(1)):
                out = [(ids[i + k], hashes[x:min(x + size, at[k + 1])]) for k in range(len(at) - 1)
                       for x in range(at[k], max(at[k + 1] - size + 1, min(at[k] + 1, at[k + 1])))]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], ["item", "terms"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return named.mapInArrow(run, "item string, terms array<long>").distinct()


def _lists(postings: DataFrame, wins: DataFrame) -> DataFrame:
    """The lists of the terms that the windows hold."""
    return postings.join(wins.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")


def search(postings: DataFrame, wins: DataFrame, slop: int | None = None) -> DataFrame:
    """(block, item, place, length) of every window that occurs: exactly at ``place``, or,
    given ``slop``, as all its terms within ``slop`` words of its rarest term at ``place`` (proximity).

    The windows (stated test items, not corpus data) go to every block of the index,
    at most ``SLICE`` of them at a time.
    """
    slices = -(-wins.count() // SLICE)
    if slices <= 1:
        return _search(postings, wins, slop)
    found = [staged(_search(postings, wins.where(F.pmod(F.xxhash64("item", "terms"), F.lit(slices)) == s), slop), "hits") for s in range(slices)]
    return functools.reduce(DataFrame.unionByName, found)


def _search(postings: DataFrame, wins: DataFrame, slop: int | None) -> DataFrame:
    plan = wins.toArrow()  # a slice of the stated query set
    items = np.array(plan.column("item").to_pylist(), object)
    terms = plan.column("terms").to_pylist()
    sizes = np.array([len(t) for t in terms], np.int64)
    width = int(sizes.max()) if len(sizes) else 1
    vocab = np.unique(np.array([t for x in terms for t in x], np.int64))
    # Term numbers of the windows; short windows repeat their first term, which changes nothing.
    table = np.zeros((len(terms), width), np.int64)
    offset = np.zeros((len(terms), width), np.int64)
    for w, t in enumerate(terms):
        table[w, :len(t)] = np.searchsorted(vocab, np.array(t, np.int64))
        table[w, len(t):] = table[w, 0]
        offset[w, :len(t)] = np.arange(len(t))

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(part["term"].to_numpy())
        own = np.searchsorted(vocab, part["term"].to_numpy()[order])
        lists = [part["places"].iloc[i] for i in order]
        df = np.zeros(len(vocab), np.int64)
        df[own] = [len(x) for x in lists]
        first = np.zeros(len(vocab), np.int64)
        first[own] = np.cumsum(df[own]) - df[own]
        flat = np.concatenate(lists).astype(np.int64)
        keys = np.repeat(own, df[own]) << 34 | flat  # sorted, since terms and each list are
        live = np.flatnonzero((df[table] > 0).all(axis=1)) if len(table) else np.zeros(0, np.int64)
        rank = np.argsort(df[table[live]], axis=1, kind="stable")
        tab, off = np.take_along_axis(table[live], rank, 1), np.take_along_axis(offset[live], rank, 1)
        lens = df[tab[:, 0]] if len(live) else np.zeros(0, np.int64)
        win = np.repeat(np.arange(len(live)), lens)
        places = flat[np.repeat(first[tab[:, 0]] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())] if len(live) else flat[:0]
        if slop is None:
            places = places - off[win, 0]
            inside = places >= 0  # the rarest term stands nearer to the block's start than in the window
            win, places = win[inside], places[inside]
        for c in range(1, width):
            if slop is None:
                want = tab[win, c] << 34 | places + off[win, c]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                ok = keys[at] == want
            else:
                want = tab[win, c] << 34
                at = np.minimum(np.searchsorted(keys, want | np.maximum(places - slop, 0)), len(keys) - 1)
                ok = (keys[at] >> 34 == tab[win, c]) & (keys[at] <= (want | (places + slop)))
            win, places = win[ok], places[ok]
        return pd.DataFrame({"block": key[0], "item": items[live[win]], "place": places, "length": sizes[live[win]]})

    return _lists(postings, wins).groupBy("block").applyInPandas(one, "block long, item string, place long, length long")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A word inside an occurrence of any window of any item is hit; contaminated is
    n_hit > 0 and 20 * n_hit >= n_words.  Null and empty texts have no words and
    are clean; an empty benchmark hits nothing; items with equal ids count as one.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "positional-index")
    build(docs, path, max(GAP, size))
    rows, postings = open_index(spark, path)
    hits = search(postings, staged(windows(items, size), "windows"))

    def mark(key, lines: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        import hashlib
        lines = lines.sort_values("start", kind="stable").reset_index(drop=True)
        start, n = lines["start"].to_numpy(np.int64), lines["n_words"].to_numpy(np.int64)
        out = pd.DataFrame({"doc_id": lines["doc_id"].astype("Int64"), "n_words": n})
        n_hit, names = np.zeros(len(lines), np.int64), [[] for _ in range(len(lines))]
        if len(found):
            place, length = found["place"].to_numpy(np.int64), found["length"].to_numpy(np.int64)
            # a document without words starts where the next one's gap begins: the last start at or before a place is its own
            at = np.searchsorted(start, place, side="right") - 1
            steps = np.zeros(int((start + n).max()) + 1, np.int32)
            np.add.at(steps, place, 1)
            np.add.at(steps, place + length, -1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(steps) > 0)])
            n_hit = covered[start + n] - covered[start]
            for d, own in pd.Series(found["item"].to_numpy(object)).groupby(at):
                names[d] = sorted(set(own))
        out["n_hit"] = n_hit
        out["n_items"] = [len(x) for x in names]
        out["items_sha256"] = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        out["contaminated"] = (n_hit > 0) & (20 * n_hit >= n)
        out["items"] = [",".join(x) for x in names]
        return out

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items string"
    return rows.groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(mark, schema)
