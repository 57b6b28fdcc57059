"""Near-duplicate classes from bottom-k sketches of one hash function.

1. Every text becomes the set of its word shingles as 64-bit hashes.  Texts with
   the same set are one node; a node keeps its set's ``k`` smallest hashes (the
   bottom-k sketch), in order.
2. Inverted lists over the ``lead`` smallest retained values give the overlaps:
   two sets of Jaccard 0.75 share none of them with a chance of about
   0.25 ** lead.
3. A value whose list is longer than ``wide`` (a passage that many texts share, or
   a large group of copies) is no evidence by itself and would give all pairs of
   its texts.  Nodes that hold such values post their whole sketch in a second family
   of lists instead, of which again the wide ones say nothing.  A node whose lead
   values are wide in good part is held back and linked through stars: its lists'
   fullest members, then whatever shares rare shingles, and then what is still apart.
4. The union of two sketches estimates their Jaccard similarity and drops pairs
   far below the threshold; the rest is confirmed on the full sets.
5. Links become components; a component is named after its least doc_id.

Rows per value never exceed ``wide`` in one task except in joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import row_blocks, staged, text_buffer, texts
from .components import connected_components

#: Retained values of a sketch, values with inverted lists, length from which a list is wide.
K, LEAD, WIDE = 64, 16, 48
#: A node is held back for star linking if this share of its lead values is wide (one that only wide values link has 3/4; 5 of 16 miss it once in 25,000).
HELD = (5, 16)
#: Pairs whose union sketch shows less than this are dropped unconfirmed (5.5 standard deviations below 0.75 at k = 64).
LEAST_ESTIMATE = 0.45
_SIGN = np.uint64(1 << 63)


def _node(s: np.ndarray) -> bytes:
    a, b = W.mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64), W.mix(s + np.uint64(0x9E6C63D0876A9A47)).sum(dtype=np.uint64)
    return W.mix(np.array([a, b], np.uint64) + np.uint64(len(s))).astype(">u8").tobytes()


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for i, j in row_blocks(offsets):
        hashes, at = W.words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], W.SPACE)
        yield from W.shingles(hashes, at, size)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Hashes as signed integers in the same order."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(ends, pa.array((flat ^ _SIGN).view(np.int64)))


def _sketcher(size: int, k: int):
    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            sets = list(_sets(data, offsets, size))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.binary()),
                 _lists([s[:k] for s in sets])], ["doc_id", "n", "node", "sketch"])
    return run


def _full_sets(size: int):
    def run(batches):
        for b in batches:
            for i, j in row_blocks(text_buffer(b.column(1))[1], 1 << 22):
                data, offsets = text_buffer(b.column(1).slice(i, j - i))
                sets = list(_sets(data, offsets, size))
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) if len(s) else None for s in sets], pa.binary()), _lists(sets)], ["node", "vals"])
    return run


def sketches(docs: DataFrame, size: int = 5, k: int = K) -> DataFrame:
    """(doc_id, n, node, sketch) per row: set size, set fingerprint (null: empty set), k smallest hashes."""
    return texts(docs).mapInArrow(_sketcher(size, k), "doc_id long, n long, node binary, sketch array<long>")


def _wide_of(posts: DataFrame, wide: int) -> DataFrame:
    return posts.groupBy("v").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > wide).select("v")


def _posts(nodes: DataFrame, values) -> DataFrame:
    return nodes.select("node", "n", F.explode(values).alias("v"))


def _close(a, b, num: int, den: int):
    """Sizes that a pair at the threshold may have."""
    return (F.least(a, b) * den >= F.greatest(a, b) * num)


def _narrow_pairs(posts: DataFrame, wide: int, num: int, den: int, least_size: int = LEAD) -> DataFrame:
    """Pairs that share lists of at most ``wide`` nodes: two of them, unless a set is so small that one must do."""
    lens = posts.groupBy("v").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt").between(2, wide)).select("v")
    groups = posts.join(lens, "v").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    return (groups.select(F.expr("inline(flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> "
                                 "struct(x.node as a, x.n as na, y.node as b, y.n as nb)))))"))
            .where(_close(F.col("na"), F.col("nb"), num, den)).groupBy("a", "b")
            .agg(F.count(F.lit(1)).alias("shared"), F.least(F.min("na"), F.min("nb")).alias("n"))
            .where((F.col("shared") >= 2) | (F.col("n") < least_size)).select("a", "b"))


def _likely(pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Distinct pairs with their overlap in the union sketch, those far below the threshold left out."""
    s = nodes.select("node", "sketch")
    p = (pairs.distinct().join(s.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a")
         .join(s.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b"))
    p = p.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    p = p.withColumn("est", F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u")) / F.size("u"))
    return p.where(F.col("est") >= LEAST_ESTIMATE).select("a", "b", "est")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    p = (pairs.join(sets.withColumnsRenamed({"node": "a", "vals": "va"}), "a")
         .join(sets.withColumnsRenamed({"node": "b", "vals": "vb"}), "b"))
    both = F.size(F.array_intersect("va", "vb"))
    return p.where(both * den >= (F.size("va") + F.size("vb") - both) * num).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs not yet in one component."""
    r = roots.withColumnRenamed("root", "r")
    p = pairs.select("a", "b").join(r.withColumnsRenamed({"node": "a", "r": "ra"}), "a", "left").join(
        r.withColumnsRenamed({"node": "b", "r": "rb"}), "b", "left")
    return p.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _split(held: DataFrame, sets: DataFrame, wide: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The members of the wide lists as (v, node, n, w, c), and the pairs of them that share a rare shingle.

    Over the members' full sets a shingle is common if more than ``wide`` of them
    hold it: w and c count a member's common and other shingles.  Each set is posted
    once, so the rows are the sum of the members' set sizes.  By the merge hint they are
    dealt by node at every size: a broadcast of ``held`` would leave them to the tasks
    that read ``sets``, in which members may lie unevenly.
    """
    each = staged(_posts(sets.join(held.select("node", "n").hint("merge"), "node"), F.col("vals")), "members")
    common = (each.join(_wide_of(each, wide), "v", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("w")))
    counted = (held.join(common, "node", "left").withColumn("w", F.coalesce("w", F.lit(0)))
               .select("node", "n", "w", (F.col("n") - F.col("w")).alias("c"), F.explode("lists").alias("v")))
    return staged(counted, "held"), _narrow_pairs(each, wide, num, den, 1 << 30)


def _across(held: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a wide list whose members are still apart and could be linked: every member outside
    the list's largest component with members of the others.

    Pairs that share a rare shingle are known by now.  Without one, the shared part is
    at most the lesser w and the union at least the greater w and both c: a pair
    beyond that bound is no link, so members far from all others take no comparison.
    """
    m = held.join(roots, "node", "left").select("v", "node", "w", "c", F.coalesce("root", "node").alias("r"))
    m = m.where(F.col("w") * (den - num) >= F.col("c") * num)
    largest = (m.groupBy("v", "r").agg(F.count(F.lit(1)).alias("cnt")).groupBy("v")
               .agg(F.max(F.struct("cnt", "r")).alias("x"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
               .select("v", F.col("x.r").alias("top")))
    m = staged(m.join(largest, "v"), "members")
    rest = m.where("r <> top").select("v", F.col("node").alias("y"), F.col("w").alias("wy"), F.col("c").alias("cy"), F.col("r").alias("ry"))
    could = F.least("w", "wy") * den >= (F.greatest("w", "wy") + F.col("c") + F.col("cy")) * num
    return (rest.join(m, "v").where((F.col("r") != F.col("ry")) & could)
            .select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b")).distinct())


def near_duplicates(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (3, 4), k: int = K,
                    lead: int = LEAD, wide: int = WIDE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable), kept.

    Null and empty texts, and texts without words, have no shingles and are linked
    with nothing: their own doc_id is their component.  Repeated rows (the same
    doc_id again) are judged by their own text.  An empty table gives no rows.
    Only doc_id and text are read; other columns may have any name.
    """
    num, den = threshold
    rows = staged(sketches(docs, size, k), "sketches")
    nodes = staged(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                                           F.first("sketch").alias("sketch")), "nodes")
    # First family: the lead values of all nodes.
    posts = staged(_posts(nodes, F.slice("sketch", 1, lead)), "posts")
    narrow = _narrow_pairs(posts, wide, num, den)
    held = None
    wides = staged(_wide_of(posts, wide), "wide")
    if not wides.isEmpty():
        # Second family: whole sketches of the nodes that hold a wide lead value, among themselves.
        touched = staged(posts.join(wides, "v", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("v")).alias("lists"))
                         .join(nodes, "node").select("node", "n", "lists", "sketch"), "touched")
        narrow = narrow.unionByName(_narrow_pairs(_posts(touched, F.col("sketch")), wide, num, den))
        held = touched.where(F.size("lists") * HELD[1] >= F.least(F.size("sketch"), F.lit(lead)) * HELD[0]).select("node", "n", "lists")
    pairs = staged(_likely(narrow, nodes, k), "pairs")
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    if held is not None:
        ids = ids.unionByName(held.select("node"))
    wanted = staged(nodes.join(ids.distinct(), "node", "left_semi").select("doc_id", "node"), "wanted")
    some = texts(docs).join(wanted.select("doc_id"), "doc_id", "left_semi")
    sets = staged(some.mapInArrow(_full_sets(size), "node binary, vals array<long>")
                  .join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    if held is not None:
        held, shared = _split(held, sets, wide, num, den)
        hubs = held.groupBy("v").agg(F.max(F.struct(F.col("w") - F.col("c"), "node")).alias("hub"))
        stars = (held.join(hubs, "v").select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"))
                 .where("a <> b"))
        pairs = staged(pairs.unionByName(_likely(stars.unionByName(shared), nodes, k)).distinct(), "pairs")

    # First each node's likeliest partner, then only pairs that are still apart.
    ends = pairs.select(F.col("a").alias("x"), "a", "b", "est").unionByName(pairs.select(F.col("b").alias("x"), "a", "b", "est"))
    best = ends.groupBy("x").agg(F.max(F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = staged(_confirmed(best, sets, num, den), "links")
    roots = connected_components(links, 2)
    links = links.unionByName(staged(_confirmed(_apart(pairs, roots), sets, num, den), "links"))
    if held is not None:
        across = _likely(_across(held, connected_components(links, 2), num, den), nodes, k)
        links = links.unionByName(staged(_confirmed(across, sets, num, den), "links"))
    roots = staged(connected_components(links), "roots")
    least = roots.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = (nodes.select("node", "doc_id").join(roots.join(least, "root"), "node", "left")
             .select("node", F.coalesce("component_id", "doc_id").alias("component_id")))
    out = rows.select("doc_id", "n", "node").join(named, "node", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("doc_id") == comp).alias("kept"))
