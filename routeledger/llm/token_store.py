"""Token-ID store: one zstandard frame per document, a shared dictionary, an offset index.

A store is a folder of three Parquet tables:

* ``dictionary``: dict_hash (sha256), id_bytes, data - trained on the serialized
  ids of a bounded sample of documents (``sample_docs`` texts of at most
  ``SAMPLE_CHARS`` characters; only compression depends on it);
* ``shards``: part, shard, dict_hash, doc_ids, ends, counts, blob - frames of
  consecutive documents in ascending doc_id, back to back; ``ends`` is where each
  frame ends in the blob;
* ``index``: doc_id, part, shard, slot, offset, length, start, n_tokens - where a
  document's frame lies, so that one is read without its neighbours.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_blocks, staged, text_buffer, texts
from .tokens import encoder

VOCABULARY, END_ID = "word_bpe_49k.json", 2
DICT_BYTES, SAMPLE_CHARS, SHARD_BYTES = 1 << 16, 20_000, 1 << 22


def _encoded(batch: pa.RecordBatch, vocabulary: str, end_id: int | None):
    """(doc_id, ids) of each row, the end id appended."""
    enc = encoder(vocabulary)
    data, offsets = text_buffer(batch.column(1))
    ids_of = batch.column(0).to_pylist()
    for i, j in row_blocks(offsets, 1 << 22):
        ids, at = enc.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        for k in range(i, j):
            x = ids[at[k - i]:at[k - i + 1]]
            yield ids_of[k], x if end_id is None else np.append(x, np.int32(end_id))


def _train(docs: DataFrame, vocabulary: str, end_id: int, sample_docs: int) -> tuple[bytes, int]:
    import zstandard
    id_bytes = encoder(vocabulary).ids_bytes
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(sample_docs)
    some = (docs.join(ids.distinct(), "doc_id", "left_semi").where(F.length("text") <= SAMPLE_CHARS)
            .orderBy(F.xxhash64("doc_id"), "text").limit(sample_docs))
    rows = some.toArrow().to_batches()
    samples = [x.astype(f"<u{id_bytes}").tobytes() for b in rows for _, x in _encoded(b, vocabulary, end_id)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes(), id_bytes
    except zstandard.ZstdError:  # too few samples
        return b"".join(samples)[:DICT_BYTES], id_bytes


def write_store(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID,
                sample_docs: int = 1000) -> None:
    """Encode every whole text and write the store to ``path`` (a folder that all executors share).

    Null texts are empty (the end id alone); rows with a repeated doc_id stand next to each
    other; null doc_ids come first; an empty table gives empty tables.
    """
    spark, docs = docs.sparkSession, texts(docs)
    dictionary, id_bytes = _train(docs, vocabulary, end_id, sample_docs)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, id_bytes, dictionary)], "dict_hash string, id_bytes int, data binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def frames(batches):
        import zstandard
        pack = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for b in batches:
            got = [(d, len(x), pack.compress(x.astype(f"<u{id_bytes}").tobytes())) for d, x in _encoded(b, vocabulary, end_id)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                                             ["doc_id", "n_tokens", "frame"])

    def shards(batches):
        part, shard = TaskContext.get().partitionId(), 0
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["part", "shard", "dict_hash", "doc_ids", "ends", "counts", "blob"]

        def row():
            values = (part, shard, dict_hash, ids, np.cumsum([len(f) for f in held]).tolist(), counts, b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        ids, counts, held, size = [], [], [], 0
        for b in batches:
            for d, n, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids.append(d)
                counts.append(n)
                held.append(f)
                size += len(f)
                if size >= SHARD_BYTES:
                    yield row()
                    ids, counts, held, size, shard = [], [], [], 0, shard + 1
        if ids:
            yield row()

    first = staged(docs.mapInArrow(frames, "doc_id long, n_tokens long, frame binary"), "frames")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (first.withColumn("tie", F.xxhash64("frame")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
     .mapInArrow(shards, "part int, shard int, dict_hash string, doc_ids array<long>, ends array<long>, counts array<long>, blob binary")
     .write.parquet(f"{path}/shards"))
    index = _starts(spark, path).drop("blob").mapInArrow(_index_rows, INDEX)
    index.write.parquet(f"{path}/index")


INDEX = "doc_id long, part int, shard int, slot int, offset long, length long, start long, n_tokens long"


def _index_rows(batches):
    for b in batches:
        for r in b.to_pylist():
            ends, counts = np.array(r["ends"], np.int64), np.array(r["counts"], np.int64)
            n = len(ends)
            offset = ends - np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * n, pa.int32()), pa.array([r["shard"]] * n, pa.int32()),
                 pa.array(np.arange(n, dtype=np.int32)), pa.array(offset), pa.array(ends - offset),
                 pa.array(r["start"] + np.cumsum(counts) - counts), pa.array(counts)],
                [c.split()[0] for c in INDEX.split(", ")])


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the ids before each: totals of parts, then of the shards within a part."""
    shards = spark.read.parquet(f"{path}/shards")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = shards.select("part", "shard", total.alias("t"))
    parts = totals.groupBy("part").agg(F.sum("t").alias("t"))  # one row per partition of the store
    before = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    inside = totals.select("part", "shard", (F.sum("t").over(Window.partitionBy("part").orderBy("shard")) - F.col("t")).alias("inside"))
    base = inside.join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("start"))
    return shards.join(base, ["part", "shard"])


def _dictionary(spark: SparkSession, path: str) -> tuple[str, int, bytes]:
    r = spark.read.parquet(f"{path}/dictionary").first()  # one row
    return r["dict_hash"], r["id_bytes"], bytes(r["data"])


def read_store(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the shards.

    A shard whose dict_hash is not that of the store's dictionary is refused.
    """
    dict_hash, id_bytes, dictionary = _dictionary(spark, path)

    def decode(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["dict_hash"] != dict_hash:
                    raise ValueError(f"shard {r['part']}/{r['shard']} was written with another dictionary")
                blob, ends = memoryview(r["blob"]), [0, *r["ends"]]
                frames = [np.frombuffer(unpack.decompress(blob[x:y]), f"<u{id_bytes}").astype("<u4") for x, y in zip(ends, ends[1:])]
                lens = np.array([len(x) for x in frames], np.int64)
                out = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + np.cumsum(lens) - lens), pa.array(lens),
                       pa.array([zlib.crc32(x.tobytes()) for x in frames], pa.int64())]
                if ids:
                    out.append(pa.array([x.astype(np.int32) for x in frames], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(out)])

    return _starts(spark, path).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents of ``wanted(doc_id)``: the index gives each one's slice of a blob, nothing else is unpacked."""
    dict_hash, id_bytes, dictionary = _dictionary(spark, path)

    def decode(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for b in batches:
            ids = [np.frombuffer(unpack.decompress(f), f"<u{id_bytes}").astype(np.int32) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    at = spark.read.parquet(f"{path}/index").join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    shards = spark.read.parquet(f"{path}/shards").where(F.col("dict_hash") == dict_hash).select("part", "shard", "blob")
    frames = at.join(shards, ["part", "shard"]).select("doc_id", F.expr("substring(blob, cast(offset + 1 as int), cast(length as int))").alias("frame"))
    return frames.mapInArrow(decode, "doc_id long, ids array<int>")
