"""Token ids on disk: one zstandard frame per document, a dictionary that all share, and an offset index.

The file format is a folder with three Parquet tables, so that any store that Spark reaches will do:

dictionary  one row: dict_hash, bytes (of a dictionary trained on serialized id arrays), width (bytes of an id)
blocks      part, block, dict_hash, n_tokens, doc_ids, doc_tokens, doc_starts (within the part), offsets, data: frames of
            consecutive documents in ascending doc_id order; document k's frame is data[offsets[k]:offsets[k + 1]]
index       doc_id, part, block, frame_offset, frame_length, n_tokens, start, dict_hash: where a short document's
            frame is; doc_id ascends over the files, so a look-up reads one row group and one block

The dictionary is trained on a bounded sample, about `sample_docs` documents chosen by an id hash whose ids take at
most `sample_bytes` each; it only helps compression and every document is stored in full.

Defined results: null text is empty (only the end id, if one is asked for); null doc_ids sort first; documents with
the same doc_id are all stored, in the order of their ids' bytes; an empty table gives empty tables and a dictionary
of no bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path
from .tokens import default_tokenizer, encoder, slices

DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_BYTES = 65_536, 2_048, 16_384
BLOCK_BYTES, BLOCK_DOCS, LEVEL = 1 << 20, 4_096, 3


def encode(docs: DataFrame, end_id: int | None = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the ids of every text as little-endian bytes, without a shuffle."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end = b"" if end_id is None else e.pack([end_id])
        for rows in slices(batches):
            ids = [x + end for x in e.encode([r["text"] or "" for r in rows])]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([len(x) // e.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def train(samples: list[bytes], size: int = DICTIONARY_BYTES, **options: int) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, path: str, end_id: int | None = 0, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, level: int = LEVEL, **columns: str) -> str:
    """Write the token files of docs to path and return it."""
    spark = docs.sparkSession
    width = encoder(tokenizer or default_tokenizer()).width
    raw_path = shared_path(spark, "token-ids")
    encode(docs, end_id, tokenizer, **columns).write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema("doc_id long, n_tokens long, ids binary").parquet(raw_path)

    every = max(1, raw.count() // sample_docs)
    picked = raw.where((F.octet_length("ids") <= sample_bytes) & (F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(every)) == 0)).limit(2 * sample_docs)
    dictionary = train(sorted(bytes(r.ids) for r in picked.select("ids").collect()))
    digest = hashlib.sha256(dictionary).hexdigest()[:16]
    spark.createDataFrame([(digest, bytearray(dictionary), width)], "dict_hash string, bytes binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    names = ["part", "block", "dict_hash", "n_tokens", "doc_ids", "doc_tokens", "doc_starts", "offsets", "data"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        compress = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary)).compress
        ids, tokens, frames, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            starts = (start + np.cumsum(tokens) - tokens).tolist()
            values = [part, block, digest, sum(tokens), ids, tokens, starts, offsets, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for i, n, x in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["ids"], strict=True):
                frames.append(compress(x.as_buffer()))
                ids.append(i)
                tokens.append(n)
                size += len(frames[-1])
                if size >= block_bytes or len(ids) >= block_docs:
                    yield row()
                    block, start = block + 1, start + sum(tokens)
                    ids, tokens, frames, size = [], [], [], 0
        if ids:
            yield row()

    ordered = raw.withColumn("h", F.crc32("ids")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").drop("h")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")

    known = spark.createDataFrame(list(part_starts(spark, path).items()), "part int, part_start long")
    each = F.arrays_zip("doc_ids", "doc_tokens", "doc_starts", "offsets", F.slice("offsets", 2, F.size("doc_ids")).alias("until"))
    stored = _blocks(spark, path).select("part", "block", "dict_hash", F.explode(F.slice(each, 1, F.size("doc_ids"))).alias("d"))
    index = stored.join(F.broadcast(known), "part")  # one row for each file
    index = index.select(F.col("d.doc_ids").alias("doc_id"), "part", "block", F.col("d.offsets").alias("frame_offset"), (F.col("d.until") - F.col("d.offsets")).alias("frame_length"), F.col("d.doc_tokens").alias("n_tokens"), (F.col("part_start") + F.col("d.doc_starts")).alias("start"), "dict_hash")
    index.write.parquet(f"{path}/index")
    return path


#: The blocks table.
BLOCKS = "part int, block long, dict_hash string, n_tokens long, doc_ids array<long>, doc_tokens array<long>, doc_starts array<long>, offsets array<long>, data binary"


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Tokens before each part: a number for each file, whatever the number of documents."""
    totals = _blocks(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    out, at = {}, 0
    for r in totals:
        out[r.part] = at
        at += r.n
    return out


def read(spark: SparkSession, path: str, blocks: DataFrame | None = None, with_ids: bool = False) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids as an array.

    blocks: only these rows of the blocks table, with a column wanted (positions in the block), or else all.
    """
    found = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, width, starts = bytes(found["bytes"]), found["width"], part_starts(spark, path)
    digest = found["dict_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                one = {c: row[c][0].as_py() for c in row.schema.names if c != "data"}
                if one["dict_hash"] != digest:
                    raise ValueError(f"a block needs dictionary {one['dict_hash']}; the folder has {digest}")
                data = memoryview(row["data"][0].as_buffer())
                at, out = starts[one["part"]], []
                for j in one.get("wanted") if one.get("wanted") is not None else range(len(one["doc_ids"])):
                    ids = np.frombuffer(decompress(data[one["offsets"][j] : one["offsets"][j + 1]]), f"<u{width}").astype("<u4")
                    if len(ids) != one["doc_tokens"][j]:
                        raise ValueError(f"document {one['doc_ids'][j]} has {len(ids)} ids; its index says {one['doc_tokens'][j]}")
                    out.append((one["doc_ids"][j], at + one["doc_starts"][j], len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array([x.astype("i8").tolist() for x in cols[4]], pa.list_(pa.int64()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    frame = blocks if blocks is not None else _blocks(spark, path)
    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of a few ids with their ids, through the index: only their blocks are read and only their frames decompressed."""
    index = spark.read.parquet(f"{path}/index").where(F.col("doc_id").isin([int(x) for x in doc_ids]))
    wanted = index.groupBy("part", "block").agg(F.collect_list("frame_offset").alias("at"))
    found = _blocks(spark, path).join(F.broadcast(wanted), ["part", "block"])  # as many rows as ids were asked for
    spots = F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda k: F.array_contains("at", F.get("offsets", k)) & F.get("doc_ids", k).isin([int(x) for x in doc_ids]))
    return read(spark, path, found.withColumn("wanted", spots).drop("at"), with_ids=True)
