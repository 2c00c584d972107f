"""Files of token ids: length-delimited binary records with masked checksums, and a separate index of offsets.

A record is

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked crc32 of the length
    payload  doc_id (8 bytes, signed), flags (1 byte: 1 if doc_id is null), width (1 byte: 2 or 4), then the ids
    check    4 bytes: masked crc32 of the payload
    end      1 byte, 0x0A

The mask is the usual one for stored checksums: rotate right by 15 and add 0xA282EAD8, modulo 2^32. Files are written by
Spark's own text writer as raw bytes, so they go to any file system that Spark knows, are committed as a whole, and a lost
task leaves nothing behind. Their names rise with doc_id.

Edge cases: a null or empty text gives a record with the end id only; a null doc_id sorts first; repeated doc_ids give one
record each, ordered by text; an empty table gives an empty index; other columns are ignored.
"""
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from coverlens.llm.tokens import crc32_of, encoder, ids_of, tokenizer_path
from coverlens.session import work_dir

#: Bytes gathered into one written row, and such rows per file: a file holds about BLOCK * BLOCKS bytes.
BLOCK = 4 << 20
BLOCKS = 8
END_ID = 2

_HEAD, _HEAD_BYTES = "<QI", 12
_PAYLOAD, _PAYLOAD_BYTES = "<qBB", 10
_CHECK = "<I"
_END = b"\n"

INDEX = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
                      T.StructField("chunk", T.IntegerType()), T.StructField("offset", T.LongType()),
                      T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()),
                      T.StructField("ids_crc32", T.LongType())])


def masked(data):
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id, ids, width):
    """One record without its end byte; ids: bytes."""
    payload = struct.pack(_PAYLOAD, doc_id or 0, doc_id is None, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(_CHECK, masked(length)) + payload + struct.pack(_CHECK, masked(payload))


def read_frames(data, start=0, most=None):
    """(offset, doc_id, ids) of the records from `start` on; raises ValueError where a check fails."""
    at, end, count = start, len(data), 0
    while at < end and (most is None or count < most):
        if at + _HEAD_BYTES > end:
            raise ValueError(f"record at {at}: cut short")
        length, check = struct.unpack_from(_HEAD, data, at)
        if masked(data[at:at + 8]) != check:
            raise ValueError(f"record at {at}: wrong length check")
        body = at + _HEAD_BYTES
        payload = data[body:body + length]
        if len(payload) < length or data[body + length + 4:body + length + 5] != _END:
            raise ValueError(f"record at {at}: cut short")
        if masked(payload) != struct.unpack_from(_CHECK, data, body + length)[0]:
            raise ValueError(f"record at {at}: wrong payload check")
        doc_id, flags, width = struct.unpack_from(_PAYLOAD, payload)
        yield at, None if flags & 1 else doc_id, ids_of(payload[_PAYLOAD_BYTES:], width)
        at, count = body + length + 5, count + 1


def write_records(docs, folder, path=None, end_id=END_ID):
    """Encodes every text, appends end_id and writes the records in ascending doc_id order."""
    path = path or tokenizer_path()

    def blocks(batches):
        import pyarrow as pa
        encode = encoder(path)
        end = np.array([end_id], f"<u{encode.width}").tobytes()
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(frame(doc_id, encode(text.as_py()) + end, encode.width))
                size += len(held[-1]) + 1
                if size >= BLOCK:
                    yield pa.record_batch([pa.array([_END.join(held)], pa.binary())], ["block"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([_END.join(held)], pa.binary())], ["block"])

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("block"))
     .write.option("maxRecordsPerFile", BLOCKS).text(folder))


def record_files(spark, folder):
    name = F.element_at(F.split("path", "/"), -1)
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
            .select(F.regexp_extract(name, r"part-(\d+)", 1).cast("int").alias("part"),
                    F.regexp_extract(name, r"-c(\d+)\.", 1).cast("int").alias("chunk"), "content"))


def write_index(spark, folder, index_folder):
    """Reads the files back, checks every record and writes doc_id, place, length and checksum of each."""
    def scan(batches):
        import pyarrow as pa
        for batch in batches:
            for part, chunk, data in zip(*(batch.column(i).to_pylist() for i in (0, 1))
                                         , (memoryview(x.as_buffer()) for x in batch.column(2))):
                rows, before = [], 0
                for offset, doc_id, ids in read_frames(data):
                    rows.append((doc_id, part, chunk, offset, before, len(ids), crc32_of(ids)))
                    before += len(ids)
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], INDEX.names)

    record_files(spark, folder).mapInArrow(scan, INDEX).write.parquet(index_folder)
    return spark.read.schema(INDEX).parquet(index_folder)


def with_starts(index):
    """Adds `start`: the ids of all documents before each. The only total order is over files, not rows."""
    files = index.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("tokens"))
    running = W.orderBy("part", "chunk").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("part", "chunk", F.coalesce(F.sum("tokens").over(running), F.lit(0)).alias("first"))
    return (index.join(files, ["part", "chunk"])
            .select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "part", "chunk", "offset"))


def read_shuffled(spark, folder, index, seed):
    """(position, doc_id, ids) of all records in an order drawn from `seed`, fetched by their offsets in the index.

    Positions are drawn per record, so each file is opened once, and the records meet in drawn order by a range shuffle.
    """
    wanted = (index.select("part", "chunk", "offset", F.xxhash64(F.lit(seed), "doc_id", "part", "chunk", "offset").alias("position"))
              .groupBy("part", "chunk").agg(F.collect_list(F.struct("offset", "position")).alias("wanted")))

    def fetch(batches):
        import pyarrow as pa
        for batch in batches:
            for data, rows in zip(batch.column(0), batch.column(1).to_pylist()):
                data, out = memoryview(data.as_buffer()), []
                for row in rows:
                    _, doc_id, ids = next(read_frames(data, row["offset"], 1))
                    out.append((row["position"], doc_id, ids.astype("i4").tolist()))
                yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                       pa.array([r[2] for r in out], pa.list_(pa.int32()))], ["position", "doc_id", "ids"])

    return (record_files(spark, folder).join(wanted, ["part", "chunk"]).select("content", "wanted")
            .mapInArrow(fetch, "position long, doc_id long, ids array<int>")
            .repartitionByRange("position").sortWithinPartitions("position", "doc_id"))


def token_records(docs, path=None, end_id=END_ID):
    """Writes records and index into the shared work folder; returns one row per document, read back from them."""
    spark = docs.sparkSession
    folder = work_dir(spark, "token-records")
    write_records(docs, f"{folder}/records", path, end_id)
    return with_starts(write_index(spark, f"{folder}/records", f"{folder}/index"))
