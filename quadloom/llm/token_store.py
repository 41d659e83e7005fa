"""Token ids in binary shard files with one zstandard dictionary for all.

Each document's ids are serialised (16 bits an id where the vocabulary allows,
else 32), compressed by themselves against a dictionary trained on a bounded
sample of such arrays, and written in ascending doc_id order. A shard file is

    magic, version, id width, documents, SHA-256 of the dictionary     (header)
    per document: doc_id, tokens, byte offset, bytes                   (index)
    the compressed documents                                          (data)

so one short document is read by its index entry alone. Shards are written
under a temporary name and renamed, which makes a repeated task harmless.

Defined cases: a null or empty text is a document of the end id alone; equal
doc_ids follow each other in text order; a null doc_id sorts first and reads
back as null; doc_ids are cast to long; further columns are ignored; no documents give no shards.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, ship
from .tokens import encode_all, encoder

MAGIC = b"QLTK"
HEAD = struct.Struct("<4sHHQ32s")
ENTRY = np.dtype([("doc_id", "<i8"), ("tokens", "<u4"), ("at", "<u8"), ("bytes", "<u4")])
NO_ID = -(1 << 63)
#: The dictionary is trained on about this many documents (those of the least hash), on a window of this many ids of
#: each, which begins anywhere in the text. It is the one part that sees a sample; every document is written whole.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 8192, 64 << 10
SHARD_BYTES = 32 << 20


def header(width: int, documents: int, digest: bytes) -> bytes:
    return HEAD.pack(MAGIC, 1, width, documents, digest)


def open_dir(uri: str):
    return fs.FileSystem.from_uri(uri)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    import zstandard

    total = docs.count()
    chars = 16 * SAMPLE_IDS
    place = F.xxhash64("doc_id", "text")
    sampled = docs.where(F.pmod(place, F.lit(1 << 40)) <= F.lit(int(min(1.0, SAMPLE_DOCS / max(1, total)) * (1 << 40))))
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    # a document may be repeated without end, so the bound holds for rows as well
    rows = sampled.limit(2 * SAMPLE_DOCS).select(F.substring("text", start, F.lit(chars)).alias("text")).toArrow()
    arrays = []
    for _, ids in encode_all(tokenizer, rows.column("text").combine_chunks()) if len(rows) else ():
        arrays += [np.append(x[:SAMPLE_IDS], end_id).astype(f"<u{width}").tobytes() for x in ids]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:  # too few or too short documents to train on: an equal share of each is the dictionary
        share = DICTIONARY_BYTES // max(1, len(arrays))
        return b"".join(x[: share // width * width] for x in arrays)


def _shards(tokenizer: str, end_id: int, width: int, dictionary: bytes, uri: str, shard_bytes: int):
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = open_dir(uri)
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        digest = hashlib.sha256(dictionary).digest()
        index, data, held, count = [], [], 0, 0

        def flush():
            nonlocal index, data, held, count
            if not index:
                return None
            name = f"part-{task.partitionId():06d}-{count:05d}.qltk"
            temp = f"{root}/_temp-{name}-{task.taskAttemptId()}"
            entries = np.array(index, ENTRY)
            with store.open_output_stream(temp) as f:
                f.write(header(width, len(index), digest))
                f.write(entries.tobytes())
                for x in data:
                    f.write(x)
            store.move(temp, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"shard": [name], "docs": [len(index)], "tokens": [int(entries["tokens"].sum(dtype=np.int64))]}, pa.schema([("shard", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            index, data, held, count = [], [], 0, count + 1
            return row

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids in encode_all(tokenizer, batch.column(1)):
                for i, x in enumerate(ids):
                    blob = press.compress(np.append(x, end_id).astype(f"<u{width}").tobytes())
                    doc = doc_ids[at + i]
                    index.append((NO_ID if doc is None else doc, len(x) + 1, held, len(blob)))
                    data.append(blob)
                    held += len(blob)
                    if held >= shard_bytes:
                        yield flush()
        if (row := flush()) is not None:
            yield row

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, uri: str | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Writes ``docs`` (doc_id, text); returns the folder's URI and its manifest (shard, docs, tokens)."""
    spark = docs.sparkSession
    ship(spark)
    uri = uri or fresh_dir(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = 2 if len(encoder(tokenizer).width) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    store, root = open_dir(uri)
    store.create_dir(f"{root}/data", recursive=True)
    with store.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = rows.mapInArrow(_shards(tokenizer, end_id, width, dictionary, f"{uri}/data", shard_bytes), "shard string, docs long, tokens long")
    manifest.write.parquet(f"{uri}/manifest")
    return uri, spark.read.schema(manifest.schema).parquet(f"{uri}/manifest")


def parse(blob: bytes, dictionary: bytes):
    """Yields (doc_id, ids) of one shard file."""
    import zstandard

    magic, _, width, n, digest = HEAD.unpack_from(blob)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard of this dictionary")
    entries = np.frombuffer(blob, ENTRY, n, HEAD.size)
    base = HEAD.size + n * ENTRY.itemsize
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(blob)
    for doc, tokens, at, size in entries.tolist():
        raw = plain.decompress(view[base + at : base + at + size])
        ids = np.frombuffer(raw, f"<u{width}")
        if len(ids) != tokens:
            raise ValueError(f"document {doc}: {len(ids)} ids, not {tokens}")
        yield (None if doc == NO_ID else doc), ids


def read_one(uri: str, shard: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document, from the shard's index and that document's bytes alone."""
    import zstandard

    store, root = open_dir(uri)
    with store.open_input_stream(f"{root}/dictionary") as f:
        dictionary = f.read()
    with store.open_input_file(f"{root}/data/{shard}") as f:
        _, _, width, n, digest = HEAD.unpack(f.read(HEAD.size))
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        entries = np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)
        k = int(np.searchsorted(entries["doc_id"], doc_id))
        if k == n or entries["doc_id"][k] != doc_id:
            return None
        f.seek(HEAD.size + n * ENTRY.itemsize + int(entries["at"][k]))
        blob = f.read(int(entries["bytes"][k]))
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    return np.frombuffer(plain.decompress(blob), f"<u{width}")


def read(spark: SparkSession, uri: str) -> DataFrame:
    """(shard, position, doc_id, shard_start, n_tokens, ids_crc32) of every document, from the files."""
    ship(spark)
    store, root = open_dir(uri)
    with store.open_input_stream(f"{root}/dictionary") as f:
        dictionary = f.read()

    def run(batches):
        for batch in batches:
            for path, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, start = [], 0
                for k, (doc, ids) in enumerate(parse(blob.as_py(), dictionary)):
                    rows.append((k, doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["shard", "position", "doc_id", "shard_start", "n_tokens", "ids_crc32"])

    schema = "shard string, position long, doc_id long, shard_start long, n_tokens long, ids_crc32 long"
    if not [x for x in store.get_file_info(fs.FileSelector(f"{root}/data")) if x.base_name.endswith(".qltk")]:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qltk").load(f"{uri}/data")
    return files.select("path", "content").mapInArrow(run, schema)


def documents(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """``read`` with each document's start among the ids of all."""
    base = manifest.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    return read(spark, uri).join(base, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
