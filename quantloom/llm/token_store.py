"""Token ids in binary shards, each document compressed alone with one shared zstandard dictionary.

A shard is: the magic, the SHA-256 of the dictionary (32 bytes), the zstandard frames of
its documents in ascending id order, then the index (validity byte, id int64, tokens
uint32, frame end uint64, each as an array), the number of documents (uint64), the width
of an id in bytes (uint64) and the magic again. A document is read with its entry of the
index and one seek.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import cut, new_path, slices, small_batches, smallest_hashes, whole
from quantloom.llm.tokens import coder, default_path

MAGIC = b"QLTOK001"
#: zstandard ignores raw content of fewer than 8 bytes, so shorter content is repeated up to this length.
LEAST_DICTIONARY = 64
#: How zstandard's trained dictionaries begin; raw content must not.
TRAINED = b"\x37\xa4\x30\xec"
MANIFEST = "path string, task int, part int, first_id long, n_docs long, n_tokens long, id_bytes int, dictionary string"
#: A shard is closed, and another one begun, when it has so many documents or bytes of frames.
SHARD_DOCS, SHARD_BYTES = 1 << 18, 256 << 20
#: Characters of a text that rows of one id are dealt by.
TIE_CHARS = 256


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def _width(vocabulary: str, end_id: int) -> int:
    return 2 if max(coder(vocabulary).coder.get_vocab_size(), end_id + 1) <= 65536 else 4


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, sample_docs: int = 1000, sample_bytes: int = 65536, size: int = 65536) -> bytes:
    """The dictionary: trained on the id arrays of ``sample_docs`` documents, those whose
    ids have the smallest hashes, of each at most ``sample_bytes``. Null ids count only where there are no
    others, and of a repeated id only the least text does; so what reaches the driver is bounded by
    these parameters. Where the samples are too few or too short to train on, their own bytes are the
    dictionary (zstandard's raw content form), so only an empty table has none."""
    import zstandard

    width = _width(vocabulary, end_id)
    end = end_id.to_bytes(4, "little")
    ids = smallest_hashes(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", sample_docs)
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("body").alias("body")).select("body")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.record_batch({"ids": pa.array([_narrow(own.encode(t) + end, width)[:sample_bytes] for t in part.column(0).to_pylist()], pa.binary())})

    samples = sorted(bytes(r[0]) for r in rows.mapInArrow(encode, "ids binary").collect())
    if not samples:  # no ids but null ones: the least text, if there is a row
        samples = [bytes(r[0]) for r in docs.agg(F.min("body").alias("body")).where("body is not null").mapInArrow(encode, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-size:]
        raw *= -(-LEAST_DICTIONARY // len(raw)) if raw else 0
        return b"\0" + raw if raw.startswith(TRAINED) else raw


def write_store(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into shards under the shared folder; returns the manifest, a row a shard.

    Rows are range-partitioned by id, and those of one id by the beginnings of their texts, and sorted, so shards hold ascending ids.
    Each task streams its rows into files with names of their own, each of at most SHARD_DOCS documents and, but for its last one, SHARD_BYTES bytes, so neither
    the index that a task holds nor what is read by one task grows with the corpus; only files that the
    manifest names count, and Spark commits one attempt of each task to it, so a task that
    is run again leaves no trace in the result. Null text counts as empty and gives just
    ``end_id``; rows with a null id come first; repeated ids stand next to each other, ordered
    by text. Ids are cast to long. An empty table gives an empty manifest. Other columns are ignored.
    """
    import zstandard

    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_path()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("body"))
    dictionary, width = train_dictionary(base, vocabulary, end_id), _width(vocabulary, end_id)
    end, digest = end_id.to_bytes(4, "little"), hashlib.sha256(dictionary).digest()
    folder = new_path(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("/") else folder.removeprefix("file:")
    files, at = _open(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/dictionary.zstd") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = coder(vocabulary), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=level)
        shard, n = None, 0
        for batch in batches:
            for part in slices(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if shard is None:
                        shard = _Writer(folder, digest, width)
                    raw = _narrow(own.encode(text) + end, width)
                    shard.add(doc, packer.compress(raw), len(raw) // width)
                    if len(shard.ids) >= SHARD_DOCS or shard.place >= SHARD_BYTES:
                        yield shard.close(task, n)
                        shard, n = None, n + 1
        if shard is not None:
            yield shard.close(task, n)

    ranged = base.repartitionByRange("doc_id", F.substring("body", 1, TIE_CHARS)).sortWithinPartitions("doc_id", "body")
    manifest = cut(ranged.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class _Writer:
    """A shard that is being written, with its index in arrays of some twenty bytes a document."""

    def __init__(self, folder: str, digest: bytes, width: int) -> None:
        files, at = _open(folder)
        name = f"shard-{uuid.uuid4().hex}.tok"
        self.path, self.digest, self.width, self.place = f"{folder}/{name}", digest, width, len(MAGIC) + 32
        self.valid, self.ids, self.tokens, self.ends = bytearray(), array("q"), array("I"), array("Q")
        self.out = files.open_output_stream(f"{at}/{name}")
        self.out.write(MAGIC + digest)

    def add(self, doc: int | None, frame: bytes, tokens: int) -> None:
        self.out.write(frame)
        self.place += len(frame)
        self.valid.append(doc is not None)
        self.ids.append(doc or 0)
        self.tokens.append(tokens)
        self.ends.append(self.place)

    def close(self, task: int, part: int) -> pa.RecordBatch:
        """Writes the index; the shard's row of the manifest."""
        for column, kind in ((self.valid, "u1"), (self.ids, "<i8"), (self.tokens, "<u4"), (self.ends, "<u8"), ([len(self.ids), self.width], "<u8")):
            self.out.write(np.array(column, kind).tobytes())
        self.out.write(MAGIC)
        self.out.close()
        row = {"path": self.path, "task": task, "part": part, "first_id": self.ids[0] if self.valid[0] else None, "n_docs": len(self.ids), "n_tokens": sum(self.tokens), "id_bytes": self.width, "dictionary": self.digest.hex()}
        kinds = [("path", pa.string()), ("task", pa.int32()), ("part", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()), ("dictionary", pa.string())]
        return pa.RecordBatch.from_pylist([row], pa.schema(kinds))


class Shard:
    """One shard: its index, and documents by their place in it."""

    def __init__(self, path: str, dictionary: str) -> None:
        import zstandard

        files, at = _open(path)
        self.file = files.open_input_file(at)
        size = self.file.size()
        tail = self._read(size - 16 - len(MAGIC), 16 + len(MAGIC))
        n, self.width = (int(x) for x in np.frombuffer(tail[:16], "<u8"))
        head = self._read(0, len(MAGIC) + 32)
        if tail[16:] != MAGIC or head[: len(MAGIC)] != MAGIC or head[len(MAGIC) :].hex() != dictionary:
            raise ValueError(f"{path}: not a shard with the dictionary {dictionary}")
        index = self._read(size - 16 - len(MAGIC) - 21 * n, 21 * n)
        self.valid = np.frombuffer(index, "u1", n, 0)
        self.ids = np.frombuffer(index, "<i8", n, n)
        self.tokens = np.frombuffer(index, "<u4", n, 9 * n)
        self.ends = np.frombuffer(index, "<u8", n, 13 * n)
        with files.open_input_file(f"{at.rpartition('/')[0]}/dictionary.zstd") as f:
            raw = f.read()
        if hashlib.sha256(raw).hexdigest() != dictionary:
            raise ValueError(f"{path}: the dictionary file has another hash")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def get(self, k: int) -> np.ndarray:
        start = int(self.ends[k - 1]) if k else len(MAGIC) + 32
        frame = self._read(start, int(self.ends[k]) - start)
        return np.frombuffer(self.unpacker.decompress(frame), f"<u{self.width}")


def read_store(spark: SparkSession, manifest: DataFrame, ids: bool = False, wanted: list[int] | None = None) -> DataFrame:
    """All documents of a store, or those with the ``wanted`` ids: doc_id, start, n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32 bits), and with ``ids`` the ids.
    ``start`` counts the ids of all documents before it, in the order of ids, null first. Rows of one
    id are rows of their own; a null id is read with all, not as wanted. Wanted ids that aren't there give no row."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"], row["dictionary"])
                starts = row["start"] + np.concatenate([[0], np.cumsum(shard.tokens, dtype="i8")])
                places = range(len(shard.ids)) if wanted is None else np.flatnonzero(np.isin(shard.ids, wanted) & (shard.valid == 1))
                rows: list[tuple] = []
                for k in places:
                    own = shard.get(int(k))
                    rows.append((int(shard.ids[k]) if shard.valid[k] else None, int(starts[k]), len(own), zlib.crc32(own.astype("<u4").tobytes()), *([own.astype("i4")] if ids else [])))
                    if len(rows) >= 2000:
                        yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])

    shards = manifest.select("path", "dictionary", "start")
    return shards.repartition(max(1, manifest.count())).mapInArrow(read, schema)
