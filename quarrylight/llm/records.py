"""Token ids in binary files of length-delimited records, with an index of offsets beside each file.

A records file begins with ``MAGIC`` and the bytes per id (2 or 4, then 7 bytes of zero).  A record is

    length of the payload   8 bytes, unsigned
    masked checksum of it   4 bytes
    payload                 1 byte (1: there is an id), the id (8 bytes, signed), the token ids
    masked checksum of it   4 bytes

all little-endian.  A checksum is a CRC-32, turned right by 15 bits and raised by a constant, so that checksums
of data that hold checksums stay sound.  The index has, after the same 16 bytes, an entry per record (offset of the record and
number of ids before it in the file, 8 bytes each), an entry for the end, and the masked checksum of the entries.

Files are written and read by a Python data source, ``token_records``.  A task writes its partition under a
name of its own and reports it; the driver then writes the manifest, one entry per file in the order of the partitions, which
makes the files readable all at once.  What lost or repeated tasks leave behind is in no manifest.  The folder has to be
one that the driver and all executors share.

Defined results: null ids are kept as such and stand first in ascending order; rows of one id stand by checksum
and size of their text; repeated rows are each written; a null text has the end id alone; an empty table has a manifest
without files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from quarrylight.session import prepare, shared_path

from .bpe import Codec, chunks, read_json

MAGIC = b"QLTOKENS"
MANIFEST = "manifest.json"
_LENGTH, _CRC, _KEY, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQ")
HEAD = 16
#: Bytes of payload beside the ids, and of a record beside its payload.
KEY, FRAME = _KEY.size, _LENGTH.size + 2 * _CRC.size
#: Bytes of records that a reader has in memory, unless a single record is longer.
BLOCK = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(key: int | None, ids: bytes) -> bytes:
    """One record of the file."""
    payload = _KEY.pack(key is not None, key or 0) + ids
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CRC.pack(masked(length)), payload, _CRC.pack(masked(payload))))


def unframed(block: bytes, at: int = 0) -> tuple[int | None, bytes, int]:
    """(id, ids, place after it) of the record at ``at``; raises ``ValueError`` where a checksum or a length is wrong."""
    if len(block) < at + FRAME:
        raise ValueError("a record is cut off")
    (size,) = _LENGTH.unpack_from(block, at)
    if _CRC.unpack_from(block, at + 8)[0] != masked(block[at : at + 8]):
        raise ValueError("the length of a record is damaged")
    end = at + 12 + size
    if len(block) < end + 4 or size < KEY:
        raise ValueError("a record is cut off")
    payload = block[at + 12 : end]
    if _CRC.unpack_from(block, end)[0] != masked(payload):
        raise ValueError("a record is damaged")
    known, key = _KEY.unpack_from(payload)
    return (key if known else None), payload[KEY:], end + 4


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def _whole(path: str) -> bytes:
    fs, at = _open(path)
    with fs.open_input_stream(at) as f:
        return f.read()


def read_index(path: str) -> np.ndarray:
    """(offset, ids before) per record and, last, for the end."""
    data = _whole(path)
    if data[:8] != MAGIC or _CRC.unpack(data[-4:])[0] != masked(data[HEAD:-4]):
        raise ValueError(f"{path} is damaged")
    return np.frombuffer(data[HEAD:-4], "<u8").reshape(-1, 2).astype(np.int64)


def manifest(path: str) -> list[dict]:
    """One entry per file: ``file``, ``width``, ``records``, ``ids`` and ``start``, the ids in all files before."""
    found, start = json.loads(_whole(f"{path}/{MANIFEST}")), 0
    for f in found:
        f["start"] = start
        start += f["ids"]
    return found


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    file: str
    width: int
    records: int
    ids: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator) -> _Written:
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        fs, at = _open(f"{self.path}/{name}")
        head, kind = MAGIC + bytes([self.width]) + bytes(7), f"<u{self.width}"
        out, index, offset, before, n = None, bytearray(), HEAD, 0, 0
        for batch in iterator:
            keys, found = batch.column("id").to_pylist(), batch.column("ids")
            for k, key in enumerate(keys):
                if out is None:
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{at}.records")
                    out.write(head)
                ids = np.frombuffer(found[k].as_buffer() or b"", "<u4")
                if self.width == 2 and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id does not fit into two bytes")
                record = framed(key, ids.astype(kind).tobytes())
                out.write(record)
                index += _ENTRY.pack(offset, before)
                offset, before, n = offset + len(record), before + len(ids), n + 1
        if out is not None:
            out.close()
            index += _ENTRY.pack(offset, before)
            with fs.open_output_stream(f"{at}.index") as f:
                f.write(head + bytes(index) + _CRC.pack(masked(bytes(index))))
        return _Written(number, name, self.width, n, before)

    def commit(self, messages) -> None:
        files = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.partition)
        fs, at = _open(f"{self.path}/{MANIFEST}")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        made = f"{at}.{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps([{"file": m.file, "width": m.width, "records": m.records, "ids": m.ids} for m in files]).encode())
        fs.move(made, at)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.records:
                fs, at = _open(f"{self.path}/{m.file}")
                for end in (".records", ".index"):
                    fs.delete_file(at + end)


@dataclass
class _File(InputPartition):
    file: str
    width: int
    start: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, index: bool):
        self.path, self.index = path, index

    def partitions(self) -> list[_File]:
        return [_File(f["file"], f["width"], f["start"]) for f in manifest(self.path)]

    def read(self, partition: _File | None):
        if partition is None:  # an empty manifest
            return
        where = f"{self.path}/{partition.file}"
        index = read_index(f"{where}.index")
        if self.index:
            n = len(index) - 1
            for a in range(0, n, 100_000):
                part = index[a : min(a + 100_000, n) + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.file] * (len(part) - 1)),
                        pa.array([partition.width] * (len(part) - 1), pa.int32()),
                        pa.array(np.arange(a, a + len(part) - 1), pa.int64()),
                        pa.array(part[:-1, 0]),
                        pa.array(np.diff(part[:, 0])),
                        pa.array(part[:-1, 1] + partition.start),
                    ],
                    ["file", "width", "nth", "offset", "bytes", "start"],
                )
            return
        fs, at = _open(f"{where}.records")
        with fs.open_input_stream(at) as f:
            head = f.read(HEAD)
            if head[:9] != MAGIC + bytes([partition.width]):
                raise ValueError(f"{where}.records has another head")
            for a, b in _blocks(index[:, 0]):
                block = f.read(int(index[b, 0] - index[a, 0]))
                yield _batch(block, b - a, partition.width, index[a:b, 1] + partition.start)


def _blocks(offsets: np.ndarray):
    """(from, to) of runs of records of about ``BLOCK`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _batch(block: bytes, n: int, width: int, starts: np.ndarray) -> pa.RecordBatch:
    keys, found, at = [], [], 0
    for _ in range(n):
        key, ids, at = unframed(block, at)
        keys.append(key)
        found.append(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(found, pa.binary())], ["id", "start", "ids"])


class TokenRecords(DataSource):
    """``token_records``: options ``path``, for writing ``width`` (bytes per id), for reading ``index`` (true: entries of the index)."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        if self.options.get("index") == "true":
            return "file string, width int, nth long, offset long, bytes long, start long"
        return "id long, start long, ids binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("index") == "true")

    def writer(self, schema, overwrite) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("width", 4)))


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and host, as tasks without Hadoop's settings need it."""
    prepare(spark)
    spark.dataSource.register(TokenRecords)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def write_records(rows: DataFrame, path: str, width: int = 4) -> str:
    """Write ``id`` (long) and ``ids`` (little-endian 32-bit ids, binary) in the order of partitions and rows; gives the full path."""
    path = _qualified(rows.sparkSession, path)
    rows.select("id", "ids").write.format("token_records").option("width", width).mode("append").save(path)
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``start`` (ids before it in all files) and ``ids``, with every checksum looked at."""
    return spark.read.format("token_records").load(_qualified(spark, path))


def read_index_rows(spark: SparkSession, path: str) -> DataFrame:
    """The index alone: ``file``, ``width``, ``nth``, ``offset``, ``bytes``, ``start``."""
    return spark.read.format("token_records").option("index", "true").load(_qualified(spark, path))


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, slices: int | None = None) -> DataFrame:
    """All records in an order that ``seed`` draws: ``place`` (the random number they stand by), ``id``, ``start`` and ``ids``.

    Only index entries are shuffled; a task then reads its records at their offsets.
    """
    path = _qualified(spark, path)
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["place", "file", "nth"]
    drawn = read_index_rows(spark, path).withColumn("place", F.xxhash64(F.lit(seed), "file", "nth"))
    drawn = drawn.repartitionByRange(slices, *order).sortWithinPartitions(*order)

    def run(batches):
        for batch in batches:
            files, width, offset, size = (np.array(batch.column(c).to_pylist()) for c in ("file", "width", "offset", "bytes"))
            place, start = batch.column("place"), np.array(batch.column("start"))
            for a, b in _blocks(np.append(0, np.cumsum(size))):
                parts = [None] * (b - a)
                for name in np.unique(files[a:b]):
                    fs, at = _open(f"{path}/{name}.records")
                    own = a + np.flatnonzero(files[a:b] == name)
                    with fs.open_input_file(at) as f:
                        for k in own[np.argsort(offset[own])].tolist():
                            parts[k - a] = _batch(f.read_at(int(size[k]), int(offset[k])), 1, int(width[k]), start[k : k + 1])
                table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([place.slice(a, b - a), *table.columns], ["place", "id", "start", "ids"])

    return drawn.mapInArrow(run, "place long, id long, start long, ids binary")


class LibraryCodec(Codec):
    """Pre-tokens that are tokens come from the hash, all others from the ``tokenizers`` library, many in one call."""

    def __init__(self, path: str):
        super().__init__(*read_json(path))
        self.library = Tokenizer.from_file(path)

    def split(self, pieces: list[bytes]) -> list[list[int]]:
        if not pieces:
            return []
        found = self.library.encode([p.decode() for p in pieces], is_pretokenized=True, add_special_tokens=False)
        words = np.fromiter(found.word_ids, np.int64, len(found.ids))
        cuts = np.searchsorted(words, np.arange(len(pieces) + 1)).tolist()
        ids = found.ids
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


def tokenised(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (little-endian 32-bit, ``end_id`` last), ascending by id over the partitions; ``path`` is a ``tokenizers`` JSON file.

    Texts are dealt by range of id before they are encoded, so each is encoded once and no ids are shuffled; rows of one id,
    however many, spread over several partitions.
    """
    spark = docs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["id", "crc", "size", "spread"]
    rows = rows.withColumns(
        {"crc": F.crc32(F.col("text").cast("binary")), "size": F.octet_length("text"), "spread": F.xxhash64(F.monotonically_increasing_id())}
    )
    rows = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order).select("id", "text")
    shared = spark.sparkContext.broadcast(library_codec(path))  # as large as the vocabulary

    def run(batches):
        tool = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                found = [np.append(x, end_id).astype("<u4").tobytes() for x in tool.encode_all(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], ["id", "ids"])

    return rows.mapInArrow(run, "id long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs`` and write them in ascending order of ids; gives the folder, one in the shared folder by default."""
    spark = docs.sparkSession
    width = 2 if max(end_id, len(library_codec(tokenizer).tokens) - 1) <= 0xFFFF else 4
    return write_records(tokenised(docs, tokenizer, end_id, id_col, text_col), path or shared_path(spark, "token-records"), width)
