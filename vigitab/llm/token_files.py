"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each with its own content checksum, then a skippable frame with an index of documents, then the
published seek table (a skippable frame that holds, for every frame, its compressed and plain size and the low half of the XXH64 of its
plain bytes). Standard tools decompress such a file to the plain ids. A document has frames of its own (several if it is long), so a
reader that wants some documents reads the end of a file and those frames, and nothing else is decompressed.

Documents are encoded and compressed where they lie; only compressed frames are shuffled, into ranges of doc_id. A task writes its range
to files of about FILE_BYTES under names of its own and returns a row for each; only returned rows count, so files that a lost or
repeated task left behind are never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import PIECES, default_vocabulary, slices
from .common import documents, map_batches, shared_dir, stored, whole_text

END_ID = 0
#: Ids of a frame at most, bytes and documents of a file at which it is closed.
FRAME_IDS, FILE_BYTES, FILE_DOCS = 1 << 20, 64 << 20, 1 << 20
#: Bytes of remembered pieces in one task, and the longest piece that is remembered.
KNOWN_BYTES, KNOWN_PIECE = 96 << 20, 64
#: Fixed values of the published formats: skippable frames, seek table and its descriptor (checksums present).
INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "<i1"), ("start", "<i8"), ("n", "<i8"), ("frame", "<u4"), ("frames", "<u4")])


#: Letters, digits and white space below this code point are spelled out for the standard `re`, which is twice as fast as properties.
LATIN_END = 0x250


def latin_split():
    """The split of PIECES for texts without a character from LATIN_END on."""
    def spelled(kind: str) -> str:
        return "".join(rf"\u{c:04x}" for c in range(LATIN_END) if regex.match(kind, chr(c)))

    letter, number, space = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    return re.compile(rf" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall


class Encoder:
    """Ids of texts as the tokenizers library gives them, little-endian, in 2 bytes if the vocabulary allows it and else 4.

    With the byte-level split and no normaliser, a text's ids are those of its pieces one after the other, so a task asks the library
    for each distinct piece once. Texts with special tokens, and any text under another kind of tokenizer, go to the library whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = id_type(self.tokenizer.get_vocab_size())
        shape = json.loads(spec)
        before = shape.get("pre_tokenizer") or {}
        self.by_piece = not shape.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.special = [t["content"] for t in shape.get("added_tokens", [])]
        self.any_split, self.latin_split, self.wide = regex.compile(PIECES).findall, latin_split(), re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search
        self.known, self.held = {}, 0

    def split(self, text: str) -> list[str]:
        return self.any_split(text) if self.wide(text) else self.latin_split(text)

    def library(self, texts: list[str]) -> list[bytes]:
        letter = "HI"[self.kind.itemsize // 4]
        return [array(letter, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a list of texts; what is new in all of them goes to the library at once."""
        whole = [not self.by_piece or any(s in t for s in self.special) for t in texts]
        pieces = [[] if w else self.split(t) for t, w in zip(texts, whole)]
        known = self.known
        new = list(set().union(*pieces).difference(known))
        known.update(zip(new, self.library(new)))
        out = [self.library([t])[0] if w else b"".join(map(known.__getitem__, own)) for t, w, own in zip(texts, whole, pieces)]
        for p in new:
            if len(p) > KNOWN_PIECE:
                del known[p]
        self.held += sum(150 + len(p) for p in new)  # of a piece, its ids and their place
        if self.held > KNOWN_BYTES:
            known.clear()
            self.held = 0
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(spec: str) -> Encoder:
    """The encoder of this worker process, kept from task to task as long as the tokenizer is the same."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def frames_of(ids: bytes, width: int, compressor: zstandard.ZstdCompressor) -> list[tuple[bytes, int, int]]:
    """Frames of a document's ids: compressed bytes, plain size, checksum. At least one."""
    step = FRAME_IDS * width
    parts = [ids[at : at + step] for at in range(0, max(len(ids), 1), step)]
    return [(compressor.compress(p), len(p), xxhash.xxh64_intdigest(p) & 0xFFFFFFFF) for p in parts]


ENCODED = "row long, doc_id long, n long, frames array<binary>, plain array<long>, checks array<long>"


def _encode(spec, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compressor = encoder_of(spec.value), zstandard.ZstdCompressor(write_checksum=True)
        last, width = np.array([end], dtype=encoder.kind).tobytes(), encoder.kind.itemsize
        for batch in batches:
            sizes, frames = [], []
            for texts in slices(batch.column("text")):
                for ids in encoder.encode(texts):
                    sizes.append(len(ids) // width + 1)
                    frames.append(frames_of(ids + last, width, compressor))
            columns = [pa.array([[f[k] for f in own] for own in frames], pa.list_(t)) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), *columns], ["row", "doc_id", "n", "frames", "plain", "checks"])

    return run


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri)


class FrameWriter:
    """One file: frames are written as they come; `close` adds the index of documents and the seek table."""

    def __init__(self, uri: str, width: int):
        self.uri, self.width, self.ids, self.bytes = uri, width, 0, 0
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple] = []
        self.fs, self.path = opened(uri)
        self.out = self.fs.open_output_stream(f"{self.path}.open")

    def add(self, doc_id: int | None, n: int, frames: list[tuple[bytes, int, int]]) -> None:
        self.documents.append((doc_id or 0, doc_id is not None, self.ids, n, len(self.entries), len(frames)))
        for packed, plain, check in frames:
            self.out.write(packed)
            self.bytes += len(packed)
            self.entries.append((len(packed), plain, check))
        self.ids += n

    def close(self) -> None:
        index = bytes([self.width]) + np.array(self.documents, dtype=DOCUMENT).tobytes()
        table = np.array(self.entries, dtype=ENTRY).tobytes() + len(self.entries).to_bytes(4, "little") + bytes([WITH_CHECKSUMS]) + SEEK_MAGIC.to_bytes(4, "little")
        for magic, body in ((INDEX_MAGIC, index + len(index).to_bytes(4, "little")), (TABLE_MAGIC, table)):
            self.out.write(magic.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
        self.out.close()
        self.fs.move(f"{self.path}.open", self.path)


class FrameReader:
    """Documents of one file; frames are read and decompressed only when their document is asked for."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._at(size - 9, 9)
        if int.from_bytes(tail[5:], "little") != SEEK_MAGIC or tail[4] != WITH_CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        n = int.from_bytes(tail[:4], "little")
        table = size - 9 - n * ENTRY.itemsize
        self.entries = np.frombuffer(self._at(table, n * ENTRY.itemsize), dtype=ENTRY)
        self.ends = np.cumsum(self.entries["packed"].astype(np.int64))
        long = int.from_bytes(self._at(table - 12, 4), "little")
        index = self._at(table - 12 - long, long)
        self.width, self.documents = index[0], np.frombuffer(index, dtype=DOCUMENT, offset=1)
        self.plain = zstandard.ZstdDecompressor()
        self.ahead, self.ahead_at = b"", 0

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def ids(self, place: int, ahead: int = 0) -> np.ndarray:
        """Ids of the document at `place` of the file. With `ahead`, that many bytes are read at once for the documents that follow."""
        d = self.documents[place]
        first, last = int(d["frame"]), int(d["frame"] + d["frames"])
        start, stop = int(self.ends[first] - self.entries["packed"][first]), int(self.ends[last - 1])
        if not (self.ahead_at <= start and stop <= self.ahead_at + len(self.ahead)):
            self.ahead, self.ahead_at = self._at(start, max(stop - start, min(ahead, int(self.ends[-1]) - start))), start
        out = []
        for k in range(first, last):
            at = int(self.ends[k] - self.entries["packed"][k]) - self.ahead_at
            body = self.plain.decompress(self.ahead[at : at + int(self.entries["packed"][k])])
            if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.entries["check"][k]:
                raise ValueError(f"frame {k} does not match its checksum")
            out.append(body)
        return np.frombuffer(b"".join(out), dtype=f"<u{self.width}")


FILES = "part int, seq int, file string, documents long, ids long, bytes long"


def _write(folder: str, width: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, writer = TaskContext.get().partitionId(), 0, None
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)

        def done() -> pa.RecordBatch:
            writer.close()
            values = (part, seq, writer.uri, len(writer.documents), writer.ids, writer.bytes)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], FILE_COLUMNS)

        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("doc_id", "n", "frames", "plain", "checks")}
                if writer is None:
                    writer = FrameWriter(f"{folder}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.zst", width)
                writer.add(row["doc_id"], row["n"], list(zip(row["frames"], row["plain"], row["checks"])))
                if writer.bytes >= file_bytes or len(writer.documents) >= FILE_DOCS:
                    yield done()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield done()

    return run


FILE_COLUMNS = [f.split()[0] for f in FILES.split(", ")]


def write_files(docs: DataFrame, vocabulary_path: str, folder: str, end: int = END_ID, file_bytes: int = FILE_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all rows to `folder`, each document followed by `end`, in ascending order of doc_id over the files.

    Returns a row per file: part and seq (their order is that of the ids), file, documents, ids, bytes. `folder` must be one that all
    machines share; `vocabulary_path` is read by the driver only. Null and empty texts have the end id alone. Ids of documents are
    integers; a null id comes first; rows that repeat an id stand side by side, by number of ids and then in no stated order if their
    texts differ. A text may be of any length. An empty table writes no file. Other columns are not read.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer

    width = id_type(Tokenizer.from_str(spec).get_vocab_size()).itemsize
    shared = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole_text(f"`{text}`").alias("text"))
    encoded = stored(map_batches(rows, _encode(shared, end), ENCODED), "encoded")
    shared.unpersist()
    order = ["doc_id", "n", "row"]
    dealt = encoded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return stored(map_batches(dealt, _write(folder, width, file_bytes), FILES), "token_files")


FOUND = "part int, seq int, place int, doc_id long, local_start long, n_tokens long"
READ_AHEAD = 4 << 20


def _read(what: str):
    """`index`: the documents of each file; `check`: with the checksum of their ids; `ids`: with the ids of the documents at `places`."""
    made = {"index": [], "check": [pa.int64()], "ids": [pa.list_(pa.int64())]}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = FrameReader(row["file"])
                places = np.array(sorted(row["places"]), dtype=np.int64) if what == "ids" else np.arange(len(reader.documents))
                for at in range(0, len(places), 1000):
                    some = places[at : at + 1000]
                    d = reader.documents[some]
                    extra = []
                    if what == "check":
                        extra = [pa.array([zlib.crc32(reader.ids(p, READ_AHEAD).astype("<u4").tobytes()) for p in some.tolist()], pa.int64())]
                    elif what == "ids":
                        extra = [pa.array([reader.ids(p).astype(np.int64) for p in some.tolist()], made[0])]
                    columns = [pa.array(np.full(len(some), row[c], np.int32)) for c in ("part", "seq")]
                    columns += [pa.array(some.astype(np.int32)), pa.array(d["doc_id"], mask=d["known"] == 0), pa.array(d["start"]), pa.array(d["n"])]
                    yield pa.RecordBatch.from_arrays([*columns, *extra], [*(c.split()[0] for c in FOUND.split(", ")), *([what] if extra else [])])

    return run


def starts(files: DataFrame) -> DataFrame:
    """`files` with file_start, the number of ids in the files before."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("file_start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _spread(files: DataFrame) -> DataFrame:
    """A file to a task, as far as there are tasks."""
    return files.repartition(max(1, min(files.count(), 10_000)))


def _placed(found: DataFrame, files: DataFrame, extra: list[str]) -> DataFrame:
    at = starts(files).select("part", "seq", "file_start")
    return found.join(F.broadcast(at), ["part", "seq"]).select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", *extra)


def read_checks(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (of the ids in 4 bytes) of every document, from the files."""
    found = map_batches(_spread(files), _read("check"), f"{FOUND}, check long").withColumnRenamed("check", "ids_crc32")
    return _placed(found, files, ["ids_crc32"])


def fetch(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents whose id is in `wanted` (doc_id); only their frames are decompressed.

    Ids that no file holds have no row; an id that several documents share has a row for each; null is an id like others.
    """
    index = map_batches(_spread(files), _read("index"), FOUND)
    names = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    hits = index.join(names, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    asked = hits.groupBy("part", "seq").agg(F.collect_list("place").alias("places"))  # at most FILE_DOCS places
    todo = files.join(asked, ["part", "seq"]).select("part", "seq", "file", "places")
    found = todo.mapInArrow(_read("ids"), f"{FOUND}, ids array<long>")
    return _placed(found, files, ["ids"])


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_files(documents(spark, sf_dir), default_vocabulary(), f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}")
    return read_checks(files)
