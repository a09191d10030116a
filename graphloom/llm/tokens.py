"""Token ids in binary shards: independent zstandard frames, a trailing seek table and a checksum for each frame.

A shard is a sequence of zstandard frames followed by the public "seekable format" table, a skippable frame
whose entries hold each frame's compressed size, decompressed size and the low 32 bits of XXH64 of its bytes.
All frames but the last hold ids (little-endian unsigned 32-bit integers) of whole documents; the last data
frame is the directory: document ids, numbers of ids, and each document's frame. A reader fetches the table,
the directory and the frames of the documents it wants, and nothing else.

Defined cases: a null text is an empty text and gets the end id alone; documents without an id come first;
repeated ids are ordered by a hash of their text; an empty table gives no shard and no row.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textops as T
from graphloom.llm.chunks import ChunkCache
from graphloom.runtime import new_folder, stored

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 1 << 18
END_ID = 0
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Exact ids of a byte-level BPE tokenizer, asking the library once for each distinct chunk.

    Pre-tokenisation never joins a non-space with a following space, so a text may be cut in front of each ASCII
    space that follows a non-space: every chunk (its spaces, then its word) has the same ids alone as in the text.
    Texts with other white space, or with the string of an added token, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.cache = ChunkCache()

    def ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))

    def solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        return self.ask([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        space = T.SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ids, sizes = self.cache.encode(data, starts, np.append(starts[1:], len(data)), self.solve)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        per = np.diff(upto)
        odd = self.wide(data, offsets)
        if len(odd):
            sizes, own = self.solve_whole(data, offsets, odd)
            parts, at = np.split(ids, upto[1:-1]), 0
            for i, size in zip(odd, sizes, strict=True):
                parts[i], at = own[at : at + size], at + size
            ids, per[odd] = np.concatenate(parts), sizes
        return ids, per

    def solve_whole(self, data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.solve(data, offsets[which], offsets[which + 1])

    def wide(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that may hold white space outside ASCII, by the first two bytes of its encodings, or hold an added token."""
        a, b = data[:-1], data[1:]
        hit = np.flatnonzero(((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))
        if self.added:
            hit = np.concatenate([hit, np.array([x.start() for x in self.added.finditer(data.tobytes())], np.int64)])
        return np.unique(np.searchsorted(offsets, hit, "right") - 1)


def encoder(path: str) -> Encoder:
    """The worker's encoder for that file; its bounded cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_shard(sink, documents: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], frame_ids: int = FRAME_IDS) -> tuple[int, int]:
    """Write batches of (document ids, missing marks, list of id arrays flattened with counts) to a binary sink."""
    squeeze, entries = zstandard.ZstdCompressor(level=1), []
    names, counts, frames, held, held_ids = [], [], [], [], 0

    def frame(raw: bytes) -> None:
        packed = squeeze.compress(raw)
        entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        sink.write(packed)

    def flush() -> None:
        nonlocal held, held_ids
        if held:
            frame(np.concatenate(held).astype("<u4").tobytes())
        held, held_ids = [], 0

    for ids_of, ids, per in documents:
        upto, begin = np.cumsum(per), 0
        while begin < len(per):
            base = upto[begin - 1] if begin else 0
            stop = min(len(per), max(begin + 1, int(np.searchsorted(upto, base + frame_ids - held_ids, "right"))))
            held.append(ids[base : upto[stop - 1]])
            held_ids += int(upto[stop - 1] - base)
            frames.append(np.full(stop - begin, len(entries), np.int64))
            begin = stop
            if held_ids >= frame_ids:
                flush()
        names.append(ids_of)
        counts.append(per)
    flush()
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    n, total = len(join(names, "<i8")), int(join(counts, "<i8").sum())
    frame(struct.pack("<Q", n) + join(names, "<i8").tobytes() + join(counts, "<i8").tobytes() + join(frames, "<i8").tobytes())
    table = b"".join(struct.pack("<III", *x) for x in entries) + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
    sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
    return n, total


class Shard:
    """Random access to a shard: any file-like object with seek and read."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, io.SEEK_END) if not hasattr(source, "size") else source.size()
        source.seek(end - 9)
        frames, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not descriptor & 0x80:
            raise ValueError("no seek table at the end of the shard")
        source.seek(end - 9 - 12 * frames)
        self.entries = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        raw = self.frame(frames - 1)
        n = struct.unpack_from("<Q", raw)[0]
        self.doc_ids, self.counts, self.frames = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
        first = np.searchsorted(self.frames, self.frames)  # frames grow along the directory
        upto = np.concatenate([[0], np.cumsum(self.counts)])
        self.inside = upto[:-1] - upto[first] if n else upto[:-1]

    def frame(self, k: int) -> bytes:
        """One frame's bytes, held against its size and checksum."""
        self.source.seek(int(self.begin[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.entries[k, 0])), max_output_size=int(self.entries[k, 1]))
        if len(raw) != self.entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return raw

    def read(self, index: int) -> np.ndarray:
        """The ids of the document at that place of the directory; only its frame is decompressed."""
        ids = np.frombuffer(self.frame(int(self.frames[index])), "<u4")
        return ids[self.inside[index] : self.inside[index] + self.counts[index]]

    def __iter__(self) -> Iterator[np.ndarray]:
        """The ids of every document in order, each frame decompressed once."""
        at, ids = -1, None
        for i in range(len(self.doc_ids)):
            if self.frames[i] != at:
                at = int(self.frames[i])
                ids = np.frombuffer(self.frame(at), "<u4")
            yield ids[self.inside[i] : self.inside[i] + self.counts[i]]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}" if not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = END_ID) -> DataFrame:
    """Encode doc_id, text and write shards in ascending order of doc_id. Returns a stored manifest: shard, path, n_docs, n_tokens."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = encoder(tokenizer)

        def encoded():
            for batch in batches:
                for part in T.slices(batch):
                    ids, per = own.encode(*T.text_bytes(part.column(1)))
                    if end_id is not None:
                        ids = np.insert(ids, np.cumsum(per), np.uint32(end_id))
                        per = per + 1
                    yield part.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), ids, per

        first = next(it := encoded(), None)
        if first is None:
            return
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        path = f"{base}/shard-{task.partitionId():07d}.ids.zst"
        with system.open_output_stream(f"{path}.{task.taskAttemptId()}", compression=None) as sink:
            n, total = write_shard(sink, (x for head in ([first], it) for x in head))
        system.move(f"{path}.{task.taskAttemptId()}", path)
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_docs": [n], "n_tokens": [total]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return stored(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens and its ids, or with digest their CRC-32."""
    from pyspark.sql import Window

    starts = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kind = "ids_crc32 long" if digest else "ids array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _place(row["path"])
                with system.open_input_file(path) as source:
                    shard = Shard(source)
                    begins = row["before"] + np.cumsum(shard.counts) - shard.counts
                    missing = shard.doc_ids == -(1 << 63)
                    documents = iter(shard)
                    for at in range(0, len(begins), 2048):
                        some = slice(at, min(len(begins), at + 2048))
                        own = [next(documents) for _ in range(some.start, some.stop)]
                        last = pa.array([zlib.crc32(np.ascontiguousarray(x).tobytes()) for x in own], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[some], pa.int64(), mask=missing[some]), pa.array(begins[some]), pa.array(shard.counts[some]), last], ["doc_id", "start", "n_tokens", kind.split()[0]])

    return starts.select("path", "before").repartition(max(1, min(manifest.count(), 1 << 14)), "path").mapInArrow(read, f"doc_id long, start long, n_tokens long, {kind}")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents' ids to shards in the shared folder, read the shards back: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = docs.sparkSession
    return read_tokens(write_tokens(docs, tokenizer, new_folder(spark, "tokens")), digest=True)
