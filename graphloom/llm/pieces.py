"""SentencePiece encoding and decoding by batched search in numpy.

A text is cut wherever two neighbouring bytes occur side by side in no piece; the best pieces of the text are then the
best pieces of its chunks in a row. Distinct chunks of equal length form a matrix and advance together.
Unigram models: Viterbi. For each end position, hashes of all substrings that could end there probe the sorted hashes of the
pieces, and a maximum over the starts stores the score and the backpointer; ties go to the longest last piece. A character
that no piece covers gets its byte pieces, at the library's penalty below the least score.
BPE models: the sum of scores isn't what such a model was made for (its scores are the order of merges), and the path that
maximises it isn't the library's. There every row merges, step by step, the neighbouring symbols whose joined
substring's hash probes the best piece, the leftmost of equals, until none is left; both give the library's ids.

The model's own rules are kept: a space becomes U+2581, and a text that isn't empty gets one in front. A model with a
normaliser other than identity, or of another type, is refused. decode() gives the text back (with U+2581 as space), so a round trip is exact unless the text holds U+2581.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded alike; other
columns of the input are kept as they are, and ids replaces a column of that name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from graphloom.llm import textops as T
from graphloom.llm.chunks import ChunkCache

MARK = "▁"
_MODELS: dict[str, "Pieces"] = {}
CELLS = 1 << 20
BASE = 0x5851F42D4C957F2D
UNKNOWN = np.uint32(0xFFFFFFFF)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte, at = raw[at], at + 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


def model_type(raw: bytes) -> int:
    """1 unigram, 2 BPE, 3 word, 4 character: the field of that name in a model's training settings."""
    spec = next((v for k, v in _fields(raw) if k == 2), b"")
    return next((v for k, v in _fields(spec) if k == 3), 1)


class Pieces:
    """The vocabulary of a model file as arrays; the space mark is kept as one byte, 0x20."""

    def __init__(self, path: str | bytes, viterbi: bool = False):
        """viterbi: the path with the best sum of scores also for a BPE model."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=path) if isinstance(path, bytes) else SentencePieceProcessor(model_file=path)
        kind = model_type(model.serialized_model_proto())
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are read")
        self.search = self.viterbi if kind == 1 or viterbi else self.merges
        if model.normalize("ﬁ  Å") not in (f"{MARK}ﬁ{MARK}{MARK}Å",):
            raise ValueError("only models with the identity normaliser, a dummy prefix and byte pieces are read")
        raw, score, ids, self.byte_ids = [], [], [], np.zeros(256, np.uint32)
        table = [b""] * model.vocab_size()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                table[i] = bytes([int(piece[1:-1], 16)])
            elif not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i):
                table[i] = piece.replace(MARK, " ").encode()
                raw.append(table[i])
                score.append(model.get_score(i))
                ids.append(i)
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.table_sizes = np.array([len(x) for x in table], np.int64)
        self.table_starts = np.cumsum(self.table_sizes) - self.table_sizes
        self.longest = max(map(len, raw))
        self.penalty = min(score) - 10.0
        #: by id: a piece's score; the first byte of a character that is no piece has the character's
        self.worth = np.zeros(len(table))
        self.worth[ids] = score
        self.worth[self.byte_ids[(np.arange(256) & 0xC0) != 0x80]] = self.penalty
        self.joined = np.zeros((256, 256), bool)
        for x in raw:
            for a, b in zip(x[:-1], x[1:], strict=True):
                self.joined[a, b] = True
        self._reach(4096)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(x) for x in raw])
        starts = np.cumsum(sizes) - sizes
        keys = np.zeros(len(raw), np.uint64)
        for k in range(self.longest):  # sum of (byte + 1) * r^(k + 1)
            own = sizes > k
            keys[own] += (data[starts[own] + k].astype(np.uint64) + T.U(1)) * self.powers[k]
        keys = T.mix(keys)
        order = np.argsort(keys)
        if (np.diff(keys[order].astype(np.float64)) == 0).any() and len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.keys, self.scores, self.ids = keys[order], np.array(score)[order], np.array(ids, np.uint32)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> T.U(42)).astype(np.int64)] = True
        self.cache = ChunkCache()

    def _reach(self, size: int) -> None:
        """Powers of the hash's base from 1, and of its inverse from 0."""
        self.powers = np.cumprod(np.full(size, BASE, np.uint64), dtype=np.uint64)
        self.inverse = np.concatenate([[T.U(1)], np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)])

    def solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of distinct chunks: the number of ids of each, and all ids."""
        length = ends - starts
        if length.max(initial=0) > len(self.powers):
            self._reach(2 * int(length.max()))
        order = np.argsort(length, kind="stable")
        bounds = np.flatnonzero(np.append(True, np.diff(length[order]) > 0))
        sizes = np.zeros(len(starts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True):
            size = int(length[order[a]])
            step = max(1, CELLS // size)
            for c in range(a, b, step):
                rows = order[c : min(b, c + step)]
                counts, ids = self.search(data[starts[rows][:, None] + np.arange(size)])
                sizes[rows] = counts
                done.append((rows, ids))
        upto = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        for rows, ids in done:
            out[T.ranges(upto[rows], sizes[rows])] = ids
        return sizes, out

    def merges(self, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equal length advance together, a merge at a time. Returns the number of ids of each row, and the ids row by row."""
        n, size = chunk.shape
        upto = np.zeros((n, size + 1), np.uint64)
        np.cumsum((chunk.astype(np.uint64) + T.U(1)) * self.powers[:size], axis=1, out=upto[:, 1:])

        def find(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Place of the piece that covers each substring, and whether there is one."""
            keys = T.mix((upto[row, hi] - upto[row, lo]) * self.inverse[lo])
            at, real = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
            some = np.flatnonzero((hi - lo <= self.longest) & self.maybe[(keys >> T.U(42)).astype(np.int64)])
            at[some] = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            real[some] = self.keys[at[some]] == keys[some]
            return at, real

        # after[i] and ahead[i]: where the symbol that begins at i ends, and where the one before it begins; worth[i]: of merging it with the next
        head = (chunk & 0xC0) != 0x80
        head[:, 0] = True
        row, lo = np.nonzero(head)
        new = np.append(row[1:] != row[:-1], True)
        after, ahead = np.zeros((n, size), np.int64), np.full((n, size + 1), -1)
        after[row, lo] = np.where(new, size, np.append(lo[1:], size))
        ahead[row, after[row, lo]] = lo
        worth = np.full((n, size), -np.inf)

        def judge(row: np.ndarray, lo: np.ndarray) -> None:
            mid = after[row, lo]
            worth[row, lo] = -np.inf
            row, lo, mid = row[mid < size], lo[mid < size], mid[mid < size]
            at, real = find(row, lo, after[row, mid])
            worth[row[real], lo[real]] = self.scores[at[real]]

        judge(row, lo)
        live = np.arange(n)
        while len(live):
            best = worth[live].argmax(1)
            ok = worth[live, best] > -np.inf
            live, best = live[ok], best[ok]
            if not len(live):
                break
            mid = after[live, best]
            end = after[live, mid]
            after[live, best], head[live, mid], worth[live, mid] = end, False, -np.inf
            ahead[live, end] = best
            judge(live, best)
            left = ahead[live, best]
            some = left >= 0
            judge(live[some], left[some])
        row, lo = np.nonzero(head)
        hi = after[row, lo]
        at, real = find(row, lo, hi)
        length = np.where(real, 1, hi - lo)  # a symbol that is no piece is a character: its bytes
        where = T.ranges(np.zeros(len(row), np.int64), length)
        spread = np.repeat(np.arange(len(row)), length)
        ids = np.where(real[spread], self.ids[at[spread]], self.byte_ids[chunk[row[spread], lo[spread] + np.where(real[spread], 0, where)]])
        return np.bincount(row, weights=length, minlength=n).astype(np.int64), ids.astype(np.uint32)

    def viterbi(self, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equal length advance together. Returns the number of ids of each row, and the ids row by row."""
        n, size = chunk.shape
        code = (chunk.astype(np.uint64) + T.U(1)).T.copy()
        head = np.concatenate([(chunk & 0xC0) != 0x80, np.ones((n, 1), bool)], axis=1)
        head[:, 0] = True
        begin = np.maximum.accumulate(np.where(head, np.arange(size + 1), 0), axis=1)  # of the character at each place
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((size + 1, n), np.int32)
        piece = np.zeros((size + 1, n), np.uint32)
        # own[s]: hash of the bytes from start s to the current end
        own = np.zeros((min(size, self.longest), n), np.uint64)
        for end in range(1, size + 1):
            low = max(0, end - self.longest)
            slots = np.arange(low, end) % len(own)
            own[(end - 1) % len(own)] = 0
            own[slots] += code[end - 1][None, :] * self.powers[end - 1 - np.arange(low, end)][:, None]
            keys = T.mix(own[slots])
            own_begin = begin[:, end - 1]
            best[end] = np.where(head[:, end], best[own_begin, np.arange(n)] + self.penalty, -np.inf)
            back[end] = own_begin
            piece[end] = UNKNOWN
            at, row = np.nonzero(self.maybe[(keys >> T.U(42)).astype(np.int64)])
            if len(at):
                probe = keys[at, row]
                found = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
                real = self.keys[found] == probe
                at, row, found = at[real], row[real], found[real]
                total = np.full((end - low, n), -np.inf)
                total[at, row] = best[low + at, row] + self.scores[found]
                which = np.full((end - low, n), 0, np.uint32)
                which[at, row] = self.ids[found]
                start = total.argmax(0)
                top = total[start, np.arange(n)]
                better = (top >= best[end]) & (top > -np.inf)
                best[end, better] = top[better]
                back[end, better] = low + start[better]
                piece[end, better] = which[start, np.arange(n)][better]
        at, found = np.full(n, size), []
        alive = np.arange(n)
        while len(alive):
            stop = at[alive]
            at[alive] = back[stop, alive]
            found.append((alive, piece[stop, alive], at[alive], stop))
            alive = alive[at[alive] > 0]
        rows, ids, low, high = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
        order = np.argsort(rows, kind="stable")
        rows, ids, low, high = rows[order], ids[order], low[order], high[order]
        length = np.where(ids == UNKNOWN, high - low, 1)  # a character that is no piece: its bytes
        spread = np.repeat(np.arange(len(rows)), length)
        where = low[spread] + T.ranges(np.zeros(len(rows), np.int64), length)
        ids = np.where(ids[spread] == UNKNOWN, self.byte_ids[chunk[rows[spread], np.minimum(where, size - 1)]], ids[spread])
        return np.bincount(rows, weights=length, minlength=n).astype(np.int64), ids.astype(np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        data, offsets = self.normal(data, offsets)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]]
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ids, sizes = self.cache.encode(data, starts, np.append(starts[1:], len(data)), self.solve)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)])

    @staticmethod
    def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """U+2581 as a space, and a space in front of each text that isn't empty."""
        a = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        if len(a):
            keep = np.ones(len(data), bool)
            keep[a + 1] = keep[a + 2] = False
            data = data.copy()
            data[a] = 32
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            data = data[keep]
        full = np.diff(offsets) > 0
        return np.insert(data, offsets[:-1][full], np.uint8(32)), offsets + np.concatenate([[0], np.cumsum(full)])

    def decode(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts one after another, and their n + 1 offsets."""
        sizes = self.table_sizes[ids]
        data = self.table[T.ranges(self.table_starts[ids], sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per)])]
        full = np.flatnonzero(np.diff(offsets) > 0)
        lead = offsets[full][data[offsets[full]] == 32]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def pieces(path: str, viterbi: bool = False) -> Pieces:
    """The worker's model for that file."""
    key = f"{path}\n{viterbi}"
    if key not in _MODELS:
        _MODELS[key] = Pieces(path, viterbi)
    return _MODELS[key]


def encode_texts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """All columns of docs, with ids array<int>: the pieces of the whole text."""
    plain = docs.drop("ids")
    schema = S.StructType([*plain.schema.fields, S.StructField("ids", S.ArrayType(S.IntegerType(), False))])
    plain = plain.withColumn(text, F.col(text).cast("string")) if plain.schema[text].dataType != S.StringType() else plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for part in T.slices(batch, text):
                ids, per = own.encode(*T.text_bytes(part.column(part.schema.get_field_index(text))))
                upto = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(upto), pa.array(ids.astype(np.int32)))], [*part.schema.names, "ids"])
        T.release()

    return plain.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """All columns of rows, with text replaced by what the ids decode to; null ids give an empty text."""
    plain = rows.drop("text").withColumn(ids, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")))
    schema = S.StructType([*plain.schema.fields, S.StructField("text", S.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            per = np.diff(np.asarray(column.offsets, dtype=np.int64))
            data, offsets = own.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), per)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())], [*batch.schema.names, "text"])

    return plain.mapInArrow(run, schema)


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip (whether decoding gives the text back) of the library's encoding;
    and of the Viterbi path, which for a BPE model is another one: n_viterbi, viterbi_crc32, viterbi_trip and viterbi_score, the sum of its scores."""

    def crcs(ids: np.ndarray, upto: np.ndarray) -> pa.Array:
        flat = ids.astype("<u4").tobytes()
        return pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = pieces(model), pieces(model, viterbi=True)
        for batch in batches:
            for part in T.slices(batch):
                data, offsets = T.text_bytes(part.column(1))
                raw, columns = data.tobytes(), [part.column(0)]
                for m in (own, best):
                    ids, per = m.encode(data, offsets)
                    upto = np.concatenate([[0], np.cumsum(per)])
                    back, ends = m.decode(ids.astype(np.int64), per)
                    got = back.tobytes()
                    same = [raw[a:b].replace(MARK.encode(), b" ") == got[c:d] for a, b, c, d in zip(offsets[:-1], offsets[1:], ends[:-1], ends[1:], strict=True)]
                    columns += [pa.array(per), crcs(ids, upto), pa.array(same, pa.bool_())]
                worth = best.worth[ids.astype(np.int64)].tolist()
                columns.append(pa.array([round(math.fsum(worth[a:b]), 6) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "round_trip", "n_viterbi", "viterbi_crc32", "viterbi_trip", "viterbi_score"])
        T.release()

    kinds = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, n_viterbi long, viterbi_crc32 long, viterbi_trip boolean, viterbi_score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)
