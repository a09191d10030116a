"""Removal of repeated byte strings by a hash-compared suffix sort over sampled positions.

Every byte covered by a LENGTH-byte string that also starts anywhere else (same text included) goes.
1. Sampling without loss: of each run of LENGTH - GRAM + 1 neighbouring GRAM-byte strings the one with the least hash
   (leftmost of equals) is an anchor. Equal LENGTH-byte strings have the same anchor at the same place, so every
   repeated string is found through its anchor, and one position in some 170 is sorted.
2. Anchors are dealt by hash to fragments. An anchor that occurs once goes. Occurrences whose whole surroundings (all
   strings that can hold the anchor) are equal by a 64-bit hash of another base remove all of it, without any text moving.
3. The rest send their surroundings. In each anchor's group a mergesort orders the right and the left contexts;
   two suffixes are compared by binary search over prefix polynomial hashes for their common extension, then by one
   byte. Common extensions of neighbours are held against the bytes; after a collision the sort is redone with
   another base. Along the tree of common right extensions, each occurrence finds the longest left and right extension it
   shares with another one so that both sides and the anchor fill LENGTH bytes.
4. An anchor with more than GROUP different surroundings (a hot passage) isn't sorted in one task: its LENGTH-byte strings are
   counted by Spark as pairs of hashes instead, which finds the same bytes.

The same sort with words as symbols finds passages: runs of PASSAGE words (A-Z lower-cased) that also start anywhere else.

Strings are judged on the input, and never cross texts. Defined cases: a null text is empty; texts below LENGTH bytes
stay whole; repeated rows, with or without an id, are texts of their own; other columns are ignored; an empty table gives
no rows; a text of any length is sampled in pieces of PIECE symbols that overlap by what a string can reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import exchange as X
from graphloom.llm import textops as T
from graphloom.runtime import stored

LENGTH, GRAM = 400, 64
PASSAGE, WORD_GRAM = 51, 8
BYTES, WORDS = 0, 1
GROUP = 1 << 15
PIECE = 4 << 20
BUCKET = 1 << 12
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2545F4914F6CDD1D)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and base ** -k modulo 2 ** 64 for k below n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        make = lambda b: np.concatenate([[T.U(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)])
        _POWERS[base] = make(base), make(pow(base, -1, 1 << 64))
    return _POWERS[base]


class PrefixHash:
    """Polynomial hashes of every prefix of some bytes, hence of every substring in constant time."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = BASES[which % len(BASES)]
        up, self.down = _powers(base, len(data) + 1)
        value = lambda x: T.mix(x.astype(np.uint64) + T.U(0x1234567 * (which + 1)))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((value(np.arange(256))[data] if data.dtype == np.uint8 else value(data)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, PrefixHash]:
    """Sorted anchor positions of all texts."""
    hashes = PrefixHash(data)
    window = length - gram + 1
    n = len(data) - gram + 1
    size = np.diff(offsets)
    if n < window or not (size >= length).any():
        return np.zeros(0, np.int64), hashes
    at = np.arange(n)
    key = (T.mix(hashes.of(at, at + gram)) & T.U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    pad = -n % window
    grid = np.concatenate([key, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()[:n]
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 :])
    inside = np.zeros(len(data) + 1, np.int32)
    whole = size >= length
    inside[offsets[:-1][whole]] += 1
    np.subtract.at(inside, offsets[1:][whole] - length + 1, 1)
    valid = np.cumsum(inside)[: len(least)] > 0
    spots = (least[valid] & T.U(0xFFFFFFFF)).astype(np.int64)
    mark = np.zeros(n, bool)
    mark[spots] = True
    return np.flatnonzero(mark), hashes


def symbols(unit: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as bytes, or as 32-bit hashes of their words, and the n + 1 offsets of each."""
    if unit == BYTES:
        return data, offsets
    hashes, per = T.hashed_words(data, offsets)
    return (hashes >> T.U(32)).astype(np.uint32), per


def _sampled(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor its text, place, hash, and the hash of its surroundings; long texts piece by piece."""
    reach, out = length - gram, []
    for begin in range(0, max(1, len(data)), PIECE):
        low, high = max(0, begin - reach), min(len(data), begin + PIECE + length)
        near = np.clip(offsets, low, high) - low
        spot, hashes = anchors(data[low:high], near, length, gram)
        spot = spot[(spot + low >= begin) & (spot + low < begin + PIECE)]
        doc = np.searchsorted(offsets, spot + low, "right") - 1
        lo, hi = np.maximum(near[doc], spot - reach), np.minimum(near[doc + 1], spot + length)
        around = PrefixHash(data[low:high], 1).of(lo, hi)
        out.append((doc, spot + low - offsets[doc], T.mix(hashes.of(spot, spot + gram)), T.mix(around + ((spot - lo).astype(np.uint64) << T.U(32)) + (hi - spot).astype(np.uint64))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parts(docs: DataFrame, kinds: list[tuple[int, int, int]]) -> DataFrame:
    """A stored row for each task's part and kind (unit, length, gram): documents, their anchors, and the distinct (anchor, surroundings) hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {unit: [] for unit, *_ in kinds}
        size, number, before = 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size, before
            src = (TaskContext.get().partitionId() << 24) | number
            for unit, rows in held.items():
                ids, missing, text_hash, doc, pos, gram_hash, around = (np.concatenate(x) for x in zip(*rows, strict=True))
                order = np.lexsort((around, gram_hash))
                gram_hash, around = gram_hash[order], around[order]
                new = np.append(True, (gram_hash[1:] != gram_hash[:-1]) | (around[1:] != around[:-1])) if len(order) else np.zeros(0, bool)
                times = np.diff(np.append(np.flatnonzero(new), len(order)))
                rows.clear()
                yield pa.RecordBatch.from_pydict({"unit": [unit], "src": [src], "n_keys": [int(new.sum())], "ids": [X.pack(ids)], "missing": [X.pack(missing)], "hashes": [X.pack(text_hash)], "doc": [X.pack(doc[order].astype(np.uint32))], "pos": [X.pack(pos[order])], "times": [X.pack(times.astype(np.uint32))], "keys": [gram_hash[new].tobytes()], "around": [around[new].tobytes()]})
            number, size, before = number + 1, 0, 0

        for batch in batches:
            for part in T.slices(batch, most=1 << 20, rows=1 << 12):
                names = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(part.column(0).is_null()), part.column(2).to_numpy(zero_copy_only=False)
                texts = T.text_bytes(part.column(1))
                for unit, length, gram in kinds:
                    doc, pos, own, around = _sampled(*symbols(unit, *texts), length, gram)
                    held[unit].append((*names, doc + before, pos, own, around))
                    size += len(pos)
                before += part.num_rows
                size += part.num_rows
                if size >= 1 << 19:
                    yield from flush()
                    T.release()
        if before:
            yield from flush()
        T.release()

    blobs = "unit long, src long, n_keys long, " + ", ".join(f"{c} binary" for c in ("ids", "missing", "hashes", "doc", "pos", "times", "keys", "around"))
    return stored(docs.mapInArrow(run, blobs), "suffix-parts")


def _judge(parts: DataFrame, group: int) -> DataFrame:
    """For each part and fragment a code for each of its distinct keys: 0 alone; 1 whole surroundings repeat; 2 to be compared; 3 both, for one of the equal ones; +4 in a hot group."""
    bits = X.fragment_bits(parts.agg(F.sum("n_keys")).first()[0] or 0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, src, keys, around, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, around, times = np.frombuffer(keys, np.uint64), np.frombuffer(around, np.uint64), X.unpack(times, np.uint32)
                at = X.cuts(keys, bits)
                some = np.flatnonzero(np.diff(at))
                cut = lambda x: pa.array([x[at[f] : at[f + 1]].tobytes() for f in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), unit)), pa.array(some, pa.int64()), pa.array(np.full(len(some), src)), cut(keys), cut(around), cut(times)], ["unit", "frag", "src", "keys", "around", "times"])

    def code(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        parts_ = read("keys", np.uint64)
        keys, around, times = (np.concatenate(x) for x in (parts_, read("around", np.uint64), read("times", np.uint32)))
        order = np.lexsort((around, keys))
        k, a = keys[order], around[order]
        new_key = np.append(True, k[1:] != k[:-1])
        new = new_key | np.append(True, a[1:] != a[:-1])
        pair, anchor = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        total = np.bincount(pair, weights=times[order])[pair]
        kinds = np.bincount(anchor[new])[anchor]
        out = np.where(total > 1, 1, 0) + np.where((kinds > 1) & ((total == 1) | new), 2, 0) + np.where((kinds > group), 4, 0)
        back = np.zeros(len(order), np.uint8)
        back[order] = out
        return pa.Table.from_arrays([table.column("unit"), table.column("src"), table.column("frag"), pa.array([x.tobytes() for x in np.split(back, np.cumsum([len(p) for p in parts_])[:-1])], pa.binary())], ["unit", "src", "frag", "codes"])

    dealt = parts.select("unit", "src", "keys", "around", "times").mapInArrow(split, "unit long, frag long, src long, keys binary, around binary, times binary")
    return dealt.groupBy("unit", "frag").applyInArrow(code, "unit long, src long, frag long, codes binary")


def _assemble(table: pa.Table) -> pa.Table:
    """A row for each document with repeats: places of anchors whose surroundings repeat whole, and of those to compare."""
    rows = table.to_pylist()
    part = next(r for r in rows if r["frag"] < 0)
    codes = np.frombuffer(b"".join(r["codes"] for r in sorted((r for r in rows if r["frag"] >= 0), key=lambda r: r["frag"])), np.uint8)
    ids, missing, hashes, doc, pos, times = (X.unpack(part[c], k) for c, k in (("ids", np.int64), ("missing", np.bool_), ("hashes", np.int64), ("doc", np.uint32), ("pos", np.int64), ("times", np.uint32)))
    first = np.cumsum(times, dtype=np.int64) - times
    code = np.repeat(codes, times)
    lead = np.zeros(len(code), bool)
    lead[first] = True
    code = np.where((code & 1) & ~lead, code & ~np.uint8(2), code)  # one of equal ones is enough to compare
    keep = np.flatnonzero(code & 3)
    keep = keep[np.argsort(doc[keep], kind="stable")]
    doc, pos, code = doc[keep].astype(np.int64), pos[keep], code[keep]
    which, at = np.unique(doc, return_index=True)
    ends = np.append(at[1:], len(doc))
    blob = [X.pack(np.stack([pos[a:b], code[a:b]]).astype(np.int64).ravel()) for a, b in zip(at, ends, strict=True)]
    compare = np.logical_or.reduceat((code & 2) > 0, at) if len(at) else np.zeros(0, bool)
    return pa.Table.from_arrays([pa.array([part["unit"]] * len(which), pa.int64()), pa.array(ids[which], mask=missing[which]), pa.array(hashes[which]), pa.array(blob, pa.binary()), pa.array(compare)], ["unit", "doc_id", "text_hash", "places", "compare"])


def lcp(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """Length of the common extension from places a and b, to the right or (back) to the left, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = hashes.of(a - mid, a) == hashes.of(b - mid, b) if back else hashes.of(a, a + mid) == hashes.of(b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_order(data: np.ndarray, hashes: PrefixHash, place: np.ndarray, room: np.ndarray, group: np.ndarray, back: bool) -> np.ndarray:
    """Mergesort of the contexts of each group (group numbers ascend): at every width all elements search their rank in the neighbouring run together."""
    n = len(place)
    start = np.searchsorted(group, group)
    size = np.searchsorted(group, group, "right") - start
    order = np.arange(n)
    local = np.arange(n) - start
    width, widest = 1, int(size.max(initial=0))

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether y's context comes before x's (ties: or is equal)."""
        most = np.minimum(room[x], room[y])
        common = lcp(hashes, place[x], place[y], most, back)
        ended = common >= most
        step = common + 1 if back else -common
        cx, cy = data[np.clip(place[x] - step, 0, len(data) - 1)], data[np.clip(place[y] - step, 0, len(data) - 1)]
        return np.where(ended, np.where(room[x] == room[y], ties, room[y] < room[x]), cy < cx)

    while width < widest:
        live = np.flatnonzero(size > width)
        run = local[live] // width
        lo = np.minimum((run ^ 1) * width, size[live])
        hi = np.minimum(lo + width, size[live])
        first = lo.copy()
        ties = (run & 1) == 1  # equals keep their order: those of the left run come first
        while (open_ := lo < hi).any():
            k = np.flatnonzero(open_)
            mid = (lo[k] + hi[k]) // 2
            less = before(order[live[k]], order[start[live[k]] + mid], ties[k])
            lo[k] = np.where(less, mid + 1, lo[k])
            hi[k] = np.where(less, hi[k], mid)
        rank = (run & ~1) * width + local[live] % width + lo - first
        moved = order.copy()
        moved[start[live] + rank] = order[live]
        order = moved
        width *= 2
    return order


def extend(data: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, gram: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence (of gram symbols) the longest left and right extension shared with another of its group so that both sum to need; -1 where none does."""
    n = len(place)
    for which in range(len(BASES)):
        hashes = PrefixHash(data, which)
        end = place + gram
        sides = []
        for spot, room, back in ((end, right, False), (place, left, True)):
            order = suffix_order(data, hashes, spot, room, group, back)
            a, b = order[:-1], order[1:]
            near = group[a] == group[b]
            common = np.zeros(max(0, n - 1), np.int64)
            common[near] = lcp(hashes, spot[a[near]], spot[b[near]], np.minimum(room[a[near]], room[b[near]]), back)
            sides.append((order, common, near))
        if all(_verified(data, s, r, *x, back) for s, r, x, back in ((end, right, sides[0], False), (place, left, sides[1], True))):
            break
    else:
        raise RuntimeError("hash collisions under every base")
    (order, common, near), (left_order, left_common, _) = sides
    best_left, best_right = np.full(n, -1), np.full(n, -1)
    rank = np.empty(n, np.int64)
    rank[left_order] = np.arange(n)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    pairs = first[size == 2]
    if len(pairs):
        ok = common[pairs] + left_common[pairs] >= need[pairs]
        for side, value in ((best_right, common), (best_left, left_common)):
            for k in (0, 1):
                side[pairs[ok] + k] = value[pairs[ok]]
    for begin, count in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        steps = common[begin : begin + count - 1]
        nodes: list[tuple[int, int, int]] = []
        stack: list[list[int]] = []  # [depth, first]
        for k in range(count):
            depth = int(steps[k]) if k < count - 1 else -1
            since = k
            while stack and stack[-1][0] > depth:
                top, since = stack.pop()
                nodes.append((top, since, k))
            if depth >= 0 and (not stack or stack[-1][0] < depth):
                stack.append([depth, since])
        for depth, a, b in nodes:  # deepest of nested ones first: members order[begin + a .. begin + b]
            own = np.sort(rank[order[begin + a : begin + b + 1]])
            gaps = np.minimum.reduceat(left_common[: own[-1]], own[:-1])
            shared = np.maximum(np.append(gaps, -1), np.insert(gaps, 0, -1))
            ok = shared + depth >= need[begin]
            who = left_order[own[ok]]
            best_left[who] = np.maximum(best_left[who], shared[ok])
            best_right[who] = np.maximum(best_right[who], depth)
    return best_left, best_right


def _verified(data: np.ndarray, spot: np.ndarray, room: np.ndarray, order: np.ndarray, common: np.ndarray, near: np.ndarray, back: bool) -> bool:
    """Whether the neighbours' common extensions hold byte by byte."""
    which = np.flatnonzero(near & (common > 0))
    for k in range(0, len(which), 4096):
        some = which[k : k + 4096]
        inside = T.ranges(np.zeros(len(some), np.int64), common[some])
        shift = np.repeat(np.arange(len(some)), common[some])
        a, b = spot[order[some]][shift], spot[order[some + 1]][shift]
        if not np.array_equal(data[a - 1 - inside] if back else data[a + inside], data[b - 1 - inside] if back else data[b + inside]):
            return False
    return True


KEYS = ["id_key", "no_id", "text_hash"]
OCCURRENCE = "unit long, anchor long, id_key long, no_id boolean, text_hash long, pos long, size long, need long, left long, around binary"


def _windows(hot: DataFrame) -> DataFrame:
    """Every whole string around each hot occurrence, as two hashes of different bases, once for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data, length = np.frombuffer(r["around"], np.uint8 if r["unit"] == BYTES else np.uint32), r["size"] + r["need"]
                at = np.arange(max(0, len(data) - length + 1))
                first, second = (T.mix(PrefixHash(data, k).of(at, at + length)).view(np.int64) for k in (0, 1))
                full = lambda x: pa.array([x] * len(at))  # noqa: B023, E731
                start = at + r["pos"] - r["left"]
                yield pa.RecordBatch.from_arrays([full(r["unit"]), pa.array(first), pa.array(second), *(full(r[k]) for k in KEYS), pa.array(start), pa.array(start + length)], ["unit", "first", "second", *KEYS, "start", "end"])

    return hot.mapInArrow(run, "unit long, first long, second long, id_key long, no_id boolean, text_hash long, start long, end long").distinct()


def _compare(table: pa.Table) -> pa.Table:
    """What the occurrences of one bucket's anchors, all in one unit, share with another one: ranges of symbols."""
    table = table.sort_by([("anchor", "ascending"), *((k, "ascending") for k in KEYS), ("pos", "ascending")]).combine_chunks()
    unit = table.column("unit")[0].as_py()
    kind = np.dtype(np.uint8 if unit == BYTES else np.uint32)
    around = table.column("around").to_pylist()
    data = np.frombuffer(b"".join(around), kind)
    sizes = np.array([len(x) for x in around], np.int64) // kind.itemsize
    del around
    left, size, need, pos, anchor = (table.column(c).to_numpy() for c in ("left", "size", "need", "pos", "anchor"))
    place = np.cumsum(sizes) - sizes + left
    number = np.cumsum(np.append(False, anchor[1:] != anchor[:-1]))
    best_left, best_right = extend(data, place, left, sizes - left - size, number, size, need)
    ok = best_left >= 0
    out = pa.Table.from_arrays([table.column("unit").filter(pa.array(ok)), *(table.column(k).filter(pa.array(ok)) for k in KEYS), pa.array((pos - best_left)[ok]), pa.array((pos + size + best_right)[ok])], ["unit", *KEYS, "start", "end"])
    T.release()
    return out


def _shared_spans(sent: DataFrame) -> DataFrame:
    """Spans of symbols that occurrences share: sorted in buckets of whole anchors, those of hot anchors by counting strings."""
    rows, hot = sent.agg(F.count("*"), F.max("hot")).first()
    spread = F.pmod(F.xxhash64("anchor"), F.lit(max(1, rows // BUCKET)))
    found = sent.where("not hot").drop("hot").withColumn("bucket", spread).groupBy("unit", "bucket").applyInArrow(_compare, "unit long, id_key long, no_id boolean, text_hash long, start long, end long")
    if not hot:
        return found
    every = _windows(sent.where("hot"))
    twice = every.groupBy("unit", "first", "second").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    return found.union(every.join(twice, ["unit", "first", "second"]).select("unit", *KEYS, "start", "end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, passage: int = 0) -> DataFrame:
    """doc_id, text, and of what repeats (bytes, and runs of that many words if passage isn't 0): the packed places of anchors whose whole surroundings do, and spans of symbols with their unit; null where nothing repeats."""
    kinds = [(BYTES, length, gram)] + ([(WORDS, passage, min(passage, WORD_GRAM))] if passage else [])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    parts = _parts(texts, kinds)
    info = parts.select("unit", "src", F.lit(-1).cast("long").alias("frag"), F.lit(None).cast("binary").alias("codes"), "ids", "missing", "hashes", "doc", "pos", "times")
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "missing", "hashes", "doc", "pos", "times")]
    judged = info.union(_judge(parts, group).select("unit", "src", "frag", "codes", *none)).groupBy("unit", "src").applyInArrow(_assemble, "unit long, doc_id long, text_hash long, places binary, compare boolean")
    # rows with the same id and text have the same places
    of = lambda unit: F.collect_set(F.when(F.col("unit") == unit, F.col("places")))
    places = stored(judged.groupBy("doc_id", "text_hash").agg(of(BYTES).alias("places"), of(WORDS).alias("word_places"), F.max("compare").alias("compare")), "suffix-places")
    key = (F.coalesce(F.col("doc_id"), F.lit(0)).alias("id_key"), F.col("doc_id").isNull().alias("no_id"), "text_hash")
    held = texts.select(*key, "doc_id", "text")
    wanted = places.select(*key, "places", "word_places", "compare")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_key, no_id, text_hash, text, *blobs in zip(*(batch.column(k) for k in range(6)), strict=True):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                for unit, whole, core in kinds:
                    if not blobs[unit].as_py():
                        continue
                    pos, code = _places(blobs[unit].as_py())
                    chosen = np.flatnonzero(code & 2)
                    if not len(chosen):
                        continue
                    pos, code = pos[chosen], code[chosen]
                    data, _ = symbols(unit, raw, np.array([0, len(raw)]))
                    anchor = T.mix(PrefixHash(data).of(pos, pos + core)).view(np.int64)
                    lo, hi = np.maximum(0, pos - (whole - core)), np.minimum(len(data), pos + whole)
                    n = len(pos)
                    full = lambda x: pa.array(np.full(n, x))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([full(unit), pa.array(anchor), full(id_key.as_py()), full(no_id.as_py()), full(text_hash.as_py()), pa.array(pos), full(core), full(whole - core), pa.array(pos - lo), pa.array([data[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()), pa.array((code & 4) > 0)], [*(c.split()[0] for c in OCCURRENCE.split(", ")), "hot"])

    sent = stored(held.join(wanted.where("compare"), KEYS).select(*KEYS, "text", "places", "word_places").mapInArrow(contexts, OCCURRENCE + ", hot boolean"), "suffix-contexts")
    found = _shared_spans(sent).groupBy(*KEYS).agg(F.collect_list(F.struct("unit", "start", "end")).alias("spans"))
    return held.join(wanted.drop("compare"), KEYS, "left").join(found, KEYS, "left").select("doc_id", "text", "places", "word_places", "spans")


def _places(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [X.unpack(b, np.int64).reshape(2, -1) for b in blobs]
    return np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])


def removed(n: int, places: list[bytes] | None, spans: list[dict] | None, length: int = LENGTH, gram: int = GRAM, unit: int = BYTES) -> np.ndarray:
    """Marks of the symbols of a text that repeat."""
    change = np.zeros(n + 1, np.int32)
    if places:
        pos, code = _places(places)
        pos = np.unique(pos[(code & 1) > 0])
        np.add.at(change, np.maximum(0, pos - (length - gram)), 1)
        np.add.at(change, np.minimum(n, pos + length), -1)
    for span in spans or []:
        if span["unit"] == unit:
            change[span["start"]] += 1
            change[span["end"]] -= 1
    return np.cumsum(change)[:-1] > 0


def repeat_digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_passage_words: how many words lie in runs of that many words that also start anywhere else."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places, word_places, spans in zip(*(batch.column(k) for k in range(1, 5)), strict=True):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                gone = removed(len(raw), places.as_py(), spans.as_py(), length, gram)
                begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                words = 0
                if word_places.as_py():
                    n = len(T.words(raw, np.array([0, len(raw)]))[0])
                    words = int(removed(n, word_places.as_py(), spans.as_py(), passage, min(passage, WORD_GRAM), WORDS).sum())
                out.append((len(raw), int(gone.sum()), begins, hashlib.sha256(raw[~gone].tobytes()).hexdigest(), words))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    return repeated_spans(docs, length, gram, group, passage).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id and the text that is left; bytes of a character cut in two are dropped."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, places, spans in zip(*(batch.column(k) for k in (1, 2, 4)), strict=True):
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                texts.append(raw[~removed(len(raw), places.as_py(), spans.as_py(), length, gram)].tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return repeated_spans(docs, length, gram, group).mapInArrow(cut, "doc_id long, text string")
