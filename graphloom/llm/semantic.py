"""Benchmark decontamination by latent semantic retrieval, confirmed by word alignment and an answer check.

1. Passages of PASSAGE words of all texts are rows of a TF-IDF matrix A over hashed words (idf squared). Its leading right
   singular vectors come from a distributed randomised SVD: one pass gathers document frequencies and the sketch A'G, G
   being sparse random signs for each passage and RANK + OVER columns; Q is an orthonormal basis of it. A second pass
   projects every passage on Q and sums the Gram matrix of AQ, whose eigenvectors and values give RANK singular vectors and
   values of AQ. Vectors are divided by their singular values, so that no subject or language outweighs the rest.
2. A third pass projects every word of every text once. Windows of WIDTHS words begin at every STEP words (a quarter of the
   width for wide ones); an item is compared with those of the least width that holds it. Windows whose cosine with the
   item reaches COSINE are candidates, and so, exactly, is every place that shares RUN words in a row with the item
   (all of a shorter item). Candidates whose surroundings can't hold COVER of the item's words, each as often as in both, go.
3. A candidate and its surroundings are aligned with the item: the longest common subsequence of words must hold COVER of
   the item's words, and that of the answer (the item's last sentence, at least ANSWER words) half of its words. So
   paraphrases with replaced, added or dropped words are found, and texts that only share a subject are not.

Benchmark items are broadcast in blocks of about ITEMS and ITEM_BYTES at most; a longer item is a block of its own.
Long texts are searched in overlapping pieces of PIECE words. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased and
trailing punctuation dropped.

Defined cases: null, empty and one-word items match nothing; repeated items are matched each; null and empty texts are
clean; repeated rows are judged alike; documents without an id are judged too; an empty table on either side gives no
matches; other columns are ignored by matches() and kept by keep_clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as T

PASSAGE, STEP, FEATURES, RANK, OVER, SIGNS = 64, 4, 1 << 15, 96, 16, 4
WIDTHS, REACH, RUN, FILTER = (8, 12, 16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256), 32, 5, 20
COSINE, COVER, ANSWER, ITEMS, ITEM_BYTES = 0.5, 0.7, 5, 4096, 8 << 20
ROWS, PIECE, CELLS, BLOCK = 1 << 11, 1 << 18, 1 << 22, 1 << 17
TRAIL = np.zeros(256, bool)
TRAIL[[ord(c) for c in ".,;:!?\"')"]] = True


def item_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words without trailing punctuation, the offsets of each text's words, and which words end a sentence."""
    low = T.LOWER[data]
    starts, ends, per = T.words(low, offsets)
    closes = TRAIL[low[ends - 1]] & np.isin(low[ends - 1], [33, 46, 63]) if len(ends) else np.zeros(0, bool)
    trimmed = ends.copy()
    while True:
        cut = (trimmed - 1 > starts) & TRAIL[low[np.maximum(trimmed - 1, 0)]] if len(ends) else np.zeros(0, bool)
        if not cut.any():
            break
        trimmed[cut] -= 1
    return T.hash_spans(low, starts, trimmed), per, closes


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> T.U(40)).astype(np.int64) % FEATURES


def _passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of all words, the passage each stands in, and the number of passages."""
    hashes, per, _ = item_words(*T.text_bytes(column))
    count = np.diff(per)
    parts = -(-count // PASSAGE)
    owner = np.repeat(np.cumsum(parts) - parts, count) + (np.arange(len(hashes)) - np.repeat(per[:-1], count)) // PASSAGE
    return _feature(hashes).astype(np.int32), owner, int(parts.sum())


def _few(docs: DataFrame) -> DataFrame:
    """The texts in as many tasks as there are cores twice over, or fewer: each sends sums of a fixed size, so they mustn't grow with the data."""
    return docs.select(F.col("text").cast("string")).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)


def _sketch(docs: DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Document frequency of each feature, the sketch (features x columns) without idf, and the number of passages."""

    few = _few(docs)
    fan = int(np.ceil(np.sqrt(2 * docs.sparkSession.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, passages = np.zeros(FEATURES * columns), np.zeros(FEATURES, np.int64), 0
        task = TaskContext.get().partitionId()
        r = np.random.default_rng([17, task])
        for batch in batches:
            for part in T.slices(batch, most=8 << 20):
                feature, owner, n = _passages(part.column(0))
                if not n:
                    continue
                both = owner * FEATURES + feature
                both.sort()
                seen += np.bincount(both[np.append(True, both[1:] != both[:-1])] % FEATURES, minlength=FEATURES)
                column, sign = r.integers(0, columns, (n, SIGNS), dtype=np.int32), r.choice(np.array([-1.0, 1.0]), (n, SIGNS))
                total += np.bincount((feature[:, None] * np.int32(columns) + column[owner]).ravel(), weights=sign[owner].ravel(), minlength=FEATURES * columns)
                passages += n
        if not passages:
            return
        grid = total.astype(np.float32).reshape(FEATURES, columns)
        del total
        T.release()
        for k in range(0, FEATURES, ROWS):
            yield pa.RecordBatch.from_pydict({"block": [k // ROWS], "part": [task % fan], "sketch": [grid[k : k + ROWS].tobytes()], "seen": [seen[k : k + ROWS].tobytes()], "passages": [passages if k == 0 else 0]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = held.setdefault((r["block"], r["part"]), [0.0, 0, 0])
                own[0] = own[0] + np.frombuffer(r["sketch"], np.float32).astype(float)
                own[1] = own[1] + np.frombuffer(r["seen"], np.int64)
                own[2] += r["passages"]
        for (block, part), (sketch, seen, n) in held.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "part": [part], "sketch": [sketch.astype(np.float32).tobytes()], "seen": [seen.tobytes()], "passages": [n]})

    kinds = "block long, part long, sketch binary, seen binary, passages long"
    blocks = FEATURES // ROWS
    # a tree: some partial sums for each block of rows, each added up as its rows arrive; then their sum
    tree = few.mapInArrow(run, kinds).repartition(blocks * fan, "block", "part").mapInArrow(add, kinds).withColumn("part", F.lit(0).cast("long")).repartition(blocks, "block").mapInArrow(add, kinds)
    sketch, seen, n = np.zeros((FEATURES, columns)), np.zeros(FEATURES, np.int64), 0
    for r in tree.collect():  # blocks of FEATURES x columns in all
        at = slice(r.block * ROWS, (r.block + 1) * ROWS)
        sketch[at] = np.frombuffer(r.sketch, np.float32).reshape(-1, columns)
        seen[at] = np.frombuffer(r.seen, np.int64)
        n += r.passages
    return seen, sketch, n


def _gram(docs: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The Gram matrix of all passages projected on a weighted basis (features x columns)."""
    columns = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for batch in batches:
            for part in T.slices(batch, most=8 << 20):
                feature, owner, _ = _passages(part.column(0))
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
                edge = np.append(first, len(owner))
                for k in range(0, len(first), 512):
                    rows = np.empty((min(512, len(first) - k), columns), basis.dtype)
                    for j in range(0, len(rows), 16):  # so few that their words' rows stay in the cache
                        some = edge[k + j : min(k + j + 16, k + len(rows)) + 1]
                        rows[j : j + 16] = np.add.reduceat(np.take(basis, feature[some[0] : some[-1]], axis=0), some[:-1] - some[0], axis=0)
                    total += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"gram": [total.tobytes()]})

    out = np.zeros((columns, columns))
    for r in _few(docs).mapInArrow(run, "gram binary").collect():  # columns x columns from each of a fixed number of tasks
        out += np.frombuffer(r.gram).reshape(columns, columns)
    return out


def singular_vectors(docs: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading right singular vectors (features x rank) and singular values of the passages' matrix, and the features' weights in it."""
    seen, sketch, n = _sketch(docs, rank + OVER)
    weight = np.log((n + 1) / (seen + 1)) ** 2
    basis, _ = np.linalg.qr(weight[:, None] * sketch)
    values, turn = np.linalg.eigh(_gram(docs, (weight[:, None] * basis).astype(np.float32)) if n else np.zeros((rank + OVER,) * 2))
    top = np.argsort(-values, kind="stable")[:rank]
    return basis @ turn[:, top], np.sqrt(np.maximum(values[top], 0)), weight


def latent_space(docs: DataFrame, rank: int = RANK) -> np.ndarray:
    """Features x rank: squared idf times the leading right singular vectors, each over its singular value."""
    vectors, values, weight = singular_vectors(docs, rank)
    return (weight[:, None] * vectors / np.maximum(values, 1e-6 * max(1.0, values.max(initial=0)))).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Items:
    """A block of benchmark items: latent vectors, words as bits for the alignment, and where the answer begins."""

    def __init__(self, ids: list, texts: list[str | None], space: np.ndarray):
        hashes, per, closes = item_words(*T.text_bytes(pa.array(texts, pa.string())))
        self.ids = ids
        vectors = np.zeros((len(ids), space.shape[1]))
        np.add.at(vectors, np.repeat(np.arange(len(ids)), np.diff(per)), space[_feature(hashes)])
        self.vectors = _unit(vectors).astype(np.float32)
        self.size = np.diff(per)
        self.masks, self.answer_masks, self.answer_size, self.known = [], [], [], []
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        for k in range(len(ids)):
            own, ends = hashes[per[k] : per[k + 1]].tolist(), np.flatnonzero(closes[per[k] : per[k + 1]])
            ends = ends[ends < len(own) - ANSWER]
            begin = int(ends[-1]) + 1 if len(ends) else max(0, len(own) - 2 * ANSWER)
            self.known.append(np.unique(number[per[k] : per[k + 1]], return_counts=True))
            self.masks.append(self._mask(own))
            self.answer_masks.append(self._mask(own[begin:]))
            self.answer_size.append(len(own) - begin)
        self.width = np.minimum(np.searchsorted(WIDTHS, self.size), len(WIDTHS) - 1)
        length = np.minimum(self.size, RUN)
        self.runs = [(int(n), *self._runs(hashes, per, np.flatnonzero(length == n), int(n))) for n in np.unique(length[self.size > 1])]

    @staticmethod
    def _runs(hashes: np.ndarray, per: np.ndarray, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All runs of n words of some items, ascending, with their items and places, and which values of the top bits occur."""
        every = runs(hashes, n)
        places = [np.arange(per[k], per[k + 1] - n + 1) for k in chosen]
        at, item = np.concatenate(places), np.repeat(chosen, [len(x) for x in places])
        order = np.argsort(every[at], kind="stable")
        some = np.zeros(1 << FILTER, bool)
        some[every[at] >> T.U(64 - FILTER)] = True
        return every[at][order], item[order], (at - per[item])[order], some

    @staticmethod
    def _mask(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, w in enumerate(words):
            out[w] = out.get(w, 0) | (1 << k)
        return out

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place among all words of the items; one beyond them for other words."""
        most = len(self.vocabulary)
        if not most:
            return np.zeros(len(hashes), np.int32)
        spot = np.searchsorted(self.vocabulary, hashes)
        spot[self.vocabulary[np.minimum(spot, most - 1)] != hashes] = most
        return spot.astype(np.int32)

    def bound(self, k: int, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: float = 0) -> np.ndarray:
        """The most words that a common subsequence with each region [lo, hi) of numbered words can have: each as often as in both.

        Regions with fewer than need of the item's words get the number of those, which is no less."""
        known, times = self.known[k]
        column = np.full(len(self.vocabulary) + 1, len(known), np.int32)  # other words have the last one
        column[known] = np.arange(len(known))
        common, step = np.zeros(len(lo), np.int64), max(1, CELLS // (16 * (int((hi - lo).max(initial=1)) + len(known))))
        for c in range(0, len(lo), step):
            size = hi[c : c + step] - lo[c : c + step]
            spot = column[words[T.ranges(lo[c : c + step], size)]]
            upto = np.concatenate([[0], np.cumsum(size)])
            seen = np.concatenate([[0], np.cumsum(spot < len(known), dtype=np.int64)])
            held = seen[upto[1:]] - seen[upto[:-1]]  # the item's words in a region, however often
            common[c : c + step] = held
            enough = np.flatnonzero(held >= need)
            width = len(known) + 1
            cell = spot[T.ranges(upto[enough], size[enough])] + np.repeat(np.arange(len(enough)) * width, size[enough])
            both = np.bincount(cell, minlength=len(enough) * width).reshape(len(enough), width)[:, :-1]
            common[c + enough] = np.minimum(both, times).sum(1)
        return common

    def align(self, k: int, words: np.ndarray) -> float:
        """The share of the item's words in its longest common subsequence with a region, or 0 if the answer isn't there."""
        region = words.tolist()
        cover = common(self.masks[k], region) / max(1, int(self.size[k]))
        if cover < COVER or 2 * common(self.answer_masks[k], region) < self.answer_size[k]:
            return 0.0
        return cover


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out = out * T.U(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - n + 1 + j]
    return T.mix(out)


def common(mask: dict[int, int], region: list[int]) -> int:
    """Length of the longest common subsequence, a word of the region at a time on all of the item's bits."""
    state, n = 0, 0
    for w in region:
        hit = mask.get(w)
        if hit:
            joined = state | hit
            state = joined & ~(joined - ((state << 1) | 1)) if joined else 0
    while state:
        state &= state - 1
        n += 1
    return n


def _find(items: Items, space: np.ndarray, data: np.ndarray, offsets: np.ndarray, cosine: float) -> list[tuple[int, int, float]]:
    """(text, item, cover) for every match in some texts."""
    hashes, per, _ = item_words(data, offsets)
    best: dict[tuple[int, int], float] = {}
    if len(hashes) <= PIECE or len(per) > 2:
        _search(items, space, hashes, per, cosine, best)
    else:  # a long text: what a match can reach lies whole in one piece
        reach = max(int(items.size.max()), WIDTHS[-1]) + 4 * REACH
        for begin in range(0, len(hashes), PIECE):
            own = hashes[begin : begin + PIECE + reach]
            _search(items, space, own, np.array([0, len(own)]), cosine, best)
    return [(d, k, c) for (d, k), c in sorted(best.items())]


def _search(items: Items, space: np.ndarray, hashes: np.ndarray, per: np.ndarray, cosine: float, best: dict[tuple[int, int], float]) -> None:
    """Put the cover of each match (text, item) into best where it is larger."""
    count = np.diff(per)
    steps = -(-count // STEP)
    upto = np.concatenate([[0], np.cumsum(steps)])
    if not len(hashes):
        return
    text = np.repeat(np.arange(len(count)), steps)
    begin = per[text] + (np.arange(len(text)) - upto[text]) * STEP
    stop = per[text + 1]
    feature, pieces = _feature(hashes), np.empty((len(begin), space.shape[1]), np.float32)
    for j in range(0, len(begin), 256):  # so few steps that their words' rows stay in the cache
        own, last, total = begin[j : j + 256], stop[j : j + 256], pieces[j : j + 256]
        np.take(space, feature[own], axis=0, out=total, mode="clip")
        for k in range(1, STEP):  # the words of a step, one after another: some steps at the end of a text have fewer
            more = own + k < last
            if more.all():
                total += np.take(space, feature[own + k], axis=0)
            else:
                total[more] += np.take(space, feature[own[more] + k], axis=0)

    numbers = items.numbered(hashes)

    def consider(own: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        """Align the surroundings of places (text, item, word)."""
        order = np.lexsort((at, own, item))
        own, item, at = own[order], item[order], at[order]
        cuts = np.concatenate([[0], np.flatnonzero(item[1:] != item[:-1]) + 1, [len(item)]]) if len(item) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k = int(item[a])
            lo = np.maximum(per[own[a:b]], at[a:b] - REACH)
            hi = np.minimum(per[own[a:b] + 1], at[a:b] + max(2 * REACH, int(items.size[k])) + REACH)
            for c in np.flatnonzero(items.bound(k, numbers, lo, hi, COVER * items.size[k]) >= COVER * items.size[k]).tolist():
                place = int(own[a + c]), k
                if best.get(place, 0.0) < 1.0:
                    cover = items.align(k, hashes[lo[c] : hi[c]])
                    if cover > best.get(place, 0.0):
                        best[place] = cover

    for n, known, item, offset, some in items.runs:
        found = runs(hashes, n)
        at = np.flatnonzero(some[found >> T.U(64 - FILTER)])
        own = np.searchsorted(per, at, "right") - 1
        at, own = (x[at + n <= per[own + 1]] for x in (at, own))
        low, high = (np.searchsorted(known, found[at], side) for side in ("left", "right"))
        each = high - low
        spot = np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())
        places = np.unique(np.stack([np.repeat(own, each), item[spot], np.repeat(at, each) - offset[spot]]), axis=1)
        consider(*places)
    for w in np.unique(items.width[items.size > 1]):
        chosen = np.flatnonzero((items.width == w) & (items.size > 1))
        vectors, wide, hits = items.vectors[chosen].T, WIDTHS[w] // STEP, []
        every = max(1, wide // 4)  # a window starts at every so many steps, and is a sum of that many groups of them
        groups = -(-steps // every)
        more = -(-wide // every)
        # groups of each text, with room for empty ones behind its last
        place = np.arange(groups.sum()) + np.repeat(np.arange(len(steps)) * (more - 1), groups)
        first = np.repeat(upto[:-1], groups) + every * (np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups))
        window = np.zeros((int(groups.sum()) + len(steps) * (more - 1), space.shape[1]), np.float32)
        window[place] = np.take(pieces, first, axis=0)
        for j in range(1, every):
            some = np.flatnonzero(first + j < upto[text[first] + 1])
            window[place[some]] += np.take(pieces, first[some] + j, axis=0)
        rows = max(1, BLOCK // max(len(chosen), 1))
        for c in range(0, len(place), rows):
            at = place[c : c + rows]
            total = window[at[0] : at[-1] + 1].copy()
            for k in range(1, more):
                total += window[at[0] + k : at[-1] + 1 + k]
            some = total[at - at[0]]
            size = np.sqrt(np.einsum("ij,ij->i", some, some))
            flat = np.flatnonzero(some @ vectors >= cosine * np.maximum(size, 1e-12)[:, None])
            row, k = first[c + flat // len(chosen)], flat % len(chosen)
            hits.append((text[row], chosen[k], begin[row]))
        del window
        consider(*(np.concatenate(x) for x in zip(*hits, strict=True)))


def _blocks(benchmark: DataFrame, space: np.ndarray) -> Iterator[Items]:
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    count, size = named.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-count // ITEMS), -(-(size or 0) // ITEM_BYTES))
    for c in range(n):
        rows = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == c).orderBy("item_id", "text").collect()
        block = Items([r.item_id for r in rows], [r.text for r in rows], space)
        if len(rows) and (block.size > 1).any():
            block.vectors[block.size < 2] = 0
            yield block


def matches(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, cover: every benchmark item that a document holds, and the share of its words found in order."""
    space = latent_space(docs, rank)
    kinds = "doc_id long, item_id long, cover double"
    found = docs.sparkSession.createDataFrame([], kinds)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in _blocks(benchmark, space):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in T.slices(batch, most=1 << 20):
                    rows = _find(items, space, *T.text_bytes(part.column(1)), cosine)
                    if rows:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([d for d, *_ in rows])), pa.array([items.ids[k] for _, k, _ in rows], pa.int64()), pa.array([c for *_, c in rows])], ["doc_id", "item_id", "cover"])

        found = found.union(texts.mapInArrow(run, kinds))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    space, out = latent_space(docs, rank), docs
    for items in _blocks(benchmark, space):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in T.slices(batch, most=1 << 20):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, *_ in _find(items, space, *T.text_bytes(part.column(part.schema.get_field_index("text"))), cosine)]] = False
                    yield part.filter(pa.array(keep))
            T.release()

        out = out.mapInArrow(run, docs.schema)
    return out
