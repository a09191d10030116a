"""Line deduplication by pairwise alignment: documents that share lines are aligned with patience diff, and the aligned
common blocks leave the later document.

1. Lines (between line feeds, trimmed of spaces) are hashed to 64 bits. Lines of MIN_WORDS words or more are anchors.
2. Documents are ordered by doc_id. Of documents with equal texts the first one stands for all: a later one that holds an anchor goes whole.
3. An anchor line of at most RARE documents pairs all of them, a more frequent one each of them with its first holder. Most lines go then.
   A frequent line that still stands in a document is settled against all its earlier holders by their frequent lines alone, other
   anchor lines and lines that no other holder has being gaps: documents with equal sequences of them are one class. Two classes that
   share a line of at most RARE classes are aligned by themselves. Others are aligned by the lines of more classes alone: classes with
   equal sequences of these are one kind, and two kinds are aligned once, for all their members. Two documents that share no rare line
   have the same alignment by whole texts as by these sequences, so an anchor line goes when it goes in the alignment with any earlier
   document, whole or by frequent lines, and no rule lists the pairs of a group.
   Lines of fewer words go with the blocks of the alignments made: a document whose anchor lines are settled isn't aligned further for them.
4. Both documents' line hashes are aligned: common head and tail, then recursively the longest ascending run of lines that occur
   once in both. An aligned block (lines that follow each other in both) with an anchor line is deleted from the later document.

Defined cases: null and empty texts have no lines and come back empty; rows with the same doc_id and text are one
document and are all kept alike; documents with one doc_id and different texts are ordered by a hash of the text;
documents without an id come back unchanged and delete nothing; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import exchange as X
from graphloom.llm import textops as T
from graphloom.runtime import stored

MIN_WORDS, RARE = 5, 32
KEY = ["line_doc", "line_text"]


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every line trimmed of spaces, its number of words, and the n + 1 offsets of each text's lines."""
    feed = data == 10
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = feed
    full = np.diff(offsets) > 0
    begin = np.union1d(np.flatnonzero(cut[:-1]), offsets[:-1][full]) if len(data) else np.zeros(0, np.int64)
    # a text that ends in a line feed has an empty last line
    tail = offsets[1:][full][feed[offsets[1:][full] - 1]] if len(data) else np.zeros(0, np.int64)
    per = np.searchsorted(begin, offsets) + np.concatenate([[0], np.cumsum(full & np.isin(offsets[1:], tail))])
    starts, ends, _ = T.words(data, offsets)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, np.append(begin[1:], len(data)))
    count = last - first
    low = np.where(count > 0, starts[np.minimum(first, max(0, len(starts) - 1))] if len(starts) else begin, begin)
    high = np.where(count > 0, ends[np.maximum(last - 1, 0)] if len(starts) else begin, low)
    hashes = T.hash_spans(data, low, high)
    if len(tail):  # empty last lines
        spot = np.searchsorted(begin, tail)
        empty = T.hash_spans(data, np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
        hashes, count = np.insert(hashes, spot, empty), np.insert(count, spot, 0)
    return hashes, count, per


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), ascending."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, int] = {}
        for k in range(a0, a1):
            once[a[k]] = -1 if a[k] in once else k
        seen: dict[int, int] = {}
        for k in range(b0, b1):
            seen[b[k]] = -1 if b[k] in seen else k
        matched = [(once[x], k) for x, k in seen.items() if k >= 0 and once.get(x, -1) >= 0]
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(matched):  # ascending in b
            at = bisect_left(tops, i)
            back.append(ends[at - 1] if at else -1)
            if at == len(tops):
                tops.append(i)
                ends.append(k)
            else:
                tops[at], ends[at] = i, k
        chain: list[tuple[int, int]] = []
        k = ends[-1] if ends else -1
        while k >= 0:
            chain.append(matched[k])
            k = back[k]
        chain.reverse()
        if not chain:
            continue
        out += chain
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            if k > i + 1 and m > j + 1:
                work.append((i + 1, k, j + 1, m))
    return sorted(out)


def deletions(a: np.ndarray, b: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Places of b in aligned blocks that hold an anchor line."""
    pairs = patience(a.tolist(), b.tolist())
    gone: list[int] = []
    block: list[int] = []
    for k, (i, j) in enumerate(pairs):
        if block and (i != pairs[k - 1][0] + 1 or j != pairs[k - 1][1] + 1):
            gone += block if anchor[block].any() else []
            block = []
        block.append(j)
    gone += block if block and anchor[block].any() else []
    return np.array(gone, np.int64)


def skeleton(lines: np.ndarray, anchor: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with each stretch of gaps as one mark, which of them are anchors and no gaps, and the place of each among the lines."""
    keep = ~gap
    keep[0] = True
    keep[1:] |= gap[1:] & ~gap[:-1]
    return np.where(gap, np.uint64(0), lines)[keep], (anchor & ~gap)[keep], np.flatnonzero(keep)


def gone_by(first: bytes, own: bytes, mark: bytes) -> np.ndarray:
    """Places of a sequence that go when it is aligned with an earlier one."""
    theirs = X.unpack(first, np.uint64)
    theirs = np.where(theirs == 0, np.uint64(1), theirs)  # a gap of one side is none of the other
    return deletions(theirs, X.unpack(own, np.uint64), np.frombuffer(mark, bool))


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """line_doc, line_text (the document's key) and gone: the packed numbers of the lines to delete."""
    text = F.col("text").cast("string")
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias(KEY[0]), F.xxhash64(text).alias(KEY[1]), F.xxhash64(text, F.lit(1)).alias("again"), text.alias("text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                hashes, count, per = split_lines(*T.text_bytes(part.column(3)))
                anchor = count >= min_words
                cut = lambda f: [f(a, b) for a, b in zip(per[:-1], per[1:], strict=True)]  # noqa: B023, E731
                packed = [pa.array(cut(lambda a, b: X.pack(hashes[a:b])), pa.binary()), pa.array(cut(lambda a, b: anchor[a:b].tobytes()), pa.binary())]
                anchors = pa.array(cut(lambda a, b: np.unique(hashes[a:b][anchor[a:b]]).view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *packed, anchors], [*KEY, "again", "lines", "anchor", "anchors"])

    # of equal texts the first document; texts are told apart by two hashes
    every = keyed.mapInArrow(run, "line_doc long, line_text long, again long, lines binary, anchor binary, anchors array<long>")
    firsts = every.groupBy(KEY[1], "again").agg(F.min(KEY[0]).alias(KEY[0]), F.first("lines").alias("lines"), F.first("anchor").alias("anchor"), F.first("anchors").alias("anchors"))
    lines = stored(firsts.withColumn("doc", F.struct(*KEY)), "lines")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [X.pack(np.arange(len(k.as_buffer()))) for k in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.binary())], [*KEY, "gone"])

    held_once = lines.where(F.size("anchors") > 0).select(F.col(KEY[0]).alias("first"), KEY[1], "again", "anchor")
    copies = keyed.select(*KEY, "again").distinct().join(held_once, [KEY[1], "again"]).where(F.col(KEY[0]) > F.col("first")).select(*KEY, "anchor").mapInArrow(whole, "line_doc long, line_text long, gone binary")
    entries = lines.select("doc", F.explode("anchors").alias("line"))
    shared = entries.groupBy("line").agg(F.count("*").alias("times"), F.min("doc").alias("owner")).where("times > 1")
    held = stored(entries.join(shared, "line"), "line-shared")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [deletions(X.unpack(a, np.uint64), X.unpack(b, np.uint64), np.frombuffer(k, bool)) for a, b, k in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([X.pack(g) for g in gone], pa.binary())], [*KEY, "gone"])

    rare, frequent = held.where(F.col("times") <= RARE), held.where(F.col("times") > RARE)
    close = rare.select("doc", "line").join(rare.select(F.col("doc").alias("owner"), "line"), "line").where("owner < doc").select("doc", "owner")
    pairs = stored(close.union(frequent.where("owner <> doc").select("doc", "owner")).distinct(), "line-pairs")
    joined = pairs.join(lines.select(F.col("doc").alias("owner"), F.col("lines").alias("first_lines")), "owner").join(lines.select("doc", "lines", "anchor"), "doc").select("doc.*", "first_lines", "lines", "anchor")
    first = stored(joined.mapInArrow(align, "line_doc long, line_text long, gone binary"), "line-gone")
    lost = first.groupBy(F.struct(*KEY).alias("doc")).agg(F.collect_list("gone").alias("gone"))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw, mark, gone in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                stays = np.frombuffer(mark, bool).copy()
                for g in gone:
                    stays[X.unpack(g, np.int64)] = False
                found.append(np.unique(X.unpack(raw, np.uint64)[stays]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], [*KEY, "line"])

    stays = lost.join(lines.select("doc", "lines", "anchor"), "doc").select("doc.*", "lines", "anchor", "gone").mapInArrow(left, "line_doc long, line_text long, line array<long>")
    open_ = stored(stays.select(F.struct(*KEY).alias("doc"), F.explode("line").alias("line")).join(frequent, ["doc", "line"]).where("owner <> doc").select("doc", "line"), "line-open")
    second = _by_frequent_lines(open_, frequent, lines)
    return first.union(second).union(copies).groupBy(*KEY).agg(F.collect_list("gone").alias("gone"))


def _by_frequent_lines(open_: DataFrame, frequent: DataFrame, lines: DataFrame) -> DataFrame:
    """What goes from the documents of open_ (doc, line) by alignment with the frequent lines of all earlier holders, class by class."""
    holders = frequent.join(open_.select("line").distinct(), "line", "left_semi").select("doc").distinct()
    common = stored(frequent.join(holders, "doc", "left_semi").select("doc", "line"), "line-common")
    known = common.groupBy("doc").agg(F.collect_list("line").alias("held"))  # a document's own lines
    sides = stored(known.join(lines.select("doc", "lines", "anchor"), "doc").select("doc.*", "lines", "anchor", "held"), "line-sides")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(X.unpack(raw, np.uint64)[~np.frombuffer(mark, bool)]).view(np.int64) for raw, mark in zip(*(batch.column(c).to_pylist() for c in (2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], [*KEY, "line"])

    # a line that one holder alone has is matched by none of the others: as a gap it keeps no document out of a class
    values = sides.mapInArrow(short, "line_doc long, line_text long, line array<long>").select(F.struct(*KEY).alias("doc"), F.explode("line").alias("line")).union(common)
    alone = values.groupBy("line").agg(F.count("*").alias("times"), F.min("doc").alias("doc")).where("times = 1").groupBy("doc").agg(F.collect_list("line").alias("alone"))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, mark, held, single in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
                own, anchor = X.unpack(raw, np.uint64), np.frombuffer(mark, bool)
                gap = anchor & ~np.isin(own, np.array(held, np.int64).view(np.uint64)) | np.isin(own, np.array(single or [], np.int64).view(np.uint64))
                rows.append(_named(*skeleton(own, anchor, gap)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_columns(rows)], [*KEY, "class", "own", "mark", "at", "held"])

    sides = sides.withColumn("doc", F.struct(*KEY)).join(alone, "doc", "left").select("doc.*", "lines", "anchor", "held", "alone")
    classed = stored(sides.mapInArrow(sequences, "line_doc long, line_text long, class binary, own binary, mark binary, at array<int>, held array<long>").withColumn("doc", F.struct(*KEY)), "line-classes")
    heads = stored(classed.groupBy("class").agg(F.min("doc").alias("head"), F.first("own").alias("own"), F.first("mark").alias("mark"), F.first("held").alias("held")), "line-heads")
    asked = stored(open_.join(classed.select("doc", "class"), "doc").groupBy("class", "line").agg(F.max("doc").alias("last")), "line-asked")
    entries = heads.select("class", "head", F.explode("held").alias("line"))
    few = entries.groupBy("line").agg(F.count("*").alias("times")).where(F.col("times") <= RARE).select("line")
    scarce = stored(entries.join(few, "line").select("class", "line"), "line-scarce")

    # two classes that share a line of few classes are aligned by themselves
    near = asked.select("class").distinct().join(scarce, "class").join(scarce.select(F.col("class").alias("other"), "line"), "line")
    near = stored(near.select("class", "other").distinct(), "line-near")
    meet = near.join(asked, "class").join(entries.select(F.col("class").alias("other"), "head", "line"), ["other", "line"]).where("head < last").select("class", "other").distinct()
    theirs = heads.select(F.col("class").alias("other"), "head", F.col("own").alias("theirs"))
    alone_met = meet.join(theirs, "other").join(heads.select("class", "own", "mark"), "class").select("class", "head", "theirs", "own", "mark")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [gone_by(*x).tolist() for x in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["class", "head", "gone"])

    taken = alone_met.mapInArrow(align, "class binary, head struct<line_doc: long, line_text: long>, gone array<int>").select("class", "head", F.explode("gone").alias("place"))
    taken = taken.union(_by_kinds(heads, asked, scarce, near))
    # of each line of a class, the first document that takes it
    taken = stored(taken.groupBy("class", "place").agg(F.min("head").alias("head")), "line-taken")
    places = taken.join(open_.select("doc").distinct().join(classed.select("doc", "class", "at"), "doc"), "class").where("head < doc")
    places = places.groupBy("doc").agg(F.collect_list(F.expr("at[place]").cast("long")).alias("places"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [X.pack(np.array(k, np.int64)) for k in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.binary())], [*KEY, "gone"])

    return places.select("doc.*", "places").mapInArrow(placed, "line_doc long, line_text long, gone binary")


def _named(own: np.ndarray, anchor: np.ndarray, at: np.ndarray) -> tuple:
    """A sequence's name, its lines and marks packed, the places of its lines, and its distinct lines."""
    return hashlib.blake2b(own.tobytes() + anchor.tobytes(), digest_size=16).digest(), X.pack(own), anchor.tobytes(), at.tolist(), np.unique(own[own != 0]).view(np.int64)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


def _by_kinds(heads: DataFrame, asked: DataFrame, scarce: DataFrame, near: DataFrame) -> DataFrame:
    """class, head and place: what goes from classes by alignment with those that share none of their lines of few classes.

    Without such lines many classes have one sequence, a kind; two kinds are aligned once. The first class of a kind may be near to one
    that asks, which the alignment isn't right for: then the first that isn't near stands for the kind."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, mark, lost in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                own = X.unpack(raw, np.uint64)
                rows.append(_named(*skeleton(own, np.frombuffer(mark, bool), (own == 0) | np.isin(own, np.array(lost or [], np.int64).view(np.uint64)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_columns(rows)], ["class", "head", "kind", "own", "mark", "at", "held"])

    marked = heads.join(scarce.groupBy("class").agg(F.collect_list("line").alias("lost")), "class", "left").select("class", "head", "own", "mark", "lost")
    kinds = stored(marked.mapInArrow(sequences, "class binary, head struct<line_doc: long, line_text: long>, kind binary, own binary, mark binary, at array<int>, held array<long>"), "line-kinds")
    tops = kinds.groupBy("kind").agg(F.min("head").alias("head"), F.min_by("class", "head").alias("first"), *(F.first(c).alias(c) for c in ("own", "mark", "held")))
    tops = stored(tops.withColumnRenamed("kind", "top"), "line-tops")
    wanted = asked.join(kinds.select("class", "kind"), "class").groupBy("kind", "line").agg(F.max("last").alias("last"))
    meet = wanted.join(tops.select("top", "head", F.explode("held").alias("line")), "line").where("head < last").groupBy("kind", "top").agg(F.collect_set("line").alias("by"))
    joined = meet.join(tops.select("top", "head", F.col("own").alias("theirs")), "top").join(tops.select(F.col("top").alias("kind"), "own", "mark"), "kind").select("kind", "top", "theirs", "own", "mark", "head", "by")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [gone_by(*x).tolist() for x in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), batch.column(6), pa.array(gone, pa.list_(pa.int32()))], ["kind", "top", "head", "by", "gone"])

    aligned = joined.mapInArrow(align, "kind binary, top binary, head struct<line_doc: long, line_text: long>, by array<long>, gone array<int>")
    aligned = stored(aligned.where(F.size("gone") > 0), "line-aligned")
    firsts = tops.select("top", F.col("first").alias("other"))
    barred = near.join(firsts, "other").join(kinds.select("class", "kind"), "class").join(aligned.select("kind", "top"), ["kind", "top"], "left_semi").select("class", "top")
    members = kinds.select(F.col("kind").alias("top"), F.col("class").alias("other"), F.col("head").alias("later"))
    later = barred.join(members, "top").join(near, ["class", "other"], "left_anti").groupBy("class", "top").agg(F.min("later").alias("later"))
    barred = stored(barred.join(later, ["class", "top"], "left").withColumn("barred", F.lit(True)), "line-barred")
    wish = asked.select("class", "line").join(kinds.select("class", "kind"), "class")
    reached = aligned.withColumn("line", F.explode("by"))
    # of each line of a kind, the first kind that takes it; for a class with a barred kind all of them
    least = reached.select("kind", "line", "head", F.explode("gone").alias("place")).groupBy("kind", "line", "place").agg(F.min("head").alias("head"))
    plain = wish.join(barred.select("class").distinct(), "class", "left_anti").join(least, ["kind", "line"]).select("class", "head", "place")
    each = wish.join(barred.select("class").distinct(), "class", "left_semi").join(reached, ["kind", "line"]).join(barred, ["class", "top"], "left")
    each = each.withColumn("head", F.when(F.col("barred"), F.col("later")).otherwise(F.col("head"))).where("head is not null").select("class", "head", F.explode("gone").alias("place"))
    found = plain.union(each).groupBy("class", "place").agg(F.min("head").alias("head"))
    return found.join(kinds.select("class", "at"), "class").select("class", "head", F.expr("at[place]").alias("place"))


def _cut(text: str | None, gone: list[bytes] | None) -> tuple[str, int, int]:
    """What is left of a text, its number of lines, and how many went."""
    parts = text.split("\n") if text else []
    if not gone:
        return text or "", len(parts), 0
    out = set(np.concatenate([X.unpack(g, np.int64) for g in gone]).tolist())
    return "\n".join(p for k, p in enumerate(parts) if k not in out), len(parts), len(out)


def _with_gone(docs: DataFrame, min_words: int) -> tuple[DataFrame, str]:
    """docs with a last column, of that name, of what goes from each text."""
    names = ["line_doc_", "line_text_", "line_gone_"]
    while {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        names = [f"{n}_" for n in names]
    doc, text, gone = names
    found = deleted_lines(docs, min_words).select(F.col(KEY[0]).alias(doc), F.col(KEY[1]).alias(text), F.col("gone").alias(gone))
    keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(text, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(found, [doc, text], "left"), gone


def line_digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted and kept_sha256 (of the text that is left) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(t.as_py(), g.as_py()) for t, g in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n, _ in cut], pa.int64()), pa.array([n for *_, n in cut], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t, *_ in cut], pa.string())], ["doc_id", "n_lines", "n_deleted", "kept_sha256"])

    plain = docs.select("doc_id", "text")
    marked, gone = _with_gone(plain, min_words)
    return marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), gone).mapInArrow(run, "doc_id long, n_lines long, n_deleted long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs with the deleted lines gone from text; documents that lose all their lines go, as their whole text stands in earlier ones."""
    schema = docs.schema
    place = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            gone = columns.pop()
            cut = [_cut(t.as_py(), g.as_py()) for t, g in zip(columns[place], gone, strict=True)]
            keep = pa.array([not n or n < lines for _, lines, n in cut], pa.bool_())
            columns[place] = pa.array([t if n else old.as_py() for (t, _, n), old in zip(cut, columns[place], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], schema.fieldNames())
        T.release()

    marked, gone = _with_gone(docs, min_words)
    return marked.select(*(F.col(f"`{c}`") for c in schema.fieldNames()), gone).mapInArrow(run, schema)
