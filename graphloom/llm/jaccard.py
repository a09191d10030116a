"""Exact similarity join on word shingles by vertical partitioning, returning classes of linked documents.

The global order of n-grams is cut into fragments. Each fragment counts in how many documents its n-grams occur and
names the shared ones so that rarer names come first; a document whose n-grams are shared by none drops out there.
1. A document with n shingles can only link to one that has a shingle in common among its first n - ceil(t n) + 1, rarest first.
   Shingles of one document only come first of all, so most documents have no candidates.
2. Documents with equal sets form one class; its least doc_id stands for it.
3. Every class is held against the one class that shares most of its first shingles with it among the purest of each
   shingle (those with the fewest shingles of their own, as an original among its copies). Links contract classes.
4. Groups that share a first shingle and still hold several components are joined exactly: in each, all classes outside
   the largest component against all others, in blocks. Candidates share a first shingle, and a signature of bits bounds
   their overlap from above.
5. Candidates of steps 3 and 4 are counted by vertical partitions: pivots cut the global order (rarest first) into
   FRAGMENTS even parts, each part of two sets is intersected separately, and the partial overlaps are summed for each pair.
No pair within a component is formed, so large groups of copies cost what their rows cost.

Shingles are 64-bit hashes, of which no text is kept: sizes and links are exact up to their collisions (one shingle
in some millions among 10^13 different ones).

Defined cases: a text without words has an empty set and links with nothing; one with fewer words than a shingle has the
whole sequence as its shingle; a document without an id is returned with a null component and links with nothing;
repeated rows link if their sets aren't empty; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import exchange as X
from graphloom.llm import textops as T
from graphloom.operators.components import star_components
from graphloom.runtime import stored

WORDS, PERCENT = 5, 75
FLUSH = 1 << 19
HOT = 32
BLOCK, OUTSIDERS = 2048, 512
BITS = 2048
FRAGMENTS, SLOTS = 8, 4
CHUNK = 1 << 20


def _sets(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """A row for each task's part and fragment: its distinct keys, how many documents hold each, and which."""
    names = ["frag", "src", "keys", "times", "owners", "hot_keys", "hot_times", "info"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, number, total = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number, size, total
            src = (TaskContext.get().partitionId() << 24) | number
            ids, missing, n, c1, c2 = (np.concatenate([h[k] for h in held]) for k in range(5))
            keys, owner = np.concatenate([h[5] for h in held]), np.concatenate([h[6] for h in held])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order].astype(np.uint32)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(keys)))
            distinct = keys[first]
            hot = times >= HOT
            hot_entry = np.repeat(hot, times)
            info = [X.pack(x) for x in (ids, missing, n, c1, c2, times[hot].astype(np.uint32), owner[hot_entry])]
            cold_keys, cold_times, owner = distinct[~hot], times[~hot], owner[~hot_entry]
            hot_keys, hot_times = distinct[hot], times[hot]
            at, hot_at = X.cuts(cold_keys, bits), X.cuts(hot_keys, bits)
            upto = np.concatenate([[0], np.cumsum(cold_times)])
            some = np.flatnonzero((np.diff(at) > 0) | (np.diff(hot_at) > 0))
            rows = [[-1 - src, src, b"", b"", b"", b"", b"", info]]
            for f in some:
                a, b = at[f], at[f + 1]
                c, d = hot_at[f], hot_at[f + 1]
                rows.append([int(f), src, X.pack(cold_keys[a:b]), X.pack(cold_times[a:b].astype(np.uint8)), X.pack(owner[upto[a] : upto[b]]), X.pack(hot_keys[c:d]), X.pack(hot_times[c:d].astype(np.uint32)), None])
            held, number, size, total = [], number + 1, 0, 0
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for part in T.slices(batch, rows=256):
                hashes, owner = T.shingles(*T.hashed_words(*T.text_bytes(part.column(1))), words)
                order = np.argsort(hashes)
                order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
                keys, owner = hashes[order], owner[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])) if len(keys) else np.zeros(0, bool)
                keys, owner = keys[new], owner[new]
                n = np.bincount(owner, minlength=part.num_rows)
                sums = []
                for odd in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
                    upto = np.concatenate([[0], np.cumsum(T.mix(keys ^ T.U(odd)), dtype=np.uint64)])
                    ends = np.cumsum(n)
                    sums.append((upto[ends] - upto[ends - n]).view(np.int64))
                held.append((part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(part.column(0).is_null()), n.astype(np.int64), *sums, keys, owner + total))
                size, total = size + len(keys), total + part.num_rows
                if size >= FLUSH:
                    yield flush()
                    T.release()
        if held:
            yield flush()
        T.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "frag long, src long, keys binary, times binary, owners binary, hot_keys binary, hot_times binary, info array<binary>")


def _count(group: pa.Table) -> pa.Table:
    """One fragment: names of the keys that several documents hold, as (power of two of their number, fragment, rank)."""
    rows = group.to_pylist()
    frag = rows[0]["frag"]
    kinds = [("src", pa.int64()), ("frag", pa.int64()), ("tokens", pa.binary()), ("times", pa.binary()), ("owners", pa.binary()), ("hot_tokens", pa.binary()), ("info", pa.list_(pa.binary()))]
    schema = pa.schema(kinds)
    if frag < 0:
        return pa.Table.from_pylist([{"src": r["src"], "frag": frag, "info": r["info"]} for r in rows], schema)
    cold, hot = [X.unpack(r["keys"], np.uint64) for r in rows], [X.unpack(r["hot_keys"], np.uint64) for r in rows]
    times = [X.unpack(r["times"], np.uint8) for r in rows]
    every, inverse = np.unique(np.concatenate(cold + hot), return_inverse=True)
    number = np.bincount(inverse, weights=np.concatenate(times + [X.unpack(r["hot_times"], np.uint32) for r in rows]), minlength=len(every)).astype(np.int64)
    name = (np.log2(number).astype(np.int64) << 56) | (int(frag) << 32) | np.arange(len(every))
    name[number < 2] = -1
    out = np.split(name[inverse], np.cumsum([len(x) for x in cold + hot])[:-1])
    back = []
    for k, r in enumerate(rows):
        shared = out[k] >= 0
        hot_names = out[len(rows) + k]
        if shared.any() or len(hot_names):
            back.append({"src": r["src"], "frag": frag, "tokens": X.pack(out[k][shared]), "times": X.pack(times[k][shared]), "owners": X.pack(X.unpack(r["owners"], np.uint32)[np.repeat(shared, times[k])]), "hot_tokens": X.pack(hot_names), "info": None})
    del every, inverse, name, out
    T.release()
    return pa.Table.from_pylist(back, schema)


def _assemble(percent: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        info = next(r["info"] for r in rows if r["frag"] < 0)
        back = sorted((r for r in rows if r["frag"] >= 0), key=lambda r: r["frag"])
        ids, missing, n, c1, c2, hot_times, hot_owner = (X.unpack(x, k) for x, k in zip(info, (np.int64, np.bool_, np.int64, np.int64, np.int64, np.uint32, np.uint32), strict=True))
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        token = join([np.repeat(X.unpack(r["tokens"], np.int64), X.unpack(r["times"], np.uint8)) for r in back] + [np.repeat(join([X.unpack(r["hot_tokens"], np.int64) for r in back], np.int64), hot_times)], np.int64)
        owner = join([X.unpack(r["owners"], np.uint32) for r in back] + [hot_owner], np.uint32).astype(np.int64)
        order = np.lexsort((token, owner))
        token, owner = token[order], owner[order]
        shared = np.bincount(owner, minlength=len(ids))
        first = n - (-(-percent * n // 100)) + 1 - (n - shared)  # how many shared shingles belong to the first ones
        live = (first > 0) & (n > 0) & ~missing
        ends = np.cumsum(shared)
        T.release()
        blobs = [X.pack(token[e - s : e]) if ok else None for e, s, ok in zip(ends.tolist(), shared.tolist(), live.tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(ids, mask=missing), pa.array(n), pa.array(c1), pa.array(c2), pa.array(np.where(live, first, 0)), pa.array(n - shared), pa.array(blobs, pa.binary())], ["doc_id", "n", "c1", "c2", "first", "own", "tokens"])

    return run


def _pivots(classes: DataFrame, bits: int) -> np.ndarray:
    """Names that cut the global order into FRAGMENTS parts with about as many entries of all sets each."""
    shift = 32 + max(0, bits - SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(X.unpack(x.as_py(), np.int64) >> shift for x in batch.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], ["slot", "n"])

    # a row for each power of two and one of 2 ** SLOTS ranges of hashes
    rows = classes.select("tokens").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).orderBy("slot").collect()
    upto = np.cumsum([r.n for r in rows])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS) if len(rows) else np.zeros(0, np.int64)
    return np.array([rows[k].slot + 1 for k in at], np.int64) << shift


def _segments(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, frag, segment: the part of each class's shared shingles that lies in a fragment of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                token = X.unpack(blob.as_py(), np.int64)
                rows += [(i, f, part.tobytes()) for f, part in enumerate(np.split(token, np.searchsorted(token, pivots))) if len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.binary())], ["id", "frag", "segment"])

    return classes.select("id", "tokens").mapInArrow(run, "id long, frag long, segment binary")


def _linked(partial: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, from their overlaps in each fragment (a, b, same)."""
    size = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"))
    total = partial.groupBy("a", "b").agg(F.sum("same").alias("same"))
    return total.join(size("a"), "a").join(size("b"), "b").where(100 * F.col("same") >= percent * (F.col("n_a") + F.col("n_b") - F.col("same"))).select("a", "b")


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b, same: the overlap of each pair in each fragment where both have shingles."""
    side = lambda x: segments.select(F.col("id").alias(x), "frag", F.col("segment").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), ["b", "frag"]).select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                same[i] = len(np.intersect1d(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64), assume_unique=True))
            keep = same > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(same[keep])], ["a", "b", "same"])

    return joined.mapInArrow(run, "a long, b long, same long")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set, and its signature: the parity of the set's hashes in each of BITS places."""
    for batch in batches:
        first, prefix, sign = batch.column(1).to_pylist(), [], []
        for blob, k in zip(batch.column(2), first, strict=True):
            token = X.unpack(blob.as_py(), np.int64)
            flip = np.bincount((T.mix(token.view(np.uint64)) % T.U(BITS)).astype(np.int64), minlength=BITS) & 1
            prefix.append(X.pack(token[:k]))
            sign.append(np.packbits(flip.astype(bool)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prefix, pa.binary()), pa.array(sign, pa.binary())], ["id", "prefix", "sign"])


def _candidates(percent: int):
    """Pairs of an outsider of one block and a member of another from different components that may link, as packed ids."""

    def run(group: pa.Table) -> pa.Table:
        role, out = (np.array(group.column(c).to_pylist(), bool) for c in ("outsider", "out"))
        ids, n, own, comp = (group.column(c).to_numpy() for c in ("id", "n", "own", "component"))
        sets = [X.unpack(x, np.int64) for x in group.column("prefix").to_pylist()]
        signs = np.frombuffer(b"".join(group.column("sign").to_pylist()), np.uint64).reshape(len(ids), -1)
        members = np.flatnonzero(~role)
        token = np.concatenate([np.zeros(0, np.int64), *(sets[i] for i in members)])
        holder = np.repeat(members, [len(sets[i]) for i in members])
        order = np.argsort(token, kind="stable")
        token, holder = token[order], holder[order]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for u in np.flatnonzero(role):
            lo, hi = np.searchsorted(token, sets[u]), np.searchsorted(token, sets[u], "right")
            near = np.unique(holder[T.ranges(lo, hi - lo)])
            near = near[(comp[near] != comp[u]) & (100 * n[near] >= percent * n[u]) & (100 * n[u] >= percent * n[near]) & (~out[near] | (ids[near] > ids[u]))]
            apart = np.bitwise_count(signs[near] ^ signs[u]).sum(1) + own[near] + own[u]
            near = near[(100 + percent) * apart <= (100 - percent) * (n[near] + n[u])]
            a.append(np.full(len(near), ids[u]))
            b.append(ids[near])
        a, b = np.concatenate(a), np.concatenate(b)
        T.release()
        key = [group.column(c)[:1] for c in ("cluster", "u", "v")]
        some = int(len(a) > 0)
        return pa.Table.from_arrays([*(x.slice(0, some) for x in key), pa.array([X.pack(a)] * some, pa.binary()), pa.array([X.pack(b)] * some, pa.binary())], ["cluster", "u", "v", "a", "b"])

    return run


def _counted(group: pa.Table) -> pa.Table:
    """In one fragment and block: the overlap of each candidate pair."""
    pairs = group.column("a").is_valid().to_numpy(zero_copy_only=False) if group.num_rows else np.zeros(0, bool)
    have = pa.array(~pairs)
    a, b = (np.concatenate([np.zeros(0, np.int64), *(X.unpack(x, np.int64) for x in group.column(c).filter(pa.array(pairs)).to_pylist())]) for c in "ab")
    ids = group.column("id").filter(have).to_numpy()
    sets = [np.frombuffer(x, np.int64) for x in group.column("segment").filter(have).to_pylist()]
    at = np.argsort(ids)
    ids = ids[at]
    place = lambda x: np.minimum(np.searchsorted(ids, x), max(0, len(ids) - 1))
    i, j = place(a), place(b)
    known = (ids[i] == a) & (ids[j] == b) if len(ids) else np.zeros(len(a), bool)
    i, j = i[known], j[known]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    same = np.zeros(len(i), np.int64)
    size = np.array([len(sets[k]) for k in at], np.int64)
    # runs of pairs with one left side and at most CHUNK entries on the right, a longer one alone
    upto, begin = np.cumsum(size[j]), 0
    while begin < len(i):
        base = upto[begin] - size[j[begin]]
        stop = max(begin + 1, min(int(np.searchsorted(i, i[begin], "right")), int(np.searchsorted(upto, base + CHUNK, "right"))))
        mine, some = sets[at[i[begin]]], j[begin:stop]
        every = np.concatenate([sets[at[k]] for k in some])
        spot = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        same[begin:stop] = np.add.reduceat((mine[spot] == every).astype(np.int64), np.cumsum(size[some]) - size[some])
        begin = stop
    some = same > 0
    out = pa.Table.from_arrays([pa.array(ids[i[some]]), pa.array(ids[j[some]]), pa.array(same[some])], ["a", "b", "same"])
    del sets, group
    T.release()
    return out


def shingle_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to; null without an id)."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = X.fragment_bits(size // 6)
    found = _sets(docs, words, bits).groupBy("frag").applyInArrow(_count, "src long, frag long, tokens binary, times binary, owners binary, hot_tokens binary, info array<binary>").groupBy("src").applyInArrow(_assemble(percent), "doc_id long, n long, c1 long, c2 long, first long, own long, tokens binary")
    sets = stored(found, "shingle-sets")
    live = sets.where("tokens is not null")
    classes = stored(live.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("id"), F.first("first").alias("first"), F.first("own").alias("own"), F.first("tokens").alias("tokens")), "shingle-classes")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, own, first, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                token = X.unpack(blob, np.int64)[:first]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), i)), pa.array(np.full(len(token), n)), pa.array(np.full(len(token), own))], ["token", "id", "n", "own"])

    entries = classes.select("id", "n", "own", "first", "tokens").mapInArrow(prefixes, "token long, id long, n long, own long")
    entries = stored(entries, "shingle-first")
    heads = entries.groupBy("token").agg(F.min(F.struct("own", "id")).alias("head"), F.count("*").alias("times")).where("times > 1").select("token", F.col("head.id").alias("head"), "times")
    common = stored(entries.join(heads, "token").select("token", "id", "n", "head", "times"), "shingle-common")
    tries = common.where("id <> head").groupBy("id", "head").agg(F.count("*").alias("hits")).groupBy("id").agg(F.max(F.struct("hits", F.col("head"))).alias("best")).select(F.col("best.head").alias("a"), F.col("id").alias("b"))
    pivots = _pivots(classes, bits)
    links = stored(_linked(_overlaps(tries, _segments(classes, pivots)), classes, percent), "shingle-links")
    part = star_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    part = stored(part, "shingle-parts")

    labelled = common.join(part, "id", "left").select("token", "id", "n", "head", "times", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("root")).where("low <> high").select("token", "root")
    open_ = stored(labelled.join(mixed, "token").select("id", "root", "component").distinct(), "shingle-open")
    cluster = stored(star_components(open_.select(F.col("id").alias("src"), F.col("root").alias("dst"))), "shingle-clusters")
    sized = open_.select("id", "component").distinct().join(cluster.withColumnRenamed("component", "cluster"), "id")
    biggest = sized.groupBy("cluster", "component").agg(F.count("*").alias("size")).groupBy("cluster").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"))
    placed = sized.join(biggest, "cluster").select("id", "component", "cluster", (F.col("component") != F.col("top.component")).alias("out"), F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("top.size")) / OUTSIDERS).alias("out_blocks"))
    placed = stored(placed.join(classes.select("id", "n", "own"), "id").join(classes.select("id", "first", "tokens").join(placed.select("id").distinct(), "id", "left_semi").mapInArrow(_signed, "id long, prefix binary, sign binary"), "id"), "shingle-placed")
    spot = lambda n: F.pmod(F.xxhash64("id"), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    members = placed.withColumn("v", spot(F.col("blocks"))).withColumn("u", upto(F.col("out_blocks"))).withColumn("outsider", F.lit(False))
    outsiders = placed.where("out").withColumn("u", spot(F.col("out_blocks"))).withColumn("v", upto(F.col("blocks"))).withColumn("outsider", F.lit(True))
    chosen = ["cluster", "u", "v", "id", "n", "own", "component", "out", "outsider", "prefix", "sign"]
    block = ["cluster", "u", "v"]
    asked = stored(members.select(*chosen).union(outsiders.select(*chosen)).groupBy(*block).applyInArrow(_candidates(percent), "cluster long, u long, v long, a binary, b binary"), "shingle-candidates")

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.unique(np.concatenate([X.unpack(a, np.int64), X.unpack(b, np.int64)]))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(ids), x)) for x in (cluster, u, v)), pa.array(ids)], [*block, "id"])

    held = asked.mapInArrow(sides, "cluster long, u long, v long, id long").join(_segments(classes, pivots), "id").select(*block, "frag", "id", "segment", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))
    every = asked.withColumn("frag", upto(F.lit(FRAGMENTS).cast("long"))).select(*block, "frag", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("segment"), "a", "b")
    more = _linked(held.union(every).groupBy(*block, "frag").applyInArrow(_counted, "a long, b long, same long"), classes, percent)
    parts = star_components(links.union(more).select(F.col("a").alias("src"), F.col("b").alias("dst")))

    named = live.join(classes.select("n", "c1", "c2", "id"), ["n", "c1", "c2"]).join(parts, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return sets.where("tokens is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")).union(named)
