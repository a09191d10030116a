"""Class-based bigram language model (Brown classes found by exchange clustering) with add-one word counts.

1. Every task turns its texts into arrays: the distinct 64-bit hashes of its words, their counts in training texts, and
   the sequence of word numbers. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; one end token closes each text.
2. Seeds: the ITEMS most frequent words and one item for all others go through the exchange algorithm, which moves items
   between CLASSES classes while the likelihood of the class bigram grows.
3. Rounds over the whole training vocabulary: tasks count the classes before and after each of their words, the counts are
   dealt to fragments of the hash space and summed, and every word moves to the class whose neighbours' classes explain its
   own best. Each task's part gets its words' totals and classes back and counts the class bigrams of all training
   texts. Rounds end when the likelihood of the class bigram grows by less than GAIN of itself; the likeliest is kept.
4. P(w | before) = P(class(w) | class(before)) * P(w | class(w)). Transitions are smoothed with SMOOTH pseudo counts of
   the class unigram; emissions add one to each word, with one unseen word, so that the whole sums to 1. The unseen word
   is of the class with most words of count 1.

The numbers of seeds, classes and rounds are the model's size; word classes, their table and all counts come from all texts.

Defined cases: a null or empty text is one end token; documents without an id count as trained (crc32 of the empty
text); repeated rows are scored and counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import exchange as X
from graphloom.llm import textops as T
from graphloom.runtime import stored

ITEMS, CLASSES, ROUNDS, SMOOTH, GAIN = 500, 32, 8, 5.0, 0.01
FLUSH_WORDS = 2 << 20
END = np.uint64(0x9D39247E33776D41)


def _parts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            ids, missing, out, per, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, inverse = np.unique(hashes, return_inverse=True)
            train = np.repeat(~out, per)
            counts = np.bincount(inverse[train], minlength=len(keys)).astype(np.uint32)
            src = (TaskContext.get().partitionId() << 24) | number
            held, number = [], number + 1
            return pa.RecordBatch.from_pydict({"src": [src], "n_keys": [len(keys)], "keys": [X.pack(keys)], "counts": [X.pack(counts)], "seq": [X.pack(inverse.astype(np.uint32))], "ids": [X.pack(ids)], "missing": [X.pack(missing)], "held": [X.pack(out)], "per": [X.pack(per.astype(np.uint32))]})

        size = 0
        for batch in batches:
            for part in T.slices(batch):
                hashes, upto = T.hashed_words(*T.text_bytes(part.column(1)))
                hashes, upto = np.insert(hashes, upto[1:], END), upto + np.arange(len(upto))
                held.append((part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(part.column(0).is_null()), part.column(2).to_numpy(zero_copy_only=False).astype(bool), np.diff(upto), hashes))
                size += len(hashes)
                if size >= FLUSH_WORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        T.release()

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held"))
    blobs = "src long, n_keys long, " + ", ".join(f"{c} binary" for c in ("keys", "counts", "seq", "ids", "missing", "held", "per"))
    return stored(chosen.mapInArrow(run, blobs), "lm-parts")


def _frequent(parts: DataFrame, items: int, bits: int) -> np.ndarray:
    """The hashes of the most frequent words of training texts, ascending."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, counts = X.unpack(keys, np.uint64), X.unpack(counts, np.uint32)
                at = X.cuts(keys, bits)
                some = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_pydict({"frag": pa.array(some, pa.int64()), "keys": pa.array([keys[at[f] : at[f + 1]].tobytes() for f in some], pa.binary()), "counts": pa.array([X.pack(counts[at[f] : at[f + 1]]) for f in some], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        counts = np.concatenate([X.unpack(x, np.uint32) for x in group.column("counts").to_pylist()])
        every, inverse = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()]), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(every)).astype(np.int64)
        top = np.lexsort((every.view(np.int64), -total))[:items]
        return pa.Table.from_pydict({"key": pa.array(every[top].view(np.int64)), "n": pa.array(total[top])})

    dealt = parts.select("keys", "counts").mapInArrow(split, "frag long, keys binary, counts binary")
    best = dealt.groupBy("frag").applyInArrow(add, "key long, n long").where("n > 0").orderBy(F.col("n").desc(), "key").limit(items).collect()
    return np.sort(np.array([r.key for r in best], np.int64).view(np.uint64))


def _before(seq: np.ndarray, per: np.ndarray) -> np.ndarray:
    """What stands before each token; the end token of a text stands before its first."""
    stop = np.cumsum(per)
    out = np.concatenate([seq[:1], seq[:-1]])
    out[stop - per] = seq[stop - 1]
    return out


def _contexts(src: int, frags: list[int], at: np.ndarray, words: list[bytes], kind: np.ndarray, seq: np.ndarray, per: np.ndarray, held: np.ndarray, classes: int) -> dict[str, list]:
    """By fragment (each from one of at to the next): a part's words, their classes, and how often which class follows (slot 0 on) or precedes (slot classes on) them in training texts."""
    wide, train = 2 * classes, np.repeat(~held, per)
    number = np.int32 if len(kind) * wide < 1 << 31 else np.int64
    word, last = seq[train].astype(number), _before(seq, per)[train].astype(number)
    code = np.concatenate([last * number(wide) + kind[word], word * number(wide) + number(classes) + kind[last]])
    code.sort()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    code, n = code[first], np.diff(np.append(first, len(code))).astype(np.uint32)
    upto = np.searchsorted(code, at * wide)
    piece = lambda x, ends: [x[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return {"frag": frags, "src": [src] * len(frags), "words": words, "kind": [X.pack(x) for x in piece(kind, at)], "code": [X.pack((x - i * wide).astype(np.uint32)) for i, x in zip(at[:-1], piece(code, upto), strict=True)], "n": [X.pack(x) for x in piece(n, upto)]}


FRAME = pa.schema([("frag", pa.int64()), ("src", pa.int64()), *((c, pa.binary()) for c in ("words", "kind", "code", "n"))])
CODED = pa.schema([*FRAME, *((c, pa.binary()) for c in ("ids", "missing", "held", "per", "kinds", "known", "logs", "pairs"))])
DEALT = "frag long, src long, words binary, kind binary, code binary, n binary"


def _moved(contexts: DataFrame, grid: np.ndarray, smooth: float, hashed: bool) -> tuple[DataFrame, np.ndarray]:
    """Every word in the class that explains its neighbours' classes best: totals (a), classes (b) and numbers (c) of each part's words in a fragment. The contexts' words are hashes, or their numbers of an earlier round. And sums by class: counts plus one, words, words of count 1."""
    classes = len(grid)
    wide = 2 * classes
    after, ahead = ((g.sum(0) + 1) / (g.sum() + classes) for g in (grid, grid.T))
    follow = np.log((grid + smooth * after) / (grid.sum(1, keepdims=True) + smooth))
    precede = np.log((grid.T + smooth * ahead) / (grid.T.sum(1, keepdims=True) + smooth))
    explain = np.concatenate([follow.T, precede.T])

    def move(group: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) if hashed else X.unpack(x, np.uint32) for x in group.column("words").to_pylist()]
        ends, inverse = np.cumsum([0, *map(len, words)]), np.concatenate(words)
        if hashed:
            inverse = np.unique(inverse, return_inverse=True)[1]
        inverse = inverse.astype(np.int64)
        size = int(inverse.max()) + 1
        kind = np.zeros(size, np.uint8)
        kind[inverse] = np.concatenate([X.unpack(x, np.uint8) for x in group.column("kind").to_pylist()])
        code = []
        for x, begin in zip(group.column("code").to_pylist(), ends, strict=False):
            own = X.unpack(x, np.uint32).astype(np.int64)
            code.append(inverse[begin + own // wide] * wide + own % wide)
        code, n = np.concatenate(code), np.concatenate([X.unpack(x, np.uint32) for x in group.column("n").to_pylist()])
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        total = np.zeros(size, np.int64)
        for lo in range(0, size, 1 << 15):
            hi = min(lo + (1 << 15), size)
            i, j = np.searchsorted(code, [lo * wide, hi * wide])
            around = np.bincount(code[i:j] - lo * wide, weights=n[i:j], minlength=(hi - lo) * wide).reshape(-1, wide)
            total[lo:hi] = around[:, :classes].sum(1)
            worth = around @ explain
            best, own = worth.argmax(1), kind[lo:hi].astype(np.int64)
            row = np.arange(hi - lo)
            kind[lo:hi] = np.where(worth[row, best] > worth[row, own] + 1e-9, best, own)
        seen = total > 0
        sums = np.stack([np.bincount(kind[seen], weights=total[seen] + 1, minlength=classes), np.bincount(kind[seen], minlength=classes), np.bincount(kind[total == 1], minlength=classes)])
        back = [(X.pack(total[x]), X.pack(kind[x]), X.pack(x.astype(np.uint32))) for x in np.split(inverse, ends[1:-1])]
        T.release()
        return pa.Table.from_pydict({"src": pa.array([*group.column("src").to_pylist(), -1], pa.int64()), "frag": pa.array([group.column("frag")[0].as_py()] * (len(back) + 1), pa.int64()), **{c: pa.array([*x, last], pa.binary()) for c, x, last in zip("abc", zip(*back, strict=True), (sums.astype(np.int64).tobytes(), b"", b""), strict=True)}})

    rows = stored(contexts.groupBy("frag").applyInArrow(move, "src long, frag long, a binary, b binary, c binary"), "lm-classes")
    return rows.where("src >= 0"), _summed(rows.where("src < 0").select("a"), 3 * classes).reshape(3, classes)


def _summed(blobs: DataFrame, size: int) -> np.ndarray:
    """The sum of equally long integer arrays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                total += np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(size)), "n": pa.array(total)})

    out = np.zeros(size, np.int64)
    for slot, n in blobs.mapInArrow(sums, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out


def likelihood(grid: np.ndarray) -> float:
    """Of the class bigram, against independent classes: the part of the log-likelihood that classes change."""
    phi = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return phi(grid) - phi(grid.sum(0)) - phi(grid.sum(1)) + phi(grid.sum())


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each item from the matrix of item bigrams: items move to the class that makes the class bigram likeliest, in order of frequency, until none moves."""
    n = len(pairs)
    if not n:
        return np.zeros(0, np.int64)
    phi = lambda x: x * np.log(np.maximum(x, 1e-300))
    rank = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    of = np.zeros(n, np.int64)
    k = min(classes, n)
    of[rank] = np.minimum(np.arange(n), k - 1)
    one = np.zeros((n, k))
    one[np.arange(n), of] = 1
    grid = one.T @ pairs @ one
    for _ in range(rounds):
        moved = 0
        for w in rank:
            a = of[w]
            right, left, same = pairs[w] @ one, pairs[:, w] @ one, pairs[w, w]
            right[a] -= same
            left[a] -= same
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] -= same
            row, column = grid.sum(1) + left, grid.sum(0) + right  # wherever w goes, its neighbours keep their classes
            gain = (phi(grid + right[None, :]) - phi(grid)).sum(1) + (phi(grid + left[:, None]) - phi(grid)).sum(0)
            own = np.diag(grid)
            gain += phi(own + right + left + same) - phi(own + right) - phi(own + left) + phi(own)
            gain -= phi(row + right.sum() + same) - phi(row) + phi(column + left.sum() + same) - phi(column)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            one[w, a], one[w, b], of[w] = 0, 1, b
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += same
        if not moved:
            break
    return of


def _seeds(parts: DataFrame, words: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the frequent words and, last, of all others; and their class bigrams over all training texts."""
    size = len(words) + 1

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                per = X.unpack(r["per"], np.uint32).astype(np.int64)
                item = _item(words, X.unpack(r["keys"], np.uint64))[X.unpack(r["seq"], np.uint32)]
                train = np.repeat(~X.unpack(r["held"], np.bool_), per)
                pair, n = np.unique(_before(item, per)[train] * size + item[train], return_counts=True)
                yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(n)})

    pairs = np.zeros((size, size))
    found = parts.select("keys", "seq", "held", "per").mapInArrow(bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most seeds squared rows
    pairs[found.pair.to_numpy(np.int64) // size, found.pair.to_numpy(np.int64) % size] = found.n
    of = exchange(pairs, classes)
    one = np.zeros((size, int(of.max()) + 1))
    one[np.arange(size), of] = 1
    return of, one.T @ pairs @ one


def _item(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Number of each key among the words; their number for others."""
    if not len(words):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
    return np.where(words[at] == keys, at, len(words))


def lm_scores(docs: DataFrame, items: int = ITEMS, classes: int = CLASSES, smooth: float = SMOOTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (10 to the negative score a token) of every document."""
    parts = _parts(docs)
    bits = X.fragment_bits(parts.agg(F.sum("n_keys")).first()[0] or 0)
    words = _frequent(parts, items, bits)
    of, grid = _seeds(parts, words, classes)
    k = len(grid)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = X.unpack(r["keys"], np.uint64)
                at = X.cuts(keys, bits)
                some = np.flatnonzero(np.diff(at))
                hashes = [keys[at[f] : at[f + 1]].tobytes() for f in some]
                yield pa.RecordBatch.from_pydict(_contexts(r["src"], some.tolist(), np.append(at[some], len(keys)), hashes, of[_item(words, keys)].astype(np.uint8), X.unpack(r["seq"], np.uint32), X.unpack(r["per"], np.uint32).astype(np.int64), X.unpack(r["held"], np.bool_), k), FRAME)

    def assemble(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        part = next(r for r in rows if r["frag"] < 0)
        back = sorted((r for r in rows if r["frag"] >= 0), key=lambda r: r["frag"])
        seq, totals = X.unpack(part["seq"], np.uint32), [X.unpack(r["a"], np.int64) for r in back]
        at, total = np.cumsum([0, *map(len, totals)]), np.concatenate(totals)
        kind = np.concatenate([X.unpack(r["b"], np.uint8) for r in back])
        kind[total == 0] = unseen
        held, per = X.unpack(part["held"], np.bool_), X.unpack(part["per"], np.uint32).astype(np.int64)
        begin, train = np.cumsum(per) - per, np.repeat(~held, per)
        known = np.add.reduceat((total > 0).astype(np.int64)[seq], begin)
        logs = np.add.reduceat(np.log10(total + 1.0)[seq], begin)
        kinds = kind[seq]
        pairs = np.bincount(_before(kinds, per)[train].astype(np.int64) * k + kinds[train], minlength=k * k).astype(np.int64)
        out = _contexts(part["src"], [r["frag"] for r in back], at, [r["c"] for r in back], kind, seq, per, held, k)
        size = len(out["frag"])
        own = {"ids": part["ids"], "missing": part["missing"], "held": part["held"], "per": part["per"], "kinds": X.pack(kinds), "known": X.pack(known), "logs": logs.tobytes(), "pairs": pairs.tobytes()}
        T.release()
        return pa.Table.from_pydict({c: [*x, -1 if c in ("frag", "src") else None] for c, x in out.items()} | {c: [None] * size + [x] for c, x in own.items()}, CODED)

    none = [F.lit(None).cast("binary").alias(c) for c in ("seq", "ids", "missing", "held", "per")]
    info = parts.select("src", F.lit(-1).cast("long").alias("frag"), *(F.lit(None).cast("binary").alias(c) for c in "abc"), "seq", "ids", "missing", "held", "per")
    contexts, best, coded = parts.select("src", "keys", "seq", "held", "per").mapInArrow(start, DEALT), None, None
    for _ in range(ROUNDS):
        back, sums = _moved(contexts, grid, smooth, best is None)
        unseen = int(sums[2].argmax())
        coded = stored(info.unionByName(back.select("src", "frag", "a", "b", "c", *none)).groupBy("src").applyInArrow(assemble, DEALT + "".join(f", {f.name} binary" for f in CODED if f.name not in FRAME.names)), "lm-coded")
        grid = _summed(coded.where("frag < 0").select("pairs"), k * k).reshape(k, k).astype(float)
        value, last = likelihood(grid), best[0] if best else -np.inf
        if value > last:
            best = value, coded, grid, sums, unseen
        if value - last <= GAIN * abs(value):
            break
        contexts = coded.where("frag >= 0").select(*FRAME.names)
    _, coded, grid, sums, unseen = best
    share = (grid.sum(0) + 1) / (grid.sum() + k)
    step = np.log10((grid + smooth * share[None, :]) / (grid.sum(1, keepdims=True) + smooth))
    mass = sums[0].astype(float)  # tokens plus one for each word
    mass[unseen] += 1
    n_all, v_all = int(sums[0].sum() - sums[1].sum()), int(sums[1].sum())
    step = step - np.log10(np.maximum(mass, 1))[None, :]
    base = np.log10(n_all + v_all + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                per, kind = X.unpack(r["per"], np.uint32).astype(np.int64), X.unpack(r["kinds"], np.uint8)
                begin, logs = np.cumsum(per) - per, np.frombuffer(r["logs"])
                total = logs + np.add.reduceat(step[_before(kind, per), kind], begin)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(X.unpack(r["ids"], np.int64), mask=X.unpack(r["missing"], np.bool_)), "held_out": pa.array(X.unpack(r["held"], np.bool_)), "n_tokens": pa.array(per), "n_known": pa.array(X.unpack(r["known"], np.int64)), "train_tokens": pa.array(np.full(len(per), n_all)), "base_score": pa.array(logs - per * base), "score": pa.array(total), "perplexity": pa.array(10.0 ** np.minimum(300, -total / per))})

    chosen = coded.where("frag < 0").select("ids", "missing", "held", "per", "kinds", "known", "logs")
    return chosen.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
