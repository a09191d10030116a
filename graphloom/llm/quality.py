"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (the last one shorter); every passage of the whole text is encoded: shares of
character classes, word lengths, repeated, capital and decorated words, all by numpy over whole batches. Labels
belong to documents only: a gated attention network (tanh and sigmoid gates) learns how much each passage counts, and the
document's score is the logistic of the attention-weighted sum of passage embeddings.

Fitting uses at most TRAIN_ROWS labelled documents (the least by a hash of doc_id) whose crc32(doc_id as text) mod 5 is not
0, one text of each (the least by its hash, if rows repeat an id), and of a longer text TRAIN_PASSAGES passages at even
steps; these bounds are the one sample. Scoring covers every passage of every document. Labels, lang, source and doc_id are
never inputs.

Defined cases: a null or empty text is one empty passage and has a score; labels that are null, or of other documents, are
ignored; a document labelled twice counts with its greatest label; without labels of both kinds the score is the share of
label 1 (0.5 without any); documents without an id count as crc32 of the empty text and are scored; repeated rows
get equal scores; other columns are kept by keep_good() and ignored otherwise; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as T

PASSAGE, TRAIN_ROWS, TRAIN_PASSAGES, THRESHOLD = 64, 6000, 64, 0.3
HIDDEN, GATE, EPOCHS, RATE, DECAY = 16, 8, 60, 0.01, 1e-4

KINDS = np.full(256, 12, np.int64)  # other punctuation and control characters
for _k, _set in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".", ",;:", "!?", "|", "*#$%&", "@=_/\\<>{}[]", "-'\"()")):
    KINDS[[ord(c) for c in _set]] = _k
KINDS[128:] = 13
N_KINDS = 14
FEATURES = N_KINDS + 9


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the n + 1 offsets of each text's passages (one at least)."""
    starts, ends, per = T.words(data, offsets)
    count = np.diff(per)
    parts = np.maximum(1, -(-count // size))
    upto = np.concatenate([[0], np.cumsum(parts)])
    total = int(upto[-1])
    text = np.repeat(np.arange(len(count)), parts)
    within = np.arange(total) - upto[text]
    first = per[text] + within * size  # the passage's first word
    begin = np.where(within == 0, offsets[text], starts[np.minimum(first, max(0, len(starts) - 1))] if len(starts) else offsets[text])
    byte_of = np.repeat(np.arange(total), np.diff(np.append(begin, len(data))))
    out = np.zeros((total, FEATURES))
    kinds = KINDS[data]
    shares = np.bincount(byte_of * N_KINDS + kinds, minlength=total * N_KINDS).reshape(total, N_KINDS).astype(float)
    n_bytes = shares.sum(1)
    out[:, :N_KINDS] = np.sqrt(shares / np.maximum(n_bytes, 1)[:, None])
    n_words = np.minimum(count[text] - within * size, size).clip(0)
    if len(starts):
        owner = np.repeat(np.arange(total), n_words)
        length = ends - starts
        add = lambda x: np.bincount(owner, weights=x, minlength=total) / np.maximum(n_words, 1)
        last, lead = kinds[ends - 1], kinds[starts]
        hashes = T.hash_spans(T.LOWER[data], starts, ends)
        order = np.lexsort((hashes, owner))
        again = np.zeros(len(order))
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        columns = [add(length) / 10, add(length > 12), add(again), add(last == 7), add(last == 9), add((lead == 1) & (last != 0) & (length > 2)), add((length == 1) & (lead == 8)), add(lead == 1)]
        for k, x in enumerate(columns):
            out[:, N_KINDS + k] = x
    out[:, N_KINDS + 8] = np.log1p(n_words) / 4
    return out, upto


def _spread(bag: np.ndarray) -> np.ndarray:
    """At most TRAIN_PASSAGES rows at even steps."""
    return bag if len(bag) <= TRAIN_PASSAGES else bag[np.arange(TRAIN_PASSAGES) * len(bag) // TRAIN_PASSAGES]


def _features(docs: DataFrame, label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                out, upto = passages(*T.text_bytes(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([_spread(out[a:b]).astype(np.float32).tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.binary()), part.column(1)], ["bag", label])

    return docs.mapInArrow(run, f"bag binary, {label} int")


class Attention:
    """Gated attention over the passages of a bag; plain numpy, fitted with Adam."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        make = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"w1": make(FEATURES, HIDDEN), "b1": np.zeros(HIDDEN), "v": make(HIDDEN, GATE), "u": make(HIDDEN, GATE), "a": make(GATE, 1), "w2": make(HIDDEN, 1), "b2": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None

    def forward(self, x: np.ndarray, upto: np.ndarray) -> dict:
        p = self.p
        begin, sizes = upto[:-1], np.diff(upto)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s @ p["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), sizes))
        a = e / np.repeat(np.add.reduceat(e, begin), sizes)
        z = np.add.reduceat(a[:, None] * h, begin)
        y = 1 / (1 + np.exp(-np.clip(z @ p["w2"] + p["b2"], -30, 30)[:, 0]))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "sizes": sizes, "begin": begin}

    def score(self, x: np.ndarray, upto: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(upto) - 1, self.constant)
        return self.forward(x, upto)["y"]

    def gradient(self, x: np.ndarray, upto: np.ndarray, label: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, upto)
        d_y = (f["y"] - label)[:, None] / len(label)
        d_z = np.repeat(d_y @ p["w2"].T, f["sizes"], axis=0)
        d_h = f["a"][:, None] * d_z
        d_a = (f["h"] * d_z).sum(1)
        d_e = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, f["begin"]), f["sizes"]))
        d_g = d_e[:, None] @ p["a"].T
        d_t, d_s = d_g * f["s"] * (1 - f["t"] ** 2), d_g * f["t"] * f["s"] * (1 - f["s"])
        d_h = (d_h + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w1": f["x"].T @ d_h, "b1": d_h.sum(0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_s, "a": (f["t"] * f["s"]).T @ d_e[:, None], "w2": f["z"].T @ d_y, "b2": d_y.sum(0)}

    def fit(self, bags: list[np.ndarray], label: np.ndarray) -> Attention:
        if len(set(label.tolist())) < 2:
            self.constant = float(label.mean()) if len(label) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        r, batch, step = np.random.default_rng(11), 256, 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                sizes = np.array([len(bags[i]) for i in some])
                found = self.gradient(np.concatenate([bags[i] for i in some]), np.concatenate([[0], np.cumsum(sizes)]), label[some])
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
                for k, g in found.items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _held(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Attention:
    """The model learned from at most that many labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label")).where(~_held())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `most` rows
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(((r.bag, r.label) for r in _features(texts.select("text", "label"), "label").collect()), key=lambda r: (r[0], r[1]))
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES).astype(float) for b, _ in rows]
    return Attention().fit(bags, np.array([y for _, y in rows], float))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                score = model.score(*passages(*T.text_bytes(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _held().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    model = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                keep = model.score(*passages(*T.text_bytes(part.column(part.schema.get_field_index("text"))))) >= threshold
                yield part.filter(pa.array(keep))
        T.release()

    return docs.mapInArrow(run, docs.schema)
