"""Periodic runs of words: where a text repeats itself at once, found by comparing the text with itself at every lag.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least max(12, 2 q) words,
which no neighbouring word extends. Words are numbered within their text and bit b of all numbers is one big integer, a
bit plane. For a lag p the planes are XORed with themselves shifted by p and the differences ORed: the zero bits are the
places whose word stands again p words later. A run of that period is a stretch of at least max(12 - p, p) zeros, and
ANDing the zeros with themselves shifted by 1, 2, 4, ... leaves one bit for each place where such a stretch begins.

* Four planes of hashed numbers are compared first: they never hide a stretch. Only lags that leave something there
  are compared on all planes. From lag 512 on, texts of 4,096 words and more are looked at in every 64th place first, where a
  stretch of p zeros leaves at least p // 64.
* A stretch that a smaller lag q dividing p has left already isn't p's own: the smallest period of a stretch of two
  periods or more divides all its periods up to half its length.

Defined cases: a null or empty text has no words; repeated rows give equal rows, one for each; a null doc_id is kept; texts of
any length are whole; other columns play no part in the digests and are kept by collapse_runs; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as T

MIN_LENGTH, FILTERS, COARSE, COARSE_LAG, COARSE_WORDS = 12, 4, 64, 512, 4096


def number_words(words: list[bytes]) -> np.ndarray:
    """Numbers of the words in order of first occurrence: equal exactly where the words are."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _plane(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _lasting(zeros: int, length: int) -> int:
    """The places where at least that many set bits follow each other."""
    have = 1
    while zeros and have < length:
        step = min(have, length - have)
        zeros &= zeros >> step
        have += step
    return zeros


def _stretches(places: int, length: int) -> list[tuple[int, int]]:
    """Starts and ends of the maximal stretches that leave these places after _lasting."""
    size = (places.bit_length() + 7) // 8
    bits = np.unpackbits(np.frombuffer(places.to_bytes(size, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(bits, prepend=0, append=0).astype(np.int8))
    return list(zip(edge[::2].tolist(), (edge[1::2] + length - 1).tolist(), strict=True))


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run as (start, length, period), by start, then period."""
    n = len(ids)
    if n < MIN_LENGTH:
        return []
    codes = T.mix(ids.astype(np.uint64) + np.uint64(1))
    marks = [((codes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) for b in range(FILTERS)]
    a, b, c, d = (_plane(m) for m in marks)
    exact = [_plane((ids >> k) & 1) for k in range(int(ids.max()).bit_length())]
    spread = [[_plane(m[r::COARSE]) for m in marks] for r in range(COARSE)] if n >= COARSE_WORDS else []
    found: dict[tuple[int, int], int] = {}
    wide: list[tuple[int, int, int]] = []  # runs that hold four periods: they show at multiples of their own lag as well
    for p in range(1, n // 2 + 1):
        if spread and p >= COARSE_LAG:
            step, need = COARSE, p // COARSE
            (e, f, g, h), (i, j, k, m), by = spread[0], spread[p % COARSE], p // COARSE
            other = (e ^ (i >> by)) | (f ^ (j >> by)) | (g ^ (k >> by)) | (h ^ (m >> by))
        else:
            step, need = 1, max(MIN_LENGTH - p, p)
            other = (a ^ (a >> p)) | (b ^ (b >> p)) | (c ^ (c >> p)) | (d ^ (d >> p))
        full = (1 << -((p - n) // step)) - 1
        left = _lasting(full & ~other, need)
        for start, end, q in wide if left else ():
            if p % q == 0 and end - start >= 2 * p:
                low, high = -(-start // step), (end - p - 1) // step - need + 2
                if high > low:
                    left &= ~(((1 << (high - low)) - 1) << low)
        if not left:
            continue
        need, other = max(MIN_LENGTH - p, p), 0
        for x in exact:
            other |= x ^ (x >> p)
        left = _lasting(((1 << (n - p)) - 1) & ~other, need)
        for start, upto in _stretches(left, need) if left else ():
            span = (start, upto + p)
            if span not in found:
                found[span] = p
                if upto + p - start >= 4 * p:
                    wide.append((*span, p))
    return sorted(((start, end - start, p) for (start, end), p in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for each of n words that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _spread_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the digest: a tenth of the documents, chosen by the checksum of its id, repeat a part of themselves."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[bytes]]]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            yield doc_id, text.split() if text else []  # bytes are split at x20 and x09 to x0D


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def run_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and runs (start, length, period, in words) of every whole text as it is."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, len(w), [dict(zip(("start", "length", "period"), r, strict=True)) for r in find_runs(number_words(w))]) for i, w in _texts(batches))
        yield from _batched(rows, schema)

    return _plain(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """All columns of docs; of each run only the first period stays in text, whose words one space then joins. A text without a run stays as it is."""
    names, place = docs.columns, docs.columns.index("text")

    def shorter(text: str | None) -> str | None:
        words = text.encode().split() if text else []
        runs = find_runs(number_words(words))
        return b" ".join(w for w, k in zip(words, kept_words(len(words), runs), strict=True) if k).decode() if runs else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([shorter(t) for t in columns[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def _digest(doc_id: int | None, words: list[bytes]) -> tuple:
    words = _spread_words(doc_id, words)
    runs = find_runs(number_words(words))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    left = b" ".join(w for w, k in zip(words, kept_words(len(words), runs), strict=True) if k) if runs else b" ".join(words)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256 of every document.

    Words are those of _spread_words: documents whose id's checksum is divisible by ten repeat a part of their words.
    """
    whole = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")
    schema = pa.schema([(c, pa.int64()) for c in whole] + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched((_digest(i, w) for i, w in _texts(batches)), schema)

    return _plain(docs).mapInArrow(run, ", ".join(f"{c} long" for c in whole) + ", runs_sha256 string, collapsed_sha256 string")
