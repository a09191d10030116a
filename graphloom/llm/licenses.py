"""License scans by diagonal voting: license templates are found in whole texts, with words missing, added or changed.

1. Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text (A-Z). Every run of GRAM words, and of fewer for templates of fewer words, is
   hashed; the hashes of all documents, a row each, are joined with the places of the templates' runs.
2. A hit at word d of a document and word t of a template votes for the diagonal d - t: the place where the template would begin.
   Votes are counted for each (document, template, diagonal). Neighbouring diagonals, at most SLACK words apart with hits that follow
   each other, are one candidate: a missing or added word moves the hits behind it to the next diagonal.
3. Candidates are verified on the words. An exact template (a phrase) has to stand there word by word, each place its own span; of
   another one at least COVERAGE of its words have to stand there in order (longest common subsequence).

A template is (label, text, exact). Templates are parameters of bounded size: up to MOST_PLACES places their hashes are broadcast,
beyond that the join shuffles. Only documents that hold a hash of a template travel to their candidates.

Defined cases: null and empty texts have no words and no span; repeated rows are one document's and each come back; a null doc_id
is kept; whole texts of any length are read, in rows of at most CHUNK hashes; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import textops as T

GRAM, SLACK, COVERAGE, VOTES, CHUNK, MOST_PLACES = 4, 8, 0.75, 0.1, 4096, 50_000
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True


class Template(NamedTuple):
    label: str
    text: str
    exact: bool = False


# The four phrases that are found word by word, and their labels.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]

# Notices that these licenses ask to be put on works, as their publishers word them.
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
]


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, and the n + 1 offsets of each text's words."""
    data, offsets = T.text_bytes(column)
    data = T.LOWER[data]
    starts, ends = T.runs(INSIDE[data], offsets)
    return data, starts, ends, np.searchsorted(starts, offsets)


def _grams(hashes: np.ndarray, per: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words that lies in one text, and the word it starts at."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(len(hashes) - k + 1, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - k + 1 + j]
    owner = np.repeat(np.arange(len(per) - 1), np.diff(per))
    start = np.flatnonzero(owner[: len(total)] == owner[k - 1 :])
    return T.mix(total[start]), start


def words_of(text: str) -> list[bytes]:
    data, starts, ends, _ = _split(pa.array([text], pa.large_string()))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _places(templates: Sequence[Template], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Hash, template and place of all runs of the templates, and the lengths of run in use."""
    data, starts, ends, per = _split(pa.array([t.text for t in templates], pa.large_string()))
    hashes, sizes = T.hash_spans(data, starts, ends), np.minimum(np.diff(per), gram)
    keys, whose, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in (lengths := [int(x) for x in np.unique(sizes) if x]):
        found, start = _grams(hashes, per, k)
        owner = np.searchsorted(per, start, "right") - 1
        keep = sizes[owner] == k
        keys, whose, where = [*keys, found[keep]], [*whose, owner[keep]], [*where, (start - per[owner])[keep]]
    return np.concatenate(keys), np.concatenate(whose), np.concatenate(where), lengths


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a word of b at a time over a bit for each word of a."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for w in b:
        hit = open_ & at.get(w, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _hashed(docs: DataFrame, lengths: list[int], chunk: int) -> DataFrame:
    """doc_id, text_key, base and grams: the hashes of all runs of a text from word base on, a row for each chunk and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                data, starts, ends, per = _split(part.column(2))
                hashes = T.hash_spans(data, starts, ends)
                for k in lengths:
                    found, start = _grams(hashes, per, k)
                    owner = np.searchsorted(per, start, "right") - 1
                    base = start - per[owner]
                    first = np.flatnonzero(base % chunk == 0)
                    cut = np.append(first, len(found)).astype(np.int32)
                    rows = pa.array(owner[first])
                    listed = pa.ListArray.from_arrays(pa.array(cut), pa.array(found.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(base[first]), listed], ["doc_id", "text_key", "base", "grams"])
        T.release()

    return docs.mapInArrow(run, "doc_id long, text_key long, base long, grams array<long>")


def license_candidates(keyed: DataFrame, templates: Sequence[Template], gram: int = GRAM, slack: int = SLACK, votes: float = VOTES) -> DataFrame:
    """doc_id, text_key, template, low and high: where a template may begin, by the votes of merged neighbouring diagonals."""
    spark = keyed.sparkSession
    keys, whose, where, lengths = _places(templates, gram)
    places = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(keys.view(np.int64), whose, where, strict=True)], "hash long, template int, place int")
    sizes = [len(words_of(t.text)) for t in templates]
    needed = [max(1, n - min(n, gram) + 1) for n in sizes]
    known = spark.createDataFrame([(i, t.exact, float(m if t.exact else max(1.0, votes * m))) for i, (t, m) in enumerate(zip(templates, needed, strict=True))], "template int, exact boolean, needed double")
    hits = _hashed(keyed, lengths, CHUNK).select("doc_id", "text_key", "base", F.posexplode("grams").alias("at", "hash"))
    hits = hits.join(F.broadcast(places) if len(keys) <= MOST_PLACES else places, "hash").select("doc_id", "text_key", "template", "place", (F.col("base") + F.col("at") - F.col("place")).alias("diagonal"))
    # the same hit of repeated rows is one vote
    diagonals = hits.groupBy("doc_id", "text_key", "template", "diagonal").agg(F.count_distinct("place").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"))
    marked = diagonals.join(F.broadcast(known) if len(templates) <= MOST_PLACES else known, "template")
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    gap = (F.col("diagonal") - F.lag("diagonal").over(order) > slack) | (F.col("diagonal") + F.col("first") - F.lag(F.col("diagonal") + F.col("last")).over(order) > slack + gram)
    begins = marked.withColumn("begins", F.when(F.col("exact") | F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    merged = begins.withColumn("group", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("doc_id", "text_key", "template", "group").agg(F.sum("votes").alias("votes"), F.first("needed").alias("needed"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    return merged.where("votes >= needed").select("doc_id", "text_key", "template", "low", "high")


def license_spans(docs: DataFrame, templates: Sequence[Template] | None = None, gram: int = GRAM, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words and spans of every row: array<struct<label, start, end, coverage, exact>>, words from 0, end exclusive, by start."""
    templates = [*PHRASES, *NOTICES] if templates is None else list(templates)
    keyed = _keyed(docs)
    keys, _, _, lengths = _places(templates, gram)
    keys = np.unique(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                data, starts, ends, per = _split(part.column(2))
                hashes, held = T.hash_spans(data, starts, ends), np.zeros(part.num_rows, bool)
                for k in lengths:
                    found, start = _grams(hashes, per, k)
                    at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
                    held[np.searchsorted(per, start[keys[at] == found] if len(keys) else start[:0], "right") - 1] = True
                texts = pa.array([t if h else None for t, h in zip(part.column(2).to_pylist(), held.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(per)), texts], ["doc_id", "text_key", "n_words", "text"])
        T.release()

    wanted = [words_of(t.text) for t in templates]

    def verified(text: str, candidates: list[dict]) -> list[dict]:
        words, found = words_of(text), {}
        for c in candidates:
            own, label, exact = wanted[c["template"]], templates[c["template"]].label, templates[c["template"]].exact
            low, high = max(0, c["low"]), min(len(words), c["high"] + len(own))
            share = float(words[low:high] == own) if exact else common_words(own, words[low:high]) / len(own)
            if share >= coverage:
                key = (low, high, label, exact)
                found[key] = max(share, found.get(key, 0.0))
        return [dict(zip(("label", "start", "end", "coverage", "exact"), (k[2], k[0], k[1], found[k], k[3]), strict=True)) for k in sorted(found)]

    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()), ("exact", pa.bool_())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([verified(t, c) if t and c else [] for t, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], ["doc_id", "n_words", "spans"])

    candidates = license_candidates(keyed, templates, gram, slack).groupBy(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).agg(F.collect_list(F.struct("template", "low", "high")).alias("candidates"))
    texts = keyed.mapInArrow(read, "doc_id long, text_key long, n_words long, text string")
    joined = texts.join(candidates, F.col("text_key").eqNullSafe(F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    return joined.select("doc_id", "n_words", "text", "candidates").mapInArrow(verify, "doc_id long, n_words long, spans array<struct<label: string, start: long, end: long, coverage: double, exact: boolean>>")


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (greatest coverage of a span, else 0) of every document."""
    found = license_spans(docs).withColumn("base", F.filter("spans", lambda s: s["exact"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(c)["label"])), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["start"]).alias("first_word"),
        F.array_max(F.col("base")["start"]).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.col("spans")["coverage"]), F.lit(0.0)).alias("score"),
    )
