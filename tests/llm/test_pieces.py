import random
import zlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor

from graphloom.llm import pieces as P
from graphloom.llm import textops as T
from graphloom.llm.chunks import ChunkCache
from graphloom.llm.queries import PIECES, tokenizer_path

TEXTS = ["", None, "a", "  two  spaces ", "Hé llo\tx\n12's don't", "日本語 テキスト 🙂🙂", "x" * 3000, "word " * 500, "▁mark", "ends\n\n", "\x00\x01 ünïcödé", "internationalization of tokenizers"]


def model():
    return P.pieces(tokenizer_path(PIECES))


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def unigram(seed):
    """A hand-made unigram model with byte pieces: random pieces over a small alphabet with random scores."""
    rng = random.Random(seed)
    names = {P.MARK, *"abcdeé日"}
    while len(names) < 120:
        names.add("".join(rng.choice(P.MARK + "abcdeé日本") for _ in range(rng.randrange(1, 6))))
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)] + [(x, -rng.uniform(1, 12), 1) for x in sorted(names)]
    made = b"".join(field(1, field(1, x) + field(2, s) + field(3, k)) for x, s, k in rows)
    return made + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, "identity") + field(3, 1) + field(4, 0) + field(5, 1))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unigram_ids_equal_library(seed):
    """Viterbi gives the ids of the public library for every text, unknown characters as bytes."""
    raw = unigram(seed)
    rng = random.Random(seed)
    texts = TEXTS + ["".join(rng.choice("abcdeé日本 🙂\n") for _ in range(rng.randrange(80))) for _ in range(300)]
    m, library = P.Pieces(raw), SentencePieceProcessor(model_proto=raw)
    assert P.model_type(raw) == 1
    check(m, library, texts)


def test_bpe_ids_equal_library():
    """Merges give the ids of the public library for every text of the tables."""
    m, library = model(), SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    rng = random.Random(3)
    odd = ["".join(rng.choice("aab  ér日🙂\t.,'") for _ in range(rng.randrange(60))) for _ in range(300)]
    check(m, library, TEXTS + texts + odd)


def check(m, library, texts):
    data, offsets = T.text_bytes(pa.array(texts))
    ids, per = m.encode(data, offsets)
    back, ends = m.decode(ids.astype(np.int64), per)
    at = 0
    for k, text in enumerate(texts):
        assert ids[at : at + per[k]].tolist() == library.encode(text or "")
        at += per[k]
        assert back[ends[k] : ends[k + 1]].tobytes().decode() == (text or "").replace(P.MARK, " ")


def test_a_shared_hash_is_found_out():
    """Two chunks of one hash get their own ids."""
    cache = ChunkCache()
    data = np.frombuffer(b"aabbaabb", np.uint8)
    solve = lambda d, a, b: (np.ones(len(a), np.int64), d[a].astype(np.uint32))
    starts = np.arange(0, 8, 2)
    cache.encode(data, starts, starts + 2, solve)
    cache.keys[:] = cache.keys[0]
    ids, sizes = cache.encode(data, starts[1:2], starts[1:2] + 2, solve)
    assert ids.tolist() == [98] and sizes.tolist() == [1]
    cache.clear()
    cache._add(np.unique(T.hash_spans(data, starts[1:2], starts[1:2] + 2)), np.ones(1, np.int64), np.array([5], np.uint32), data[:2], np.array([2]))
    assert cache.encode(data, starts[:2], starts[:2] + 2, solve)[0].tolist() == [97, 98]


def test_frames(spark):
    docs = spark.createDataFrame([(i, t, "kept", [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, ids array<int>")
    coded = P.encode_texts(docs, tokenizer_path(PIECES))
    assert coded.columns == ["doc_id", "text", "source", "ids"]
    back = {r.doc_id: r.text for r in P.decode_ids(coded, tokenizer_path(PIECES)).collect()}
    assert back == {i: (t or "").replace(P.MARK, " ") for i, t in enumerate(TEXTS)}
    assert all(r.round_trip for r in P.piece_digest(docs, tokenizer_path(PIECES)).collect())
    assert P.piece_digest(docs.limit(0), tokenizer_path(PIECES)).collect() == []


def plain_viterbi(m, known, text):
    """Ids and score of the best path of one text, character by character; the longest last piece of equals, a piece before bytes."""
    chars = [c.encode() for c in (" " + text if text else "")]
    best = [(0.0, None, ())] + [None] * len(chars)
    for end in range(1, len(chars) + 1):
        score, own = best[end - 1][0] + m.penalty, (end - 1, tuple(int(m.byte_ids[b]) for b in chars[end - 1]))
        options = []
        for start in range(max(0, end - m.longest), end):
            found = known.get(b"".join(chars[start:end]))
            if found:
                options.append((best[start][0] + found[1], start, (found[0],)))
        top = max(options, key=lambda o: (o[0], -o[1]), default=None)
        best[end] = (score, *own) if top is None or top[0] < score else top
    ids, at = [], len(chars)
    while at:
        ids = [*best[at][2], *ids]
        at = best[at][1]
    return ids, best[-1][0]


def test_viterbi_columns_equal_plain_viterbi(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"))
    m = P.Pieces(tokenizer_path(PIECES), viterbi=True)
    got = {r.doc_id: r for r in P.piece_digest(docs, tokenizer_path(PIECES)).collect()}
    texts = {r.doc_id: (r.text or "").replace(P.MARK, " ") for r in docs.collect()}
    assert got.keys() == texts.keys() and all(r.viterbi_trip and r.round_trip for r in got.values())
    some = [i for i, t in texts.items() if len(t) < 1500]
    assert len(some) > 70
    single = set(m.byte_ids.tolist())
    known = {m.table[a : a + n].tobytes(): (i, m.worth[i]) for i, (a, n) in enumerate(zip(m.table_starts.tolist(), m.table_sizes.tolist(), strict=True)) if n and i not in single}
    for i in some:
        ids, score = plain_viterbi(m, known, texts[i])
        assert got[i].n_viterbi == len(ids) and got[i].viterbi_score == pytest.approx(score, abs=1e-5), i
        assert got[i].viterbi_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()), i
