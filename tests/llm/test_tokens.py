import io
import zlib

import numpy as np
import pytest

from graphloom.llm import tokens
from graphloom.llm.queries import TOKENIZER, tokenizer_path

TEXTS = ["", None, "a", " a  b\n\n\tc ", "Hé llo    x 12's don't", "<|endoftext|> x", "hello <|endoftext|> world", "a <|endoftext |> b", "x<|endoftext|><|endoftext|>", "word " * 9000, "日本語 テキスト　です", "\n", "a", "ab\u0085\u0085 c", "🙂 🙂\r\n\r\n  y"]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 + 1, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, None)]


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digest_equals_library(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, start string, n_tokens int")
    got = [tuple(r) for r in tokens.token_digest(docs, tokenizer_path(TOKENIZER)).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_empty_table(spark):
    assert tokens.token_digest(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(TOKENIZER)).collect() == []


def test_reads_only_the_wanted_frame_and_checks_it():
    sink = io.BytesIO()
    ids = np.arange(1000, dtype=np.uint32)
    per = np.array([100, 0, 400, 300, 200])
    assert tokens.write_shard(sink, [(np.arange(5), ids, per)], frame_ids=256) == (5, 1000)
    shard = tokens.Shard(sink)
    ends = np.cumsum(per)
    for i in (4, 0, 2, 1, 3):
        assert shard.read(i).tolist() == ids[ends[i] - per[i] : ends[i]].tolist()
    assert [x.tolist() for x in shard] == [ids[e - n : e].tolist() for e, n in zip(ends, per, strict=True)]
    raw = bytearray(sink.getvalue())
    raw[20] ^= 1
    with pytest.raises(Exception):
        tokens.Shard(io.BytesIO(bytes(raw))).read(0)
