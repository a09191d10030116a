import random
import re

from graphloom.llm import licenses as L

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    words = split(text)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_words_and_common_words_equal_plain_ones():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde").encode() for _ in range(rng.randrange(1, 40))] for _ in "ab")
        assert L.common_words(a, b) == subsequence(a, b)
    for text in ("MIT-License", "a_b c0 É Ärger x", "", "\x7f~{}9"):
        assert [w.decode() for w in L.words_of(text)] == split(text)


def scan(docs):
    return sorted((tuple(r) for r in L.license_digest(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_base_places_of_edge_cases(spark):
    texts = [None, "", "mit license", "MIT License, mit LICENSE; cc-by/cc BY", "gnu general public license gnu general public license", "cc by cc by cc", "apache", "licence", "mit  license" * 3, "é cc by", "x " * 9000 + "cc by " * 5000, "cc by", "cc by"]
    rows = [(k if k != 3 else None, t, "l", 5) for k, t in enumerate(texts)] + [(11, "cc by", "l", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, template int")
    found = scan(docs)
    assert [r[:6] for r in found] == sorted([(i, *base(t)) for i, t, *_ in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert all((r[7] == 1.0) == (r[2] > 0) and set(filter(None, r[5].split(","))) <= set(r[6].split(",")) for r in found)
    assert scan(docs.limit(0)) == []


def test_base_places_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert [r[:6] for r in scan(docs)] == sorted((r.doc_id, *base(r.text)) for r in docs.collect())


def test_changed_notices_are_found_and_plain_text_is_not(spark):
    rng = random.Random(9)
    filler = lambda n: [rng.choice(["the", "of", "and", "license", "software", "free", "public", "river", "stone", "to"]) for _ in range(n)]
    rows, wanted = [], {}
    for k, t in enumerate(L.NOTICES):
        words = t.text.split()
        for share in (0.0, 0.1):
            if len(words) < 20 and share:
                continue
            own = [w for w in words if rng.random() >= share / 2]
            own = [x for w in own for x in ([w, "indeed"] if rng.random() < share / 2 else [w])]
            rows.append((len(rows), " ".join(filler(300) + own + filler(200))))
            wanted[len(rows) - 1] = (t.label, 300)
    clean = [(1000 + k, " ".join(filler(500))) for k in range(20)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in L.license_spans(docs).collect()}
    for i, (label, at) in wanted.items():
        assert any(s.label == label and abs(s.start - at) <= 12 and s.coverage >= L.COVERAGE for s in found[i]), (i, label, found[i])
    assert all(not found[i] for i, _ in clean)


def test_own_templates_and_shuffled_places(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_PLACES", 0)  # the join shuffles
    docs = spark.createDataFrame([(1, "All Rights Reserved by us"), (2, "all rights"), (3, "one two three four five six seven eight")], "doc_id long, text string")
    own = [L.Template("closed", "all rights reserved", True), L.Template("count", "one two three three and a half four five six seven eight")]
    found = {r.doc_id: [(s.label, s.start, s.exact) for s in r.spans] for r in L.license_spans(docs, own, coverage=0.6).collect()}
    assert found == {1: [("closed", 0, True)], 2: [], 3: [("count", 0, False)]}
    assert all(not r.spans for r in L.license_spans(docs, []).collect())
