import corpus_pipeline
from graphloom.llm.pieces import decode_ids
from graphloom.llm.queries import PIECES, tokenizer_path
from graphloom.runtime import stored, table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    labels = table(spark, FOLDER, "labels")
    columns, before = docs.columns, docs
    kept = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stored(stage(spark, before, FOLDER), "test")
        assert after.count() <= before.count()
        if number < 4:
            assert after.columns == columns, name
            kept.append({r.doc_id for r in after.select("doc_id").collect()})
            before = after
    good = {r.doc_id for r in labels.where("quality = 1").join(docs, "doc_id").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(good & kept[0]) >= 0.97 * len(good)
    assert len(bad & kept[0]) <= 0.2 * len(bad)
    assert kept[0] >= kept[1] >= kept[2] >= kept[3]
    back = {r.doc_id: r.text for r in decode_ids(after.select("doc_id", "ids"), tokenizer_path(PIECES)).collect()}
    assert back == {r.doc_id: r.text or "" for r in after.collect()}


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names, no column n_chars, and no rows at all."""
    long = "\n".join(f"line number {k} of a very long text with words" for k in range(4000))
    rows = [(None, None, None, None), (1, "", "a", 1), (2, long, None, 2), (2, long, None, 2), (3, long, "b", 3), (None, long, "c", 4), (4, "short text", "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, line_doc_ long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        got = sorted((tuple(r) for r in after.collect()), key=str)
        want = [r for r in rows if r[0] != 3] if name in ("line dedup", "n-gram Jaccard join") else rows
        assert got == sorted(want, key=str), name
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
    quality, encode = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[4][1]
    kept = quality(spark, docs, FOLDER)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= set(rows)
    assert quality(spark, docs.limit(0), FOLDER).collect() == [] and encode(spark, docs.limit(0), FOLDER).collect() == []
    back = decode_ids(encode(spark, docs, FOLDER).select("doc_id", "ids"), tokenizer_path(PIECES)).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id) == sorted((d, t or "") for d, t, *_ in rows if d)
