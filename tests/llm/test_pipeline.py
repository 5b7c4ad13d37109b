import corpus_pipeline
from docmeter.llm import language, quality
from tests.llm.brute import components, shingles


def test_stages_follow_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    (_, clean), (_, known), (_, alone), (_, packed) = corpus_pipeline.STAGES
    one = clean(spark, docs, sf).cache()
    kept = {r.doc_id: r.clean_text for r in quality.clean_lines(docs).filter("kept").collect()}
    assert one.columns == columns and {r.doc_id: r.text for r in one.collect()} == kept
    two = known(spark, one, sf).cache()
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {r.doc_id for r in one.collect() if any(c.isalpha() for c in r.text)}
    three = alone(spark, two, sf).cache()
    sets = {r.doc_id: shingles(r.text) for r in two.collect()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {i for i, c in components(ids, links).items() if i == c}
    last = packed(spark, three, sf)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in three.collect()}
    assert language.UNDETERMINED == "und"


def test_run_equals_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == docs.columns and rows.count() > 100
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, docs.collect()))


def test_stages_keep_columns_of_any_name_and_stand_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    text = docs.orderBy("doc_id").filter("lang is not null and doc_id % 4 = 1").first().text
    rows = [(1, text, "en", "a", 7, "x"), (1, f"{text} more and other words.", "en", None, None, "y"), (None, text, "en", None, None, "z"), (2, None, "en", "a", 1, "x"), (3, "", None, "a", 1, None), (4, text, "en", "a", 1, "w")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row_number string"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "").cache()
            assert out.columns == docs.columns, name
            docs = out
        kept = [r["_row_number"] for r in docs.collect()]
        assert len(kept) == (1 if some else 0) and set(kept) <= {"x", "y"}
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0) == bool(some)
