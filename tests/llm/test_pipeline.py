import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import decontamination, near_dups

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, now = {r.doc_id for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, SF)
        rows = now.collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before) <= seen, name
        if name != "bpe":
            assert now.schema == docs.schema
        if name == "near_duplicates":
            assert near_dups.near_duplicates(now).where("not kept").count() == 0
        if name == "decontamination":
            assert decontamination.contamination(now, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        if name == "personal_data":
            assert set(ids) == set(before) and not any("@mail" in r.text for r in rows) and all(len(r.text) == r.n_chars for r in rows)
        if name == "bpe":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert all(r.ids == library.encode(before[r.doc_id].text, add_special_tokens=False).ids for r in rows)
    got = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, tuple(r.ids)) for r in got.collect()} == {(r.doc_id, tuple(r.ids)) for r in rows}


def test_rows_without_ids_stay_beside_repeated_ids(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (2, "a quite different text of its own words"), (None, "no id here at all my friend"), (None, "another one that has no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(i), t) for i, t in rows[1:])


def test_each_row_is_judged_by_its_own_text(spark):
    one, other = "one two three four five six seven eight nine ten", "a quite different text that has some words of its own"
    rows = [(1, one), (1, other), (None, one), (2, other), (3, "..."), (3, "..."), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, one), (1, other), (3, "..."), (None, None)]))
    bad = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, bad), (1, other), (None, bad), (None, other)], "doc_id long, text string")
    got = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, other), (None, other)]))


def test_quality_judges_rows_with_null_and_repeated_ids(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = spark.read.parquet(f"{SF}/documents.parquet").join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id").collect()
    model = corpus_pipeline.quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels, corpus_pipeline.crc_is(3, 1))
    scored = {r.doc_id: r.score for r in corpus_pipeline.quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    good, bad = (f(known, key=lambda r: scored[r.doc_id]) for f in (max, min))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, good.text), (None, bad.text), (10**9, bad.text), (10**9, good.text)], "doc_id long, text string")
    got = corpus_pipeline.keep_quality(spark, docs.select("doc_id", "text").unionByName(odd), SF)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert (None, good.text) in kept and (None, bad.text) not in kept and (10**9, bad.text) not in kept and (10**9, good.text) in kept


def test_stages_take_empty_tables_long_texts_and_further_columns(spark):
    long = " ".join(f"word{k % 5000}" for k in range(300_000))
    rows = [(1, long, "x", "s", 1.5), (2, None, "x", None, None), (3, "", "x", "s", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, span string, rank double")
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, docs, SF)
        assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3], name
        if name != "bpe":
            assert got.columns == docs.columns and {r.text for r in got.collect()} == {long, None, ""}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.keep_quality(spark, docs.limit(0), SF).count() == 0


def test_the_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", "text")).unionByName(docs.selectExpr("doc_id div 2 as doc_id", "concat(text, ' and more') as text"))
    got = [sorted(map(str, map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), SF).collect()))) for n in (1, 7)]
    assert got[0] == got[1]


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    one, other, third = (" ".join(f"{c}{k}" for k in range(20)) for c in "abc")
    rows = [(1, one), (2, other), (3, one), (None, other), (4, third), (4, third), (5, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())))
    assert want == sorted(map(str, [(1, one), (2, other), (4, third), (5, ""), (None, None)]))
    hashed = corpus_pipeline._hashed
    monkeypatch.setattr(corpus_pipeline, "_hashed", lambda docs: hashed(docs).withColumn("_hash_1", F.lit(7).cast("long")))
    assert sorted(map(str, map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()))) == want


def test_rows_of_one_id_and_text_leave_the_first_by_all_columns(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (None, text, "c"), (2, "", "x"), (2, "", "y")], "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == [(1, text), (2, "")]
    assert {tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), SF).collect()} == {tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.coalesce(1), SF).collect()}
