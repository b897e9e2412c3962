import zlib

import corpus_pipeline
from demandloom.llm import decontam, langid, pii, simhash
from tests.llm.cases import SF_DIR, awkward, clashing


def test_stages_one_after_the_other(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF_DIR)
        ids, kept = {r.doc_id for r in before.collect()}, docs.collect()
        assert {r.doc_id for r in kept} <= ids
        if name != "tokens":
            assert docs.columns == documents.columns
        if name == "near_duplicates":
            firsts = {r.component_id for r in simhash.simhash_groups(before).collect()}
            assert sorted(r.doc_id for r in kept) == sorted(firsts)
        if name == "decontamination":
            leaks = decontam.find_leaks(before, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()
            assert {r.doc_id for r in kept} == ids - {r.doc_id for r in leaks}
        if name == "personal_data":
            old = {r.doc_id: r.text for r in before.collect()}
            for r in kept:
                assert r.text == pii.redacted(old[r.doc_id], pii.spans_of(old[r.doc_id]))
                assert r.n_chars == len(r.text) or r.text == old[r.doc_id]
    assert all(r.round_trip for r in kept)
    assert sorted(map(str, kept)) == sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect()))


def test_clean_documents_pass_language_id(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = langid.reject_unknown(documents, corpus_pipeline.LEAST_SCORE)
    assert kept.count() == documents.where(r"text rlike '\\p{L}'").count()


def test_language_of_one_held_out_document_stays(spark):
    rare = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows = [(i, "the cat sat on the mat " * 5, "en") for i in range(8)] + [(rare, "γάτα κάθεται στο χαλί " * 5, "el")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.reject_unknown(table, corpus_pipeline.LEAST_SCORE)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows}


def test_without_any_language_texts_with_letters_stay(spark):
    rows = [(1, "the cat sat", None), (2, "12 !", None), (3, None, "en"), (4, "γάτα", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.reject_unknown(table, corpus_pipeline.LEAST_SCORE)
    assert {r.doc_id for r in kept.collect()} == {1, 4}


def test_awkward_rows(spark):
    table = clashing(awkward(spark), ["score", "fp", "spans", "ids", "__id"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), SF_DIR).count() == 0
        docs = stage(spark, table, SF_DIR)
        assert docs.columns[: len(table.columns)] == table.columns
        docs.collect()
