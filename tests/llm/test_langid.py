import zlib

import numpy as np

from demandloom.llm import langid
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, awkward, clashing

SMALL = "/root/testdata/sf0.01"


def plain_trigrams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    return [g for w in letters.split() for p in [f" {w} "] for g in (p[i : i + 3] for i in range(len(p) - 2))]


def test_trigrams():
    texts = ["Ab, cd-É", None, "", "...", "x", "Grüße 日本 😀a"]
    grams, owner = langid.trigrams(texts)
    for i, text in enumerate(texts):
        want = plain_trigrams(text or "")
        got = ["".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in grams[owner == i]]
        assert got == want


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op4_language"](spark, SMALL).collect()
    assert len(got) == len(truth)
    right = held = 0
    for row in got:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1
        if row.held_out and any(c.isalpha() for c in truth[row.doc_id].text):
            held += 1
            right += row.lang_pred == truth[row.doc_id].lang
    assert held > 100
    assert right / held > 0.98


def test_counts_and_filters_against_plain_sets(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    counts = {}
    for r in rows:
        for g in plain_trigrams(r.text):
            counts.setdefault(r.lang, {}).setdefault(g, 0)
            counts[r.lang][g] += 1
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {}
    for r in langid.gram_counts(table, "lang", "text").collect():
        got.setdefault(r.lang, {})["".join(chr(r.gram >> s & 0x1FFFFF) for s in (42, 21, 0))] = r.n
    assert got == counts
    share = {lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in counts.items()}
    filters = langid.learn_languages(table)
    for i, lang in enumerate(filters.languages):
        most = lambda g: max(own.get(g, 0) for own in share.values())
        held = [g for g, s in share[lang].items() if s >= langid.LEAST_SHARE and s >= langid.LEAST_RATIO * most(g)]
        codes = np.array([ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in held], dtype=np.uint64)
        a, b = langid.positions_of(codes, langid.POSITIONS)
        assert (filters._bit(filters.table[a] & filters.table[b], i) == 1).all()  # a filter never loses a gram


def test_awkward_rows(spark):
    table = clashing(awkward(spark), ["lang_pred", "score", "gram"])
    filters = langid.learn_languages(table)
    got = langid.predict_languages(table, filters)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got.collect() if r.doc_id}
    assert [by_id[i] for i in (1, 2, 3, 7)] == [("und", 0.0)] * 4
    assert by_id[4][0] == "en"
    nothing = langid.learn_languages(table.where("false"))
    assert nothing.languages == []
    assert {r.lang_pred for r in langid.predict_languages(table, nothing).collect()} == {"und"}
    assert langid.predict_languages(table.limit(0), filters).count() == 0
    kept = langid.reject_unknown(table, 0.2)
    assert kept.columns == table.columns
    assert {r.score for r in kept.collect()} == {"own"}


def test_more_languages_than_bits_in_a_word(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 30, f"l{i:03d}") for i in range(70)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict_languages(table, langid.learn_languages(table)).collect()
    assert all(r.lang_pred == r.lang and r.score > 0.9 for r in got)


def test_documents_without_language_teach_nothing(spark):
    rows = [(1, "the cat sat", None), (2, None, "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn_languages(table).languages == []
