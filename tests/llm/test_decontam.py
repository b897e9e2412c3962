import random
from datetime import date

import pytest

from demandloom.llm import decontam
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, awkward, clashing, docs, words


def plain_distance(item, text):
    """Smallest number of edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + "q" + text[at:], text[:at] + text[at + 1 :], text[:at] + "z" + text[at + 1 :]])
    return text


def test_myers_against_the_plain_table():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90)))
        want = plain_distance(item, text)
        got = decontam.myers(item, text, len(item))
        if text:
            assert got and got[0] == min(want, got[0]) and got[0] >= want
            assert got[0] == want or want == len(item)
        assert want == len(item) or decontam.myers(item, text, want - 1) is None


def test_no_match_within_the_budget_is_missed():
    rng = random.Random(4)
    for n in range(60):
        item = decontam.normal(" ".join(words(rng.randint(3, 40), n)))
        errors = decontam.budget(item, 0.05)
        matcher = decontam.Matcher([(7, item)], 0.05)
        for edits in range(errors + 3):
            text = " ".join(words(30, 500 + n)) + edited(rng, item, edits) + " ".join(words(30, 900 + n))
            want = plain_distance(item, text)
            got = matcher.matches(text)
            assert got.get(0, (None,))[0] == (want if want <= errors else None)


def test_query_against_all_pairs(spark):
    items = {r.item_id: decontam.normal(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    texts = {r.doc_id: decontam.normal(r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op5_decontamination"](spark, SF_DIR).collect()}
    assert exact and exact <= got.keys()
    for (d, i), distance in got.items():
        assert (distance == 0) == ((d, i) in exact)
        assert distance == plain_distance(items[i], texts[d]) if distance else True


def test_blocks_do_not_change_the_result(spark, rows):
    documents, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = rows(decontam.find_leaks(documents, items))
    assert rows(decontam.find_leaks(documents, items, block_chars=2000)) == whole
    clean = decontam.drop_leaks(documents, items, block_chars=2000)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in documents.collect()} - {r[0] for r in whole}
    assert clean.columns == documents.columns


def test_awkward_rows(spark):
    table = clashing(awkward(spark), ["item_id", "distance", "match_end"])
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "One, TWO"), (None, "cafe"), (5, "one two"), (6, "ne tw")], "item_id long, text string")
    got = decontam.find_leaks(table, items)
    assert sorted((str(r.doc_id), r.item_id) for r in got.collect()) == sorted([(d, i) for d in ("5", "5", "None") for i in (4, 5)])
    assert decontam.find_leaks(table.limit(0), items).count() == 0
    assert decontam.find_leaks(table, items.limit(0)).count() == 0
    assert decontam.drop_leaks(table, items.limit(0)).count() == table.count()
    assert decontam.drop_leaks(table, items).count() == table.count() - 3
    assert decontam.find_leaks(docs(spark, [(1, "x")]), items).columns == ["doc_id", "item_id", "distance", "match_end"]


@pytest.mark.parametrize("kind,ids", [("int", [7, None]), ("string", ["a", "b"]), ("long", [None, None]), ("short", [3, 4]), ("date", [None, date(2024, 1, 2)])])
def test_item_ids_of_any_type(spark, kind, ids):
    texts = ["one two three four five six seven eight nine", "alpha beta gamma delta epsilon zeta eta theta"]
    items = spark.createDataFrame(list(zip(ids, texts)), f"item_id {kind}, text string")
    table = docs(spark, [(1, f"x {texts[0]} y"), (2, texts[1]), (3, "nothing")])
    for size in (10, 1000):
        got = decontam.find_leaks(table, items, block_chars=size)
        assert got.schema["item_id"].dataType == items.schema["item_id"].dataType
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got.collect()) == [(1, ids[0], 0), (2, ids[1], 0)]
