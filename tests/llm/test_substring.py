import hashlib
import random
import re

import pytest

from demandloom.llm import substring
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, awkward, clashing, docs, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(texts, window):
    """``{id: (words, kept words)}`` from every window of every document."""
    first = {}
    split = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i, own in split.items():
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, own in split.items():
        gone = set()
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (own, [w for k, w in enumerate(own) if k not in gone])
    return out


def test_query_against_every_window(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {tuple(r) for r in QUERIES["op2_substring_dedup"](spark, SF_DIR).collect()}
    want = {
        (i, len(own), len(own) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        for i, (own, kept) in plain(texts, 50).items()
    }
    assert got == want
    assert any(row[2] for row in want)


@pytest.mark.parametrize("window, anchor", [(50, 12), (10, 3), (6, 5)])
def test_shared_passages_that_branch(spark, window, anchor):
    rng = random.Random(window)
    pool = [words(rng.randint(4, 90), k) for k in range(8)]
    texts = {}
    for i in range(60):
        parts = [pool[rng.randrange(8)] if rng.random() < 0.6 else words(rng.randint(1, 30), 100 + i) for _ in range(5)]
        parts = [p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)] for p in parts]
        texts[i] = " ".join(w for p in parts for w in p)
    texts[60], texts[61] = "the " * 200, "the " * 120 + "end"
    texts[62], texts[63] = texts[3], texts[3].replace(" ", "\n\t")
    got = substring.drop_repeats(docs(spark, list(texts.items())), window=window, anchor=anchor).collect()
    want = plain(texts, window)
    for row in got:
        own, kept = want[row.doc_id]
        assert (row.n_words, row.n_removed, row.kept_text) == (len(own), len(own) - len(kept), " ".join(kept))
        left = [w for a, b in zip([0, *(s.end for s in row.spans)], [*(s.start for s in row.spans), len(own)]) for w in own[a:b]]
        assert left == kept


def test_awkward_rows(spark):
    table = clashing(awkward(spark), ["minimizer", "digest", "kept_text", "spans", "text_hash"])
    copy = [(9, r.text) for r in table.collect() if r.doc_id == 4]
    got = substring.drop_repeats(table.select("doc_id", "text").unionByName(docs(spark, copy).select("doc_id", "text")))
    by_id = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert (by_id[4].n_removed, by_id[9].n_removed, by_id[9].kept_text) == (0, 40_000, "")
    assert (by_id[1].n_words, by_id[1].kept_text, by_id[5].n_words, by_id[6].n_words) == (0, "", 2, 1)
    assert substring.drop_repeats(table).count() == table.count()
    assert substring.drop_repeats(table.limit(0)).count() == 0


def test_null_ids_and_one_id_do_not_make_words_go(spark):
    text = " ".join(words(60, 1))
    got = substring.drop_repeats(docs(spark, [(None, text), (2, text), (2, text), (2, text + " more")])).collect()
    assert [r.n_removed for r in got] == [0, 0, 0, 0]
