import math
import re
from collections import Counter

from pyspark.sql import functions as F

from demandloom.llm import quality
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, awkward, clashing, docs, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    own = WORD.findall(text or "")
    windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def test_query_against_plain_counts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    kept = Counter()
    for row in QUERIES["op8_quality"](spark, SF_DIR).collect():
        want = plain(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.kept and row.base_failed)
        kept[row.kept] += 1
    assert kept[True] > kept[False] > 0


def test_repeated_windows(spark):
    a, b = words(30, 1), words(12, 2)
    texts = [" ".join(x) for x in (a + b + a, ["x"] * 40, a[:9], a[:7] * 2, a[:8] * 2, a[:8] + b + a[1:9], b * 3, ["x"] * 8, ["x"] * 9)]
    texts += ["a\nb\n\n b \na\n", "\x0b\nx y\nx y", "  lead\ttail \n"]
    got = quality.text_counts(docs(spark, list(enumerate(texts)))).collect()
    for row in got:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == plain(texts[row.doc_id])


def test_em_finds_out_which_rules_to_believe():
    patterns = Counter()
    for k in range(1000):  # two good rules, one that votes at random
        good = k % 10 < 8
        right = 1 if good else -1
        patterns[(right if k % 20 else 0, right if k % 70 else -right, 1 if k % 3 else -1)] += 1
    model = quality.estimate(["a", "b", "c"], dict(patterns))
    assert abs(math.exp(model.share[0]) - 0.8) < 0.1
    assert model.good((1, 1, -1)) > 0.9 > 0.1 > model.good((-1, -1, 1))
    assert abs(model.good((1, 1, -1)) - model.good((1, 1, 1))) < 0.05


def test_junk_goes_and_clean_stays(spark):
    clean = [(i, " ".join(words(120, i))) for i in range(80)]
    junk = [(100 + i, " ".join(w.upper() + "!!" for w in words(60, 200 + i))) for i in range(20)]
    junk += [(200 + i, " ".join(w + "$$$ ***" for w in words(60, 300 + i))) for i in range(20)]
    judged = quality.with_quality(docs(spark, clean + junk))
    got = {r.doc_id: r.posterior for r in judged.collect()}
    assert all(got[i] > 0.5 for i, _ in clean)
    assert all(got[i] < 0.5 for i, _ in junk)


def test_a_family_of_junk_goes_at_every_share():
    names = [f"vote_{name}" for name in quality.rules()]

    def pattern(*rejecting):
        return tuple(-1 if name in rejecting else 1 for name in quality.rules())

    clean, spam, loud = pattern(), pattern("symbols"), pattern("capitals", "marks")
    both = pattern("symbols", "capitals", "marks")
    for share in (200, 299, 310, 333, 500, 800):
        rest = 1000 - share
        for patterns in (
            {clean: rest, spam: share},
            {clean: rest - 30, spam: share, loud: 30},
            {clean: rest - rest // 30, spam: share - share // 30, loud: rest // 30, both: share // 30},
        ):
            model = quality.estimate(names, patterns, believed=names)
            assert model.good(clean) > 0.9, share
            assert all(model.good(p) < 0.1 for p in patterns if p != clean), share


def test_junk_of_a_third_or_half_of_the_rows_goes(spark):
    for n in (20, 33, 50):
        rows = [(i, " ".join(words(60, i))) for i in range(100 - n)]
        rows += [(100 + i, " ".join(w + " $$$" for w in words(60, 100 + i))) for i in range(n)]
        got = {r.doc_id: r.posterior for r in quality.with_quality(docs(spark, rows)).collect()}
        assert all((p > 0.5) == (i < 100) for i, p in got.items()), n


def test_awkward_rows(spark):
    table = clashing(awkward(spark), ["n_words", "posterior", "w", "l", "vote_length"])
    got = {r.doc_id: r for r in quality.with_quality(table).collect() if r.doc_id}
    assert (got[1].n_words, got[2].n_words, got[3].n_words, got[4].n_words, got[6].word_chars) == (0, 0, 0, 40_000, 50_000)
    assert quality.with_quality(table).count() == table.count()
    assert quality.with_quality(table.limit(0)).count() == 0
    assert quality.estimate(["a"], {}).good((1,)) == 0.5


def test_main_path_is_dataframe_functions_only(spark):
    plan = quality.text_counts(docs(spark, [(1, "x")])).select(F.count("*"))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert not re.search("Python|Arrow|Pandas", text)
