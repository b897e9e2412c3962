import numpy as np

from demandloom.llm import toxicity
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, awkward, clashing, docs

SMALL = "/root/testdata/sf0.1"


def test_accuracy_on_rows_that_are_not_learned_from(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    learned = toxicity.learn_toxicity(documents, labels.where("doc_id % 3 > 0"))
    scored = {r.doc_id: r.p_toxic >= 0.5 for r in toxicity.predict_toxicity(documents, learned).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    caught = sum(scored[i] for i, t in truth.items() if t)
    wrong = sum(scored[i] for i, t in truth.items() if not t)
    assert caught >= 0.8 * sum(truth.values())
    assert wrong <= 0.03 * sum(not t for t in truth.values())


def test_query_scores_every_document(spark):
    got = QUERIES["op10_toxicity"](spark, SF_DIR)
    assert got.columns == ["doc_id", "p_insult", "p_contempt", "p_mockery", "p_toxic", "is_toxic"]
    assert got.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    first = rng.random(600) < 0.5
    texts = [toxicity.features(["bad"] if f else ["good"]) for f in first]
    chain = toxicity.fit_chain(texts, {"a": first.astype(float), "b": first.astype(float)})
    assert chain.models[0].more.shape == (0,) and chain.models[1].more.shape == (1,)
    assert chain.models[1].more[0] > 0
    scores = chain.predict([toxicity.features(words) for words in (["bad"], ["good"], [])])
    assert scores[0, 1] > 0.9 and scores[1, 1] < 0.1


def test_out_of_fold_predictions_do_not_see_their_row(monkeypatch):
    seen = []
    fit = toxicity.Linear.fit
    monkeypatch.setattr(toxicity.Linear, "fit", lambda self, rows, more, label: seen.append(rows.n) or fit(self, rows, more, label))
    toxicity.fit_chain([toxicity.features(["a"]), toxicity.features(["b"])] * 6, {name: np.array([1.0, 0.0] * 6) for name in "xy"}, folds=3)
    assert seen == [8, 8, 8, 12, 12]


def test_categories_follow_the_labels_whatever_the_words():
    rng = np.random.default_rng(1)
    plain = ["".join(chr(0x430 + i) for i in rng.integers(0, 32, 6)) for _ in range(60)]
    bad = ["".join(chr(0x3B1 + i) for i in rng.integers(0, 24, 8)) for _ in range(12)]
    toxic = np.arange(400) % 4 == 0
    texts = [toxicity.features([*rng.choice(plain, 10), *(rng.choice(bad, 5) if t else [])]) for t in toxic]
    toxic = toxic.astype(float)
    labels = {name: toxicity.marked(i, toxic) for i, name in enumerate(toxicity.GROUPS)}
    scores = toxicity.fit_chain(texts, {**labels, toxicity.TOXIC: toxic}).predict(texts)
    assert (scores[toxic > 0].mean(axis=0) > 0.7).all() and (scores[toxic == 0].mean(axis=0) < 0.2).all()


def test_sample_has_a_row_for_each_id_with_a_text(spark):
    rows = [(7, "same words")] * 40 + [(7, "other words")] + [(i, f"text {i}") for i in range(20, 25)] + [(30, None)]
    labels = spark.createDataFrame([(i, 1) for i in [7, *range(20, 25), 30, *range(100, 200)]], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs(spark, rows), labels, 6).collect()
    assert sorted(r.doc_id for r in sample) == [7, *range(20, 25)]
    seven = next(r for r in sample if r.doc_id == 7)
    assert bytes(seven.features) == toxicity.features_of("other words").tobytes()


def test_awkward_rows(spark):
    table = clashing(awkward(spark), ["toxic", "p_toxic", "features"])
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (4, 0), (99, 1)], "doc_id long, toxic int")
    chain = toxicity.learn_toxicity(table, labels)
    got = toxicity.predict_toxicity(table, chain).collect()
    assert len(got) == table.count()
    assert all(0 <= r.p_toxic <= 1 for r in got)
    empty = toxicity.learn_toxicity(table, labels.limit(0))
    assert {r.p_toxic for r in toxicity.predict_toxicity(table, empty).collect()} == {0.5}
    assert toxicity.predict_toxicity(table.limit(0), chain).count() == 0
