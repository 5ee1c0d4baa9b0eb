import pytest
from pyspark.sql import functions as F

from spindrift.functions import stats
from spindrift.operators import classifier, topics, users
from spindrift.sources.tables import Settings


@pytest.fixture(scope="module")
def bags(spark):
    rows = [(f"u{i}", i % 8 == 0, [float(i % 8 == 0) * 2 + (i % 5) / 10, (i % 3) / 3, 1.0]) for i in range(48)]
    return spark.createDataFrame(rows, "user_url string, y boolean, x array<double>").repartition(2)


def test_nested_evaluation(bags):
    out = classifier.nested_evaluation(bags, "x", "y", "user_url", costs=(0.1, 1.0), limit_positives=2).cache()
    assert out.where("y_true = 1").count() == 2
    assert stats.average_precision(out, "y_score", "y_true").first()["average_precision"] == pytest.approx(1.0)


def test_folds_go_on_where_they_stopped(bags, tmp_path, monkeypatch):
    path, made = f"file://{tmp_path}/folds", []
    first = classifier.nested_evaluation(bags, "x", "y", "user_url", costs=(1.0,), limit_positives=2, path=path)
    first = sorted(map(tuple, first.collect()))
    fit = classifier.fit_logistic
    monkeypatch.setattr(classifier, "fit_logistic", lambda *a: made.append(1) or fit(*a))
    again = classifier.nested_evaluation(bags, "x", "y", "user_url", costs=(1.0,), limit_positives=2, path=path)
    assert sorted(map(tuple, again.collect())) == first and not made
    more = classifier.nested_evaluation(bags, "x", "y", "user_url", costs=(1.0,), limit_positives=3, path=path)
    assert more.where("y_true = 1").count() == 3 and len(made) == 4
    with pytest.raises(ValueError, match="another configuration"):
        classifier.nested_evaluation(bags, "x", "y", "user_url", costs=(2.0,), limit_positives=2, path=path)


def test_no_positives(bags):
    assert classifier.nested_evaluation(bags.where("not y"), "x", "y", "user_url").count() == 0


def test_bag_classifier(spark, bags):
    instances = bags.select("user_url", "y", F.explode(F.array("x", "x")).alias("vector"))
    pooled = classifier.pool_bags(instances).select("user_url", "mean")
    out = classifier.bag_classifier(pooled, bags.select("user_url", "y"), "y", k=3)
    assert out.count() == 48 and out.select("fold").distinct().count() == 3


def test_preparation(spark):
    train = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 2.0)], "a double, b double")
    filled = classifier.impute_medians(train, train, ["a", "b"])
    assert sorted(r.a for r in filled.collect())[0] == 1.0 and filled.where("a is null or isnan(a)").count() == 0
    scaled = classifier.standardise(train.dropna(), train.dropna(), ["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in scaled) == [(-1.0, 0.0), (1.0, 0.0)]
    v = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "x array<double>")
    assert sorted(r.x for r in classifier.standardise_vectors(v, v, "x").collect()) == [[-1.0, 0.0], [1.0, 0.0]]


def test_substituted_vectors(spark):
    f = spark.createDataFrame([("a", True, [1.0]), ("b", True, [1.0]), ("c", False, [1.0])], "user_url string, y boolean, x array<double>")
    r = spark.createDataFrame([("a", [9.0]), ("c", [9.0])], "user_url string, x array<double>")
    assert sorted((x.user_url, x.x) for x in users.substitute_vectors(f, r, "y", "x").collect()) == [("a", [9.0]), ("c", [1.0])]


def test_topic_search_and_stability(spark, tmp_path, monkeypatch):
    rows = [(f"r{i}", f"{w} {w}x common", [float(i % 2), float(i % 2) * 2, i / 100.0]) for i, w in enumerate(["lag", "story"] * 20)]
    docs = spark.createDataFrame(rows, "review_url string, review_text_clean string, vector array<double>")
    s = Settings(sample_fraction=1.0, min_topics=2, stability_fractions=(0.5,))
    best = topics.search(docs, s, grid=[dict(k=2, n_components=2, min_size=2)]).first()
    assert best["topics"] == 2 and best["outlier_rate"] == 0
    path, tried, fit = f"file://{tmp_path}", [], topics.fit_topics
    monkeypatch.setattr(topics, "fit_topics", lambda *a, **k: tried.append(1) or fit(*a, **k))
    few = topics.search(docs, s.with_(n_trials=2), path=f"{path}/study").collect()
    more = topics.search(docs, s.with_(n_trials=3), path=f"{path}/study").collect()
    assert len(tried) == 3 and len(more) == 3 and set(few) <= set(more)
    model = topics.TopicModel.load_or_fit(spark, f"{path}/model", lambda: topics.fit_topics(docs, 2, 2, 2))
    loaded = topics.TopicModel.load_or_fit(spark, f"{path}/model", lambda: 1 / 0)
    assert loaded.topics == model.topics and sorted(loaded.assign(docs).select("review_url", "topic").collect()) == sorted(model.assign(docs).select("review_url", "topic").collect())
    monkeypatch.undo()
    assert topics.stability(docs, s, 2, 2, 2).first()["overlap"] > 0.9
    assert topics.topic_summary(topics.fit_topics(docs, 2, 2, 50).assign(docs)).first()["outlier_rate"] == 1.0
