import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import ranks, stats
from spindrift.operators import annotation, cleaning, examples, reports, scoring, tfidf, topics, users
from spindrift.sources import sinks, stage, tables


def test_clean_reviews(spark):
    cols = "linkComentario string, nomeUsuario string, id string, texto string, dataPublicacao string, horasJogadas string, recomendado double, language string, toxicity double, util string"
    rows = [
        ("r1", "u1", "12.0", "bom", "16 de MARÇO de 2022", "1.5", 1.0, "pt", 0.2, "x"),
        ("r1", "u1", "12.0", "outro", "31 de fevereiro de 2022", "-1", 0.0, "pt", float("nan"), "x"),
        ("r2", "u1", "abc", "bom", None, "", -1.0, "", 0.2, "x"),
        ("r3", "-1", "3", "bom", None, "", -1.0, "", 0.2, "x"),
        ("r4", "u4", "1.5", "bom", "", "x", None, "en", -1.0, None),
        ("r5", "u5", "7", "good", "Publicada: 1 de maio de 2020", "x", None, "-1", -1.0, None),
    ]
    got = cleaning.clean_reviews(spark.createDataFrame(rows, cols)).orderBy("review_url", "review_text").collect()
    assert [(r.review_url, r.game_id, r.review_date, r.is_recommended, r.hours_played, r.perspective_score, r.perspective_declared_language) for r in got] == [
        ("r1", 12, "2022-03-16", True, 1.5, 0.2, "pt"), ("r1", 12, None, False, None, None, "pt"), ("r5", 7, "2020-05-01", None, None, None, None),
    ]
    once = cleaning.dedup_reviews(spark.createDataFrame(got))
    assert once.count() == 2 and cleaning.dedup_reviews(once).count() == 2


def test_clean_games_and_users(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"game_id":"1","title":"A","price":"Free","release_date":"2020-01-02","popular_tags":["x","Y"]},{"game_id":"1","title":"A","price":"n/a","release_date":"bad"},{"game_id":"2","title":"","price":"19.9"},{"game_id":"3","title":"C","price":"19.9","popular_tags":"solo"}]')
    games = cleaning.clean_games(tables.read_games(spark, str(tmp_path / "g.json")))
    got = {r.game_id: r for r in games.withColumn("tags", tables.tag_list(F.col("popular_tags"))).collect()}
    assert set(got) == {1, 3} and got[3].price == 19.9 and got[3].tags == ["solo"]
    raw = spark.createDataFrame([("s1", "u/", "-1", "true", -1), ("s1", "u/", "3", "true", 4), ("s2", "v", "x", "no", 2)], "steam_id string, steam_url string, awards string, has_ban string, groups long")
    assert sorted((r.steam_id, r.awards, r.groups) for r in cleaning.clean_users(raw).collect())[1] == ("s2", None, 2)


def test_raw_names_of_games_and_users(spark, tmp_path):
    row = {"gameId": 1, "titulo": "A", "preco": "Free", "dataLancamento": "2 Jan, 2020", "serie": "s", "dlc_id": "d", "marcadoresPopulares": ["x", "Y"], "qntdReviews": 7, "metascore": -1, "grafico": True, "idiomas_interface": ["en"]}
    (tmp_path / "g.json").write_text(json.dumps([row, row | {"gameId": 2, "titulo": "", "preco": "1.5"}, row | {"gameId": 3, "preco": "1.5"}]))
    games = cleaning.clean_games(tables.read_games(spark, str(tmp_path / "g.json")))
    got = {r.game_id: r for r in games.collect()}
    assert set(got) == {1, 3} and not {"series", "dlc_id", "serie", "titulo"} & set(games.columns)
    assert (got[1].price, got[1].release_date, got[1].all_time_reviews_count, got[1].metascore, got[1].has_review_bombing, got[1].languages_interface) == (0.0, "2020-01-02", 7, None, True, '["en"]')
    assert len(tables.GAME_NAMES) == 28 and len(tables.USER_NAMES) == 20
    with pytest.raises(ValueError, match="missing columns"):
        cleaning.clean_games(spark.createDataFrame([("A",)], "name string"))
    users_ = spark.createDataFrame([(5, "u/", "true", "3", "-1", 0.5), (5, "u/", "true", "3", "-1", 0.5)], "id long, Nome string, Ban string, `Total de Jogos` string, Premios string, toxicidade_media double")
    (r,) = cleaning.clean_users(users_).collect()
    assert (r.steam_id, r.steam_url, r.has_ban, r.library_size, r.awards) == ("5", "u/", True, 3, None) and "toxicidade_media" not in r.asDict()
    with pytest.raises(ValueError, match="steam_id"):
        cleaning.clean_users(users_.drop("id"))


def test_draws_folds_and_bags(spark):
    rows = spark.createDataFrame([(f"k{i}", i % 10 == 0, f"t{i}") for i in range(200)], "user_url string, y boolean, text string")
    folds = {(r.y, r.fold): r.n for r in examples.stratified_folds(rows, "y", "user_url").groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    assert folds == {(y, f): 36 if not y else 4 for y in (True, False) for f in range(5)}
    drawn = examples.draw_balanced(rows, "y", "user_url", 400).collect()
    assert sorted(r.draw for r in drawn) == list(range(400)) and 150 < sum(r.y for r in drawn) < 250
    assert {r.draw: r.user_url for r in drawn} == {r.draw: r.user_url for r in examples.draw_balanced(rows.repartition(3), "y", "user_url", 400).collect()}
    bag = spark.createDataFrame([("u", f"r{i}", f"t{i}") for i in range(9)], "user_url string, review_url string, review_text_clean string")
    (whole,), (cut,) = users.text_bags(bag).collect(), users.text_bags(bag, 4).collect()
    assert (whole.n, cut.n, cut.texts) == (9, 9, whole.texts[:4])
    assert tables.flagged(spark.createDataFrame([(True, 1), (None, 2), (False, 3)], "f boolean, i int"), "f").count() == 1
    labels = spark.createDataFrame([("a", True), ("b", None)], "user_url string, is_toxic_en boolean")
    mood = spark.createDataFrame([("a", 2.0, 3), ("b", 2.0, 3)], "user_url string, avg_sentiment_en double, n_en_sentiment long")
    assert [tuple(r) for r in users.labelled_sentiment(labels, mood, "en").collect()] == [("a", True, 2.0, 3)]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.shared_folder(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/"
    assert stage.shared_folder(Session) == "hdfs://x"


def test_undetermined_breakdown_tells_rows_apart(spark):
    long = "letters enough for a detector"
    rows = [(None, "und", 0.0), ("", "und", 0.0), ("short", "und", 0.5), (long, "und", 0.0), (long, "und", None), (long, "und", 0.8), (long, "en", 0.0), ("", "fr", 0.9), (long, None, 0.0)]
    got = reports.undetermined_breakdown(spark.createDataFrame(rows, "review_text string, review_lang string, detection_confidence double"))
    assert {r.cause: r.n for r in got.collect()} == {"no_text": 1, "empty_after_cleaning": 1, "gated": 1, "no_guess": 2, "inconsistent": 1}


def test_md5_bucket(spark):
    import hashlib

    got = spark.createDataFrame([("abc",), ("",), ("é",)], "k string").select("k", cleaning.md5_bucket(F.col("k")).alias("b")).collect()
    assert all(r.b == int(hashlib.md5(r.k.encode()).hexdigest(), 16) % 200 for r in got)


def test_dedup_is_idempotent_and_reported(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    once = cleaning.dedup(df, "k", ["v"])
    assert sorted(r.v for r in once.collect()) == [1, 3] and cleaning.dedup(once, "k", ["v"]).count() == 2
    assert tuple(cleaning.dedup_report(df, "k").first()) == (4, 2, 2)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "review_url string, review_lang string, perspective_declared_language string, perspective_score double, detoxify_score double, user_url string, sentiment_score double, review_text string")
    assert users.user_rates(e, ("en", "fr")).count() == 0
    assert users.pooled_rate(users.user_rates(e, ("en", "fr")), "fr").first()["baseline"] is None
    assert reports.threshold_agreement(e).count() == 0
    assert stats.correlations(e, "perspective_score", "detoxify_score", "review_lang").count() == 0


@pytest.mark.parametrize(("n", "k", "p"), [(1, 1, 0.3), (10, 0, 0.2), (20, 7, 0.25), (400, 120, 0.24), (5, 6, 0.5)])
def test_binomial_tail(n, k, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert stats.binomial_tail_value(n, k, p) == pytest.approx(want, rel=1e-9)


def test_ranks_and_precision(spark):
    random.seed(3)
    v = [random.randint(0, 9) for _ in range(200)]
    y = [random.random() < 0.3 for _ in v]
    df = spark.createDataFrame([("g", float(a), b) for a, b in zip(v, y, strict=True)], "g string, v double, y boolean")
    got = {r.value: r["rank"] for r in ranks.average_ranks(df, "v", ("g",)).collect()}
    s = sorted(v)
    assert all(got[float(x)] == (s.index(x) + 1 + s.index(x) + s.count(x)) / 2 for x in set(v))
    ap, tp, n = 0.0, 0, 0
    for x in sorted(set(v), reverse=True):
        hits = sum(b for a, b in zip(v, y, strict=True) if a == x)
        tp, n = tp + hits, n + v.count(x)
        ap += hits / sum(y) * tp / n
    assert stats.average_precision(df, "v", "y").first()["average_precision"] == pytest.approx(ap)
    u = sum((a > b) + 0.5 * (a == b) for a, p in zip(v, y, strict=True) if p for b, q in zip(v, y, strict=True) if not q)
    r = stats.mann_whitney(df, "v", "y", "g").first()
    assert r["u"] == u and 0 <= r["p_less"] <= 1
    tiny = spark.createDataFrame([("t", 1.0, True), ("t", 1.0, False)], "g string, v double, y boolean")
    assert stats.mann_whitney(tiny, "v", "y", "g").first()["u"] is None
    assert stats.correlations(tiny.withColumn("w", F.col("v")), "v", "w", "g").first()["pearson"] is None


VOTES = [("[0.0, 0.1)", 1, 1, 1), ("[0.0, 0.1)", 0, 0, 0), ("[0.9, 1.0]", 1, 0, None), ("[0.9, 1.0)", 1, 1, None), ("[0.9, 1.0)", 1, 1, 0), ("[0.9, 1.0)", None, None, None), ("[0.5, 0.6)", 1, 1, 1)]


def test_kappa(spark):
    df = spark.createDataFrame(VOTES, "perspective_bin string, P int, L int, M int")
    got = {r.bin: r for r in annotation.kappa_by_bin(df, "perspective_bin", ("P", "L", "M")).collect()}
    assert got["[0.0, 0.1)"].kappa_fleiss == 1.0 and got["[0.0, 0.1)"].majority == "tie"
    assert got["[0.5, 0.6)"].single_category and got["[0.5, 0.6)"].kappa_randolph == 1.0
    assert got["[0.9, 1.0)"]["items"] == 1
    filled = {r.bin: r for r in annotation.kappa_by_bin(df, "perspective_bin", ("P", "L", "M"), True).collect()}
    assert filled["[0.9, 1.0)"]["items"] == 2
    assert annotation.missing_votes(df, ("P", "L", "M")).first()[0] == 5
    with pytest.raises(ValueError):
        annotation.annotator_columns(df.drop("M"))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1), st.integers(0, 1)), min_size=2, max_size=20))
def test_randolph_is_at_least_fleiss(spark, votes):
    df = spark.createDataFrame([("[0.1, 0.2)", *v) for v in votes], "perspective_bin string, P int, L int, M int")
    r = annotation.kappa_by_bin(df, "perspective_bin", ("P", "L", "M")).first()
    assert r.kappa_randolph >= r.kappa_fleiss - 1e-4
    if len(votes) == 20:
        assert (r.unanimous - 5) / 15 == pytest.approx(r.kappa_randolph, abs=1e-4)


def test_coverage_edge_and_venn_sum(spark):
    rates = spark.createDataFrame([("a", 10, 9, 1), ("b", 10, 8, 8), ("c", 1, 1, 1), ("d", 3, 0, 0)], "user_url string, n_total long, n_en long, n_en_toxic long")
    assert {r.user_url for r in rates.where(users.eligible("en")).collect()} == {"a", "c"}
    got = {r.user_url: r for r in users.binomial_labels(rates, "en").collect()}
    assert got["c"].p_value == pytest.approx(got["c"].baseline)
    assert users.single_review_cases(users.binomial_labels(rates, "en"), "en").first()["users"] == 1
    with pytest.raises(Exception, match="repeats"):
        users.unique_key(spark.createDataFrame([("a",), ("a",)], "user_url string"), "user_url").collect()


def test_vector_mean_equals_chunked_mean(spark):
    df = spark.createDataFrame([("u", [1.0, 2.0]), ("u", [3.0, 6.0]), ("v", []), ("w", None)], "user_url string, vector array<double>")
    got = users.vector_means(df.repartition(3), "user_url", "vector").collect()
    assert [(r.user_url, r.n, r["mean"]) for r in got] == [("u", 2, [2.0, 4.0])]


def test_profiles_by_url(spark):
    labels = spark.createDataFrame([("http://x/id/a//",), ("http://x/b",)], "user_url string")
    prof = spark.createDataFrame([("http://x/id/a", "s", -1, True), ("http://x/zz", "t", 2, None)], "steam_url string, steam_id string, awards long, has_ban boolean")
    got = users.profile_metadata(labels, prof).collect()
    assert len(got) == 1 and got[0].awards is None and got[0].is_vanity and got[0].has_ban


def test_tfidf_lexicon_of_two_documents(spark):
    docs = spark.createDataFrame([(1, "aa bb aa", "x"), (2, "bb cc", "y"), (3, "", "y")], "k int, clean string, g string")
    means = {(r.g, r.term): r["mean"] for r in tfidf.fit_group_means(docs, "k", "clean", "g", min_df=1, max_df=1.0).collect()}
    idf = {t: math.log(4 / (n + 1)) + 1 for t, n in (("aa", 1), ("bb", 2), ("cc", 1))}
    z = math.hypot(2 * idf["aa"], idf["bb"])
    assert means[("x", "aa")] == pytest.approx(2 * idf["aa"] / z)
    assert means[("y", "cc")] == pytest.approx(idf["cc"] / math.hypot(idf["bb"], idf["cc"]) / 2)


def test_language_scores_and_cache(spark):
    df = spark.createDataFrame([("a", "the cat is in the house and it is not big"), ("b", "curto"), ("c", None), ("d", "zzz qqq www kkk jjj xxx ppp")], "review_url string, review_text string")
    got = {r.review_url: (r.review_lang, r.detection_confidence) for r in scoring.with_language(df).collect()}
    assert got["a"][0] == "en" and got["b"] == ("und", 0.0) == got["c"] == got["d"]

    def boom(texts):
        raise RuntimeError

    rows = df.withColumn("review_lang", F.lit("en")).withColumn("perspective_declared_language", F.lit("en"))
    assert {r.s for r in rows.where("review_text is not null").select(scoring.score_texts(F.col("review_text"), boom).alias("s")).collect()} == {-1.0}
    cache = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "review_url string, detoxify_score double")
    out = {r.review_url: r.detoxify_score for r in scoring.score_reviews(rows, ("en",), "detoxify_score", scoring.hash_scorer, cache, exclude="curto").collect()}
    assert out["a"] == 0.25 and out["b"] != 0.75 and out["c"] is None and 0 <= out["d"] <= 1


def test_examples(spark, sf_dir):
    reviews = tables.reviews(spark, sf_dir)
    with pytest.raises(ValueError):
        examples.pick(reviews, 3)
    got = examples.with_context(examples.pick(reviews, 5, venn="perspective_only"))
    assert got.count() == 5 and got.first().game_name is None
    assert examples.sample_per_group(reviews, "review_lang", 3, "review_url").count() == 12
    assert examples.sample_fraction(reviews, 0.25, "review_url").count() == 250


def test_topics_rules(spark):
    assert topics.rescaled_size(10, None, 5) == 10 and topics.rescaled_size(10, 100, 50) == 5 and topics.rescaled_size(3, 100, 1) == 2
    ladder = spark.createDataFrame([(0.1, 0.9, 3), (0.2, 0.9, 12), (0.3, 0.2, 20)], "fraction double, overlap double, topics long")
    assert topics.stable_fraction(ladder).first()[0] == 0.2 and topics.stable_fraction(ladder.where("fraction < 0.2")).first()[0] == 1.0
    words = spark.createDataFrame([(0, "aa", 1.0), (1, "bb", 1.0), (-1, "cc", 1.0)], "topic int, term string, weight double")
    assert topics.topic_overlap(words, words).first()["overlap"] == pytest.approx(1.0)
    docs = spark.createDataFrame([("aa xx",), ("bb yy",), ("aa xx bb",)], "review_text_clean string")
    two = spark.createDataFrame([(0, "aa"), (0, "xx"), (1, "bb"), (1, "yy")], "topic int, term string")
    assert -1 <= topics.coherence(docs, two).first()[0] <= 1
    assert topics.coherence(docs, two.where("topic = 0")).first()[0] == 0.0
    t = spark.createDataFrame([(-1, 50.0, ["a"], ["x"]), (0, 25.0, ["lag", "fps"], ["x"]), (1, 25.0, [], [])], "topic int, share double, words array<string>, examples array<string>")
    got = {r.topic: (r.label, r.category) for r in scoring.label_topics(t, lambda p: 'ok {"label":"Slow","category":"product_complaint"}').collect()}
    assert got == {-1: ("outlier", "other"), 0: ("Slow", "product_complaint"), 1: ("no data", "other")}
    assert {r.topic: r.category for r in scoring.label_topics(t).collect()}[0] == "product_complaint"
    assert {r.topic: r.category for r in scoring.label_topics(t, lambda p: '{"label":"Slow","category":"performance"}').collect()}[0] == "product_complaint"
    again = spark.createDataFrame([(2, 1.0, ["buy"], ["x", "x", "x"])], "topic int, share double, words array<string>, examples array<string>")
    r = scoring.label_topics(again).first()
    assert (r.category, r.copypasta_suspected, r.copypasta_evidence) == ("copypasta_repetition", True, "2 of 3 examples repeat another")
    r = scoring.label_topics(again, lambda p: '{"label":"Buy","description":"Messages that sell.","category":"other","copypasta_suspected":false}').first()
    assert (r.label, r.description, r.category, r.copypasta_suspected, r.copypasta_evidence) == ("Buy", "Messages that sell.", "other", False, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", -1)], "k string, v int")
    p = f"file://{tmp_path}/t"
    assert sinks.append_new(df, p, "k").count() == 2
    assert sorted(r.k for r in spark.read.parquet(p).collect()) == ["a", "b"]
    sinks.append_new(df.union(spark.createDataFrame([("c", 3)], "k string, v int")), p, "k")
    assert spark.read.parquet(p).count() == 3
    sinks.write_csv_with_bom(df, f"file://{tmp_path}/x.csv")
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfk,v")
    sinks.write_report(spark, df.agg(F.count("*").alias("n"), F.collect_list("k").alias("ks")), f"file://{tmp_path}/r.json")
    assert '"n": 2' in (tmp_path / "r.json").read_text()
    q = f"file://{tmp_path}/s"
    assert sinks.resume_stage(spark, q, {"a": 1}, lambda: df).count() == 2 == sinks.resume_stage(spark, q, {"a": 1}, lambda: None).count()
    with pytest.raises(ValueError):
        sinks.resume_stage(spark, q, {"a": 2}, lambda: df)
    assert tables.Settings.from_json('{"language":"pt","nope":1}').with_(n_trials=3).n_trials == 3


def test_stream_counts(spark, tmp_path):
    from spindrift.streaming import scoring as streaming

    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'en' AS review_lang, 'en' AS perspective_declared_language, 'hello' AS review_text, 0.9D AS perspective_score, 0.1D AS detoxify_score")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.toxic_counts(streaming.score_stream(stream, ("en",)).withColumn("detoxify_score", F.lit(0.2)), "ts").writeStream.outputMode("complete").format("memory").queryName("toxic").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.n_toxic) for r in spark.sql("select * from toxic").collect()] == [(1, 1)]
