"""One entry point a job: ``python -m spindrift.plans.jobs JOB --input DIR --output DIR [options]``.

Each job reads tables, builds one plan and writes tables or a report; results depend on the
options and the input alone.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import build_session
from spindrift.functions import masks, stats, text
from spindrift.operators import annotation, classifier, cleaning, examples, reports, scoring, tfidf, topics, users
from spindrift.sources import sinks, tables

JOBS: dict[str, Callable[[SparkSession, argparse.Namespace], None]] = {}


def job(f: Callable[[SparkSession, argparse.Namespace], None]):
    JOBS[f.__name__] = f
    return f


def _reviews(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return tables.read_parquet_dir(spark, a.input, recursive=True)


def _languages(a: argparse.Namespace) -> tuple[str, ...]:
    return tuple(a.lang.split(",")) if a.lang else masks.DEFAULT_LANGUAGES


@job
def games(spark, a):
    sinks.write_table(cleaning.clean_games(tables.read_games(spark, a.input)), a.output)


@job
def users_table(spark, a):
    sinks.write_table(cleaning.clean_users(tables.read_parquet_dir(spark, a.input)), a.output)


@job
def dedup(spark, a):
    """Raw reviews to cleaned, deduplicated ones; with --buckets laid out by md5 bucket."""
    cleaned = cleaning.clean_reviews(tables.read_parquet_dir(spark, a.input))
    out = cleaning.dedup_reviews(cleaned)
    if a.buckets:
        out = out.withColumn("bucket", cleaning.md5_bucket(F.col("review_url"), a.buckets))
    sinks.write_table(out, a.output, "bucket" if a.buckets else None)
    sinks.write_report(spark, cleaning.dedup_report(cleaned, "review_url"), f"{a.output}-report.json")
    sinks.write_csv(cleaning.null_summary(spark.read.parquet(a.output)), f"{a.output}-nulls")


@job
def language(spark, a):
    sinks.write_table(scoring.with_language(_reviews(spark, a)), a.output)
    sinks.write_csv(reports.value_counts(spark.read.parquet(a.output), "review_lang"), f"{a.output}-counts")


@job
def language_check(spark, a):
    declared = _reviews(spark, a)
    if a.lang:
        declared = declared.where(F.col("perspective_declared_language").isin(*_languages(a)))
    sinks.write_table(scoring.revalidate_language(declared, least=a.min_length), a.output)
    checked = spark.read.parquet(a.output)
    sinks.write_report(spark, reports.language_validation_summary(checked), f"{a.output}-report.json")
    sinks.write_csv(reports.mismatch_breakdown(checked), f"{a.output}-mismatches")


@job
def agreement(spark, a):
    sinks.write_csv(reports.agreement_summary(_reviews(spark, a), _languages(a)), a.output)


@job
def undetermined(spark, a):
    sinks.write_csv(reports.undetermined_breakdown(cleaning.with_missing(_reviews(spark, a), {"detection_confidence": "double"})), a.output)


@job
def ascii_art(spark, a):
    sinks.write_csv(reports.ascii_art(_reviews(spark, a), a.min_frac, a.min_art_chars, a.limit), a.output)


@job
def boilerplate(spark, a):
    """How the language found changes when boilerplate is taken out first."""
    rows = _reviews(spark, a).where(F.col("review_text").rlike(text.BOILERPLATE_PATTERN))
    found = rows.withColumn("after", scoring.detect_language(F.col("review_text"))["lang"])
    sinks.write_csv(reports.boilerplate_impact(found, "review_lang", "after"), a.output)


@job
def score_toxicity(spark, a):
    cache = spark.read.parquet(a.cache_from) if a.cache_from else None
    out = scoring.score_reviews(_reviews(spark, a), _languages(a), "detoxify_score", scoring.hash_scorer, cache, a.cache_exclude_pattern)
    sinks.append_new(out, a.output, "review_url")


@job
def score_sentiment(spark, a):
    cache = spark.read.parquet(a.cache_from) if a.cache_from else None
    out = scoring.score_reviews(_reviews(spark, a), _languages(a), "sentiment_score", scoring.star_scorer, cache)
    sinks.append_new(out, a.output, "review_url")


@job
def fix_scores(spark, a):
    """Score anew the rows whose text matches --fix-pattern; written beside the old table."""
    fresh = scoring.score_texts(text.clean_for_scoring(F.col("review_text")), scoring.hash_scorer)
    sinks.write_table(sinks.patch_matching(_reviews(spark, a), "review_text", a.fix_pattern, "detoxify_score", fresh), a.output)


@job
def validity(spark, a):
    sinks.write_csv(reports.validity_summary(_reviews(spark, a).where(F.col("review_lang").isin(*_languages(a)))), a.output)


@job
def toxicity_sets(spark, a):
    sinks.write_csv(reports.toxicity_sets(_reviews(spark, a).where(F.col("review_lang").isin(*_languages(a)))), a.output)


@job
def correlation(spark, a):
    rows = _reviews(spark, a).where(masks.agrees(_languages(a)) & masks.valid())
    sinks.write_csv(stats.correlations(rows, "perspective_score", "detoxify_score", "review_lang"), a.output)
    sinks.write_csv(reports.threshold_agreement(rows), f"{a.output}-thresholds")


def _term_docs(spark, a, lang: str) -> DataFrame:
    rows = _reviews(spark, a).where(masks.agrees((lang,)) & masks.valid())
    return rows.select("review_url", F.when(masks.toxic(), "toxic").otherwise("neutral").alias("class"), masks.venn_region().alias("region"), text.clean_terms(F.col("review_text"), text.URL_WIDE).alias("clean"))


@job
def tfidf_terms(spark, a):
    for lang in _languages(a):
        means = tfidf.fit_group_means(_term_docs(spark, a, lang), "review_url", "clean", "class", text.stop_words(lang), a.min_df)
        lex = tfidf.lexicon(means, "class", "toxic", "neutral").withColumnsRenamed(tfidf.LEXICON)
        sinks.write_csv(lex, f"{a.output}/lexicon_{lang}")


@job
def tfidf_venn(spark, a):
    for lang in _languages(a):
        docs = _term_docs(spark, a, lang).where("region is not null")
        lex = tfidf.venn_lexicon(tfidf.fit_group_means(docs, "review_url", "clean", "region", text.stop_words(lang), a.min_df), "region")
        sinks.write_csv(tfidf.top_per_region(lex), f"{a.output}/venn_{lang}")


@job
def top_terms(spark, a):
    back = {v: k for k, v in tfidf.LEXICON.items()}
    schema = "termo string, tfidf_toxico double, tfidf_neutro double, diferenca double, proporcao_toxico_neutro double, log_ratio double"
    every = None
    for lang in _languages(a):
        top = tfidf.top_terms(tables.read_csv(spark, f"{a.input}/lexicon_{lang}", schema).withColumnsRenamed(back), a.n, a.by).withColumn("language", F.lit(lang))
        every = top if every is None else every.unionByName(top)
    sinks.write_csv(every, a.output)


@job
def topic_stages(spark, a):
    """Clean, encode, search, stability, train, infer, export and label, each stage a table that resumes under its settings."""
    (lang,) = _languages(a)[:1]
    s = tables.Settings.from_yaml(spark.sparkContext.wholeTextFiles(a.config).first()[1]) if a.config else tables.Settings(language=lang)
    config = {"settings": s.to_json(), "input": a.input}
    clean = sinks.resume_stage(spark, f"{a.output}/clean", config, lambda: topics.topic_texts(_reviews(spark, a), (lang,)))
    docs = sinks.resume_stage(spark, f"{a.output}/encoded", config, lambda: topics.encodable(clean).withColumn("vector", scoring.encode_texts(F.col("review_text_clean"))))
    trials = sinks.resume_stage(spark, f"{a.output}/trials", config, lambda: topics.search(docs, s, path=f"{a.output}/study"))
    best = trials.orderBy("objective", "k", "n_components", "min_size").first()
    args = (best["k"], best["n_components"], best["min_size"])
    ladder = sinks.resume_stage(spark, f"{a.output}/stability", config, lambda: topics.stability(docs, s, *args))
    fraction = topics.stable_fraction(ladder, s.stability_threshold, s.min_topics).first()[0]
    part = examples.sample_fraction(docs, fraction, "review_url", s.seed)
    size = topics.rescaled_size(args[2], round(s.sample_fraction * docs.count()), part.count())
    model = topics.TopicModel.load_or_fit(spark, f"{a.output}/model", lambda: topics.fit_topics(part, args[0], args[1], size, seed=s.seed))
    assigned = sinks.resume_stage(spark, f"{a.output}/assigned", config, lambda: model.assign(docs).select("review_url", "game_id", "review_text_clean", "topic"))
    words = topics.topic_words(assigned, n=s.top_words).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda w: w["term"]).alias("words"))
    shown = examples.sample_per_group(assigned, "topic", 15, "review_url", s.seed).groupBy("topic").agg(F.array_sort(F.collect_list("review_text_clean")).alias("examples"))
    counts = assigned.groupBy("topic").agg(F.count("*").alias("n"))
    share = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("topic", (F.col("n") * 100.0 / F.col("all")).alias("share"))
    info = share.join(words, "topic", "left").join(shown, "topic", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("words", "examples")})
    sinks.write_csv(topics.real_counts(scoring.label_topics(info).withColumnRenamed("topic", "Topic"), assigned), f"{a.output}/labels")
    sinks.log_run(spark, f"{a.output}/runs", s.language, {"k": args[0], "n_components": args[1], "min_size": size, "fraction": fraction, "objective": best["objective"]})


@job
def user_pipeline(spark, a):
    """Rates, labels, profiles, vectors, features, sentiment with and without toxic reviews."""
    langs, reviews = _languages(a), _reviews(spark, a)
    populations = (*langs, users.UNION)
    sinks.write_table(users.user_rates(reviews, langs), f"{a.output}/rates")
    rates = spark.read.parquet(f"{a.output}/rates")
    sinks.write_table(users.label_users(rates, populations, a.coverage, a.alpha), f"{a.output}/labels")
    labels = spark.read.parquet(f"{a.output}/labels")
    scoped = reviews.where(masks.agrees(langs) & masks.valid()).join(labels.select("user_url"), "user_url", "left_semi")
    vectors = scoped.select("user_url", "review_lang", masks.toxic().alias("is_toxic"), scoring.encode_texts(text.clean_light(F.col("review_text"))).alias("vector"))
    sinks.write_table(users.population_vectors(vectors, langs), f"{a.output}/vectors")
    sinks.write_table(users.population_vectors(vectors, langs, leave_toxic_out=True), f"{a.output}/vectors_leave_toxic_out")
    if "sentiment_score" in reviews.columns:
        sinks.write_table(users.user_sentiment(reviews, langs), f"{a.output}/sentiment")
        sinks.write_table(users.user_sentiment(reviews, langs, leave_toxic_out=True, only_of=users.toxic_in_any(labels, populations)), f"{a.output}/sentiment_leave_toxic_out")
    if a.profiles:
        profiles = users.profile_metadata(labels.select("user_url"), spark.read.parquet(a.profiles))
        sinks.write_table(users.feature_table(profiles, labels, spark.read.parquet(f"{a.output}/vectors")), f"{a.output}/features")


@job
def user_diagnostics(spark, a):
    rates = spark.read.parquet(f"{a.input}/rates")
    for p in (*_languages(a), users.UNION):
        sinks.write_csv(users.coverage_distribution(rates, p), f"{a.output}/coverage_{p}")
        sinks.write_csv(users.threshold_grid(rates, p), f"{a.output}/thresholds_{p}")
        labels = users.binomial_labels(rates, p, a.coverage, a.alpha)
        sinks.write_csv(users.alpha_grid(labels), f"{a.output}/alphas_{p}")
        sinks.write_csv(users.single_review_cases(labels, p), f"{a.output}/single_{p}")
    labels = spark.read.parquet(f"{a.input}/labels")
    for name in ("sentiment", "sentiment_leave_toxic_out"):
        found = labels.join(spark.read.parquet(f"{a.input}/{name}"), "user_url", "left" if name == "sentiment" else "inner")
        for p in (*_languages(a), users.UNION):
            rows = found.withColumn("population", F.lit(p))
            sinks.write_csv(stats.mann_whitney(rows, f"avg_sentiment_{p}", f"is_toxic_{p}", "population"), f"{a.output}/{name}_{p}")


@job
def nested_cv(spark, a):
    """Nested evaluation of one population (--lang, or union)."""
    p = a.lang or users.UNION
    rows = spark.read.parquet(a.input).where(F.col(f"is_toxic_{p}").isNotNull() & F.col(f"mean_{p}").isNotNull())
    if a.leave_toxic_out:
        rows = users.substitute_vectors(rows, spark.read.parquet(a.leave_toxic_out), f"is_toxic_{p}", f"mean_{p}")
    out = classifier.nested_evaluation(rows, f"mean_{p}", f"is_toxic_{p}", "user_url", limit_positives=a.limit, path=f"{a.output}-folds")
    sinks.write_table(out, a.output)
    sinks.write_report(spark, stats.average_precision(spark.read.parquet(a.output), "y_score", "y_true"), f"{a.output}-report.json")


@job
def review_bags(spark, a):
    langs = _languages(a)
    rows = _reviews(spark, a).where(masks.agrees(langs) & masks.valid())
    clean = rows.select("user_url", "review_url", "review_lang", text.clean_light(F.col("review_text")).alias("review_text_clean"), masks.toxic().alias("is_toxic_review")).where("review_text_clean <> ''")
    sinks.write_table(users.text_bags(clean, a.n or None), a.output)


@job
def kappa_table(spark, a):
    sheet = spark.read.option("header", True).option("multiLine", True).csv(a.input)
    names = annotation.annotator_columns(sheet)
    found = {(a.lang or "all", c): annotation.kappa_by_bin(sheet, c, names, a.fill_missing) for c in annotation.BINS if c in sheet.columns}
    sinks.write_report(spark, annotation.agreement_report(found), a.output)


@job
def show_examples(spark, a):
    games_ = cleaning.rename_existing(tables.read_games(spark, a.games), tables.GAME_NAMES).withColumn("popular_tags", tables.tag_list(F.col("popular_tags"))) if a.games else None
    picked = examples.pick(_reviews(spark, a), a.n, toxic=None if a.venn_set else True, venn=a.venn_set, contains=a.contains, games=games_, tag=a.game_tag, seed=a.seed)
    sinks.write_csv(examples.with_context(picked, games_), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=sorted(JOBS))
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    for name in ("lang", "cache-from", "cache-exclude-pattern", "fix-pattern", "config", "profiles", "leave-toxic-out", "games", "venn-set", "contains", "game-tag"):
        p.add_argument(f"--{name}")
    for name, kind, value in (
        ("buckets", int, 0), ("min-length", int, text.DETECT_LEAST), ("min-frac", float, 0.5), ("min-art-chars", int, 20), ("limit", int, None), ("min-df", int, tfidf.MIN_DF),
        ("n", int, 15), ("coverage", float, users.COVERAGE), ("alpha", float, users.ALPHA), ("seed", int, 42),
    ):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--by", choices=("tfidf", "difference", "log_ratio"), default="tfidf")
    p.add_argument("--fill-missing", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    JOBS[args.job](build_session(), args)


if __name__ == "__main__":
    main()
