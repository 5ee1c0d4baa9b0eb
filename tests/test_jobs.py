"""Jobs end to end on a small review table."""

import json

import pytest

from spindrift.plans import jobs
from spindrift.sources import tables


@pytest.fixture(scope="module")
def review_dir(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("jobs") / "reviews")
    tables.reviews(spark, sf_dir).write.parquet(path)
    return path


def run(spark, job, **options):
    args = jobs.parser().parse_args([job, *[x for k, v in options.items() for x in (f"--{k.replace('_', '-')}", str(v))]])
    jobs.JOBS[job](spark, args)


@pytest.mark.parametrize("job", ["agreement", "validity", "toxicity_sets", "undetermined", "ascii_art", "boilerplate", "correlation", "language_check", "review_bags", "score_toxicity", "show_examples"])
def test_job_writes(spark, review_dir, tmp_path, job):
    out = str(tmp_path / "out")
    run(spark, job, input=review_dir, output=out, lang="en,fr")
    assert list((tmp_path / "out").glob("part-*"))


def test_user_pipeline_and_diagnostics(spark, review_dir, tmp_path):
    out = str(tmp_path / "users")
    run(spark, "user_pipeline", input=review_dir, output=out, lang="en,fr", coverage=0.8, alpha=0.05)
    assert spark.read.parquet(f"{out}/labels").where("is_toxic_union").count() > 0
    run(spark, "user_diagnostics", input=out, output=str(tmp_path / "diag"), lang="en,fr", coverage=0.8)
    assert (tmp_path / "diag" / "sentiment_union").exists()


def test_term_jobs(spark, review_dir, tmp_path):
    out = str(tmp_path / "terms")
    run(spark, "tfidf_terms", input=review_dir, output=out, lang="en", min_df=5)
    run(spark, "top_terms", input=out, output=str(tmp_path / "top"), lang="en", n=5)
    assert spark.read.option("header", True).csv(str(tmp_path / "top")).count() == 10


def test_kappa_job(spark, tmp_path):
    (tmp_path / "s.csv").write_text('perspective_bin,detoxify_bin,P,L,M\n"[0.1, 0.2)","[0.2, 0.3)",1,1,0\n"[0.1, 0.2)","[0.2, 0.3)",0,0,0\n')
    run(spark, "kappa_table", input=str(tmp_path / "s.csv"), output=str(tmp_path / "k.json"))
    assert len(json.loads((tmp_path / "k.json").read_text())["tables"]) == 2
