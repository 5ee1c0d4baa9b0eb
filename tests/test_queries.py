"""Each query against its SQL on the driver's tables."""

import math

import duckdb
import pytest

from spindrift.plans import steps  # noqa: F401 (registers its queries)
from spindrift.plans.queries import _TERM_DOCS, ORACLE, QUERIES, REVIEWS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*[f"`{c}`" for c in names]).collect()) == plain(cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_model_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_operators_get_whole_tables(spark, sf_dir, monkeypatch):
    from spindrift.operators import reports, users
    from spindrift.plans import queries
    from spindrift.sources import tables

    given = {}
    real = users.profile_metadata
    monkeypatch.setattr(reports, "undetermined_breakdown", lambda df: given.setdefault("reviews", df))
    monkeypatch.setattr(users, "profile_metadata", lambda df, profiles: (given.setdefault("profiles", profiles), real(df, profiles))[1])
    queries.q38_und_breakdown(spark, sf_dir)
    queries.q45_feature_table(spark, sf_dir)
    assert given["reviews"].count() == tables.reviews(spark, sf_dir).count() > given["reviews"].where("review_lang = 'und'").count() > 0
    assert given["profiles"].count() == tables.table(spark, sf_dir, "customer").count()
    assert queries._games(spark, sf_dir).count() == tables.table(spark, sf_dir, "part").count()


def test_clean_terms_runs_over_every_review(spark, sf_dir):
    import re
    import unicodedata

    from spindrift.functions import text
    from spindrift.sources import tables

    def brute(t):
        t = re.sub(r"https?://\S+|www\.\S+", " ", t.lower())
        t = re.sub("|".join(text.BOILERPLATE), " ", t, flags=re.I)
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", " ", t)).strip()

    given = {r.review_url: r.review_text for r in tables.reviews(spark, sf_dir).collect()}
    got = {r.review_url: r.clean for r in QUERIES["q52_clean_terms_all"](spark, sf_dir).collect()}
    assert any(t and not t.isascii() for t in given.values())
    assert got == {u: None if t is None else brute(t) for u, t in given.items()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_queries(tmp_path):
    """A copy of the tree without both folders: whatever is left of the pipeline, the rest is registered and imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("spindrift", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "spindrift" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q)"
    for left in (False, True):
        if left and not (root / "corpus_pipeline.py").exists():
            continue
        if left:
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert ran.stdout.split() == [str(len(QUERIES)), "False"], ran.stderr


@pytest.fixture(scope="module")
def many_terms(tmp_path_factory):
    """16 English documents with 100,100 terms in five of them each, and 12 rarer terms in two of those that both scores call toxic."""
    con = duckdb.connect()
    con.execute("create table documents as select range doc_id, 'en' lang, '' as text from range(5000)")
    docs = con.execute(f"""with {REVIEWS}, {_TERM_DOCS} select coalesce(region, 'none'), list(doc_id order by doc_id)[:4] from docs join reviews using (review_url) group by 1 order by 1""").fetchall()
    ids = [i for _, four in docs for i in four]
    assert [r for r, _ in docs] == ["both", "detoxify_only", "none", "perspective_only"] and len(ids) == 16
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["x" + "".join(letters[n // 26**k % 26] for k in range(4)) for n in range(100_100)]
    texts = {i: [w for n, w in enumerate(words) if (n - 3 * k) % 16 < 5] for k, i in enumerate(ids)}
    for i in dict(docs)["both"][:2]:
        texts[i] += [f"zz{c}" for c in letters[:12]]
    sf = tmp_path_factory.mktemp("many-terms")
    con.execute("create table d (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into d values (?, ?, 'en')", [[i, " ".join(t)] for i, t in texts.items()])
    con.execute(f"copy d to '{sf}/documents.parquet'")
    return str(sf)


@pytest.mark.parametrize("name", ["q24_tfidf_lexicon", "q26_top_terms", "q25_tfidf_venn", "q84_top_per_region"])
def test_no_term_is_cut(spark, many_terms, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{many_terms}/documents.parquet'")
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert plain(QUERIES[name](spark, many_terms).select(*names).collect()) == plain(cur.fetchall())


@pytest.mark.parametrize("name", ["q73_cleaning_stats", "q74_list_files"])
@pytest.mark.parametrize("parts", [0, 1, 3])
def test_part_files_are_one_table(spark, sf_dir, tmp_path, name, parts):
    """In a folder whose path has characters that are escaped in a URI; without parts, a table of no rows."""
    sf = tmp_path / "a b+c%20.parquet"
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (df.repartition(parts) if parts else df.limit(0)).write.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert plain(QUERIES[name](spark, str(sf)).select(*names).collect()) == plain(cur.fetchall())
