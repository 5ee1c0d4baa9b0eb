"""Term weights in long form, group means, and lexicons of distinctive terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.sources.stage import Stages

# Fixed values.
MIN_DF, MAX_DF, MAX_FEATURES, EPSILON = 100, 0.8, 100_000, 1e-9
LEXICON = {"term": "termo", "tfidf_a": "tfidf_toxico", "tfidf_b": "tfidf_neutro", "difference": "diferenca", "ratio": "proporcao_toxico_neutro", "log_ratio": "log_ratio"}
#: Terms that are sent to every task, at most.
SENT = 1 << 18


def term_counts(docs: DataFrame, key: str, cleaned: str, stop: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, term, tf): terms of two characters or more that are no stop words.

    Texts are dealt by key, so that their terms are counted where they are cut.
    """
    dealt = docs.select(key, *keep, cleaned).repartition(key)
    words = dealt.select(key, *keep, F.explode(text.tokens(F.col(cleaned))).alias("term")).where(F.length("term") >= 2)
    if stop:
        words = words.where(~F.col("term").isin(*stop))
    return words.groupBy(key, *keep, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """(term, df, idf); the most frequent by total count where there are more than ``max_features`` (None: all)."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return terms.select("term", "df", (F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1)) + 1).alias("idf"))


def weights(counts: DataFrame, terms: DataFrame, n_terms: int, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, term, w): tf * idf, each document scaled to length 1 over its terms in the vocabulary.

    A vocabulary of at most SENT terms is sent to the tasks, so that only counts of its terms are shuffled, once.
    """
    idf = terms.select("term", "idf")
    raw = counts.join(F.broadcast(idf) if n_terms <= SENT else idf, "term").select(key, *keep, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.withColumn("w", F.col("w") / norm)


def group_means(sizes: DataFrame, group: str, weighted: DataFrame) -> DataFrame:
    """(group, term, mean): sums over a group's documents by the number of all its documents."""
    sums = weighted.groupBy(group, "term").agg(F.sum("w").alias("s"))
    return sums.join(F.broadcast(sizes), group).select(group, "term", (F.col("s") / F.col("n_docs")).alias("mean"))


def fit_group_means(docs: DataFrame, key: str, cleaned: str, group: str, stop: list[str] | None = None, min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """Counts and vocabulary are tables, so texts are cut into terms once and the vocabulary's size is known."""
    stages = Stages(docs.sparkSession, "tfidf")
    sizes = docs.groupBy(group).agg(F.count("*").alias("n_docs"))
    counts = stages.save(term_counts(docs, key, cleaned, stop, (group,)), "counts")
    terms = stages.save(vocabulary(counts, docs.count(), min_df, max_df, max_features), "terms")
    return group_means(sizes, group, weights(counts, terms, terms.count(), key, (group,)))


def _pivot(means: DataFrame, group: str, names: dict[str, object]) -> DataFrame:
    return means.groupBy("term").agg(*[F.coalesce(F.max(F.when(F.col(group).eqNullSafe(F.lit(v)), F.col("mean"))), F.lit(0.0)).alias(n) for n, v in names.items()])


def lexicon(means: DataFrame, group: str, a: object, b: object) -> DataFrame:
    """Terms by how much more group ``a`` weighs them than ``b``."""
    out = _pivot(means, group, {"tfidf_a": a, "tfidf_b": b})
    ratio: Column = (F.col("tfidf_a") + EPSILON) / (F.col("tfidf_b") + EPSILON)
    out = out.withColumn("difference", F.col("tfidf_a") - F.col("tfidf_b")).withColumn("ratio", ratio).withColumn("log_ratio", F.log2(ratio))
    return out.orderBy(F.desc("difference"), "term")


def venn_lexicon(means: DataFrame, group: str, regions: tuple[str, ...] = ("perspective_only", "detoxify_only", "both")) -> DataFrame:
    """(region, term, tfidf, others, difference, log_ratio): each region against the plain mean of the other regions' means."""
    wide = _pivot(means, group, {r: r for r in regions})
    rows = []
    for r in regions:
        rest = [F.col(o) for o in regions if o != r]
        rows.append(F.struct(F.lit(r).alias("region"), F.col(r).alias("tfidf"), (sum(rest[1:], rest[0]) / len(rest)).alias("others")))
    out = wide.select("term", F.explode(F.array(*rows)).alias("r")).select("r.region", "term", "r.tfidf", "r.others")
    ratio = (F.col("tfidf") + EPSILON) / (F.col("others") + EPSILON)
    return out.withColumn("difference", F.col("tfidf") - F.col("others")).withColumn("log_ratio", F.log2(ratio))


def top_terms(lex: DataFrame, n: int = 15, by: str = "tfidf", key: tuple[str, ...] = ()) -> DataFrame:
    """The n top terms of either class with their ranks; for the neutral class differences count from below."""
    order = {"tfidf": (F.col("tfidf_a"), F.col("tfidf_b")), "difference": (F.col("difference"), -F.col("difference")), "log_ratio": (F.col("log_ratio"), -F.col("log_ratio"))}[by]
    two = F.array(F.struct(F.lit("toxic").alias("class"), order[0].alias("value")), F.struct(F.lit("neutral").alias("class"), order[1].alias("value")))
    rows = lex.withColumn("c", F.explode(two)).select(*key, "term", "c.class", "c.value")
    place = Window.partitionBy(*key, "class").orderBy(F.desc("value"), "term")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def top_per_region(lex: DataFrame, n: int = 10) -> DataFrame:
    place = Window.partitionBy("region").orderBy(F.desc("difference"), "term")
    return lex.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)
