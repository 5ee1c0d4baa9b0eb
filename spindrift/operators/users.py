"""Per-user rates, labels, features, and the diagnostics around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import masks, stats
from spindrift.operators import cleaning
from spindrift.sources.tables import PROFILE_FEATURES

# Fixed values.
COVERAGE, ALPHA = 0.90, 0.01
COVERAGES = (0.5, 0.7, 0.8, 0.9, 0.95, 1.0)
THRESHOLDS = ((1, 0.20), (3, 0.20), (5, 0.20), (3, 0.25), (5, 0.25), (5, 0.30))
ALPHAS = (0.05, 0.01, 0.005, 0.001, 0.0001, 0.00001)
UNION = "union"


def roster(df: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Users with an agreeing, valid review in one of the languages."""
    return df.where(masks.agrees(languages) & masks.valid()).select("user_url").distinct()


def user_totals(df: DataFrame, languages: Sequence[str]) -> DataFrame:
    """All reviews, of any language, of the users in scope."""
    return df.join(roster(df, languages), "user_url", "left_semi").groupBy("user_url").agg(F.count("*").alias("n_total"))


def user_rates(df: DataFrame, languages: Sequence[str]) -> DataFrame:
    """user_url, n_total, then n_<lang> and n_<lang>_toxic over agreeing and valid reviews, and their unions: one scan, one shuffle."""
    counted = masks.agrees(languages) & masks.valid()
    per = []
    for lang in languages:
        mine = counted & (F.col("review_lang") == lang)
        per += [F.count_if(mine).alias(f"n_{lang}"), F.count_if(mine & masks.toxic()).alias(f"n_{lang}_toxic")]
    out = df.groupBy("user_url").agg(F.count("*").alias("n_total"), F.count_if(counted).alias("n_in"), *per).where("n_in > 0").drop("n_in")
    total = sum((F.col(f"n_{x}") for x in languages[1:]), F.col(f"n_{languages[0]}"))
    toxic = sum((F.col(f"n_{x}_toxic") for x in languages[1:]), F.col(f"n_{languages[0]}_toxic"))
    return out.withColumn(f"n_{UNION}", total).withColumn(f"n_{UNION}_toxic", toxic)


def coverage(rates: DataFrame, population: str) -> Column:
    return F.try_divide(F.col(f"n_{population}").cast("double"), F.col("n_total").cast("double"))


def eligible(population: str, least: float = COVERAGE) -> Column:
    """At least one review of the population, and a share of all the user's reviews of ``least`` or more."""
    n = F.col(f"n_{population}")
    return (n > 0) & F.coalesce(F.try_divide(n.cast("double"), F.col("n_total").cast("double")) >= least, F.lit(False))


def coverage_distribution(rates: DataFrame, population: str, thresholds: Sequence[float] = COVERAGES) -> DataFrame:
    """Percentiles of coverage, and how many users reach each threshold (of all, and of those with a review in the population)."""
    share = coverage(rates, population)
    some = rates.where(F.col(f"n_{population}") > 0)
    quantiles = F.percentile(share, F.array(*[F.lit(q) for q in (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)]))
    reached = F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(share >= t).alias("users")) for t in thresholds])
    one = some.agg(F.count("*").alias("users_in_population"), F.avg(share).alias("mean"), quantiles.alias("q"), reached.alias("r"))
    whole = rates.agg(F.count("*").alias("users"))
    out = one.crossJoin(F.broadcast(whole)).withColumn("r", F.explode("r"))
    return out.select(
        F.lit(population).alias("population"), F.col("r.threshold").alias("threshold"), F.col("r.users").alias("reached"), "users_in_population", "users",
        F.try_divide(F.col("r.users").cast("double"), F.col("users_in_population").cast("double")).alias("share_in_population"), F.try_divide(F.col("r.users").cast("double"), F.col("users").cast("double")).alias("share_of_all"),
        "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p25"), F.col("q")[2].alias("p50"), F.col("q")[3].alias("p75"), F.col("q")[4].alias("p90"), F.col("q")[5].alias("p95"), F.col("q")[6].alias("p99"),
    )


def pooled_rate(rates: DataFrame, population: str, least: float = COVERAGE) -> DataFrame:
    """One row: the rate of toxic reviews over eligible users; null where none is eligible."""
    own = rates.where(eligible(population, least))
    return own.agg(F.try_divide(F.sum(f"n_{population}_toxic").cast("double"), F.sum(f"n_{population}").cast("double")).alias("baseline"), F.count("*").alias("n_eligible"))


def binomial_labels(rates: DataFrame, population: str, least: float = COVERAGE, alpha: float = ALPHA) -> DataFrame:
    """Eligible users with the chance of as many toxic reviews at the pooled rate, and whether it is below ``alpha``."""
    n, k = f"n_{population}", f"n_{population}_toxic"
    own = rates.where(eligible(population, least)).select("user_url", n, k)
    own = own.crossJoin(F.broadcast(pooled_rate(rates, population, least).select("baseline")))
    out = stats.with_binomial_tail(own, n, k, "baseline", "p_value")
    return out.withColumn("is_toxic", F.col("p_value") < alpha)


def label_users(rates: DataFrame, populations: Sequence[str], least: float = COVERAGE, alpha: float = ALPHA) -> DataFrame:
    """user_url with eligible_, p_value_ and is_toxic_ for each population (null where not eligible); users eligible in none go."""
    out = rates
    for p in populations:
        got = binomial_labels(rates, p, least, alpha).select("user_url", F.col("p_value").alias(f"p_value_{p}"), F.col("is_toxic").alias(f"is_toxic_{p}"))
        out = out.join(got, "user_url", "left").withColumn(f"eligible_{p}", eligible(p, least))
    some = F.array_contains(F.array(*[F.col(f"eligible_{p}") for p in populations]), True)
    return out.where(some).select("user_url", *[f"{kind}_{p}" for p in populations for kind in ("eligible", "p_value", "is_toxic")])


def threshold_grid(rates: DataFrame, population: str, settings: Sequence[tuple[int, float]] = THRESHOLDS, least: float = COVERAGE) -> DataFrame:
    """Users labelled by n >= min_n and rate >= t, a row for each setting."""
    own = rates.where(eligible(population, least))
    n, k = F.col(f"n_{population}"), F.col(f"n_{population}_toxic")
    counts = [F.struct(F.lit(m).alias("min_n"), F.lit(float(t)).alias("rate"), F.count_if((n >= m) & (k / n >= t)).alias("labelled"), F.count("*").alias("n_eligible")) for m, t in settings]
    return own.agg(F.array(*counts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def alpha_grid(labels: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Users labelled at each alpha and at 0.05 over the number of users (strictly below)."""
    p = F.col("p_value")
    one = labels.agg(F.array(*[F.struct(F.lit(f"{a:g}").alias("alpha"), F.count_if(p < a).alias("labelled")) for a in alphas]).alias("r"), F.count("*").alias("n"))
    grid = one.select("n", F.explode("r").alias("r")).select("n", "r.*")
    whole = labels.agg(F.count("*").alias("n"))
    strict = labels.crossJoin(F.broadcast(whole)).groupBy("n").agg(F.count_if(p < F.lit(0.05) / F.col("n")).alias("labelled")).select("n", F.lit("bonferroni").alias("alpha"), "labelled")
    return grid.unionByName(strict)


def single_review_cases(labels: DataFrame, population: str) -> DataFrame:
    """Users with one review, toxic: their p is the baseline."""
    n, k = F.col(f"n_{population}"), F.col(f"n_{population}_toxic")
    return labels.where((n == 1) & (k == 1)).agg(F.count("*").alias("users"), F.min("p_value").alias("p_value"), F.min("baseline").alias("baseline"))


def user_sentiment(df: DataFrame, languages: Sequence[str], keep_failed: bool = False, leave_toxic_out: bool = False, only_of: DataFrame | None = None) -> DataFrame:
    """Mean sentiment and count by population over agreeing and valid reviews.

    A failed score (-1) is left out unless ``keep_failed``.  ``leave_toxic_out`` drops toxic
    reviews; with ``only_of`` just those of the users in it.
    """
    rows = df.where(masks.agrees(languages) & masks.valid() & F.col("sentiment_score").isNotNull())
    if not keep_failed:
        rows = rows.where(F.col("sentiment_score") != -1)
    if leave_toxic_out:
        bad = masks.toxic()
        if only_of is not None:
            marked = rows.join(only_of.select("user_url").distinct().withColumn("_own", F.lit(True)), "user_url", "left")
            rows = marked.where(~(bad & F.coalesce("_own", F.lit(False)))).drop("_own")
        else:
            rows = rows.where(~bad)
    out = []
    for p in (*languages, UNION):
        mine = F.lit(True) if p == UNION else F.col("review_lang") == p
        out += [F.avg(F.when(mine, F.col("sentiment_score"))).alias(f"avg_sentiment_{p}"), F.count_if(mine).alias(f"n_{p}_sentiment")]
    return rows.groupBy("user_url").agg(*out)


def toxic_in_any(labels: DataFrame, populations: Sequence[str]) -> DataFrame:
    some = F.lit(False)
    for p in populations:
        some = some | F.coalesce(F.col(f"is_toxic_{p}"), F.lit(False))
    return labels.where(some).select("user_url")


def labelled_sentiment(labels: DataFrame, sentiment: DataFrame, population: str) -> DataFrame:
    """(user_url, is_toxic, avg_sentiment, n) of the labelled users that have a sentiment in a population."""
    flag, mean, n = f"is_toxic_{population}", f"avg_sentiment_{population}", f"n_{population}_sentiment"
    rows = labels.where(F.col(flag).isNotNull()).join(sentiment.where(F.col(mean).isNotNull()), "user_url")
    return rows.select("user_url", F.col(flag).alias("is_toxic"), F.col(mean).alias("avg_sentiment"), F.col(n).alias("n"))


def vector_means(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, mean): component-wise means, combined before the shuffle; null and empty vectors do not count."""
    cells = vectors.where(F.size(vector) > 0).select(key, F.posexplode(vector).alias("i", "x"))
    per = cells.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    out = per.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("a"))
    return out.select(key, "n", F.transform("a", lambda s: s["m"]).alias("mean"))


def population_vectors(vectors: DataFrame, languages: Sequence[str], leave_toxic_out: bool = False) -> DataFrame:
    """A user's mean vector and count for each population (columns mean_<p>, n_<p>_embedded)."""
    rows = vectors.where(~F.col("is_toxic")) if leave_toxic_out else vectors
    out = None
    for p in (*languages, UNION):
        mine = rows if p == UNION else rows.where(F.col("review_lang") == p)
        got = vector_means(mine, "user_url", "vector").select("user_url", F.col("mean").alias(f"mean_{p}"), F.col("n").alias(f"n_{p}_embedded"))
        out = got if out is None else out.join(got, "user_url", "full")
    return out.withColumns({f"n_{p}_embedded": F.coalesce(f"n_{p}_embedded", F.lit(0)) for p in (*languages, UNION)})


def expand_vector(df: DataFrame, column: str, prefix: str, size: int) -> DataFrame:
    """One float column for each component, for exports."""
    return df.select(*[c for c in df.columns if c != column], *[F.get(F.col(column), F.lit(i)).cast("float").alias(f"{prefix}{i}") for i in range(size)])


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """``df``, failing where a key repeats (checked where the rows are read)."""
    checked = df.groupBy(key).agg(F.count("*").alias("n")).select(F.col(key).alias("_k"), F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast("long")).otherwise(F.col("n")).alias("_n"))
    return df.join(checked, df[key].eqNullSafe(checked["_k"])).where("_n = 1").drop("_k", "_n")


def profile_metadata(labels: DataFrame, users: DataFrame) -> DataFrame:
    """Labelled users with their profiles, by URL without trailing slashes; -1 counters become null."""
    left = labels.withColumn("_k", cleaning.profile_key(F.col("user_url")))
    right = users.withColumn("_k", cleaning.profile_key(F.col("steam_url"))).drop("steam_id", "city", "state/region", "country")
    joined = left.join(right, "_k").withColumn("is_vanity", cleaning.is_vanity(F.col("user_url"))).drop("_k", "steam_url")
    return joined.withColumns({c: F.nullif(c, F.lit(-1)) for c in PROFILE_FEATURES if c in joined.columns and c != "has_ban"})


def profile_sentinel_counts(users: DataFrame) -> DataFrame:
    counters = [c for c in PROFILE_FEATURES if c in users.columns and c != "has_ban"]
    return users.agg(*[F.count_if(F.col(c) == -1).alias(c) for c in counters]).unpivot([], counters, "column", "sentinels")


def feature_table(profiles: DataFrame, labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """Profiles with labels and vectors, each one-to-one on user_url."""
    own = [c for c in labels.columns if c == "user_url" or c not in profiles.columns]
    return unique_key(profiles, "user_url").join(unique_key(labels.select(*own), "user_url"), "user_url", "left").join(unique_key(vectors, "user_url"), "user_url", "left")


def substitute_vectors(features: DataFrame, replaced: DataFrame, label: str, column: str) -> DataFrame:
    """Positives get their vector of ``replaced``; positives without one go."""
    other = replaced.select("user_url", F.col(column).alias("_other"))
    out = features.join(other, "user_url", "left")
    positive = F.coalesce(F.col(label), F.lit(False))
    return out.where(~positive | F.col("_other").isNotNull()).withColumn(column, F.when(positive, F.col("_other")).otherwise(F.col(column))).drop("_other")


def text_bags(df: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """(user_url, n, texts): each user's texts in hash order; ``most`` of them where a trainer caps its bags."""
    row = F.struct(F.xxhash64("review_url", F.lit(seed)).alias("h"), "review_url", "review_text_clean")
    size = F.count("*")
    if most:
        # The cut is made in the sorted rows, before a bag is gathered.
        place = Window.partitionBy("user_url").orderBy(F.xxhash64("review_url", F.lit(seed)), "review_url")
        df = df.withColumn("_r", F.row_number().over(place))
        row, size = F.when(F.col("_r") <= most, row), F.max("_r").cast("bigint")
    bag = F.transform(F.array_sort(F.collect_list(row)), lambda s: s["review_text_clean"])
    return df.groupBy("user_url").agg(size.alias("n"), bag.alias("texts"))


def drop_own_toxic(df: DataFrame, positives: DataFrame) -> DataFrame:
    """Toxic reviews of positive users go; other users keep theirs."""
    own = positives.select("user_url").distinct().withColumn("_p", F.lit(True))
    return df.join(own, "user_url", "left").where(~(F.coalesce("_p", F.lit(False)) & F.col("is_toxic_review"))).drop("_p")
