"""Topic stages over encoded texts: reduce, cluster, describe, compare, search.

Clusters come from k-means on principal components (Spark ML), in place of density clustering;
clusters under the least size are outliers (topic -1).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import partial
from random import Random

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import masks, stats, text
from spindrift.operators.examples import sample_fraction
from spindrift.sources.sinks import resume_stage
from spindrift.sources.tables import Settings

OUTLIER = -1


def topic_texts(df: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """review_url, game_id, is_toxic, review_text_clean of agreeing, valid reviews; the required columns must be there."""
    need = {"review_text", "review_lang", "perspective_declared_language", "perspective_score", "detoxify_score"}
    if missing := need - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = df.where(masks.agrees(languages) & masks.valid())
    return rows.select("review_url", "game_id", masks.toxic().alias("is_toxic"), text.clean_terms(F.col("review_text")).alias("review_text_clean"))


def encodable(df: DataFrame) -> DataFrame:
    return df.where("is_toxic and review_text_clean is not null and trim(review_text_clean) <> ''")


def rescaled_size(size: int, search_rows: int | None, target_rows: int) -> int:
    """A least cluster size found on ``search_rows`` rows, for ``target_rows``; at least 2, unchanged without a basis."""
    return max(2, round(size / search_rows * target_rows)) if search_rows else size


@dataclass
class TopicModel:
    """Fitted stages; ``sizes`` maps clusters to topics (-1 for small ones)."""

    centre: StandardScalerModel
    pca: PCAModel
    clusters: KMeansModel
    topics: dict[int, int]

    def save(self, path: str) -> None:
        """The fitted stages and the topics of the clusters, in a folder that ``load`` reads; the topics come last."""
        for name, stage in (("centre", self.centre), ("pca", self.pca), ("clusters", self.clusters)):
            stage.write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(sorted(self.topics.items()), "cluster int, topic int").coalesce(1).write.mode("overwrite").parquet(f"{path}/topics")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        found = {r["cluster"]: r["topic"] for r in spark.read.parquet(f"{path}/topics").collect()}
        return cls(StandardScalerModel.load(f"{path}/centre"), PCAModel.load(f"{path}/pca"), KMeansModel.load(f"{path}/clusters"), found)

    @classmethod
    def load_or_fit(cls, spark: SparkSession, path: str, fit) -> TopicModel:
        """The model at ``path``, or else the one that ``fit`` makes, saved there."""
        try:
            return cls.load(spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        model = fit()
        model.save(path)
        return model

    def assign(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        out = self.clusters.transform(reduce_vectors(df, self.centre, self.pca, vector))
        mapped = F.create_map(*[F.lit(x) for pair in self.topics.items() for x in pair])
        return out.withColumn("topic", F.coalesce(mapped[F.col("_cluster")], F.lit(OUTLIER))).drop("_cluster", "_centred", "_v", "pc")


def fit_pca(df: DataFrame, vector: str, k: int) -> tuple[StandardScalerModel, PCAModel]:
    """Principal components of centred vectors (Spark ML's own transform does not centre)."""
    v = df.withColumn("_v", array_to_vector(F.col(vector)))
    centre = StandardScaler(inputCol="_v", outputCol="_centred", withMean=True, withStd=False).fit(v)
    return centre, PCA(k=k, inputCol="_centred", outputCol="pc").fit(centre.transform(v))


def reduce_vectors(df: DataFrame, centre: StandardScalerModel, pca: PCAModel, vector: str = "vector") -> DataFrame:
    return pca.transform(centre.transform(df.withColumn("_v", array_to_vector(F.col(vector)))))


def components(df: DataFrame) -> DataFrame:
    return df.withColumn("pc", vector_to_array("pc", "float32"))


def fit_topics(df: DataFrame, k: int, n_components: int, min_size: int, vector: str = "vector", seed: int = 42) -> TopicModel:
    centre, pca = fit_pca(df, vector, n_components)
    reduced = reduce_vectors(df, centre, pca, vector)
    model = KMeans(k=k, seed=seed, featuresCol="pc", predictionCol="_cluster").fit(reduced)
    sizes = sorted(((r["count"], r["_cluster"]) for r in model.transform(reduced).groupBy("_cluster").count().collect()), key=lambda x: (-x[0], x[1]))
    kept = [c for n, c in sizes if n >= min_size]
    return TopicModel(centre, pca, model, {c: (kept.index(c) if c in kept else OUTLIER) for _, c in sizes})


def topic_words(assigned: DataFrame, cleaned: str = "review_text_clean", n: int = 10) -> DataFrame:
    """Class-based term weights tf * ln(1 + mean words / corpus tf); the n top words of each topic."""
    words = assigned.select("topic", F.explode(text.tokens(F.col(cleaned))).alias("term")).where(F.length("term") >= 2)
    tf = words.groupBy("topic", "term").agg(F.count("*").alias("tf"))
    sizes = tf.groupBy("topic").agg(F.sum("tf").alias("words"))
    corpus = tf.groupBy("term").agg(F.sum("tf").alias("all"))
    mean = sizes.agg(F.avg("words").alias("mean_words"))
    w = tf.join(F.broadcast(sizes), "topic").join(corpus, "term").crossJoin(F.broadcast(mean))
    w = w.withColumn("weight", F.col("tf") / F.col("words") * F.log1p(F.col("mean_words") / F.col("all")))
    place = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return w.select("topic", "term", "weight").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n)


def topic_summary(assigned: DataFrame) -> DataFrame:
    """topics, rows, outliers, outlier_rate, smallest."""
    per = assigned.groupBy("topic").agg(F.count("*").alias("n"))
    out = F.col("topic") == OUTLIER
    one = per.agg(F.count_if(~out).alias("topics"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("outliers"), F.min(F.when(~out, F.col("n"))).alias("smallest"))
    return one.withColumn("outlier_rate", F.try_divide(F.col("outliers").cast("double"), F.col("rows").cast("double")))


def real_counts(info: DataFrame, assigned: DataFrame) -> DataFrame:
    """Topic table with counts over all the data, the largest first."""
    counts = assigned.groupBy(F.col("topic").alias("Topic")).agg(F.count("*").alias("Count_Real"))
    return info.join(F.broadcast(counts), "Topic", "left").withColumn("Count_Real", F.coalesce("Count_Real", F.lit(0))).orderBy(F.desc("Count_Real"), "Topic")


def other_topics(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_if(F.col("category") == "other").alias("other_topics"))


def topic_overlap(a: DataFrame, b: DataFrame, n: int = 10) -> DataFrame:
    """Mean over the topics of ``a`` of the largest cosine with a topic of ``b`` (term weights; outliers and topics after the n-th go).

    Topics are at most n on each side, so every pair of them is compared.
    """

    def vectors(df: DataFrame) -> DataFrame:
        return df.where((F.col("topic") != OUTLIER) & (F.col("topic") < n))

    left, right = vectors(a), vectors(b)
    dot = left.alias("l").join(right.alias("r"), F.col("l.term") == F.col("r.term")).groupBy(F.col("l.topic").alias("i"), F.col("r.topic").alias("j")).agg(F.sum(F.col("l.weight") * F.col("r.weight")).alias("dot"))
    na = left.groupBy(F.col("topic").alias("i")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("na"))
    nb = right.groupBy(F.col("topic").alias("j")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("nb"))
    best = na.join(dot, "i", "left").join(nb, "j", "left").groupBy("i").agg(F.coalesce(F.max(F.try_divide(F.col("dot"), F.col("na") * F.col("nb"))), F.lit(0.0)).alias("best"))
    return best.agg(F.avg("best").alias("overlap"), F.count("*").alias("topics"))


def vector_overlap(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """The same over dense vectors of few rows on each side."""
    left = a.select(F.col(key).alias("i"), F.col(vector).alias("x"))
    right = b.select(F.col(key).alias("j"), F.col(vector).alias("y"))
    pairs = left.join(F.broadcast(right), F.size("x") == F.size("y"))
    best = pairs.groupBy("i").agg(F.max(stats.cosine(F.col("x"), F.col("y"))).alias("best"))
    return best.agg(F.avg("best").alias("overlap"), F.count("*").alias("topics"))


def coherence(docs: DataFrame, words: DataFrame, cleaned: str = "review_text_clean", window: int = 10) -> DataFrame:
    """Mean normalised pointwise mutual information of topic words, over sliding windows of texts; 0 for under two topics."""
    t = text.tokens(F.col(cleaned))
    n = F.greatest(F.size("t") - window + 1, F.lit(1))
    windows = docs.select(t.alias("t")).where(F.size("t") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_distinct(F.slice("t", i, window)))).alias("w"))
    wanted = words.where(F.col("topic") != OUTLIER).select("topic", "term")
    terms = wanted.select("term").distinct()
    seen = windows.select(F.monotonically_increasing_id().alias("id"), F.explode("w").alias("term")).join(F.broadcast(terms), "term")
    total = windows.agg(F.count("*").cast("double").alias("total"))
    single = seen.groupBy("term").agg(F.count("*").alias("n"))
    pairs = wanted.alias("a").join(wanted.alias("b"), (F.col("a.topic") == F.col("b.topic")) & (F.col("a.term") < F.col("b.term"))).select("a.topic", F.col("a.term").alias("x"), F.col("b.term").alias("y"))
    # Terms of a window are at most ``window``, so its pairs are bounded.
    per = seen.groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("w"))
    both = per.select(F.explode(F.flatten(F.transform("w", lambda x: F.transform(F.filter("w", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p")).select("p.*")
    both = both.groupBy("x", "y").agg(F.count("*").alias("n_xy"))
    got = pairs.join(both, ["x", "y"], "left").join(single.toDF("x", "n_x"), "x", "left").join(single.toDF("y", "n_y"), "y", "left").crossJoin(F.broadcast(total))
    e = F.lit(1e-12)
    pxy = F.coalesce(F.col("n_xy"), F.lit(0)) / F.col("total")
    pmi = F.log((pxy + e) / (F.col("n_x") / F.col("total") * F.col("n_y") / F.col("total")))
    npmi = F.coalesce(pmi / -F.log(pxy + e), F.lit(0.0))
    topics = got.groupBy("topic").agg(F.avg(npmi).alias("c"))
    return topics.agg(F.when(F.count("*") >= 2, F.avg("c")).otherwise(0.0).alias("coherence"))


def objective(outlier_rate: Column, coherence_: Column, n_topics: Column, weight: float = 1.0, least: int = 10) -> Column:
    """What the search makes small: outliers, less weighted coherence, and a penalty for too few topics."""
    return outlier_rate - weight * coherence_ + F.when(n_topics < least, 1 + (least - n_topics)).otherwise(0)


# The search space; least cluster sizes are shares of the corpus.
COMPONENTS, SIZE_SHARES = (5, 15), (0.000208, 0.006241)
#: Clusters that k-means is tried with, in place of the neighbours of a density clustering.
CLUSTERS = (5, 50)


def draw_trials(settings: Settings, rows: int) -> list[dict]:
    """``n_trials`` seeded draws from the search space; the first ones are the same for any number of trials."""
    random = Random(settings.seed)
    share = lambda: SIZE_SHARES[0] + random.random() * (SIZE_SHARES[1] - SIZE_SHARES[0])
    return [dict(k=random.randint(*CLUSTERS), n_components=random.randint(*COMPONENTS), min_size=max(2, round(share() * rows))) for _ in range(settings.n_trials)]


def search(docs: DataFrame, settings: Settings, grid: list[dict] | None = None, key: str = "review_url", path: str | None = None) -> DataFrame:
    """Trials on a sample: parameters, topics, outlier_rate, coherence, objective, the best first.

    Under ``path`` each trial is a table, and a later call goes on behind the trials that are there.
    """
    spark = docs.sparkSession
    part = sample_fraction(docs, settings.sample_fraction, key, settings.seed).cache()
    if grid is None:
        n = part.count()
        # No more components than a vector has.
        width = part.select(F.max(F.size("vector"))).first()[0] or 1
        grid = [p | {"n_components": min(p["n_components"], width), "k": min(p["k"], max(2, n))} for p in draw_trials(settings, n)]

    def trial(p: dict) -> DataFrame:
        assigned = fit_topics(part, seed=settings.seed, **p).assign(part).cache()
        s = topic_summary(assigned).first()
        c = coherence(assigned, topic_words(assigned, n=settings.top_words)).first()["coherence"] if s["topics"] > 1 else 0.0
        assigned.unpersist()
        row = (p["k"], p["n_components"], p["min_size"], s["topics"], float(s["outlier_rate"] or 0), float(c))
        return spark.createDataFrame([row], "k int, n_components int, min_size int, topics long, outlier_rate double, coherence double")

    trials = None
    for i, p in enumerate(grid):
        own = asdict(settings) | {"n_trials": None}
        got = resume_stage(spark, f"{path}/trial-{i:04d}", {"trial": i, "parameters": p, "settings": own}, partial(trial, p)) if path else trial(p)
        trials = got if trials is None else trials.unionByName(got)
    part.unpersist()
    return trials.withColumn("objective", objective(F.col("outlier_rate"), F.col("coherence"), F.col("topics"), settings.coherence_weight, settings.min_topics)).orderBy("objective", "k", "n_components", "min_size")


def stability(docs: DataFrame, settings: Settings, k: int, n_components: int, min_size: int, key: str = "review_url") -> DataFrame:
    """(fraction, overlap, topics): topics of each sample size held against those of all the data."""
    full = topic_words(fit_topics(docs, k, n_components, min_size, seed=settings.seed).assign(docs), n=1000)
    rows = []
    for f in settings.stability_fractions:
        part = sample_fraction(docs, f, key, settings.seed)
        size = rescaled_size(min_size, docs.count(), max(1, part.count()))
        own = topic_words(fit_topics(part, k, n_components, size, seed=settings.seed).assign(part), n=1000)
        r = topic_overlap(own, full).first()
        rows.append((float(f), float(r["overlap"] or 0.0), int(r["topics"])))
    return docs.sparkSession.createDataFrame(rows, "fraction double, overlap double, topics long")


def stable_fraction(ladder: DataFrame, threshold: float = 0.85, least_topics: int = 10) -> DataFrame:
    """The first size that is stable and has enough topics; 1.0 where none is."""
    first = ladder.where((F.col("overlap") >= threshold) & (F.col("topics") >= least_topics)).agg(F.min("fraction").alias("f"))
    return first.select(F.coalesce("f", F.lit(1.0)).alias("fraction"))
