"""Readers, schemas and the stand-in review table over the driver's documents."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw names to ours, columns that go, types.
REVIEW_NAMES = {
    "recomendado": "is_recommended", "dataPublicacao": "review_date", "texto": "review_text", "horasJogadas": "hours_played", "nomeUsuario": "user_url",
    "linkComentario": "review_url", "id": "game_id", "language": "perspective_declared_language", "toxicity": "perspective_score",
}
REVIEW_DROPS = ("respostaDev", "linkDentroTexto", "title", "numComentarios", "util", "engracada", "premios")
REVIEW_TYPES = {"review_text": "string", "hours_played": "double", "user_url": "string", "review_url": "string", "perspective_declared_language": "string", "perspective_score": "double", "review_date": "string"}
CRITICAL = ("game_id", "user_url", "review_url", "review_text")
GAME_NAMES = {
    "titulo": "title", "gameId": "game_id", "dataLancamento": "release_date", "dataLancamentoCedo": "early_access_date", "genres": "genres", "desenvolvedor": "developer", "destribuidor": "publisher",
    "serie": "series", "marcadoresPopulares": "popular_tags", "gameRating": "game_rating", "reviewsRecentes": "recent_reviews_rating", "qntdReviewsRecentes": "recent_reviews_count",
    "porcentagemRecente": "recent_reviews_percentage", "reviews": "all_time_reviews_rating", "qntdReviews": "all_time_reviews_count", "porcentagem": "all_time_reviews_percentage", "preco": "price",
    "requisitos": "requirements", "requisitosMinimos": "minimum_requirements", "metascore": "metascore", "texto_ia": "ai_disclosure", "texto_mature": "mature_content_disclosure",
    "qntdCuradores": "curators_count", "dlc_id": "dlc_id", "grafico": "has_review_bombing", "idiomas_interface": "languages_interface", "idiomas_dublagem": "languages_audio",
    "idiomas_legendas": "languages_subtitles",
}
GAME_DROPS = ("series", "dlc_id")
USER_NAMES = {
    "id": "steam_id", "Nome": "steam_url", "Cidade": "city", "Estado": "state/region", "Pais": "country", "Descricao Perfil": "profile_description", "Nivel": "profile_level", "Ban": "has_ban",
    "Dias Ultimo Ban": "days_since_last_ban", "Motivo Ban": "ban_reason", "Premios": "awards", "Insignias": "insignias", "Total de Jogos": "library_size", "Capturas de Tela": "screenshots",
    "Itens da Oficina": "workshop_items", "Quantidade de Guias": "guides", "Quantidade de Artes": "arts", "Quantidade de Grupos": "groups", "Quantidade de Amigos": "friends_count",
    "idiomas_comentarios": "reviews_langs",
}
USER_DROPS = (
    "comentarios_nao_toxicos", "comentarios_toxicos", "Quantidade de Comentarios", "Quantidade de Comentarios no Perfil", "toxicidade_media", "toxicidade_desvio_padrao", "num_comentarios_total",
    "num_comentarios_recomendados", "num_comentarios_nao_recomendados",
)
USER_STRINGS = ("steam_id", "steam_url", "city", "state/region", "country", "profile_description", "ban_reason")
USER_COUNTERS = ("profile_level", "days_since_last_ban", "awards", "insignias", "library_size", "screenshots", "workshop_items", "guides", "arts", "groups", "friends_count")
PROFILE_FEATURES = ("profile_level", "has_ban", "days_since_last_ban", "awards", "insignias", "library_size", "screenshots", "workshop_items", "guides", "arts", "groups", "friends_count")

#: Stand-in for the review table: the same SQL runs on both engines.  The scores are synthetic.
REVIEWS_SQL = """
SELECT concat('r/', CAST(doc_id AS STRING)) AS review_url, text AS review_text, lang AS review_lang,
  CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS perspective_declared_language,
  CASE WHEN doc_id % 11 = 0 THEN concat('u', CAST(doc_id % 55 AS STRING)) WHEN lang = 'en' THEN concat('u', CAST(doc_id % 40 AS STRING))
    ELSE concat('u', CAST(40 + doc_id % 15 AS STRING)) END AS user_url,
  CAST(doc_id % 50 AS BIGINT) AS game_id,
  CASE WHEN doc_id % 53 = 0 THEN CAST(-1.0 AS DOUBLE)
    WHEN doc_id % 40 < 4 THEN least(CAST(1.0 AS DOUBLE), a * a + CAST(0.5 AS DOUBLE)) ELSE a * a END AS perspective_score,
  CASE WHEN doc_id % 41 = 0 THEN CAST(-1.0 AS DOUBLE) ELSE b * b END AS detoxify_score,
  CAST(1 AS DOUBLE) + CAST(4 AS DOUBLE) * CAST((doc_id * 17) % 97 AS DOUBLE) / CAST(96.0 AS DOUBLE) AS sentiment_score,
  doc_id
FROM (SELECT *, CAST((doc_id * 37) % 101 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS a, CAST((doc_id * 61) % 103 AS DOUBLE) / CAST(102.0 AS DOUBLE) AS b FROM {documents}) d
"""


def read_parquet_dir(spark: SparkSession, path: str, recursive: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A directory of Parquet files, flat or (``recursive``) at any depth; other files are left out."""
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in review table (see REVIEWS_SQL)."""
    return spark.sql(REVIEWS_SQL, documents=table(spark, sf_dir, "documents"))


def per_file(df: DataFrame, counts: dict[str, Column], folder: str | None = None) -> DataFrame:
    """(file, *counts) of the files that a scan reads, 0 for files without rows.

    With ``folder``, of that folder's entries: a table that is kept as many part files is one of them.
    """
    at = -1
    if folder is not None:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        root = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath()
        at = len([p for p in root.split("/") if p])
    store = r"^[^/:]+:(//[^/]*)?/+"
    entries = sorted({re.sub(store, "", f).split("/")[at] for f in df.inputFiles()})
    files = df.sparkSession.createDataFrame([(e, unquote(e)) for e in entries], "entry string, file string")
    entry = F.element_at(F.split(F.regexp_replace("_metadata.file_path", store, ""), "/"), at if at < 0 else at + 1)
    found = df.groupBy(entry.alias("entry")).agg(*[c.alias(n) for n, c in counts.items()])
    return files.join(found, "entry", "left").select("file", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def list_files(df: DataFrame, folder: str | None = None) -> DataFrame:
    """(file, rows) of the files that a scan reads, or of the entries of ``folder`` that they are or lie in."""
    return per_file(df, {"rows": F.count("*")}, folder)


def languages(df: DataFrame, column: str = "review_lang") -> DataFrame:
    return df.select(column).dropna().distinct()


def load_language(spark: SparkSession, path: str, language: str) -> DataFrame:
    """One language of a scored table, from ``review_lang=`` folders or a flat column alike."""
    return spark.read.parquet(path).where(F.col("review_lang") == language)


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """Games from a JSON array document, every column of it; lists come as JSON text, as tags may be a list or one string."""
    df = spark.read.option("multiLine", True).json(path)
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.withColumns({f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, nested)})


def flagged(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose flag is set (true, or 1); a null flag is not set."""
    return df.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def tag_list(tags) -> F.Column:
    """A JSON list of tags, or a plain string as the only tag, as an array."""
    parsed = F.from_json(tags, "array<string>")
    return F.when(tags.startswith("["), parsed).when(tags.isNotNull(), F.array(tags)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Settings:
    """Parameters of the topic stages; immutable, changed by ``with_``."""

    language: str = "en"
    n_trials: int = 60
    sample_fraction: float = 0.3
    top_words: int = 10
    coherence_weight: float = 1.0
    min_topics: int = 10
    stability_fractions: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4)
    stability_threshold: float = 0.85
    seed: int = 42

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__}
        return cls(**known)

    @classmethod
    def from_yaml(cls, text: str) -> Settings:
        import yaml

        return cls.from_json(json.dumps(yaml.safe_load(text)))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
