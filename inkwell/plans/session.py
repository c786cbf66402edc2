"""Session settings and access to tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side up to which a broadcast hint is given; beyond, the planner shuffles.
BROADCAST_ROWS = 100_000


def session(app: str = "inkwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; cluster settings are left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.master(master) if master else builder
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset, a session in one process gets a temporary folder and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most rows rows (counted without reading more), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kept(df: DataFrame) -> DataFrame:
    """df, worked out once and read from the shared folder from then on; its files go when nothing refers to it any more."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; of equally new ones that with the greatest hash, so that reruns agree."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(F.col(order), F.xxhash64(F.to_json(whole)))).alias("_row")).select("_row.*")


def library(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """The documents table under the names of a document library: tenant, title (first line), section (second line), access level, date.

    wanted: doc_id of the documents to be taken; all if None. They are picked from the table itself, so that no other text is split.
    """
    docs = table(spark, sf_dir, "documents")
    docs = docs if wanted is None else docs.join(wanted.select("doc_id"), "doc_id", "left_semi")
    return docs.select(
        "doc_id",
        F.col("source").alias("tenant_id"),
        F.substring(F.split("text", "\n", 3).getItem(0), 1, 80).alias("title"),  # the rest of the text stays in one piece
        F.substring(F.get(F.split("text", "\n", 3), F.lit(1)), 1, 80).alias("section"),
        F.col("text").alias("content"),
        (F.lit(1) + F.col("doc_id") % 4).cast("int").alias("access_level"),
        F.when(F.col("lang") == "en", "public").otherwise(F.col("lang")).alias("department"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 800).cast("int")).cast("string").alias("updated"),
        "n_chars",
        "lang",
    )


#: The same as library(), for DuckDB.
LIBRARY_SQL = """lib AS (
  SELECT doc_id, source AS tenant_id, substr(string_split(text, chr(10))[1], 1, 80) AS title, substr(string_split(text, chr(10))[2], 1, 80) AS section, text AS content, (DATE '2024-01-01' + (doc_id % 800)::INTEGER)::VARCHAR AS updated,
         (1 + doc_id % 4)::INTEGER AS access_level, CASE WHEN lang = 'en' THEN 'public' ELSE lang END AS department, n_chars, lang
  FROM documents
)"""
