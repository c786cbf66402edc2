"""Files as DataFrames: directories of raw files, CSV, JSON lines, manifests; and writers of derived tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers
from ..functions.text import mojibake_score
from ..plans.registry import query
from ..plans.session import latest, table

MANIFEST = "filename string, title string, category string, source_type string, url string, saved_path string, bytes bigint, content_type string, error string"
MAX_TABLE_ROWS = 500


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content, length, parser (by suffix) and sha256 of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content", parser_of(F.col("path")).alias("parser"), F.sha2("content", 256).alias("sha256"))


def parser_of(path: Column) -> Column:
    name = F.lower(path)
    return (
        F.when(name.rlike(r"\.(png|jpe?g|bmp|tiff?|webp|gif)$"), "ocr").when(name.rlike(r"\.html?$"), "html").when(name.endswith(".docx"), "docx")
        .when(name.rlike(r"\.(xlsx|csv)$"), "table").when(name.endswith(".pptx"), "pptx").when(name.rlike(r"\.(txt|md)$"), "text").otherwise("pdf")
    )


def _score(text: str) -> int:
    """mojibake_score() of one text."""
    return 4 * sum("一" <= c <= "鿿" for c in text) + sum(c.isprintable() for c in text) - 10 * sum(text.count(m) for m in markers.MOJIBAKE)


def decoded(files: DataFrame, encodings: tuple[str, ...] = ("utf-8-sig", "utf-8"), scored: tuple[str, ...] = ("gb18030", "gbk"), lossy: bool = True) -> DataFrame:
    """files with text: the content in the first of encodings that fits, else in that of scored whose text scores best.

    Where none fits (or only to an empty text), with replacement characters if lossy, else null.
    """

    def best(raw: bytes) -> str | None:
        found = []
        for name in scored:
            try:
                found.append(raw.decode(name))
            except UnicodeDecodeError:
                continue
        return max(found, key=_score) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                text = None
                for name in encodings:
                    try:
                        text = bytes(raw).decode(name)
                        break
                    except UnicodeDecodeError:
                        continue
                if text is None:
                    text = best(bytes(raw)) or (bytes(raw).decode("utf-8", "replace") if lossy else None)
                out.append(text)
            yield pd.DataFrame({"path": pdf["path"], "text": out})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


MOJIBAKE_SQL = " + ".join(f"len(string_split(text, '{m}')) - 1" for m in markers.MOJIBAKE)


@query(
    rf"""SELECT doc_id, 4 * length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) + length(regexp_replace(text, '[\p{{C}}\x{{a0}}\x{{3000}}\x{{2028}}\x{{2029}}]', '', 'g')) - 10 * ({MOJIBAKE_SQL}) AS score FROM documents"""
)
def decoding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each text looks like one read in the right charset."""
    return table(spark, sf_dir, "documents").select("doc_id", mojibake_score(F.col("text")).alias("score"))


def csv_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, **options).csv(path)


def csv_fields(texts: DataFrame, schema: str) -> DataFrame:
    """path, line number and the fields of decoded CSV texts (path, text) in encodings that Spark's reader refuses; the first line is the header."""
    lines = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).filter((F.col("line_no") > 0) & (F.trim("line") != ""))
    return lines.select("path", "line_no", F.from_csv("line", schema).alias("f")).select("path", "line_no", "f.*")


def markdown_table(rows: DataFrame, order: Column, most: int = MAX_TABLE_ROWS) -> DataFrame:
    """One row: the first rows as a markdown table, and how many rows there are. A preview of bounded size, by design."""
    cells = lambda cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    names = rows.columns
    first = rows.orderBy(order).limit(most).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), cells([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]).alias("line")))).alias("ls"))
    head = F.array(cells([F.lit(c) for c in names]), cells([F.lit("---") for _ in names]))
    rendered = first.select(F.array_join(F.concat(head, F.transform("ls", lambda x: x["line"])), "\n").alias("markdown"))
    return rendered.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_rows"))))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Objects of a JSON-lines file; blank and malformed lines are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def not_yet_fetched(listed: DataFrame, known: DataFrame) -> DataFrame:
    return listed.join(known.select("filename"), "filename", "left_anti")


# Writers -------------------------------------------------------------------------------------------------------------


def replaced(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """current without the keys that new brings, and new: the table after a replace by key."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upserted(current: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key; of equal versions the one of greatest hash, so that reruns agree."""
    return latest(current.unionByName(new, allowMissingColumns=True), key, version)


def without(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """current without the keys of gone (a delete by document or by tenant)."""
    return current.join(gone.select(key).distinct(), key, "left_anti")


def merged_edges(edges: DataFrame) -> DataFrame:
    """Edges as a set over all their properties."""
    return edges.dropDuplicates(["source", "target", "relationship", "doc_id", "tenant_id", "section_title"])


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes df over the partitions that it holds, and leaves others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_bundle(rows: DataFrame, path: str, outcome: str = "outcome") -> DataFrame:
    """Writes kept and excluded rows as JSON lines and returns the manifest: rows by outcome."""
    rows.filter(F.col(outcome) == "kept").write.mode("overwrite").json(f"{path}/kept")
    rows.filter(F.col(outcome) != "kept").write.mode("overwrite").json(f"{path}/excluded")
    return rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def sync_report(sent: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """(sent, indexed, state): degraded where an index has fewer keys than were sent."""
    both = sent.select(key).distinct().join(written.select(key, F.lit(True).alias("there")).distinct(), key, "left")
    return both.agg(F.count(F.lit(1)).alias("sent"), F.count("there").alias("indexed")).withColumn("state", F.when(F.col("indexed") < F.col("sent"), "degraded").otherwise("ok"))


HISTORY_COLUMNS = "run_id string, created_at string, mode string, samples int, faithfulness double, relevancy double, precision double, recall double, passed boolean, failures string"


def write_history(records: DataFrame, path: str, column: str = "record") -> None:
    """Evaluation records (JSON strings) as CSV files with a header and ten fixed columns; what a record lacks is empty."""
    records.select(F.from_json(column, HISTORY_COLUMNS).alias("r")).select("r.*").write.option("header", True).csv(path)
