"""Result export to CSV, report files and result import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coursequarry import fixed_values as fv
from coursequarry import schemas
from coursequarry.functions.replies import finite_number
from coursequarry.functions.text import resource_id

_ROWS_PER_FILE = 1_000_000
_MOST_COLUMNS = 64


def export_columns(results: DataFrame) -> DataFrame:
    return results.select(
        *[c for c in fv.CSV_COLUMNS if c != "verificado"],
        F.date_format("ultima_verificacion", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("verificado"),
    )


def _write(df: DataFrame, path: str) -> None:
    # A quoted field may hold line ends, so a file is read by one task; files are kept small.
    (
        df.write.mode("overwrite").option("header", True).option("escape", '"')
        .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).option("maxRecordsPerFile", _ROWS_PER_FILE).csv(path)
    )


def export_results(results: DataFrame, path: str) -> None:
    """The ten result columns, with header."""
    _write(export_columns(results), path)


def export_report(report: DataFrame, path: str) -> None:
    _write(report, path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The result columns as text, by the name each file gives them; null where a file lacks one.

    Every file's first record is its header, so files may differ in their columns and in their order. A quoted field
    may hold line ends, so a file is read by one task.
    """
    cells = [f"_c{i}" for i in range(_MOST_COLUMNS)]
    raw = (
        spark.read.schema(", ".join(f"{c} string" for c in cells)).option("header", False).option("escape", '"')
        .option("multiLine", True).csv(path)
        .select(F.array(*cells).alias("celdas"), F.col("_metadata.file_path").alias("fichero"),
                F.monotonically_increasing_id().alias("linea"))
    )
    headers = raw.groupBy("fichero").agg(F.min("linea").alias("primera"), F.min_by("celdas", "linea").alias("nombres"))
    names = F.transform("nombres", lambda n: F.regexp_replace(F.trim(n), "^\ufeff", ""))
    rows = raw.join(headers.withColumn("nombres", names), "fichero").where(F.col("linea") > F.col("primera"))
    return rows.select(*[
        F.try_element_at("celdas", F.nullif(F.array_position("nombres", name), F.lit(0)).cast("int")).alias(name)
        for name in fv.CSV_COLUMNS
    ])


def imported_results(rows: DataFrame, now: Column) -> DataFrame:
    """Result rows from CSV text columns; a missing column or an empty cell takes its default."""
    def cell(name: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast("string")
        return F.nullif(F.col(name), F.lit(""))

    def with_default(name: str) -> Column:
        return F.coalesce(cell(name), F.lit(fv.CSV_DEFAULTS[name])).alias(name)

    url = F.coalesce(cell("url"), F.lit(fv.CSV_DEFAULTS["url"]))
    return rows.select(
        F.coalesce(cell("id"), resource_id(url)).alias("id"),
        with_default("titulo"),
        with_default("url"),
        F.lit(fv.CSV_DESCRIPTION).alias("descripcion"),
        with_default("plataforma"),
        with_default("idioma"),
        with_default("nivel"),
        with_default("categoria"),
        F.lit(None).cast(schemas.CERTIFICACION).alias("certificacion"),
        F.coalesce(finite_number(cell("confianza")), F.lit(fv.CSV_DEFAULT_CONFIDENCE))
        .alias("confianza"),
        with_default("tipo"),
        F.coalesce(cell("verificado").try_cast("timestamp_ntz"), now)
        .alias("ultima_verificacion"),
        F.lit(True).alias("activo"),
        F.struct(
            F.lit(fv.SOURCE_CSV).alias("fuente"),
            F.lit(None).cast("double").alias("relevancia"),
            F.lit(None).cast("boolean").alias("prioritario"),
            F.lit(None).cast("double").alias("confianza_db"),
        ).cast(schemas.METADATOS).alias("metadatos"),
    )


def import_results(spark: SparkSession, path: str, now: Column) -> DataFrame:
    return imported_results(read_csv(spark, path), now)
