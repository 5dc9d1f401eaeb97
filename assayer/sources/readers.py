"""Dataset scans: every raw column arrives as text and is conformed explicitly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.expressions import clean_text, to_double, to_timestamp
from assayer.operators.contracts import require_columns
from assayer.operators.production import rename_aliases
from assayer.sources.schemas import ALIASES, DATASETS, Dataset


def _unlocked(df: DataFrame) -> DataFrame:
    """Spreadsheet lock files (~$...) are not data."""
    return df.filter(~F.col("SourceFile").startswith("~$"))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files below a folder, columns by name, as text with their file name.

    Files are grouped by header so that differing column orders are united by name.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("enforceSchema", False)
    return _unlocked(raw.csv(path).select("*", F.col("_metadata.file_name").alias("SourceFile")))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True)
    return _unlocked(reader.parquet(path).select("*", F.col("_metadata.file_name").alias("SourceFile")))


def unite(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns missing from a file become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def conform(raw: DataFrame, dataset: Dataset) -> DataFrame:
    """Aliases resolved, required columns checked, values coerced, empty rows dropped."""
    named = rename_aliases(raw, ALIASES.get(dataset.name, []))
    require_columns(named, dataset.required, dataset.name)
    present = {c: target for c, target in dataset.fields.items() if c in named.columns}
    rows = named.dropna(how="all", subset=list(present))
    out = []
    for source, (target, kind) in present.items():
        col = F.col(f"`{source}`")
        if kind == "string":
            value = clean_text(col)
        elif kind == "double":
            value = to_double(col)
        elif kind == "timestamp_ntz":
            value = to_timestamp(col)
        elif kind == "bigint":
            number = to_double(col)
            value = F.when(number % 1 == 0, number).cast("bigint")
        else:
            value = col.try_cast(kind)
        out.append(value.alias(target))
    lineage = [F.col("SourceFile")] if "SourceFile" in named.columns else []
    return rows.select(*out, *lineage)


def read_dataset(spark: SparkSession, root: str, name: str, fmt: str = "csv") -> DataFrame:
    """Scan and conform one dataset from its folder below the root."""
    dataset = DATASETS[name]
    scan = scan_csv if fmt == "csv" else scan_parquet
    return conform(scan(spark, f"{root}/{dataset.folder}"), dataset)


def load_catalogue(spark: SparkSession, root: str, names: list[str], fmt: str = "csv") -> dict[str, DataFrame]:
    return {name: read_dataset(spark, root, name, fmt) for name in names}


def order_status(orders: DataFrame) -> DataFrame:
    """Two-column projection; pruned down to the scan."""
    return orders.select("WO", "Status")


def calendar_year(df: DataFrame, year: int, column: str = "RafMonth") -> DataFrame:
    """Half-open range on the raw column so the predicate reaches the scan."""
    low, high = F.lit(f"{year}-01-01").cast("timestamp_ntz"), F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
    return df.filter((F.col(column) >= low) & (F.col(column) < high))


def teams_from_json(df: DataFrame, column: str = "Workers") -> DataFrame:
    """Crew lists stored as JSON text back to arrays."""
    return df.withColumn(column, F.from_json(column, "array<string>"))


def teams_to_json(df: DataFrame, column: str = "Workers") -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def row_ids(df: DataFrame) -> DataFrame:
    """Surrogate row identity for audit only; never used for semantics."""
    return df.withColumn("SourceRow", F.monotonically_increasing_id())


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size per input file, each file hashed by the task that reads it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_name").alias("SourceFile"), F.sha2("content", 256).alias("Sha256"), F.col("length").alias("Bytes"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint of a table of any size."""
    columns = sorted(df.columns)
    return df.agg(F.count("*").alias("RowCount"), F.bit_xor(F.xxhash64(*columns)).alias("Xor"), F.sum(F.pmod(F.xxhash64(*columns), F.lit(2**31))).alias("HashSum"))


def distinct_extra_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How many rows repeat an earlier identical row."""
    grouped = df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("n"))
    return grouped.agg(F.sum("n").alias("RowCount"), F.count("*").alias("DistinctRows"), F.sum(F.col("n") - 1).alias("ExtraRows"))
