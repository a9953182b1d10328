"""Readers and writers: delimited text, JSON lines, Parquet and streams of them; inspection of delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql import types as T

DELIMITERS = (",", ";", "\t", "|")


def detect_delimiter(header: str) -> str:
    """The delimiter that splits the header line into most fields outside quotes."""
    def fields(d: str) -> int:
        inside, n = False, 1
        for c in header:
            inside ^= c == '"'
            n += c == d and not inside
        return n

    return max(DELIMITERS, key=fields)


def normal_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text; the delimiter is taken from the first line where none is given, types from the text where there is no schema."""
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = detect_delimiter(first[0].value if first else "")
    reader = spark.read.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def split_xy(df: DataFrame, target: str | None = None, time: str | None = None, features: list[str] | None = None) -> DataFrame:
    """x array<float>, y float and t: the target is the last column, features the others, unless named."""
    target = target or df.columns[-1]
    features = features or [c for c in df.columns if c not in (target, time)]
    t = F.lit(None).cast("double")
    if time:
        t = F.unix_micros(F.col(time).cast("timestamp")).cast("double") if isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(time).cast("double")
    return df.select(F.array(*(F.col(c).cast("float") for c in features)).alias("x"), F.col(target).cast("float").alias("y"), t.alias("t"))


def inspect(df: DataFrame) -> DataFrame:
    """column, rows, missing, numeric, datetime counts and a role, for string columns as read without a schema, in one pass."""
    aggs = []
    for i, c in enumerate(df.columns):
        s = F.trim(F.col(c).cast("string"))
        here = s.isNotNull() & (s != "")
        number, date = F.expr(f"try_cast(trim(`{c}`) as double)").isNotNull(), F.expr(f"try_cast(trim(`{c}`) as timestamp)").isNotNull() & F.col(c).cast("string").rlike("[-/:]")
        aggs += [F.count(F.when(~here | s.isNull(), 1)).alias(f"m{i}"), F.count(F.when(here & number, 1)).alias(f"n{i}"), F.count(F.when(here & date, 1)).alias(f"d{i}")]
    row = df.agg(F.count("*").alias("rows"), *aggs)
    long = row.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col(f"n{i}").alias("numeric"), F.col(f"d{i}").alias("dates")) for i, c in enumerate(df.columns)))).alias("x"))
    present = F.col("rows") - F.col("x.missing")
    role = F.when(present == 0, "empty").when(F.col("x.dates") >= 0.6 * present, "time").when(F.col("x.numeric") >= 0.9 * present, "numeric").otherwise("text")
    return long.select("x.column", "rows", "x.missing", "x.numeric", "x.dates", role.alias("role"))


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object per row with its keys in name order."""
    df.select(*sorted(df.columns)).write.json(path)


def write_results(df: DataFrame, path: str, kind: str = "parquet", digits: int = 6, partition_by: tuple[str, ...] = ()) -> None:
    """Doubles rounded; kind is parquet, csv, json or orc."""
    out = df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    writer = out.write.partitionBy(*partition_by) if partition_by else out.write
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of files, as an artifact table."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def extract_series(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """series, t, y: one row per present value of each column."""
    long = df.select(F.col(time).alias("t"), F.explode(F.array(*(F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("y")) for c in columns))).alias("x"))
    return long.select("x.series", "t", "x.y").filter("y is not null")


def batches(df: DataFrame, keys: list[str], position: str, share: float, size: int) -> DataFrame:
    """df with part (train for the first share of each series, val for the rest) and batch, numbered from 0 within the part; position counts from 0."""
    n = F.count("*").over(Window.partitionBy(*keys))
    cut = F.floor(n * share)
    train = F.col(position) < cut
    return df.withColumn("part", F.when(train, "train").otherwise("val")).withColumn("batch", F.floor(F.when(train, F.col(position)).otherwise(F.col(position) - cut) / size))
