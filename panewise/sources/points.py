"""Points: id, value (coordinates), arrival (milliseconds), flag (0: the point itself, 1: a copy that only counts as neighbour)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panewise.errors import ConfigError, ParseError

SCHEMA = "id long, value array<double>, arrival long, flag int"
KAFKA_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("timestamp", T.LongType()), T.StructField("value", T.ArrayType(T.DoubleType()))])


def to_points(df: DataFrame, identity: str | Column, coordinates: str | Column | Sequence[str | Column], arrival: str | Column) -> DataFrame:
    """Points of any table. coordinates: columns, or one array column. arrival: milliseconds, or a timestamp (floored)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    value = F.array(*[col(c).cast("double") for c in coordinates]) if isinstance(coordinates, (list, tuple)) else col(coordinates).cast("array<double>")
    when = col(arrival)
    kind = df.select(when.alias("t")).schema["t"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        when = F.unix_millis(when.cast("timestamp"))
    return df.select(col(identity).cast("long").alias("id"), value.alias("value"), when.cast("long").alias("arrival"), F.lit(0).alias("flag"))


def parsed(text: Column, field: str = "&", value: str = ",") -> Column:
    """The point of a line `id&v1,v2,...`, which arrives at its id; null if the id or every coordinate is unreadable."""
    parts = F.split(F.trim(text), f"\\Q{field}\\E", 2)
    identity = F.get(parts, F.lit(0)).try_cast("long")
    values = F.transform(F.split(F.get(parts, F.lit(1)), f"\\Q{value}\\E"), lambda v: F.trim(v).try_cast("double"))
    good = identity.isNotNull() & F.coalesce(F.exists(values, lambda v: v.isNotNull()), F.lit(False))
    return F.when(good, F.struct(identity.alias("id"), values.alias("value"), identity.alias("arrival"), F.lit(0).alias("flag")))


def parse_lines(lines: DataFrame, field: str = "&", value: str = ",", mode: str = "dropmalformed") -> DataFrame:
    """Points of a table of lines (value). Blank lines are skipped; malformed ones are dropped, or fail the job in mode failfast."""
    if mode not in ("dropmalformed", "failfast"):
        raise ConfigError(f"unknown mode {mode!r}")
    found = lines.where(F.trim("value") != "").select(parsed(F.col("value"), field, value).alias("p"), F.col("value").alias("line"))
    if mode == "failfast":
        bad = F.raise_error(F.concat(F.lit("no point: "), F.col("line")))
        found = found.select(F.when(F.col("p").isNull(), bad.cast(found.schema["p"].dataType)).otherwise(F.col("p")).alias("p"))
    return found.where("p is not null").select("p.*")


def read_text(spark: SparkSession, path: str, field: str = "&", value: str = ",", mode: str = "dropmalformed") -> DataFrame:
    """Points of text files, split by Spark."""
    return parse_lines(spark.read.text(path), field, value, mode)


def from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Points of messages {"id", "timestamp", "value"}; messages without id, time or values are dropped."""
    found = df.select(F.from_json(F.col(column).cast("string"), KAFKA_SCHEMA).alias("m")).where("m.id is not null and m.timestamp is not null and m.value is not null")
    return found.select("m.id", "m.value", F.col("m.timestamp").alias("arrival"), F.lit(0).alias("flag"))


def read_kafka(spark: SparkSession, topic: str, brokers: str, streaming: bool = True, offsets: str = "earliest", **options: str) -> DataFrame:
    """Points of a topic from its first message on. The Kafka connector must be on Spark's class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", offsets)
    return from_json(reader.options(**options).load())


def from_list(spark: SparkSession, points: Iterable[tuple[int, Sequence[float], int] | tuple[int, Sequence[float], int, int]]) -> DataFrame:
    """Points of tuples (id, value, arrival[, flag])."""
    try:
        rows = [(int(p[0]), [float(v) for v in p[1]], int(p[2]), int(p[3]) if len(p) > 3 else 0) for p in points]
    except (TypeError, ValueError, IndexError) as error:
        raise ParseError(str(error)) from error
    return spark.createDataFrame(rows, SCHEMA)


def replayed(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Points of a folder of Parquet files as a stream, so many files in each micro-batch, oldest files first."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sample_values(spark: SparkSession, path: str, limit: int, value: str = ",") -> list[list[float]]:
    """Coordinates of lines `v1,v2,...` of a file, at most `limit`: the bounded sample that a tree is fitted on.

    Of more lines those with the smallest hashes are taken, so that all parts of the file count alike.
    """
    values = F.transform(F.split("value", f"\\Q{value}\\E"), lambda v: F.trim(v).try_cast("double"))
    rows = spark.read.text(path).where(F.trim("value") != "").select(values.alias("v")).where(F.forall("v", lambda v: v.isNotNull()))
    return sorted(list(r["v"]) for r in rows.orderBy(F.xxhash64("v")).limit(limit).collect())
