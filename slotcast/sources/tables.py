"""Reading and writing tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from ..functions.scalar import safe_divide, zero_fill
from ..session import CODEC

SALES_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("exposed_min", T.DoubleType()),
        T.StructField("mother_code", T.LongType()),
        T.StructField("product_code", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("sales", T.DoubleType()),
    ]
)
TREND_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField(
            "data",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("period", T.StringType()),
                        T.StructField("ratio", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
RESPONSE_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(TREND_SCHEMA))])
WEATHER_SCHEMA = T.StructType(
    [T.StructField("ymd", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("aver", "high", "low", "rain")]
)
TS_FORMAT = "yyyy/MM/dd HH:mm"
TEXT_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Read parquet, CSV (one header line) or JSON lines; text formats need a schema."""
    if fmt != "parquet" and schema is None:
        raise ValueError(f"{fmt} needs an explicit schema")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt != "parquet":
        reader = reader.options(**TEXT_OPTIONS)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> str:
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt != "parquet":
        writer = writer.options(**TEXT_OPTIONS, **({"header": True} if fmt == "csv" else {}))
    else:
        writer = writer.option("compression", CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def normalise_sales(raw: DataFrame, ts_format: str = TS_FORMAT) -> DataFrame:
    """Trim names, cast, zero-fill codes, parse times, derive ymd, exposed and volume."""
    df = raw.toDF(*[c.strip() for c in raw.columns])
    when = df.schema["ts"].dataType
    ts = F.col("ts") if when != T.StringType() else F.try_to_timestamp("ts", F.lit(ts_format))
    df = df.withColumn("ts", ts.cast("timestamp_ntz")).withColumns(
        {
            "mother_code": zero_fill("mother_code"),
            "product_code": zero_fill("product_code"),
            "ymd": F.to_date("ts"),
            "exposed": F.col("exposed_min").cast("double"),
        }
    )
    if "sales" in df.columns:
        df = df.withColumn("volume", safe_divide("sales", "unit_price"))
    return df


def calendar(spark: SparkSession, start: str, end: str, step: str = "interval 1 day") -> DataFrame:
    """Dense date spine from ``start`` to ``end``, both included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(step))
    return spark.range(1).select(F.explode(days).alias("ymd"))


def calendar_of(df: DataFrame, day: str, step: str = "interval 1 day") -> DataFrame:
    """Dense date spine over the range of a date column."""
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return bounds.select(F.explode(F.sequence("lo", "hi", F.expr(step))).alias("ymd"))


def write_report(df: DataFrame, path: str, order: list[str], fmt: str = "csv") -> str:
    """Sorted report as part files in order."""
    return write_table(df.orderBy(*order), path, fmt)


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: column_name, nulls."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns]
    )
    return counts.select(F.inline(pairs))
