"""Table, CSV, JSON and stream sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed products, the default currency and the entity enums.
PRODUCT_TYPES = ("pix", "ted", "doc", "credit_card", "debit_card", "loan",
                 "investment", "savings_account", "checking_account")
DEFAULT_CURRENCY = "BRL"

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("product_type", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("currency", T.StringType()),
    T.StructField("beneficiary_id", T.StringType()),
    T.StructField("beneficiary_document", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("location_lat", T.DoubleType()),
    T.StructField("location_lon", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("status", T.StringType()),
])


def read_table(spark: SparkSession, source: str, fmt: str | None = None, **options) -> DataFrame:
    """A table as a DataFrame; filters and column choice are pushed into the source.

    ``source`` is a path for file formats, a table name for ``fmt='table'``, and
    the table name for ``fmt='jdbc'`` (give ``url``, ``partitionColumn`` and bounds).
    """
    fmt = fmt or ("parquet" if source.endswith(".parquet") or "/" in source else "table")
    if fmt == "table":
        return spark.table(source)
    reader = spark.read.format(fmt).options(**options)
    return reader.option("dbtable", source).load() if fmt == "jdbc" else reader.load(source)


def write_table(df: DataFrame, target: str, if_exists: str = "fail", *, fmt: str = "parquet",
                partition_by: Sequence[str] = (), as_table: bool = False, **options) -> None:
    """Append to, replace or create a table; ``fail`` refuses an existing target."""
    mode = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}[if_exists]
    writer = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(target) if as_table else writer.save(target)


def read_csv(spark: SparkSession, path: str, schema, timestamp_columns: Sequence[str] = (),
             timestamp_format: str | None = None) -> DataFrame:
    """CSV with a declared schema; named text columns are parsed as timestamps."""
    df = spark.read.csv(path, schema=schema, header=True)
    for name in timestamp_columns:
        parsed = F.try_to_timestamp(F.col(name), F.lit(timestamp_format)) if timestamp_format \
            else F.col(name).try_cast("timestamp")
        df = df.withColumn(name, parsed)
    return df


def write_csv(df: DataFrame, path: str, if_exists: str = "replace") -> None:
    write_table(df, path, if_exists, fmt="csv", header="true")


def flatten_feature_map(df: DataFrame, json_column: str, names: Sequence[str],
                        prefix: str = "") -> DataFrame:
    """JSON feature map to one double column per known name."""
    parsed = F.from_json(json_column, "map<string,double>")
    rest = [c for c in df.columns if c != json_column]
    staged = df.select(*rest, parsed.alias("__map"))
    return staged.select(*rest, *[F.col("__map")[n].alias(prefix + n) for n in names])


def json_summary(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """One row with one JSON text column of aggregate measures."""
    return df.agg(*[e.alias(n) for n, e in measures.items()]).select(
        F.to_json(F.struct(*measures)).alias("summary"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table (column_name, value, n) counting each named column in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return (df.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.value")
            .agg(F.count(F.lit(1)).alias("n")))


def validate_transactions(df: DataFrame, received_at,
                          products: Sequence[str] = PRODUCT_TYPES) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, quarantine); defaults fill currency and timestamp."""
    marked = mark_invalid(df, received_at, products)
    return (marked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            marked.where(F.col("reject_reason").isNotNull()))


def mark_invalid(df: DataFrame, received_at, products: Sequence[str] = PRODUCT_TYPES) -> DataFrame:
    from riskspark.functions.times import as_time

    def missing(name: str) -> Column:
        return F.col(name).isNull()

    reason = (F.when(missing("transaction_id"), "missing_transaction_id")
              .when(missing("customer_id"), "missing_customer_id")
              .when(missing("amount") | ~(F.col("amount") > 0), "amount_not_positive")
              .when(missing("product_type") | ~F.col("product_type").isin(*products), "unknown_product")
              .when(missing("channel"), "missing_channel"))
    currency = F.col("currency") if "currency" in df.columns else F.lit(None).cast("string")
    return (df.withColumn("reject_reason", reason)
            .withColumn("currency", F.coalesce(currency, F.lit(DEFAULT_CURRENCY)))
            .withColumn("timestamp", F.coalesce("timestamp", as_time(received_at))))


def stream_source(spark: SparkSession, path: str | None = None, schema=TRANSACTION_SCHEMA,
                  fmt: str = "parquet", **options) -> DataFrame:
    """Stream of transactions or events: files of a folder, or a message topic.

    With ``fmt='kafka'`` the JSON value is parsed by the schema. A micro-batch takes a
    bounded number of files or messages, so the first one is not the whole table.
    """
    limit = {"maxOffsetsPerTrigger": "1000000"} if fmt == "kafka" else {"maxFilesPerTrigger": "100"}
    reader = spark.readStream.format(fmt).options(**{**limit, **options})
    if fmt == "kafka":
        return reader.load().select(
            F.from_json(F.col("value").cast("string"), schema).alias("row")).select("row.*")
    return reader.schema(schema).load(path)
