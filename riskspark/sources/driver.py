"""Canonical payment tables derived from the given Parquet tables.

Every derivation is plain column arithmetic, so the same rows can be written in
SQL (next to the queries in ``riskspark/catalog``) and the work grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.sources.tables import read_table, stream_source

AS_OF = "2024-01-31 00:00:00"


class DriverTables:
    """Lazily built canonical tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str, streaming: bool = False):
        self.spark = spark
        self.folder = folder
        self.streaming = streaming

    def as_stream(self) -> "DriverTables":
        """The same tables with ``events`` read as a stream of files."""
        return DriverTables(self.spark, self.folder, streaming=True)

    def raw(self, name: str) -> DataFrame:
        if self.streaming and name == "events":
            schema = read_table(self.spark, f"{self.folder}/{name}.parquet").schema
            return stream_source(self.spark, self.folder, schema, pathGlobFilter=f"{name}.parquet")
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    def transactions(self) -> DataFrame:
        e = F.col("event_id")
        user, k = F.col("user_id"), F.col("k").cast("bigint")
        g = F.expr("user_id div 5")
        transfer = (e % 5).isin(0, 1, 3)
        return self.events().select(
            e.alias("transaction_id"),
            user.alias("customer_id"),
            F.element_at(F.array(*map(F.lit, ["pix", "pix", "credit_card", "ted", "loan"])),
                         (e % 5 + 1).cast("int")).alias("product_type"),
            F.element_at(F.array(*map(F.lit, ["transfer", "transfer", "purchase", "transfer", "loan_payment"])),
                         (e % 5 + 1).cast("int")).alias("transaction_type"),
            F.col("value").alias("amount"),
            F.when(transfer, F.when(k < 10, g * 5 + k % 5).otherwise((user * 31 + k * 17) % 150))
            .alias("beneficiary_id"),
            F.when(e % 5 == 2, F.element_at(
                F.array(*map(F.lit, ["5411", "5541", "5812", "7995", "5999"])),
                (k % 5 + 1).cast("int"))).alias("merchant_category"),
            F.element_at(F.array(*map(F.lit, ["mobile_app", "web_browser", "atm", "pos"])),
                         (e % 4 + 1).cast("int")).alias("channel"),
            F.when(k < 2, F.concat(F.lit("RING_"), F.lpad(g.cast("string"), 6, "0")))
            .when(k != 99, F.concat(F.lit("DEV_"), F.lpad((user * 3 + k % 3).cast("string"), 6, "0")))
            .alias("device_id"),
            F.concat(F.lit("10.0."), (k % 16).cast("string"), F.lit("."), (user % 250).cast("string"))
            .alias("ip_address"),
            F.when(e % 7 != 0, F.lit(-23.5) + (k % 10) * 0.05).alias("location_lat"),
            F.when(e % 7 != 0, F.lit(-46.6) + (k % 7) * 0.05).alias("location_lon"),
            F.col("ts").alias("timestamp"),
            F.when(F.col("event_type") == "error", "rejected").otherwise("approved").alias("status"),
            k.alias("k"),
        )

    def customer_events(self) -> DataFrame:
        return self.events().select(
            F.col("event_id"), F.col("user_id").alias("customer_id"),
            F.col("ts").alias("timestamp"),
            F.create_map(*map(F.lit, ["signup", "login", "error", "password_change",
                                      "view", "profile_update", "click", "login",
                                      "purchase", "logout"]))[F.col("event_type")].alias("event_type"),
            F.col("value").alias("session_duration_minutes"))

    def fraud_labels(self) -> DataFrame:
        e, k = F.col("event_id"), F.col("k")
        return self.events().select(
            e.alias("transaction_id"), F.col("user_id").alias("customer_id"),
            F.when((F.col("value") > 150) | (k < 2), 1).otherwise(0).alias("is_fraud"),
            (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("label_timestamp"),
            F.when(e % 11 == 0, F.lit(0.5)).otherwise(F.lit(0.9)).alias("confidence_score"))

    def scored(self) -> DataFrame:
        e, k = F.col("event_id"), F.col("k").cast("bigint")
        return self.events().select(
            e.alias("transaction_id"),
            ((k * 7 % 100) / 100).alias("hub_score"),
            ((e * 13 % 101) / 100).alias("spoke_score"))

    def customers(self) -> DataFrame:
        c = F.col("c_custkey")
        seg = F.col("c_mktsegment")
        return self.raw("customer").select(
            c.alias("customer_id"),
            F.lpad(c.cast("string"), 11, "0").alias("document_number"),
            F.col("c_name").alias("full_name"),
            F.date_add(F.lit("1950-01-01").cast("date"), (c * 37 % 18000).cast("int")).alias("birth_date"),
            F.when(c % 7 != 0, F.concat(F.lit("u"), c.cast("string"), F.lit("@x.test"))).alias("email"),
            F.lpad((c * 97).cast("string"), 11, "0").alias("phone"),
            F.when(c % 5 != 0, F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).alias("address"),
            F.when(seg == "BUILDING", "low").when(seg == "AUTOMOBILE", "medium")
            .when(seg == "MACHINERY", "high").alias("income_bracket"),
            (F.col("c_acctbal") > 0).alias("income_verified"),
            F.when(c % 97 == 3, "closed").otherwise("active").alias("status"),
            self._created(c, 0).alias("created_at"), self._created(c, 0).alias("updated_at"),
            F.col("c_acctbal").alias("account_balance"))

    @staticmethod
    def _created(c, extra_days: int):
        start = F.lit("2015-01-01").cast("date")
        return F.date_add(start, (c * 11 % 3000).cast("int") + extra_days).cast("timestamp_ntz")

    def card_customers(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.raw("customer").where(c % 3 == 0).select(
            (c + 1_000_000).alias("customer_id"),
            F.lpad(c.cast("string"), 11, "0").alias("document_number"),
            F.replace(F.lower("c_name"), F.lit("#"), F.lit(" # ")).alias("cardholder_name"),
            F.date_add(F.lit("1950-01-01").cast("date"), (c * 37 % 18000).cast("int")).alias("birth_date"),
            F.concat(F.lit("U"), c.cast("string"), F.lit("@X.TEST")).alias("email"),
            F.lpad((c * 97).cast("string"), 11, "0").alias("phone"),
            F.when(c % 21 == 0, "blocked").when(c % 2 == 0, "suspended").otherwise("active").alias("card_status"),
            self._created(c, 0).alias("account_opened"), self._created(c, 1).alias("last_updated"))

    def loan_applications(self) -> DataFrame:
        c = F.col("c_custkey")
        doc = F.lpad(c.cast("string"), 11, "0")
        birth = F.when(c % 10 == 0, c * 37 % 18000 + 4000).otherwise(c * 37 % 18000)
        return self.raw("customer").where(c % 5 == 0).select(
            (c + 2_000_000).alias("borrower_id"),
            F.concat(F.substring(doc, 1, 9), F.lit("-"), F.substring(doc, 10, 2)).alias("cpf"),
            F.col("c_name").alias("borrower_name"),
            F.date_add(F.lit("1950-01-01").cast("date"), birth.cast("int")).alias("birth_date"),
            F.lit(None).cast("string").alias("email"),
            F.lpad((c * 97).cast("string"), 11, "0").alias("contact_phone"),
            F.when(c % 35 == 0, "cancelled").otherwise("approved").alias("status"),
            self._created(c, 0).alias("application_date"), self._created(c, 2).alias("last_modified"))

    def customer_products(self) -> DataFrame:
        last = (self.raw("lineitem").groupBy(F.col("l_orderkey").alias("account_id"))
                .agg(F.max("l_shipdate").alias("last_activity")))
        first = F.substring("o_orderpriority", 1, 1)
        return (self.raw("orders").select(
            F.col("o_orderkey").alias("account_id"), F.col("o_custkey").alias("customer_id"),
            F.create_map(*map(F.lit, ["1", "loan", "2", "credit_card", "3", "investment",
                                      "4", "checking_account", "5", "savings_account"]))[first]
            .alias("product_type"),
            F.create_map(*map(F.lit, ["O", "active", "F", "closed", "P", "suspended"]))
            [F.col("o_orderstatus")].alias("status"),
            F.col("o_totalprice").alias("balance"), F.col("o_orderdate").alias("opened_date"))
            .join(last, "account_id", "left"))

    def risk_profile(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.raw("customer").select(
            c.alias("customer_id"), (300 + c * 53 % 551).cast("int").alias("credit_score_internal"),
            (c % 50 == 0).alias("is_pep"))

    def risk_indicators(self) -> DataFrame:
        c = F.col("c_custkey")
        kinds = F.array(
            F.struct(F.lit("pep").alias("t"), F.lit(1.0).alias("v"), (c % 50 == 0).alias("on")),
            F.struct(F.lit("fraud_history").alias("t"), F.lit(1.0).alias("v"), (c % 40 == 0).alias("on")),
            F.struct(F.lit("credit_score_internal").alias("t"), (300 + c * 53 % 551).cast("double").alias("v"),
                     F.lit(True).alias("on")),
            F.struct(F.lit("credit_score_external").alias("t"), (310 + c * 29 % 541).cast("double").alias("v"),
                     (c % 2 == 0).alias("on")))
        return (self.raw("customer").select(c.alias("customer_id"), F.explode(kinds).alias("r"))
                .where("r.on").select("customer_id", F.col("r.t").alias("indicator_type"),
                                      F.col("r.v").alias("indicator_value")))

    def fraud_records(self) -> DataFrame:
        return self.raw("customer").where(F.col("c_custkey") % 40 == 0).select(
            F.col("c_custkey").alias("customer_id"))

    def demo_profiles(self) -> DataFrame:
        """Customer attributes of the modelling table."""
        c = F.col("c_custkey")
        return self.raw("customer").select(
            c.alias("customer_id"), (18 + c * 13 % 63).cast("bigint").alias("age"),
            (F.col("c_acctbal") * 12 + 20000).alias("income"),
            (300 + c * 53 % 551).cast("bigint").alias("credit_score"),
            (1 + c * 11 % 3000).cast("bigint").alias("account_age_days"),
            F.when(c % 50 == 0, 1).otherwise(0).cast("bigint").alias("is_pep"),
            F.when(F.col("c_nationkey") % 6 == 0, 1).otherwise(0).cast("bigint").alias("high_risk_location"))

    def metric_points(self) -> DataFrame:
        e = F.col("event_id")
        return self.events().select(
            F.col("event_type").alias("name"), F.col("ts").alias("timestamp"), F.col("value"),
            F.create_map(F.lit("channel"), F.element_at(
                F.array(*map(F.lit, ["mobile_app", "web_browser", "atm", "pos"])),
                (e % 4 + 1).cast("int"))).alias("labels"),
            e.alias("point_id"))

    def trade_edges(self) -> DataFrame:
        """Larger two-sided graph: customers and suppliers of their orders."""
        return (self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
                .join(self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"),
                                                  "l_suppkey", "l_extendedprice", "l_linenumber"), "o_orderkey")
                .select(F.concat(F.lit("C"), "o_custkey").alias("customer_id"),
                        F.concat(F.lit("S"), "l_suppkey").alias("beneficiary_id"),
                        F.col("l_extendedprice").alias("amount"),
                        F.col("o_orderdate").alias("timestamp"),
                        F.lit("trade").alias("product_type")))
