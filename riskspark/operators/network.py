"""Network features: shared devices, beneficiaries, transfer degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.times import within
from riskspark.plans.fixpoint import cut

DAYS_90, DAYS_180 = 90 * 24, 180 * 24


def customer_devices(transactions: DataFrame, as_of, hours: int = DAYS_90) -> DataFrame:
    """Distinct (customer, device) pairs with the number of customers on the device."""
    pairs = (transactions.where(F.col("device_id").isNotNull() & within("timestamp", as_of, hours))
             .select("customer_id", "device_id").distinct())
    users = pairs.groupBy("device_id").agg(F.count(F.lit(1)).alias("device_users"))
    return pairs.join(users, "device_id")


def device_sharing(transactions: DataFrame, as_of, hours: int = DAYS_90, many_devices: int = 8) -> DataFrame:
    """Distinct co-users, devices used, largest device audience per customer.

    The co-users of a customer are the union of the members of its devices. Its
    size is the alternating sum, over all sets of its devices, of the number
    of customers that own the whole set: a count per set of devices, whatever the
    number of members, and no pairs. Customers with more than ``many_devices``
    shared devices have too many sets; they (and who meets them) are counted by
    listing their own co-users. Both ways are exact.
    """
    # Read several times below: written once, small next to the transactions.
    sized = cut(customer_devices(transactions, as_of, hours))
    base = sized.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("unique_devices_used"),
        F.max("device_users").alias("max_customers_per_device"))
    shared = sized.where("device_users > 1").select("device_id", "customer_id")
    owners = cut(shared.groupBy("customer_id").agg(F.sort_array(F.collect_list("device_id")).alias("devices")))

    few = owners.where(F.size("devices") <= many_devices)
    sets = few.select("customer_id", F.explode(F.expr(
        "transform(sequence(1L, shiftleft(1L, size(devices)) - 1), m -> named_struct('sign', if(bit_count(m) % 2 = 1, 1L, -1L), "
        "'set', filter(devices, (d, i) -> (shiftright(m, i) & 1) = 1)))")).alias("s")).select("customer_id", "s.*")
    counted = sets.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    light = sets.join(counted, "set").groupBy("customer_id").agg((F.sum(F.col("sign") * F.col("n")) - 1).alias("light"))

    heavy = owners.where(F.size("devices") > many_devices).select("customer_id", F.explode("devices").alias("device_id"))
    met = (heavy.join(shared.withColumnRenamed("customer_id", "partner"), "device_id")
           .where("customer_id <> partner").select("customer_id", "partner").distinct())
    own = met.groupBy("customer_id").agg(F.count(F.lit(1)).alias("partners"))
    theirs = (met.join(few.select(F.col("customer_id").alias("partner")), "partner")
              .groupBy(F.col("partner").alias("customer_id")).agg(F.count(F.lit(1)).alias("partners")))
    return (base.join(light, "customer_id", "left").join(own.unionByName(theirs), "customer_id", "left")
            .select("customer_id",
                    (F.coalesce("light", F.lit(0)) + F.coalesce("partners", F.lit(0)))
                    .cast("bigint").alias("customers_sharing_devices"),
                    "unique_devices_used", "max_customers_per_device"))


def beneficiary_network(transactions: DataFrame, fraud_records: DataFrame, as_of,
                        hours: int = DAYS_180) -> DataFrame:
    """Distinct beneficiaries, how many senders they have, how many are known fraudsters."""
    pairs = (transactions.where(F.col("beneficiary_id").isNotNull() & within("timestamp", as_of, hours))
             .select("customer_id", "beneficiary_id").distinct())
    known = fraud_records.select(F.col("customer_id").alias("beneficiary_id")).distinct() \
        .withColumn("known", F.lit(1))
    beneficiaries = (pairs.groupBy("beneficiary_id").agg(F.count(F.lit(1)).alias("senders"))
                     .join(known, "beneficiary_id", "left"))
    return (pairs.join(beneficiaries, "beneficiary_id").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("unique_beneficiaries"),
        F.avg("senders").alias("avg_senders_per_beneficiary"),
        F.max("senders").alias("max_senders_per_beneficiary"),
        F.count("known").alias("fraudulent_beneficiaries_count")))


def transfer_degrees(transactions: DataFrame, as_of, hours: int = DAYS_90) -> DataFrame:
    """In and out degree and strength of the directed transfer graph."""
    transfer = (F.col("transaction_type") == "transfer") | (F.col("product_type") == "pix")
    edges = (transactions.where(transfer & F.col("beneficiary_id").isNotNull()
                                & within("timestamp", as_of, hours))
             .groupBy("customer_id", "beneficiary_id").agg(F.count(F.lit(1)).alias("weight")))
    out = edges.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("network_out_degree"), F.sum("weight").alias("out_weight"))
    incoming = edges.groupBy(F.col("beneficiary_id").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("network_in_degree"), F.sum("weight").alias("in_weight"))
    joined = out.join(incoming, "customer_id", "full_outer")
    return joined.select(
        "customer_id",
        F.coalesce("network_out_degree", F.lit(0)).cast("bigint").alias("network_out_degree"),
        F.coalesce("network_in_degree", F.lit(0)).cast("bigint").alias("network_in_degree"),
        F.coalesce("out_weight", F.lit(0)).cast("double").alias("network_out_strength"),
        F.coalesce("in_weight", F.lit(0)).cast("double").alias("network_in_strength"))


def fill_network_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({"max_customers_per_device": 1}).fillna(0)


def network_features(transactions: DataFrame, fraud_records: DataFrame, as_of) -> DataFrame:
    """The whole network pillar for every customer or beneficiary seen."""
    joined = (device_sharing(transactions, as_of)
              .join(beneficiary_network(transactions, fraud_records, as_of), "customer_id", "full_outer")
              .join(transfer_degrees(transactions, as_of), "customer_id", "full_outer"))
    return fill_network_defaults(joined)
