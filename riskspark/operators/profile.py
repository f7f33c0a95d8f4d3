"""Profile features: who the customer is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.times import as_time, whole_days

# Income codes, share of the KYC score per completed item, typed defaults.
INCOME_CODES = {"low": 1, "medium": 2, "high": 3}
KYC_SHARE = 0.2
TYPE_DEFAULTS = {"int": 0, "float": 0.0, "bool": False, "string": ""}


def fill_typed_defaults(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Replace nulls by the default of the column type."""
    def default(kind: T.DataType):
        if isinstance(kind, T.BooleanType):
            return TYPE_DEFAULTS["bool"]
        if isinstance(kind, T.IntegralType):
            return TYPE_DEFAULTS["int"]
        if isinstance(kind, (T.FractionalType, T.DecimalType)):
            return TYPE_DEFAULTS["float"]
        return TYPE_DEFAULTS["string"] if isinstance(kind, T.StringType) else None

    out = []
    for field in df.schema.fields:
        value = None if field.name in skip else default(field.dataType)
        column = F.col(field.name)
        out.append(column if value is None else
                   F.coalesce(column, F.lit(value).cast(field.dataType)).alias(field.name))
    return df.select(*out)


def age_years(birth: Column, as_of) -> Column:
    """Completed years; a birthday on 29 February counts from 1 March in common years."""
    at = as_time(as_of)
    not_yet = (F.month(at) * 100 + F.day(at)) < (F.month(birth) * 100 + F.day(birth))
    return (F.year(at) - F.year(birth) - not_yet.cast("int")).cast("bigint")


def income_code(bracket: Column) -> Column:
    code = F.lit(0)
    for name, value in INCOME_CODES.items():
        code = F.when(bracket == name, F.lit(value)).otherwise(code)
    return code.cast("int")


def kyc_score() -> Column:
    done = [F.col(c).isNotNull() for c in ("full_name", "email", "phone", "address")]
    done.append(F.coalesce(F.col("income_verified"), F.lit(False)))
    steps = sum((d.cast("int") for d in done), F.lit(0))
    return steps * F.lit(KYC_SHARE)


def active_product_counts(products: DataFrame) -> DataFrame:
    return (products.where(F.col("status") == "active").groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("total_products_count")))


def profile_features(customers: DataFrame, products: DataFrame, risk: DataFrame, as_of) -> DataFrame:
    """All profile columns for all customers in one plan."""
    base = customers.select(
        "customer_id",
        age_years(F.col("birth_date"), as_of).alias("customer_age"),
        whole_days(as_time(as_of), F.col("created_at")).alias("account_age_days"),
        income_code(F.col("income_bracket")).alias("income_bracket_encoded"),
        kyc_score().alias("kyc_completion_score"))
    joined = (base.join(active_product_counts(products), "customer_id", "left")
              .join(risk.select("customer_id", "credit_score_internal", "is_pep"), "customer_id", "left"))
    return fill_typed_defaults(joined, skip=("customer_id",)).select(
        "customer_id", "customer_age", "account_age_days", "total_products_count",
        "credit_score_internal", "is_pep", "income_bracket_encoded", "kyc_completion_score")
