"""Customer identity: sources, cleaning, record linkage, unified profiles."""

from __future__ import annotations

from collections.abc import Mapping
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.times import as_time, micros, whole_days
from riskspark.operators.profile import age_years
from riskspark.plans.fixpoint import both_ways, connected_components, cut, iterate
from riskspark.plans.similar import SLACK, least_shared, meeting_points, rare_first, ratio_bound, two_of, without_one

# Linkage rules (weight, threshold) and the group threshold.
DOCUMENT, EMAIL, PHONE = 1.0, 0.8, 0.7
NAME_BIRTH, NAME_BIRTH_MIN = 0.9, 0.85
NAME_PHONE, NAME_PHONE_MIN = 0.8, 0.80
MATCH_MIN = 0.8

IDENTITY = ["source_system", "customer_id", "document_number", "full_name", "birth_date",
            "email", "phone", "created_at", "updated_at"]

# Per source, the column names and the allowed states.
SOURCE_COLUMNS = {
    "core_banking": {},
    "credit_cards": {"full_name": "cardholder_name", "created_at": "account_opened",
                     "updated_at": "last_updated"},
    "loans": {"customer_id": "borrower_id", "document_number": "cpf", "full_name": "borrower_name",
              "phone": "contact_phone", "created_at": "application_date", "updated_at": "last_modified"},
}


def source_filter(source: str) -> Column:
    return {"core_banking": F.col("status") == "active",
            "credit_cards": F.col("card_status").isin("active", "suspended"),
            "loans": F.col("status") != "cancelled"}[source]


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Rows in an accepted state from every source system, in one shape."""
    out = None
    for name, df in sources.items():
        columns = SOURCE_COLUMNS[name]
        part = df.where(source_filter(name)).select(
            F.lit(name).alias("source_system"),
            *[F.col(columns.get(c, c)).alias(c) for c in IDENTITY[1:]])
        out = part if out is None else out.unionByName(part)
    return out


def standardize(identities: DataFrame) -> DataFrame:
    """Digits-only document and phone, upper-case single-spaced name, lower-case e-mail."""
    return identities.withColumns({
        "document_number": F.regexp_replace("document_number", r"\D", ""),
        "full_name": F.regexp_replace(F.trim(F.upper("full_name")), r"\s+", " "),
        "phone": F.regexp_replace("phone", r"\D", ""),
        "email": F.trim(F.lower("email"))})


def first_per_source(identities: DataFrame) -> DataFrame:
    """One row per (customer, source): the earliest created, then by content.

    An aggregate, not a window, so many copies of one key combine on the map side.
    """
    rest = [c for c in IDENTITY if c not in ("customer_id", "source_system")]
    order = F.struct("created_at", *[c for c in rest if c != "created_at"])
    kept = identities.groupBy("customer_id", "source_system").agg(
        F.min_by(F.struct(*rest), order).alias("r"))
    return kept.select("source_system", "customer_id", *[F.col("r." + c).alias(c) for c in rest])


def clean_identities(sources: Mapping[str, DataFrame]) -> DataFrame:
    return first_per_source(standardize(union_sources(sources))).select(*IDENTITY)


@F.pandas_udf(T.DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, 1 for two empty texts: stays in generated code."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(1.0)


def _filled(name: str) -> Column:
    column = F.col(name).cast("string")
    return F.when(F.length(column) > 0, column)


def record_variants(identities: DataFrame) -> DataFrame:
    """Distinct field combinations with the smallest and the largest id carrying each."""
    fields = {c: _filled(c) for c in ("document_number", "email", "phone", "full_name", "birth_date")}
    return (identities.select("customer_id", *[e.alias(c) for c, e in fields.items()])
            .groupBy(*fields).agg(F.min("customer_id").alias("rep"), F.max("customer_id").alias("last")))


def candidate_pairs(variants: DataFrame, null_policy: str = "skip") -> DataFrame:
    """Pairs of variants that can reach the match score.

    The rules weigh 4.2 in all, so a pair may lose 0.84.

    ``skip``: with two different documents nothing reaches 0.8. With equal
    documents, if both sides carry an e-mail or both carry a phone, one of
    these must be equal too; only pairs with no such type in common are met on the
    document alone. Where a document is missing, the e-mail, and failing that
    the phone, takes its place as the mandatory rule.

    ``reference``: an empty side passes an exact rule, so documents must be equal or
    one empty, the name with birth date must pass, and only one of e-mail,
    phone and name with phone may fail. Pairs meet on the document unless
    e-mails and phones both differ, and with a document empty on the e-mail or on
    the phone.

    Pairs without an equal identifier can match by name and birth date alone; they
    are found by ``similar_pairs``.
    """
    v = variants.withColumn("has_email", F.col("email").isNotNull()) \
        .withColumn("has_phone", F.col("phone").isNotNull()) \
        .withColumn("has_doc", F.col("document_number").isNotNull())
    fields = v.columns
    a = v.select(*[F.col(c).alias("a_" + c) for c in fields])
    b = v.select(*[F.col(c).alias("b_" + c) for c in fields])

    def meet(*keys: str) -> Column:
        on = F.lit(True)
        for k in keys:
            on = on & (F.col("a_" + k) == F.col("b_" + k))
        return on

    def both(name: str) -> Column:
        return F.col("a_" + name) & F.col("b_" + name)

    # A pair is compared once: smaller id first. Variants with the same smallest id may have other ids that differ.
    ordered = (F.col("a_rep") < F.col("b_rep")) | ((F.col("a_rep") == F.col("b_rep")) & (
        F.struct(*["a_" + c for c in variants.columns]) < F.struct(*["b_" + c for c in variants.columns])))
    email, phone, document = both("has_email"), both("has_phone"), both("has_doc")
    if null_policy == "skip":
        alone, by_phone = ~email & ~phone, ~document & ~email
    else:
        alone, by_phone = ~email | ~phone, ~document
    pairs = [
        a.join(b, meet("document_number", "email") & ordered),
        a.join(b, meet("document_number", "phone") & ordered),
        a.join(b, meet("document_number") & ordered & alone),
        a.join(b, meet("email") & ordered & ~document),
        a.join(b, meet("phone") & ordered & by_phone),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    out = out.select(*[c for c in out.columns if "_has_" not in c])
    # Similar pairs lack a document on one side, so there are none where every variant has one.
    if not variants.where("document_number IS NULL").isEmpty():
        out = out.unionByName(similar_pairs(variants, null_policy))
    return out.distinct()


def similar_pairs(variants: DataFrame, null_policy: str = "skip") -> DataFrame:
    """Pairs of variants without an equal identifier that can match by name and birth date.

    Such a pair lacks a document on one side at least (``skip``: also an e-mail and
    a phone; ``reference``: one of the two), and the ratios of name and birth date add up to 1.7.
    Dates are ten letters long, their ratios steps of a tenth, so a pair meets in one of four places:

    * dates equal, names at 0.7: on the date and a rare pair of letters of the name
    * dates at 0.9, names at 0.8: on the date without one letter and a rare pair of letters
    * dates at 0.8, names at 0.9: on two rare pairs of letters
    * dates at 0.7: on the name

    Where texts of another length stand in place of dates, those that differ in more
    than one letter are only met with the name equal or at 0.9. The side without a
    document carries which other fields it has; the other side meets only
    those it may be paired with. A name that stands with very many dates is
    compared within its name, which is inherent in the rule.
    """
    skip = null_policy == "skip"

    def text(name: str) -> Column:
        out = F.trim(F.lower(F.col(name)))
        return out if skip else F.coalesce(out, F.lit("none"))

    fields = variants.columns
    rows = variants.select(
        "*", text("full_name").alias("name"), text("birth_date").alias("birth"), F.xxhash64(*fields).alias("row"),
        (F.when(F.col("email").isNotNull(), 1).otherwise(0) + F.when(F.col("phone").isNotNull(), 2).otherwise(0)).alias("has"))
    if skip:
        rows = rows.where("name IS NOT NULL AND birth IS NOT NULL")
    rows = cut(rare_first(rows, ["rep", "row"], "name", "grams").withColumn("size", F.char_length("name")))

    def places(kind: int, *of: Column) -> Column:
        return F.xxhash64(F.lit(kind), *of)

    grams, size, birth = F.col("grams"), F.col("size"), F.col("birth")
    alike = meeting_points(grams, size, 0.8)
    keys = F.array_distinct(F.concat(
        F.transform(meeting_points(grams, size, 0.7), lambda g: places(1, birth, g)),
        F.flatten(F.transform(without_one(birth), lambda d: F.transform(alike, lambda g: places(2, d, g)))),
        F.transform(two_of(meeting_points(grams, size, 0.9, 2)), lambda g: places(3, g)),
        F.array(places(4, F.col("name")))))
    bare = F.col("document_number").isNull()
    met = rows.select("rep", "row", "has", bare.alias("bare"), keys.alias("keys"))
    both = F.col("has").bitwiseAND(F.col("left_has"))
    left = met.where("bare").select(F.col("rep").alias("rep1"), F.col("row").alias("row1"), F.col("has").alias("left_has"),
                                    F.explode("keys").alias("place"))
    right = (met.select("rep", "row", "has", "keys", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("left_has"))
             .where(both == 0 if skip else both != 3)
             .select(F.col("rep").alias("rep2"), F.col("row").alias("row2"), "left_has", F.explode("keys").alias("place")))
    one, two = F.struct(F.col("rep1").alias("rep"), F.col("row1").alias("row")), F.struct(F.col("rep2").alias("rep"), F.col("row2").alias("row"))
    pairs = (left.join(right, ["left_has", "place"]).where("rep1 <> rep2 OR row1 <> row2")
             .select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
             .select(F.col("a.rep").alias("a_rep"), F.col("a.row").alias("a_row"), F.col("b.rep").alias("b_rep"), F.col("b.row").alias("b_row")))
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(*[F.col(c).alias(f"{side}_{c}") for c in [*fields, "row", "name", "birth", "grams", "size"]]),
                           [f"{side}_rep", f"{side}_row"])
    # What the lengths and the shared pairs of letters still allow.
    total, shared = F.col("a_size") + F.col("b_size"), F.size(F.array_intersect("a_grams", "b_grams"))
    dates = F.when(F.col("a_birth") == F.col("b_birth"), 1.0).otherwise(ratio_bound(F.col("a_birth"), F.col("b_birth")))
    ratio = F.greatest(F.lit(1.7) - dates, F.lit(0.7))
    close = (shared >= least_shared(total, ratio)) & (2 * F.least("a_size", "b_size") >= total * (ratio - SLACK))
    return pairs.where(close).select(*[f"a_{c}" for c in fields], *[f"b_{c}" for c in fields])


def scored_variants(pairs: DataFrame, fuzzy: str = "matcher", null_policy: str = "skip", at_least: float = 0.0) -> DataFrame:
    """Pairs of variants with ``score``, the weighted share of passed rules.

    Pairs that stay below ``at_least`` whatever their texts are left out before any text is compared.

    ``null_policy='skip'`` leaves a rule out of both sums when a side is empty;
    ``'reference'`` lets exact rules pass on an empty side and compares an empty
    value as the text "none".
    """
    skip = null_policy == "skip"

    def side(prefix: str, name: str) -> Column:
        text = F.trim(F.lower(F.col(f"{prefix}_{name}")))
        return text if skip else F.coalesce(text, F.lit("none"))

    def filled(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & F.col("a_" + n).isNotNull() & F.col("b_" + n).isNotNull()
        return out

    def weighed(rules: list) -> Column:
        total = weights = F.lit(0.0)
        for counts, s, least, weight in rules:
            total = total + F.when(counts & (s >= least), s * weight).otherwise(0.0)
            weights = weights + F.when(counts, weight).otherwise(0.0)
        return F.when(weights > 0, total / weights).otherwise(0.0)

    rules = []
    for name, weight in (("document_number", DOCUMENT), ("email", EMAIL), ("phone", PHONE)):
        equal = F.col("a_" + name) == F.col("b_" + name)
        hit = equal if skip else (~filled(name) | equal)
        rules.append((filled(name) if skip else F.lit(True), F.coalesce(hit, F.lit(False)).cast("double"), 0.9, weight))
    text_rules = [(filled("full_name", other) if skip else F.lit(True), other, least, weight) for other, weight, least in (
        ("birth_date", NAME_BIRTH, NAME_BIRTH_MIN), ("phone", NAME_PHONE, NAME_PHONE_MIN))]
    compared = pairs

    def texts(n: str) -> tuple[Column, Column]:
        return F.coalesce(side("a", n), F.lit("")), F.coalesce(side("b", n), F.lit(""))

    if at_least > 0:
        best = weighed(rules + [(counts, F.lit(1.0), least, weight) for counts, _, least, weight in text_rules])
        compared = pairs.where(best >= at_least)
    ratio = matcher_ratio if fuzzy == "matcher" else edit_ratio
    for n in ("full_name", "birth_date", "phone"):
        compared = compared.withColumn("r_" + n, ratio(*texts(n)))
    for counts, other, least, weight in text_rules:
        rules.append((counts, (F.col("r_full_name") + F.col("r_" + other)) / 2, least, weight))
    return compared.withColumn("score", weighed(rules))


def score_pairs(pairs: DataFrame, fuzzy: str = "matcher", null_policy: str = "skip", at_least: float = 0.0) -> DataFrame:
    """The best score of each pair of smallest ids (``scored_variants``)."""
    return scored_variants(pairs, fuzzy, null_policy, at_least).groupBy(F.col("a_rep").alias("id_a"), F.col("b_rep").alias("id_b")).agg(
        F.max("score").alias("score"))


VARIANT = ["document_number", "email", "phone", "full_name", "birth_date"]


def _matching_variants(identities: DataFrame, fuzzy: str, null_policy: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(ids of every variant that has several, with its number, smallest id and fields; matching pairs of variants)."""
    variants = cut(record_variants(identities).withColumn("variant", F.monotonically_increasing_id()))
    scored = scored_variants(candidate_pairs(variants, null_policy), fuzzy, null_policy, threshold).where(F.col("score") >= threshold)
    rows = identities.where("customer_id IS NOT NULL").select("customer_id", *[_filled(c).alias("i_" + c) for c in VARIANT])
    same = F.lit(True)
    for c in VARIANT:
        same = same & F.col("i_" + c).eqNullSafe(F.col(c))
    members = rows.join(variants.where("last > rep"), same).select("customer_id", "variant", "rep", *VARIANT)
    return members, scored


def _tied(members: DataFrame) -> DataFrame:
    """Exact copies tied to their smallest id."""
    return members.where("customer_id <> rep").select(F.col("rep").alias("id_a"), F.col("customer_id").alias("id_b"), F.lit(1.0).alias("score"))


def matched_pairs(identities: DataFrame, fuzzy: str = "matcher", null_policy: str = "skip",
                  threshold: float = MATCH_MIN) -> DataFrame:
    """All matching id pairs with their best score, smaller id first.

    Texts are compared once for each pair of variants; a pair of variants then stands for every pair of their ids, and a
    variant for every pair of its own, so the result has as many rows as ids match. Copies of which no rule can compare
    anything match nobody and are only tied to their smallest id. ``matched_links`` has fewer rows for the same groups.
    """
    members, scored = _matching_variants(identities, fuzzy, null_policy, threshold)
    members = cut(members.distinct())

    def has(*names: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(n).isNotNull() for n in names])

    known = F.lit(True)
    if null_policy == "skip":
        known = has("document_number") | has("email") | has("phone") | has("full_name", "birth_date")
    pairs = scored.select("score", *[f"{side}_{c}" for side in "ab" for c in ("variant", "rep")])
    for side in "ab":
        ids = members.select(F.col("variant").alias(f"{side}_variant"), F.col("customer_id").alias(f"{side}_other"))
        pairs = pairs.join(ids, f"{side}_variant", "left").withColumn(f"{side}_id", F.coalesce(f"{side}_other", f"{side}_rep"))
    copies = members.where(known).select("variant", F.col("customer_id").alias("a_id")).join(
        members.select("variant", F.col("customer_id").alias("b_id")), "variant").where("a_id < b_id")
    found = pairs.where("a_id <> b_id").select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), "score")
    found = found.unionByName(copies.select(F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), F.lit(1.0).alias("score")))
    return found.unionByName(_tied(members.where(~known))).groupBy("id_a", "id_b").agg(F.max("score").alias("score"))


def matched_links(identities: DataFrame, fuzzy: str = "matcher", null_policy: str = "skip", threshold: float = MATCH_MIN) -> DataFrame:
    """Matching id pairs that connect the same ids as ``matched_pairs``: of the smallest ids of two variants,
    and exact copies tied to their smallest id. As many rows as variants match, however many copies there are."""
    members, scored = _matching_variants(identities, fuzzy, null_policy, threshold)
    links = scored.where("a_rep < b_rep").select(F.col("a_rep").alias("id_a"), F.col("b_rep").alias("id_b"), "score")
    return links.unionByName(_tied(members))


def _along_chains(waits: DataFrame) -> DataFrame:
    """(id, end, odd) for rows (id, on, n) where ``id`` waits for the ``n`` smaller open ids next to it, ``on`` the smallest.

    An id that waits for a single one is a seed exactly if that one is none, so along a
    chain of such ids only the parity of the distance to its end counts. Doubling the
    distance each round reaches the ends in logarithmic rounds.
    """
    start = waits.select("id", F.when(F.col("n") == 1, F.col("on")).otherwise(F.col("id")).alias("end"), (F.col("n") == 1).alias("odd"))

    def step(state: DataFrame) -> DataFrame:
        far = state.select(F.col("id").alias("end"), F.col("end").alias("further"), F.col("odd").alias("more"))
        return state.join(far, "end").select("id", F.col("further").alias("end"), (F.col("odd") != F.col("more")).alias("odd"),
                                             (F.col("further") != F.col("end")).alias("changed"))

    return iterate(start, step, "changed")


def _seed_groups(pairs: DataFrame) -> DataFrame:
    """Greedy grouping around seeds in id order; members match their seed directly.

    An id is a seed exactly if no smaller id next to it is one, and others join the smallest seed
    next to them. Each round first settles all ids next to a smaller seed, then
    every chain of ids that wait for a single smaller one, from an id that waits
    for none on. The smallest open id settles in every round; further rounds
    are needed only behind ids that wait for two or more.
    """
    links = cut(both_ways(pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")).where("src <> dst")).distinct())
    smaller = cut(links.where("dst < src"))
    state = cut(links.select(F.col("src").alias("id")).distinct().withColumn("seed", F.lit(None).cast("boolean")))
    while not (unsettled := state.where("seed IS NULL").select("id")).isEmpty():
        near = (smaller.join(unsettled.withColumnRenamed("id", "src"), "src", "left_semi")
                .join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"))
                .agg(F.max(F.coalesce("seed", F.lit(False))).alias("joins"), F.count_if(F.col("seed").isNull()).alias("n"),
                     F.min(F.when(F.col("seed").isNull(), F.col("dst"))).alias("on")))
        near = cut(unsettled.join(near, "id", "left").select(
            "id", F.coalesce("joins", F.lit(False)).alias("joins"), F.coalesce("n", F.lit(0)).alias("n"), "on"))
        # Ids that join are none, so those that wait for one of them alone go on from there as from an even end.
        waits = near.select("id", F.when(F.col("joins"), 0).otherwise(F.col("n")).alias("n"), "on")
        known = near.where("joins OR n = 0").select(F.col("id").alias("end"), (~F.col("joins")).alias("of_end"))
        fresh = _along_chains(waits).join(known, "end").select("id", (F.col("of_end") != F.col("odd")).alias("fresh"))
        state = cut(state.join(fresh, "id", "left").select("id", F.coalesce("seed", "fresh").alias("seed")))
    joined = (smaller.join(state.where("seed").select(F.col("id").alias("dst")), "dst")
              .groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("first")))
    return state.join(joined, "id", "left").select("id", F.when(F.col("seed"), F.col("id")).otherwise(F.col("first")).alias("component"))


def id_mapping(identities: DataFrame, pairs: DataFrame, mode: str = "components") -> DataFrame:
    """customer_id to canonical id: the smallest of its group."""
    edges = pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    groups = connected_components(edges) if mode == "components" else _seed_groups(pairs)
    return (identities.select("customer_id").distinct()
            .join(groups.withColumnRenamed("id", "customer_id"), "customer_id", "left")
            .select("customer_id", F.coalesce("component", "customer_id").alias("canonical_customer_id")))


def resolve(identities: DataFrame, fuzzy: str = "matcher", null_policy: str = "skip",
            mode: str = "components") -> DataFrame:
    """customer_id to canonical id. Components need links only; a seed takes every id that matches it directly."""
    pairs = matched_links if mode == "components" else matched_pairs
    return id_mapping(identities, pairs(identities, fuzzy, null_policy), mode)


def canonical_lookup(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """Canonical id of each requested id; an unknown id stands for itself."""
    return requests.join(mapping, "customer_id", "left").select(
        *requests.columns, F.coalesce("canonical_customer_id", "customer_id").alias("canonical_customer_id"))


def related_ids(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """All ids sharing the canonical id of each requested id."""
    asked = requests.select("customer_id").distinct().join(mapping, "customer_id")
    group = mapping.select(F.col("customer_id").alias("related_customer_id"), "canonical_customer_id")
    return asked.join(group, "canonical_customer_id").select("customer_id", "related_customer_id")


def only_customers(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Membership filter as a semi join."""
    return df.join(ids.select("customer_id").distinct(), "customer_id", "left_semi")


def with_canonical(df: DataFrame, mapping: DataFrame) -> DataFrame:
    return canonical_lookup(df, mapping)


def best_identity(identities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per canonical id the row with e-mail, then phone, then the newest update."""
    newest = F.coalesce(-micros("updated_at"), F.lit(2**62))
    order = F.struct(F.col("email").isNull(), F.col("phone").isNull(), newest, "customer_id", "source_system")
    fields = ["document_number", "full_name", "birth_date", "email", "phone", "created_at", "updated_at"]
    rows = with_canonical(identities, mapping)
    best = rows.groupBy("canonical_customer_id").agg(F.min_by(F.struct(*fields), order).alias("r"))
    return best.select("canonical_customer_id", "r.*")


def primary_product(products: DataFrame, mapping: DataFrame) -> DataFrame:
    """Active product with the latest activity, then the highest balance."""
    order = F.struct(F.coalesce(-micros("last_activity"), F.lit(2**62)),
                     -F.coalesce(F.col("balance").cast("double"), F.lit(0.0)), "account_id")
    return (with_canonical(products.where("status = 'active'"), mapping).groupBy("canonical_customer_id")
            .agg(F.min_by("product_type", order).alias("primary_product")))


def product_rollup(products: DataFrame, mapping: DataFrame, as_of) -> DataFrame:
    """Totals, active product types with counts, relationship length, last activity."""
    rows = with_canonical(products, mapping)
    by_type = rows.groupBy("canonical_customer_id", "product_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("active"),
        F.min("opened_date").alias("first"), F.max("last_activity").alias("last"))
    active = F.when(F.col("active") > 0, F.struct("product_type", "active"))
    return by_type.groupBy("canonical_customer_id").agg(
        F.sum("n").cast("bigint").alias("total_products"),
        F.map_from_entries(F.array_sort(F.collect_list(active))).alias("active_product_counts"),
        F.min("first").alias("customer_since"), F.max("last").alias("last_activity"),
    ).withColumn("relationship_length_days", whole_days(as_time(as_of), F.col("customer_since"))) \
     .withColumn("active_products", F.map_keys("active_product_counts"))


def days_since_opening(products: DataFrame, as_of) -> DataFrame:
    return products.withColumn("days_since_opening", whole_days(as_time(as_of), F.col("opened_date")))


def risk_indicators(indicators: DataFrame, mapping: DataFrame) -> DataFrame:
    kind, value = F.col("indicator_type"), F.col("indicator_value")
    return with_canonical(indicators, mapping).groupBy("canonical_customer_id").agg(
        F.coalesce(F.max(kind == "pep"), F.lit(False)).alias("is_pep"),
        F.coalesce(F.max(kind == "fraud_history"), F.lit(False)).alias("has_fraud_history"),
        F.floor(F.avg(F.when(kind == "credit_score_internal", value))).cast("bigint").alias("credit_score_internal"),
        F.floor(F.avg(F.when(kind == "credit_score_external", value))).cast("bigint").alias("credit_score_external"))


def unified_profiles(identities: DataFrame, mapping: DataFrame, products: DataFrame,
                     indicators: DataFrame, as_of) -> DataFrame:
    """One row per canonical customer."""
    base = best_identity(identities, mapping)
    key = "canonical_customer_id"
    return (base.join(product_rollup(products, mapping, as_of), key, "left")
            .join(primary_product(products, mapping), key, "left")
            .join(risk_indicators(indicators, mapping), key, "left")
            .withColumn("age", age_years(F.col("birth_date"), as_of))
            .fillna(0, ["total_products"]).fillna(False, ["is_pep", "has_fraud_history"]))


def refresh_profiles(stored: DataFrame, changed: DataFrame, identities: DataFrame, mapping: DataFrame,
                     products: DataFrame, indicators: DataFrame, as_of) -> DataFrame:
    """Stored profiles with those of the changed ids rebuilt; the others pass through."""
    key = "canonical_customer_id"
    touched = canonical_lookup(changed.select("customer_id"), mapping).select(key).distinct()
    affected = mapping.join(touched, key, "left_semi")
    fresh = unified_profiles(only_customers(identities, affected), affected,
                             only_customers(products, affected), only_customers(indicators, affected), as_of)
    return stored.join(touched, key, "left_anti").unionByName(fresh)
