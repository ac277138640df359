"""Which records may be analysed, and which taxa have enough of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatrend.functions.geo import tenth_degree
from taxatrend.functions.timefn import local_day
from taxatrend.params import Params

FREE_TEXT = ["occurrence_remarks", "event_remarks"]


def derived_columns(occ: DataFrame) -> DataFrame:
    """Columns computed when a record is stored: grid cell, local calendar day and its year, by which tables are partitioned (0 without a day)."""
    cells = occ.withColumns(
        {
            "cell_lat": tenth_degree(F.col("decimal_latitude")),
            "cell_lon": tenth_degree(F.col("decimal_longitude")),
            "event_day": local_day(F.col("event_date")),
        }
    )
    return cells.withColumn("event_year", F.coalesce(F.year("event_day"), F.lit(0)))


def has_point() -> Column:
    return F.col("decimal_latitude").isNotNull() & F.col("decimal_longitude").isNotNull()


def public_view(occ: DataFrame) -> DataFrame:
    """Everything but contributors' free text: the only form open to ad-hoc readers."""
    return occ.drop(*FREE_TEXT)


def managed_flag(occ: DataFrame, rules: DataFrame) -> DataFrame:
    """Recompute ``managed_by_rule``: some rule names the taxon and state, and its region and dataset
    where it sets them. A record matching several rules stays one record."""
    # A wildcard is a null in the rule, so each rule shape is an equi-join on the columns it sets and
    # the hit is found by key, without a residual test against every rule of a taxon.
    shapes = []
    keys = ["taxon_concept_id", "state_province"]
    for extra in ([], ["ibra_region"], ["data_resource_uid"], ["ibra_region", "data_resource_uid"]):
        free = [c for c in ("ibra_region", "data_resource_uid") if c not in extra]
        cond = F.lit(True)
        for c in extra:
            cond = cond & F.col(c).isNotNull()
        for c in free:
            cond = cond & F.col(c).isNull()
        shapes.append((keys + extra, rules.filter(cond).select(*(keys + extra)).distinct()))
    out = occ.drop("managed_by_rule")
    for i, (on, rule_keys) in enumerate(shapes):
        out = out.join(rule_keys.withColumn(f"_m{i}", F.lit(True)), on, "left")
    hit = F.coalesce(*[F.col(f"_m{i}") for i in range(len(shapes))], F.lit(False))
    out = out.withColumn("managed_by_rule", hit).drop(*[f"_m{i}" for i in range(len(shapes))])
    return out.select(*occ.columns, *([] if "managed_by_rule" in occ.columns else ["managed_by_rule"]))


def managed_changes(occ: DataFrame, rules: DataFrame) -> DataFrame:
    """Records whose stored flag differs from what the rules say now, with the new flag.

    Only taxa that have a rule, or records flagged at present, are looked at.
    """
    ruled = rules.select("taxon_concept_id").distinct().withColumn("_ruled", F.lit(True))
    target = occ.join(ruled, "taxon_concept_id", "left").filter(F.col("_ruled") | F.col("managed_by_rule")).drop("_ruled")
    old = target.withColumn("was_managed", F.col("managed_by_rule"))
    return managed_flag(old, rules).filter(F.col("managed_by_rule") != F.col("was_managed"))


def dataset_kind(occ: DataFrame, datasets: DataFrame) -> DataFrame:
    """Left join of the curated dataset kind; records of no known dataset count as wild."""
    kinds = datasets.select("data_resource_uid", "kind")
    return occ.join(kinds, "data_resource_uid", "left").withColumn(
        "dataset_kind", F.coalesce("kind", F.lit("wild"))
    ).drop("kind")


def analysable(occ: DataFrame, datasets: DataFrame) -> DataFrame:
    """Valid, dated, not telemetry; ``population`` tells managed from wild."""
    kept = occ.filter(F.col("is_valid") & F.col("event_date").isNotNull())
    return (
        dataset_kind(kept, datasets)
        .filter(F.col("dataset_kind") != "telemetry")
        .withColumn(
            "population",
            F.when((F.col("dataset_kind") == "managed") | F.col("managed_by_rule"), "managed").otherwise("wild"),
        )
    )


def taxon_tiers(records: DataFrame, taxa: DataFrame, p: Params) -> DataFrame:
    """Per taxon: records since the tier date, last day, and whether the statistics apply."""
    since = F.col("event_day") >= F.lit(p.tier_since).cast("date")
    counts = records.groupBy("taxon_concept_id").agg(
        F.count_if(since).alias("n"), F.max("event_day").alias("last_record_day")
    )
    n = F.coalesce("n", F.lit(0))
    return taxa.join(counts, "taxon_concept_id", "left").select(
        "taxon_concept_id", "scientific_name", "vernacular_name", "national_status",
        n.alias("records_since_2015"), "last_record_day", (n >= p.tier_min_records).alias("statistical_tier"),
    )


def statistical_taxa(tiers: DataFrame) -> DataFrame:
    return tiers.filter("statistical_tier").select("taxon_concept_id")


def not_telemetry(occ: DataFrame, datasets: DataFrame) -> DataFrame:
    """Drop records of telemetry datasets; records of no dataset stay."""
    telemetry = datasets.filter(F.col("kind") == "telemetry").select("data_resource_uid")
    return occ.join(telemetry, "data_resource_uid", "left_anti")
