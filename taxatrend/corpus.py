"""The benchmark tables re-read as a biodiversity corpus (see FIXTURES.md part B).

Only column arithmetic on the given tables: a line item becomes an occurrence, its part a taxon, its
supplier a dataset, and the customer's nation and region the place.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxatrend.operators.curation import analysable, derived_columns, taxon_tiers
from taxatrend.operators.effort import build_effort
from taxatrend.operators.reporting_rate import reporting_rate, visits
from taxatrend.params import Params, Window
from taxatrend.plans.calculated import calculated_run
from taxatrend.workspace import Workspace

CLASSES = ["Aves", "Mammalia", "Reptilia", "Amphibia", "Insecta", "Magnoliopsida"]
STATUSES = ["Vulnerable", "Endangered", "Critically Endangered"]
TAXA = 120
HARVEST = "benchmark/run-1"
RUN_ID = "calc-1"

PARAMS = Params(
    report_month="2001-06",
    tier_since="1995-01-01",
    baseline=Window("1995-01-01", "1997-12-31"),
    baseline_window=Window("1995-01-01", "1997-12-31"),
    recent_window=Window("1999-01-01", "2001-12-31"),
)
#: Lower minima, for tables too small to reach the published ones.
SMALL = replace(PARAMS, min_detections=10, rate_min_records=10, min_taxa=2, alpha=0.3)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    num = k.cast("string")
    return (
        read(spark, sf_dir, "part").select((F.col("p_partkey") % TAXA).alias("k")).distinct().select(
            F.concat(F.lit("T"), num).alias("taxon_concept_id"),
            F.concat(F.lit("Genus species"), num).alias("scientific_name"),
            F.when(k % 4 != 0, F.concat(F.lit("Common name-"), num)).alias("vernacular_name"),
            F.lit("species").alias("taxon_rank"),
            F.when(k % 6 == 5, "Plantae").otherwise("Animalia").alias("kingdom"),
            pick(k % 6, CLASSES).alias("taxon_class"),
            F.when(k % 10 != 9, pick(k % 3, STATUSES)).alias("national_status"),
            F.lit("2001-07-01 00:00:00").cast("timestamp").alias("status_seen_at"),
        )
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    return (
        read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("i")).distinct().select(
            F.concat(F.lit("d"), i.cast("string")).alias("data_resource_uid"),
            F.concat(F.lit("Dataset "), i.cast("string")).alias("name"),
            F.when(i == 0, "telemetry").when(i == 1, "managed").otherwise("wild").alias("kind"),
        )
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managed-population rules of all four wildcard shapes, one per nation and shape."""
    n = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    shape = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("shape")
    k = (F.col("n_nationkey") * 3 + F.col("shape") * 40) % TAXA
    return n.select("n_nationkey", "n_name", "r_name", shape).select(
        (F.col("n_nationkey") * 4 + F.col("shape")).alias("rule_id"),
        F.concat(F.lit("T"), k.cast("string")).alias("taxon_concept_id"),
        F.col("n_name").alias("state_province"),
        F.when(F.col("shape") % 2 == 1, F.col("r_name")).alias("ibra_region"),
        F.when(F.col("shape") >= 2, F.concat(F.lit("d"), (F.col("n_nationkey") % 10).cast("string"))).alias("data_resource_uid"),
        F.lit("derived rule").alias("note"),
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their place."""
    place = (
        read(spark, sf_dir, "customer")
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "n_nationkey", "n_name", "r_regionkey", "r_name")
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        place, F.col("o_custkey") == F.col("c_custkey")
    )
    return read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "k", F.col("l_partkey") % TAXA
    )


def shaped(b: DataFrame) -> DataFrame:
    """Name some records for another taxon of the same ten, so that taxa fall silent, decline, shrink or grow; no row is dropped."""
    k, d, ok = F.col("k") % 10, F.col("l_shipdate"), F.col("l_orderkey")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    moved = (
        ((k == 0) & (d >= day("1998-06-01")))
        | ((k == 1) & (ok % 200 != 0))
        | ((k == 2) & (F.col("r_regionkey") == 1) & (d >= day("1998-06-01")))
        | ((k == 3) & (d >= day("1999-01-01")) & (ok % 10 < 6))
        | ((k == 4) & (d < day("1998-01-01")) & (ok % 10 < 6))
        | (k.isin(5, 6) & (F.col("r_regionkey") == 3) & (d >= day("1999-01-01")) & (ok % 10 < 7))
    )
    return b.withColumn("k", F.when(moved, F.col("k") - k + 8).otherwise(F.col("k")))


def as_occurrences(b: DataFrame) -> DataFrame:
    ok, pk, sk, n, rk = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "n_nationkey", "r_regionkey"))
    source_id = F.concat(ok.cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    k = F.col("k")
    occ = b.select(
        F.concat(F.lit("t:"), source_id).alias("record_id"),
        F.lit("t").alias("source"),
        source_id.alias("source_record_id"),
        F.lit(HARVEST).alias("harvest_id"),
        F.concat(F.lit("d"), (sk % 10).cast("string")).alias("data_resource_uid"),
        F.concat(F.lit("T"), k.cast("string")).alias("taxon_concept_id"),
        F.concat(F.lit("Genus species"), k.cast("string")).alias("scientific_name"),
        F.col("l_shipdate").cast("timestamp").alias("event_date"),
        (F.lit(-1200) - n * 110 - (ok * 7 + pk * 13) % 100).cast("double").alias("_lat100"),
        (F.lit(11500) + rk * 600 + (sk * 17 + ok * 3) % 500).cast("double").alias("_lon100"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 100).alias("coordinate_uncertainty_m"),
        F.col("n_name").alias("state_province"),
        F.col("r_name").alias("ibra_region"),
        F.when(F.col("l_linenumber") % 3 == 0, "0").when(F.col("l_linenumber") % 3 == 1, "Looks strong and healthy").alias(
            "occurrence_remarks"
        ),
        ((F.col("l_linenumber") != 6) | (F.col("l_quantity") < 45)).alias("is_valid"),
        F.lit(False).alias("managed_by_rule"),
    ).withColumns({"decimal_latitude": F.col("_lat100") / 100, "decimal_longitude": F.col("_lon100") / 100})
    return derived_columns(occ.drop("_lat100", "_lon100"))


class Corpus:
    """The corpus of one table directory: dimensions as they are, facts written once per workspace."""

    def __init__(self, ws: Workspace, sf_dir: str, params: Params = PARAMS):
        self.ws, self.spark, self.sf_dir, self.p = ws, ws.spark, sf_dir, params

    @property
    def taxa(self) -> DataFrame:
        return self.ws.table("taxa", lambda: taxa(self.spark, self.sf_dir))

    @property
    def datasets(self) -> DataFrame:
        return self.ws.table("datasets", lambda: datasets(self.spark, self.sf_dir))

    @property
    def rules(self) -> DataFrame:
        return self.ws.table("rules", lambda: rules(self.spark, self.sf_dir))

    @property
    def occurrences(self) -> DataFrame:
        return self.ws.table(
            "occurrences", lambda: as_occurrences(shaped(base(self.spark, self.sf_dir))), partition_by="event_year"
        )

    @property
    def effort(self) -> DataFrame:
        """Effort counts the records under the names they were made with: all recording, whatever the listed taxa did."""
        return self.ws.table(
            "effort",
            lambda: build_effort(as_occurrences(base(self.spark, self.sf_dir)), self.taxa, self.datasets, HARVEST),
            partition_by="taxon_group",
        )

    @property
    def records(self) -> DataFrame:
        return analysable(self.occurrences, self.datasets)

    @property
    def tiers(self) -> DataFrame:
        return self.ws.table("tiers", lambda: taxon_tiers(self.records, self.taxa, self.p))

    @property
    def visits(self) -> DataFrame:
        return self.ws.table("visits", lambda: visits(self.records, self.tiers, self.p))

    @property
    def regional_rates(self) -> DataFrame:
        return self.ws.table("regional_rates", lambda: reporting_rate(self.visits, self.taxa, self.effort, self.p, True))

    @property
    def insights(self) -> DataFrame:
        """The packed insights of one calculated run."""
        return self.ws.table(
            "insights",
            lambda: calculated_run(
                self.occurrences, self.records, self.datasets, self.taxa, self.tiers, self.effort, self.visits,
                self.regional_rates, self.p, RUN_ID,
            ),
            partition_by="insight_type",
        )
