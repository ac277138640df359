"""Recording effort per group, cell and month: the denominator of reporting rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatrend.functions.groups import effort_group
from taxatrend.operators.curation import has_point, not_telemetry


def build_effort(occ: DataFrame, taxa: DataFrame, datasets: DataFrame, harvest_id: str) -> DataFrame:
    """Count all records of all taxa, telemetry excluded. A record counts under 'all' and under its own group."""
    own = taxa.select("taxon_concept_id", effort_group(F.col("kingdom"), F.col("taxon_class")).alias("own_group"))
    counted = (
        not_telemetry(occ.filter(has_point()), datasets)
        # Counting per taxon first leaves a few rows per cell and month to be doubled by the explode.
        .groupBy("taxon_concept_id", "cell_lat", "cell_lon", F.trunc("event_day", "month").alias("period_start"))
        .agg(F.count("*").alias("n"))
        .join(own, "taxon_concept_id", "left")
    )
    grouped = counted.withColumn(
        "taxon_group", F.explode(F.array_distinct(F.array(F.lit("all"), F.coalesce("own_group", F.lit("all")))))
    )
    return (
        grouped.groupBy("taxon_group", "cell_lat", "cell_lon", "period_start")
        .agg(F.sum("n").cast("int").alias("records"))
        .select(
            "taxon_group", "cell_lat", "cell_lon", "period_start", F.last_day("period_start").alias("period_end"),
            "records", F.lit(harvest_id).alias("harvest_id"),
        )
    )


def facet_cells(pages: DataFrame, group: str, harvest_id: str) -> DataFrame:
    """Facet rows (month, label, count) -> effort cells. Labels that are no cell are dropped; a signed zero
    and zero are one cell."""
    parts = F.split("label", ",")
    lat, lon = (F.trim(F.get(parts, i)).try_cast("decimal(18,10)") for i in (0, 1))
    return (
        pages.withColumns({"cell_lat": F.round(lat, 1).cast("decimal(4,1)"), "cell_lon": F.round(lon, 1).cast("decimal(4,1)")})
        .filter(F.col("cell_lat").isNotNull() & F.col("cell_lon").isNotNull())
        .groupBy("cell_lat", "cell_lon", F.to_date(F.concat("month", F.lit("-01"))).alias("period_start"))
        .agg(F.sum("count").cast("int").alias("records"))
        .select(
            F.lit(group).alias("taxon_group"), "cell_lat", "cell_lon", "period_start",
            F.last_day("period_start").alias("period_end"), "records", F.lit(harvest_id).alias("harvest_id"),
        )
    )


def facet_gaps(totals: DataFrame, cells: DataFrame) -> DataFrame:
    """Months whose stated total differs from what fell in cells, with the warning to log.

    ``totals``: month, total_records, one row per month page.
    """
    inside = cells.groupBy(F.date_format("period_start", "yyyy-MM").alias("month")).agg(F.sum("records").alias("in_cells"))
    t = totals.groupBy("month").agg(F.sum("total_records").alias("total_records"))
    out = t.join(inside, "month", "left").withColumn("in_cells", F.coalesce("in_cells", F.lit(0)))
    missing = F.col("total_records") - F.col("in_cells")
    return out.filter(missing != 0).select(
        "month", "total_records", "in_cells",
        F.format_string("%s: %d of its %d records lack a cell", "month", missing, F.col("total_records")).alias("warning"),
    )
