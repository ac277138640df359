"""Loading into the stored tables: upserts as joins, and writes that touch only the partitions concerned."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxatrend.operators.curation import managed_changes, managed_flag
from taxatrend.workspace import drop, write


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, first in ``order``. Tasks drop their own losers before the shuffle."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") == 1).drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """``new`` replaces ``old`` by key, all columns but ``keep``, whose stored values survive.

    ``new`` must hold one row per key. One full outer join, so each side is shuffled once.
    """
    keep = keep or []
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full_outer")
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in keep:
            fresh = F.col(f"n.{c}") if c in new.columns else F.lit(None)
            cols.append(F.coalesce(F.col(f"o.{c}"), fresh).alias(c))
        else:
            cols.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*cols)


def merge_into(spark: SparkSession, path: str, new: DataFrame, keys: list[str], part: str, scratch: str, keep: list[str] | None = None) -> int:
    """Upsert into a table partitioned by ``part``, rewriting only partitions that hold or receive a changed key.

    A key may move to another partition. The affected partition values, few by nature, come to the driver; the
    rows do not. Merged rows are written aside first, because a table cannot be overwritten while it is read.
    Repeating the call after a failure gives the same table. Returns the number of partitions rewritten.
    """
    old = spark.read.parquet(path)
    moved_from = old.select(*keys, part).join(new.select(*keys), keys, "left_semi").select(part)
    values = [r[0] for r in moved_from.unionByName(new.select(part)).distinct().collect()]
    if not values:
        return 0
    touched = old.filter(F.col(part).isin(values))
    aside = f"{scratch}/merge-{uuid.uuid4().hex}"
    write(upsert(touched, new, keys, keep), aside, partition_by=part)
    merged = spark.read.schema(old.schema).parquet(aside)
    merged.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    # A partition that lost its last row has no merged rows to overwrite it with.
    left = {r[0] for r in merged.select(part).distinct().collect()}
    for v in [v for v in values if v not in left]:
        drop(spark, f"{path}/{part}={v}")
    drop(spark, aside)
    return len(values)


def upsert_datasets(old: DataFrame, records: DataFrame, seq: list[str]) -> DataFrame:
    """New datasets arrive as wild; a curated kind and a known name are never overwritten."""
    met = records.filter(F.coalesce("data_resource_uid", F.lit("")) != "").groupBy("data_resource_uid").agg(
        F.min_by(F.struct("data_resource_name"), F.struct(*seq))["data_resource_name"].alias("new_name")
    )
    return old.join(met, "data_resource_uid", "full_outer").select(
        "data_resource_uid", F.coalesce("name", "new_name").alias("name"), F.coalesce("kind", F.lit("wild")).alias("kind")
    )


TAXON_COLUMNS = [
    "scientific_name", "vernacular_name", "taxon_rank", "kingdom", "phylum", "taxon_class", "taxon_order", "family", "genus", "national_status",
]


def upsert_taxa(old: DataFrame, records: DataFrame, seq: list[str], seen_at: Column) -> DataFrame:
    """The first record of a taxon in the run supplies its values; an older run never replaces a newer one."""
    cols = [c for c in TAXON_COLUMNS if c in old.columns]
    met = (
        records.filter(F.coalesce("taxon_concept_id", F.lit("")) != "").groupBy("taxon_concept_id")
        .agg(F.min_by(F.struct(*cols), F.struct(*seq)).alias("v")).withColumn("seen", seen_at)
    )
    joined = old.join(met, "taxon_concept_id", "full_outer")
    fresh = F.col("v").isNotNull() & (F.col("status_seen_at").isNull() | (F.col("seen") >= F.col("status_seen_at")))
    return joined.select(
        "taxon_concept_id", *[F.when(fresh, F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        F.when(fresh, F.col("seen")).otherwise(F.col("status_seen_at")).alias("status_seen_at"),
    )


def upsert_runs(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """A run already loaded keeps its description; only the load time moves."""
    incoming = new.select("harvest_id").withColumn("_again", F.lit(True))
    kept = old.join(incoming, "harvest_id", "left").withColumn("loaded_at", F.when(F.col("_again"), now).otherwise(F.col("loaded_at"))).drop("_again")
    added = new.join(old.select("harvest_id"), "harvest_id", "left_anti").withColumn("loaded_at", now)
    return kept.unionByName(added.select(*kept.columns))


def attach_analysis(runs: DataFrame, analysis: DataFrame) -> DataFrame:
    """Set the analysis of runs: ``analysis`` holds harvest_id and its JSON."""
    one = analysis.select("harvest_id", F.col("analysis").alias("_a"))
    return runs.join(one, "harvest_id", "left").withColumn("analysis", F.coalesce("_a", "analysis")).drop("_a")


def set_dataset_kinds(datasets: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated kinds: insert the dataset, or set its kind and reason. ``curated``: uid, name, kind, kind_reason."""
    c = curated.select("data_resource_uid", F.col("name").alias("c_name"), F.col("kind").alias("c_kind"), F.col("kind_reason").alias("c_reason"))
    reason = F.col("kind_reason") if "kind_reason" in datasets.columns else F.lit(None).cast("string")
    return datasets.withColumn("kind_reason", reason).join(c, "data_resource_uid", "full_outer").select(
        "data_resource_uid", F.coalesce("name", "c_name").alias("name"), F.coalesce("c_kind", "kind").alias("kind"),
        F.when(F.col("c_kind").isNotNull(), F.col("c_reason")).otherwise(F.col("kind_reason")).alias("kind_reason"),
    )


def resolve_rules(curated: DataFrame, taxa: DataFrame) -> DataFrame:
    """Curated rules name taxa; names the corpus does not hold are dropped."""
    return curated.join(taxa.select("taxon_concept_id", "scientific_name"), "scientific_name").drop("scientific_name")


def add_rules(rules: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add rules not there yet; null wildcards compare equal."""
    keys = ["taxon_concept_id", "state_province", "ibra_region", "data_resource_uid"]
    r, n = rules.alias("r"), resolved.alias("n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}"))
    return rules.select(*keys, "note").unionByName(n.join(r, same, "left_anti").select(*keys, "note"))


def append_comparison(row: DataFrame, path: str) -> None:
    """Add a comparison to the log: ``row`` holds ai_run_id and calculated_run_id. A comparison made again replaces the one before."""
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ai_run_id", "calculated_run_id").parquet(path)


def append_insights(packed: DataFrame, path: str) -> None:
    """Add a run's insights. The partitions of its run and types are replaced, so a write that is repeated doubles nothing."""
    packed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "insight_type").parquet(path)


def write_managed_flags(spark: SparkSession, path: str, rules: DataFrame, scratch: str, part: str = "event_year") -> int:
    """Bring ``managed_by_rule`` of a stored table in line with the rules; returns how many records changed.

    Only partitions with a changed record are rewritten, each row in its place: a flag depends on its row and the rules
    alone. A second call changes nothing. The partitions concerned, few by nature, come to the driver.
    """
    stored = spark.read.parquet(path)
    changed = managed_changes(stored, rules).groupBy(part).agg(F.count("*").alias("n")).collect()
    if not changed:
        return 0
    aside = f"{scratch}/flags-{uuid.uuid4().hex}"
    write(managed_flag(stored.filter(F.col(part).isin([r[part] for r in changed])), rules), aside, partition_by=part)
    fresh = spark.read.schema(stored.schema).parquet(aside)
    fresh.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    drop(spark, aside)
    return sum(r["n"] for r in changed)


RUN_LOG = "run_id string, arm string, brief string, params string, corpus string, model string, prompt_version string, temperature double, usage string, status string, error string, started_at timestamp, finished_at timestamp, at timestamp"


def open_run(spark: SparkSession, run_id: str, arm: str, params: str, corpus: str, now: str, brief: str | None = None, model: str | None = None, prompt_version: str | None = None) -> DataFrame:
    """The log row of a run that starts. An AI run, and only one, has a brief."""
    if (arm == "ai") != (brief is not None):
        raise ValueError("a brief belongs to runs of the ai arm, and to those only")
    row = (run_id, arm, brief, params, corpus, model, prompt_version, None, None, "running", None, now, None, now)
    typed = ", ".join(c.replace("timestamp", "string") for c in RUN_LOG.split(", "))
    df = spark.createDataFrame([row], typed)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at", "at")})


def close_run(log: DataFrame, run_id: str, status: str, now: str, error: str | None = None, usage: str | None = None) -> DataFrame:
    """The log row of a run that ended, to be appended after its opening row."""
    at = F.lit(now).cast("timestamp")
    return current_runs(log).filter(F.col("run_id") == run_id).withColumns(
        {"status": F.lit(status), "error": F.lit(error).cast("string"), "usage": F.lit(usage).cast("string"), "finished_at": at, "at": at}
    )


def current_runs(log: DataFrame) -> DataFrame:
    """Latest log row of every run."""
    return latest(log, ["run_id"], [F.desc("at"), F.desc_nulls_last("finished_at")])
