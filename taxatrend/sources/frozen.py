"""Scans of frozen deliveries: search pages, bulk CSV, facet pages and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxatrend.sources.split_csv import csv_records

RAW = "map<string,variant>"
MANIFEST = """runId string, harvestKey string, source string, query struct<q: string, fq: array<string>>,
  startedAt string, finishedAt string, expectedRecords bigint, retrievedRecords bigint, complete boolean,
  slices array<struct<sliceKey: string, expectedRecords: bigint, retrievedRecords: bigint, pages: bigint>>,
  pages array<struct<file: string, sliceKey: string, recordCount: bigint, fetchedAt: string, contentHash: string, bytes: bigint>>,
  corpusHash string, requestCount bigint, warnings array<string>"""


def page_rows(pages: DataFrame) -> DataFrame:
    """Page bodies (``page``, ``value``) -> one row per record with its position; a body that is no JSON fails."""
    body = F.from_json("value", f"occurrences array<{RAW}>", {"mode": "FAILFAST"})
    records = F.coalesce(body["occurrences"], F.array().cast(f"array<{RAW}>"))
    return pages.select(*[c for c in pages.columns if c != "value"], F.posexplode(records).alias("pos", "raw"))


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Search pages under a directory, or several, one file each, named by the last path components."""
    pages = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.regexp_extract("_metadata.file_path", r"pages/(.*)$", 1)
    return page_rows(pages.select(run_of_path(), F.regexp_replace(name, "/[^/]*$", "").alias("page"), "value"))


def run_of_path() -> Column:
    """The run folder a file lies in; page names recur in every run."""
    return F.regexp_extract("_metadata.file_path", r"run=([^/]+)/", 1).alias("run")


def with_context(rows: DataFrame, manifest_pages: DataFrame) -> DataFrame:
    """Add what its run's manifest says of each page: when it was fetched, and the harvest it belongs to.

    Rows of runs without a manifest are left out: such a run is still being written.
    """
    at = manifest_pages.select("run", F.col("file").alias("page"), F.to_timestamp("fetchedAt").alias("fetched_at"))
    runs = manifest_pages.select("run", F.concat("harvestKey", F.lit("/"), "runId").alias("harvest_id")).distinct()
    return rows.join(runs, "run").join(at, ["run", "page"], "left").drop("run")


def parsed_manifests(text: DataFrame) -> DataFrame:
    """``text`` (run, value): manifest bodies, as columns."""
    return text.select("run", F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("run", "m.*")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished run. A run without a manifest is still being written and is not seen."""
    text = spark.read.text(f"{root}/run=*/manifest.json", wholetext=True)
    return parsed_manifests(text.select(run_of_path(), "value"))


def manifest_stream(spark: SparkSession, root: str, runs_per_batch: int) -> DataFrame:
    """(run, value): manifests as they appear; each is read once, however often the stream is restarted."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", runs_per_batch).schema("value string")
    return stream.load(f"{root}/run=*/manifest.json").select(run_of_path(), "value")


def newest_first(manifests: DataFrame) -> DataFrame:
    return manifests.select("runId").orderBy(F.desc("runId"))


def newest_run(manifests: DataFrame) -> DataFrame:
    return manifests.orderBy(F.desc("runId")).limit(1)


def manifest_pages(manifests: DataFrame) -> DataFrame:
    return manifests.select("run", "runId", "harvestKey", F.explode("pages").alias("p")).select("run", "runId", "harvestKey", "p.*")


def missing_pages(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Pages a manifest lists that its run did not deliver. ``found`` holds ``run`` and ``page``; page names recur in every run."""
    return listed.join(found.select("run", F.col("page").alias("file")).distinct(), ["run", "file"], "left_anti")


# --- bulk CSV ---


def read_headings(spark: SparkSession, path: str) -> list[dict]:
    """The column list of a bulk file: label, requested field, and whether the column is a quality flag."""
    rows = spark.read.csv(path, header=True, escape='"').collect()  # one row per column of the delivery
    out = []
    for r in rows:
        label = r["Column name"] or ""
        name = r["Requested field"] or label
        flag = not r["Field name"] and bool(name) and all(ch.isdigit() or ch == "_" or "A" <= ch <= "Z" for ch in name)
        out.append({"label": label, "field": name, "flag": flag})
    return out


def read_bulk(spark: SparkSession, path: str, headings: list[dict]) -> DataFrame:
    """Rows of all ``data*.csv`` files, read in byte ranges and matched to headings by position because labels repeat.

    Keeps header rows, marked ``is_header``; see ``check_headers`` and ``bulk_rows``.
    """
    cols = [f"c{i}" for i in range(len(headings))]
    schema = ", ".join(f"{c} string" for c in [*cols, "beyond"])
    cells = F.from_csv("record", schema, {"quote": '"', "escape": '"', "nullValue": "", "maxCharsPerColumn": "-1"})
    df = csv_records(spark, f"{path}/data*.csv").select("file", "pos", cells.alias("cells")).select("file", "pos", "cells.*")
    same = F.lit(True)
    for c, h in zip(cols, headings):
        same = same & F.coalesce(F.col(c), F.lit("")).eqNullSafe(F.lit(h["label"]))
    return df.withColumn("is_header", same & F.col("beyond").isNull())


def check_headers(bulk: DataFrame) -> DataFrame:
    """Files whose header does not line up with the headings, or that hold rows wider than them: must be empty."""
    return bulk.groupBy("file").agg(
        F.count_if("is_header").alias("headers"), F.count_if(F.col("beyond").isNotNull()).alias("too_wide")
    ).filter((F.col("headers") != 1) | (F.col("too_wide") > 0))


def require_alignment(bulk: DataFrame) -> DataFrame:
    """``bulk`` itself; a file whose header or width is not that of the headings ends the load."""
    bad = check_headers(bulk).limit(5).collect()
    if bad:
        raise ValueError("columns do not line up with the headings in " + ", ".join(f"{r.file} ({r.headers} headers, {r.too_wide} rows too wide)" for r in bad))
    return bulk


def bulk_rows(bulk: DataFrame, headings: list[dict]) -> DataFrame:
    """Data rows as raw maps, the way a search page would give them. Loads pass ``bulk`` through ``require_alignment`` first.

    Empty cells are absent; set quality flags fold into ``assertions``; ``id`` becomes ``uuid`` when there is none.
    """
    fields = [(f"c{i}", h["field"]) for i, h in enumerate(headings) if not h["flag"]]
    flags = [(f"c{i}", h["field"]) for i, h in enumerate(headings) if h["flag"]]
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col(c).alias("value")) for c, f in fields])
    filled = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))
    set_flags = F.array_compact(F.array(*[F.when(F.col(c) == "true", F.lit(f)) for c, f in flags])) if flags else F.array().cast("array<string>")
    rename = F.map_contains_key(filled, "id") & ~F.map_contains_key(filled, "uuid")
    text = F.when(rename, F.transform_keys(filled, lambda k, v: F.when(k == "id", F.lit("uuid")).otherwise(k))).otherwise(filled)
    return (
        bulk.filter(~F.col("is_header"))
        .select("file", "pos", text.alias("text"), set_flags.alias("flags"))
        .select("file", "pos", "text", F.when(F.size("flags") > 0, F.col("flags")).alias("assertions"))
    )


def bulk_raw(rows: DataFrame) -> DataFrame:
    """Bulk rows in the raw form the mapping reads: a map of variants."""
    as_variant = F.transform_values("text", lambda k, v: v.cast("variant"))
    flags = F.map_from_arrays(F.array(F.lit("assertions")), F.array(F.col("assertions").cast("variant")))
    raw = F.when(F.col("assertions").isNull(), as_variant).otherwise(F.map_concat(as_variant, flags))
    return rows.select(F.col("file").alias("page"), "pos", raw.alias("raw"))


# --- facet pages ---

FACET = "totalRecords bigint, facetResults array<struct<fieldName: string, fieldResult: array<struct<label: string, count: bigint>>>>"


def read_facets(spark: SparkSession, path: str) -> DataFrame:
    """Facet pages of an effort run, one per month: month, total_records, facets."""
    pages = spark.read.text(path, wholetext=True)
    body = F.from_json("value", FACET, {"mode": "FAILFAST"})
    return pages.select("month", body.alias("b")).select("month", F.col("b.totalRecords").alias("total_records"), F.col("b.facetResults").alias("facets"))


def facet_rows(facets: DataFrame, name: str = "point-0.1") -> DataFrame:
    return (
        facets.select("month", F.explode("facets").alias("f")).filter(F.col("f.fieldName") == name)
        .select("month", F.explode("f.fieldResult").alias("r")).select("month", "r.label", "r.count")
    )
