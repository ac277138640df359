"""The shared insight record, its packed form, and typed reads of the packed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxatrend.functions.text import display_name

TYPES = ["silent_species", "range_change", "reporting_rate", "co_movement", "notable_record", "other"]
COLUMNS = [
    "insight_id", "run_id", "insight_type", "taxon_concept_id", "related_taxa", "region",
    "period_start", "period_end", "figures", "confidence", "summary", "query_ids",
]


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def name_of() -> Column:
    return display_name(F.col("vernacular_name"), F.col("scientific_name"))


def window_struct(w) -> Column:
    return F.struct(F.lit(w.start).alias("start"), F.lit(w.end).alias("end"))


def insight_key(run_id: Column) -> Column:
    """Readable natural key: run, type, taxon, region, and the state of a notable group."""
    state = F.when(F.col("insight_type") == "notable_record", F.get_json_object("figures", "$.state_province"))
    parts = [run_id, F.col("insight_type"), F.col("taxon_concept_id"), F.col("region"), state]
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in parts])


def pack(df: DataFrame, run_id: str) -> DataFrame:
    """Typed operator output -> the shared table. Figures and confidence become JSON text at rest."""
    cols = set(df.columns)
    out = df.select(
        F.lit(run_id).alias("run_id"),
        "insight_type",
        "taxon_concept_id",
        F.col("related_taxa") if "related_taxa" in cols else F.array().cast("array<string>").alias("related_taxa"),
        "region",
        "period_start",
        "period_end",
        F.to_json("figures", {"ignoreNullFields": "false"}).alias("figures"),
        F.to_json("confidence", {"ignoreNullFields": "false"}).alias("confidence"),
        "summary",
        F.array().cast("array<bigint>").alias("query_ids"),
    )
    return out.withColumn("insight_id", insight_key(F.col("run_id"))).select(*COLUMNS)


def unpack(insights: DataFrame) -> DataFrame:
    """Parse the JSON islands once; the accessors below read them."""
    return insights.withColumns({"figures": F.parse_json("figures"), "confidence": F.parse_json("confidence")})


def fig(path: str, kind: str = "string", of: str = "figures") -> Column:
    """A typed value at a path of an unpacked island; null when absent or of another type."""
    return F.try_variant_get(F.col(of), f"$.{path}", kind)


def fig_number(path: str, of: str = "figures") -> Column:
    return fig(path, "double", of)


def label() -> Column:
    """The kind or flag an insight is filed under."""
    return F.coalesce(fig("kind"), fig("flag"))


def flatten(df: DataFrame, *structs: str) -> DataFrame:
    """Top-level columns for every leaf of the named struct columns, joined by underscores."""
    out: list[Column] = []

    def leaves(path: str, name: str, t: T.DataType) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                leaves(f"{path}.{f.name}", f"{name}_{f.name}" if name else f.name, f.dataType)
        else:
            out.append(F.col(path).alias(name))

    for f in df.schema.fields:
        if f.name in structs:
            leaves(f.name, "" if f.name == structs[0] else f.name, f.dataType)
        else:
            out.append(F.col(f.name))
    return df.select(*out)
