"""Coded checks of canonical records and of insights, and conformance to the declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatrend import schema as sc
from taxatrend.functions.timefn import dated_instant

# Coarse bounding box of Australia and its offshore waters.
LAT, LON = (-44.0, -9.0), (112.0, 154.0)


def _issue(when: Column, field: str, severity: str, code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("message")))


def issues(as_of: str, event_text: Column | None = None) -> Column:
    """Array of issues of a canonical row.

    ``event_text``: the event date as text, for records whose date was not typed by the mapping. The mapping
    rejects text that is no date, so its rows can miss a date but not hold an unreadable one.
    """
    lat, lon, unc, n = (F.col(c) for c in ("decimal_latitude", "decimal_longitude", "coordinate_uncertainty_m", "individual_count"))
    placed = lat.isNotNull() & lon.isNotNull()
    on_earth = lat.between(-90, 90) & lon.between(-180, 180)
    inside = lat.between(*LAT) & lon.between(*LON)
    point = F.concat(lat.cast("string"), F.lit(", "), lon.cast("string"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    where, day = "decimalLatitude/decimalLongitude", F.col("event_date")
    if event_text is not None:
        day = dated_instant(event_text)
    given = day.isNotNull() if event_text is None else event_text.isNotNull()
    shown = day.cast("string") if event_text is None else event_text
    return F.array_compact(
        F.array(
            _issue(blank("source_record_id"), "provenance.sourceRecordId", "error", "MISSING_SOURCE_RECORD_ID", "record has no identifier of its source"),
            _issue(blank("scientific_name"), "scientificName", "error", "MISSING_SCIENTIFIC_NAME", "record names no taxon"),
            _issue(~placed, where, "warning", "MISSING_COORDINATES", "no usable pair of coordinates"),
            _issue(placed & ~on_earth, where, "error", "COORDINATES_OUT_OF_RANGE", F.concat(F.lit("not a point on Earth: "), point)),
            _issue(placed & on_earth & ~inside, where, "warning", "OUTSIDE_AUSTRALIA_BBOX", F.concat(F.lit("outside the Australian box: "), point)),
            _issue(unc < 0, "coordinateUncertaintyInMeters", "warning", "NEGATIVE_UNCERTAINTY", F.concat(F.lit("uncertainty below zero: "), unc.cast("string"))),
            _issue(~given, "eventDate", "warning", "MISSING_EVENT_DATE", "no event date"),
            _issue(given & day.isNull(), "eventDate", "error", "UNPARSEABLE_EVENT_DATE", F.concat(F.lit("unreadable event date: "), shown)),
            _issue(day > F.lit(as_of).cast("timestamp"), "eventDate", "warning", "FUTURE_EVENT_DATE", F.concat(F.lit("event date in the future: "), shown)),
            _issue(n < 0, "individualCount", "warning", "NEGATIVE_INDIVIDUAL_COUNT", F.concat(F.lit("count below zero: "), n.cast("string"))),
        )
    )


def is_valid(found: Column) -> Column:
    return ~F.exists(found, lambda i: i["severity"] == "error")


# --- schema conformance ---


def _conforms(v: Column, kind: str) -> Column:
    """Whether a variant has the declared type."""
    t = F.schema_of_variant(v)
    numeric = t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    n = F.try_variant_get(v, "$", "double")
    tests = {
        "string": t == "STRING",
        "boolean": t == "BOOLEAN",
        "integer": numeric & (n == F.floor(n)),
        "number": numeric,
        "iso8601": (t == "STRING") & dated_instant(F.try_variant_get(v, "$", "string")).isNotNull(),
        "latitude": numeric & n.between(-90, 90),
        "longitude": numeric & n.between(-180, 180),
        "string[]": t.startswith("ARRAY")
        & F.forall(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING"),
    }
    return F.coalesce(tests[kind], F.lit(False))


def schema_checks(record: Column) -> Column:
    """Per declared field of a record variant: path, status, actual type.

    status: ok, empty, missing_required or type_mismatch.
    """
    lines = []
    for f in sc.FIELDS:
        v = F.try_variant_get(record, f"$.{f.path}", "variant")
        t = F.schema_of_variant(v)
        empty = v.isNull() | (t == "VOID") | ((t == "STRING") & (F.try_variant_get(v, "$", "string") == ""))
        status = F.when(empty, "missing_required" if f.required else "empty").when(_conforms(v, f.kind), "ok").otherwise("type_mismatch")
        actual = (
            F.when(v.isNull(), "absent").when(t == "VOID", "null").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string")
            .when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object").otherwise("number")
        )
        lines.append(F.struct(F.lit(f.path).alias("path"), status.alias("status"), actual.alias("actual_type")))
    return F.array(*lines)


def schema_conformance(records: DataFrame, record: str) -> DataFrame:
    """Counts per field, status and actual type over a column of record variants."""
    return records.select(F.explode(schema_checks(F.col(record))).alias("c")).groupBy("c.path", "c.status", "c.actual_type").agg(F.count("*").alias("records"))
