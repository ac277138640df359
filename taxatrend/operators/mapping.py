"""Raw source row -> canonical record with a trace of where every value came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxatrend import schema as sc
from taxatrend.functions.hashing import pseudonym
from taxatrend.functions.numeric import text_number
from taxatrend.functions.text import trim_space
from taxatrend.functions.timefn import iso_utc, text_instant
from taxatrend.operators.validate import issues, is_valid

REJECTED_NOTE = "value given but unreadable"


# First character of a JSON value -> kind; anything else is a number.
KINDS = {'"': "string", "[": "array", "{": "object", "t": "boolean", "f": "boolean", "n": "null"}


def _plain(json: Column) -> Column:
    """JSON text of a scalar other than a string, whole numbers without a decimal point."""
    return F.when(json.endswith(".0"), F.left(json, F.length(json) - 2)).otherwise(json)


def _item_text(v: Column) -> Column:
    json = F.to_json(v)
    return F.when(json.startswith('"'), F.try_variant_get(v, "$", "string")).otherwise(_plain(json))


def cells(raw: Column) -> Column:
    """What the mapping needs of each raw value, worked out once per value.

    kind; ``raw``: text of a scalar; ``items``: texts of an array; ``text``: trimmed text, array parts joined by
    '; '; ``empty``; ``json``. The passes are separate so that each one reads the results of the one before it, and
    the costlier expressions stand behind the kind they are for.
    """
    first = F.transform_values(raw, lambda k, v: F.struct(F.to_json(v).alias("json"), v.alias("v")))

    def read(k: Column, t: Column) -> Column:
        json, head = t["json"], F.left(t["json"], F.lit(1))
        kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
        return F.struct(
            json.alias("json"), F.coalesce(F.try_element_at(kinds, head), F.lit("number")).alias("kind"),
            F.when(head == '"', F.try_variant_get(t["v"], "$", "string")).when(~head.isin("[", "n"), _plain(json)).alias("raw"),
            F.when(head == "[", F.transform(F.try_variant_get(t["v"], "$", "array<variant>"), _item_text)).alias("items"),
        )

    def finish(k: Column, t: Column) -> Column:
        parts = F.filter(F.transform(t["items"], trim_space), lambda x: x != "")
        text = F.nullif(F.when(t["kind"] == "array", F.array_join(parts, "; ")).otherwise(trim_space(t["raw"])), F.lit(""))
        return F.struct(t["kind"].alias("kind"), t["raw"].alias("raw"), t["items"].alias("items"), text.alias("text"), t["json"].alias("json"))

    texts = F.transform_values(F.transform_values(first, read), finish)
    return F.transform_values(
        texts, lambda k, t: F.struct(t["kind"].alias("kind"), t["raw"].alias("raw"), t["items"].alias("items"), t["text"].alias("text"), t["text"].isNull().alias("empty"), t["json"].alias("json"))
    )


def flatten_rows(rows: DataFrame, keep: list[str], nested: str = "otherProperties") -> DataFrame:
    """Raw maps -> ``flat`` (map of cells) and ``lifted``: keys of the nested object come to the top. A populated
    key of the same name stays, and the nested value is kept under a prefixed name."""
    none = F.create_map().cast("map<string,variant>")
    inner = F.coalesce(F.try_variant_get(F.try_element_at("raw", F.lit(nested)), "$", "map<string,variant>"), none)
    two = rows.select(*keep, cells(F.map_filter("raw", lambda k, v: k != nested)).alias("_top"), cells(inner).alias("_inner"))
    clash = lambda k: F.coalesce(~F.try_element_at("_top", k)["empty"], F.lit(False))
    named = two.withColumn(
        "_named", F.transform_keys("_inner", lambda k, v: F.when(clash(k), F.concat(F.lit(f"{nested}."), k)).otherwise(k))
    )
    return named.select(
        *keep,
        F.map_concat(F.map_filter("_top", lambda k, v: ~F.map_contains_key("_named", k)), "_named").alias("flat"),
        F.filter(F.map_keys("_inner"), lambda k: ~clash(k)).alias("lifted"),
    )


def _value(f: sc.Field, c: Column, salt: str) -> tuple[Column, Column]:
    """Canonical value of a chosen cell, and whether it is the raw value carried across unchanged."""
    if f.path == "recordedByPseudonym":
        return pseudonym(F.when(c["kind"] == "array", F.array_join(c["items"], "|")).otherwise(c["raw"]), salt), F.lit(False)
    number = text_number(F.coalesce(c["raw"], c["text"]))
    if f.kind in ("number", "latitude", "longitude"):
        return number, c["kind"] == "number"
    if f.kind == "integer":
        whole = F.when(F.abs(number) < 9.2e18, F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))
        return whole, (c["kind"] == "number") & (whole == number)
    if f.kind == "iso8601":
        at = text_instant(c["text"])
        return at, (c["kind"] == "string") & (c["raw"] == iso_utc(at))
    if f.kind == "string[]":
        ordered = F.when(c["kind"] == "array", F.array_sort(c["items"]))
        return ordered, ordered == c["items"]
    return c["text"], (c["kind"] == "string") & (c["raw"] == c["text"])


def chosen(f: sc.Field, flat: Column) -> dict[str, Column]:
    """First populated source field of ``f``: its cell, the name used, and the JSON of the first one present.

    Plain columns, not one struct: the optimizer would fold a struct that is only taken apart again back into
    every place that uses it, and look each cell up many times over.
    """
    found = [F.try_element_at(flat, F.lit(s)) for s in f.sources]
    if len(found) == 1:
        return {"cell": found[0]}
    named = F.array(*[F.struct(c.alias("cell"), F.lit(s).alias("used")) for c, s in zip(found, f.sources)])
    first = F.get(F.filter(named, lambda x: ~x["cell"]["empty"]), 0)
    present = F.get(F.filter(named, lambda x: x["cell"].isNotNull()), 0)
    return {"cell": first["cell"], "used": first["used"], "present": present["cell"]["json"]}


def picked(f: sc.Field) -> dict[str, Column]:
    """The columns of a field after the first step: cell, used, present."""
    cell = F.col(f"cell_{f.column}")
    if len(f.sources) == 1:
        return {"cell": cell, "used": F.when(~cell["empty"], f.sources[0]), "present": cell["json"]}
    return {"cell": cell, "used": F.col(f"used_{f.column}"), "present": F.coalesce(cell["json"], F.col(f"present_{f.column}"))}


def mapped(f: sc.Field) -> dict[str, Column]:
    """The columns of a field after the second step: its value, and whether that is the raw value unchanged."""
    return {"value": F.col(f"value_{f.column}"), "unchanged": F.col(f"same_{f.column}")}


def field_status(c: dict[str, Column], m: dict[str, Column]) -> Column:
    return (
        F.when(c["present"].isNull(), "absent_from_source").when(c["used"].isNull(), "empty_in_source").when(m["value"].isNull(), "rejected")
        .when(m["unchanged"], "mapped").otherwise("derived")
    )


def trace_line(f: sc.Field, c: dict[str, Column], m: dict[str, Column]) -> Column:
    """What happened to one field on its way."""
    value, status = m["value"], field_status(c, m)
    if f.note:
        note = F.lit(f.note)
    else:
        taken = F.concat(F.lit("taken from `"), c["used"], F.lit("`")) if len(f.sources) > 1 else F.lit(None).cast("string")
        note = F.when(c["used"].isNotNull() & value.isNull(), REJECTED_NOTE).otherwise(taken)
    if f.kind == "iso8601":
        value = iso_utc(value)
    elif f.kind == "string[]":
        value = F.to_json(value)
    return F.struct(
        F.lit(f.path).alias("canonical_field"), F.array(*[F.lit(s) for s in f.sources]).alias("source_fields"),
        c["present"].alias("raw_value"), value.cast("string").alias("canonical_value"), status.alias("status"), note.alias("note"),
    )


def derive_field(name: str, flat: Column, sources: list[str], compute, note: str | None = None) -> Column:
    """A value computed from all populated inputs at once; its trace shows every input and says 'derived'."""
    inputs = F.map_filter(flat, lambda k, v: k.isin(sources) & ~v["empty"])
    value = compute(F.transform_values(inputs, lambda k, v: v["text"]))
    return F.struct(
        F.lit(name).alias("canonical_field"), F.array(*[F.lit(s) for s in sources]).alias("source_fields"),
        F.to_json(F.transform_values(inputs, lambda k, v: v["text"])).alias("raw_value"), value.cast("string").alias("canonical_value"),
        F.lit("derived").alias("status"), F.lit(note).cast("string").alias("note"),
    )


def excluded_fields(flat: Column) -> Column:
    """Populated fields left out on purpose: field, reason, value."""
    reasons = F.create_map(*[F.lit(x) for reason, names in sc.EXCLUDED.items() for n in names for x in (n, reason)])
    hits = F.filter(F.map_entries(flat), lambda e: ~e["value"]["empty"] & F.map_contains_key(reasons, e["key"]))
    return F.transform(
        hits, lambda e: F.struct(e["key"].alias("field"), F.try_element_at(reasons, e["key"]).alias("reason"), e["value"]["json"].alias("value"))
    )


def known_fields() -> list[str]:
    return sorted({*sc.IGNORED, *(n for ns in sc.EXCLUDED.values() for n in ns), *(s for f in sc.MAPPED for s in f.sources)})


def unmapped_fields(flat: Column) -> Column:
    """Fields nothing accounts for, sorted: field, value."""
    names = F.array_sort(F.array_except(F.map_keys(flat), F.array(*[F.lit(k) for k in known_fields()])))
    return F.transform(names, lambda k: F.struct(k.alias("field"), F.try_element_at(flat, k)["json"].alias("value")))


def adapt(rows: DataFrame, salt: str, as_of: str, full_trace: bool = False) -> DataFrame:
    """``rows``: page, pos, raw, harvest_id, fetched_at -> canonical columns plus what the analyses need of the trace.

    ``statuses`` holds the status of every mapped field in declaration order, which is what field coverage reads.
    The full trace, several times the size of the record, is added on request: mapping is deterministic, so the
    trace of any record is had again from its page. ``as_of``: the instant that dates are judged future against. Write the result to a table before filtering
    it: a filter on a computed column would be pushed below the mapping and repeat it.
    """
    step = flatten_rows(rows, ["page", "pos", "harvest_id", "fetched_at"])
    # One projection per step, so that a cell is looked up once and a value computed once, however often used.
    first = [e.alias(f"{name}_{f.column}") for f in sc.MAPPED for name, e in chosen(f, F.col("flat")).items()]
    step = step.select("*", *first)
    second = []
    for f in sc.MAPPED:
        c = picked(f)
        value, unchanged = _value(f, c["cell"], salt)
        second += [F.when(c["used"].isNotNull(), value).alias(f"value_{f.column}"), F.coalesce(unchanged, F.lit(False)).alias(f"same_{f.column}")]
    step = step.select("*", *second)
    values = {f.column: mapped(f)["value"] for f in sc.MAPPED}
    values["source_record_id"] = F.coalesce(values["source_record_id"], F.lit(""))
    values["source_assertions"] = F.coalesce(values["source_assertions"], F.array().cast("array<string>"))
    out = step.select(
        F.concat(F.lit(f"{sc.SOURCE}:"), values["source_record_id"]).alias("record_id"),
        F.lit(sc.SOURCE).alias("source"),
        *[v.alias(c) for c, v in values.items()],
        "harvest_id", F.col("page").alias("snapshot_page"), "fetched_at", F.col("pos").alias("page_pos"),
        F.array(*[field_status(picked(f), mapped(f)) for f in sc.MAPPED]).alias("statuses"),
        *([F.array(*[trace_line(f, picked(f), mapped(f)) for f in sc.MAPPED]).alias("trace")] if full_trace else []),
        excluded_fields(F.col("flat")).alias("excluded_fields"),
        unmapped_fields(F.col("flat")).alias("unmapped_fields"),
        F.col("lifted").alias("lifted_fields"),
    )
    out = out.withColumn("issues", issues(as_of))
    return out.withColumns(
        {"is_valid": is_valid(F.col("issues")), "issue_count": F.size("issues"), "unmapped_count": F.size("unmapped_fields")}
    )


def first_of_each(adapted: DataFrame) -> DataFrame:
    """Drop repeats of a record id; the first in page order stays.

    Keeping rank 1 lets each task drop its own repeats before the shuffle, so an id that very many rows share
    (rows without an id all do) does not pile up in one task.
    """
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy("snapshot_page", "page_pos"))
    return adapted.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def adapt_summary(adapted: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: records kept, valid, with errors, and repeats removed."""
    k = kept.agg(
        F.count("*").alias("records_adapted"), F.count_if("is_valid").alias("records_valid"), F.count_if(~F.col("is_valid")).alias("records_with_errors")
    )
    return k.crossJoin(adapted.agg(F.count("*").alias("seen"))).select(  # one-row sides
        "records_adapted", "records_valid", "records_with_errors", (F.col("seen") - F.col("records_adapted")).alias("duplicates")
    )
