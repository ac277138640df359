"""Scoring one set of insights (an AI arm's) against the calculated set: reproduction, discovery, grounding.

Functions take insights as ``insight.unpack`` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxatrend.functions.numeric import close, fixed, share, text_number
from taxatrend.functions.text import mention_form
from taxatrend.operators.insight import TYPES, fig, fig_number

#: Findings per priority set that a score is stated for; every function takes its own number.
PRIORITY_K = 15

#: A number written as text, as scoring reads it: a fixed pattern, stricter than the one of the mapping.
SCORED_NUMBER = r"(?i)^-?\d+(\.\d+)?(e-?\d+)?$"


def scored_number(s: Column) -> Column:
    return text_number(s, SCORED_NUMBER)


def match_key() -> Column:
    """National silence matches on the taxon alone; everything else on taxon, region and period."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = F.coalesce("taxon_concept_id", F.lit("null"))
    national = (F.col("insight_type") == "silent_species") & F.col("region").isNull()
    return F.when(national, F.concat_ws("|", "insight_type", t, F.lit(""), F.lit("national"))).otherwise(
        F.concat_ws("|", F.col("insight_type"), t, none("region"), none("period_start"), none("period_end"))
    )


def calculated_by_key(calc: DataFrame) -> DataFrame:
    """One calculated insight per key; the last of repeats."""
    keyed = calc.withColumn("key", match_key())
    last = Window.partitionBy("key").orderBy(F.desc("insight_id"))
    return keyed.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") == 1).select(
        "key", F.col("insight_id").alias("calculated_insight_id"), F.col("figures").alias("calc")
    )


def _get(of: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(of), f"$.{path}", kind)


def _num(of: str, path: str) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(_get(of, path, "variant")) != "STRING", _get(of, path, "double")), scored_number(_get(of, path)))


def _same(path: str) -> Column:
    """Equal as JSON: an absent value is not the same as an explicit null."""
    return F.to_json(_get("figures", path, "variant")).eqNullSafe(F.to_json(_get("calc", path, "variant")))


def _near(path: str, rel: float = 0.01) -> Column:
    return close(_num("figures", path), _num("calc", path), rel)


def reason_label(reason: Column) -> Column:
    """Any wording of a notable-record reason in the vocabulary of the calculated set."""
    s = F.lower(reason)
    return (
        F.when(s.rlike(r"outside_range|\bkm\b|distance|range"), "outside_range").when(s.rlike("new_region|region|ibra"), "new_region")
        .when(s.rlike("season|month|%"), "out_of_season").otherwise(s)
    )


def figure_checks() -> Column:
    """array<struct<check, agrees>> for a matched pair (``figures``, ``calc``), by insight type."""
    flag = _get("figures", "flag").eqNullSafe(_get("calc", "flag"))
    said = _get("figures", "last_record_date", "variant")
    date_ok = said.isNull() | F.coalesce(F.substring(F.coalesce(_get("figures", "last_record_date"), F.lit("null")), 1, 10) == _get("calc", "last_record_date"), F.lit(False))
    gap_led = (_get("figures", "kind") == "evidence_gap") & (_get("calc", "evidence_gap", "boolean"))
    direction = lambda of: F.signum(_num(of, "detection_ratio") - 1)
    labels = lambda of: F.array_sort(F.array_distinct(F.transform(F.coalesce(_get(of, "reasons", "array<string>"), F.array().cast("array<string>")), reason_label)))
    per_type = {
        "silent_species": {
            "kind": _same("kind") | F.coalesce(gap_led, F.lit(False)), "records_since_2015": _near("records_since_2015", 0), "last_record_date": date_ok,
        },
        "range_change": {
            "flag": _same("flag"), "aoo_10km_baseline": _near("aoo_10km_km2.baseline", 0), "aoo_10km_recent": _near("aoo_10km_km2.recent", 0),
            "aoo_10km_change": _near("aoo_10km_km2.change", 0.02), "eoo_change": _near("eoo_km2.change", 0.05),
            "records_baseline": _near("records.baseline", 0), "records_recent": _near("records.recent", 0),
        },
        "reporting_rate": {
            "flag": flag, "direction": F.coalesce(direction("figures") == direction("calc"), F.lit(False)),
            "detection_ratio_within_5pct": _near("detection_ratio", 0.05),
        },
        "co_movement": {"flag": flag, "declines": _near("declines", 0), "increases": _near("increases", 0), "taxa_assessed": _near("taxa_assessed", 0)},
        "notable_record": {"reasons": labels("figures") == labels("calc"), "records": _near("records", 0)},
    }
    out = F.when(F.lit(False), F.array().cast("array<struct<check:string,agrees:boolean>>"))
    for t, checks in per_type.items():
        out = out.when(F.col("insight_type") == t, F.array(*[F.struct(F.lit(n).alias("check"), c.alias("agrees")) for n, c in checks.items()]))
    return out.otherwise(F.array().cast("array<struct<check:string,agrees:boolean>>"))


def _headline_row() -> Column:
    return F.col("taxon_concept_id").isNull() & F.col("region").isNull()


def reproduction(ai: DataFrame, calc: DataFrame) -> DataFrame:
    """AI insights of a computed type with their match and figure checks; headline rows are scored apart."""
    mine = ai.filter((F.col("insight_type") != "other") & ~_headline_row()).withColumn("key", match_key())
    j = mine.join(calculated_by_key(calc), "key", "left").withColumn("matched", F.col("calculated_insight_id").isNotNull())
    return j.withColumn("checks", F.when(F.col("matched"), figure_checks())).select(
        "insight_id", "insight_type", "key", "matched", "calculated_insight_id", "checks", "summary"
    )


def reproduction_totals(repro: DataFrame) -> DataFrame:
    agreed = F.size(F.filter("checks", lambda c: c["agrees"]))
    t = repro.agg(
        F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"),
        F.coalesce(F.sum(F.when(F.col("matched"), agreed)), F.lit(0)).alias("agreed"), F.coalesce(F.sum(F.when(F.col("matched"), F.size("checks"))), F.lit(0)).alias("checked"),
    )
    return t.withColumn("figure_agreement", fixed(share(F.col("agreed"), F.nullif("checked", F.lit(0))), 3))


# --- headline counts ---


def headline_counts(calc: DataFrame) -> DataFrame:
    """Counts the calculated set would put in its headlines. A silent taxon with too few records counts twice."""
    t, kind, flag = F.col("insight_type"), fig("kind"), fig("flag")
    flagged = F.coalesce(flag, F.lit("")) != ""
    as_flag = F.concat(t, F.lit(":"), flag)
    keys = F.array_compact(
        F.array(
            F.when(t == "silent_species", F.concat(F.lit("silent_species:"), F.coalesce(kind, F.lit("null")))),
            F.when((t == "silent_species") & (kind == "silent") & fig("evidence_gap", "boolean"), "silent_species:evidence_gap"),
            F.when(t.isin("co_movement", "range_change") & flagged, as_flag),
            F.when((t == "reporting_rate") & flagged & F.col("region").isNull(), as_flag),
            F.when(t == "notable_record", "notable_record:groups"),
        )
    )
    return calc.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("calculated"))


def headline_checks(ai: DataFrame, calc: DataFrame) -> DataFrame:
    """AI insights about the whole country and no taxon, against the calculated counts."""
    t = F.col("insight_type")
    said = F.coalesce(F.when(t == "silent_species", fig("kind")).otherwise(fig("flag")), F.lit("null"))
    key = F.when(t.isin("silent_species", "range_change", "reporting_rate", "co_movement"), F.concat(t, F.lit(":"), said)).otherwise("notable_record:groups")
    rows = ai.filter((t != "other") & _headline_row()).select("insight_id", key.alias("key"), _num("figures", "count").alias("ai"))
    out = rows.join(headline_counts(calc), "key", "left").withColumn("calculated", F.coalesce("calculated", F.lit(0)))
    return out.withColumn("agrees", F.coalesce(F.col("ai") == F.col("calculated"), F.lit(False)))


# --- discovery ---


def priority_sets(calc: DataFrame, k: int = PRIORITY_K) -> DataFrame:
    """The k gravest findings of each kind: what an open-ended search should surface."""
    n = lambda path: F.coalesce(fig_number(path), F.lit(0.0))
    t, kind, flag = F.col("insight_type"), fig("kind"), fig("flag")
    sets = {
        "silent": (kind == "silent", n("baseline_annual_mean")),
        "regional_silence": (kind == "regional_silence", n("baseline_records")),
        "contraction": (flag == "contraction", F.least(n("records.baseline"), F.lit(1e9)) * -n("aoo_10km_km2.change")),
        "notable": (t == "notable_record", n("max_distance_to_prior_km")),
        "co_decline": ((t == "co_movement") & (flag == "co_decline"), -n("p_decline")),
        "rate_decline": (
            (t == "reporting_rate") & F.col("region").isNull() & (flag == "decline"),
            n("detections.baseline") * -F.ln(F.greatest(n("detection_ratio"), F.lit(1e-6))),
        ),
    }
    entries = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(s).alias("set"), score.alias("score"))) for s, (cond, score) in sets.items()]))
    ranked = calc.select("insight_id", "taxon_concept_id", "region", "summary", F.explode(entries).alias("e")).select("*", "e.set", "e.score").drop("e")
    rank = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("score"), "insight_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k)


def taxa_of(insights: DataFrame) -> DataFrame:
    """Every taxon an insight is about: its own and the related ones, with the insight's region."""
    own = F.array_compact(F.array_distinct(F.concat(F.array("taxon_concept_id"), F.coalesce("related_taxa", F.array().cast("array<string>")))))
    t = insights.select("insight_id", F.explode(own).alias("taxon_concept_id"), F.coalesce("region", F.lit("")).alias("at"))
    return t.filter(F.col("taxon_concept_id") != "")


#: Characters of the grams that texts and names meet by; a shorter name is one gram.
GRAM = 5


def grams(text: Column, n: int) -> Column:
    """The different runs of n characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))) if n else F.array(F.lit(""))


def substring_join(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` (text) and ``names`` (name) -> (text, name) for every name that is part of a text.

    A name can only be in a text that holds its rarest gram, so the two meet by equality on that gram; what meets is then compared.
    Texts are followed by a hash and joined back, not repeated for each gram.
    """
    keyed = texts.select("text").distinct().withColumn("key", F.xxhash64("text"))
    sized = names.select("name").distinct().withColumn("size", F.least(F.length("name"), F.lit(GRAM)))
    sizes = sorted(r["size"] for r in sized.select("size").distinct().collect())  # six at most
    if not sizes:
        return keyed.select("text", F.lit("").alias("name")).limit(0)
    text_grams = keyed.select("key", F.explode(F.concat(*[grams(F.col("text"), n) for n in sizes])).alias("gram"))
    own = sized.select("name", F.explode(F.coalesce(*[F.when(F.col("size") == n, grams(F.col("name"), n)) for n in sizes])).alias("gram"))
    often = text_grams.join(own.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(often, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    met = text_grams.join(rarest.filter("g.n > 0").select("name", F.col("g.gram").alias("gram")), "gram").select("key", "name")
    return keyed.join(met, "key").filter(F.contains("text", "name")).select("text", "name")


def mentions(ai: DataFrame, findings: DataFrame, taxa: DataFrame) -> DataFrame:
    """Insight ids of findings some AI text names: the taxon and, for a regional finding, the region; a finding without taxon by its region."""
    texts = ai.select(mention_form(F.concat_ws(" ", "summary", F.coalesce("region", F.lit("")))).alias("text"))
    named = findings.select("insight_id", "taxon_concept_id", "region").distinct().join(
        taxa.select("taxon_concept_id", "vernacular_name", "scientific_name"), "taxon_concept_id", "left"
    )
    where = F.lower("region")
    forms = F.filter(F.array(*[mention_form(F.col(c)) for c in ("vernacular_name", "scientific_name")]), lambda x: F.coalesce(x, F.lit("")) != "")
    by_name = named.select("insight_id", F.when(F.col("taxon_concept_id").isNotNull(), where).alias("place"), F.explode(
        F.when(F.col("taxon_concept_id").isNull(), F.array(F.coalesce(where, F.lit("")))).otherwise(forms)).alias("name"))
    met = substring_join(texts, by_name).join(by_name, "name")
    return met.filter(F.col("place").isNull() | F.contains("text", "place")).select("insight_id").distinct()


def discovered(ai: DataFrame, calc: DataFrame, taxa: DataFrame, k: int = PRIORITY_K) -> DataFrame:
    """Priority findings with whether the AI found them by key, and by key or mention."""
    sets = priority_sets(calc, k)
    mine = taxa_of(ai)
    anywhere = mine.select("taxon_concept_id").distinct().withColumn("any", F.lit(True))
    placed = mine.select("taxon_concept_id", "at").distinct().withColumn("here", F.lit(True))
    regions = ai.filter(F.coalesce("region", F.lit("")) != "").select("region").distinct().withColumn("reg", F.lit(True))
    out = (
        sets.withColumn("at", F.coalesce("region", F.lit("")))
        .join(anywhere, "taxon_concept_id", "left").join(placed, ["taxon_concept_id", "at"], "left").join(regions, "region", "left")
        .join(mentions(ai, sets, taxa).withColumn("named", F.lit(True)), "insight_id", "left")
    )
    found = F.when(F.col("taxon_concept_id").isNull(), F.col("reg")).when(F.col("set") == "regional_silence", F.col("here")).otherwise(F.col("any"))
    out = out.withColumn("found", F.coalesce(found, F.lit(False)))
    return out.withColumn("mentioned", F.col("found") | F.coalesce("named", F.lit(False))).select(
        "set", "rank", "insight_id", "taxon_concept_id", "region", "score", "found", "mentioned", "summary"
    )


def recall(found: DataFrame) -> DataFrame:
    """Per set and overall: findings, found by key, by mention, and the missed ones."""
    per = found.groupBy("set").agg(
        F.count_if("found").alias("found"), F.count_if("mentioned").alias("mentioned"), F.count("*").alias("of"),
        F.sort_array(F.collect_list(F.when(~F.col("mentioned"), F.col("summary")))).alias("missed"),  # at most PRIORITY_K
    )
    total = per.agg(F.sum("found").alias("found"), F.sum("mentioned").alias("mentioned"), F.sum("of").alias("of")).select(
        F.lit("overall").alias("set"), "found", "mentioned", "of", F.array().cast("array<string>").alias("missed")
    )
    return per.unionByName(total).withColumns(
        {"recall_by_key": fixed(share(F.col("found"), F.nullif("of", F.lit(0))), 3), "recall_by_mention": fixed(share(F.col("mentioned"), F.nullif("of", F.lit(0))), 3)}
    )


def unflagged_taxa_insights(ai: DataFrame, calc: DataFrame) -> DataFrame:
    """How many AI insights are on a taxon the calculated set says nothing about."""
    raised = (F.coalesce(fig("kind"), F.lit("")) != "") | (F.coalesce(fig("flag"), F.lit("")) != "") | (F.col("insight_type") == "notable_record")
    known = calc.filter(raised & F.col("taxon_concept_id").isNotNull()).select("taxon_concept_id").distinct()
    mine = ai.filter(F.coalesce("taxon_concept_id", F.lit("")) != "")
    return mine.join(known, "taxon_concept_id", "left_anti").agg(F.count("*").alias("insights_on_unflagged_taxa"))


# --- grounding ---


def nesting(v: Column) -> Column:
    """How many objects and arrays a variant's deepest value lies in."""
    brackets = F.regexp_replace(F.regexp_replace(F.to_json(v), r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    step = lambda acc, c: F.struct(
        (acc["at"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("at"), F.greatest(acc["most"], acc["at"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most")
    )
    return F.coalesce(F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step)["most"], F.lit(0))


def numeric_leaves(df: DataFrame, keys: list[str], figures: str) -> DataFrame:
    """keys, path, value: every number in a JSON value at any depth, numbers written as text included.

    The plan has one step per level of the deepest value, which is looked up first (one number).
    """
    cur = df.select(*keys, F.lit("").alias("path"), F.col(figures).alias("v"))
    for _ in range(df.agg(F.max(nesting(F.col(figures)))).first()[0] or 0):
        kind = F.schema_of_variant("v")
        as_object = F.transform(
            F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")),
            lambda e: F.struct(F.when(F.col("path") == "", e["key"]).otherwise(F.concat("path", F.lit("."), e["key"])).alias("path"), e["value"].alias("v")),
        )
        as_array = F.transform(
            F.try_variant_get("v", "$", "array<variant>"), lambda x, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v"))
        )
        itself = F.array(F.struct("path", "v"))
        parts = F.when(kind.startswith("OBJECT"), as_object).when(kind.startswith("ARRAY"), as_array).otherwise(itself)
        cur = cur.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.path", "p.v")
    kind = F.schema_of_variant("v")
    n = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$", "double")).when(kind == "STRING", scored_number(F.try_variant_get("v", "$", "string")))
    return cur.select(*keys, "path", n.alias("value")).filter(F.col("value").isNotNull())


def result_numbers(results: DataFrame) -> DataFrame:
    """(query_id, n): the numbers of logged results, and the totals of columns with more than one.

    ``results``: query_id, row, column, value (text). Logged results are capped when they are logged.
    """
    n = results.withColumn("n", scored_number(F.col("value"))).filter(F.col("n").isNotNull())
    return n.select("query_id", "n").unionByName(column_totals(results).select("query_id", F.col("total").alias("n")))


def column_totals(results: DataFrame) -> DataFrame:
    n = results.withColumn("n", scored_number(F.col("value"))).filter(F.col("n").isNotNull())
    return n.groupBy("query_id", "column").agg(F.sum("n").alias("total"), F.count("*").alias("c")).filter(F.col("c") > 1).drop("c")


def decimals(x: Column) -> Column:
    """Decimal places a number is written with."""
    plain = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.length(F.regexp_extract(plain, r"\.(\d+)$", 1))


def matches(x: Column, places: Column, v: Column) -> Column:
    """Whether v gives x: within a thousandth of v, or by rounding v to x's places."""
    scale = F.pow(F.lit(10.0), places)
    scaled = F.abs(v) * scale
    rounded = F.when(scaled < 9e15, F.signum(v) * F.floor(F.when(scaled < 9e15, scaled) + 0.5) / scale).otherwise(v)
    return (F.abs(x - v) <= F.lit(0.001) * F.abs(v)) | (rounded == x)


#: What two cited values a and b may stand for: the value that a must have for it to be c, and the value itself.
FORMS = [
    (lambda b, c: b + c, lambda a, b: a - b), (lambda b, c: b * c, lambda a, b: a / b), (lambda b, c: b * (1 + c), lambda a, b: (a - b) / b),
    (lambda b, c: b * (1 + c / 100), lambda a, b: (a - b) / b * 100), (lambda b, c: b * (c / 100), lambda a, b: a / b * 100),
]


def reach() -> tuple[Column, Column]:
    """Least and greatest value that can give the stated number, a little widened."""
    x, half = F.col("value"), F.lit(0.5) / F.pow(F.lit(10.0), F.col("places"))
    ends = [x / 1.001, x / 0.999, x - half, x + half]
    wide = F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(x))
    return F.least(*ends) - wide, F.greatest(*ends) + wide


def in_reach(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """``wanted`` (insight_id, lo, hi and more) with every cited value ``a`` of its insight from lo to hi.

    A band join by equality: an interval lies in two buckets at most of the power of two at or above its length, and values are
    put into the buckets of the lengths that occur, so no list of an insight's values is held and no value meets all intervals.
    """
    level = F.ceil(F.log2(F.col("hi") - F.col("lo"))).cast("int")
    bucket = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level")))
    asked = wanted.withColumn("level", level)
    twice = asked.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("lo")), bucket(F.col("hi"))))))
    levels = asked.select("insight_id", "level").distinct()
    size = F.abs(F.col("a")) / F.pow(F.lit(2.0), F.col("level"))
    placed = values.select("insight_id", F.col("n").alias("a")).join(levels, "insight_id").filter(size < 1e17).withColumn("bucket", bucket(F.col("a")))
    return twice.join(placed, ["insight_id", "level", "bucket"]).filter(F.col("a").between(F.col("lo"), F.col("hi"))).drop("level", "bucket")


def grounded_numbers(asked: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of ``asked`` (insight_id, value, places; distinct) that are one of the insight's ``values`` (insight_id, n; distinct), or a
    difference, ratio or percentage of two of them."""
    low, high = reach()
    x, places = F.col("value"), F.col("places")
    itself = in_reach(asked.withColumns({"lo": low, "hi": high}), values).filter(matches(x, places, F.col("a"))).select(asked.columns).distinct()
    left = asked.join(itself, asked.columns, "left_anti")
    divided = left.join(values.filter("n <> 0").withColumnRenamed("n", "b"), "insight_id")
    ends = []
    for i, (partner, _) in enumerate(FORMS):
        one, two = partner(F.col("b"), low), partner(F.col("b"), high)
        slack = F.lit(1e-12) * F.greatest(F.abs(one), F.abs(two))
        ends.append(F.struct(F.lit(i).alias("form"), (F.least(one, two) - slack).alias("lo"), (F.greatest(one, two) + slack).alias("hi")))
    wanted = divided.select(*divided.columns, F.explode(F.array(*ends)).alias("e")).select(*divided.columns, "e.*").filter((F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") < 1e300))
    met = in_reach(wanted, values)
    made = F.coalesce(*[F.when(F.col("form") == i, form(F.col("a"), F.col("b"))) for i, (_, form) in enumerate(FORMS)])
    return itself.unionByName(met.filter(matches(x, places, made)).select(asked.columns).distinct())


def grounding_lines(ai: DataFrame, results: DataFrame) -> DataFrame:
    """(insight_id, path, value, ok): every number an AI insight states, and whether the results it cites give it."""
    cited = ai.select("insight_id", F.explode("query_ids").alias("query_id")).distinct().join(result_numbers(results), "query_id")
    values = cited.select("insight_id", "n").distinct()
    stated = numeric_leaves(ai, ["insight_id"], "figures").withColumn("places", decimals(F.col("value")))
    ok = grounded_numbers(stated.select("insight_id", "value", "places").distinct(), values).withColumn("ok", F.lit(True))
    return stated.join(ok, ["insight_id", "value", "places"], "left").select("insight_id", "path", "value", F.coalesce("ok", F.lit(False)).alias("ok"))


def grounding(ai: DataFrame, results: DataFrame) -> DataFrame:
    """Per AI insight: numbers stated, numbers grounded in the cited results, and the paths that are not."""
    per = grounding_lines(ai, results).groupBy("insight_id").agg(
        F.count("*").alias("numbers"), F.count_if("ok").alias("grounded"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("path")))).alias("ungrounded"),
    )
    return ai.select("insight_id").join(per, "insight_id", "left").select(
        "insight_id", F.coalesce("numbers", F.lit(0)).alias("numbers"), F.coalesce("grounded", F.lit(0)).alias("grounded"),
        F.coalesce("ungrounded", F.array().cast("array<string>")).alias("ungrounded"),
    )


def query_reproduction(ai: DataFrame, logged: DataFrame) -> DataFrame:
    """Distinct cited queries, and how many gave the logged result again. ``logged``: query_id, result_hash,
    rerun_hash (null when the rerun failed)."""
    cited = ai.select(F.explode("query_ids").alias("query_id")).distinct()
    j = cited.join(logged, "query_id", "left")
    return j.agg(F.count("*").alias("queries_cited"), F.count_if(F.col("rerun_hash") == F.col("result_hash")).alias("queries_reproduced"))


def grounding_rates(per_insight: DataFrame) -> DataFrame:
    return per_insight.agg(
        F.coalesce(F.sum("numbers"), F.lit(0)).alias("numbers"), F.coalesce(F.sum("grounded"), F.lit(0)).alias("grounded"), F.count("*").alias("n"),
        F.count_if(F.col("numbers") == F.col("grounded")).alias("whole"),
    ).select(
        "numbers", fixed(share(F.col("grounded"), F.nullif("numbers", F.lit(0))), 3).alias("numbers_grounded"),
        fixed(share(F.col("whole"), F.nullif("n", F.lit(0))), 3).alias("insights_fully_grounded"),
    )


def score_run(ai: DataFrame, calc: DataFrame, results: DataFrame, logged: DataFrame, taxa: DataFrame, guided: bool) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One summary row, and the detail tables behind it. Both insight sets are read several times: pass written tables."""
    repro, found, per = reproduction(ai, calc), discovered(ai, calc, taxa), grounding(ai, results)
    overall = recall(found).filter(F.col("set") == "overall").select("recall_by_key", "recall_by_mention")
    summary = (
        ai.agg(F.count("*").alias("ai_insights"))
        .crossJoin(reproduction_totals(repro))  # all sides hold one row
        .crossJoin(overall)
        .crossJoin(unflagged_taxa_insights(ai, calc))
        .crossJoin(query_reproduction(ai, logged))
        .crossJoin(grounding_rates(per))
    )
    if not guided:
        summary = summary.withColumns({c: F.lit(None).cast("double") for c in ("matched", "unmatched", "agreed", "checked", "figure_agreement")})
    return summary, {"reproduction": repro, "headlines": headline_checks(ai, calc), "discovery": found, "grounding": per}


# --- acceptance of AI insights ---

DAY = r"^\d{4}-\d{2}-\d{2}$"


def record_issues(open_brief: bool) -> Column:
    """Problems of a submitted insight: columns insight_type, category, period_start, period_end, summary (text),
    figures, confidence (variants)."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    bad_day = lambda c: ~F.coalesce(F.col(c).rlike(DAY) & F.try_to_date(F.col(c)).isNotNull(), F.lit(False))
    no_object = lambda c: ~F.coalesce(F.schema_of_variant(F.col(c)).startswith("OBJECT"), F.lit(False))
    checks = [
        (F.lit(not open_brief) & ~F.coalesce(F.col("insight_type").isin(TYPES), F.lit(False)), "insight_type"),
        (F.lit(open_brief) & blank("category"), "category"),
        (bad_day("period_start") | bad_day("period_end"), "period"),
        (blank("summary"), "summary"),
        (no_object("figures"), "figures"),
        (F.col("confidence").isNotNull() & no_object("confidence"), "confidence"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))


def reference_issues(ai: DataFrame, taxa: DataFrame, regions: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (insight_id, issue, value) for references that lead nowhere: unknown taxa and regions, no cited
    query, queries of another run, failed queries."""
    known = taxa.select("taxon_concept_id")
    row = lambda df, issue, value: df.select("insight_id", F.lit(issue).alias("issue"), value.cast("string").alias("value"))
    own = ai.filter(F.col("taxon_concept_id").isNotNull()).join(known, "taxon_concept_id", "left_anti")
    rel = ai.select("insight_id", F.explode("related_taxa").alias("taxon_concept_id")).join(known, "taxon_concept_id", "left_anti")
    reg = ai.filter(F.col("region").isNotNull()).join(regions.select("region").distinct(), "region", "left_anti")
    cites = ai.select("insight_id", "run_id", F.explode("query_ids").alias("query_id"))
    mine = queries.select("run_id", "query_id", "error")
    foreign = cites.join(mine, ["run_id", "query_id"], "left_anti")
    failed = cites.join(mine.filter(F.col("error").isNotNull()), ["run_id", "query_id"], "left_semi")
    parts = [
        row(own, "unknown_taxon", F.col("taxon_concept_id")), row(rel, "unknown_related_taxon", F.col("taxon_concept_id")),
        row(reg, "unknown_region", F.col("region")), row(ai.filter(F.size("query_ids") == 0), "no_query", F.lit(None)),
        row(foreign, "foreign_query", F.col("query_id")), row(failed, "failed_query", F.col("query_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
