"""Checks of curation, effort and the five insights."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from taxatrend.checks import sql as S
from taxatrend.checks.registry import query
from taxatrend.corpus import PARAMS as P
from taxatrend.corpus import SMALL, Corpus
from taxatrend.functions import geo, groups, stats, timefn
from taxatrend.functions.numeric import fixed, sig3
from taxatrend.functions.text import display_name
from taxatrend.operators import co_movement as cm
from taxatrend.operators import curation as cu
from taxatrend.operators import notable as nt
from taxatrend.operators import range_change as rc
from taxatrend.operators import reporting_rate as rr
from taxatrend.operators import silent as si
from taxatrend.operators.hull import extent_km2
from taxatrend.operators.insight import flatten
from taxatrend.sources import store as st
from taxatrend.workspace import write

DATES = ["period_start", "period_end"]


def dates(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in (cols or DATES)})


def dates_sql(*cols: str) -> str:
    return "* replace (" + ", ".join(f"cast({c} as varchar) as {c}" for c in (cols or DATES)) + ")"


def joined(c: str):
    return F.array_join(c, ",").alias(c)


def map_text(c: str):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)


# --- national silence, and its parts ---


@query("i1_silent_national", S.using(f"select {dates_sql()} from silent_nat", S.silent()))
def _(c: Corpus):
    df = flatten(si.national(c.records, c.taxa, c.p), "figures", "confidence")
    return dates(df).drop("confidence_records_since_2015").withColumnsRenamed(
        {f"confidence_{x}": x for x in ("datasets", "share_imprecise", "share_managed")}
    )


@query("i1_silent_regional", S.using(f"select {dates_sql()}, 'regional_silence' as kind from silent_reg", S.silent()))
def _(c: Corpus):
    df = flatten(si.regional(c.records, c.taxa, c.p), "figures", "confidence")
    return dates(df).drop("confidence_baseline_records").withColumnRenamed("confidence_datasets", "datasets")


@query(
    "j2_taxa_left_join_dated_records",
    S.using("select taxon_concept_id, records_since_2015, cast(last_day as varchar) as last_record_date from silent_counts", S.silent()),
)
def _(c: Corpus):
    return si.national_counts(c.records, c.taxa, c.p).select(
        "taxon_concept_id", "records_since_2015", F.col("last_record_date").cast("string").alias("last_record_date")
    )


@query(
    "a1_a5_filtered_counts_shares",
    S.using(
        f"""select taxon_concept_id, records_in_window, {S.fx('mean_raw', 2)} as baseline_annual_mean, datasets,
            {S.fx('imprecise', 3)} as share_imprecise, {S.fx('managed', 3)} as share_managed from silent_counts""",
        S.silent(),
    ),
)
def _(c: Corpus):
    return si.national_counts(c.records, c.taxa, c.p).select(
        "taxon_concept_id", "records_in_window", fixed(F.col("baseline_annual_mean"), 2).alias("baseline_annual_mean"),
        "datasets", fixed(F.col("share_imprecise"), 3).alias("share_imprecise"), fixed(F.col("share_managed"), 3).alias("share_managed"),
    )


# --- curation ---


@query("s9_occurrence_scan", S.using("select record_id, taxon_concept_id, lat as decimal_latitude, lon as decimal_longitude, cast(event_day as varchar) as event_day, is_valid from occ"))
def _(c: Corpus):
    return c.occurrences.select(
        "record_id", "taxon_concept_id", "decimal_latitude", "decimal_longitude", F.col("event_day").cast("string").alias("event_day"), "is_valid"
    )


@query("p18_j1_analysable_population", S.using("select dataset_kind, population, count(*) as records, count(distinct taxon_concept_id) as taxa from rec group by all"))
def _(c: Corpus):
    return c.records.groupBy("dataset_kind", "population").agg(F.count("*").alias("records"), F.count_distinct("taxon_concept_id").alias("taxa"))


@query("j3_taxon_tiers", S.using(f"select {dates_sql('last_record_day')} from tiers", S.tiers()))
def _(c: Corpus):
    return dates(c.tiers, "last_record_day")


@query(
    "j4_statistical_tier_semi_join",
    S.using("select taxon_concept_id, count(*) as n from rec where taxon_concept_id in (select taxon_concept_id from tiers where statistical_tier) group by all", S.tiers()),
)
def _(c: Corpus):
    return c.records.join(cu.statistical_taxa(c.tiers), "taxon_concept_id", "left_semi").groupBy("taxon_concept_id").agg(F.count("*").alias("n"))


@query(
    "j5_nationally_recent_semi_join",
    S.using(f"select ibra_region, count(*) as n from rec where taxon_concept_id in (select taxon_concept_id from rec where {S.between('event_day', P.silence)}) group by all"),
)
def _(c: Corpus):
    alive = c.records.filter(timefn.in_window(F.col("event_day"), c.p.silence)).select("taxon_concept_id").distinct()
    return c.records.join(alive, "taxon_concept_id", "left_semi").groupBy("ibra_region").agg(F.count("*").alias("n"))


RULE_HIT = """exists (select 1 from rules m where m.taxon_concept_id = o.taxon_concept_id and m.state_province = o.state_province
  and (m.ibra_region is null or m.ibra_region = o.ibra_region) and (m.data_resource_uid is null or m.data_resource_uid = o.data_resource_uid))"""


@query("j8_managed_rule_match", S.using(f"select record_id, {RULE_HIT} as managed_by_rule from occ o"))
def _(c: Corpus):
    return cu.managed_flag(c.occurrences, c.rules).select("record_id", "managed_by_rule")


@query("k7_managed_flag_changes", S.using(f"select record_id, {RULE_HIT} as managed_by_rule, l_linenumber = 2 as was_managed from occ o where {RULE_HIT} <> (l_linenumber = 2)"))
def _(c: Corpus):
    flagged = c.occurrences.withColumn("managed_by_rule", F.col("source_record_id").endswith(":2"))
    return cu.managed_changes(flagged, c.rules).select("record_id", "managed_by_rule", "was_managed")


@query("k7_managed_flags_written", S.using(f"select count(*) filter ({RULE_HIT} <> (l_linenumber = 2)) as changed, 0 as changed_again, count(*) filter ({RULE_HIT}) as managed, count(*) as records from occ o"))
def _(c: Corpus):
    path, scratch = (c.ws.path(f"flags-{uuid.uuid4().hex}/{x}") for x in ("table", "scratch"))
    write(c.occurrences.withColumn("managed_by_rule", F.col("source_record_id").endswith(":2")), path, partition_by="event_year")
    first = st.write_managed_flags(c.spark, path, c.rules, scratch)
    again = st.write_managed_flags(c.spark, path, c.rules, scratch)
    return c.spark.read.parquet(path).agg(
        F.lit(first).alias("changed"), F.lit(again).alias("changed_again"), F.count_if("managed_by_rule").alias("managed"), F.count("*").alias("records")
    )


@query("p24_not_telemetry_null_safe", S.using("select count(*) as n, count(data_resource_uid) as with_dataset from (select case when l_linenumber = 5 then null else data_resource_uid end as data_resource_uid from occ) where coalesce(data_resource_uid <> 'd0', true)"))
def _(c: Corpus):
    anon = c.occurrences.withColumn("data_resource_uid", F.when(~F.col("source_record_id").endswith(":5"), F.col("data_resource_uid")))
    return cu.not_telemetry(anon, c.datasets).agg(F.count("*").alias("n"), F.count("data_resource_uid").alias("with_dataset"))


@query("p15_p17_grid_cells_points", S.using("select record_id, cast(cell_lat as double) as cell_lat, cast(cell_lon as double) as cell_lon, lat is not null and lon is not null as has_point from occ"))
def _(c: Corpus):
    return c.occurrences.select("record_id", F.col("cell_lat").cast("double").alias("cell_lat"), F.col("cell_lon").cast("double").alias("cell_lon"), cu.has_point().alias("has_point"))


@query("p16_local_day", "select event_id, cast(cast(ts + interval 11 hour as date) as varchar) as event_day from events")
def _(c: Corpus):
    e = c.spark.read.parquet(f"{c.sf_dir}/events.parquet")
    return e.select("event_id", timefn.local_day(F.col("ts").cast("timestamp")).cast("string").alias("event_day"))


@query("p19_window_label", S.using(f"select case when {S.between('event_day', P.baseline_window)} then 'baseline' when {S.between('event_day', P.recent_window)} then 'recent' end as win, count(*) as n from rec group by all"))
def _(c: Corpus):
    return c.records.groupBy(timefn.window_label(F.col("event_day"), c.p.baseline_window, c.p.recent_window).alias("win")).agg(F.count("*").alias("n"))


@query(
    "p20_p21_wild_switch_precision",
    S.using(
        """select o.flag as wild_only, count(*) filter (coalesce(unc <= 2000, false)) as precise, count(*) filter (unc is null or unc > 2000) as imprecise
           from rec, (values (true), (false)) o(flag) where not o.flag or population = 'wild' group by all"""
    ),
)
def _(c: Corpus):
    out = None
    for wild_only in (True, False):
        r = c.records.filter(F.col("population") == "wild") if wild_only else c.records
        one = r.agg(F.count_if(F.coalesce(F.col("coordinate_uncertainty_m") <= 2000, F.lit(False))).alias("precise"), F.count_if(si.imprecise()).alias("imprecise"))
        one = one.withColumn("wild_only", F.lit(wild_only))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "p22_p23_p28_taxon_groups_names",
    S.using(
        f"""select taxon_concept_id, case when kingdom = 'Plantae' then 'Plantae' when taxon_class in ('Aves', 'Mammalia', 'Reptilia', 'Amphibia') then taxon_class else 'all' end as effort_group,
            case when kingdom = 'Plantae' then 'plants' when taxon_class = 'Aves' then 'birds' when taxon_class = 'Mammalia' then 'mammals' when taxon_class = 'Reptilia' then 'reptiles'
                 when taxon_class = 'Amphibia' then 'amphibians' else 'other' end as display_group, {S.NAME} as name from taxa"""
    ),
)
def _(c: Corpus):
    return c.taxa.select(
        "taxon_concept_id", groups.effort_group(F.col("kingdom"), F.col("taxon_class")).alias("effort_group"),
        groups.display_group(F.col("kingdom"), F.col("taxon_class")).alias("display_group"),
        display_name(F.col("vernacular_name"), F.col("scientific_name")).alias("name"),
    )


PUBLIC = ["record_id", "source", "source_record_id", "harvest_id", "data_resource_uid", "taxon_concept_id", "scientific_name", "event_date", "coordinate_uncertainty_m", "state_province",
          "ibra_region", "is_valid", "managed_by_rule", "decimal_latitude", "decimal_longitude", "cell_lat", "cell_lon", "event_day", "event_year"]


@query("p30_s10_public_view_catalogue", S.using(f"select unnest({PUBLIC}) as column_name, (select count(*) from occ) as records"))
def _(c: Corpus):
    t = cu.public_view(c.occurrences)
    names = F.array(*[F.lit(f.name) for f in t.schema])
    return t.agg(F.count("*").alias("records")).select(F.explode(names).alias("column_name"), "records")


@query("w5_first_per_key", S.using("select taxon_concept_id, min(record_id) as first_record, arg_min(ibra_region, record_id) as first_region from rec group by taxon_concept_id"))
def _(c: Corpus):
    first = F.min_by(F.struct("record_id", "ibra_region"), "record_id")
    return c.records.groupBy("taxon_concept_id").agg(first.alias("f")).select("taxon_concept_id", F.col("f.record_id").alias("first_record"), F.col("f.ibra_region").alias("first_region"))


# --- effort ---


@query("a39_effort_build", S.using(f"select {dates_sql()} replace (cast(cell_lat as double) as cell_lat, cast(cell_lon as double) as cell_lon) from (select * from effort)".replace(") replace (", ", ")))
def _(c: Corpus):
    return dates(c.effort).drop("harvest_id").withColumns({x: F.col(x).cast("double") for x in ("cell_lat", "cell_lon")})


@query("a9_effort_ratio", S.using(f"select {S.fx('ratio', 3)} as effort_ratio from re", S.tiers(), S.range_change()))
def _(c: Corpus):
    return rc.effort_ratio(c.effort, c.p).select(fixed(F.col("effort_ratio"), 3).alias("effort_ratio"))


# --- reporting rate ---


def rate_flat(df):
    f, k = (lambda x: F.col(f"figures.{x}")), (lambda x: F.col(f"confidence.{x}"))
    pairs = {"records": ("nb", "nr"), "consistent_source_records": ("nbc", "nrc"), "footprint_effort_records": ("eb", "er"),
             "reporting_rate_per_10k": ("per10k_b", "per10k_r"), "detections": ("db", "dr"), "visits": ("vb", "vr")}
    cols = [f(f"{name}.{side}").alias(a) for name, ab in pairs.items() for side, a in zip(("baseline", "recent"), ab)]
    arrays = {"consistent_source_ratio_ci95": ("ci_low", "ci_high"), "detection_ratio_ci95": ("d_low", "d_high")}
    cols += [F.get(f(name), i).alias(a) for name, ab in arrays.items() for i, a in enumerate(ab)]
    return dates(df).select(
        "insight_type", "taxon_concept_id", "region", *DATES, "summary", *cols,
        *[f(x).alias(x) for x in ("flag", "national_status", "effort_group", "ratio", "consistent_source_ratio", "footprint_cells", "detection_ratio")],
        k("enough_detections").alias("enough_detections"), k("datasets").alias("datasets"), k("consistent_datasets").alias("consistent_datasets"),
        k("baseline_share_from_sources_no_longer_recording").alias("share_stopped"), k("footprint_effort_ratio").alias("footprint_effort_ratio"),
    )


def rates(c: Corpus, regional: bool, p=None):
    return rr.reporting_rate(c.visits, c.taxa, c.effort, p or c.p, regional)


for _scope, _reg in (("national", False), ("regional", True)):
    query(f"i3_reporting_rate_{_scope}", S.using(f"select {dates_sql()} from (select * exclude (name, detection) from rate_{'reg' if _reg else 'nat'})", S.tiers(), S.rate(P, _reg)))(
        lambda c, _reg=_reg: rate_flat(rates(c, _reg))
    )

query("u1_rate_union_scopes", S.using("select region, count(*) as n, count(flag) as flagged from (select * from rate_nat union all select * from rate_reg) group by all", S.tiers(), S.rate(P, False), S.rate(P, True)))(
    lambda c: rates(c, False).unionByName(rates(c, True)).groupBy("region").agg(F.count("*").alias("n"), F.count("figures.flag").alias("flagged"))
)

query("j7_consistent_sources", S.using("select taxon_concept_id, region, count(*) as consistent from both_reg group by all", S.tiers(), S.rate(P, True)))(
    lambda c: rr.consistent_sources(rr.source_windows(rr.in_scope(c.visits, True))).groupBy("taxon_concept_id", "region").agg(F.count("*").alias("consistent"))
)

query("j14_j15_a7_footprint_effort", S.using("select taxon_concept_id, region, eb, er, vb, vr, nb, nr, cells, db, dr from counts_reg join foot_reg using (taxon_concept_id, region) where nb >= 20 and nr >= 20", S.tiers(), S.rate(P, True)))(
    lambda c: rr.counts(c.visits, c.taxa, c.effort, c.p, True).select("taxon_concept_id", "region", "eb", "er", "vb", "vr", "nb", "nr", "cells", "db", "dr")
)

query("a2_a3_composite_distinct", S.using("select taxon_concept_id, count(distinct data_resource_uid) as datasets, count(distinct (cell_lat, cell_lon)) as cells, count(distinct (cell_lat, cell_lon, date_trunc('month', event_day))) as cell_months from rec group by all"))(
    lambda c: c.records.groupBy("taxon_concept_id", "cell_lat", "cell_lon", F.trunc("event_day", "month").alias("mo"), "data_resource_uid").agg(F.lit(1).alias("one"))
    .groupBy("taxon_concept_id").agg(
        F.count_distinct("data_resource_uid").alias("datasets"), F.count_distinct(F.struct("cell_lat", "cell_lon")).alias("cells"),
        F.count_distinct(F.struct("cell_lat", "cell_lon", "mo")).alias("cell_months"),
    )
)

query("a6_having_on_aggregates", S.using("select taxon_concept_id, ibra_region, count(*) as n from rec group by all having count(*) >= 50 and max(event_day) < date '2001-10-01'"))(
    lambda c: c.records.groupBy("taxon_concept_id", "ibra_region").agg(F.count("*").alias("n"), F.max("event_day").alias("last"))
    .filter((F.col("n") >= 50) & (F.col("last") < F.lit("2001-10-01").cast("date"))).drop("last")
)

query("a38_distinct_keys", S.using("select distinct taxon_concept_id, data_resource_uid, ibra_region from rec"))(
    lambda c: c.records.select("taxon_concept_id", "data_resource_uid", "ibra_region").distinct()
)


# --- co-movement ---


def co_flat(df):
    return dates(df).select(
        "insight_type", "taxon_concept_id", joined("related_taxa"), "region", *DATES, "summary",
        *[F.col(f"figures.{x}").alias(x) for x in ("flag", "taxa_assessed", "declines", "increases", "expected_decline_share", "expected_increase_share", "p_decline", "p_increase", "q_decline", "q_increase")],
        map_text("figures.declining_groups").alias("declining_groups"), map_text("figures.increasing_groups").alias("increasing_groups"),
        joined("figures.declining_taxa").alias("declining_taxa"), joined("figures.increasing_taxa").alias("increasing_taxa"),
        F.col("confidence.taxon_region_pairs_assessed_nationally").alias("pairs_assessed"),
    )


query("i4_co_movement", S.using(f"select {dates_sql()} from co", S.tiers(), S.rate(P, True), S.co_movement(P)))(
    lambda c: co_flat(cm.co_movement(c.regional_rates, c.taxa, c.p))
)
query("i4_co_movement_low_minima", S.using(f"select {dates_sql()} from co", S.tiers(), S.rate(SMALL, True), S.co_movement(SMALL)))(
    lambda c: co_flat(cm.co_movement(rates(c, True, SMALL), c.taxa, SMALL))
)

BH_IN = "select ibra_region as way, taxon_concept_id, count(*) / sum(count(*)) over (partition by ibra_region) * 60 as p from rec group by ibra_region, taxon_concept_id"


@query("w2_bh_adjust", S.using(f"select way, taxon_concept_id, round((select min(least(1.0, y.p * y.m / y.rk)) from r y where y.way = x.way and y.rk >= x.rk), 9) as q from r x", f"b as ({BH_IN})", "r as (select *, count(*) over (partition by way) as m, row_number() over (partition by way order by p, taxon_concept_id) as rk from b)"))
def _(c: Corpus):
    from pyspark.sql import Window

    n = c.records.groupBy(F.col("ibra_region").alias("way"), "taxon_concept_id").agg(F.count("*").alias("n"))
    ps = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("way")) * 60)
    return cm.bh_adjust(ps, "p", "way").select("way", "taxon_concept_id", F.round("q", 9).alias("q"))


@query(
    "f_binomial_upper_tail",
    S.using(
        f"""select ibra_region, taxon_concept_id, {S.sig3('''least(1.0, (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.12) + (n - i) * ln(0.88)))
            from (select unnest(range(greatest(k, 1), n + 1)) as i)))''')} as p from (select ibra_region, taxon_concept_id, count(*) as n, count(*) filter (population = 'managed') as k from rec group by all) where k > 0
            union all select ibra_region, taxon_concept_id, 1.0 from rec group by all having count(*) filter (population = 'managed') = 0"""
    ),
)
def _(c: Corpus):
    n = c.records.groupBy("ibra_region", "taxon_concept_id").agg(F.count("*").alias("n"), F.count_if(F.col("population") == "managed").alias("k"))
    return n.select("ibra_region", "taxon_concept_id", sig3(stats.binomial_upper_tail(F.col("k"), F.col("n"), F.lit(0.12))).alias("p"))


# --- range change ---


def range_flat(df):
    f, k = (lambda x: F.col(f"figures.{x}")), (lambda x: F.col(f"confidence.{x}"))
    return dates(df).select(
        "insight_type", "taxon_concept_id", "region", *DATES, f("flag").alias("flag"), f("national_status").alias("national_status"),
        *[f(f"aoo_{g}km_km2.{s}").alias(f"aoo_{g}km_{a}") for g in ("10", "2") for s, a in (("baseline", "b"), ("recent", "r"), ("change", "change"))],
        f("aoo_2km_km2.reliable").alias("aoo_2km_reliable"), f("records.baseline").alias("records_b"), f("records.recent").alias("records_r"),
        k("enough_records").alias("enough_records"), k("precise_share.baseline").alias("precise_b"), k("precise_share.recent").alias("precise_r"),
        k("national_effort_ratio").alias("effort_ratio"), k("baseline_share_from_sources_no_longer_recording").alias("share_stopped"),
        k("datasets").alias("datasets"), k("share_managed").alias("share_managed"),
    )


def ranges(c: Corpus, extent: bool):
    return rc.range_change(c.records, c.taxa, c.tiers, c.effort, c.p, extent)


query("i2_range_change_aoo", S.using(f"select {dates_sql()} from rc", S.tiers(), S.range_change()))(lambda c: range_flat(ranges(c, False)))


@query("i2_range_change_full", S.using("select * from rc_text", S.tiers(), S.range_change(), S.range_extent()))
def _(c: Corpus):
    df = ranges(c, True)
    f = lambda x: F.col(f"figures.{x}")
    return df.select("taxon_concept_id", f("flag").alias("flag"), f("eoo_km2.baseline").alias("eoo_b"), f("eoo_km2.recent").alias("eoo_r"), f("eoo_km2.change").alias("eoo_change"), "summary")


query("a8_extent_of_occurrence", S.using("select key as taxon_concept_id, round(eoo_km2, 3) as eoo_km2 from eoo", S.hull_area("eoo", "select taxon_concept_id as key, lon, lat from rec")))(
    lambda c: extent_km2(c.records.filter(cu.has_point()).select("taxon_concept_id", F.col("decimal_longitude").alias("lon"), F.col("decimal_latitude").alias("lat")), ["taxon_concept_id"])
    .withColumn("eoo_km2", F.round("eoo_km2", 3))
)

query("j6_discontinued_sources", S.using("select taxon_concept_id, win, count(*) as records, count(*) filter (a.u is null) as from_discontinued from rw left join (select distinct taxon_concept_id as t, data_resource_uid as u from rw where win = 'r') a on a.t = rw.taxon_concept_id and a.u = rw.data_resource_uid group by all", S.tiers(), S.range_change()))(
    lambda c: rc.discontinued(rc.windowed(c.records, c.tiers, c.p)).groupBy("taxon_concept_id", F.substring("win", 1, 1).alias("win"))
    .agg(F.sum("n").alias("records"), F.sum(F.when(F.col("from_discontinued"), F.col("n")).otherwise(0)).alias("from_discontinued"))
)

_ax, _ay = S.albers_sql()


@query("f_albers_grid", S.using(f"select record_id, round({_ax}, 2) as x, round({_ay}, 2) as y, cast(floor({_ax} / 2000) as bigint) as gx, cast(floor({_ay} / 2000) as bigint) as gy from occ"))
def _(c: Corpus):
    x, y = geo.albers(F.col("decimal_longitude"), F.col("decimal_latitude"))
    g = geo.grid_square(F.col("decimal_longitude"), F.col("decimal_latitude"), 2000)
    return c.occurrences.select("record_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), g["gx"].alias("gx"), g["gy"].alias("gy"))


@query("p11_public_coordinates", S.using("select record_id, floor(lat * 100 + 0.5) / 100 as latitude, floor(lon * 100 + 0.5) / 100 as longitude, true as fuzzed, 1113 as approx_metres from occ"))
def _(c: Corpus):
    return c.occurrences.select("record_id", geo.public_coordinates(F.col("decimal_latitude"), F.col("decimal_longitude")).alias("p")).select("record_id", "p.*")


# --- notable records ---

NOTABLE = (S.tiers(), S.notable())

query("i5_notable_records", S.using(f"select {dates_sql()} from nt", *NOTABLE))(
    lambda c: dates(nt.notable_records(c.occurrences, c.records, c.datasets, c.taxa, c.tiers, c.p)).select(
        "insight_type", "taxon_concept_id", "region", *DATES, "summary", joined("figures.reasons").alias("reasons"), joined("figures.record_ids").alias("record_ids"),
        *[F.col(f"figures.{x}").alias(x) for x in ("national_status", "records", "max_distance_to_prior_km", "state_province", "managed_records")],
        *[F.col(f"confidence.{x}").alias(x) for x in ("share_imprecise", "managed", "baseline_records")],
    )
)


@query("j9_nearest_prior", S.using("select distinct taxon_concept_id, lon, lat, round(km, 6) as nearest_km from cur join near using (record_id)", *NOTABLE))
def _(c: Corpus):
    cur = nt.current(c.records, c.tiers, c.p)
    return nt.nearest_prior(cur, c.occurrences, c.datasets, p=c.p).withColumn("nearest_km", F.round("nearest_km", 6))


@query("j9_nearest_prior_deep_levels", S.using("select distinct taxon_concept_id, lon, lat, round(km, 6) as nearest_km from cur join near using (record_id)", *NOTABLE))
def _(c: Corpus):
    cur = nt.current(c.records, c.tiers, c.p)
    return nt.nearest_prior(cur, c.occurrences, c.datasets, p=c.p, leaf_points=3).withColumn("nearest_km", F.round("nearest_km", 6))


query("j10_region_seen", S.using("select taxon_concept_id, ibra_region from seen", *NOTABLE))(lambda c: nt.region_seen(c.occurrences, c.p).drop("seen"))

query("w1_a10_season_profile", S.using("select taxon_concept_id, m, n, cast(total as bigint) as total, round(n / total, 9) as month_share from season", *NOTABLE))(
    lambda c: nt.season(c.records, nt.current(c.records, c.tiers, c.p), c.p).withColumn("month_share", F.round("month_share", 9))
)


@query("j11_j12_j13_record_checks", S.using("select record_id, round(km, 6) as nearest_km, region_seen, round(month_share, 9) as month_share, baseline_records, outside_range, new_region, out_of_season from why", *NOTABLE))
def _(c: Corpus):
    return nt.checked(c.occurrences, c.records, c.datasets, c.tiers, c.p).select(
        "record_id", F.round("nearest_km", 6).alias("nearest_km"), "region_seen", F.round("month_share", 9).alias("month_share"), "baseline_records", "outside_range", "new_region", "out_of_season"
    )


query("a11_notable_groups", S.using("select taxon_concept_id, place, records, outside_range, new_region, out_of_season, managed_records as managed, imprecise, record_ids from ng", *NOTABLE))(
    lambda c: nt.groups(nt.checked(c.occurrences, c.records, c.datasets, c.tiers, c.p).filter("new_region or out_of_season or outside_range")).select(
        "taxon_concept_id", "place", "records", "outside_range", "new_region", "out_of_season", "managed", "imprecise", joined("record_ids")
    )
)

query("a11_finding_members", S.using("select taxon_concept_id, coalesce(ibra_region, state_province, '') as place, record_id from why where outside_range or new_region or out_of_season", *NOTABLE))(
    lambda c: nt.members(nt.checked(c.occurrences, c.records, c.datasets, c.tiers, c.p).filter("new_region or out_of_season or outside_range"))
)


P29 = """select summary from silent_nat union all select summary from silent_reg union all select summary from rate_reg union all select summary from co union all select summary from nt union all select summary from rc_text"""


@query("p29_summary_sentences", S.using(P29, S.tiers(), S.silent(), S.rate(P, True), S.co_movement(P), S.notable(), S.range_change(), S.range_extent()))
def _(c: Corpus):
    reg = c.regional_rates
    parts = [
        si.national(c.records, c.taxa, c.p), si.regional(c.records, c.taxa, c.p), reg, cm.co_movement(reg, c.taxa, c.p),
        nt.notable_records(c.occurrences, c.records, c.datasets, c.taxa, c.tiers, c.p), ranges(c, True),
    ]
    out = parts[0].select("summary")
    for d in parts[1:]:
        out = out.unionByName(d.select("summary"))
    return out
