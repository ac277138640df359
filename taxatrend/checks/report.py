"""Checks of the report queries. Runs, comparisons, logged queries and AI insights are read out of the
benchmark tables: a customer is a run, an order a comparison, an event a logged query and an AI insight."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxatrend.checks import sql as S
from taxatrend.checks.insights import dates
from taxatrend.checks.registry import query
from taxatrend.corpus import PARAMS as P
from taxatrend.corpus import Corpus, read
from taxatrend.functions.numeric import fixed
from taxatrend.operators import report as rp
from taxatrend.operators.insight import fig, fig_number, label, unpack
from taxatrend.sources import store as st

CALC = """
calc as (
  select 'calc-1|' || insight_type || '|' || coalesce(taxon_concept_id, '') || '|' || coalesce(region, '') || '|' ||
         case insight_type when 'notable_record' then coalesce(state_province, '') else '' end as insight_id, *,
         coalesce(kind, flag, 'none') as label
  from (
    select *, 'silent_species' as t from silent_nat
    union all by name select *, 'regional_silence' as kind from silent_reg
    union all by name select * exclude (enough_records) from rc
    union all by name select * exclude (name, detection) from rate_nat
    union all by name select * exclude (name, detection) from rate_reg
    union all by name select * from co
    union all by name select * exclude (baseline_records) from nt)
)"""
ALL = (S.tiers(), S.silent(), S.range_change(), S.rate(P, False), S.rate(P, True), S.co_movement(P), S.notable(), CALC)


def using(select: str, *more: str) -> str:
    return S.using(select, *ALL, *more)


def ins(c: Corpus):
    return unpack(c.insights)


def shown(c: Corpus):
    return rp.with_taxa(ins(c), c.taxa)


@query("k6_insight_table", using("select insight_type, region is null as national, count(*) as n, count(distinct insight_id) as ids from calc group by all"))
def _(c: Corpus):
    path = c.ws.path("insight_log")
    if "insight_log" not in c.ws.marks:
        for _ in range(2):  # a repeated write doubles nothing
            st.append_insights(c.insights, path)
        c.ws.marks.add("insight_log")
    t = c.spark.read.parquet(path)
    return t.groupBy("insight_type", F.col("region").isNull().alias("national")).agg(F.count("*").alias("n"), F.count_distinct("insight_id").alias("ids"))


@query("a25_p25_insight_counts", using("select insight_type, region is null as national, label, count(*) as n from calc group by all"))
def _(c: Corpus):
    return rp.insight_counts(ins(c))


@query("a26_j16_region_rollup", using("""select region, count(*) as insights, count(*) filter (kind = 'regional_silence') as silences, count(*) filter (insight_type = 'notable_record') as notable,
  count(*) filter (insight_type = 'reporting_rate' and flag is not null) as rate_flags, max(taxa_assessed) as taxa_assessed, max(declines) as declines, max(increases) as increases,
  max(p_decline) as p_decline, max(p_increase) as p_increase, max(flag) filter (insight_type = 'co_movement') as co_flag from calc where region is not null group by region"""))
def _(c: Corpus):
    return rp.region_rollup(ins(c))


query("a37_region_balance", using(f"select region, {S.fx('(increases - declines) / taxa_assessed', 6)} as balance from calc where insight_type = 'co_movement' and taxa_assessed >= 5"))(
    lambda c: rp.region_balance(rp.region_rollup(ins(c))).withColumn("balance", fixed(F.col("balance"), 6))
)

query("o7_region_table_order", using("select region, row_number() over (order by coalesce(declines, -1) desc, region) as pos from (select region, max(declines) as declines from calc where region is not null group by region)"))(
    lambda c: rp.region_table(rp.region_rollup(ins(c)), "declines").select("region", F.row_number().over(_pos("declines")).alias("pos"))
)


def _pos(measure: str):
    from pyspark.sql import Window

    return Window.orderBy(F.coalesce(F.col(measure), F.lit(-1)).desc(), "region")


query("j19_p26_filtered_insights", using("""select insight_id, vernacular_name from calc left join (select taxon_concept_id, vernacular_name, scientific_name as sn, kingdom, taxon_class from taxa) t using (taxon_concept_id)
  where region is not null and label <> 'none' and taxon_class = 'Aves' and kingdom <> 'Plantae' and (vernacular_name ilike '%name-1%' or sn ilike '%name-1%' or region ilike '%name-1%')"""))(
    lambda c: rp.find(shown(c), region="regional", flagged=True, group="birds", q="NAME-1").select("insight_id", "vernacular_name")
)

query("p26_taxon_or_related", using("select insight_id, insight_type from calc where taxon_concept_id = 'T15' or list_contains(string_split(coalesce(related_taxa, ''), ','), 'T15')"))(
    lambda c: rp.find(shown(c), taxon="T15").select("insight_id", "insight_type")
)

SORT_SQL = {
    "default": "insight_id", "baseline_annual_mean": "baseline_annual_mean desc nulls last", "baseline_records": "baseline_records desc nulls last",
    "records_since_2015": "records_since_2015 asc nulls last", "aoo_change": "aoo_10km_change asc nulls last",
    "aoo_change_reliable": "coalesce(share_stopped, 0) >= 0.5, aoo_10km_change asc nulls last", "aoo_change_desc": "aoo_10km_change desc nulls last",
    "detection_ratio": "detection_ratio asc nulls last", "detection_ratio_desc": "detection_ratio desc nulls last", "p_decline": "p_decline asc nulls last",
    "p_increase": "p_increase asc nulls last", "distance": "max_distance_to_prior_km desc nulls last",
}


def _page_sql(key: str) -> str:
    return f"(select '{key}' as sort, insight_id from calc order by {SORT_SQL[key]}, insight_id limit 12 offset 3)"


@query("o1_o2_sorted_pages", using(" union all ".join(f"select * from {_page_sql(k)}" for k in SORT_SQL)))
def _(c: Corpus):
    out = None
    for key in SORT_SQL:
        rows, _ = rp.page(shown(c), key, limit=12, offset=3)
        one = rows.select(F.lit(key).alias("sort"), "insight_id")
        out = one if out is None else out.unionByName(one)
    return out


query("o2_page_total", using("select count(*) as total from calc where insight_type = 'silent_species'"))(lambda c: rp.page(rp.find(shown(c), type="silent_species"))[1])


@query("o3_result_cap", "select true as truncated, 200 as row_count, count(*) > 200 as really from orders")
def _(c: Corpus):
    o = read(c.spark, c.sf_dir, "orders")
    return rp.capped(o, 200, "o_orderkey")[1].crossJoin(o.agg((F.count("*") > 200).alias("really")))


LISTS = {
    "silent": ("insight_type = 'silent_species' and label = 'silent'", "baseline_annual_mean", 5),
    "contraction": ("insight_type = 'range_change' and label = 'contraction' and region is null", "aoo_change_reliable", 5),
    "decline": ("insight_type = 'reporting_rate' and label = 'decline' and region is null", "detection_ratio", 5),
    "co_movement": ("insight_type = 'co_movement' and flag is not null", "p_decline", 10), "notable": ("insight_type = 'notable_record'", "distance", 5),
}
query("o5_report_lists", using(" union all ".join(f"select * from (select '{s}' as section, insight_id from calc where {w} order by {SORT_SQL[k]}, insight_id limit {n})" for s, (w, k, n) in LISTS.items())))(
    lambda c: rp.report_lists(shown(c)).select("section", "insight_id")
)


@query("o6_default_sort_first", using("select 'expansion' as filed, * from (select insight_id from calc where flag = 'expansion' and insight_type = 'range_change' order by aoo_10km_change desc nulls last, insight_id limit 3) union all select 'evidence_gap', * from (select insight_id from calc where kind = 'evidence_gap' order by records_since_2015, insight_id limit 3)"))
def _(c: Corpus):
    out = None
    for t, filed in (("range_change", "expansion"), ("silent_species", "evidence_gap")):
        rows, _ = rp.page(rp.find(shown(c), type=t, label=filed), rp.default_sort(t, filed), 3)
        one = rows.select(F.lit(filed).alias("filed"), "insight_id")
        out = one if out is None else out.unionByName(one)
    return out


query("p31_region_page", using("select insight_id from calc where region = 'AFRICA' and not (insight_type = 'reporting_rate' and flag is null)"))(
    lambda c: rp.region_page(shown(c), "AFRICA").select("insight_id")
)

RATIO = "(case when {e} is null then '—' else case when {e} >= {b} then '+' else '−' end || abs(cast(floor(({e} - {b}) * 100 + 0.5) as bigint)) || '%' end)"
NUM = "coalesce(format('{{:,}}', cast({e} as bigint)), '—')"


@query("p27_display_columns", using(f"""select insight_id, label, tone, key_figure, caveat from (select insight_id, nullif(label, 'none') as label,
  case when label in ('silent', 'regional_silence', 'contraction', 'decline', 'co_decline') then 'alert' when label in ('expansion', 'increase', 'co_increase') then 'good' else 'neutral' end as tone,
  case insight_type when 'silent_species' then case when kind = 'regional_silence' then {NUM.format(e='baseline_records')} || ' baseline records, last ' || coalesce(last_record_date, '—')
         else coalesce(last_record_date, 'none') || ', ' || {NUM.format(e='records_since_2015')} || ' records' end
       when 'range_change' then {NUM.format(e='aoo_10km_b')} || ' → ' || {NUM.format(e='aoo_10km_r')} || ' km² (' || {RATIO.format(e='aoo_10km_change', b=0)} || ')'
       when 'reporting_rate' then {RATIO.format(e='detection_ratio', b=1)} || case when d_low is not null then ' (95% CI ' || {RATIO.format(e='d_low', b=1)} || ' to ' || {RATIO.format(e='d_high', b=1)} || ')' else '' end
       when 'co_movement' then declines || ' / ' || increases || ' of ' || taxa_assessed
       when 'notable_record' then {NUM.format(e='records')} || ' records, ' || case when max_distance_to_prior_km is null then 'no earlier record' else {NUM.format(e='max_distance_to_prior_km')} || ' km' end end as key_figure,
  case when insight_type = 'range_change' and share_stopped >= 0.5 then 'Doubtful: ' || cast(floor(share_stopped * 100 + 0.5) as bigint) || '% of the baseline is from sources that no longer report it' end as caveat from calc)"""))
def _(c: Corpus):
    return rp.display_columns(ins(c)).select("insight_id", "label", "tone", "key_figure", "caveat")


AS_OF = "2001-06-30"


@query("a24_corpus_facts", S.using(f"select (select count(*) from rec) as analysable_records, (select count(*) from taxa) as taxa, (select count(*) from tiers where statistical_tier) as statistical_tier, (select count(distinct data_resource_uid) from occ) as datasets, (select cast(max(event_day) as varchar) from occ where event_day <= date '{AS_OF}') as latest_record", S.tiers()))
def _(c: Corpus):
    return dates(rp.corpus_facts(c.occurrences, c.records, c.taxa, c.tiers, AS_OF), "latest_record")


SERIES = "count(*) as records, count(*) filter (population = 'wild') as wild, count(distinct data_resource_uid) as datasets from rec"
query("a27_monthly_currency", S.using(f"select strftime(event_day, '%Y-%m') as month, {SERIES} where event_day between date '1996-01-01' and date '{AS_OF}' group by 1"))(lambda c: rp.monthly_currency(c.records, "1996-01-01", AS_OF))
query("a28_taxon_years", S.using(f"select cast(year(event_day) as int) as year, {SERIES} where taxon_concept_id = 'T7' and event_day between date '1996-01-01' and date '{AS_OF}' group by 1"))(lambda c: rp.taxon_years(c.records, "T7", "1996-01-01", AS_OF))
REGIONS = f"select ibra_region as region, count(*) filter ({S.between('event_day', P.baseline_window)}) as baseline, count(*) filter ({S.between('event_day', P.recent_window)}) as recent, count(*) as since from rec where taxon_concept_id = 'T7' and population = 'wild' group by 1"
query("a28_taxon_regions", S.using(REGIONS))(lambda c: rp.taxon_regions(c.records, "T7", c.p))
query("a37_region_shift", S.using(f"select region, {S.fx('(recent - baseline) / (recent + baseline)', 6)} as shift from ({REGIONS}) where recent + baseline >= 5"))(
    lambda c: rp.region_shift(rp.taxon_regions(c.records, "T7", c.p)).withColumn("shift", fixed(F.col("shift"), 6))
)
query("j28_taxon_page", S.using("select t.taxon_concept_id, t.kingdom, records_since_2015, cast(last_record_day as varchar) as last_record_day, statistical_tier from taxa t left join tiers using (taxon_concept_id) where t.taxon_concept_id = 'T7'", S.tiers()))(
    lambda c: dates(rp.taxon_page(c.taxa, c.tiers, "T7"), "last_record_day").select("taxon_concept_id", "kingdom", "records_since_2015", "last_record_day", "statistical_tier")
)


@query("a35_workload_counts", using(f"""select count(*) filter (insight_type = 'range_change') as range_taxa, count(*) filter (insight_type = 'reporting_rate' and region is null) as rate_taxa,
  count(*) filter (insight_type = 'reporting_rate' and region is not null) as rate_pairs, count(*) filter (insight_type = 'co_movement') as regions, (select count(*) from taxa) as taxa,
  (select count(distinct taxon_concept_id) from rec where {S.between('event_day', P.baseline)}) as baseline_region_taxa, (select count(distinct taxon_concept_id) from cur) as report_taxa from calc"""))
def _(c: Corpus):
    return rp.workload_counts(ins(c), c.records, c.taxa, c.tiers, c.p)


# --- runs ---

RUNS = """runs as (
  select 'r' || c_custkey as run_id, case when c_custkey % 3 = 0 then 'calculated' else 'ai' end as arm, case when c_custkey % 3 = 0 then null when c_custkey % 2 = 0 then 'guided' else 'open' end as brief,
         case when c_custkey % 7 = 0 then 'failed' else 'done' end as status, 'p' || c_custkey % 4 as prompt_version, 'v' || c_custkey % 5 as version, c_custkey % 4 <> 0 as whole, c_custkey as ck,
         c_acctbal / 100 as cost, c_custkey % 50 as turns, timestamp '2024-01-01' + to_minutes(c_custkey) as started_at, timestamp '2024-01-01' + to_minutes(c_custkey + c_custkey % 90) as finished_at from customer
),
comparisons as (
  select o_orderkey as comparison_id, 'r' || o_custkey as ai_run_id, 'r' || (o_custkey % 5) * 3 as calculated_run_id, 's' || o_orderkey % 3 as scorer_version, o_orderkey % 4 as n, o_orderkey % 2 as y from orders
),
latest as (select ai_run_id, arg_max(calculated_run_id, comparison_id) as calculated_run_id, arg_max(scorer_version, comparison_id) as scorer_version, arg_max(n, comparison_id) as n, arg_max(y, comparison_id) as y from comparisons group by 1)"""


def runs(c: Corpus):
    k = F.col("c_custkey")
    win = '{"start": "1995-01-01", "end": "1997-12-31"}'
    listed = F.when(k % 4 != 0, '["1", "2", "3", "4", "5"]').otherwise('["1", "2"]')
    params = F.concat(F.lit('{"version": "v'), (k % 5).cast("string"), F.lit('", "reportMonth": "2001-06", "insights": '), listed, F.lit(f', "baseline": {win}, "rangeChange": {{"baselineWindow": {win}, "recentWindow": {win}}}}}'))
    usage = F.to_json(F.struct((F.col("c_acctbal") / 100).alias("estimatedCostUsd"), (k % 50).alias("turns"), (k % 20).alias("queries"), (k * 10).alias("outputTokens")))
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return read(c.spark, c.sf_dir, "customer").select(
        F.concat(F.lit("r"), k.cast("string")).alias("run_id"), F.when(k % 3 == 0, "calculated").otherwise("ai").alias("arm"),
        F.when(k % 3 != 0, F.when(k % 2 == 0, "guided").otherwise("open")).alias("brief"), F.when(k % 7 == 0, "failed").otherwise("done").alias("status"),
        F.concat(F.lit("p"), (k % 4).cast("string")).alias("prompt_version"), params.alias("params"), usage.alias("usage"),
        (t0 + F.make_dt_interval(mins=k.cast("int"))).alias("started_at"), (t0 + F.make_dt_interval(mins=(k + k % 90).cast("int"))).alias("finished_at"),
    )


def comparisons(c: Corpus):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    agrees = F.concat(F.lit('{"agrees": '), F.when(o % 2 == 1, "true").otherwise("false"), F.lit("}"))
    heads = F.array_join(F.slice(F.array(*[agrees] * 3), F.lit(1), (o % 4).cast("int")), ", ")
    return read(c.spark, c.sf_dir, "orders").select(
        o.alias("comparison_id"), F.concat(F.lit("r"), k.cast("string")).alias("ai_run_id"), F.concat(F.lit("r"), ((k % 5) * 3).cast("string")).alias("calculated_run_id"),
        F.concat(F.lit("s"), (o % 3).cast("string")).alias("scorer_version"), F.concat(F.lit('{"reproduction": {"headline_counts": ['), heads, F.lit("]}}")).alias("summary"),
    )


def ai_insights(c: Corpus):
    e = read(c.spark, c.sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("insight_id"), F.concat(F.lit("r"), (F.col("user_id") % 1000).cast("string")).alias("run_id"), F.concat(F.lit("T"), (i % 120).cast("string")).alias("taxon_concept_id"),
        F.array(F.concat(F.lit("T"), (i % 7).cast("string"))).alias("related_taxa"), F.col("event_type").alias("summary"),
    )


def runs_using(select: str) -> str:
    return "with " + RUNS + "\n" + select


query("o4_latest_complete_run", runs_using("select run_id from runs where arm = 'calculated' and status = 'done' and whole order by started_at desc, run_id limit 1"))(lambda c: rp.latest_complete_run(runs(c)).select("run_id"))
query("p32_run_header", runs_using("select run_id, arm, version as params_version, '2001-06' as report_month, '1995-01-01' as baseline_start, '1997-12-31' as window_recent_end, cast(started_at as varchar) as started_at from runs"))(
    lambda c: rp.run_header(runs(c)).select("run_id", "arm", "params_version", "report_month", "baseline_start", "window_recent_end", F.col("started_at").cast("string").alias("started_at"))
)
query("w4_j17_latest_comparison", runs_using("select ai_run_id, calculated_run_id, scorer_version from latest"))(lambda c: rp.latest_comparison(comparisons(c)).select("ai_run_id", "calculated_run_id", "scorer_version"))
query("w4_latest_baseline", "select o_custkey as calculated_run_id, max(o_orderkey) as baseline_id from orders group by o_custkey")(
    lambda c: rp.latest_baseline(read(c.spark, c.sf_dir, "orders").select(F.col("o_custkey").alias("calculated_run_id"), F.col("o_orderkey").alias("baseline_id")))
)
query("j18_run_list", runs_using("select r.run_id, coalesce(n.n, 0) as insights, l.calculated_run_id, l.scorer_version from runs r left join (select 'r' || user_id % 1000 as run_id, count(*) as n from events group by 1) n using (run_id) left join latest l on l.ai_run_id = r.run_id"))(
    lambda c: rp.run_list(runs(c), ai_insights(c), comparisons(c)).select("run_id", "insights", "calculated_run_id", "scorer_version")
)
query("j20_ai_insights_of_taxon", runs_using("select event_id as insight_id, run_id, brief from (select *, 'r' || user_id % 1000 as run_id from events) e join runs r using (run_id) where arm = 'ai' and status = 'done' and (event_id % 120 = 5 or event_id % 7 = 5)"))(
    lambda c: rp.ai_insights_of(ai_insights(c), runs(c), "T5").select("insight_id", "run_id", "brief")
)
query("o8_queries_by_id", "select event_id as query_id, event_type as sql from events where event_id in (select range from range(0, 1000, 10))")(
    lambda c: rp.queries_by_id(read(c.spark, c.sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("event_type").alias("sql")), list(range(0, 1000, 10)))
)
query("a29_j21_ai_usage", runs_using(f"""select brief, count(*) as runs, {S.fx('avg(cost)', 4)} as mean_cost, {S.fx('avg(epoch(finished_at - started_at) / 60)', 4)} as mean_minutes, {S.fx('avg(turns)', 4)} as mean_turns from runs r
  where arm = 'ai' and status = 'done' and run_id in (select ai_run_id from comparisons where calculated_run_id = 'r6') and started_at > (select finished_at from runs where run_id = 'r6') group by brief"""))(
    lambda c: rp.ai_usage(runs(c), comparisons(c), "r6").select("brief", "runs", *[fixed(F.col(x), 4).alias(x) for x in ("mean_cost", "mean_minutes", "mean_turns")])
)
query("a36_evaluation_groups", runs_using(f"select prompt_version, brief, count(*) as runs, cast(coalesce(sum(n * y), 0) as bigint) as headlines_agreed, cast(coalesce(sum(n), 0) as bigint) as headlines, {S.fx('sum(cost)', 2)} as total_cost from runs left join latest on ai_run_id = run_id where arm = 'ai' group by 1, 2"))(
    lambda c: rp.evaluation_groups(runs(c), comparisons(c)).withColumn("total_cost", fixed(F.col("total_cost"), 2))
)


@query("f_variant_figures", using("select insight_id, nullif(label, 'none') as label, detection_ratio, records_since_2015 from calc"))
def _(c: Corpus):
    return ins(c).select("insight_id", label().alias("label"), fig_number("detection_ratio").alias("detection_ratio"), fig("records_since_2015", "bigint").alias("records_since_2015"))
