"""Plain SQL restatements of the corpus and the insights, used only to check the Spark operators."""

from __future__ import annotations

from taxatrend.corpus import PARAMS, TAXA
from taxatrend.functions import geo
from taxatrend.params import Params


def fx(e: str, d: int) -> str:
    """Half away from zero to ``d`` decimals, null for null or non-finite."""
    k = 10**d
    return f"(case when isfinite({e}) then sign({e}) * (floor(abs({e}) * {k} + 0.5) / {k}.0) + 0.0 end)"


def ri(e: str) -> str:
    return f"cast(floor(({e}) + 0.5) as bigint)"


def sig3(e: str) -> str:
    return f"cast(printf('%.3g', {e}) as double)"


def between(col: str, w) -> str:
    return f"{col} between date '{w.start}' and date '{w.end}'"


NAME = "case when vernacular_name is not null then vernacular_name || ' (' || scientific_name || ')' else coalesce(scientific_name, 'unnamed taxon') end"

CORPUS = f"""
base as (
  select l.*, l.l_partkey % {TAXA} as k, cast(l.l_shipdate as date) as d,
         n.n_nationkey as n, n.n_name, r.r_regionkey as rk, r.r_name
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey
),
taxa as (
  select 'T' || k as taxon_concept_id, 'Genus species' || k as scientific_name,
         case when k % 4 <> 0 then 'Common name-' || k end as vernacular_name, 'species' as taxon_rank,
         case when k % 6 = 5 then 'Plantae' else 'Animalia' end as kingdom,
         ['Aves', 'Mammalia', 'Reptilia', 'Amphibia', 'Insecta', 'Magnoliopsida'][k % 6 + 1] as taxon_class,
         case when k % 10 <> 9 then ['Vulnerable', 'Endangered', 'Critically Endangered'][k % 3 + 1] end as national_status
  from (select distinct p_partkey % {TAXA} as k from part)
),
datasets as (
  select 'd' || i as data_resource_uid, 'Dataset ' || i as name,
         case i when 0 then 'telemetry' when 1 then 'managed' else 'wild' end as kind
  from (select distinct s_suppkey % 10 as i from supplier)
),
rules as (
  select cast(n_nationkey * 4 + s as bigint) as rule_id, 'T' || ((n_nationkey * 3 + s * 40) % {TAXA}) as taxon_concept_id,
         n_name as state_province, case when s % 2 = 1 then r_name end as ibra_region,
         case when s >= 2 then 'd' || (n_nationkey % 10) end as data_resource_uid
  from nation join region on n_regionkey = r_regionkey, range(4) t(s)
),
every_rec as (
  select 't:' || l_orderkey || ':' || l_linenumber as record_id, l_orderkey || ':' || l_linenumber as source_record_id,
         'd' || (l_suppkey % 10) as data_resource_uid,
         'T' || k as taxon_concept_id, d as event_day, k, rk, l_orderkey, l_linenumber,
         cast(-1200 - n * 110 - (l_orderkey * 7 + l_partkey * 13) % 100 as double) / 100 as lat,
         cast(11500 + rk * 600 + (l_suppkey * 17 + l_orderkey * 3) % 500 as double) / 100 as lon,
         case when l_linenumber <> 7 then l_quantity * 100 end as unc,
         n_name as state_province, r_name as ibra_region,
         case l_linenumber % 3 when 0 then '0' when 1 then 'Looks strong and healthy' end as occurrence_remarks,
         (l_linenumber <> 6 or l_quantity < 45) as is_valid
  from base
),
un as (
  select *, round(cast(lat as decimal(18, 10)), 1) as cell_lat, round(cast(lon as decimal(18, 10)), 1) as cell_lon
  from every_rec
),
occ as (
  select * exclude (k, taxon_concept_id, moved), if(moved, k - k % 10 + 8, k) as k, 'T' || if(moved, k - k % 10 + 8, k) as taxon_concept_id from (select *, (
    (k % 10 = 0 and event_day >= date '1998-06-01') or (k % 10 = 1 and l_orderkey % 200 <> 0)
    or (k % 10 = 2 and rk = 1 and event_day >= date '1998-06-01')
    or (k % 10 = 3 and event_day >= date '1999-01-01' and l_orderkey % 10 < 6)
    or (k % 10 = 4 and event_day < date '1998-01-01' and l_orderkey % 10 < 6)
    or (k % 10 in (5, 6) and rk = 3 and event_day >= date '1999-01-01' and l_orderkey % 10 < 7)) as moved from un)
),
rec as (
  select o.*, coalesce(d.kind, 'wild') as dataset_kind,
         case when coalesce(d.kind, 'wild') = 'managed' then 'managed' else 'wild' end as population
  from occ o left join datasets d using (data_resource_uid)
  where o.is_valid and coalesce(d.kind, 'wild') <> 'telemetry'
),
effort as (
  select g.grp as taxon_group, cell_lat, cell_lon, cast(date_trunc('month', event_day) as date) as period_start,
         last_day(event_day) as period_end, count(*) as records
  from un join taxa using (taxon_concept_id), lateral (
    select 'all' as grp union all
    select case when kingdom = 'Plantae' then 'Plantae' else taxon_class end
    where kingdom = 'Plantae' or taxon_class in ('Aves', 'Mammalia', 'Reptilia', 'Amphibia')) g
  where data_resource_uid <> 'd0'
  group by all
)"""


def tiers(p: Params = PARAMS) -> str:
    return f"""
tiers as (
  select t.taxon_concept_id, t.scientific_name, t.vernacular_name, t.national_status,
         count(r.record_id) filter (r.event_day >= date '{p.tier_since}') as records_since_2015,
         max(r.event_day) as last_record_day,
         count(r.record_id) filter (r.event_day >= date '{p.tier_since}') >= {p.tier_min_records} as statistical_tier
  from taxa t left join rec r using (taxon_concept_id)
  group by all
)"""


def silent(p: Params = PARAMS) -> str:
    w = p.silence
    return f"""
silent_counts as (
  select t.taxon_concept_id, t.scientific_name, t.vernacular_name, t.national_status,
         count(r.record_id) as records_since_2015,
         count(r.record_id) filter (r.event_day >= date '{w.start}') as records_in_window,
         max(r.event_day) as last_day,
         count(r.record_id) filter ({between('r.event_day', p.baseline)}) / {p.baseline_years}.0 as mean_raw,
         count(distinct r.data_resource_uid) as datasets,
         avg(case when r.record_id is null then null when r.unc is null or r.unc > 2000 then 1 else 0 end) as imprecise,
         avg(case when r.record_id is null then null when r.population = 'managed' then 1 else 0 end) as managed
  from taxa t left join rec r on r.taxon_concept_id = t.taxon_concept_id and r.event_day <= date '{w.end}'
  group by all
),
silent_nat as (
  select 'silent_species' as insight_type, taxon_concept_id, cast(null as varchar) as region,
         date '{w.start}' as period_start, date '{w.end}' as period_end,
         case when records_in_window = 0 then 'silent' else 'evidence_gap' end as kind,
         records_since_2015 < {p.evidence_gap_max_records} as evidence_gap, national_status,
         cast(last_day as varchar) as last_record_date,
         cast(floor((date '{w.end}' - last_day) / 30.44) as bigint) as months_since_last_record,
         records_in_window, records_since_2015, {fx('mean_raw', 2)} as baseline_annual_mean, datasets,
         {fx('imprecise', 3)} as share_imprecise, {fx('managed', 3)} as share_managed,
         case when records_in_window = 0 then
           {NAME} || ' (' || coalesce(national_status, 'status unknown') || ') went unrecorded for the {p.lookback_months} months up to {w.end}'
           || coalesce(', its latest record being of ' || last_day || '.', ', with no usable record from {p.tier_since[:4]} on.')
           || case when records_since_2015 < {p.evidence_gap_max_records} then ' Its whole series counts ' || records_since_2015 || ' from {p.tier_since[:4]} on.' else '' end
         else {NAME} || ' (' || coalesce(national_status, 'status unknown') || ') is known from just ' || records_since_2015
           || ' records from {p.tier_since[:4]} on, which show no trend.' end as summary
  from silent_counts
  where records_in_window = 0 or records_since_2015 < {p.evidence_gap_max_records}
),
silent_reg as (
  select 'silent_species' as insight_type, taxon_concept_id, r.ibra_region as region,
         date '{w.start}' as period_start, date '{w.end}' as period_end, t.national_status,
         cast(max(r.event_day) as varchar) as last_record_date,
         count(*) filter ({between('r.event_day', p.baseline)}) as baseline_records,
         count(*) as records_since_2015, count(distinct r.data_resource_uid) as datasets,
         any_value({NAME}) || ' is on record elsewhere, but its latest record in ' || r.ibra_region || ' is of ' || max(r.event_day)
           || ', after ' || count(*) filter ({between('r.event_day', p.baseline)})
           || ' in the baseline of {p.baseline.start[:4]}–{p.baseline.end[2:4]}.' as summary
  from rec r join taxa t using (taxon_concept_id)
  where r.ibra_region is not null and r.event_day <= date '{w.end}'
    and taxon_concept_id in (select taxon_concept_id from rec where {between('event_day', w)})
  group by taxon_concept_id, r.ibra_region, t.national_status
  having count(*) filter ({between('r.event_day', p.baseline)}) >= {p.regional_min_baseline_records}
     and max(r.event_day) < date '{w.start}'
)"""


def rate(p: Params, regional: bool) -> str:
    s = "reg" if regional else "nat"
    b, r = p.baseline_window, p.recent_window
    scope = "ibra_region" if regional else "''"
    cons = "b.data_resource_uid is not null"
    ratio = lambda x, y: f"case when eb > 0 and er > 0 and {x} > 0 then ({y} / er) / ({x} / eb) end"
    return f"""
w_{s} as (
  select r.taxon_concept_id, {scope} as region, cell_lat, cell_lon, data_resource_uid,
         case when kingdom = 'Plantae' then 'Plantae' when taxon_class in ('Aves', 'Mammalia', 'Reptilia', 'Amphibia') then taxon_class else 'all' end as effort_group,
         date_trunc('month', event_day) as month, case when {between('event_day', b)} then 'b' else 'r' end as win
  from rec r join taxa t using (taxon_concept_id)
  where taxon_concept_id in (select taxon_concept_id from tiers where statistical_tier) and population = 'wild'
    and ({between('event_day', b)} or {between('event_day', r)}) {"and ibra_region is not null" if regional else ""}
),
both_{s} as (select taxon_concept_id, region, data_resource_uid from w_{s} group by all having count(distinct win) = 2),
counts_{s} as (
  select w.taxon_concept_id, w.region, w.effort_group,
         count(*) filter (win = 'b') as nb, count(*) filter (win = 'r') as nr,
         count(*) filter (win = 'b' and {cons}) as nbc, count(*) filter (win = 'r' and {cons}) as nrc,
         count(distinct w.data_resource_uid) as datasets, count(distinct b.data_resource_uid) as consistent_datasets,
         count(distinct (cell_lat, cell_lon)) as cells,
         count(distinct (cell_lat, cell_lon, month)) filter (win = 'b' and {cons}) as db,
         count(distinct (cell_lat, cell_lon, month)) filter (win = 'r' and {cons}) as dr
  from w_{s} w left join both_{s} b using (taxon_concept_id, region, data_resource_uid)
  group by all
),
cell_effort_{s} as (
  select taxon_group as effort_group, cell_lat, cell_lon,
         sum(records) filter ({between('period_start', b)}) as eb, sum(records) filter ({between('period_start', r)}) as er,
         count(*) filter (records > 0 and {between('period_start', b)}) as vb,
         count(*) filter (records > 0 and {between('period_start', r)}) as vr
  from effort group by all
),
foot_{s} as (
  select f.taxon_concept_id, f.region, cast(sum(coalesce(eb, 0)) as bigint) as eb, cast(sum(coalesce(er, 0)) as bigint) as er,
         cast(sum(coalesce(vb, 0)) as bigint) as vb, cast(sum(coalesce(vr, 0)) as bigint) as vr
  from (select distinct taxon_concept_id, region, effort_group, cell_lat, cell_lon from w_{s}) f
  left join cell_effort_{s} using (effort_group, cell_lat, cell_lon) group by all
),
ratios_{s} as (
  select *, {ratio('nb', 'nr')} as ratio, {ratio('nbc', 'nrc')} as consistent,
         case when vb > 0 and vr > 0 and db > 0 then (dr / vr) / (db / vb) end as detection,
         case when nbc > 0 and nrc > 0 then sqrt(1 / nbc + 1 / nrc) end as se_c,
         case when db > 0 and dr > 0 and vb > 0 and vr > 0 and 1 / db - 1 / vb + 1 / dr - 1 / vr >= 0
              then sqrt(1 / db - 1 / vb + 1 / dr - 1 / vr) end as se_d,
         db >= {p.min_detections} and dr >= {p.min_detections} as enough
  from counts_{s} join foot_{s} using (taxon_concept_id, region)
  {f"where nb >= {p.rate_min_records} and nr >= {p.rate_min_records}" if regional else ""}
),
rate_{s} as (
  select 'reporting_rate' as insight_type, taxon_concept_id, nullif(region, '') as region,
         date '{r.start}' as period_start, date '{r.end}' as period_end, national_status,
         case when enough and consistent is not null and detection > 0 and se_d is not null then
           case when detection <= {p.decline_ratio} and detection * exp({p.z} * se_d) < 1 and consistent < 1 then 'decline'
                when detection >= {p.increase_ratio!r} and detection * exp(-{p.z} * se_d) > 1 and consistent > 1 then 'increase' end
         end as flag,
         nb, nr, nbc, nrc, effort_group, eb, er, {fx('nb / nullif(eb, 0) * 10000', 3)} as per10k_b, {fx('nr / nullif(er, 0) * 10000', 3)} as per10k_r,
         {fx('ratio', 3)} as ratio, {fx('consistent', 3)} as consistent_source_ratio,
         case when consistent > 0 then {fx(f'consistent * exp(-{p.z} * se_c)', 3)} end as ci_low,
         case when consistent > 0 then {fx(f'consistent * exp({p.z} * se_c)', 3)} end as ci_high,
         cells as footprint_cells, db, dr, vb, vr, {fx('detection', 3)} as detection_ratio,
         case when detection > 0 then {fx(f'detection * exp(-{p.z} * se_d)', 3)} end as d_low,
         case when detection > 0 then {fx(f'detection * exp({p.z} * se_d)', 3)} end as d_high,
         enough as enough_detections, datasets, consistent_datasets,
         {fx('1 - nbc / nullif(nb, 0)', 3)} as share_stopped, {fx('er / nullif(eb, 0)', 3)} as footprint_effort_ratio,
         {NAME} || coalesce(' in ' || nullif(region, ''), '') || ': detections per visited cell-month '
         || {ratio_text('detection')} || ' (visits with ' || case effort_group when 'all' then 'any' else effort_group end
         || ' records in its range), {b.years} to {r.years}, ' || db || ' → ' || dr
         || ' by sources active in both; records per effort ' || {ratio_text('consistent')}
         || case when flag is not null then '; flag: ' || flag || '.' when enough then '.' else '; not enough detections for a flag.' end as summary,
         {NAME} as name, detection
  from ratios_{s} join taxa using (taxon_concept_id)
)"""


def ratio_text(e: str) -> str:
    return f"(case when {e} is null then 'n/a' else case when {e} >= 1 then '+' else '' end || {ri(f'({e} - 1) * 100')} || '%' end)"


def change_text(e: str) -> str:
    return f"(case when {e} is null then 'n/a' else case when {e} > 0 then '+' else '' end || {ri(f'{e} * 100')} || '%' end)"


def co_movement(p: Params) -> str:
    """Needs rate(p, True)."""
    b, r = p.baseline_window, p.recent_window
    tail = lambda k, e: (
        f"case when {k} <= 0 then 1.0 when {e} <= 0 then 0.0 when {e} >= 1 then 1.0 else least(1.0, ("
        f"select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({e}) + (n - i) * ln(1 - {e}))) "
        f"from (select unnest(range(greatest({k}, 1), n + 1)) as i))) end"
    )
    q = lambda w: f"(select min(least(1.0, y.p_{w} * y.m / y.rk_{w})) from co_rank y where y.rk_{w} >= x.rk_{w})"
    groups = lambda f: (
        f"coalesce((select string_agg(grp || '=' || c, ',' order by grp) from (select grp, count(*) as c from co_in z "
        f"where z.region = x.region and z.flag = '{f}' group by grp)), '')"
    )
    return f"""
co_in as (
  select region, taxon_concept_id, flag, name,
         case when kingdom = 'Plantae' then 'plants' else coalesce(
           map {{'Aves': 'birds', 'Mammalia': 'mammals', 'Reptilia': 'reptiles', 'Amphibia': 'amphibians'}}[taxon_class], 'other') end as grp
  from rate_reg join taxa using (taxon_concept_id) where enough_detections
),
co_region as (
  select region, count(*) as n, count(*) filter (flag = 'decline') as kd, count(*) filter (flag = 'increase') as ki
  from co_in group by region
),
co_p as (
  select *, {tail('kd', 'ed')} as p_d, {tail('ki', 'ei')} as p_i
  from (select *, sum(n) over () as total, sum(kd) over () / sum(n) over () as ed, sum(ki) over () / sum(n) over () as ei from co_region)
),
co_rank as (
  select *, count(*) over () as m, row_number() over (order by p_d, region) as rk_d, row_number() over (order by p_i, region) as rk_i
  from co_p
),
co_q as (
  select *, {q('d')} as q_d, {q('i')} as q_i,
         coalesce((select string_agg(taxon_concept_id, ',' order by taxon_concept_id) from co_in z where z.region = x.region and z.flag = 'decline'), '') as declining_taxa,
         coalesce((select string_agg(taxon_concept_id, ',' order by taxon_concept_id) from co_in z where z.region = x.region and z.flag = 'increase'), '') as increasing_taxa,
         (select string_agg(name, '; ' order by taxon_concept_id) from co_in z where z.region = x.region and z.flag = 'decline') as dn,
         (select string_agg(name, '; ' order by taxon_concept_id) from co_in z where z.region = x.region and z.flag = 'increase') as inn,
         {groups('decline')} as declining_groups, {groups('increase')} as increasing_groups,
         case when kd >= {p.min_taxa} and p_d < {p.alpha} then 'co_decline' when ki >= {p.min_taxa} and p_i < {p.alpha} then 'co_increase' end as flag
  from co_rank x
),
co as (
  select 'co_movement' as insight_type, cast(null as varchar) as taxon_concept_id, region, date '{r.start}' as period_start, date '{r.end}' as period_end, flag,
         n as taxa_assessed, kd as declines, ki as increases, {sig3('ed')} as expected_decline_share, {sig3('ei')} as expected_increase_share,
         {sig3('p_d')} as p_decline, {sig3('p_i')} as p_increase, {sig3('q_d')} as q_decline, {sig3('q_i')} as q_increase,
         declining_groups, increasing_groups, declining_taxa, increasing_taxa, cast(total as bigint) as pairs_assessed,
         case when flag = 'co_increase' then increasing_taxa else declining_taxa end as related_taxa,
         region || ': ' || kd || ' of ' || n || ' assessed taxa fell in detection rate, ' || ki
         || ' rose, {b.years} to {r.years}'
         || case flag when 'co_decline' then ', more falls than chance gives (p ' || {sig3('p_d')} || '): ' || dn || '.'
                      when 'co_increase' then ', more rises than chance gives (p ' || {sig3('p_i')} || '): ' || inn || '.'
                      else '.' end as summary
  from co_q
)"""


def albers_sql() -> tuple[str, str]:
    k = geo.albers_constants()
    s = "sin(radians(lat))"
    es = f"({k['e']!r} * {s})"
    q = f"({1 - k['e2']!r} * ({s} / (1 - {es} * {es}) - ln((1 - {es}) / (1 + {es})) / {2 * k['e']!r}))"
    rho = f"({geo.A!r} * sqrt({k['c']!r} - {k['n']!r} * {q}) / {k['n']!r})"
    th = f"({k['n']!r} * radians(lon - {geo.ORIGIN[1]!r}))"
    return f"({rho} * sin({th}))", f"({k['rho0']!r} - {rho} * cos({th}))"


def range_change(p: Params = PARAMS) -> str:
    """Everything of insight 2 except the extent of occurrence."""
    b, r = p.baseline_window, p.recent_window
    x, y = albers_sql()
    ch = lambda u, v: fx(f"(({v} - {u}) / nullif({u}, 0))", 3)
    side = lambda s, f: f"coalesce(max({f}) filter (win = '{s}'), 0)"
    return f"""
rw as (
  select *, {x} as ax, {y} as ay, coalesce(unc <= {p.aoo_fine_cell_m}, false) as precise from (
    select taxon_concept_id, lat, lon, unc, data_resource_uid, population,
           case when {between('event_day', b)} then 'b' when {between('event_day', r)} then 'r' end as win
    from rec where taxon_concept_id in (select taxon_concept_id from tiers where statistical_tier) and population = 'wild')
  where win is not null
),
rm as (
  select taxon_concept_id, win, count(*) as records, count(*) filter (precise) as precise_records,
         count(distinct (floor(ax / {p.aoo_fine_cell_m}), floor(ay / {p.aoo_fine_cell_m}))) filter (precise) as fine,
         count(distinct (floor(ax / {p.aoo_coarse_cell_m}), floor(ay / {p.aoo_coarse_cell_m}))) as coarse,
         count(distinct data_resource_uid) as datasets,
         avg(case when a.u is null then 1 else 0 end) as stopped
  from rw left join (select distinct taxon_concept_id as t, data_resource_uid as u from rw where win = 'r') a
    on a.t = rw.taxon_concept_id and a.u = rw.data_resource_uid
  group by all
),
re as (
  select sum(records) filter (period_start >= date '{r.start}' and period_end <= date '{r.end}')
       / nullif(sum(records) filter (period_start >= date '{b.start}' and period_end <= date '{b.end}'), 0) as ratio
  from effort where taxon_group = 'all'
),
rside as (
  select taxon_concept_id, {side('b', 'records')} as records_b, {side('r', 'records')} as records_r,
         {side('b', 'precise_records')} as pb, {side('r', 'precise_records')} as pr, {side('b', 'fine')} as fb, {side('r', 'fine')} as fr,
         {side('b', 'coarse')} as cb, {side('r', 'coarse')} as cr, max(datasets) as datasets, max(stopped) filter (win = 'b') as stopped_b
  from rm group by all
),
rc as (
  select 'range_change' as insight_type, taxon_concept_id, cast(null as varchar) as region,
         date '{r.start}' as period_start, date '{r.end}' as period_end, national_status,
         records_b >= {p.range_min_records} and records_r >= {p.range_min_records} as enough_records,
         cb * 100 as aoo_10km_b, cr * 100 as aoo_10km_r, {ch('cb', 'cr')} as aoo_10km_change,
         fb * 4 as aoo_2km_b, fr * 4 as aoo_2km_r, {ch('fb', 'fr')} as aoo_2km_change,
         coalesce(pb / nullif(records_b, 0) >= {p.min_precise_share} and pr / nullif(records_r, 0) >= {p.min_precise_share}, false) as aoo_2km_reliable,
         records_b, records_r, {fx('pb / nullif(records_b, 0)', 3)} as precise_b, {fx('pr / nullif(records_r, 0)', 3)} as precise_r,
         {fx('re.ratio', 3)} as effort_ratio, {fx('stopped_b', 3)} as share_stopped, datasets, 0.0 as share_managed,
         case when enough_records and aoo_10km_change <= -{p.flag_change} then 'contraction'
              when enough_records and aoo_10km_change >= {p.flag_change} then 'expansion' end as flag
  from rside join taxa using (taxon_concept_id), re
)"""


def geodesic_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    f = geo.WGS84_F
    ra, rb = (f"atan({1 - f!r} * tan(radians({v})))" for v in (lat1, lat2))
    h = f"least(1.0, pow(sin(({rb} - {ra}) / 2), 2) + cos({ra}) * cos({rb}) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    s = f"(2 * asin(sqrt({h})))"
    pp = f"pow(sin(({ra} + {rb}) / 2), 2) * pow(cos(({rb} - {ra}) / 2), 2)"
    qq = f"pow(cos(({ra} + {rb}) / 2), 2) * pow(sin(({rb} - {ra}) / 2), 2)"
    xx = f"({s} - sin({s})) * {pp} / nullif(pow(cos({s} / 2), 2), 0)"
    yy = f"({s} + sin({s})) * {qq} / nullif(pow(sin({s} / 2), 2), 0)"
    return (
        f"(case when {lon1} = {lon2} and {lat1} = {lat2} then 0.0 else {geo.A / 1000!r} * "
        f"({s} - {f / 2!r} * (coalesce({xx}, 0.0) + coalesce({yy}, 0.0))) end)"
    )


def notable(p: Params = PARAMS) -> str:
    w = p.report
    limit = f"{p.outside_range_km:g}"
    first = lambda c: f"arg_min({c}, record_id)"
    return f"""
cur as (
  select * from rec where {between('event_day', w)} and taxon_concept_id in (select taxon_concept_id from tiers where statistical_tier)
),
prior as (select distinct taxon_concept_id, lon, lat from occ where is_valid and event_day < date '{w.start}' and data_resource_uid <> 'd0'),
near as (
  select record_id, {geodesic_sql('lon', 'lat', 'p.plon', 'p.plat')} as km from (
    select record_id, cur.lon, cur.lat, arg_min({{'plon': p.lon, 'plat': p.lat}}, {{'d': (p.lon - cur.lon) * (p.lon - cur.lon) + (p.lat - cur.lat) * (p.lat - cur.lat), 'x': p.lon, 'y': p.lat}}) as p
    from cur join prior p on p.taxon_concept_id = cur.taxon_concept_id group by record_id, cur.lon, cur.lat)
),
seen as (select distinct taxon_concept_id, ibra_region from occ where is_valid and event_day < date '{w.start}'),
season as (
  select *, sum(n) over (partition by taxon_concept_id) as total from (
    select taxon_concept_id, month(event_day) as m, count(*) as n from rec
    where {between('event_day', p.baseline)} and taxon_concept_id in (select taxon_concept_id from cur) group by all)
),
checked as (
  select cur.*, near.km, s2.ibra_region is not null as region_seen, season.n / season.total as month_share,
         cast(coalesce((select max(total) from season z where z.taxon_concept_id = cur.taxon_concept_id), 0) as bigint) as baseline_records
  from cur left join near using (record_id)
  left join seen s2 on s2.taxon_concept_id = cur.taxon_concept_id and s2.ibra_region = cur.ibra_region
  left join season on season.taxon_concept_id = cur.taxon_concept_id and season.m = month(cur.event_day)
),
why as (
  select *, km is null or km > {p.outside_range_km} as outside_range, not region_seen as new_region,
         baseline_records >= {p.season_min_baseline_records} and coalesce(month_share, 0) < {p.out_of_season_max_share} as out_of_season
  from checked
),
ng as (
  select taxon_concept_id, coalesce(ibra_region, state_province, '') as place, {first('ibra_region')} as region, {first('state_province')} as state_province,
         {first('baseline_records')} as baseline_records, bool_or(outside_range) as outside_range, bool_or(new_region) as new_region,
         bool_or(out_of_season) as out_of_season, count(*) as records, max(km) as max_km,
         count(*) filter (population = 'managed') as managed_records, count(*) filter (unc is null or unc > 2000) as imprecise,
         array_to_string(list_sort(list(record_id))[1:20], ',') as record_ids
  from why where outside_range or new_region or out_of_season group by 1, 2
),
nt as (
  select 'notable_record' as insight_type, taxon_concept_id, region, date '{w.start}' as period_start, date '{w.end}' as period_end,
         concat_ws(',', case when new_region then 'new_region' end, case when out_of_season then 'out_of_season' end, case when outside_range then 'outside_range' end) as reasons,
         national_status, records, record_ids, {ri('max_km')} as max_distance_to_prior_km, state_province, managed_records,
         {fx('imprecise / records', 3)} as share_imprecise, managed_records > 0 as managed, baseline_records,
         {NAME} || ' in ' || coalesce(region, nullif(state_province, '') || ' (no bioregion)', 'no assigned region') || ', {p.report_month}: '
         || records || ' record' || case records when 1 then '' else 's' end || ' '
         || concat_ws('; ', case when new_region then 'new to the bioregion from {p.tier_since[:4]}' end,
              case when out_of_season then 'in a month unusual for it' end, case when outside_range then 'over {limit} km away from every earlier record' end)
         || case when max_km is not null and outside_range then ', at most ' || {ri('max_km')} || ' km' else '' end
         || case when managed_records > 0 then '; ' || managed_records || ' of them managed.' else '.' end as summary
  from ng join taxa using (taxon_concept_id)
)"""


#: Marks CTEs that refer to themselves.
RECURSIVE = "/* recursive */"


def hull_area(name: str, points: str) -> str:
    """CTE ``name`` (key, eoo_km2): area of the convex hull of each key's points (key, lon, lat in whole hundredths of a degree).

    The two chains of a hull are walked over one meridian's extreme points after another: the last kept point is given up as long as it does not
    turn left to the next. Cross products of whole numbers are exact. Edges are great circles on the sphere of equal area.
    """
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)
    q = lambda s: f"({1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) + atanh(sqrt({e2!r}) * {s}) / sqrt({e2!r})))"
    half = lambda y: f"tan(asin(greatest(-1.0, least(1.0, {q(f'sin(radians({y} / 100.0::double))')} / {q('1.0::double')}))) / 2)"
    return f"""
{name}_x as {RECURSIVE} (
  select key, x, min(y) as south, max(y) as north from (select key, cast(round(lon * 100) as bigint) as x, cast(round(lat * 100) as bigint) as y from ({points})) group by key, x
),
{name}_side as (
  select key, 1 as side, list({{'x': x, 'y': south}} order by x) as pts from {name}_x group by key union all select key, 2, list({{'x': x, 'y': north}} order by x desc) from {name}_x group by key
),
{name}_walk as (
  select key, side, cast(1 as bigint) as i, pts[1:0] as st from {name}_side
  union all
  select key, side, case when back then i else i + 1 end, case when back then st[1:len(st) - 1] else list_append(st, pt) end from (
    select key, side, i, st, pt, len(st) > 1 and (st[len(st)].x - st[len(st) - 1].x) * (pt.y - st[len(st) - 1].y) - (st[len(st)].y - st[len(st) - 1].y) * (pt.x - st[len(st) - 1].x) <= 0 as back
    from (select w.key, w.side, w.i, w.st, s.pts[w.i] as pt from {name}_walk w join {name}_side s on s.key = w.key and s.side = w.side where w.i <= len(s.pts)))
),
{name}_ring as (
  select key, list_concat(max(w.st) filter (side = 1), max(w.st) filter (side = 2)) as ring from {name}_walk w join {name}_side s using (key, side) where w.i = len(s.pts) + 1 group by key
),
{name} as (
  select key, abs(sum(2 * atan2(tan(radians((b.x - a.x) / 100.0::double) / 2) * (ta + tb), 1 + ta * tb))) * {(geo.A / 1000) ** 2!r} * {q('1.0::double')} / 2 as eoo_km2
  from (select key, a, b, {half('a.y')} as ta, {half('b.y')} as tb from (select key, ring[j] as a, ring[j % len(ring) + 1] as b from (select key, ring, unnest(range(1, len(ring) + 1)) as j from {name}_ring)))
  group by key
)"""


def range_extent(p: Params = PARAMS) -> str:
    """CTE rc_eoo (taxon_concept_id, eoo_b, eoo_r, eoo_change). Needs range_change()."""
    side = lambda w: f"coalesce(max(eoo_km2) filter (key = taxon_concept_id || '{w}'), 0)"
    return hull_area("eoo", "select taxon_concept_id || win as key, lon, lat from rw") + f""",
rc_eoo as (
  select taxon_concept_id, {ri('b')} as eoo_b, {ri('r')} as eoo_r, {fx('((r - b) / nullif(b, 0))', 3)} as eoo_change
  from (select taxon_concept_id, {side('b')} as b, {side('r')} as r from (select distinct taxon_concept_id, win from rw) join eoo on key = taxon_concept_id || win group by taxon_concept_id)
),
rc_text as (
  select rc.taxon_concept_id, flag, eoo_b, eoo_r, eoo_change, {NAME} || ': occupied 10 km cells ' || {change_text('aoo_10km_change')} || ', {p.baseline_window.years} to {p.recent_window.years} (' || aoo_10km_b || ' → ' || aoo_10km_r
    || ' km²); extent ' || {change_text('eoo_change')} || '; records ' || records_b || ' → ' || records_r || case when flag is not null then '; flag: ' || flag || '.' when enough_records then '.' else '; not enough records for a flag.' end as summary
  from rc join rc_eoo using (taxon_concept_id) join taxa using (taxon_concept_id)
)"""


def using(select: str, *ctes: str) -> str:
    """A statement over the corpus and the given further CTEs."""
    return ("with recursive " if any(RECURSIVE in c for c in ctes) else "with ") + ",\n".join([CORPUS, *ctes]).replace(RECURSIVE, "") + "\n" + select
