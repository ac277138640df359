"""Checks of the scoring operators. The second arm is a perturbed copy of the calculated insights, and its
logged results are record counts per taxon and region."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxatrend.checks import sql as S
from taxatrend.checks.registry import query
from taxatrend.checks.report import ALL, ins
from taxatrend.corpus import Corpus, read
from taxatrend.functions.numeric import fixed
from taxatrend.operators import scoring as sc
from taxatrend.operators.insight import fig, fig_number, unpack

# The other arm in SQL: k is the taxon's number, or the length of the region's name.
AI = """
ks as (select *, case when taxon_concept_id is null then length(region) else cast(taxon_concept_id[2:] as int) end as k from calc),
ai as (
  select 'ai|' || insight_id as insight_id, insight_type, taxon_concept_id, region, period_start, case when k % 8 = 1 then period_end + 1 else period_end end as period_end, k,
         case when kind = 'silent' and k % 5 = 2 then 'evidence_gap' else kind end as kind, evidence_gap, case when k % 6 = 0 then null else flag end as flag, last_record_date,
         records_since_2015 + case when k % 5 = 0 then 1 else 0 end as records_since_2015, aoo_10km_b, aoo_10km_r, aoo_10km_change * case when k % 4 = 1 then 1.01 else 1 end as aoo_10km_change,
         records_b, records_r + case when k % 7 = 0 then 3 else 0 end as records_r, detection_ratio * case when k % 3 = 0 then 1.2 else 1 end as detection_ratio,
         declines, increases + case when k % 2 = 0 then 1 else 0 end as increases, taxa_assessed,
         case when reasons like '%outside_range%' then 'over 100 km away' end as far, case when reasons like '%new_region%' then 'first IBRA record' end as fresh,
         case when reasons like '%out_of_season%' then 'odd month' end as odd, records, summary
  from ks where k % 4 <> 3
),
heads as (
  select key, count(*) as calculated from (
    select unnest([case when insight_type = 'silent_species' then 'silent_species:' || kind end, case when insight_type = 'silent_species' and kind = 'silent' and evidence_gap then 'silent_species:evidence_gap' end,
      case when insight_type in ('co_movement', 'range_change') and flag is not null then insight_type || ':' || flag end,
      case when insight_type = 'reporting_rate' and flag is not null and region is null then insight_type || ':' || flag end, case when insight_type = 'notable_record' then 'notable_record:groups' end]) as key from calc)
  where key is not null group by key
),
pairs as (
  select a.*, c.insight_id as cid, c.kind as ckind, c.evidence_gap as cgap, c.flag as cflag, c.last_record_date as clast, c.records_since_2015 as csince, c.aoo_10km_b as cab, c.aoo_10km_r as car,
         c.aoo_10km_change as cch, c.records_b as crb, c.records_r as crr, c.detection_ratio as cdr, c.declines as cd, c.increases as ci, c.taxa_assessed as cta, c.reasons as creasons, c.records as crec
  from ai a left join calc c on c.insight_type = a.insight_type and c.taxon_concept_id is not distinct from a.taxon_concept_id and c.region is not distinct from a.region
    and ((a.insight_type = 'silent_species' and a.region is null) or (c.period_start = a.period_start and c.period_end = a.period_end))
),
matched_pairs as (
  select *, cid is not null as matched, case when cid is null then null else list_transform(case insight_type
    when 'silent_species' then [kind is not distinct from ckind or coalesce(kind = 'evidence_gap' and cgap, false), coalesce(abs(records_since_2015 - csince) <= 0.0015, false), coalesce(last_record_date = clast, false)]
    when 'range_change' then [flag is not distinct from cflag, aoo_10km_b = cab, aoo_10km_r = car, coalesce(abs(aoo_10km_change - cch) <= greatest(0.0015, 0.02 * abs(cch)), false), coalesce(crb, 0) > 2, records_b = crb, abs(records_r - crr) <= 0.0015]
    when 'reporting_rate' then [flag is not distinct from cflag, coalesce(sign(detection_ratio - 1) = sign(cdr - 1), false), coalesce(abs(detection_ratio - cdr) <= greatest(0.0015, 0.05 * abs(cdr)), false)]
    when 'co_movement' then [flag is not distinct from cflag, declines = cd, increases = ci, taxa_assessed = cta]
    else [concat_ws(',', case when fresh is not null then 'new_region' end, case when odd is not null then 'out_of_season' end, case when far is not null then 'outside_range' end) = creasons, records = crec] end, lambda x: coalesce(x, false)) end as checks
  from pairs
)"""


def using(select: str, *more: str) -> str:
    return S.using(select, *ALL, AI, *more)


def ai(c: Corpus, headlines: bool = True):
    """The other arm, written once."""
    t = c.ws.table("ai_insights", lambda: _ai(c))
    return unpack(t if headlines else t.filter("taxon_concept_id is not null or region is not null"))


def _ai(c: Corpus):
    i = ins(c)
    k = F.when(F.col("taxon_concept_id").isNull(), F.length("region")).otherwise(F.substring("taxon_concept_id", 2, 9).cast("int"))
    i = i.withColumn("k", k).filter(F.col("k") % 4 != 3)
    k = F.col("k")
    t = F.col("insight_type")
    one = lambda cond, x: F.when(cond, x).otherwise(0)
    flag = F.when(k % 6 != 0, fig("flag")).alias("flag")
    kind = F.when((fig("kind") == "silent") & (k % 5 == 2), "evidence_gap").otherwise(fig("kind")).alias("kind")
    n = fig_number
    change = (n("aoo_10km_km2.change") * F.when(k % 4 == 1, 1.01).otherwise(1.0)).alias("change")
    reasons = fig("reasons", "array<string>")
    wording = {"outside_range": "over 100 km away", "new_region": "first IBRA record", "out_of_season": "odd month"}
    said = F.transform(reasons, lambda r: F.when(r == "outside_range", wording["outside_range"]).when(r == "new_region", wording["new_region"]).otherwise(wording["out_of_season"]))
    shapes = {
        "silent_species": F.struct(kind, (n("records_since_2015") + one(k % 5 == 0, 1)).alias("records_since_2015"), fig("last_record_date").alias("last_record_date")),
        "range_change": F.struct(
            flag, F.struct(n("aoo_10km_km2.baseline").alias("baseline"), n("aoo_10km_km2.recent").alias("recent"), change).alias("aoo_10km_km2"),
            F.struct(n("eoo_km2.change").alias("change")).alias("eoo_km2"), F.struct(n("records.baseline").alias("baseline"), (n("records.recent") + one(k % 7 == 0, 3)).alias("recent")).alias("records"),
        ),
        "reporting_rate": F.struct(flag, (n("detection_ratio") * F.when(k % 3 == 0, 1.2).otherwise(1.0)).alias("detection_ratio")),
        "co_movement": F.struct(flag, n("declines").alias("declines"), (n("increases") + one(k % 2 == 0, 1)).alias("increases"), n("taxa_assessed").alias("taxa_assessed")),
        "notable_record": F.struct(said.alias("reasons"), n("records").alias("records")),
    }
    figures = F.coalesce(*[F.when(t == name, F.to_json(s, {"ignoreNullFields": "false"})) for name, s in shapes.items()])
    qid = F.when(F.col("taxon_concept_id").isNotNull(), F.array(k, k + 1000)).otherwise(F.array()).cast("array<bigint>")
    out = i.select(
        F.concat(F.lit("ai|"), "insight_id").alias("insight_id"), F.lit("ai-1").alias("run_id"), "insight_type", "taxon_concept_id",
        F.array().cast("array<string>").alias("related_taxa"), "region", "period_start", F.date_add("period_end", one(k % 8 == 1, 1)).alias("period_end"),
        figures.alias("figures"), F.lit("{}").alias("confidence"), "summary", qid.alias("query_ids"),
    )
    # One headline row per calculated count; counts of flags are overstated by one.
    h = sc.headline_counts(ins(c)).withColumn("w", F.split("key", ":"))
    word = F.when(F.col("w")[0] == "notable_record", None).otherwise(F.col("w")[1])
    count = F.col("calculated") + F.when(F.col("key").startswith("reporting"), 1).otherwise(0)
    heads = h.select(
        F.concat(F.lit("ai|head|"), "key").alias("insight_id"), F.lit("ai-1").alias("run_id"), F.col("w")[0].alias("insight_type"),
        F.lit(None).cast("string").alias("taxon_concept_id"), F.array().cast("array<string>").alias("related_taxa"), F.lit(None).cast("string").alias("region"),
        F.lit("2001-01-01").cast("date").alias("period_start"), F.lit("2001-06-30").cast("date").alias("period_end"),
        F.to_json(F.struct(F.when(F.col("w")[0] == "silent_species", word).alias("kind"), F.when(F.col("w")[0] != "silent_species", word).alias("flag"), count.alias("count"))).alias("figures"),
        F.lit("{}").alias("confidence"), F.concat(F.lit("Nationally "), count.cast("string")).alias("summary"), F.array().cast("array<bigint>").alias("query_ids"),
    )
    return out.unionByName(heads)


@query("j22_match_by_key", using("select insight_id, matched, cid as calculated_insight_id from matched_pairs"))
def _(c: Corpus):
    return sc.reproduction(ai(c), ins(c)).select("insight_id", "matched", "calculated_insight_id")


@query("e1_figure_checks", using("select insight_type, len(checks) as checks, len(list_filter(checks, lambda x: x)) as agreed, count(*) as n from matched_pairs where matched group by all"))
def _(c: Corpus):
    r = sc.reproduction(ai(c), ins(c)).filter("matched")
    return r.groupBy("insight_type", F.size("checks").alias("checks"), F.size(F.filter("checks", lambda x: x["agrees"])).alias("agreed")).agg(F.count("*").alias("n"))


TOTALS = "select count(*) filter (matched) as matched, count(*) filter (not matched) as unmatched, cast(sum(len(list_filter(checks, lambda x: x))) as bigint) as agreed, cast(sum(len(checks)) as bigint) as checked from matched_pairs"


@query("a31_reproduction_totals", using(f"select *, {S.fx('agreed / checked', 3)} as figure_agreement from ({TOTALS})"))
def _(c: Corpus):
    return sc.reproduction_totals(sc.reproduction(ai(c), ins(c)))


@query("a30_headline_counts", using("select * from heads"))
def _(c: Corpus):
    return sc.headline_counts(ins(c))


@query("a30_headline_checks", using("select key, calculated, cast(calculated + case when key like 'reporting%' then 1 else 0 end as double) as ai, key not like 'reporting%' as agrees from heads"))
def _(c: Corpus):
    return sc.headline_checks(ai(c), ins(c)).drop("insight_id")


PRIORITY = """
scored as (
  select insight_id, taxon_concept_id, region, summary, 'silent' as set, baseline_annual_mean as score from calc where kind = 'silent'
  union all select insight_id, taxon_concept_id, region, summary, 'regional_silence', baseline_records from calc where kind = 'regional_silence'
  union all select insight_id, taxon_concept_id, region, summary, 'contraction', least(records_b, 1e9) * -aoo_10km_change from calc where flag = 'contraction'
  union all select insight_id, taxon_concept_id, region, summary, 'notable', coalesce(max_distance_to_prior_km, 0) from calc where insight_type = 'notable_record'
  union all select insight_id, taxon_concept_id, region, summary, 'co_decline', -p_decline from calc where flag = 'co_decline'
  union all select insight_id, taxon_concept_id, region, summary, 'rate_decline', db * -ln(greatest(detection_ratio, 1e-6)) from calc where insight_type = 'reporting_rate' and region is null and flag = 'decline'
),
prio as (select * from (select *, row_number() over (partition by set order by score desc, insight_id) as rank from scored) where rank <= 15),
texts as (
  select replace(replace(lower(summary || coalesce(' ' || region, '')), '-', ' '), '‐', ' ') as text from ai
  union all select 'nationally ' || (calculated + case when key like 'reporting%' then 1 else 0 end) from heads
),
found as (
  select p.*, case when taxon_concept_id is null then region in (select region from ai where region is not null)
    when set = 'regional_silence' then exists (select 1 from ai where ai.taxon_concept_id = p.taxon_concept_id and ai.region = p.region)
    else taxon_concept_id in (select taxon_concept_id from ai where taxon_concept_id is not null) end as found,
    exists (select 1 from texts x where case when p.taxon_concept_id is null then contains(x.text, lower(p.region)) else
      (coalesce(contains(x.text, replace(lower(t.vernacular_name), '-', ' ')), false) or contains(x.text, replace(lower(t.scientific_name), '-', ' '))) and (p.region is null or contains(x.text, lower(p.region))) end) as named
  from prio p left join taxa t using (taxon_concept_id)
)"""


@query("w3_priority_sets", using("select set, rank, insight_id, round(score, 6) as score from prio", PRIORITY))
def _(c: Corpus):
    return sc.priority_sets(ins(c)).select("set", "rank", "insight_id", F.round("score", 6).alias("score"))


@query("a32_j23_discovery", using("select set, rank, insight_id, found, found or named as mentioned from found", PRIORITY))
def _(c: Corpus):
    return sc.discovered(ai(c), ins(c), c.taxa).select("set", "rank", "insight_id", "found", "mentioned")


RECALL = "count(*) filter (found) as found, count(*) filter (found or named) as mentioned, count(*) as of from found"


@query("a32_recall", using(f"select set, found, mentioned, of, {S.fx('found / of', 3)} as recall_by_key, {S.fx('mentioned / of', 3)} as recall_by_mention from (select set, {RECALL} group by set union all select 'overall', {RECALL})", PRIORITY))
def _(c: Corpus):
    return sc.recall(sc.discovered(ai(c), ins(c), c.taxa)).drop("missed")


query("u3_missed_findings", using("select set, insight_id from found where not (found or named)", PRIORITY))(lambda c: sc.discovered(ai(c), ins(c), c.taxa).filter("not mentioned").select("set", "insight_id"))

query("a32_unflagged_taxa", using("select count(*) as insights_on_unflagged_taxa from ai where taxon_concept_id is not null and taxon_concept_id not in (select taxon_concept_id from calc where taxon_concept_id is not null and (kind is not null or flag is not null or insight_type = 'notable_record'))"))(
    lambda c: sc.unflagged_taxa_insights(ai(c), ins(c))
)

query("u2_taxa_of_insights", using("select distinct unnest(list_filter(list_prepend(taxon_concept_id, string_split(coalesce(related_taxa, ''), ',')), lambda x: x is not null and x <> '')) as taxon_concept_id from calc"))(
    lambda c: sc.taxa_of(ins(c)).select("taxon_concept_id").distinct()
)


@query("j23_name_mentions_in_documents", "select p_partkey as insight_id from part where exists (select 1 from documents where contains(replace(replace(lower(text), '-', ' '), '‐', ' '), replace(lower(split_part(p_name, ' ', 1)), '-', ' ')))")
def _(c: Corpus):
    docs = read(c.spark, c.sf_dir, "documents").select(F.col("text").alias("summary"), F.lit(None).cast("string").alias("region"))
    # Findings are a bounded list; here the distinct first words of part names, each with the parts that bear it.
    parts = read(c.spark, c.sf_dir, "part").select("p_partkey", F.split("p_name", " ")[0].alias("word"))
    words = parts.select("word").distinct()
    finding = words.select(F.col("word").alias("insight_id"), F.col("word").alias("taxon_concept_id"), F.lit(None).cast("string").alias("region"))
    named = words.select(F.col("word").alias("taxon_concept_id"), F.col("word").alias("vernacular_name"), F.lit(None).cast("string").alias("scientific_name"))
    hit = sc.mentions(docs, finding, named).select(F.col("insight_id").alias("word"))
    return parts.join(hit, "word", "left_semi").select(F.col("p_partkey").alias("insight_id"))


# --- grounding ---

RESULTS = S.range_extent() + """,
res as (
  select cast(taxon_concept_id[2:] as bigint) as query_id, 0 as r, 'n' as col, cast(count(*) as varchar) as v from rec group by taxon_concept_id
  union all select cast(taxon_concept_id[2:] as bigint), 0, 'label', 'x' || taxon_concept_id from rec group by taxon_concept_id
  union all select cast(taxon_concept_id[2:] as bigint) + 1000, row_number() over (partition by taxon_concept_id order by ibra_region), 'n', cast(count(*) as varchar) from rec group by taxon_concept_id, ibra_region
),
num as (select query_id, r, col, cast(v as double) as n from res where regexp_full_match(v, '-?[0-9.]+')),
vals as (
  select query_id, n from num union all select query_id, sum(n) from num group by query_id, col having count(*) > 1
),
leaf as (
  select insight_id, k, p.path, p.x from (select * from ai left join rc_eoo using (taxon_concept_id)) ai, lateral (select unnest([
    struct_pack(path := 'records_since_2015', x := cast(case when insight_type = 'silent_species' then records_since_2015 end as double)), struct_pack(path := 'detection_ratio', x := case when insight_type = 'reporting_rate' then detection_ratio end),
    struct_pack(path := 'aoo_10km_km2.baseline', x := case when insight_type = 'range_change' then aoo_10km_b end), struct_pack(path := 'aoo_10km_km2.recent', x := case when insight_type = 'range_change' then aoo_10km_r end),
    struct_pack(path := 'aoo_10km_km2.change', x := case when insight_type = 'range_change' then aoo_10km_change end),
    struct_pack(path := 'eoo_km2.change', x := case when insight_type = 'range_change' then eoo_change end),
    struct_pack(path := 'records.baseline', x := case when insight_type = 'range_change' then records_b end), struct_pack(path := 'records.recent', x := case when insight_type = 'range_change' then records_r end),
    struct_pack(path := 'declines', x := case when insight_type = 'co_movement' then declines end), struct_pack(path := 'increases', x := case when insight_type = 'co_movement' then increases end), struct_pack(path := 'taxa_assessed', x := case when insight_type = 'co_movement' then taxa_assessed end),
    struct_pack(path := 'records', x := case when insight_type = 'notable_record' then records end)], recursive := true)) p where p.x is not null
),
cand as (
  select k, n as v from (select distinct k from ai where taxon_concept_id is not null) join vals on query_id in (k, k + 1000)
),
comb as (
  select k, v from cand union all
  select a.k, unnest([a.v - b.v, a.v / b.v, (a.v - b.v) / b.v, (a.v - b.v) / b.v * 100, a.v / b.v * 100]) from cand a join cand b on a.k = b.k where b.v <> 0
),
judged as (
  select l.insight_id, l.path, ai2.taxon_concept_id is not null and exists (select 1 from comb c where c.k = l.k and (abs(l.x - c.v) <= 0.001 * abs(c.v)
    or sign(c.v) * floor(abs(c.v) * pow(10, length(regexp_extract(rtrim(rtrim(cast(cast(l.x as decimal(38, 12)) as varchar), '0'), '.'), '\\.(\\d+)$', 1))) + 0.5) / pow(10, length(regexp_extract(rtrim(rtrim(cast(cast(l.x as decimal(38, 12)) as varchar), '0'), '.'), '\\.(\\d+)$', 1))) = l.x)) as ok
  from leaf l join ai ai2 using (insight_id)
)"""


def results(c: Corpus):
    q = F.substring("taxon_concept_id", 2, 9).cast("bigint")
    n = c.records.groupBy("taxon_concept_id", "ibra_region").agg(F.count("*").alias("n"))
    total = n.groupBy("taxon_concept_id").agg(F.sum("n").alias("n"))
    row = lambda df, qid, r, name, v: df.select(qid.alias("query_id"), r.cast("bigint").alias("row"), F.lit(name).alias("column"), v.cast("string").alias("value"))
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("taxon_concept_id").orderBy("ibra_region"))
    out = row(total, q, F.lit(0), "n", F.col("n")).unionByName(row(total, q, F.lit(0), "label", F.concat(F.lit("x"), "taxon_concept_id")))
    return out.unionByName(row(n.withColumn("rn", rn), q + 1000, F.col("rn"), "n", F.col("n")))


query("a34_column_totals", using("select query_id, col as column, sum(n) as total from num group by query_id, col having count(*) > 1", RESULTS).replace("as column,", 'as "column",'))(lambda c: sc.column_totals(results(c)))


def placed_ai(c: Corpus):
    return ai(c, headlines=False)


def lines_of(c: Corpus):
    """Every number stated, extents of occurrence included, and whether it is grounded."""
    return c.ws.table("grounding_lines", lambda: sc.grounding_lines(placed_ai(c), results(c)))


RATES = f"select cast(sum(numbers) as bigint) as numbers, {S.fx('sum(grounded) / sum(numbers)', 3)} as numbers_grounded, {S.fx('count(*) filter (numbers = grounded) / count(*)', 3)} as insights_fully_grounded"
PER_INSIGHT = "select insight_id, count(path) as numbers, coalesce(count(*) filter (ok), 0) as grounded from ai left join judged using (insight_id) group by insight_id"


@query("j24_grounded_numbers", using("select insight_id, path, ok from judged", RESULTS))
def _(c: Corpus):
    return lines_of(c).select("insight_id", "path", "ok")


query("a33_grounding_rates", using(f"{RATES} from ({PER_INSIGHT})", RESULTS))(lambda c: sc.grounding_rates(sc.grounding(placed_ai(c), results(c))))


def logged(c: Corpus):
    r = results(c).groupBy("query_id").agg(F.count("*").alias("n")).withColumn("rerun_hash", F.md5(F.concat_ws("|", "query_id", "n")))
    return r.select("query_id", "rerun_hash", F.when(F.col("query_id") % 9 != 0, F.col("rerun_hash")).otherwise("other").alias("result_hash"))


REPRODUCED = "select count(*) as queries_cited, count(*) filter (q % 9 <> 0 and q in (select query_id from res)) as queries_reproduced from (select distinct unnest([k, k + 1000]) as q from ai where taxon_concept_id is not null)"

query("a33_queries_reproduced", using(REPRODUCED, RESULTS))(
    lambda c: sc.query_reproduction(placed_ai(c), logged(c))
)


# Headline rows count as insights, each with one number and no cited query.
E1 = f"""select (select count(*) from ai) + (select count(*) from heads) as ai_insights, t.*, {S.fx('agreed / checked', 3)} as figure_agreement, r.* exclude (set, found, mentioned, of), u.*, q.*, g.*
  from ({TOTALS}) t, (select 'overall' as set, *, {S.fx('found / of', 3)} as recall_by_key, {S.fx('mentioned / of', 3)} as recall_by_mention from (select {RECALL})) r,
  (select count(*) as insights_on_unflagged_taxa from ai where taxon_concept_id is not null and taxon_concept_id not in (select taxon_concept_id from calc where taxon_concept_id is not null and (kind is not null or flag is not null or insight_type = 'notable_record'))) u,
  ({REPRODUCED}) q, ({RATES} from ({PER_INSIGHT} union all select key, 1, 0 from heads)) g"""


@query("e1_score_run", using(E1, PRIORITY, RESULTS))
def _(c: Corpus):
    summary, _ = sc.score_run(ai(c), ins(c), results(c), logged(c), c.taxa, guided=True)
    return summary


@query("f_numeric_leaves", "select event_id, path, value from (select event_id, unnest([struct_pack(path := 'a.b', value := value), struct_pack(path := 'a.c[0]', value := cast(user_id as double)), struct_pack(path := 'a.c[1]', value := 2.5), struct_pack(path := 'k', value := cast(json_extract_string(props, '$.k') as double)), struct_pack(path := 'd.e.f[0].g.h', value := cast(event_id as double))], recursive := true) from events)")
def _(c: Corpus):
    e = read(c.spark, c.sf_dir, "events")
    doc = F.concat(F.lit('{"a": {"b": '), F.col("value").cast("string"), F.lit(', "c": ['), F.col("user_id").cast("string"), F.lit(', "2.5", "x", null]}, "k": '), F.get_json_object("props", "$.k"), F.lit(', "t": true, "d": {"e": {"f": [{"g": {"h": '), F.col("event_id").cast("string"), F.lit(', "plus": "+5", "open": "5.", "bare": ".5", "{[": "\\"["}}]}}}'))
    return sc.numeric_leaves(e.select("event_id", F.parse_json(doc).alias("f")), ["event_id"], "f")


# --- acceptance ---


@query("p33_insight_record_issues", """select event_id, concat_ws(',', case when event_type = 'view' then 'insight_type' end, case when event_id % 5 = 0 then 'period' end, case when event_id % 7 = 0 then 'summary' end, case when event_id % 3 = 0 then 'figures' end, case when event_id % 4 = 0 then 'confidence' end) as issues from events""")
def _(c: Corpus):
    i = F.col("event_id")
    e = read(c.spark, c.sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "sighting").otherwise("other").alias("insight_type"), F.lit(None).cast("string").alias("category"),
        F.when(i % 5 == 0, "2024-13-40").otherwise("2024-01-31").alias("period_start"), F.lit("2024-02-29").alias("period_end"), F.when(i % 7 == 0, "  ").otherwise("text").alias("summary"),
        F.parse_json(F.when(i % 3 == 0, "[1]").otherwise(F.col("props"))).alias("figures"), F.parse_json(F.when(i % 4 == 0, "5")).alias("confidence"),
    )
    return e.select("event_id", F.array_join(sc.record_issues(False), ",").alias("issues"))


@query("j25_reference_checks", S.using("""select event_id as insight_id, issue, value from (select event_id, unnest([
    struct_pack(issue := case when event_id % 150 >= 120 then 'unknown_taxon' end, value := 'T' || event_id % 150), struct_pack(issue := case when event_id % 130 >= 120 then 'unknown_related_taxon' end, value := 'T' || event_id % 130),
    struct_pack(issue := case when event_id % 6 = 5 then 'unknown_region' end, value := 'NOWHERE'), struct_pack(issue := case when event_id % 10 = 0 then 'no_query' end, value := null),
    struct_pack(issue := case when event_id % 10 = 1 then 'foreign_query' end, value := cast(-1 as varchar)), struct_pack(issue := case when event_id % 10 > 1 and event_type = 'error' then 'failed_query' end, value := cast(event_id as varchar))], recursive := true) from events) where issue is not null"""))
def _(c: Corpus):
    e = read(c.spark, c.sf_dir, "events")
    i = F.col("event_id")
    regions = read(c.spark, c.sf_dir, "region").select(F.col("r_name").alias("region"))
    cites = F.when(i % 10 == 0, F.array()).when(i % 10 == 1, F.array(F.lit(-1))).otherwise(F.array(i)).cast("array<bigint>")
    a = e.select(
        i.alias("insight_id"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.concat(F.lit("T"), (i % 150).cast("string")).alias("taxon_concept_id"),
        F.array(F.concat(F.lit("T"), (i % 130).cast("string"))).alias("related_taxa"), F.when(i % 6 == 5, "NOWHERE").when(i % 6 == 4, "ASIA").alias("region"), cites.alias("query_ids"),
    )
    q = e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), i.alias("query_id"), F.when(F.col("event_type") == "error", "bad").alias("error"))
    return sc.reference_issues(a, c.taxa, regions, q)


@query("k9_comparison_log", using(f"select 'ai-' || n as ai_run_id, 'calc-1' as calculated_run_id, matched, agreed from ({TOTALS}), (values (1), (2)) v(n)"))
def _(c: Corpus):
    import uuid

    from taxatrend.sources.store import append_comparison

    path = c.ws.path(f"comparisons-{uuid.uuid4().hex}")
    totals = sc.reproduction_totals(sc.reproduction(ai(c), ins(c)))
    row = totals.select(F.lit("calc-1").alias("calculated_run_id"), F.to_json(F.struct("*")).alias("summary"))
    for run in ("ai-1", "ai-2", "ai-1"):  # the last is made again, and stands once
        append_comparison(row.withColumn("ai_run_id", F.lit(run)), path)
    t = c.spark.read.parquet(path)
    return t.select("ai_run_id", "calculated_run_id", *[F.get_json_object("summary", f"$.{x}").cast("bigint").alias(x) for x in ("matched", "agreed")])


@query("f_score_numbers", "select event_id, abs(value - round(value, 1)) <= greatest(0.0015, 0.01 * abs(round(value, 1))) as near, floor(abs(value) * 10 + 0.5) / 10 as rounded from events where value >= 0")
def _(c: Corpus):
    from taxatrend.functions.numeric import close

    e = read(c.spark, c.sf_dir, "events").filter("value >= 0")
    return e.select("event_id", close(F.col("value"), F.round("value", 1)).alias("near"), fixed(F.col("value"), 1).alias("rounded"))
