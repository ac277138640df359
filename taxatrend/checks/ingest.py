"""Checks of scans, mapping, validation, coverage, effort pages and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxatrend.checks import deliveries as dv
from taxatrend.checks import sql as S
from taxatrend.checks.insights import dates
from taxatrend.checks.registry import query
from taxatrend.corpus import Corpus, read
from taxatrend.functions import hashing, text, timefn
from taxatrend.functions.numeric import fixed, text_number
from taxatrend.operators import coverage as cv
from taxatrend.operators import effort as ef
from taxatrend.operators import mapping as mp
from taxatrend.operators import reconcile as rec
from taxatrend.operators import validate as va
from taxatrend.sources import frozen as fr

SEQ = ["snapshot_page", "page_pos"]

# The delivery restated: every line item, repeats included, with what the mapping should give.
DELIVERY = f"""
li as (
  select *, l_partkey % 120 as k, l_orderkey || ':' || l_linenumber as sid, l_orderkey // {dv.ORDERS_PER_PAGE} as base_page,
         -12.0 - (l_orderkey * 7 + l_partkey * 13) % 30 as lat0, l_linenumber as ln, l_orderkey as ok
  from lineitem
),
delivered as (
  select *, base_page + again as page from li, lateral (
    select 0 as again union all select 1 where l_linenumber = 1 and l_orderkey % 20 = 3)
),
mapped as (
  select *, row_number() over (partition by page order by again, ok, ln, l_partkey, l_suppkey, l_quantity, l_shipdate, l_tax) - 1 as page_pos, case when ln = 7 and ok % 50 = 0 then '' else sid end as source_record_id,
         case when ln <> 5 then 'd' || (l_suppkey % 10) end as data_resource_uid,
         case when not (k = 11 and ln = 4) then 'Genus species' || k when ok % 2 = 0 then 'nested' end as scientific_name,
         case when l_partkey % 9 = 0 then 'Common; name-' || k end as vernacular_name,
         case when ln = 6 and ok % 10 = 1 then null when ln < 7 then l_shipdate end as event_date,
         case when ln = 1 and ok % 100 = 7 then 95.0 when ln = 3 and ok % 25 = 0 then null else lat0 end as lat,
         case when ln = 4 and ok % 20 = 1 then 170.0 else 115.0 + l_suppkey % 25 end as lon,
         case when ok % 40 = 9 then -l_quantity when ln <> 7 then l_quantity * 400 end as unc,
         case when ln = 4 and ok % 30 = 2 then -3 else cast(floor(l_quantity + 0.5) as bigint) end as individual_count,
         case ln % 3 when 0 then '0' when 1 then 'Looks strong and healthy' end as remarks,
         case ln when 1 then 'AAA,ZZZ' when 2 then 'AAA' else '' end as assertions
  from delivered
),
kept as (
  select *, source_record_id <> '' and scientific_name is not null and (lat is null or lat <= 90) as is_valid from (
    select *, row_number() over (partition by source_record_id order by page, again, ok, ln, l_partkey, l_suppkey, l_quantity, l_shipdate, l_tax) as rn from mapped) where rn = 1
)"""


def using(select: str, *more: str) -> str:
    return "with " + ",\n".join([DELIVERY, *more]) + "\n" + select


def rows(c: Corpus):
    """Raw rows of all finished runs, with the context their manifests give."""
    root = dv.write_pages(c)
    finished = fr.read_manifests(c.spark, root)
    pages = fr.manifest_pages(finished)
    return fr.with_context(fr.read_pages(c.spark, f"{root}/run=*/pages"), pages)


def adapted(c: Corpus):
    return c.ws.table("adapted", lambda: mp.adapt(rows(c), dv.SALT, dv.AS_OF))


def kept(c: Corpus):
    return c.ws.table("adapted_kept", lambda: mp.first_of_each(adapted(c)))


# --- scans ---


@query("s1_paged_json_scan", using("select 'page=p' || printf('%08d', page) as page, count(*) as records, max(fetched) as fetched_at from (select *, '2001-07-01 00:00:00' as fetched from delivered) group by all"))
def _(c: Corpus):
    return rows(c).groupBy("page").agg(F.count("*").alias("records"), F.max(F.col("fetched_at").cast("string")).alias("fetched_at"))


def bulk(c: Corpus):
    path = dv.write_bulk(c)
    heads = fr.read_headings(c.spark, f"{path}/headings.csv")
    return fr.read_bulk(c.spark, path, heads), heads


BULK = """select ok || ':' || ln as uuid, case when ln <> 4 then 'Genus species' || (l_partkey % 120) end as scientific_name,
  case ln % 3 when 0 then 'said "hi",' || chr(10) || 'then left' when 1 then '0' end as remarks,
  nullif(concat_ws(',', case when ok % 3 = 0 then 'ZERO_COORDINATE' end, case when ln = 2 then 'TAXON_MISSING' end), '') as assertions
  from (select *, l_orderkey as ok, l_linenumber as ln from lineitem)"""


@query("s2_s4_s5_bulk_csv_rows", BULK)
def _(c: Corpus):
    df, heads = bulk(c)
    t = lambda f: F.try_element_at("text", F.lit(f))
    return fr.bulk_rows(fr.require_alignment(df), heads).select(
        t("uuid").alias("uuid"), t("scientificName").alias("scientific_name"), t("occurrenceRemarks").alias("remarks"), F.array_join("assertions", ",").alias("assertions")
    )


@query("s3_header_alignment", "select case l_linenumber % 2 when 0 then 'data.csv' else 'data_1.csv' end as name, count(*) as data_rows, cast(0 as bigint) as misaligned from lineitem group by all")
def _(c: Corpus):
    df, _ = bulk(c)
    name = F.regexp_extract("file", r"/(data[^/]*\.csv)/", 1).alias("name")
    wrong = fr.check_headers(df).groupBy(name).agg(F.count("*").alias("misaligned"))
    return df.filter(~F.col("is_header")).groupBy(name).agg(F.count("*").alias("data_rows")).join(wrong, "name", "left").fillna(0, ["misaligned"])


query("s8_archive_row_count", "select count(*) as n from lineitem")(lambda c: bulk(c)[0].filter(~F.col("is_header")).agg(F.count("*").alias("n")))


@query("c2_bulk_adapt", "select 'atlas:' || l_orderkey || ':' || l_linenumber as record_id, case when l_linenumber <> 4 then 'Genus species' || (l_partkey % 120) end as scientific_name, l_linenumber <> 4 as is_valid, concat_ws(',', case when l_linenumber = 2 then 'TAXON_MISSING' end, case when l_orderkey % 3 = 0 then 'ZERO_COORDINATE' end) as assertions from lineitem")
def _(c: Corpus):
    df, heads = bulk(c)
    raw = fr.bulk_raw(fr.bulk_rows(fr.require_alignment(df), heads)).withColumns({"harvest_id": F.lit("bulk"), "fetched_at": F.lit(None).cast("timestamp")})
    return mp.adapt(raw, dv.SALT, dv.AS_OF).select("record_id", "scientific_name", "is_valid", F.array_join("source_assertions", ",").alias("assertions"))


FACET = "facet as (select strftime(period_start, '%Y-%m') as month, cell_lat, cell_lon, records from effort where taxon_group = 'all')"


@query("s6_facet_scan", S.using("select month, count(*) + 3 as labels, cast(sum(records) + 10 as bigint) as counted from facet group by month", FACET))
def _(c: Corpus):
    return fr.facet_rows(fr.read_facets(c.spark, dv.write_facets(c))).groupBy("month").agg(F.count("*").alias("labels"), F.sum("count").alias("counted"))


@query("a19_effort_cells_from_facets", S.using("select month, cast(cell_lat as double) as cell_lat, cast(cell_lon as double) as cell_lon, cast(records as bigint) as records from facet union all select distinct month, 0.0, 153.1, 5 from facet", FACET))
def _(c: Corpus):
    cells = ef.facet_cells(fr.facet_rows(fr.read_facets(c.spark, dv.write_facets(c))), "all", "facets")
    return cells.select(F.date_format("period_start", "yyyy-MM").alias("month"), F.col("cell_lat").cast("double").alias("cell_lat"), F.col("cell_lon").cast("double").alias("cell_lon"), "records")


@query("a20_effort_reconciliation", S.using("select month, cast(sum(records) + 10 as bigint) as total_records, cast(sum(records) + 5 as bigint) as in_cells, month || ': 5 of its ' || cast(sum(records) + 10 as bigint) || ' records lack a cell' as warning from facet where month < '1998-01' group by month", FACET))
def _(c: Corpus):
    f = fr.read_facets(c.spark, dv.write_facets(c))
    return ef.facet_gaps(f.select("month", "total_records"), ef.facet_cells(fr.facet_rows(f), "all", "facets"))


RUNS = f"""select * from (select page % {dv.RUNS} as run, '2001-07-0' || (page % {dv.RUNS} + 1) || 'T00-00-00' as run_id, count(distinct page) as pages, count(*) as retrieved,
  count(*) + page % {dv.RUNS} as expected from delivered group by page % {dv.RUNS})"""


@query("s7_manifest_list", using(f"select run_id, pages, retrieved, run_id = (select max(run_id) from ({RUNS})) as newest from ({RUNS})"))
def _(c: Corpus):
    m = fr.read_manifests(c.spark, dv.write_pages(c))
    newest = fr.newest_run(m).select(F.col("runId").alias("run_id"), F.lit(True).alias("newest"))
    listed = m.select(F.col("runId").alias("run_id"), F.size("pages").alias("pages"), F.col("retrievedRecords").alias("retrieved"))
    return listed.join(newest, "run_id", "left").fillna(False, ["newest"])


@query("a21_slice_reconciliation", using(f"select run_id, expected, retrieved, case when run > 0 then run_id || ': ' || expected || ' records announced, ' || retrieved || ' received' end as warning from ({RUNS})"))
def _(c: Corpus):
    m = fr.read_manifests(c.spark, dv.write_pages(c))
    expected = m.select(F.col("runId").alias("slice_key"), F.col("expectedRecords").alias("expected_records"))
    pages = fr.manifest_pages(m).select(F.col("runId").alias("slice_key"), F.col("recordCount").alias("record_count"))
    return rec.slice_totals(expected, pages).select(F.col("slice_key").alias("run_id"), F.col("expected_records").alias("expected"), F.col("retrieved_records").alias("retrieved"), "warning")


@query("j27_manifest_pages_missing", using(f"select cast(page % {dv.RUNS} as varchar) as run, 'page=p' || printf('%08d', page) as file from (select distinct page from delivered) where page % 2 = 1"))
def _(c: Corpus):
    root = dv.write_pages(c)
    listed = fr.manifest_pages(fr.read_manifests(c.spark, root))
    found = fr.read_pages(c.spark, f"{root}/run=*/pages").select("run", "page").distinct().filter(F.substring("page", -1, 1).cast("int") % 2 == 0)
    return fr.missing_pages(listed, found).select("run", "file")


# The page bodies restated, byte for byte.
BODY = """'{' || concat_ws(', ',
    case when not (ln = 7 and ok % 50 = 0) then '"uuid": "' || sid || '"' end, '"dataResourceUid": "' || case when ln <> 5 then 'd' || (l_suppkey % 10) else '' end || '"',
    '"dataResourceName": ' || case when ln = 5 then 'null' else '"Dataset ' || (l_suppkey % 10) || '"' end,
    '"scientificName": "' || case when k = 11 and ln = 4 then '  ' when l_partkey % 7 = 0 then ' Genus species' || k || ' ' else 'Genus species' || k end || '"',
    case l_partkey % 9 when 0 then '"vernacularName": [" Common ", "", "name-' || k || '"]' when 1 then '"vernacularName": []' end, '"taxonConceptID": "T' || k || '"',
    case when ln % 2 = 1 then '"classs": "Aves"' else '"class": "Aves"' end, case when l_partkey % 10 <> 9 then '"countryConservation": "Vulnerable"' end,
    '"eventDate": ' || case when ln < 5 then '' || epoch_ms(l_shipdate) when ln = 5 then '"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') || '"' when ln = 6 and ok % 10 = 1 then '"not a date"' when ln = 6 then '"' || epoch_ms(l_shipdate) || '"' end,
    '"decimalLatitude": ' || case when ln = 1 and ok % 100 = 7 then '95.0' when ln = 3 and ok % 25 = 0 then '"abc"' when ln = 2 then '"' || cast(lat0 as double) || '"' else '' || cast(lat0 as double) end,
    '"decimalLongitude": ' || case when ln = 4 and ok % 20 = 1 then '170' else '' || (115 + l_suppkey % 25) end,
    case when ok % 40 = 9 then '"coordinateUncertaintyInMeters": -' || l_quantity when ln <> 7 then '"coordinateUncertaintyInMeters": ' || l_quantity * 400 end, '"stateProvince": "State"',
    '"individualCount": ' || case when ln = 4 and ok % 30 = 2 then '-3' else '' || (l_quantity + 0.5::double) end, '"recordedBy": ["Observer ' || (l_suppkey % 50) || '", "Team"]',
    case ln when 1 then '"assertions": ["ZZZ", "AAA"]' when 2 then '"assertions": ["AAA"]' when 3 then '"assertions": "AAA"' end, '"country": "Australia"', '"point1": "-12,115"', case when ln = 2 then '"mystery": ' || l_tax end,
    '"otherProperties": {"month": "06"' || case when ok % 2 = 0 then ', "scientificName": "nested"' else '' end || case ln % 3 when 0 then ', "raw_occurrenceRemarks": "0"' when 1 then ', "raw_occurrenceRemarks": "Looks strong and healthy"' else '' end || '}') || '}'"""
HASHES = f"""hashes as (
  select page % {dv.RUNS} as run, sha256('{{"totalRecords": 0, "occurrences": [' || string_agg(body, ',' || chr(10) order by again, ok, ln, l_partkey, l_suppkey, l_quantity, l_shipdate, l_tax, body) || ']}}' || chr(10)) as h
  from (select *, {BODY} as body from delivered) group by page
), buckets as (select run, left(h, 2) || ':' || sha256(string_agg(h, chr(10) order by h)) as line from hashes group by run, left(h, 2))"""


@query("a22_corpus_hash", using("select cast(run as varchar) as run, sha256(string_agg(h, chr(10) order by h)) as corpus_hash, count(*) as pages, (select sha256(string_agg(line, chr(10) order by line)) from buckets b where b.run = hashes.run) as tree_hash from hashes group by run", HASHES))
def _(c: Corpus):
    root = dv.write_pages(c)
    finished = fr.read_manifests(c.spark, root).select("run")
    return rec.corpus_hash(rec.page_hashes(c.spark, f"{root}/run=*/pages").withColumn("run", F.regexp_extract("path", r"run=([^/]+)/", 1)).join(finished, "run"))


RUN_SLICES = f"""select '2001-07-0' || (run + 1) || 'T00-00-00' as run_id, run, slice, slice * 7 + count(*) as expected, count(*) as retrieved, count(distinct page) as pages
  from (select page % {dv.RUNS} as run, l_linenumber % 3 as slice, page from delivered) group by run, slice"""


@query("a21_run_totals", using(f"select run, cast(sum(expected) as bigint) as expected_records, cast(sum(retrieved) as bigint) as retrieved_records, count(*) filter (expected <> retrieved) as warnings, bool_and(expected = retrieved) and run <> 1 as complete from ({RUN_SLICES}) where not (run = 2 and slice > 0) group by run"))
def _(c: Corpus):
    r = rows(c).select(F.regexp_extract("page", r"(\d+)", 1).cast("bigint").alias("page"), F.coalesce(F.split(F.try_variant_get(F.try_element_at("raw", F.lit("uuid")), "$", "string"), ":")[1].cast("int"), F.lit(7)).alias("ln"))
    per = r.groupBy((F.col("page") % dv.RUNS).alias("run"), (F.col("ln") % 3).alias("slice"), "page").agg(F.count("*").alias("record_count"))
    per = per.filter("NOT (run = 2 AND slice > 0)").withColumn("slice_key", F.concat_ws("/", "run", "slice"))
    expected = per.groupBy("slice_key", "slice", "run").agg((F.sum("record_count") + F.col("slice") * 7).alias("expected_records"))
    slices = rec.slice_totals(expected.select("slice_key", "expected_records", "run"), per.select("slice_key", "record_count"))
    return rec.run_totals(slices, ["run"], warned=F.col("run") == 1)


@query("a21_download_warnings", """select o_orderkey, case when q is not null and q <> o_custkey or r <> coalesce(q, o_custkey) then false else true end as complete,
  concat_ws('; ', case when r <> coalesce(q, o_custkey) then r || ' rows received of ' || coalesce(q, o_custkey) || ' queued' end, case when q <> o_custkey then o_custkey || ' rows announced, ' || q || ' queued' end) as warnings
  from (select o_orderkey, o_custkey, case when o_orderkey % 3 <> 0 then o_custkey + o_orderkey % 2 end as q, o_custkey + o_orderkey % 5 // 3 as r from orders)""")
def _(c: Corpus):
    ok, n = F.col("o_orderkey"), F.col("o_custkey")
    totals = read(c.spark, c.sf_dir, "orders").select("o_orderkey", n.alias("expected"), F.when(ok % 3 != 0, n + ok % 2).alias("queued"), (n + F.expr("o_orderkey % 5 div 3")).alias("retrieved"))
    return rec.download_warnings(totals).select("o_orderkey", "complete", F.array_join("warnings", "; ").alias("warnings"))


@query("a23_curation_fingerprint", S.using("""select md5(coalesce((select string_agg(concat_ws('|', taxon_concept_id, state_province, ibra_region, data_resource_uid), ';'
  order by taxon_concept_id, state_province, ibra_region nulls last, data_resource_uid nulls last) from rules), '') || '#' ||
  coalesce((select string_agg(data_resource_uid || '=' || kind, ';' order by data_resource_uid) from datasets where kind <> 'wild'), '')) as hash, (select count(*) from rules) as managed_rules"""))
def _(c: Corpus):
    return rec.curation_fingerprint(c.rules, c.datasets)


ORDER_LINE = "concat_ws(chr(31), " + ", ".join(f"coalesce(cast({c} as varchar), chr(0))" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")) + ")"


@query("f_result_fingerprint", f"select count(*) as rows, bit_xor(h) as xor_hash, cast(sum(h % {1 << 31}) as bigint) as sum_hash from (select cast('0x' || left(sha256({ORDER_LINE}), 15) as bigint) as h from orders)")
def _(c: Corpus):
    return rec.row_fingerprint(read(c.spark, c.sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("f_result_hash", """select sha256('{"columns":["n_nationkey","n_name","suppliers"],"rows":' || cast(to_json(list(line order by line)) as varchar) || '}') as result_hash, count(*) as row_count
  from (select cast(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'suppliers': n}) as varchar) as line from nation left join (select s_nationkey, count(*) as n from supplier group by 1) on s_nationkey = n_nationkey)""")
def _(c: Corpus):
    n = read(c.spark, c.sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return rec.result_hash(read(c.spark, c.sf_dir, "nation").join(n, "n_nationkey", "left").select("n_nationkey", "n_name", "suppliers"))


# --- mapping ---


def literal(text: str | None) -> str:
    return "cast(null as varchar)" if text is None else "'" + text.replace("'", "''") + "'"


# The status of every mapped field that the delivery can hold; all others are absent.
STATUS = {
    "provenance.sourceRecordId": "case when ln = 7 and ok % 50 = 0 then 'absent_from_source' else 'mapped' end",
    "provenance.dataResourceUid": "case when ln = 5 then 'empty_in_source' else 'mapped' end",
    "provenance.dataResourceName": "case when ln = 5 then 'empty_in_source' else 'mapped' end",
    "scientificName": "case when k = 11 and ln = 4 and ok % 2 = 1 then 'empty_in_source' when k = 11 and ln = 4 then 'mapped' when l_partkey % 7 = 0 then 'derived' else 'mapped' end",
    "vernacularName": "case when l_partkey % 9 = 0 then 'derived' when l_partkey % 9 = 1 then 'empty_in_source' else 'absent_from_source' end",
    "taxonConceptId": "'mapped'", "taxonClass": "'mapped'", "stateProvince": "'mapped'", "decimalLongitude": "'mapped'", "recordedByPseudonym": "'derived'",
    "nationalStatus": "case when l_partkey % 10 <> 9 then 'mapped' else 'absent_from_source' end",
    "eventDate": "case when ln = 6 and ok % 10 = 1 then 'rejected' when ln = 7 then 'absent_from_source' else 'derived' end",
    "decimalLatitude": "case when ln = 1 and ok % 100 = 7 then 'mapped' when ln = 3 and ok % 25 = 0 then 'rejected' when ln = 2 then 'derived' else 'mapped' end",
    "coordinateUncertaintyInMeters": "case when ln <> 7 or ok % 40 = 9 then 'mapped' else 'absent_from_source' end",
    "individualCount": "case when ln = 4 and ok % 30 = 2 then 'mapped' else 'derived' end",
    "occurrenceRemarks": "case when ln % 3 = 2 then 'absent_from_source' else 'mapped' end",
    "sourceAssertions": "case ln when 1 then 'derived' when 2 then 'mapped' when 3 then 'rejected' else 'absent_from_source' end",
}


def statuses(source: str) -> str:
    """Rows (canonical_field, status, note) for all mapped fields of the records in ``source``."""
    each = ", ".join(f"{{'canonical_field': '{f.path}', 'status': {STATUS.get(f.path, literal('absent_from_source'))}, 'own': {literal(f.note)}}}" for f in mp.sc.MAPPED)
    return f"select canonical_field, status, case when own is not null then own when status = 'rejected' then '{mp.REJECTED_NOTE}' end as note from (select unnest([{each}], recursive := true) from {source})"


ISSUES = """list_filter([case when source_record_id = '' then 'MISSING_SOURCE_RECORD_ID' end, case when scientific_name is null then 'MISSING_SCIENTIFIC_NAME' end,
    case when lat is null then 'MISSING_COORDINATES' end, case when lat > 90 then 'COORDINATES_OUT_OF_RANGE' end,
    case when lat <= 90 and not (lat between -44 and -9 and lon between 112 and 154) then 'OUTSIDE_AUSTRALIA_BBOX' end,
    case when unc < 0 then 'NEGATIVE_UNCERTAINTY' end, case when event_date is null then 'MISSING_EVENT_DATE' end,
    case when event_date > timestamp '2001-06-01' then 'FUTURE_EVENT_DATE' end, case when individual_count < 0 then 'NEGATIVE_INDIVIDUAL_COUNT' end], lambda x: x is not null)"""
#: Fields that no record of the delivery has.
BARE = ["occurrence_id", "license", "taxon_rank", "kingdom", "phylum", "taxon_order", "family", "genus", "first_loaded_at", "ibra_region", "locality", "basis_of_record", "event_remarks"]


def hmac_sql(message: str) -> str:
    """HMAC-SHA256 as two nested digests over padded keys."""
    key = dv.SALT.encode().ljust(64, b"\0")
    inner, outer = ("'" + "".join(f"\\x{b ^ pad:02X}" for b in key) + "'::blob" for pad in (0x36, 0x5C))
    return f"sha256({outer} || unhex(sha256({inner} || encode({message}))))"


OBSERVER = f"'obs_' || left({hmac_sql("'observer ' || l_suppkey % 50 || '|team'")}, 16)"


@query("p9_canonical_projection", using(f"""select 'atlas:' || source_record_id as record_id, 'atlas' as source, source_record_id, data_resource_uid, case when ln <> 5 then 'Dataset ' || (l_suppkey % 10) end as data_resource_name, scientific_name, vernacular_name,
  'T' || k as taxon_concept_id, 'Aves' as taxon_class, case when l_partkey % 10 <> 9 then 'Vulnerable' end as national_status, cast(event_date as varchar) as event_date, cast(lat as double) as decimal_latitude, cast(lon as double) as decimal_longitude,
  unc as coordinate_uncertainty_m, 'State' as state_province, individual_count, {OBSERVER} as recorded_by_pseudonym, remarks as occurrence_remarks, assertions, is_valid, len({ISSUES}) as issue_count,
  'pages/2001-07-0' || (page % {dv.RUNS} + 1) || 'T00-00-00' as harvest_id, 'page=p' || printf('%08d', page) as snapshot_page, page_pos, '2001-07-01 00:00:00' as fetched_at, {", ".join(f"cast(null as varchar) as {c}" for c in BARE)} from kept"""))
def _(c: Corpus):
    text = lambda *names: [F.col(n).cast("string").alias(n) for n in names]
    return kept(c).select(
        "record_id", "source", "source_record_id", "data_resource_uid", "data_resource_name", "scientific_name", "vernacular_name", "taxon_concept_id", "taxon_class", "national_status",
        *text("event_date"), "decimal_latitude", "decimal_longitude", "coordinate_uncertainty_m", "state_province", "individual_count", "recorded_by_pseudonym", "occurrence_remarks",
        F.array_join("source_assertions", ",").alias("assertions"), "is_valid", "issue_count", "harvest_id", "snapshot_page", "page_pos", *text("fetched_at", *BARE),
    )


@query("p2_mapping_trace", using(f"select canonical_field, status, note, count(*) as n from ({statuses('delivered')}) group by all"))
def _(c: Corpus):
    # An explode would bring a filter on the trace, which would be pushed below the mapping and repeat it.
    lines = mp.adapt(rows(c), dv.SALT, dv.AS_OF, full_trace=True).select(F.explode_outer("trace").alias("t"))
    return lines.groupBy("t.canonical_field", "t.status", "t.note").agg(F.count("*").alias("n"))


@query("p1_flatten_nested", using("select 'month' || case ln % 3 when 2 then '' else ',raw_occurrenceRemarks' end || case when k = 11 and ln = 4 and ok % 2 = 0 then ',scientificName' else '' end as lifted, count(*) as n from kept group by all"))
def _(c: Corpus):
    return kept(c).groupBy(F.array_join(F.array_sort("lifted_fields"), ",").alias("lifted")).agg(F.count("*").alias("n"))


@query("p4_excluded_fields", using("select f as field, count(*) as n from kept, (values ('country'), ('month')) v(f) group by f"))
def _(c: Corpus):
    return kept(c).select(F.explode("excluded_fields").alias("e")).groupBy("e.field").agg(F.count("*").alias("n"))


@query("p5_unmapped_fields", using("select concat_ws(',', case ln when 2 then 'mystery' end, case when ok % 2 = 0 and not (k = 11 and ln = 4) then 'otherProperties.scientificName' end) as fields, count(*) as n from kept group by all"))
def _(c: Corpus):
    return kept(c).groupBy(F.array_join(F.transform("unmapped_fields", lambda u: u["field"]), ",").alias("fields")).agg(F.count("*").alias("n"))


@query("p3_multi_input_derive", using("select ln, case when k = 11 and ln = 4 then case ok % 2 when 0 then 'nested' else '' end else 'Genus species' end || case when l_partkey % 9 = 0 then '+vernacular' else '' end as value, count(*) as n from (select * replace (case when ln = 7 and ok % 50 = 0 then 0 else ln end as ln) from delivered) group by all"))
def _(c: Corpus):
    line = mp.derive_field(
        "name", F.col("flat"), ["scientificName", "vernacularName"],
        lambda v: F.concat(F.regexp_extract(F.coalesce(F.try_element_at(v, F.lit("scientificName")), F.lit("")), r"^\D*", 0), F.when(F.map_contains_key(v, "vernacularName"), "+vernacular").otherwise("")),
    )
    d = mp.flatten_rows(rows(c), []).select(line.alias("t"), F.try_element_at("flat", F.lit("uuid"))["text"].alias("u"))
    return d.groupBy(F.coalesce(F.split("u", ":")[1].cast("int"), F.lit(0)).alias("ln"), F.col("t.canonical_value").alias("value")).agg(F.count("*").alias("n"))


@query("p10_observer_pseudonym", using(f"select {OBSERVER} as recorded_by_pseudonym, count(*) as n from kept group by 1"))
def _(c: Corpus):
    return kept(c).groupBy("recorded_by_pseudonym").agg(F.count("*").alias("n"))


@query("p12_p13_validation", using(f"select code, count(*) as n from (select unnest({ISSUES}) as code from kept) group by code union all select 'valid', count(*) from kept where is_valid"))
def _(c: Corpus):
    k = kept(c)
    return cv.validation_counts(k).select("code", F.col("count").alias("n")).unionByName(k.filter("is_valid").select(F.lit("valid").alias("code")).groupBy("code").agg(F.count("*").alias("n")))


@query("p12_unparseable_dates", "select event_type || case event_id % 3 when 0 then ' bad' else '' end as k, case event_id % 3 when 0 then 'UNPARSEABLE_EVENT_DATE' when 1 then 'MISSING_EVENT_DATE' else 'FUTURE_EVENT_DATE' end as code, count(*) as n from events group by all")
def _(c: Corpus):
    e = read(c.spark, c.sf_dir, "events")
    none = {x: F.lit(None).cast(t) for x, t in (("decimal_latitude", "double"), ("decimal_longitude", "double"), ("coordinate_uncertainty_m", "double"), ("individual_count", "bigint"), ("event_date", "timestamp"))}
    bad = F.col("event_id") % 3 == 0
    rowset = e.withColumns({**none, "source_record_id": F.lit("x"), "scientific_name": F.lit("y")}).withColumn("txt", F.when(bad, F.col("event_type")).when(F.col("event_id") % 3 == 2, F.col("ts").cast("string")))
    out = rowset.select(F.concat("event_type", F.when(bad, " bad").otherwise("")).alias("k"), F.explode(va.issues(dv.AS_OF, F.col("txt"))).alias("i"))
    return out.filter(F.col("i.code").endswith("EVENT_DATE")).groupBy("k", F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


def p14_sql() -> str:
    """Every declared field: those the made-up records hold, and the rest, absent."""
    held = {
        "scientificName": ("'ok'", "'string'"), "decimalLatitude": ("case when o_orderkey % 5 = 0 then 'type_mismatch' else 'ok' end", "'number'"),
        "individualCount": ("case when o_orderkey % 2 = 0 then 'ok' else 'type_mismatch' end", "case when o_orderkey % 2 = 0 then 'number' else 'string' end"),
        "provenance.source": ("case when o_orderkey % 3 = 0 then 'missing_required' else 'ok' end", "'string'"),
        "provenance.fetchedAt": ("case when o_orderkey % 4 = 0 then 'ok' else 'type_mismatch' end", "'string'"), "sourceAssertions": ("case when o_orderkey % 4 = 1 then 'type_mismatch' else 'ok' end", "'array'"),
        "locality": ("'empty'", "'null'"), "decimalLongitude": ("'type_mismatch'", "'object'"), "isValid": ("case when o_orderkey % 7 = 0 then 'ok' else 'type_mismatch' end", "case when o_orderkey % 7 = 0 then 'boolean' else 'number' end"),
    }
    lines = []
    for f in mp.sc.FIELDS:
        status, kind = held.get(f.path, (literal("missing_required" if f.required else "empty"), "'absent'"))
        lines.append(f"{{'path': '{f.path}', 'status': {status}, 'actual_type': {kind}}}")
    return f"select path, status, actual_type, count(*) as records from (select unnest([{', '.join(lines)}], recursive := true) from orders) group by all"


@query("p14_schema_conformance", p14_sql())
def _(c: Corpus):
    ok = F.col("o_orderkey")
    pick = lambda when, a, b: F.when(when, a).otherwise(b)
    doc = F.concat(
        F.lit('{"scientificName": "a", "decimalLatitude": '), pick(ok % 5 == 0, "123.5", "-33.5"), F.lit(', "individualCount": '), pick(ok % 2 == 0, "4", '"4"'),
        F.lit(', "locality": null, "decimalLongitude": {"x": 1}, "isValid": '), pick(ok % 7 == 0, "true", "1"), F.lit(', "sourceAssertions": ["A"'), pick(ok % 4 == 1, ", 5]", "]"),
        F.lit(', "provenance": {"source": "'), pick(ok % 3 == 0, "", "atlas"), F.lit('", "fetchedAt": "'), pick(ok % 4 == 0, "2020-01-01T00:00:00.000Z", "yesterday"), F.lit('"}}'),
    )
    return va.schema_conformance(read(c.spark, c.sf_dir, "orders").select(F.parse_json(doc).alias("r")), "r")


@query("p6_p7_p8_coercions", """select event_id, try_cast(json_extract_string(props, '$.k') as double) as num, cast(trunc(try_cast(json_extract_string(props, '$.k') as double) / 7) as bigint) as whole,
  cast(epoch_us(ts) // 1000 as varchar) as instant, length(trim(event_type)) = 0 as blank from events""")
def _(c: Corpus):
    e = read(c.spark, c.sf_dir, "events")
    k = text_number(F.get_json_object("props", "$.k"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    as_text = F.when(F.col("event_id") % 2 == 0, ms.cast("string")).otherwise(timefn.iso_utc(F.timestamp_millis(ms)))
    return e.select("event_id", k.alias("num"), F.floor(k / 7).alias("whole"), F.unix_millis(timefn.text_instant(as_text)).cast("string").alias("instant"), (text.trim_space(F.col("event_type")) == "").alias("blank"))


# --- coverage ---


@query("a18_dedup_summary", using("select (select count(*) from kept) as records_adapted, (select count(*) from kept where is_valid) as records_valid, (select count(*) from kept where not is_valid) as records_with_errors, (select count(*) from mapped) - (select count(*) from kept) as duplicates"))
def _(c: Corpus):
    return mp.adapt_summary(adapted(c), kept(c))


COVERAGE = f"""select canonical_field, {', '.join(f"count(*) filter (status = '{x}') as {x}" for x in cv.STATUSES)}, count(*) as total, count(*) filter (status in ('mapped', 'derived')) as populated,
  {S.fx("count(*) filter (status in ('mapped', 'derived')) / count(*)", 6)} as coverage from ({statuses('kept')}) group by canonical_field"""


@query("a13_field_coverage", using(COVERAGE))
def _(c: Corpus):
    return cv.field_coverage(kept(c)).withColumn("coverage", fixed(F.col("coverage"), 6))


WORDS = "len(regexp_extract_all(t, '[A-Za-z]{2,}'))"
BAND = f"case when t is null or t = '' then 'absent' when {WORDS} = 0 or length(t) < 3 then 'trivial' when length(t) < 20 or {WORDS} < 3 then 'short' else 'substantive' end"
DOCS = f"""docs as (select *, {BAND} as band from (select doc_id, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents))"""


def documents(c: Corpus):
    return read(c.spark, c.sf_dir, "documents")


@query("a14_free_text_bands", "with " + DOCS + """ select source, count(*) as total, count(*) filter (band = 'absent') as absent, count(*) filter (band = 'trivial') as trivial, count(*) filter (band = 'short') as short,
  count(*) filter (band = 'substantive') as substantive, coalesce(median(case when t <> '' then length(t) end), 0) as median_length, coalesce(max(case when t <> '' then length(t) end), 0) as max_length,
  round(count(*) filter (band = 'substantive') / count(*), 9) as substantive_share from docs group by source""")
def _(c: Corpus):
    return cv.text_bands(documents(c), "text", ["doc_id"], ["source"]).withColumn("substantive_share", F.round("substantive_share", 9))


@query("a14_free_text_samples", "with " + DOCS + " select source, band, arg_min(t, doc_id) as sample from docs where band <> 'absent' group by source, band")
def _(c: Corpus):
    return cv.text_samples(documents(c), "text", ["doc_id"], ["source"])


@query("a15_unmapped_excluded_counts", using(f"""select 'mystery' as field, count(*) as records, {S.fx('count(*) / (select count(*) from kept)', 6)} as share from kept where ln = 2
  union all select 'otherProperties.scientificName', count(*), {S.fx('count(*) / (select count(*) from kept)', 6)} from kept where ok % 2 = 0 and not (k = 11 and ln = 4) union all select 'country', count(*), 1.0 from kept union all select 'month', count(*), 1.0 from kept"""))
def _(c: Corpus):
    k = kept(c)
    n = k.count()
    parts = [cv.field_counts(k, x, n, SEQ).select("field", "records", fixed(F.col("share"), 6).alias("share")) for x in ("unmapped_fields", "excluded_fields")]
    return parts[0].unionByName(parts[1])


@query("a16_resource_breakdown", using(f"""select data_resource_uid, coalesce('Dataset ' || data_resource_uid[2:], '(unattributed)') as data_resource_name, count(*) as records, {S.fx('count(*) / (select count(*) from kept)', 6)} as share,
  count(*) filter (remarks like 'Looks%') as substantive_remarks, {S.fx('avg(unc)', 3)} as mean_uncertainty, median(unc) as median_uncertainty, count(*) filter (unc > 10000) as obscured_records from kept group by data_resource_uid"""))
def _(c: Corpus):
    return cv.resource_breakdown(kept(c)).withColumns({"share": fixed(F.col("share"), 6), "mean_uncertainty": fixed(F.col("mean_uncertainty"), 3)})


@query("a17_assertion_counts", using(f"select a as assertion, count(*) as count, {S.fx('count(*) / (select count(*) from kept)', 6)} as share from kept, lateral (select unnest(string_split(assertions, ','))) u(a) where a <> '' group by a"))
def _(c: Corpus):
    k = kept(c)
    return cv.assertion_counts(k, k.count()).withColumn("share", fixed(F.col("share"), 6))


UNMAPPED = """select 'mystery' as field, count(*) as records from kept where ln = 2 union all select 'otherProperties.scientificName', count(*) from kept where ok % 2 = 0 and not (k = 11 and ln = 4)"""
ASSERTED = "select a as assertion, count(*) as n from kept, lateral (select unnest(string_split(assertions, ','))) u(a) where a <> '' group by a"
ALL_KEPT = "(select count(*) from kept)"
C1 = f"""select 'fields' as part, canonical_field as key, populated as n, coverage as figure from ({COVERAGE})
  union all select 'free_text', 'occurrence_remarks', count(*) filter (remarks like 'Looks%'), median(length(remarks)) from kept union all select 'free_text', 'event_remarks', 0, 0
  union all select 'unmapped', field, records, {S.fx(f'records / {ALL_KEPT}', 6)} from ({UNMAPPED})
  union all select 'excluded', unnest(['country', 'month']), {ALL_KEPT}, 1
  union all select 'resources', coalesce('Dataset ' || data_resource_uid[2:], '(unattributed)'), count(*), median(unc) from kept group by data_resource_uid
  union all select 'validation', code, count(*), null from (select unnest({ISSUES}) as code from kept) group by code
  union all select 'assertions', assertion, n, {S.fx(f'n / {ALL_KEPT}', 6)} from ({ASSERTED})"""


@query("c1_corpus_analysis", using(C1))
def _(c: Corpus):
    shown = {
        "fields": ("canonical_field", "populated", "coverage"), "free_text": ("field", "substantive", "median_length"), "unmapped": ("field", "records", "share"), "excluded": ("field", "records", "share"),
        "resources": ("data_resource_name", "records", "median_uncertainty"), "validation": ("code", "count", None), "assertions": ("assertion", "count", "share"),
    }
    out = None
    for name, df in cv.corpus_analysis(kept(c)).items():
        key, n, figure = shown[name]
        one = df.select(F.lit(name).alias("part"), F.col(key).alias("key"), F.col(n).cast("bigint").alias("n"), (fixed(F.col(figure).cast("double"), 6) if figure else F.lit(None).cast("double")).alias("figure"))
        out = one if out is None else out.unionByName(one)
    return out


@query("o9_lowest_coverage", using(f"""select * from (select 'coverage' as list, canonical_field as key, populated as n from ({COVERAGE}) order by coverage, canonical_field limit 18)
  union all select * from (select 'unmapped', field, records from ({UNMAPPED}) order by records desc, field limit 15) union all select * from (select 'assertions', assertion, n from ({ASSERTED}) order by n desc, assertion limit 12)"""))
def _(c: Corpus):
    """The three lists of the corpus report: fields covered worst, unmapped fields and assertions met most."""
    k = kept(c)
    total = k.count()
    lists = {
        "coverage": cv.lowest_coverage(cv.field_coverage(k), 18).select("canonical_field", "populated"),
        "unmapped": cv.field_counts(k, "unmapped_fields", total, SEQ).limit(15).select("field", "records"), "assertions": cv.assertion_counts(k, total).limit(12).select("assertion", "count"),
    }
    out = None
    for name, df in lists.items():
        one = df.toDF("key", "n").select(F.lit(name).alias("list"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("f_hash_functions", "select o_orderkey, md5(o_orderpriority) as md5, sha256(o_orderpriority) as sha256 from orders")
def _(c: Corpus):
    return read(c.spark, c.sf_dir, "orders").select("o_orderkey", F.md5("o_orderpriority").alias("md5"), F.sha2("o_orderpriority", 256).alias("sha256"))


@query("f_hmac", f"select c_custkey, {hmac_sql('c_name')} as hmac from customer")
def _(c: Corpus):
    return read(c.spark, c.sf_dir, "customer").select("c_custkey", hashing.hmac_sha256(F.col("c_name"), dv.SALT).alias("hmac"))


@query("f_month_series", "select strftime(d, '%Y-%m') as month, cast(d as varchar) as period_start, cast(last_day(d) as varchar) as period_end, (select count(*) from lineitem where date_trunc('month', l_shipdate) = d) as records from (select cast(unnest(generate_series(date '1995-01-01', date '2001-12-01', interval 1 month)) as date) as d)")
def _(c: Corpus):
    months = dates(timefn.month_series(c.spark, "1995-01", "2001-12"))
    n = read(c.spark, c.sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("records"))
    return months.join(n, "month", "left").fillna(0, ["records"])
