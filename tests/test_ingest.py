import json

import pytest
from pyspark.sql import functions as F

from taxatrend.operators import mapping as mp
from taxatrend.operators.coverage import corpus_analysis
from taxatrend.operators.effort import facet_cells
from taxatrend.sources import frozen as fr
from taxatrend.sources import store as st
from taxatrend.streaming import increments as inc
from taxatrend.workspace import Workspace, write

RECORDS = [
    {"uuid": "a", "scientificName": "Aus bus", "eventDate": 1577836800000, "decimalLatitude": -33.5, "decimalLongitude": "151", "recordedBy": ["Jo", ""], "assertions": ["B", "A"],
     "individualCount": 2.9, "otherProperties": {"raw_occurrenceRemarks": "said so", "scientificName": "nested", "year": 2020}, "brandNew": 1},
    {"uuid": "a", "scientificName": "repeat"},
    {"scientificName": ["Cus", " ", "dus "], "decimalLatitude": "north", "decimalLongitude": 1, "eventDate": "", "coordinateUncertaintyInMeters": -1, "individualCount": "-2"},
    {"uuid": "c", "decimalLatitude": -120, "decimalLongitude": 10, "eventDate": "2999-01-01T00:00:00Z", "class": "Aves", "classs": ""},
]


@pytest.fixture(scope="module")
def adapted(spark):
    pages = spark.createDataFrame([("p1", json.dumps({"occurrences": RECORDS})), ("p2", json.dumps({"totalRecords": 0}))], "page string, value string")
    rows = fr.page_rows(pages).withColumns({"harvest_id": F.lit("h"), "fetched_at": F.lit(None).cast("timestamp")})
    return mp.adapt(rows, "salt", "2021-01-01", full_trace=True).cache()


def test_mapping(adapted):
    r = adapted.filter("page_pos = 0").first()
    assert (r["record_id"], r["scientific_name"], r["decimal_longitude"], r["individual_count"], r["source_assertions"]) == ("atlas:a", "Aus bus", 151.0, 2, ["A", "B"])
    assert r["occurrence_remarks"] == "said so" and str(r["event_date"]) == "2020-01-01 00:00:00" and r["recorded_by_pseudonym"].startswith("obs_")
    status = {t["canonical_field"]: t["status"] for t in r["trace"]}
    assert status["scientificName"] == "mapped" and status["eventDate"] == "derived" and status["decimalLatitude"] == "mapped"
    assert status["decimalLongitude"] == "derived" and status["sourceAssertions"] == "derived" and status["genus"] == "absent_from_source"
    assert {u["field"] for u in r["unmapped_fields"]} == {"brandNew", "otherProperties.scientificName"}
    assert [e["field"] for e in r["excluded_fields"]] == ["year"] and set(r["lifted_fields"]) == {"raw_occurrenceRemarks", "year"}
    note = {t["canonical_field"]: t["note"] for t in r["trace"]}
    assert note["vernacularName"] is None


def test_faults(adapted):
    r = adapted.filter("page_pos = 2").first()
    assert r["scientific_name"] == "Cus; dus" and r["decimal_latitude"] is None and not r["is_valid"]
    assert {i["code"] for i in r["issues"]} == {"MISSING_SOURCE_RECORD_ID", "MISSING_COORDINATES", "NEGATIVE_UNCERTAINTY", "MISSING_EVENT_DATE", "NEGATIVE_INDIVIDUAL_COUNT"}
    status = {t["canonical_field"]: t["status"] for t in r["trace"]}
    assert status["decimalLatitude"] == "rejected" and status["eventDate"] == "empty_in_source"
    last = adapted.filter("page_pos = 3").first()
    assert {i["code"] for i in last["issues"]} == {"MISSING_SCIENTIFIC_NAME", "COORDINATES_OUT_OF_RANGE", "FUTURE_EVENT_DATE"} and last["taxon_class"] == "Aves"


def test_first_of_each_and_summary(adapted):
    kept = mp.first_of_each(adapted)
    assert sorted(r["page_pos"] for r in kept.select("page_pos").collect()) == [0, 2, 3]
    assert tuple(mp.adapt_summary(adapted, kept).first()) == (3, 1, 2, 1)


def test_corpus_analysis(adapted):
    parts = corpus_analysis(mp.first_of_each(adapted))
    fields = {r["canonical_field"]: r for r in parts["fields"].collect()}
    assert fields["scientificName"]["populated"] == 2 and fields["scientificName"]["absent_from_source"] == 1 and fields["decimalLatitude"]["rejected"] == 1
    text = {r["field"]: r for r in parts["free_text"].collect()}
    assert text["occurrence_remarks"]["absent"] == 2 and text["occurrence_remarks"]["median_length"] == 7 and text["event_remarks"]["median_length"] == 0
    assert parts["resources"].first()["data_resource_name"] == "(unattributed)"


def test_bad_page_fails(spark):
    pages = spark.createDataFrame([("p", "{not json")], "page string, value string")
    with pytest.raises(Exception):
        fr.page_rows(pages).collect()


def test_facet_labels(spark):
    f = spark.createDataFrame([("2020-01", "-0,153.1", 2), ("2020-01", "0,153.1", 3), ("2020-01", "Not supplied", 9), ("2020-01", "-33,151", 1)], "month string, label string, count long")
    assert sorted((str(r["cell_lat"]), r["records"]) for r in facet_cells(f, "all", "h").collect()) == [("-33.0", 1), ("0.0", 5)]


def test_misaligned_header_is_found(spark, tmp_path):
    (tmp_path / "data.csv").write_text("﻿Record ID,Name\n1,\"a\nb\"\n")
    (tmp_path / "data_1.csv").write_text("Record ID,Other\n2,c\n")
    heads = [{"label": "Record ID", "field": "id", "flag": False}, {"label": "Name", "field": "n", "flag": False}]
    bulk = fr.read_bulk(spark, str(tmp_path), heads)
    assert [r["file"].rsplit("/", 1)[1] for r in fr.check_headers(bulk).collect()] == ["data_1.csv"]
    with pytest.raises(ValueError, match="data_1.csv"):
        fr.require_alignment(bulk)
    first = fr.bulk_rows(fr.require_alignment(bulk.filter("file like '%data.csv'")), heads).first()
    assert first["text"] == {"uuid": "1", "n": "a\nb"} and first["assertions"] is None


def test_merge_moves_a_key_between_partitions(spark, tmp_path):
    table, scratch = str(tmp_path / "t"), str(tmp_path / "s")
    write(spark.createDataFrame([("a", 1, 2020), ("b", 1, 2021), ("c", 1, 2022)], "k string, v int, y int"), table, partition_by="y")
    new = spark.createDataFrame([("a", 2, 2021), ("d", 2, 2023)], "k string, v int, y int")
    for _ in range(2):
        st.merge_into(spark, table, new, ["k"], "y", scratch)
        got = sorted((r["k"], r["v"], r["y"]) for r in spark.read.parquet(table).collect())
        assert got == [("a", 2, 2021), ("b", 1, 2021), ("c", 1, 2022), ("d", 2, 2023)]


def test_an_older_run_does_not_replace_a_taxon(spark):
    old = spark.createDataFrame([("T", "new name", "2021-01-01")], "taxon_concept_id string, scientific_name string, status_seen_at string").withColumn("status_seen_at", F.col("status_seen_at").cast("timestamp"))
    met = spark.createDataFrame([("T", "old name", 1), ("U", "first", 1), ("U", "second", 2)], "taxon_concept_id string, scientific_name string, seq int")
    got = {r[0]: r[1] for r in st.upsert_taxa(old, met, ["seq"], F.lit("2020-01-01").cast("timestamp")).collect()}
    assert got == {"T": "new name", "U": "first"}


def test_only_ai_runs_have_a_brief(spark):
    with pytest.raises(ValueError):
        st.open_run(spark, "r", "calculated", "{}", "{}", "2020-01-01", brief="open")
    log = st.open_run(spark, "r", "ai", "{}", "{}", "2020-01-01", brief="open")
    closed = st.close_run(log, "r", "done", "2020-01-02")
    assert [(r["status"], r["brief"]) for r in st.current_runs(log.unionByName(closed)).collect()] == [("done", "open")]


def deliver(spark, root, batches, harvest, files_per_batch=1):
    """Load deliveries one after the other; each restart takes only what is new."""
    src, ws = root / "pages", Workspace(spark, str(root / "ws"))
    for i, records in enumerate(batches):
        sink = inc.occurrence_sink(spark, ws.path("table"), ws.path("scratch"), "salt", "2021-01-01", harvest(i))
        (src / f"page={i}").mkdir(parents=True)
        (src / f"page={i}" / "x.json").write_text(json.dumps({"occurrences": records}))
        if files_per_batch == 1 or i == len(batches) - 1:
            inc.load_increments(inc.page_stream(spark, str(src), files_per_batch), sink, ws.path("checkpoint")).awaitTermination()
    return sorted((r["record_id"], r["scientific_name"] or "") for r in spark.read.parquet(ws.path("table")).collect())


BATCHES = [[RECORDS[0], RECORDS[3]], [{**RECORDS[0], "scientificName": "renamed", "eventDate": 1609459200000}], [{"uuid": "z", "scientificName": "Z"}]]


def test_later_harvests_replace(spark, tmp_path):
    assert deliver(spark, tmp_path, BATCHES, lambda i: f"h{i}") == [("atlas:a", "renamed"), ("atlas:c", ""), ("atlas:z", "Z")]


def test_one_harvest_does_not_depend_on_batches(spark, tmp_path):
    first = deliver(spark, tmp_path / "one", BATCHES, lambda i: "h")
    assert first == [("atlas:a", "Aus bus"), ("atlas:c", ""), ("atlas:z", "Z")] == deliver(spark, tmp_path / "all", BATCHES, lambda i: "h", 10)


def test_no_bare_times_and_own_grammar(spark):
    from taxatrend.functions.timefn import text_instant
    from taxatrend.operators.scoring import grounded_numbers, numeric_leaves, scored_number

    texts = ["12:30", "2020-05-01", "2020-05-01T12:30:00Z", "0", "x", "2020", "05-2020"]
    got = [r[0] is not None for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text_instant(F.col("t"))).collect()]
    assert got == [False, True, True, True, False, True, False]
    numbers = spark.createDataFrame([(t,) for t in ("5", "-2.5e-3", "+5", "5.", ".5", "1e+5")], "t string").select(scored_number(F.col("t")))
    assert [r[0] for r in numbers.collect()] == [5.0, -0.0025, None, None, None, None]
    deep = spark.createDataFrame([('{"a":{"b":{"c":{"d":{"x":5, "s{": "}]"}}}},"y":[1,[[2]]]}',)], "j string").select(F.lit(1).alias("k"), F.parse_json("j").alias("v"))
    assert {(r.path, r.value) for r in numeric_leaves(deep, ["k"], "v").collect()} == {("a.b.c.d.x", 5.0), ("y[0]", 1.0), ("y[1][0][0]", 2.0)}

    import itertools
    import random

    import numpy as np

    rng = random.Random(1)

    def direct(x, places, values):
        near = lambda c: abs(x - c) <= 0.001 * abs(c) or np.sign(c) * np.floor(abs(c) * 10.0**places + 0.5) / 10.0**places == x
        pairs = ((a, b) for a, b in itertools.product(values, values) if b)
        return any(map(near, values)) or any(near(c) for a, b in pairs for c in (a - b, a / b, (a - b) / b, (a - b) / b * 100, a / b * 100))

    asked, given, want = [], [], {}
    for i in range(3000):
        values = [float(rng.choice([0, rng.randint(-50, 50), round(rng.uniform(-1e4, 1e4), 2), 10.0 ** rng.randint(-8, 12)])) for _ in range(rng.randint(0, 5))]
        places = rng.randint(0, 3)
        x = round(rng.choice([0.0, rng.uniform(-60, 60), rng.uniform(-2, 2), rng.uniform(-1e4, 1e4)]), places)
        asked.append((i, x, places))
        given += [(i, v) for v in set(values)]
        want[i] = direct(x, places, values)
    found = grounded_numbers(spark.createDataFrame(asked, "insight_id int, value double, places int"), spark.createDataFrame(given, "insight_id int, n double"))
    rows = [r.insight_id for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {i for i, ok in want.items() if ok} and 300 < len(rows) < 2700


def test_grounded_extents_against_brute_force(spark):
    """Every number of an insight counts, extents of occurrence included."""
    from taxatrend.operators.scoring import grounding, grounding_lines

    figures = '{"eoo_km2": {"baseline": 1204.5, "recent": 963.6, "change": -0.2}, "records": {"baseline": 10, "recent": 7}}'
    ai = spark.createDataFrame([(1, figures, [5]), (2, figures, [])], "insight_id int, f string, query_ids array<int>").withColumn("figures", F.parse_json("f"))
    results = spark.createDataFrame([(5, 0, "a", "1204.49"), (5, 1, "a", "963.6"), (5, 0, "b", "3"), (5, 0, "c", "10")], "query_id int, row int, column string, value string")
    # 7 is 10 - 3; the change is that of the two extents; a query not cited gives nothing.
    assert {(r.insight_id, r.path) for r in grounding_lines(ai, results).collect() if r.ok} == {(1, p) for p in ("eoo_km2.baseline", "eoo_km2.recent", "eoo_km2.change", "records.baseline", "records.recent")}
    assert [(r.numbers, r.grounded) for r in grounding(ai, results).orderBy("insight_id").collect()] == [(5, 5), (5, 0)]


def test_names_in_texts_against_search(spark):
    import random

    from taxatrend.operators.scoring import substring_join

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 9)))
    texts, names = {"".join(word() for _ in range(rng.randint(0, 20))) for _ in range(200)}, {word() for _ in range(150)} | {"", "no such name"}
    got = substring_join(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted((r.text, r["name"]) for r in got.collect()) == sorted((t, n) for t in texts for n in names if n in t)
    assert substring_join(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "name string")).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_missing_pages_are_those_of_their_run(spark):
    from taxatrend.sources.frozen import missing_pages

    listed = spark.createDataFrame([("1", "p"), ("2", "p"), ("2", "q")], "run string, file string")
    found = spark.createDataFrame([("1", "p"), ("2", "q")], "run string, page string")
    assert [(r.run, r.file) for r in missing_pages(listed, found).collect()] == [("2", "p")]


def test_year_partition_is_that_of_the_local_day(spark):
    """An instant of 31 December in UTC is 1 January where the day is counted."""
    from taxatrend.functions.timefn import in_any_window
    from taxatrend.operators.curation import derived_columns
    from taxatrend.params import Window

    df = spark.createDataFrame([("1999-12-31 14:00:00",), ("1999-12-31 12:00:00",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("event_date"), F.lit(-12.05).alias("decimal_latitude"), F.lit(None).cast("double").alias("decimal_longitude"))
    got = derived_columns(df)
    assert sorted((r.event_year, str(r.event_day)) for r in got.collect()) == [(0, "None"), (1999, "1999-12-31"), (2000, "2000-01-01")]
    assert in_any_window(got, Window("2000-01-01", "2000-12-31")).count() == 1


def test_page_context_is_by_run(spark):
    from taxatrend.sources.frozen import with_context

    rows = spark.createDataFrame([("1", "p", 0), ("2", "p", 0), ("3", "p", 0)], "run string, page string, pos int")
    pages = spark.createDataFrame([("1", "p", "2020-01-01T00:00:00Z", "h", "1"), ("2", "p", "2020-02-01T00:00:00Z", "h", "2")], "run string, file string, fetchedAt string, harvestKey string, runId string")
    assert sorted((r.harvest_id, r.fetched_at.month) for r in with_context(rows, pages).collect()) == [("h/1", 1), ("h/2", 2)]


def test_only_window_years_are_read(spark, tmp_path):
    from taxatrend.functions.timefn import in_any_window
    from taxatrend.params import Window

    df = spark.createDataFrame([(y, f"{y}-06-01") for y in range(2000, 2010)], "event_year int, d string").select("event_year", F.col("d").cast("date").alias("event_day"))
    df.write.partitionBy("event_year").parquet(str(tmp_path / "t"))
    got = in_any_window(spark.read.parquet(str(tmp_path / "t")), Window("2001-01-01", "2002-12-31"), Window("2007-01-01", "2007-12-31"))
    assert sorted(r.event_year for r in got.collect()) == [2001, 2002, 2007]
    assert "PartitionFilters: []" not in got._jdf.queryExecution().toString()


def test_a_load_does_not_depend_on_batches_and_can_be_repeated(spark, tmp_path):
    """Runs loaded one by one or at once leave the same tables; a batch that is run again changes nothing."""
    from taxatrend.sources import frozen as fr
    from taxatrend.streaming import load_plan as lp

    def deliver_run(run, records, complete=True):
        pages = tmp_path / "in" / f"run={run}" / "pages" / "page=p1"
        pages.mkdir(parents=True)
        (pages / "x.json").write_text(json.dumps({"occurrences": records}))
        if complete:
            page = {"file": "page=p1", "sliceKey": "all", "recordCount": len(records), "fetchedAt": f"2020-01-0{run}T00:00:00Z", "contentHash": "h", "bytes": 1}
            doc = {"runId": f"2020-01-0{run}T00-00-00", "harvestKey": "k", "source": "atlas", "finishedAt": f"2020-01-0{run}T01:00:00.000Z", "expectedRecords": 2, "retrievedRecords": 2, "complete": True, "slices": [], "pages": [page], "requestCount": 1, "warnings": []}
            (pages.parent.parent / "manifest.json").write_text(json.dumps(doc))

    record = lambda uuid, name, day, uid: {"uuid": uuid, "scientificName": name, "taxonConceptID": "T1", "eventDate": day, "decimalLatitude": -30.04, "decimalLongitude": 150.0, "dataResourceUid": uid, "stateProvince": "S"}
    deliver_run(1, [record("a", "Aus bus", "1999-12-31T14:00:00Z", "d1"), record("b", "Aus bus", "1999-06-01T00:00:00Z", "d0")])
    deliver_run(2, [record("a", "Aus cus", "1999-12-31T12:00:00Z", "d1"), record("c", "Aus cus", "2001-06-01T00:00:00Z", "d2")])
    deliver_run(3, [record("z", "never loaded", "2001-06-01T00:00:00Z", "d9")], complete=False)
    rules = spark.createDataFrame([("T1", "S", None, "d2")], "taxon_concept_id string, state_province string, ibra_region string, data_resource_uid string")
    curated = spark.createDataFrame([("d0", None, "telemetry", "tracking")], "data_resource_uid string, name string, kind string, kind_reason string")

    def tables(store):
        occ = spark.read.parquet(store.occurrences)
        return (
            sorted((r.record_id, r.scientific_name, r.event_year, str(r.event_day), r.managed_by_rule, r.harvest_id) for r in occ.collect()),
            sorted((r.data_resource_uid, r.kind) for r in store.datasets(spark).collect()), [(r.taxon_concept_id, r.scientific_name) for r in store.taxa(spark).collect()],
            sorted((r.harvest_id, json.loads(r.analysis)["records_adapted"], len(json.loads(r.analysis)["fields"])) for r in store.runs(spark).collect()),
        )

    found = []
    for name, at_once in (("one", 1), ("all", 9)):
        store = lp.Store(str(tmp_path / name), "salt", "2021-01-01", "2021-01-01 00:00:00")
        store.seed(curated)
        lp.load_runs(spark, str(tmp_path / "in"), store, rules, at_once).awaitTermination()
        found.append(tables(store))
    assert found[0] == found[1]
    occ, datasets, taxa, runs = found[0]
    assert [r[:5] for r in occ] == [("atlas:a", "Aus cus", 1999, "1999-12-31", False), ("atlas:b", "Aus bus", 1999, "1999-06-01", False), ("atlas:c", "Aus cus", 2001, "2001-06-01", True)]
    assert datasets == [("d0", "telemetry"), ("d1", "wild"), ("d2", "wild")] and taxa == [("T1", "Aus cus")]
    assert [r[:2] for r in runs] == [("k/2020-01-01T00-00-00", 2), ("k/2020-01-02T00-00-00", 2)] and all(r[2] == 30 for r in runs)
    again = spark.read.text(str(tmp_path / "in" / "run=*" / "manifest.json"), wholetext=True).select(fr.run_of_path(), "value")
    lp.run_sink(spark, str(tmp_path / "in"), store, rules)(again, 0)
    assert tables(store) == found[1]
    assert not [p for p in (tmp_path / "all" / "scratch").iterdir()]


def test_pages_are_written_record_by_record(spark, tmp_path):
    """No page is held as one value: its lines are sorted rows, equal ones included, and its file is one JSON document."""
    import hashlib
    from datetime import datetime

    from taxatrend.checks import deliveries as dv
    from taxatrend.corpus import Corpus

    day = datetime(1999, 6, 1)
    line = lambda ok, ln: (ok, 5, 7, ln, 3.0, 0.02, day)
    given = [line(ok, ln) for ok in (3, 23, 999, 1003, 2999, 4001) for ln in (2, 1, 7)] + [line(1003, 1)] * 3 + [(3, None, 7, 1, None, None, None)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_shipdate timestamp_ntz"
    spark.createDataFrame(given, schema).repartition(3).write.parquet(str(tmp_path / "in" / "lineitem.parquet"))
    lines = dv.page_lines(dv.delivered(spark.read.parquet(str(tmp_path / "in" / "lineitem.parquet"))))
    assert "collect_list" not in lines._jdf.queryExecution().toString()
    c = Corpus(Workspace(spark, str(tmp_path / "ws")), str(tmp_path / "in"))
    root = dv.write_pages(c)
    again = [(ok // 1000 + 1, 1, ok, ln) for ok, _, _, ln, *_ in given if ln == 1 and ok % 20 == 3]
    want = {}
    for page, *place in sorted([(ok // 1000, 0, ok, ln) for ok, _, _, ln, *_ in given] + again):
        want.setdefault(page, []).append((place[1], place[2]))
    for m in fr.read_manifests(spark, root).collect():
        for p in m.pages:
            number = int(p.file.removeprefix("page=p"))
            (path,) = (tmp_path / "ws" / "delivery" / f"run={m.run}" / "pages" / p.file).glob("part-*")
            text = path.read_text()
            records = json.loads(text)["occurrences"]
            assert [tuple(map(int, r["uuid"].split(":"))) for r in records] == want.pop(number) and p.recordCount == len(records) and number % 4 == int(m.run)
            assert text.endswith("]}\n") and (p.contentHash, p.bytes) == (hashlib.sha256(text[:-1].encode()).hexdigest(), len(text) - 1)
    assert not want
    assert {r.page for r in fr.read_pages(spark, f"{root}/run=4/pages").collect()} == {"page=p00000000"}
