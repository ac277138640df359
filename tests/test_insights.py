"""Edge cases of the insights on hand-made records."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from taxatrend.operators import curation as cu
from taxatrend.operators import notable as nt
from taxatrend.operators import range_change as rc
from taxatrend.operators import reporting_rate as rr
from taxatrend.operators import silent as si
from taxatrend.params import Params, Window

P = replace(
    Params(), report_month="2024-06", tier_min_records=1, min_detections=1, rate_min_records=1,
    baseline_window=Window("2017-01-01", "2019-12-31"), recent_window=Window("2022-01-01", "2024-12-31"),
)
COLS = "record_id string, taxon_concept_id string, data_resource_uid string, event_date string, decimal_latitude double, decimal_longitude double, coordinate_uncertainty_m double, state_province string, ibra_region string, is_valid boolean"


def occurrences(spark, rows):
    df = spark.createDataFrame(rows, COLS).withColumn("event_date", F.col("event_date").cast("timestamp")).withColumn("managed_by_rule", F.lit(False))
    return cu.derived_columns(df)


def rec(i, day, uid="d1", lat=-33.85, lon=151.25, unc=10.0, state="NSW", region="R1", taxon="T1", valid=True):
    return (str(i), taxon, uid, day, lat, lon, unc, state, region, valid)


@pytest.fixture(scope="module")
def dims(spark):
    taxa = spark.createDataFrame(
        [("T1", "Sci one", "Common one", "Animalia", "Aves", "Vulnerable"), ("T2", "Sci two", None, "Plantae", "X", None)],
        "taxon_concept_id string, scientific_name string, vernacular_name string, kingdom string, taxon_class string, national_status string",
    )
    ds = spark.createDataFrame([("d1", "wild"), ("tel", "telemetry"), ("man", "managed")], "data_resource_uid string, kind string")
    return taxa, ds


def test_analysable(spark, dims):
    occ = occurrences(spark, [rec(1, "2020-01-01"), rec(2, "2020-01-01", uid="tel"), rec(3, "2020-01-01", uid=None), rec(4, None), rec(5, "2020-01-01", valid=False), rec(6, "2020-01-01", uid="man")])
    got = {r["record_id"]: r["population"] for r in cu.analysable(occ, dims[1]).collect()}
    assert got == {"1": "wild", "3": "wild", "6": "managed"}


def test_two_rules_flag_a_record_once(spark):
    rules = spark.createDataFrame([("T1", "NSW", None, None), ("T1", "NSW", "R1", "d1"), ("T1", "VIC", "R9", None)], "taxon_concept_id string, state_province string, ibra_region string, data_resource_uid string")
    occ = occurrences(spark, [rec(1, "2020-01-01"), rec(2, "2020-01-01", state="VIC"), rec(3, "2020-01-01", state="VIC", region=None), rec(4, "2020-01-01", state="VIC", region="R9")])
    out = cu.managed_flag(occ, rules)
    assert {r["record_id"]: r["managed_by_rule"] for r in out.collect()} == {"1": True, "2": False, "3": False, "4": True}
    assert {r["record_id"] for r in cu.managed_changes(occ, rules).collect()} == {"1", "4"}
    assert cu.managed_changes(out, rules).count() == 0


def test_silent_taxon_without_records(spark, dims):
    occ = occurrences(spark, [rec(1, "2024-06-01"), rec(2, "2018-01-01", unc=None)])
    rows = {r["taxon_concept_id"]: r for r in si.national(cu.analysable(occ, dims[1]), dims[0], P).collect()}
    none = rows["T2"]["figures"]
    assert (none["kind"], none["evidence_gap"], none["records_since_2015"], none["last_record_date"]) == ("silent", True, 0, None)
    assert rows["T2"]["confidence"]["share_imprecise"] is None
    assert rows["T2"]["summary"] == "Sci two (status unknown) went unrecorded for the 36 months up to 2024-06-30, with no usable record from 2015 on. Its whole series counts 0 from 2015 on."
    assert rows["T1"]["figures"]["kind"] == "evidence_gap" and rows["T1"]["confidence"]["share_imprecise"] == 0.5


def test_more_detections_than_visits_raise_no_flag(spark, dims):
    rows = [rec(i, f"2018-0{i}-01", lat=-30.0 - i) for i in range(1, 6)] + [rec(i + 10, f"2023-0{i}-01", lat=-30.0 - i) for i in range(1, 9)]
    records = cu.analysable(occurrences(spark, rows), dims[1])
    tiers = cu.taxon_tiers(records, dims[0], P)
    # Effort knows of fewer visits than there are detections: the variance is negative.
    effort = spark.createDataFrame(
        [("Aves", "-31.0", "151.3", "2018-01-01", "2018-01-31", 5), ("Aves", "-31.0", "151.3", "2023-01-01", "2023-01-31", 5)], "taxon_group string, cell_lat string, cell_lon string, period_start string, period_end string, records int"
    ).withColumns({"cell_lat": F.col("cell_lat").cast("decimal(4,1)"), "cell_lon": F.col("cell_lon").cast("decimal(4,1)"), "period_start": F.col("period_start").cast("date"), "period_end": F.col("period_end").cast("date")})
    got = rr.reporting_rate(rr.visits(records, tiers, P), dims[0], effort, P, regional=False).first()["figures"]
    assert got["detections"] == (5, 8) and got["visits"] == (1, 1)
    assert got["detection_ratio"] == 1.6 and got["detection_ratio_ci95"] is None and got["flag"] is None


def test_records_of_no_dataset_are_never_consistent(spark, dims):
    rows = [rec(1, "2018-01-01", uid=None), rec(2, "2023-01-01", uid=None), rec(3, "2018-01-01"), rec(4, "2023-01-01")]
    records = cu.analysable(occurrences(spark, rows), dims[1])
    v = rr.in_scope(rr.visits(records, cu.taxon_tiers(records, dims[0], P), P), False)
    assert [r["data_resource_uid"] for r in rr.consistent_sources(rr.source_windows(v)).collect()] == ["d1"]


def test_records_of_no_dataset_count_as_discontinued(spark, dims):
    rows = [rec(1, "2018-01-01", uid=None), rec(2, "2023-01-01", uid=None), rec(3, "2018-01-01"), rec(4, "2023-01-01")]
    records = cu.analysable(occurrences(spark, rows), dims[1])
    got = rc.discontinued(rc.windowed(records, cu.taxon_tiers(records, dims[0], P), P)).collect()
    assert {(r["data_resource_uid"], r["win"]): r["from_discontinued"] for r in got} == {(None, "baseline"): True, (None, "recent"): True, ("d1", "baseline"): False, ("d1", "recent"): False}


def test_range_change_of_a_taxon_seen_in_one_window(spark, dims):
    rows = [rec(i, "2018-01-01", lat=-30.0 - i, unc=-5.0 if i else None) for i in range(3)]
    records = cu.analysable(occurrences(spark, rows), dims[1])
    effort = spark.createDataFrame([], "taxon_group string, cell_lat decimal(4,1), cell_lon decimal(4,1), period_start date, period_end date, records int")
    f = rc.range_change(records, dims[0], cu.taxon_tiers(records, dims[0], P), effort, P).first()
    assert f["figures"]["aoo_10km_km2"] == (300, 0, -1.0) and f["figures"]["eoo_km2"]["change"] is None and f["figures"]["flag"] is None
    assert f["confidence"]["precise_share"] == (0.667, None)  # a negative uncertainty counts as precise
    assert f["confidence"]["national_effort_ratio"] is None


def test_notable_checks(spark, dims):
    rows = [
        rec(1, "2024-06-05"),  # 0.05 degrees from an earlier wild record
        rec(2, "2024-06-06", lat=-20.0, region="R2"),  # only telemetry was near, but the region has been seen through it
        rec(3, "2024-06-07", lat=-10.0, region=None, state="QLD"), rec(4, "2024-06-08", lat=-10.0, region=None, state="NT"), rec(5, "2024-06-09", lat=-10.0, region=None, state=None),
        rec(6, "2024-06-09", taxon="T2", uid="man"),  # no earlier record at all
        rec(7, "2020-01-01", lat=-33.9), rec(8, "2020-01-01", uid="tel", lat=-20.0, region="R2"),
    ]
    occ = occurrences(spark, rows)
    records = cu.analysable(occ, dims[1])
    tiers = cu.taxon_tiers(records, dims[0], P)
    got = {r["record_id"]: r for r in nt.checked(occ, records, dims[1], tiers, P).collect()}
    assert not got["1"]["outside_range"] and got["1"]["nearest_km"] == pytest.approx(5.55, abs=0.1)
    assert got["2"]["outside_range"] and not got["2"]["new_region"]
    assert got["3"]["region_seen"] and got["6"]["nearest_km"] is None and got["6"]["outside_range"] and got["6"]["new_region"]
    out = nt.notable_records(occ, records, dims[1], dims[0], tiers, P).collect()
    # Three places without a region stay three findings of one taxon.
    assert sorted((r["taxon_concept_id"], r["region"] or "", r["figures"]["state_province"] or "") for r in out) == [("T1", "", ""), ("T1", "", "NT"), ("T1", "", "QLD"), ("T1", "R2", "NSW"), ("T2", "R1", "NSW")]
    lone = next(r for r in out if r["taxon_concept_id"] == "T2")
    assert lone["summary"].endswith("over 100 km away from every earlier record; 1 of them managed.") and lone["figures"]["max_distance_to_prior_km"] is None
    assert any("no assigned region" in r["summary"] for r in out) and any("QLD (no bioregion)" in r["summary"] for r in out)
