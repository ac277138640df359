"""Quoted CSV in byte ranges against Python's reader, wherever the ranges' borders fall."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from taxatrend.sources import frozen as fr
from taxatrend.sources.split_csv import csv_records, file_lines, ranges_within_quotes


@pytest.fixture
def ranges_of(spark):
    """Byte ranges of a given length."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(folder, seed, rows=40, end="\n"):
    rng = random.Random(seed)
    cells = ["", "plain", 'said "hi"', "two\nlines", "a,b", "\n\n", "é日本", '"', "x" * 90, "line\n" * 40]
    table = [["id", "name", "name", "note"]] + [[f"r{i}", *[rng.choice(cells) for _ in range(3)]] for i in range(rows)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(table)
    (folder / f"data_{seed}.csv").write_bytes(("﻿" + out.getvalue()).encode())
    return table


@pytest.mark.parametrize("length", [61, 4096])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_against_a_whole_reader(spark, tmp_path, ranges_of, length, end):
    ranges_of(length)
    tables = {f"data_{seed}.csv": written(tmp_path, seed, end=end) for seed in (1, 2)}
    got = csv_records(spark, f"{tmp_path}/data*.csv").withColumn("name", F.regexp_extract("file", "[^/]*$", 0)).collect()
    for name, table in tables.items():
        mine = [r.record for r in sorted((r for r in got if r["name"] == name), key=lambda r: r.pos)]
        assert list(csv.reader(io.StringIO("\n".join(mine), newline=""))) == table
        assert len({r.pos for r in got if r["name"] == name}) == len(table)


def test_one_file_feeds_many_tasks(spark, tmp_path, ranges_of):
    ranges_of(200)
    written(tmp_path, 1)
    lines = file_lines(spark, f"{tmp_path}/data*.csv")
    assert lines.rdd.getNumPartitions() > 10
    within = ranges_within_quotes(lines).collect()
    assert len(within) > 10 and any(r.within for r in within) and not all(r.within for r in within)


def test_bulk_rows_do_not_depend_on_the_ranges(spark, tmp_path, ranges_of):
    table = written(tmp_path, 7)
    (tmp_path / "headings.csv").write_text("Column name,Requested field,Field name\nid,id,id\nname,scientificName,scientificName\nname,vernacularName,vernacularName\nnote,NOTE_FLAG,\n")
    heads = fr.read_headings(spark, f"{tmp_path}/headings.csv")
    found = []
    for n in (150, 1 << 20):
        ranges_of(n)
        bulk = fr.require_alignment(fr.read_bulk(spark, str(tmp_path), heads))
        assert bulk.count() == len(table) and bulk.filter("is_header").count() == 1
        found.append([(r["text"], r["assertions"]) for r in fr.bulk_rows(bulk, heads).orderBy("pos").collect()])
    assert found[0] == found[1] and [t["uuid"] for t, _ in found[0]] == [r[0] for r in table[1:]]
    assert [t.get("scientificName") for t, _ in found[0]] == [r[1] or None for r in table[1:]]
