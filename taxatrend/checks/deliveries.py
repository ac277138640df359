"""Deliveries written from the benchmark tables in the formats the sources use, faults included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxatrend.corpus import Corpus, read

ORDERS_PER_PAGE = 1000
#: Pages are dealt to so many finished runs; one more, of the first page, is still being written and has no manifest.
RUNS = 4
FETCHED = "2001-07-01T00:00:00.000Z"
SALT = "check-salt"
AS_OF = "2001-06-01 00:00:00"
HARVEST = "pages"


def _text(c) -> F.Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


#: What orders the records of a page. Bodies follow from these columns alone.
SEQ = ["again", "ok", "ln", "pk", "sk", "q", "day", "tax"]


def delivered(li: DataFrame) -> DataFrame:
    """One row per line item, and a repeat of some on the next page: what a body is made of, and the page it lies on."""
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    repeats = F.when((ln == 1) & (ok % 20 == 3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    given = li.select(
        ok.alias("ok"), ln.alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").alias("q"), F.col("l_shipdate").alias("day"),
        F.col("l_tax").alias("tax"), F.explode(repeats).alias("again"),
    )
    page = F.floor(F.col("ok") / ORDERS_PER_PAGE) + F.col("again")
    return given.select(*SEQ, (page % RUNS).alias("run"), F.format_string("p%08d", page).alias("page"))


def raw_json() -> F.Column:
    """The JSON record of a row of ``delivered``."""
    ok, ln, pk, sk, q = (F.col(c) for c in ("ok", "ln", "pk", "sk", "q"))
    k = (pk % 120).cast("string")
    s = lambda c: c.cast("string")
    ms = s(F.unix_millis(F.col("day").cast("timestamp")))
    iso = _text(F.date_format(F.col("day"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    lat = s((F.lit(-12) - (ok * 7 + pk * 13) % 30).cast("double"))
    fields = {
        "uuid": F.when(~((ln == 7) & (ok % 50 == 0)), _text(F.concat(s(ok), F.lit(":"), s(ln)))),
        "dataResourceUid": F.when(ln == 5, '""').otherwise(_text(F.concat(F.lit("d"), s(sk % 10)))),
        "dataResourceName": F.when(ln == 5, "null").otherwise(_text(F.concat(F.lit("Dataset "), s(sk % 10)))),
        "scientificName": F.when((pk % 120 == 11) & (ln == 4), '"  "').when(pk % 7 == 0, _text(F.concat(F.lit(" Genus species"), k, F.lit(" "))))
        .otherwise(_text(F.concat(F.lit("Genus species"), k))),
        "vernacularName": F.when(pk % 9 == 0, F.concat(F.lit('[" Common ", "", "name-'), k, F.lit('"]'))).when(pk % 9 == 1, "[]"),
        "taxonConceptID": _text(F.concat(F.lit("T"), k)),
        "classs": F.when(ln % 2 == 1, '"Aves"'),
        "class": F.when(ln % 2 == 0, '"Aves"'),
        "countryConservation": F.when(pk % 10 != 9, '"Vulnerable"'),
        "eventDate": F.when(ln < 5, ms).when(ln == 5, iso).when((ln == 6) & (ok % 10 == 1), '"not a date"').when(ln == 6, _text(ms)),
        "decimalLatitude": F.when((ln == 1) & (ok % 100 == 7), "95.0").when((ln == 3) & (ok % 25 == 0), '"abc"').when(ln == 2, _text(lat)).otherwise(lat),
        "decimalLongitude": F.when((ln == 4) & (ok % 20 == 1), "170").otherwise(s((F.lit(115) + sk % 25).cast("int"))),
        "coordinateUncertaintyInMeters": F.when(ok % 40 == 9, F.concat(F.lit("-"), s(q))).when(ln != 7, s(q * 400)),
        "stateProvince": F.lit('"State"'),
        "individualCount": F.when((ln == 4) & (ok % 30 == 2), "-3").otherwise(s(q + 0.5)),
        "recordedBy": F.concat(F.lit('["Observer '), s(sk % 50), F.lit('", "Team"]')),
        "assertions": F.when(ln == 1, '["ZZZ", "AAA"]').when(ln == 2, '["AAA"]').when(ln == 3, '"AAA"'),
        "country": F.lit('"Australia"'),
        "point1": F.lit('"-12,115"'),
        "mystery": F.when(ln == 2, s(F.col("tax"))),
        "otherProperties": F.concat(
            F.lit('{"month": "06"'),
            F.when(ok % 2 == 0, ', "scientificName": "nested"').otherwise(""),
            F.when(ln % 3 == 0, ', "raw_occurrenceRemarks": "0"').when(ln % 3 == 1, ', "raw_occurrenceRemarks": "Looks strong and healthy"').otherwise(""),
            F.lit("}"),
        ),
    }
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{name}": '), v)) for name, v in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def page_lines(rows: DataFrame) -> DataFrame:
    """The lines of the page files, a record each, in their order: ``page``, ``value``.

    A page is never held as one value: rows are dealt and sorted by what their bodies are made of, and become text on their way into the file.
    """
    w = Window.partitionBy("page").orderBy(*SEQ)
    placed = rows.withColumns({"_nth": F.row_number().over(w), "_last": F.lead(F.lit(1)).over(w).isNull()}).sortWithinPartitions("page", "_nth")
    head = F.when(F.col("_nth") == 1, '{"totalRecords": 0, "occurrences": [').otherwise("")
    return placed.select("page", F.concat(head, raw_json(), F.when(F.col("_last"), "]}").otherwise(",")).alias("value"))


def write_pages(c: Corpus) -> str:
    """Freeze the pages, one file each, and a manifest per finished run. Returns the delivery's folder.

    A page holds the records of a fixed number of orders, so pages are many, not large.
    """
    root = c.ws.path("delivery")
    if "delivery" not in c.ws.marks:
        rows = delivered(read(c.spark, c.sf_dir, "lineitem"))
        freeze = lambda df, run: page_lines(df).write.mode("overwrite").partitionBy("page").text(f"{root}/run={run}/pages")
        for run in range(RUNS):
            one = rows.filter(F.col("run") == run)
            freeze(one, run)
            manifest(frozen_pages(one, f"{root}/run={run}/pages"), run).write.mode("overwrite").text(f"{root}/run={run}/manifest.json")
        first = rows.agg(F.min("page")).first()[0]
        freeze(rows.filter(F.col("page") == first), RUNS)
        c.ws.marks.add("delivery")
    return root


def frozen_pages(rows: DataFrame, path: str) -> DataFrame:
    """Per page of a run its records, and hash and bytes of its file but for the line break that ends it."""
    files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    body = F.substring("content", 1, F.length("content") - 1)
    found = files.select(F.regexp_extract("path", r"/page=([^/]+)/", 1).alias("page"), F.sha2(body, 256).alias("hash"), (F.col("length") - 1).cast("int").alias("bytes"))
    return rows.groupBy("page").agg(F.count("*").alias("record_count")).join(found, "page")


def manifest(pages: DataFrame, run: int) -> DataFrame:
    """The manifest is one JSON document listing a run's pages; one document is one row."""
    page = F.struct(
        F.concat(F.lit("page="), F.col("page")).alias("file"), F.lit("all").alias("sliceKey"), F.col("record_count").alias("recordCount"),
        F.lit(FETCHED).alias("fetchedAt"), F.col("hash").alias("contentHash"), "bytes",
    )
    agg = pages.agg(F.sort_array(F.collect_list(page)).alias("pages"), F.sum("record_count").alias("n"), F.count("*").alias("np"))
    doc = F.struct(
        F.lit(f"2001-07-0{run + 1}T00-00-00").alias("runId"), F.lit(HARVEST).alias("harvestKey"), F.lit("atlas").alias("source"),
        F.lit("2001-07-01T00:00:00.000Z").alias("startedAt"), F.lit(f"2001-07-0{run + 1}T00:00:00.000Z").alias("finishedAt"),
        (F.col("n") + run).alias("expectedRecords"), F.col("n").alias("retrievedRecords"), F.lit(run == 0).alias("complete"),
        F.array(F.struct(F.lit("all").alias("sliceKey"), (F.col("n") + run).alias("expectedRecords"), F.col("n").alias("retrievedRecords"), F.col("np").alias("pages"))).alias("slices"),
        "pages", F.col("np").alias("requestCount"), F.array().cast("array<string>").alias("warnings"),
    )
    return agg.select(F.to_json(doc).alias("value"))


def write_facets(c: Corpus) -> str:
    """Facet pages of group 'all', one per month, with records in no cell and a signed zero."""
    path = c.ws.path("facets")
    if "facets" not in c.ws.marks:
        e = c.effort.filter(F.col("taxon_group") == "all").select(F.date_format("period_start", "yyyy-MM").alias("month"), "cell_lat", "cell_lon", "records")
        short = lambda x: F.regexp_replace(F.col(x).cast("string"), r"\.0$", "")
        facet = F.struct(F.concat(short("cell_lat"), F.lit(","), short("cell_lon")).alias("label"), F.col("records").alias("count"))
        months = e.groupBy("month").agg(F.sort_array(F.collect_list(facet)).alias("cells"), F.sum("records").alias("n"))
        extra = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(n).alias("count")) for label, n in (("Not supplied", 5), ("-0,153.1", 2), ("0,153.1", 3))])
        doc = F.struct(
            (F.col("n") + F.when(F.col("month") < "1998-01", 5).otherwise(0) + 5).alias("totalRecords"),
            F.array(F.struct(F.lit("point-0.1").alias("fieldName"), F.concat("cells", extra).alias("fieldResult"))).alias("facetResults"),
        )
        months.select("month", F.to_json(doc).alias("value")).repartition("month").write.mode("overwrite").partitionBy("month").text(path)
        c.ws.marks.add("facets")
    return path


LABELS = ["Record ID", "Scientific name", "Scientific name", "Remarks", "Zero coordinates", "Taxon missing"]
REQUESTED = ["id", "scientificName", "raw_scientificName", "occurrenceRemarks", "ZERO_COORDINATE", "TAXON_MISSING"]
INDEXED = ["id", "scientificName", "raw_scientificName", "occurrenceRemarks", "", ""]


def write_bulk(c: Corpus) -> str:
    """Two bulk CSV files with repeated labels, quality-flag columns and quoted line breaks, and headings.csv."""
    path = c.ws.path("bulk")
    if "bulk" not in c.ws.marks:
        li = read(c.spark, c.sf_dir, "lineitem")
        ln, ok = F.col("l_linenumber"), F.col("l_orderkey")
        cols = [f"c{i}" for i in range(len(LABELS))]
        rows = li.select(
            (ln % 2).alias("odd"),
            F.concat(ok.cast("string"), F.lit(":"), ln.cast("string")).alias("c0"),
            F.when(ln != 4, F.concat(F.lit("Genus species"), (F.col("l_partkey") % 120).cast("string"))).alias("c1"),
            F.lit("as given").alias("c2"),
            F.when(ln % 3 == 0, 'said "hi",\nthen left').when(ln % 3 == 1, "0").alias("c3"),
            F.when(ok % 3 == 0, "true").when(ok % 3 == 1, "false").alias("c4"),
            F.when(ln == 2, "true").alias("c5"),
        )
        labels = list(LABELS)

        def with_header(batches):
            import pandas as pd

            yield pd.DataFrame([labels], columns=cols)
            yield from batches

        for i, name in enumerate(("data.csv", "data_1.csv")):
            part = rows.filter(F.col("odd") == i).select(*cols).mapInPandas(with_header, ", ".join(f"{x} string" for x in cols))
            part.write.mode("overwrite").csv(f"{path}/{name}", quote='"', escape='"', emptyValue="")
        head = [(a, b, d) for a, b, d in zip(LABELS, REQUESTED, INDEXED)]
        c.spark.createDataFrame(head, "`Column name` string, `Requested field` string, `Field name` string").coalesce(1).write.mode("overwrite").csv(
            f"{path}/headings.csv", header=True, emptyValue=""
        )
        c.ws.marks.add("bulk")
    return path
