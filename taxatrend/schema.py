"""The canonical record, declared as data: fields, where they come from, and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Registry key given to records of the atlas.
SOURCE = "atlas"


@dataclass(frozen=True)
class Field:
    path: str
    kind: str
    required: bool = False
    sources: tuple[str, ...] = ()
    note: str | None = None

    @property
    def column(self) -> str:
        return COLUMN_NAMES.get(self.path, "".join("_" + ch.lower() if ch.isupper() else ch for ch in self.path.split(".")[-1]))


# Canonical fields in declaration order, their types, and the source fields consulted.
FIELDS = [
    Field("recordId", "string", True),
    Field("provenance.source", "string", True),
    Field("provenance.sourceRecordId", "string", True, ("uuid",)),
    Field("provenance.occurrenceId", "string", False, ("occurrenceID",)),
    Field("provenance.harvestId", "string", True),
    Field("provenance.snapshotPage", "string", True),
    Field("provenance.fetchedAt", "iso8601", True),
    Field("provenance.dataResourceUid", "string", False, ("dataResourceUid",)),
    Field("provenance.dataResourceName", "string", False, ("dataResourceName",)),
    Field("provenance.license", "string", False, ("license",)),
    Field("scientificName", "string", True, ("scientificName",)),
    Field("vernacularName", "string", False, ("vernacularName",)),
    Field("taxonConceptId", "string", False, ("taxonConceptID",)),
    Field("taxonRank", "string", False, ("taxonRank",)),
    Field("kingdom", "string", False, ("kingdom",)),
    Field("phylum", "string", False, ("phylum",)),
    Field("taxonClass", "string", False, ("classs", "class"), "search pages and bulk files name the class differently"),
    Field("order", "string", False, ("order",)),
    Field("family", "string", False, ("family",)),
    Field("genus", "string", False, ("genus",)),
    Field("nationalStatus", "string", False, ("countryConservation",)),
    Field("eventDate", "iso8601", False, ("eventDate",), "epoch milliseconds or ISO text, kept as a UTC instant"),
    Field("firstLoadedAt", "iso8601", False, ("firstLoadedDate",), "kept as a UTC instant"),
    Field("decimalLatitude", "latitude", False, ("decimalLatitude",)),
    Field("decimalLongitude", "longitude", False, ("decimalLongitude",)),
    Field("coordinateUncertaintyInMeters", "number", False, ("coordinateUncertaintyInMeters",)),
    Field("stateProvince", "string", False, ("stateProvince",)),
    Field("ibraRegion", "string", False, ("cl1048",)),
    Field("locality", "string", False, ("locality",)),
    Field("basisOfRecord", "string", False, ("basisOfRecord",)),
    Field("individualCount", "integer", False, ("individualCount",)),
    Field("recordedByPseudonym", "string", False, ("recordedBy",), "observer replaced by a stable pseudonym"),
    Field("occurrenceRemarks", "string", False, ("raw_occurrenceRemarks", "occurrenceRemarks"), "queried and returned under different names"),
    Field("eventRemarks", "string", False, ("eventRemarks",)),
    Field("sourceAssertions", "string[]", True, ("assertions",)),
    Field("isValid", "boolean", True),
]

COLUMN_NAMES = {
    "order": "taxon_order",
    "eventDate": "event_date",
    "coordinateUncertaintyInMeters": "coordinate_uncertainty_m",
}

# Source fields that are plumbing of the source and are not looked at.
IGNORED = [
    "collectors", "collector", "namesLsid", "left", "right", "taxonRankID", "speciesGuid", "genusGuid", "speciesGroups",
    "geospatialKosher", "latLong", "point1", "point01", "point001", "point0001", "point00001",
]

# Source fields deliberately not kept, by the reason for leaving them out.
EXCLUDED = {
    "same information as the names kept": ["species", "raw_scientificName"],
    "never varies": ["country", "raw_countryCode"],
    "follows from the event date": ["year", "month"],
    "holds a placeholder, no measurement": ["coordinatePrecision"],
    "does not tell records apart": ["spatiallyValid"],
    "state listings are not used": ["stateConservation"],
    "publisher-internal identifier": [
        "institutionCode", "raw_institutionCode", "collectionCode", "raw_collectionCode", "catalogNumber",
        "raw_catalogNumber", "recordNumber",
    ],
    "coarser form of dataset or licence": ["dataProviderUid", "dataProviderName", "rights"],
    "rarely filled in": ["sex", "lifeStage"],
    "too sparse as text": ["habitat", "identificationRemarks"],
    "seen empty everywhere": ["dataGeneralizations", "informationWithheld", "sensitive"],
    "repeats basisOfRecord": ["raw_basisOfRecord"],
    "repeats the national status": ["austConservation"],
    "repeats the locality": ["raw_locality"],
    "repeats the common name": ["raw_vernacularName"],
}

MAPPED = [f for f in FIELDS if f.sources]
SPARK_TYPES = {
    "string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "latitude": T.DoubleType(),
    "longitude": T.DoubleType(), "boolean": T.BooleanType(), "iso8601": T.TimestampType(), "string[]": T.ArrayType(T.StringType()),
}


def canonical_struct() -> T.StructType:
    """Columns of a canonical record; each column's metadata says whether it is required and its sources."""
    return T.StructType(
        [T.StructField(f.column, SPARK_TYPES[f.kind], True, {"path": f.path, "required": f.required, "sourceFields": list(f.sources)}) for f in FIELDS]
    )


# Columns of a stored occurrence that a newer run replaces.
OCCURRENCE_COLUMNS = [
    "record_id", "source", "source_record_id", "occurrence_id", "harvest_id", "snapshot_page", "fetched_at",
    "data_resource_uid", "license", "taxon_concept_id", "scientific_name", "vernacular_name", "national_status",
    "event_date", "first_loaded_at", "decimal_latitude", "decimal_longitude", "coordinate_uncertainty_m",
    "state_province", "ibra_region", "locality", "basis_of_record", "individual_count", "recorded_by_pseudonym",
    "occurrence_remarks", "event_remarks", "source_assertions", "is_valid", "issue_count",
]
