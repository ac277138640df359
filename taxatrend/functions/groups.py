"""Taxonomic groupings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes with their own effort counts, and the display names of groups.
EFFORT_CLASSES = ["Aves", "Mammalia", "Reptilia", "Amphibia"]
DISPLAY = {"Aves": "birds", "Mammalia": "mammals", "Reptilia": "reptiles", "Amphibia": "amphibians"}


def effort_group(kingdom: Column, taxon_class: Column) -> Column:
    """Group whose recording effort a taxon is read against."""
    return (
        F.when(kingdom == "Plantae", "Plantae").when(taxon_class.isin(EFFORT_CLASSES), taxon_class).otherwise("all")
    )


def display_group(kingdom: Column, taxon_class: Column) -> Column:
    out = F.when(kingdom == "Plantae", "plants")
    for name, label in DISPLAY.items():
        out = out.when(taxon_class == name, label)
    return out.otherwise("other")
