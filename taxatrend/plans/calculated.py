"""One calculated run: all five insights in the shared record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from taxatrend.operators.co_movement import co_movement
from taxatrend.operators.insight import pack
from taxatrend.operators.notable import notable_records
from taxatrend.operators.range_change import range_change
from taxatrend.operators.reporting_rate import reporting_rate
from taxatrend.operators.silent import national, regional
from taxatrend.params import Params


def calculated_run(
    occ: DataFrame, records: DataFrame, datasets: DataFrame, taxa: DataFrame, tiers: DataFrame, effort: DataFrame,
    visited: DataFrame, regional_rates: DataFrame, p: Params, run_id: str, extent: bool = True,
) -> DataFrame:
    """``records``, ``tiers``, ``visited`` and ``regional_rates`` are each read more than once: pass written tables."""
    parts = [
        national(records, taxa, p),
        regional(records, taxa, p),
        range_change(records, taxa, tiers, effort, p, extent),
        reporting_rate(visited, taxa, effort, p, regional=False),
        regional_rates,
        co_movement(regional_rates, taxa, p),
        notable_records(occ, records, datasets, taxa, tiers, p),
    ]
    return reduce(DataFrame.unionByName, [pack(df, run_id) for df in parts])
