"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import raster_queries, series_queries, vector_queries

#: Columns of dates, which both sides give as text so that no client's date type comes into a comparison.
_DATES = {
    "zonal_daily_mean": ("date",),
    "zonal_daily_scaled": ("date",),
    "days_with_any_value": ("date",),
    "zonal_pivot": ("date",),
    "unpivot_series": ("date",),
    "interval_expand_last_wins": ("date",),
    "calendar_spine": ("date",),
    "tile_index_wide": ("date_start", "date_end"),
    "normalize_dates": ("date",),
    "recharge_period": ("start",),
    "date_in_name": ("date",),
    "basin_enrichment": ("climdata_date_start",),
}


def _as_text(f, columns: tuple[str, ...]):
    def run(spark, sf_dir):
        found = f(spark, sf_dir)
        return found.withColumns({c: found[c].cast("string") for c in columns})

    return run


def _sql_as_text(sql: str, columns: tuple[str, ...]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'strftime({c}, $$%Y-%m-%d$$) AS {c}' for c in columns)}) FROM ({sql})"


QUERIES = raster_queries.QUERIES | series_queries.QUERIES | vector_queries.QUERIES
SQL = raster_queries.SQL | series_queries.SQL | vector_queries.SQL
QUERIES |= {n: _as_text(QUERIES[n], c) for n, c in _DATES.items()}
SQL |= {n: _sql_as_text(SQL[n], c) for n, c in _DATES.items()}
