"""Splits by name, for callers that choose them by configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from statloom.operators import columns as C
from statloom.operators import rows as R

#: name -> function(df, columns) -> df with part
ROWS: dict[str, Callable[..., DataFrame]] = {
    "kmeans": lambda df, columns, **o: R.kmeans_split(df, columns, **o)[0],
    "gmm": lambda df, columns, **o: R.gmm_split(df, columns, **o)[0],
    "rdc": lambda df, columns, **o: R.rdc_split(df, columns, o.pop("discrete", [False] * len(columns)), **o),
    "grid": R.grid_split,
    "rectangle": R.rectangle_split,
    "dbscan": R.density_split,
    "grid_naive": lambda df, columns: R.median_split(df, columns[0])[0],
}
#: name -> function(df, columns) -> groups of columns
COLUMNS: dict[str, Callable[..., list[list[str]]]] = {
    "rdc": lambda df, columns, **o: C.rdc_groups(df, columns, o.pop("discrete", [False] * len(columns)), **o),
    "poisson": C.stability_groups,
}


def split_functions(cols: str | Callable = "rdc", rows: str | Callable = "kmeans") -> tuple[Callable, Callable]:
    """A column split and a row split; a function stands for itself."""
    for name, known in ((cols, COLUMNS), (rows, ROWS)):
        if not callable(name) and name not in known:
            raise ValueError(f"{name!r} is none of {', '.join(known)}")
    return cols if callable(cols) else COLUMNS[cols], rows if callable(rows) else ROWS[rows]
