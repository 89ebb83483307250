"""Long to wide and wide to long.

``widen`` uses one conditional aggregate per output column: a single shuffle on
the keys, where ``pivot`` would need one on (keys, name) and another on the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from capital_access.functions.nulls import as_col

MISSING_NAME = "NA"


def name_of(columns: str | Sequence[str], sep: str = "_") -> Column:
    """Column that holds the new column's name; a missing part is written ``NA``."""
    parts = [columns] if isinstance(columns, str) else list(columns)
    written = [F.coalesce(as_col(p).cast("string"), F.lit(MISSING_NAME)) for p in parts]
    return written[0] if len(written) == 1 else F.concat_ws(sep, *written)


def vocabulary(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """The names ``widen`` would make, one row (name) each."""
    return df.select(name_of(columns).alias("name")).distinct()


def column_names(names: DataFrame) -> list[str]:
    """A vocabulary as a sorted list, to be used as columns of a table; runs a job."""
    return sorted(r["name"] for r in names.collect())


def widen(
    df: DataFrame,
    keys: Sequence[str | Column],
    names_from: str | Sequence[str],
    names: Sequence[str],
    values: Mapping[str, str | Column] | str,
    aggregate: Callable[[Column], Column] = F.sum,
    *,
    rest: str | None,
    prefix: str = "",
    name_first: bool = False,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key with a column per name.

    With one value column the new columns are ``prefix + name``. With several,
    given as ``{label: column}``, they are ``label_name`` (``name_label`` with
    ``name_first``). A cell without rows is missing. ``extra`` aggregates are
    taken over all rows of the key.

    ``rest`` names one more column for all rows whose name is not listed; with
    None these rows are in no cell.
    """
    label = name_of(names_from)
    cells_of = {name: label == name for name in names}
    if rest is not None:
        cells_of[rest] = ~label.isin(list(names))
    several = not isinstance(values, str)
    cells = []
    for value_label, value in (values.items() if several else [(None, values)]):
        for name, here in cells_of.items():
            if several:
                parts = (name, value_label) if name_first else (value_label, name)
                out = prefix + "_".join(parts)
            else:
                out = f"{prefix}{name}"
            cells.append(aggregate(F.when(here, as_col(value))).alias(out))
    return df.groupBy(*keys).agg(*cells, *extra)


def widen_open(
    df: DataFrame,
    keys: Sequence[str],
    names_from: str | Sequence[str],
    value: str | Column,
    aggregate: Callable[[Column], Column] = F.sum,
    cells: str = "cells",
) -> DataFrame:
    """One row per key with a map from name to value, for a vocabulary that nobody has to know.

    The names stay in the rows: none is brought to the driver, and a row is as
    wide as its own names, not as the vocabulary. Cells are aggregated by key and
    name before they meet by key, so a hot key costs one row for each of its
    names. Names are in order; a cell without rows is in no map, one whose rows
    are all missing is missing. ``cell`` makes a column of one name.
    """
    by = [as_col(k) for k in keys]
    summed = df.groupBy(*by, name_of(names_from).alias("_name")).agg(aggregate(as_col(value)).alias("_value"))
    entries = F.array_sort(F.collect_list(F.struct("_name", "_value")))
    return summed.groupBy(*by).agg(F.map_from_entries(entries).alias(cells))


def cell(name: str, cells: str = "cells") -> Column:
    """The value of one name in the rows of ``widen_open``; missing where the row lacks it."""
    return F.try_element_at(as_col(cells), F.lit(name))


def lengthen(
    df: DataFrame, columns: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """One row per value column; missing values keep their row."""
    ids = [as_col(c) for c in df.columns if c not in set(columns)]
    values = [as_col(c).cast("double").alias(c) for c in columns]
    return df.select(ids + values).unpivot(
        [as_col(c) for c in df.columns if c not in set(columns)],
        [as_col(c) for c in columns],
        name,
        value,
    )
