"""Cells to rectangular grids, trimming, measuring, labels.

A grid is a table of rows with their values as an array; `grid_cells` gives it cell by cell. Grids are laid out row by row, with the open
spans of each column as the only state, so a table's grid is never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crawlsift.functions.csv import csv_field
from crawlsift.functions.sql import each, keep, lit
from crawlsift.functions.text import ELLIPSIS, WHITESPACE, js_cut, js_trim

KEYS = ["page_id", "table_index"]
#: The widest and the tallest span that html knows.
MAX_SPAN, MAX_ROWS = 1000, 65534
#: Values that a task passes on at a time.
VALUES = 50_000
_BLANK = re.compile(rf"[{WHITESPACE}]*\Z")


def resolve_span(value: str, fallback: int = 1, largest: int = MAX_SPAN) -> str:
    """A finite span of at least 1, whole and clamped; the fallback for anything else."""
    number = f"try_cast({value} AS DOUBLE)"
    return (f"CASE WHEN {number} IS NULL OR isnan({number}) OR {number} < 1 OR {number} = DOUBLE('Infinity') "
            f"THEN {fallback} ELSE CAST(least(floor({number}), {largest}) AS INT) END")


def _laid_out(cells: list[dict], row_count: int) -> Iterator[dict[int, str]]:
    """Each row's values by column. A cell takes the first column at or after its left neighbour's end that no row above claims; where
    spans collide, the later cell wins."""
    open_: dict[int, list[tuple[int, str]]] = {}
    at = 0
    for row in range(row_count):
        for col in list(open_):
            while open_[col] and open_[col][-1][0] <= row:
                open_[col].pop()
            if not open_[col]:
                del open_[col]
        values = {col: spans[-1][1] for col, spans in open_.items()}
        busy = set(values)
        col = 0
        while at < len(cells) and cells[at]["row"] <= row:
            cell = cells[at]
            at += 1
            while col in busy:
                col += 1
            for x in range(col, col + cell["cs"]):
                values[x] = cell["text"]
                if cell["rs"] > 1:
                    open_.setdefault(x, []).append((row + cell["rs"], cell["text"]))
            col += cell["cs"]
        yield values


def grid_rows(tables: DataFrame) -> DataFrame:
    """(page_id, table_index, row, rows, columns, empty, trimmed_row, trimmed_columns, values) of tables with their cells in order (see
    `page_tables`): every row as wide as the widest, gaps as ''.

    `trimmed_row` is the row's number without rows that are entirely blank (NULL for those), `trimmed_columns` the columns that are not;
    `empty` counts the table's blank values. A table is laid out twice: for its measures, then row by row for its values.
    """
    column = lambda c: (
        f"named_struct('row', CAST({c}.row AS INT), 'text', {c}.text, 'cs', {resolve_span(f'{c}.colspan')}, 'rs', CAST(if({c}.rowspan = 0, "
        f"row_count - {c}.row, least({resolve_span(f'{c}.rowspan', largest=MAX_ROWS)}, row_count - {c}.row)) AS INT))")
    shaped = tables.selectExpr(*KEYS, "CAST(row_count AS INT) AS row_count", f"{each('cells', column)} AS cells")
    keys = [shaped.schema[k] for k in KEYS]
    schema = StructType([*keys, *StructType.fromDDL(
        "row int, rows int, columns int, empty long, trimmed_row int, trimmed_columns array<int>, values array<string>")])

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(k.name).type for k in keys]
            out: list[list] = [[] for _ in schema]
            held = 0

            def flush() -> pa.RecordBatch:
                types = [*kinds, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=schema.names)

            for i in range(batch.num_rows):
                cells, count = batch.column("cells")[i].as_py(), batch.column("row_count")[i].as_py()
                if not cells:
                    continue
                key = [batch.column(k.name)[i].as_py() for k in keys]
                width, full, filled = 0, 0, set()
                for values in _laid_out(cells, count):
                    width = max(width, max(values, default=-1) + 1)
                    solid = [col for col, text in values.items() if not _BLANK.match(text)]
                    full += len(solid)
                    filled.update(solid)
                columns, trimmed = sorted(filled), -1
                for row, values in enumerate(_laid_out(cells, count)):
                    line = [values.get(col, "") for col in range(width)]
                    solid = any(not _BLANK.match(v) for v in values.values())
                    trimmed += solid
                    for into, v in zip(out, (*key, row, count, width, count * width - full, trimmed if solid else None, columns, line)):
                        into.append(v)
                    held += width
                    if held >= VALUES:
                        yield flush()
                        out, held = [[] for _ in schema], 0
            if out[0]:
                yield flush()

    return shaped.mapInArrow(expand, schema)


def grid_cells(rows: DataFrame) -> DataFrame:
    """table_grid(page_id, table_index, row, col, value)."""
    return rows.select(*KEYS, "row", F.posexplode("values").alias("col", "value"))


def trimmed_rows(rows: DataFrame) -> DataFrame:
    """(page_id, table_index, row, values) without rows and columns that are entirely blank; the rest renumbered."""
    return rows.filter("trimmed_row IS NOT NULL").selectExpr(
        *KEYS, "trimmed_row AS row", f"{each('trimmed_columns', lambda c: f'get(values, {c})')} AS values")


def grid_measures(rows: DataFrame) -> DataFrame:
    """(page_id, table_index, rows, columns, cells, empty); whitespace counts as empty."""
    return rows.filter("row = 0").selectExpr(*KEYS, "rows", "columns", "CAST(rows AS BIGINT) * columns AS cells", "empty")


def grid_lines(rows: DataFrame, delimiter: str = ",") -> DataFrame:
    """One CSV line per grid row: (page_id, table_index, row, line)."""
    fields = each("values", lambda v: csv_field(v, delimiter))
    return rows.selectExpr(*KEYS, "row", f"array_join({fields}, {lit(delimiter)}) AS line")


# --- from rows of cells, as a user may have filtered or changed them ------------------------------


def expand_grid(cells: DataFrame) -> DataFrame:
    """table_grid(page_id, table_index, row, col, value) of rows of cells: the cells of a table meet by its key first."""
    fields = "struct(row, cell, text, colspan, rowspan)"
    tables = cells.groupBy(*KEYS).agg(F.max("row_count").alias("row_count"), F.expr(f"array_sort(collect_list({fields}))").alias("cells"))
    return grid_cells(grid_rows(tables))


def _rows_of(grid: DataFrame) -> DataFrame:
    return grid.groupBy(*KEYS, "row").agg(F.expr("array_sort(collect_list(struct(col, value)))").alias("cells"))


def trim_grid(grid: DataFrame) -> DataFrame:
    """Without rows and columns that are entirely blank; the rest renumbered."""
    blank = f"{js_trim('value')} = ''"
    full = lambda by: f"max(NOT ({blank})) OVER (PARTITION BY page_id, table_index, {by})"
    kept = grid.selectExpr("*", f"{full('row')} AS in_row", f"{full('col')} AS in_col").filter("in_row AND in_col")
    rank = "dense_rank() OVER (PARTITION BY page_id, table_index ORDER BY {0}) - 1 AS {0}"
    return kept.selectExpr(*KEYS, rank.format("row"), rank.format("col"), "value")


def measure_grid(grid: DataFrame) -> DataFrame:
    """(page_id, table_index, rows, columns, cells, empty); whitespace counts as empty."""
    return grid.groupBy(*KEYS).agg(
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("columns"),
        F.count(F.lit(1)).alias("cells"), F.expr(f"count_if({js_trim('value')} = '')").alias("empty"))


def grid_csv(grid: DataFrame, delimiter: str = ",") -> DataFrame:
    """One CSV line per grid row: (page_id, table_index, row, line)."""
    return grid_lines(_rows_of(grid).selectExpr(*KEYS, "row", "cells.value AS values"), delimiter)


def describe_table(tables: DataFrame) -> DataFrame:
    """Label of each table: its caption, else its first headings or cells; at most 70 characters."""
    shown = (f"CASE WHEN caption <> '' THEN caption WHEN size(headings) > 0 THEN array_join(slice(headings, 1, 3), ' / ') "
             f"WHEN size(preview) > 0 THEN array_join(slice({keep('preview', lambda p: f"{p} <> ''")}, 1, 3), ' / ') END")
    label = js_cut(f"concat_ws(' - ', concat('Table ', table_index + 1), {shown})", 70, ELLIPSIS)
    return tables.selectExpr(*KEYS, f"{label} AS label")
