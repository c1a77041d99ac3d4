"""Arrays, tables and boxes as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweave.functions.text import escape_prose


def rectangular(rows: Column) -> Column:
    """Rows without the blank ones, padded on the right to equal width; null cells are empty."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    kept = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(kept, lambda r: F.size(r))), F.lit(0))
    return F.transform(kept, lambda r: F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))


def header_cells(table: Column) -> Column:
    """One header row: the cells of all header rows of a column, joined; blanks without header rows."""
    head = F.slice(table["row_cells"], F.lit(1), F.greatest(F.lit(0), table["header_rows"]))
    columns = F.sequence(F.lit(0), F.greatest(F.lit(0), table["column_count"] - 1))
    joined = F.transform(columns, lambda i: F.array_join(F.filter(F.transform(head, lambda r: F.get(r, i)), lambda c: c != ""), " / "))
    return F.when(table["header_rows"] > 0, joined).otherwise(F.array_repeat(F.lit(""), table["column_count"]))


def _cell(c: Column) -> Column:
    return F.replace(F.replace(escape_prose(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_markdown(table: Column) -> Column:
    head = header_cells(table)
    body = F.slice(table["row_cells"], table["header_rows"] + 1, F.size(table["row_cells"]))
    rule = _line(F.transform(head, lambda c: F.lit("---")))
    lines = F.transform(body, lambda r: _line(F.transform(r, _cell)))
    return F.array_join(F.concat(F.array(_line(F.transform(head, _cell)), rule), lines), "\n")


def table_html(table: Column) -> Column:
    def row(cells: Column, tag: str) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), escape_prose(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    body = F.slice(table["row_cells"], table["header_rows"] + 1, F.size(table["row_cells"]))
    head = F.when(table["header_rows"] > 0, F.concat(F.lit("<thead>"), row(header_cells(table), "th"), F.lit("</thead>"))).otherwise("")
    return F.concat(F.lit("<table>"), head, F.lit("<tbody>"), F.array_join(F.transform(body, lambda r: row(r, "td")), ""), F.lit("</tbody></table>"))


def merge_half_rows(left: Column, right: Column) -> Column:
    """Rows of two table parts; boundary rows that complement each other become one row."""
    a, b = F.element_at(left, -1), F.element_at(right, 1)
    pairs = F.arrays_zip(a.alias("l"), b.alias("r"))
    halves = (
        F.exists(a, lambda c: c == "") & F.exists(b, lambda c: c == "") & F.forall(pairs, lambda p: (p["l"] == "") | (p["r"] == ""))
    )
    joined = F.transform(pairs, lambda p: F.when(p["l"] != "", p["l"]).otherwise(p["r"]))
    merged = F.concat(F.slice(left, F.lit(1), F.greatest(F.lit(0), F.size(left) - 1)), F.array(joined), F.slice(right, F.lit(2), F.size(right)))
    return F.when((F.size(left) > 0) & (F.size(right) > 0) & (F.size(a) == F.size(b)) & halves, merged).otherwise(F.concat(left, right))


def effective_labels(kind: Column, own: Column, supplied: Column) -> Column:
    """The record's figure labels where they name the unit's sources in order, else the unit's; null on a mismatch."""
    same = F.transform(own, lambda x: x["source"]).eqNullSafe(F.transform(supplied, lambda x: x["source"]))
    return F.when(supplied.isNull() | (F.size(supplied) == 0), own).when((kind == "figure") & same, supplied)


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Share of box ``a`` that box ``b`` covers."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h / F.greatest(area(a), F.lit(1.0))).otherwise(0.0)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h / F.greatest(F.least(area(a), area(b)), F.lit(1.0))).otherwise(0.0)


def equal_share(total: Column, parts: Column, ordinal: Column) -> Column:
    """Share of the ``ordinal``-th of ``parts`` (from 0): the quotient, one more for the first remainder."""
    return (F.floor(total / parts) + F.when(ordinal < F.pmod(total, parts), 1).otherwise(0)).cast("long")
