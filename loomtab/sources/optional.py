"""Formats of third-party libraries. Each checks for its library or Spark package when called, and says what is missing."""

from __future__ import annotations

import importlib
import io
import re
import zipfile
from collections.abc import Sequence
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from ..core import Table, as_table, from_rows, method, session
from ..errors import ArgumentError, Unavailable
from .files import _in_order
from .registry import read_bytes, write_bytes


def _library(name: str) -> Any:
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as e:
        raise Unavailable(name) from e


# --- XLSX: zip and XML, without a library ---------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}


def _letters(n: int) -> str:
    """Column letters of a 1-based number."""
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _place(ref: str) -> tuple[int, int]:
    """Row and column, 1-based, of a reference such as ``B7``."""
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return int(row), n


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return {s.get("name"): "xl/" + rels[s.get(f"{{{_NS['r']}}}id")].removeprefix("/xl/") for s in book.find("m:sheets", _NS)}


def _cell(c: ElementTree.Element, shared: list[str]) -> Any:
    kind, v = c.get("t", "n"), c.find("m:v", _NS)
    if kind == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    return int(v.text) if re.fullmatch(r"-?\d+", v.text) else float(v.text)


def _grid(data: bytes, sheet: str | int | None) -> list[list[Any]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheets = _sheets(z)
        name = list(sheets)[sheet or 0] if isinstance(sheet, int) or sheet is None else sheet
        if name not in sheets:
            raise ArgumentError(f"no sheet {name!r} among {list(sheets)}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(x.text or "" for x in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        cells = {_place(c.get("r")): _cell(c, shared) for c in ElementTree.fromstring(z.read(sheets[name])).iter(f"{{{_NS['m']}}}c")}
    rows, cols = max((r for r, _ in cells), default=0), max((c for _, c in cells), default=0)
    return [[cells.get((r, c)) for c in range(1, cols + 1)] for r in range(1, rows + 1)]


def fromxlsx(filename: Any, sheet: str | int | None = None, range_string: str | None = None, min_row: int | None = None, min_col: int | None = None, max_row: int | None = None, max_col: int | None = None) -> Table:
    """A sheet, or a range of it; the first row is the header."""
    grid = _grid(read_bytes(filename), sheet)
    if range_string:
        (min_row, min_col), (max_row, max_col) = map(_place, range_string.replace("$", "").split(":"))
    part = [r[(min_col or 1) - 1 : max_col] for r in grid[(min_row or 1) - 1 : max_row]]
    return from_rows(part)


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _sheet_xml(rows: list[Sequence[Any]]) -> str:
    out = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row, 1):
            ref = f"{_letters(c)}{r}"
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    return f'{_HEAD}<worksheet xmlns="{_NS["m"]}"><sheetData>{"".join(out)}</sheetData></worksheet>'


def _write_book(filename: Any, sheets: dict[str, list[Sequence[Any]]]) -> None:
    main, rel = _NS["m"], _NS["r"]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    book = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_NS["p"]}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{book}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_NS["p"]}">{links}</Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(rows))
    write_bytes(filename, out.getvalue())


def _all_sheets(filename: Any) -> dict[str, list[list[Any]]]:
    data = read_bytes(filename)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = list(_sheets(z))
    return {n: _grid(data, n) for n in names}


@method
def toxlsx(t: Table, filename: Any, sheet: str | None = None, write_header: bool = True, mode: str = "replace") -> None:
    """A sheet; modes ``replace`` (the file), ``add`` (a sheet) and ``overwrite`` (a sheet that is there)."""
    t = as_table(t)
    rows = [*([t.columns] if write_header else []), *map(tuple, _in_order(t))]
    there = {} if mode == "replace" else _all_sheets(filename)
    name = sheet or f"Sheet{len(there) + 1}"
    if mode == "add" and name in there:
        raise ArgumentError(f"sheet {name!r} is there")
    _write_book(filename, there | {name: rows})


@method
def appendxlsx(t: Table, filename: Any, sheet: str | None = None, write_header: bool = False) -> None:
    t, there = as_table(t), _all_sheets(filename)
    name = sheet or next(iter(there))
    rows = [*([t.columns] if write_header else []), *map(tuple, _in_order(t))]
    _write_book(filename, there | {name: [*there.get(name, []), *rows]})


def fromxls(filename: str, sheet: str | int | None = None) -> Table:
    """An Excel 97 sheet (xlrd)."""
    book = _library("xlrd").open_workbook(filename)
    s = book.sheet_by_name(sheet) if isinstance(sheet, str) else book.sheet_by_index(sheet or 0)
    return from_rows([s.row_values(i) for i in range(s.nrows)])


@method
def toxls(t: Table, filename: str, sheet: str = "Sheet1") -> None:
    """An Excel 97 sheet (xlwt)."""
    book = _library("xlwt").Workbook()
    s = book.add_sheet(sheet)
    for i, r in enumerate([t.columns, *map(tuple, _in_order(as_table(t)))]):
        for j, v in enumerate(r):
            s.write(i, j, v)
    book.save(filename)


# --- Google Sheets --------------------------------------------------------------------------------------------------


def _client(x: Any) -> Any:
    return x if hasattr(x, "open") else _library("gspread").authorize(x)


def _worksheet(book: Any, name: str | None) -> Any:
    return book.sheet1 if name is None else book.worksheet(name)


def fromgsheet(credentials_or_client: Any, spreadsheet: str, worksheet: str | None = None, cell_range: str | None = None, open_by_key: bool = False) -> Table:
    """A sheet's values as text (gspread)."""
    client = _client(credentials_or_client)
    ws = _worksheet(client.open_by_key(spreadsheet) if open_by_key else client.open(spreadsheet), worksheet)
    return from_rows(ws.get(cell_range) if cell_range else ws.get_all_values())


@method
def togsheet(t: Table, credentials_or_client: Any, spreadsheet: str, worksheet: str | None = None, share_emails: Sequence[str] | None = None, role: str = "reader") -> str:
    t, book = as_table(t), _client(credentials_or_client).create(spreadsheet)
    ws = book.sheet1
    if worksheet:
        ws.update_title(worksheet)
    ws.append_rows([list(t.columns), *map(list, _in_order(t))])
    for e in share_emails or ():
        book.share(e, perm_type="user", role=role)
    return book.id


@method
def appendgsheet(t: Table, credentials_or_client: Any, spreadsheet: str, worksheet: str | None = None, open_by_key: bool = False, include_header: bool = False) -> None:
    t, client = as_table(t), _client(credentials_or_client)
    ws = _worksheet(client.open_by_key(spreadsheet) if open_by_key else client.open(spreadsheet), worksheet)
    ws.append_rows([*([list(t.columns)] if include_header else []), *map(list, _in_order(t))])


# --- HDF5 -----------------------------------------------------------------------------------------------------------


def fromhdf5(source: str, where: str = "/", name: str | None = None, condition: str | None = None, start: int | None = None, stop: int | None = None, step: int | None = None) -> Table:
    """An HDF5 table (PyTables), the condition evaluated by it."""
    with _library("tables").open_file(source) as f:
        node = f.get_node(where, name)
        rows = node.read_where(condition, start=start, stop=stop, step=step) if condition else node.read(start, stop, step)
        return from_rows(rows.tolist(), node.colnames)


def fromhdf5sorted(source: str, where: str = "/", name: str | None = None, sortby: str | None = None, **kwargs: Any) -> Table:
    from ..operators.sorts import sort

    return sort(fromhdf5(source, where, name, **kwargs), sortby)


@method
def tohdf5(t: Table, source: str, where: str = "/", name: str = "table", create: bool = False) -> None:
    from .arrays import toarray

    with _library("tables").open_file(source, "a") as f:
        if create:
            f.create_table(where, name, obj=toarray(t))
        else:
            node = f.get_node(where, name)
            node.remove_rows(0, node.nrows)
            node.append(toarray(t))


@method
def appendhdf5(t: Table, source: str, where: str = "/", name: str = "table") -> None:
    from .arrays import toarray

    with _library("tables").open_file(source, "a") as f:
        f.get_node(where, name).append(toarray(t))
