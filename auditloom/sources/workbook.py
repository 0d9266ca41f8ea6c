"""Workbooks in the zipped XML format: reading one sheet as text and writing simple sheets, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _tree(book: zipfile.ZipFile, name: str) -> ElementTree.Element:
    content = book.read(name)
    if b"<!ENTITY" in content or b"<!DOCTYPE" in content:
        raise ValueError("the workbook declares entities, which are not allowed")
    return ElementTree.fromstring(content)


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    links = {r.get("Id"): r.get("Target") for r in _tree(book, "xl/_rels/workbook.xml.rels")}
    found = {}
    for s in _tree(book, "xl/workbook.xml").iter(f"{_MAIN}sheet"):
        target = links[s.get(_LINK)].lstrip("/")
        found[s.get("name")] = target if target.startswith("xl/") else f"xl/{target}"
    return found


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        return list(_sheets(book))


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_sheet(content: bytes, sheet: str | None = None) -> tuple[list[str], list[tuple]]:
    """(header, rows) of a sheet by name, or of the first one; cells as text, missing cells as null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = _sheets(book)
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"there is no sheet {sheet!r}")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in _tree(book, "xl/sharedStrings.xml").iter(f"{_MAIN}si")]
        grid = []
        for row in _tree(book, sheets[sheet] if sheet else next(iter(sheets.values()))).iter(f"{_MAIN}row"):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                value = c.find(f"{_MAIN}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif value is None:
                    text = None
                elif c.get("t") == "s":
                    text = shared[int(value.text)]
                elif c.get("t") == "b":
                    text = "True" if value.text == "1" else "False"
                else:
                    text = value.text
                cells[_column(c.get("r")) if c.get("r") else i] = text
            grid.append(cells)
    if not grid:
        return [], []
    width = max((max(r, default=-1) for r in grid), default=-1) + 1
    header = [grid[0].get(i) or "" for i in range(width)]
    return header, [tuple(r.get(i) for i in range(width)) for r in grid[1:] if any(v is not None for v in r.values())]


def _cell(value, style: int) -> str:
    s = f' s="{style}"' if style else ""
    if value is None:
        return f"<c{s}/>"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c t="inlineStr"{s}><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f"<c{s}><v>{value!r}</v></c>"


#: Cell styles by name: index into cellXfs below.
STYLES = {"": 0, "header": 1, "percent": 2, "good": 3, "bad": 4, "warn": 5}
_STYLE_XML = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.0%"/></numFmts>'
    '<fonts count="2"><font/><font><b/></font></fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in ("C8E6C9", "FFCDD2", "FFE0B2"))
    + '</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="6"><xf/><xf fontId="1" applyFont="1"/>'
    '<xf numFmtId="164" applyNumberFormat="1"/><xf fillId="2" applyFill="1"/><xf fillId="3" applyFill="1"/><xf fillId="4" applyFill="1"/></cellXfs></styleSheet>'
)


def write_workbook(sheets: dict[str, list[list[tuple[object, str]]]]) -> bytes:
    """A workbook of sheets, each a list of rows of (value, style name)."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names = list(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{types}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="rId{len(names) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", _STYLE_XML)
        for i, n in enumerate(names, 1):
            rows = "".join("<row>" + "".join(_cell(v, STYLES[s]) for v, s in r) + "</row>" for r in sheets[n])
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()
