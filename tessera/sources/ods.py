"""ODS workbooks, read and written with the standard library."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from ..config import WriterConfig
from ..errors import WorkbookError
from .xlsx import Cell, _clean, _local, number_cell
from .zipfix import repaired

_DURATION = re.compile(r"^(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:[.,]\d+)?)S)?)?$")
MIME = "application/vnd.oasis.opendocument.spreadsheet"


def duration_seconds(text: str) -> float | None:
    m = _DURATION.match(text)
    if not m:
        return None
    days, hours, minutes = (int(m[k] or 0) for k in (2, 3, 4))
    return (-1 if m[1] else 1) * (days * 86_400 + hours * 3600 + minutes * 60 + float((m[5] or "0").replace(",", ".")))


def cell_value(attributes: dict[str, str], text: str) -> Cell:
    """A cell from its value attributes and the text of its paragraphs."""
    a = {_local(k): v for k, v in attributes.items()}
    kind = a.get("value-type")
    if kind in ("float", "currency", "percentage"):
        try:
            return number_cell(float(a.get("value", text)))
        except ValueError:
            return "string", text
    if kind == "string":
        return "string", a.get("string-value", text)
    if kind == "boolean":
        return "bool", "TRUE" if a.get("boolean-value", text).lower() == "true" else "FALSE"
    if kind == "date":
        value = a.get("date-value", text)
        return ("datetime", value.replace("T", " ")[:19]) if "T" in value else ("date", value[:10])
    if kind == "time":
        seconds = duration_seconds(a.get("time-value", text))
        if seconds is None:
            return "string", text
        if 0 <= seconds < 86_400:
            return "time", (dt.datetime.min + dt.timedelta(seconds=int(seconds))).strftime("%H:%M:%S")
        return number_cell(seconds)
    return ("string", text) if text else ("null", None)


def _paragraph(e: ET.Element) -> str:
    out = [e.text or ""]
    for c in e:
        name = _local(c.tag)
        if name == "s":
            out.append(" " * int(next((v for k, v in c.attrib.items() if _local(k) == "c"), "1")))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        elif name not in ("annotation", "note"):
            out.append(_paragraph(c))
        out.append(c.tail or "")
    return "".join(out)


class Workbook:
    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            self.zip = zipfile.ZipFile(io.BytesIO(repaired(data)))
        if "content.xml" not in self.zip.namelist():
            raise WorkbookError("no content part")
        self.sheets = []
        with self.zip.open("content.xml") as f:
            for _, e in ET.iterparse(f, ("start",)):
                if _local(e.tag) == "table":
                    name = next((v for k, v in e.attrib.items() if _local(k) == "name"), f"Sheet{len(self.sheets) + 1}")
                    self.sheets.append((name, str(len(self.sheets))))

    def rows(self, part: str) -> Iterator[tuple[int, list[Cell]]]:
        """Rows of the table of that number. Repeated rows and cells are expanded; empty ones at the end of a
        row or a sheet are left out however often they are repeated."""
        at, number, waiting, inside = -1, 0, 0, False
        with self.zip.open("content.xml") as f:
            for event, e in ET.iterparse(f, ("start", "end")):
                name = _local(e.tag)
                if name == "table":
                    if event == "start":
                        at += 1
                        inside = str(at) == part
                    elif inside:
                        return
                elif name == "table-row" and event == "end":
                    if inside:
                        attributes = {_local(k): v for k, v in e.attrib.items()}
                        times = int(attributes.get("number-rows-repeated", "1"))
                        cells = self._cells(e)
                        if cells:
                            for _ in range(waiting):
                                yield number, []
                                number += 1
                            waiting = 0
                            for _ in range(times):
                                yield number, cells
                                number += 1
                        else:
                            waiting += times
                    e.clear()

    @staticmethod
    def _cells(row: ET.Element) -> list[Cell]:
        cells: list[Cell] = []
        gap = 0
        for c in row:
            if _local(c.tag) not in ("table-cell", "covered-table-cell"):
                continue
            times = int(next((v for k, v in c.attrib.items() if _local(k) == "number-columns-repeated"), "1"))
            value = cell_value(c.attrib, "\n".join(_paragraph(p) for p in c if _local(p.tag) == "p"))
            if value[0] == "null":
                gap += times
            else:
                cells += [("null", None)] * gap + [value] * times
                gap = 0
        return cells


class OdsWriter:
    """Writes one sheet row by row, straight into the archive."""

    def __init__(self, out: io.IOBase, columns: list[str], config: WriterConfig | None = None) -> None:
        self.config, self.rows = config or WriterConfig(), 0
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr(zipfile.ZipInfo("mimetype"), MIME)
        self.zip.writestr("META-INF/manifest.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.2"><manifest:file-entry manifest:full-path="/" manifest:media-type="{MIME}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>')
        self.part = self.zip.open("content.xml", "w", force_zip64=True)
        o = "urn:oasis:names:tc:opendocument:xmlns"
        self._put(f'<?xml version="1.0" encoding="UTF-8"?>\n<office:document-content xmlns:office="{o}:office:1.0" xmlns:table="{o}:table:1.0" xmlns:text="{o}:text:1.0" office:version="1.2"><office:body><office:spreadsheet><table:table table:name="{escape(self.config.sheet_name, {chr(34): "&quot;"})}">')
        if self.config.header:
            self.write([*columns])
            self.rows = 0

    def _put(self, text: str) -> None:
        self.part.write(text.encode())

    def write(self, values: list) -> None:
        self.rows += 1
        self._put("<table:table-row>" + "".join(map(self._cell, values)) + "</table:table-row>")

    @staticmethod
    def _cell(v: object) -> str:
        if v is None:
            return "<table:table-cell/>"
        if isinstance(v, bool):
            kind = f'office:value-type="boolean" office:boolean-value="{str(v).lower()}"'
        elif isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
            kind = f'office:value-type="float" office:value="{v!r}"'
        elif isinstance(v, dt.datetime):
            kind = f'office:value-type="date" office:date-value="{v.isoformat(timespec="seconds")}"'
        elif isinstance(v, dt.date):
            kind = f'office:value-type="date" office:date-value="{v.isoformat()}"'
        elif isinstance(v, dt.time):
            kind = f'office:value-type="time" office:time-value="PT{v.hour:02}H{v.minute:02}M{v.second:02}S"'
        else:
            text = "".join(f"<text:p>{_spaced(line)}</text:p>" for line in _clean(str(v)).split("\n"))
            return f'<table:table-cell office:value-type="string">{text}</table:table-cell>'
        return f"<table:table-cell {kind}><text:p>{escape(str(v))}</text:p></table:table-cell>"

    def finish(self) -> int:
        self._put("</table:table></office:spreadsheet></office:body></office:document-content>")
        self.part.close()
        self.zip.close()
        return self.rows


def _spaced(line: str) -> str:
    """Escaped text in which runs of spaces, spaces at the ends, and tabs survive the format's white-space rules."""
    out = escape(line).replace("\t", "<text:tab/>")
    return re.sub(r"^ +| +$|(?<= ) +", lambda m: f'<text:s text:c="{len(m[0])}"/>', out)
