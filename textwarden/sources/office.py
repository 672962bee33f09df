"""Pages of office files from their parts: a zip directory of XML, read with the standard library.

Word files are one page: the paragraphs of the body, then the rows of its tables, cells joined by " | ". A workbook has a page for each sheet, in the workbook's
order, a line for each row with cells; cells that are missing before the last one are empty. A presentation has a page for each slide, in order, with
the paragraphs of its shapes. Numbers are shown as they are stored. A part above ``most_bytes`` is an error, as is a damaged file; the caller makes a row of it.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as XML

MOST_BYTES = 512 << 20


class Parts:
    """The parts of a file, by name."""

    def __init__(self, content: bytes, most_bytes: int = MOST_BYTES) -> None:
        self.zip, self.most = zipfile.ZipFile(io.BytesIO(content)), most_bytes

    def has(self, name: str) -> bool:
        return name in self.zip.NameToInfo

    def xml(self, name: str) -> XML.Element:
        if self.zip.getinfo(name).file_size > self.most:
            raise ValueError(f"{name} is larger than {self.most} bytes")
        raw = self.zip.read(name)
        if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
            raise ValueError(f"{name} declares entities")
        return XML.fromstring(raw)

    def related(self, name: str) -> dict[str, str]:
        """The names of parts that a part refers to, by the reference's id."""
        folder, base = posixpath.split(name)
        rels = f"{folder}/_rels/{base}.rels"
        if not self.has(rels):
            return {}
        return {r.get("Id"): posixpath.normpath(posixpath.join("/", r.get("Target")) if r.get("Target", "").startswith("/") else posixpath.join(folder, r.get("Target", ""))).lstrip("/") for r in self.xml(rels)}


def _name(e: XML.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: XML.Element, name: str) -> Iterator[XML.Element]:
    return (x for x in e.iter() if _name(x) == name)


def _kids(e: XML.Element, name: str) -> list[XML.Element]:
    return [x for x in e if _name(x) == name]


def _said(e: XML.Element) -> str:
    """The text of a paragraph's runs; tabs and breaks are characters."""
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_name(x), "") for x in e.iter())


def docx(content: bytes) -> list[str]:
    body = next(_all(Parts(content).xml("word/document.xml"), "body"))
    lines = [_said(p) for p in _kids(body, "p")]
    for table in _kids(body, "tbl"):
        lines += [" | ".join("\n".join(_said(p) for p in _all(c, "p")) for c in _kids(r, "tc")) for r in _kids(table, "tr")]
    return ["\n".join(lines)]


def _column(place: str | None, after: int) -> int:
    """The number, from 0, of a cell's column by its place ("AB7"), or the one after the last."""
    letters = re.match(r"[A-Za-z]+", place or "")
    if not letters:
        return after
    n = 0
    for c in letters.group().upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def _cell(c: XML.Element, strings: list[str]) -> str:
    kind, v = c.get("t", "n"), next((x.text or "" for x in c if _name(x) == "v"), "")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in _all(c, "t"))
    if kind == "s":
        return strings[int(v)] if v else ""
    return {"1": "True", "0": "False"}.get(v, v) if kind == "b" else v


def xlsx(content: bytes) -> list[str]:
    parts = Parts(content)
    strings = ["".join(t.text or "" for t in _all(si, "t")) for si in _kids(parts.xml("xl/sharedStrings.xml"), "si")] if parts.has("xl/sharedStrings.xml") else []
    at, pages = parts.related("xl/workbook.xml"), []
    for sheet in _all(parts.xml("xl/workbook.xml"), "sheet"):
        ref = next(v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id")
        lines = []
        for row in _all(parts.xml(at[ref]), "row"):
            cells: list[str] = []
            for c in _kids(row, "c"):
                i = _column(c.get("r"), len(cells))
                if i >= 16_384:
                    raise ValueError("a cell lies beyond the last column")
                cells += [""] * (i + 1 - len(cells))
                cells[i] = _cell(c, strings)
            if cells:
                lines.append(" | ".join(cells))
        pages.append("\n".join(lines))
    return pages


def pptx(content: bytes) -> list[str]:
    parts = Parts(content)
    at, pages = parts.related("ppt/presentation.xml"), []
    for slide in _all(parts.xml("ppt/presentation.xml"), "sldId"):
        ref = next(v for k, v in slide.attrib.items() if k.rpartition("}")[2] == "id" and k != "id")
        shapes = [b for b in _all(parts.xml(at[ref]), "txBody")]
        pages.append("\n".join("\n".join(_said(p) for p in _kids(b, "p")) for b in shapes))
    return pages


READERS = {".docx": docx, ".xlsx": xlsx, ".pptx": pptx}
