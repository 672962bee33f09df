"""Office files made here, part by part."""

import io
import zipfile

import pytest

from textwarden.sources import office, readers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def word(body):
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def book():
    sheet = lambda rows: f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>"
    return packed({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Two" sheetId="2" r:id="b"/><sheet name="One" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>par</t></r><r><t>ts é</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"/><row r="3"><c><v>1.5</v></c><c t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row>'),
        "xl/worksheets/sheet2.xml": sheet(""),
    })


def slides():
    slide = lambda *ts: f"<p:sld {A}><p:cSld><p:spTree>" + "".join(f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p><a:r><a:t>x</a:t></a:r><a:br/><a:r><a:t>y</a:t></a:r></a:p></p:txBody></p:sp>" for t in ts) + "</p:spTree></p:cSld></p:sld>"
    return packed({
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="257" r:id="q"/><p:sldId id="256" r:id="p"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="p" Target="slides/slide1.xml"/><Relationship Id="q" Target="slides/slide2.xml"/>'),
        "ppt/slides/slide1.xml": slide("later"), "ppt/slides/slide2.xml": slide("first", "second"),
    })


def test_pages(spark, tmp_path):
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in row) + "</w:tr>" for row in (("a", "b"), ("1", "2"))) + "</w:tbl>"
    files = {
        "one.docx": word(f"<w:p>{run('Hello ')}{run('wörld &amp; co')}<w:r><w:tab/><w:t>x</w:t></w:r></w:p>{table}<w:p/>"), "two.xlsx": book(), "three.pptx": slides(), "four.txt": "plain é".encode(),
        "cut.docx": word("<w:p/>")[:60], "short.xlsx": b"x", "bomb.docx": packed({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'}), "nobody.pptx": packed({"a": "b"}),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = readers.documents(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.page)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.page, r.text, r.method))
    assert got["one.docx"] == [(1, "Hello wörld & co\tx\n\na | b\n1 | 2", "docx")]
    assert got["two.xlsx"] == [(1, "", "xlsx"), (2, "name |  | parts é\n1.5 | True | in", "xlsx")]
    assert got["three.pptx"] == [(1, "first\nx\ny\nsecond\nx\ny", "pptx"), (2, "later\nx\ny", "pptx")]
    assert got["four.txt"] == [(1, "plain é", "text")]
    assert all(got[n] == [(0, None, "error")] for n in ("cut.docx", "short.xlsx", "bomb.docx", "nobody.pptx")) and all(r.error for r in rows if r.page == 0)


def test_bounds():
    with pytest.raises(ValueError, match="larger"):
        office.Parts(word("<w:p/>"), most_bytes=10).xml("word/document.xml")
    assert office._column("AB7", 0) == 27 and office._column(None, 4) == 4
