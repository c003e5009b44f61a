import io
import zipfile

from feuillet.sources import files, pages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = packed({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Un </w:t><w:t>contrat</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>caché</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Fin</w:t></w:r></w:p></w:body></w:document>"})
PPTX = packed({
    "ppt/slides/slide1.xml": f"<s {A}/>",
    "ppt/slides/slide2.xml": f"<s {A}><a:p><a:r><a:t>Titre</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>y</a:t></a:r></a:p></a:tc></a:tr></a:tbl></s>",
})
XLSX = packed({
    "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Feuille" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Libellé</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v> 12 </v></c><c/></row><row><c/></row></sheetData></worksheet>',
})


def test_office_readers():
    assert files.word_text(DOCX) == "Un contrat\n\nFin"
    assert files.slide_text(PPTX) == "Slide 2\n\nTitre\nx | y"  # the number is a paragraph of its own
    assert files.sheet_text(XLSX) == "Sheet: Feuille\n\nLibellé | 12"


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "Banque").mkdir()
    for name, data in {"Banque/a.docx": DOCX, "Banque/copie.docx": DOCX, "b.xlsx": XLSX, "c.txt": b"no", "broken.pptx": b"zip?"}.items():
        (tmp_path / name).write_bytes(data)
    light = files.scan(spark, str(tmp_path))
    assert sorted(r.relative_path for r in light.collect()) == ["Banque/a.docx", "Banque/copie.docx", "b.xlsx", "broken.pptx"] and "content" not in light.columns
    rows = {r.relative_path: r for r in files.extract(files.scan(spark, str(tmp_path), content=True)).collect()}
    assert rows["Banque/copie.docx"].text == "Un contrat\n\nFin" and rows["broken.pptx"].text is None and "BadZipFile" in rows["broken.pptx"].error


def test_route_pdf(spark):
    rows = spark.createDataFrame([("a", "texte clair", False, None, None), ("b", "texte clair", True, "image", None), ("c", "", True, "i", "page"), ("d", "1 2 3 4 5 6 7", None, "i", None)], "path string, native string, has_raster boolean, image_text string, page_text string")
    assert {r.path: (r.case, r.text) for r in files.route_pdf(rows).collect()} == {"a": ("A", "texte clair"), "b": ("B", "texte clair\nimage"), "c": ("C", "page"), "d": ("C", "1 2 3 4 5 6 7\ni")}  # garbled text is kept, what was recognised comes after it


def test_cells_of_all_kinds():
    book = packed({
        "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="F" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00 &quot;jours&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="20"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c><v>3</v></c><c><v>3.50</v></c><c s="1"><v>45292</v></c><c s="1"><v>45292.75</v></c><c s="2"><v>7.0</v></c><c s="3"><v>0.5</v></c><c t="str"><v> a </v></c><c t="e"><v>#N/A</v></c><c t="inlineStr"><is><t>b</t></is></c></row></sheetData></worksheet>',
    })
    assert files.sheet_text(book) == "Sheet: F\n\nTrue | False | 3 | 3.5 | 2024-01-01 00:00:00 | 2024-01-01 18:00:00 | 7.0 | 12:00:00 | a | #N/A | b"


def test_slides_and_shapes_keep_their_order():
    p = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc><a:tc><a:p/></a:tc><a:tc><a:p><a:r><a:t>y</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>"
    slide = lambda *shapes: f"<p:sld {p} {A}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
    deck = packed({
        "ppt/presentation.xml": f'<p:presentation {p}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide(shape("avant"), table, shape("après")), "ppt/slides/slide2.xml": slide(shape("premier"), "<p:grpSp>" + shape("groupe") + "</p:grpSp>"),
    })
    assert files.slide_text(deck) == "Slide 1\n\npremier\n\nSlide 2\n\navant\nx | y\naprès"


def test_pdf_chain(spark):
    def lines(data):
        """A stand-in for PDF: one line a page, `text|says` with what its only image says, or `!` for a broken file."""
        if data.startswith(b"!"):
            raise ValueError("broken")
        return [line.split("|") for line in data.decode().split("\n")]

    raw = lambda says: says.encode().ljust(210 * 200 * 3, b" ")
    readers = {
        "native": lambda data: [t for t, _ in lines(data)],
        "images": lambda data: [(n, 0, 210, 200, raw(says)) for n, (_, says) in enumerate(lines(data)) if says],
        "render": lambda data: [f"page {n}: {says}".encode() for n, (_, says) in enumerate(lines(data))],
        "recognise": lambda image: bytes(image).decode().strip(),
    }
    rows = [("a.pdf", b"un texte|"), ("b.pdf", b"un texte|tampon\nsuite|tampon"), ("copie.pdf", b"un texte|tampon\nsuite|tampon"), ("c.pdf", b"1 2 3|scan\n|fin"), ("d.pdf", b"!"), ("e.docx", DOCX)]
    df = spark.createDataFrame([(p, "." + p.rsplit(".")[-1], bytearray(c)) for p, c in rows], "path string, file_type string, content binary").selectExpr("*", "sha2(content, 256) as content_hash")
    got = {r.path: (r.text, r.error) for r in files.extract_documents(df, readers).collect()}
    assert got["a.pdf"] == ("un texte", None) and got["b.pdf"] == got["copie.pdf"] == ("un texte\nsuite\ntampon", None)
    assert got["c.pdf"] == ("1 2 3\npage 0: scan\npage 1: fin", None) and got["d.pdf"][0] is None and got["d.pdf"][1] and got["e.docx"] == ("Un contrat\n\nFin", None)

def test_animation_reader():
    read = pages.animation_reader(lambda data: data.decode().split(","), str)
    assert read(b"a,b,a") == "a\n\nb" and read(b"a,x,x,b,x,c") == "a\n\nb\n\nc" and read(b"x") == "x"
