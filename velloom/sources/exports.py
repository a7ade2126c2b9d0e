"""Sinks: documents as txt, md, docx, xlsx and pdf files, made with the standard library."""

from __future__ import annotations

import io
import os
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import select_text
from ..operators.jobs import export_name, export_status

#: Media types and extensions of the formats.
FORMATS = {
    "txt": "text/plain; charset=utf-8",
    "md": "text/markdown; charset=utf-8",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pdf": "application/pdf",
}
#: An A4 page and its margins, size and leading of the text, space after a block, in points.
PAGE, MARGINS, SIZE, LEADING, AFTER = (595.2756, 841.8898), (72.0, 56.6929), 12, 16, 10
#: Widths of Helvetica's characters from space to tilde, in thousandths.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return out.getvalue()


def _rels(kind: str, target: str) -> str:
    return f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_REL}/{kind}" Target="{target}"/></Relationships>'


def _content(part: str, kind: str, more: str = "") -> str:
    return f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="{part}" ContentType="application/vnd.openxmlformats-officedocument.{kind}+xml"/>{more}</Types>'


def blocks(text: str) -> list[list[str]]:
    """SNK6 for one text."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def docx(text: str) -> bytes:
    """SNK3: a paragraph for each block, a line break for each inner line."""
    t = lambda x: f'<w:t xml:space="preserve">{escape(x)}</w:t>'
    body = "".join("<w:p><w:r>" + "<w:br/>".join(map(t, b)) + "</w:r></w:p>" for b in blocks(text)) or "<w:p/>"
    main = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    return _zip({"[Content_Types].xml": _content("/word/document.xml", "wordprocessingml.document.main"), "_rels/.rels": _rels("officeDocument", "word/document.xml"), "word/document.xml": main})


def xlsx(text: str) -> bytes:
    """SNK4: a sheet of the lines that aren't blank, numbered."""
    lines = [x for x in text.split("\n") if x.strip()]
    cell = lambda x: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'
    rows = f"<row>{cell('#')}{cell('Текст')}</row>" + "".join(f"<row><c><v>{i}</v></c>{cell(x)}</row>" for i, x in enumerate(lines, 1))
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{space}"><cols><col min="2" max="2" width="100" customWidth="1"/></cols><sheetData>{rows}</sheetData></worksheet>'
    book = f'<workbook xmlns="{space}" xmlns:r="{_REL}"><sheets><sheet name="OCR" sheetId="1" r:id="rId1"/></sheets></workbook>'
    more = '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    return _zip({"[Content_Types].xml": _content("/xl/workbook.xml", "spreadsheetml.sheet.main", more), "_rels/.rels": _rels("officeDocument", "xl/workbook.xml"), "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": _rels("worksheet", "worksheets/sheet1.xml"), "xl/worksheets/sheet1.xml": sheet})


class TrueType:
    """What a PDF needs of a TrueType font: glyphs of characters, widths, and the file itself."""

    def __init__(self, data: bytes):
        self.data = data
        tables = {data[i : i + 4]: struct.unpack_from(">II", data, i + 8) for i in range(12, 12 + 16 * struct.unpack_from(">H", data, 4)[0], 16)}
        at = lambda name: tables[name][0]
        self.em = struct.unpack_from(">H", data, at(b"head") + 18)[0]
        metrics = struct.unpack_from(">H", data, at(b"hhea") + 34)[0]
        self.widths = [struct.unpack_from(">H", data, at(b"hmtx") + 4 * i)[0] * 1000 // self.em for i in range(metrics)]
        cmap = at(b"cmap")
        for i in range(struct.unpack_from(">H", data, cmap + 2)[0]):
            where = cmap + struct.unpack_from(">I", data, cmap + 8 + 8 * i)[0]
            if struct.unpack_from(">H", data, where)[0] == 4:
                break
        else:
            raise ValueError("no Unicode characters in this font")
        n = struct.unpack_from(">H", data, where + 6)[0] // 2
        row = lambda k, code="H": struct.unpack_from(f">{n}{code}", data, where + 14 + 2 * n * k + (2 if k else 0))
        self.segments = list(zip(row(0), row(1), row(2, "h"), row(3), range(where + 16 + 6 * n, where + 16 + 8 * n, 2)))

    def glyph(self, char: str) -> int:
        """The glyph of a character; 0, the mark for a missing one, where there is none."""
        for end, start, delta, offset, at in self.segments:
            if ord(char) <= end:
                if ord(char) < start:
                    return 0
                if not offset:
                    return (ord(char) + delta) & 0xFFFF
                found = struct.unpack_from(">H", self.data, at + offset + 2 * (ord(char) - start))[0]
                return (found + delta) & 0xFFFF if found else 0
        return 0

    def width(self, char: str) -> int:
        g = self.glyph(char)
        return self.widths[min(g, len(self.widths) - 1)]


def first_font(paths: Iterable[str]) -> bytes | None:
    """SNK7: the first of the files that exists."""
    for path in paths:
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    return None


def _wrapped(line: str, width: Callable[[str], int], most: float) -> list[str]:
    """A line cut at spaces to what fits; a longer word is cut where it must be."""
    out, now, used = [], "", 0.0
    for word in line.split():
        need = sum(map(width, word)) * SIZE / 1000
        gap = width(" ") * SIZE / 1000
        if now and used + gap + need > most:
            out.append(now)
            now, used = "", 0.0
        if now:
            now, used = f"{now} {word}", used + gap + need
            continue
        for c in word:
            w = width(c) * SIZE / 1000
            if now and used + w > most:
                out.append(now)
                now, used = "", 0.0
            now, used = now + c, used + w
    return [*out, now]


def pdf(text: str, font: bytes | None = None) -> bytes:
    """SNK5: blocks as paragraphs of wrapped lines on A4 pages; one empty page for a text without any.

    With a TrueType ``font`` every character it has is written; without, Helvetica, which has only Western ones (others become "?").
    """
    own = TrueType(font) if font else None
    width = own.width if own else lambda c: HELVETICA[ord(c) - 32] if " " <= c <= "~" else 556
    pages: list[list[tuple[float, str]]] = [[]]
    y = top = PAGE[1] - MARGINS[1]
    for block in blocks(text):
        for line in block:
            for piece in _wrapped(line, width, PAGE[0] - 2 * MARGINS[0]):
                if y - LEADING < MARGINS[1]:
                    pages.append([])
                    y = top
                y -= LEADING
                pages[-1].append((y, piece))
        y -= AFTER

    def shown(s: str) -> str:
        if own:
            return "<" + "".join(f"{own.glyph(c):04x}" for c in s) + ">"
        plain = s.encode("cp1252", "replace").decode("latin-1")
        return "(" + "".join("\\" + c if c in "()\\" else c for c in plain) + ")"

    objects: list[bytes] = []
    add = lambda body: objects.append(body if isinstance(body, bytes) else body.encode("latin-1")) or len(objects)
    stream = lambda data, more="": f"<< /Length {len(z := zlib.compress(data))} /Filter /FlateDecode{more} >>\nstream\n".encode() + z + b"\nendstream"
    add("<< /Type /Catalog /Pages 2 0 R >>")
    add("")  # the pages, known later
    if own:
        used = sorted({c for page in pages for _, s in page for c in s})
        file = add(stream(font, f" /Length1 {len(font)}"))
        about = add(f"<< /Type /FontDescriptor /FontName /Embedded /Flags 4 /FontBBox [0 -300 1000 1000] /ItalicAngle 0 /Ascent 900 /Descent -250 /CapHeight 700 /StemV 80 /FontFile2 {file} 0 R >>")
        wide = " ".join(f"{own.glyph(c)} [{own.width(c)}]" for c in used)
        inner = add(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Embedded /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor {about} 0 R /W [{wide}] /CIDToGIDMap /Identity >>")
        pairs = "".join(f"1 beginbfchar\n<{own.glyph(c):04x}> <{c.encode('utf-16-be').hex()}>\nendbfchar\n" for c in used)
        names = add(stream(f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /T def /CMapType 2 def\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n{pairs}endcmap end end".encode()))
        face = add(f"<< /Type /Font /Subtype /Type0 /BaseFont /Embedded /Encoding /Identity-H /DescendantFonts [{inner} 0 R] /ToUnicode {names} 0 R >>")
    else:
        face = add("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    kids = []
    for page in pages:
        body = "".join(f"BT /F1 {SIZE} Tf {MARGINS[0]} {y:.2f} Td {shown(s)} Tj ET\n" for y, s in page)
        held = add(stream(body.encode("latin-1")))
        kids.append(add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE[0]} {PAGE[1]}] /Resources << /Font << /F1 {face} 0 R >> >> /Contents {held} 0 R >>"))
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
    return bytes(out)


def build(text: str | None, fmt: str, font: bytes | None = None) -> bytes:
    """One file. An unknown format is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    made = {"docx": docx, "xlsx": xlsx, "pdf": lambda t: pdf(t, font)}
    return made.get(fmt, lambda t: t.encode())(text or "")


def files(df: DataFrame, id_col: str, text_col: str, fmt: str, font: bytes | None = None) -> DataFrame:
    """(id, file_name, media_type, content): a file for each row. ``font`` goes to the workers with the task."""
    media = FORMATS[fmt] if fmt in FORMATS else build("", fmt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "file_name": [f"ocr-{str(i)[:8]}.{fmt}" for i in b["id"]], "media_type": media, "content": [build(t, fmt, font) for t in b["text"]]})

    return df.selectExpr(f"cast(`{id_col}` as string) id", f"`{text_col}` text").mapInPandas(run, "id string, file_name string, media_type string, content binary")


def export(asked: DataFrame, jobs: DataFrame, font: bytes | None = None) -> DataFrame:
    """API6, SNK8: (job_id, format, which, http_status, file_name, media_type, content) for each request (job_id, format, which).

    ``jobs`` has job_id, status, text and text_corrected. The first check that fails gives the status: format, job, state; such a request
    has no file. Which text is written is PRJ2's rule. Catalyst picks the join by size; files are made row by row.
    """
    known = jobs.select("job_id", "status", "text", "text_corrected", F.lit(True).alias("known"))
    found = asked.select("job_id", "format", "which").join(known, "job_id", "left")
    status = export_status(F.col("format"), F.coalesce("known", F.lit(False)), F.col("status"))
    picked = found.select(F.col("job_id").cast("string").alias("job_id"), "format", "which", status.alias("http_status"), select_text(F.col("which"), F.col("text"), F.col("text_corrected")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fine = (b["http_status"] == 200).tolist()
            b["media_type"] = [FORMATS[f] if ok else None for f, ok in zip(b["format"], fine)]
            b["content"] = [build(t, f, font) if ok else None for t, f, ok in zip(b["text"], b["format"], fine)]
            yield b.drop(columns="text")

    made = picked.mapInPandas(run, "job_id string, format string, which string, http_status int, media_type string, content binary")
    name = F.when(F.col("http_status") == 200, export_name(F.col("job_id"), F.col("format")))
    return made.select("job_id", "format", "which", "http_status", name.alias("file_name"), "media_type", "content")
