"""Files as rows: types, text out of them, and the same file with its text replaced."""

from __future__ import annotations

import codecs
import io
import re
import shutil
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from xml.etree import ElementTree
from xml.parsers import expat
from xml.parsers.expat import ExpatError
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.rows import by_row

# MIME types, and the extensions that stand for them.
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
IMAGES = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/tiff")
PLAIN = ("text/plain", "text/csv", "text/html", "text/markdown")
FORMATS = {
    "application/pdf": "pdf",
    DOCX: "docx",
    XLSX: "xlsx",
    "image/png": "image",
    "image/jpeg": "image",
    "image/gif": "image",
    "image/webp": "image",
    "image/tiff": "image",
    "text/plain": "plain",
    "text/csv": "plain",
    "text/html": "plain",
    "text/markdown": "plain",
}
PASSABLE = ("application/pdf", *IMAGES, *PLAIN)
REBUILT = (DOCX, XLSX, *PLAIN)
REVEALED = (DOCX, XLSX, *PLAIN, "text/tab-separated-values", "application/json")
EXTENSIONS = {
    "pdf": "application/pdf",
    "docx": DOCX,
    "xlsx": XLSX,
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "txt": "text/plain",
    "csv": "text/csv",
    "md": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "json": "application/json",
    "tsv": "text/tab-separated-values",
}
OCTETS = "application/octet-stream"
PDF_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")
MOST_PIXELS, MOST_SIDE = 50_000_000, 4096
MOST_BYTES, MOST_PAGES, MOST_UNZIPPED, MOST_RATIO = 25 * 2**20, 50, 200 * 10**6, 100


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, content, mime_type of the files in each folder (not below it) and of each file that is named."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.withColumn("mime_type", mime_type(F.col("path"), F.col("content")))


def mime_type(path: Column, content: Column) -> Column:
    """By the first bytes, else by the extension, else octets."""
    head = F.hex(F.substring(content, 1, 12))
    magic = (("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for start, mime in magic:
        out = out.when(head.startswith(start), mime)
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return out.otherwise(F.coalesce(known[extension], F.lit(OCTETS)))


def format_of(mime: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))[mime]


def plain_text(content: Column) -> Column:
    """UTF-8, with a replacement character for what is none."""
    return F.make_valid_utf8(content.cast("string"))


def zip_problem(content: bytes) -> str | None:
    """Why an office file is not opened; read from its directory alone."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except (zipfile.BadZipFile, ValueError) as e:
        return f"not a zip file: {e}"
    size, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    if size > MOST_UNZIPPED:
        return f"would unpack to {size} bytes"
    return f"packed more than {MOST_RATIO} times" if size > MOST_RATIO * max(packed, 1) else None


# XML namespaces.
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
W, S = "{" + WORD_NS + "}", "{" + SHEET_NS + "}"


def _surfaces(names: list[str]) -> list[str]:
    """The parts of a document that hold text: body, headers, footers, comments."""
    return [n for n in ("word/document.xml", *sorted(x for x in names if x.startswith(("word/header", "word/footer"))), "word/comments.xml") if n in names]


def _sheets(names: list[str]) -> list[str]:
    """Worksheets in the order of their numbers."""
    return sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet[0-9]*\.xml", x)), key=lambda x: (len(x), x))


def _outermost(part, tag: str) -> Iterator[ElementTree.Element]:
    """Elements with the tag that are in no other such element; each is forgotten once it has been looked at, like all else."""
    path, inside = [], 0
    for event, e in ElementTree.iterparse(part, ("start", "end")):
        if event == "start":
            path.append(e)
            inside += e.tag == tag
            continue
        path.pop()
        inside -= e.tag == tag
        if not inside:
            if e.tag == tag:
                yield e
            if path:
                path[-1].remove(e)


def docx_text(content: bytes) -> str:
    found = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for n in _surfaces(z.namelist()):
            with z.open(n) as part:
                found += ["".join(t.text or "" for t in p.iter(W + "t")).strip() for e in _outermost(part, W + "p") for p in e.iter(W + "p")]
    return "\n".join(x for x in found if x)


def column_number(reference: str) -> int:
    """1 for A, 27 for AA; 0 if the reference has no letters."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n


def xlsx_cells(content: bytes) -> Iterator[tuple[int, int, int, str, bool]]:
    """The filled cells: sheet (from 0), row, column (both from 1), what they show, and whether that is text. One row is in memory at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, shared = z.namelist(), []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in _outermost(part, S + "si")]
        for sheet, n in enumerate(_sheets(names)):
            at_row = 0
            with z.open(n) as part:
                for row in (x for e in _outermost(part, S + "row") for x in e.iter(S + "row")):
                    at_row, at = int(row.get("r") or at_row + 1), 0
                    for c in row.iter(S + "c"):
                        at, kind, value = column_number(c.get("r") or "") or at + 1, c.get("t"), c.find(S + "v")
                        text = "".join(t.text or "" for t in c.iter(S + "t")) if kind == "inlineStr" else value.text if value is not None else None
                        text = shared[int(text)] if kind == "s" and text is not None else text
                        if text is not None:
                            yield sheet, at_row, at, text, kind in ("s", "inlineStr", "str")


def xlsx_grid(content: bytes) -> list[list[tuple[int, int, str, bool]]]:
    """By sheet, its filled cells: row, column, what they show, and whether that is text; see `xlsx_cells`."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheets = [[] for _ in _sheets(z.namelist())]
    for sheet, *cell in xlsx_cells(content):
        sheets[sheet].append(tuple(cell))
    return sheets


def xlsx_lines(cells: Iterable[tuple[int, int, int, str, bool]]) -> str:
    """A line for each row, its cells joined by bars."""
    return "\n".join(" | ".join(c[3] for c in row) for _, row in groupby(cells, key=lambda c: c[:2]))


def xlsx_text(content: bytes) -> str:
    return xlsx_lines(xlsx_cells(content))


def _made_lines(rows: Iterable[Iterable[str | float | None]]) -> Iterator[str]:
    for i, row in enumerate(rows, 1):
        cells = []
        for x, value in enumerate(row):
            at = f"{column_letters(x + 1)}{i}"
            if isinstance(value, str):
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
            elif value is not None:
                cells.append(f'<c r="{at}"><v>{value!r}</v></c>')
        yield f'<row r="{i}">{"".join(cells)}</row>'


def xlsx_made(rows: Iterable[Iterable[str | float | None]]) -> bytes:
    """A workbook of one sheet: texts and numbers, nothing for null."""
    relations, office = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{main}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{relations}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{SHEET_NS}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{relations}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    head, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, head + xml)
        with z.open("xl/worksheets/sheet1.xml", "w") as part:
            part.write(f'{head}<worksheet xmlns="{SHEET_NS}"><sheetData>'.encode())
            for line in _made_lines(rows):
                part.write(line.encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


#: Bytes of an XML part that are read at a time.
PIECE = 2**16
TAG = re.compile(rb"<[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
ATTRIBUTE = re.compile(rb"([^\s=/<>]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')")
DECLARED = re.compile(rb"""(<\?xml[^>]*?\sencoding\s*=\s*["'])([A-Za-z0-9._-]+)""")


def _pieces(part) -> Iterator[bytes]:
    """An XML part bit by bit, in UTF-8 whatever it was written in."""
    data = part.read(PIECE)
    named, wide = DECLARED.match(data), data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
    try:
        code = codecs.lookup("utf-16" if wide else named[2].decode() if named else "utf-8")
    except LookupError as e:
        raise ValueError(str(e)) from e
    decoder = None if code.name in ("utf-8", "ascii") else code.incrementaldecoder()
    first = True
    while data:
        if decoder:
            data = decoder.decode(data).encode()
            data, first = DECLARED.sub(rb"\1utf-8", data, count=1) if first else data, False
        yield data
        data = part.read(PIECE)


class _Node:
    """An element: its name as "namespace}name", attributes, own text, where it and its end tag begin, and how many nodes there are up to its end."""

    __slots__ = ("attrs", "close", "last", "name", "start", "text")

    def __init__(self, name: str, attrs: dict[str, str], start: int):
        self.name, self.attrs, self.start, self.text = name, attrs, start, ""


def _content(text: str) -> bytes:
    return escape(text, {"\r": "&#13;"}).encode()


def _attribute(name: bytes, value: bytes, tag: bytes) -> bytes:
    """A start tag with an attribute set."""
    pair = name + b'="' + value + b'"'
    for m in ATTRIBUTE.finditer(tag):
        if m[1] == name:
            return tag[: m.start()] + pair + tag[m.end() :]
    return tag[:-1].rstrip() + b" " + pair + b">"


def _with_text(tag: bytes, text: str) -> bytes:
    """A start tag and the text behind it."""
    return (_attribute(b"xml:space", b"preserve", tag) if text != text.strip() else tag) + _content(text)


def _copied(part, write, held, change) -> None:
    """The XML part, byte by byte but for what `change` has edited.

    held(name, attributes) says of each element whether it is to be kept until its end;
    change(nodes) is given it with all that is in it, and gives edits: a node, and a function
    from its start tag to that tag with all of its new content. Nothing else is in memory.
    """
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    data, base, out, nodes, path = bytearray(), 0, bytearray(), [], []

    def copy(to: int) -> None:
        nonlocal base
        out.extend(memoryview(data)[: to - base])
        del data[: to - base]
        base = to

    def start(name: str, attrs: dict[str, str]) -> None:
        if path or held(name, attrs):
            path.append(_Node(name, attrs, parser.CurrentByteIndex))
            nodes.append(path[-1])

    def text(x: str) -> None:
        if path:
            path[-1].text += x

    def end(_: str) -> None:
        nonlocal base
        if not path:
            return
        node = path.pop()
        node.close, node.last = parser.CurrentByteIndex, len(nodes)
        if path:
            return
        for node, made in sorted(change(nodes), key=lambda x: x[0].start):
            copy(node.start)
            tag = TAG.match(data)[0]
            if tag.endswith(b"/>"):
                behind, tag, last = len(tag), tag[:-2].rstrip() + b">", b"</" + re.match(rb"<([^\s/>]+)", tag)[1] + b">"
            else:
                behind = data.index(b">", node.close - base) + 1
                last = bytes(data[node.close - base : behind])
            out.extend(made(tag) + last)
            del data[:behind]
            base += behind
        nodes.clear()

    def entity(name: str, _, value: str | None, *__) -> None:
        if value is None or "<" in value:
            raise ValueError(f"entity {name} is not plain text")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, text, entity
    for piece in _pieces(part):
        data += piece
        parser.Parse(piece, False)
        copy(nodes[0].start if nodes else max(base, parser.CurrentByteIndex))
        write(out)
        out.clear()
    parser.Parse(b"", True)
    write(data)


def _rewritten(content: bytes, parts, editor) -> bytes:
    """The package with edits in some parts: editor(name) gives `held` and `change`, see `_copied`."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        some = parts(z.namelist())
        for info in z.infolist():
            if info.is_dir():
                new.writestr(info.filename, b"")
                continue
            with z.open(info) as part, new.open(info.filename, "w") as to:
                if info.filename in some:
                    _copied(part, to.write, *editor(info.filename))
                else:
                    shutil.copyfileobj(part, to)
    return out.getvalue()


def _swapped(nodes: list[_Node], groups, swap) -> list[tuple]:
    """Edits of `swap` on the text that the nodes of each group have together; what changes stands in the first."""
    now = {}
    for own in groups(nodes):
        was = "".join(now.get(x, x.text) for x in own)
        if own and (new := swap(was)) != was:
            now |= {x: "" for x in own} | {own[0]: new}
    return [(x, lambda tag, text=text: _with_text(tag, text)) for x, text in now.items()]


def _within(nodes: list[_Node], at: int, name: str) -> list[_Node]:
    return [x for x in nodes[at + 1 : nodes[at].last] if x.name == name]


def _paragraphs(nodes: list[_Node]) -> list[list[_Node]]:
    return [_within(nodes, i, W[1:] + "t") for i, x in enumerate(nodes) if x.name == W[1:] + "p"]


def _cell_texts(nodes: list[_Node]) -> list[list[_Node]]:
    out = [_within(nodes, i, S[1:] + "t") for i, x in enumerate(nodes) if x.name in (S[1:] + "si", S[1:] + "is")]
    return out + [[v] for i, x in enumerate(nodes) if x.name == S[1:] + "c" and x.attrs.get("t") == "str" for k in ("v", "f") for v in _within(nodes, i, S[1:] + k)]


def _cell_parts(names: list[str]) -> list[str]:
    return [*_sheets(names), *(n for n in ("xl/sharedStrings.xml",) if n in names)]


def _is_paragraph(name: str, _: dict[str, str]) -> bool:
    return name == W[1:] + "p"


def _is_cell_text(name: str, attrs: dict[str, str]) -> bool:
    return name in (S[1:] + "si", S[1:] + "is") or name == S[1:] + "c" and attrs.get("t") == "str"


def docx_changed(content: bytes, swap) -> bytes:
    """The document with `swap` on the text of each paragraph; what changes stands in its first run."""
    return _rewritten(content, _surfaces, lambda _: (_is_paragraph, lambda nodes: _swapped(nodes, _paragraphs, swap)))


def xlsx_changed(content: bytes, swap) -> bytes:
    """The workbook with `swap` on each text cell, and on formulas that give a text and what they gave last; numbers stay."""
    return _rewritten(content, _cell_parts, lambda _: (_is_cell_text, lambda nodes: _swapped(nodes, _cell_texts, swap)))


def office_texts(content: bytes, kind: str, see) -> None:
    """Calls `see` with each text that `docx_changed` or `xlsx_changed` would swap."""
    parts, held, groups = (_surfaces, _is_paragraph, _paragraphs) if kind == DOCX else (_cell_parts, _is_cell_text, _cell_texts)

    def change(nodes: list[_Node]) -> list:
        for own in groups(nodes):
            see("".join(x.text for x in own))
        return []

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for n in parts(z.namelist()):
            with z.open(n) as part:
                _copied(part, lambda _: None, held, change)


def xlsx_filled(content: bytes, tokens: dict[tuple[int, int, int], str]) -> bytes:
    """The workbook with the given texts in cells named by sheet (from 0), row and column; a formula there goes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        order = {n: i for i, n in enumerate(_sheets(z.namelist()))}

    def editor(name: str):
        at_row, at, token = 0, 0, None

        def held(tag: str, attrs: dict[str, str]) -> bool:
            nonlocal at_row, at, token
            if tag == S[1:] + "row":
                at_row, at = int(attrs.get("r") or at_row + 1), 0
            elif tag == S[1:] + "c":
                at = column_number(attrs.get("r") or "") or at + 1
                token = tokens.get((order[name], at_row, at))
                return token is not None
            return False

        def filled(tag: bytes) -> bytes:
            prefix = re.match(rb"<([^\s/>:]+:)?", tag)[1] or b""
            return _attribute(b"t", b"inlineStr", tag) + b"<" + prefix + b"is>" + _with_text(b"<" + prefix + b"t>", token) + b"</" + prefix + b"t></" + prefix + b"is>"

        return held, lambda nodes: [(nodes[0], filled)]

    return _without_unused(_rewritten(content, _sheets, editor))


def _without_unused(content: bytes) -> bytes:
    """The workbook with empty shared strings in place of those that no cell shows any more."""
    used = set()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "xl/sharedStrings.xml" not in z.namelist():
            return content
        for n in _sheets(z.namelist()):
            with z.open(n) as part:
                used.update(int(v.text) for e in _outermost(part, S + "c") for c in e.iter(S + "c") if c.get("t") == "s" for v in c.iter(S + "v") if v.text)

    def editor(_: str):
        at = -1

        def change(nodes: list[_Node]) -> list:
            nonlocal at
            at += 1
            return [] if at in used else _swapped(nodes, _cell_texts, lambda _: "")

        return lambda name, _: name == S[1:] + "si", change

    return _rewritten(content, lambda names: [n for n in names if n == "xl/sharedStrings.xml"], editor)


def swapping(pairs: dict[str, str]):
    """A function that replaces each key wherever it stands, in their order."""

    def swap(text: str) -> str:
        for old, new in pairs.items():
            text = text.replace(old, new)
        return text

    return swap


def pdf_text(pages: list[str], metadata: dict[str, str | None], ocr: Callable[[int], str] | None = None, most_pages: int = MOST_PAGES, least_chars: int = 100) -> str:
    """What a PDF reader gives, put together: entries of the information dictionary, then pages, all apart by an empty line.

    A page whose text layer has fewer than `least_chars` characters is read by ocr (its
    number, from 0), where there is one.
    """
    head = "\n".join(f"{k}: {metadata[k]}" for k in PDF_KEYS if metadata.get(k))
    body = "\n\n".join(ocr(i) if ocr and len(page.strip()) < least_chars else page for i, page in enumerate(pages[:most_pages]))
    return "\n\n".join(x for x in (head, body) if x)


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF or JPEG, read from its head; nothing for other bytes."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    if content[:4] == b"GIF8" and len(content) >= 10:
        return int.from_bytes(content[6:8], "little"), int.from_bytes(content[8:10], "little")
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        if 0xC0 <= content[at + 1] <= 0xCF and content[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def ocr_size(width: int, height: int) -> tuple[int, int]:
    """The size at which an image goes to OCR; an error for one with too many pixels."""
    if width * height > MOST_PIXELS:
        raise ValueError(f"an image of {width * height} pixels is not opened")
    longest = max(width, height)
    return (width, height) if longest <= MOST_SIDE else (int(width * MOST_SIDE / longest), int(height * MOST_SIDE / longest))


def extracted(files: DataFrame, pdf=None, ocr=None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files (content, mime_type) with `text` and `extraction_error`; one of them is null.

    Plain formats are decoded by Spark. DOCX and XLSX are read from their XML after a
    look at the zip directory. pdf (bytes, pages -> text, or the pages and metadata that
    `pdf_text` puts together) and ocr (bytes, size or nothing -> text) are plug-ins; without
    one, such files have an error. ocr is told the size to scale an image to, and not
    called for one with too many pixels.
    """
    size_ok, fmt = F.length("content") <= most_bytes, format_of(F.col("mime_type"))

    def office(content, kind) -> tuple[str | None, str | None]:
        data, own = content.as_py(), kind.as_py()
        if data is None:
            return None, None
        try:
            if own in ("docx", "xlsx"):
                problem = zip_problem(data)
                return (None, problem) if problem else ((docx_text if own == "docx" else xlsx_text)(data), None)
            if own == "pdf":
                read = pdf(data, MOST_PAGES) if pdf else None
                return (None, "no PDF extractor") if not pdf else (read if isinstance(read, str) else pdf_text(*read), None)
            if not ocr:
                return None, "OCR is off"
            size = image_size(data)
            return ocr(data, ocr_size(*size) if size else None), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    binary = size_ok & fmt.isin("docx", "xlsx", "pdf", "image")
    read = files.withColumn("_read", by_row("struct<text string, error string>", office)(F.when(binary, F.col("content")), fmt))
    text = F.when(size_ok & (fmt == "plain"), plain_text(F.col("content"))).otherwise(F.col("_read.text"))
    error = F.when(~size_ok, F.lit("file too large")).when(fmt.isNull(), F.concat(F.lit("unsupported type: "), F.coalesce("mime_type", F.lit("none")))).otherwise(F.col("_read.error"))
    return read.withColumn("text", text).withColumn("extraction_error", error).drop("_read")


def rebuilt(files: DataFrame) -> DataFrame:
    """files (content, mime_type, redacted, replacements) with `output`: the same kind of file, null where that can't be made."""

    def office(content, mime, replacements) -> bytes | None:
        data, pairs = content.as_py(), dict(replacements.as_py() or [])
        try:
            if data is not None and not zip_problem(data):
                return (docx_changed if mime.as_py() == DOCX else xlsx_changed)(data, swapping(pairs))
        except (KeyError, ExpatError, ElementTree.ParseError, zipfile.BadZipFile, ValueError):
            pass
        return None

    mime, some = F.col("mime_type"), F.col("redacted").isNotNull()
    is_office = some & mime.isin(DOCX, XLSX)
    made = by_row("binary", office)(F.when(is_office, F.col("content")), mime, F.when(is_office, F.col("replacements")))
    return files.withColumn("output", F.when(some & mime.isin(*PLAIN), F.encode("redacted", "utf-8")).when(is_office, made))


def output_name(path: Column, rebuilt_ok: Column) -> Column:
    """The file's own name with _redacted before its extension, .txt where it could not be rebuilt."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    stem, suffix = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".(\.[^.]*)$", 1)
    return F.concat(stem, F.lit("_redacted"), F.when(rebuilt_ok, suffix).otherwise(F.lit(".txt")))
