"""Office files in Spark: their cells as rows, and their bytes with tokens put in or turned back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched
from xml.etree import ElementTree
from xml.parsers.expat import ExpatError
from zipfile import BadZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from spanveil.functions.rows import by_row
from spanveil.operators.mapping import PREFIX, SUFFIX
from spanveil.operators.splice import free_names
from spanveil.sources import files as file_source

GRID = "array<struct<sheet int, row int, col int, text string, is_text boolean>>"
UNREADABLE = (KeyError, IndexError, ValueError, BadZipFile, ExpatError, ElementTree.ParseError)
STRICT = re.compile(re.escape(PREFIX) + "[A-Z_]+_[0-9]+" + re.escape(SUFFIX))
#: Cells that are put into Arrow's form together.
CELLS = 10_000
LENIENT = re.compile(f"(?:{re.escape(PREFIX)}|[«《＜]{{1,2}})\\s*([A-Za-z_]+_[0-9]+)\\s*(?:{re.escape(SUFFIX)}|[»》＞]{{1,2}})", re.ASCII)


def opened(files: DataFrame, most_bytes: int = file_source.MOST_BYTES) -> DataFrame:
    """files (content) with `text`, `extraction_error` and `grid`, the cells of all sheets; empty for what can't be read."""

    kind = f"struct<text string, error string, grid {GRID}>"
    made = to_arrow_type(DataType.fromDDL(kind))
    grid_of = made.field("grid").type

    def read(content) -> pa.Array | tuple:
        data, chunks = content.as_py(), []

        def seen(cells: Iterator[tuple]) -> Iterator[tuple]:
            for some in batched(cells, CELLS):
                chunks.append(pa.array(some, grid_of.value_type))
                yield from some

        if data is None:
            return None, None, []
        try:
            if len(data) > most_bytes:
                return None, "file too large", []
            if problem := file_source.zip_problem(data):
                return None, problem, []
            text = file_source.xlsx_lines(seen(file_source.xlsx_cells(data)))
        except UNREADABLE as e:
            return None, f"{type(e).__name__}: {e}", []
        own = pa.concat_arrays(chunks) if chunks else pa.array([], grid_of.value_type)
        grid = pa.ListArray.from_arrays(pa.array([0, len(own)], "int32"), own, type=grid_of)
        return pa.StructArray.from_arrays([pa.array([text], made.field("text").type), pa.array([None], made.field("error").type), grid], fields=[*made])

    told = files.withColumn("grid", by_row(kind, read)("content"))
    return told.withColumns({"text": F.col("grid.text"), "extraction_error": F.col("grid.error"), "grid": F.col("grid.grid")})


def filled(files: DataFrame) -> DataFrame:
    """files (content, text, filled: sheet, row, col, pseudonym of cells) with `output` and `redacted`, its text; both null for what could not be read."""

    def one(content, readable, cells) -> tuple[bytes | None, str | None]:
        if not readable.as_py():
            return None, None
        data, tokens = content.as_py(), {}
        if cells.is_valid:
            sheet, row, col, pseudonym = (cells.values.field(k).to_pylist() for k in ("sheet", "row", "col", "pseudonym"))
            tokens = dict(zip(zip(sheet, row, col, strict=True), pseudonym, strict=True))
        out = file_source.xlsx_filled(data, tokens) if tokens else data
        return out, file_source.xlsx_text(out)

    places = F.transform("filled", lambda x: F.struct(x["sheet"].alias("sheet"), x["row"].alias("row"), x["col"].alias("col"), x["pseudonym"].alias("pseudonym")))
    (done,) = free_names(files.columns, "done")
    made = files.withColumn(done, by_row("struct<output binary, redacted string>", one)("content", F.col("text").isNotNull(), places))
    return made.withColumns({"output": F.col(f"{done}.output"), "redacted": F.col(f"{done}.redacted")}).drop(done)


def _changed(data: bytes, kind: str, swap) -> bytes:
    return (file_source.docx_changed if kind == file_source.DOCX else file_source.xlsx_changed)(data, swap)


def _spelled(token: re.Match) -> str:
    return PREFIX + token[1].upper() + SUFFIX


def _office(content: Column, mime: Column) -> Column:
    """The bytes of office files; of others, none, so that they don't go through Python."""
    return F.when(mime.isin(file_source.DOCX, file_source.XLSX), content)


def tokens_in(content: Column, mime: Column) -> Column:
    """The tokens in the text of a DOCX or XLSX file, as a mapping spells them; null for other files."""

    def one(content, mime) -> list[str] | None:
        data, kind, found = content.as_py(), mime.as_py(), set()

        def note(text: str) -> None:
            found.update(STRICT.findall(text))
            found.update(map(_spelled, LENIENT.finditer(text)))

        try:
            if data is None or file_source.zip_problem(data):
                return []
            file_source.office_texts(data, kind, note)
        except UNREADABLE:
            return []
        return sorted(found)

    return by_row("array<string>", one)(_office(content, mime), mime)


def restored(content: Column, mime: Column, pairs: Column) -> Column:
    """A DOCX or XLSX file with its tokens turned back, strictly and then leniently; null for what can't be read."""

    def one(content, mime, known) -> bytes | None:
        data, own = content.as_py(), dict(known.as_py() or [])
        try:
            if data is None or file_source.zip_problem(data):
                return None
            return _changed(data, mime.as_py(), lambda text: LENIENT.sub(lambda m: own.get(_spelled(m), m[0]), STRICT.sub(lambda m: own.get(m[0], m[0]), text)))
        except UNREADABLE:
            return None

    return by_row("binary", one)(_office(content, mime), mime, pairs)
