"""What Python holds of workbooks, bodies and plain files doesn't grow with batches."""

import contextlib
import io
import tracemalloc

import pyarrow as pa
import pytest

from spanveil.functions import rows
from spanveil.sources import bodies, files, workbooks


def _peak(f, *args) -> float:
    tracemalloc.start()
    try:
        f(*args)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", ["filled", "changed", "made"])
def test_a_workbook_is_worked_on_bit_by_bit(name):
    head, own = ["Name", "Email", "Segment"], [[f"Customer {i}", f"c{i}@x.de", "A"] for i in range(3000)]
    book, token = files.xlsx_made([head, *own]), {(0, i + 2, 2): f"<<EMAIL_{i + 1}>>" for i in range(3000)}
    if name == "filled":
        assert _peak(files.xlsx_filled, book, token) < 5  # a tree of it has some 30 MB
    elif name == "changed":
        assert _peak(files.xlsx_changed, book, lambda t: t.upper()) < 5
    else:
        assert files.xlsx_made(iter([head, *own])) is not None and files.xlsx_grid(files.xlsx_made(iter([head, *own]))) == files.xlsx_grid(book)


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


BODIES = "request_id string, stream_key string, body string, more string"


def test_bodies_go_through_python_row_by_row(spark):
    df = spark.createDataFrame([("1", "openai_chat", '{"messages": []}', "m")], BODIES)
    told = bodies.instructed(df)
    assert "MapInPandas" not in _plan(told) and told.columns == df.columns
    assert told.first().more == "m" and told.first().body.startswith('{"messages": [{"role": "system"')


FILES = "path string, content binary, mime_type string, redacted string, replacements map<string,string>"


def test_plain_files_are_rebuilt_without_python(spark):
    df = spark.createDataFrame([("/a.txt", bytearray(b"Anna"), "text/plain", "<<P_1>>", {"Anna": "<<P_1>>"}), ("/b.bin", bytearray(b"x"), "a/b", "x", {})], FILES)
    done = files.rebuilt(df)
    assert "MapInPandas" not in _plan(done) and [r.output and bytes(r.output) for r in done.collect()] == [b"<<P_1>>", None]


def test_plain_files_are_revealed_without_python(spark):
    df = spark.createDataFrame([("text/plain", bytearray(b"<<P_1>>"))], "mime string, content binary")
    told = df.select(workbooks.tokens_in(df["content"], df["mime"]).alias("t"))
    assert "CASE WHEN" in _plan(told) and told.first().t == []


def test_results_are_handed_on_before_they_are_many(monkeypatch, spark):
    monkeypatch.setattr(rows, "HANDED", 100)
    seen = {}
    monkeypatch.setattr(rows.F, "arrow_udf", lambda f, kind: seen.setdefault("f", f))
    rows.by_row("string", lambda x: x.as_py() * 30)
    out = [*seen["f"](iter([pa.array(["ab"] * 5), pa.array([], "string")]))]
    assert [len(x) for x in out] == [2, 2, 1] and out[0].to_pylist() == ["ab" * 30] * 2
