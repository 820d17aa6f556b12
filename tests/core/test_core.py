import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from spanveil import cli
from spanveil.functions import text as T
from spanveil.operators import detect, mapping, merge, plugins, reveal, splice, tables
from spanveil.plans.session import RedactionSession, redact
from spanveil.sources import bodies, files
from spanveil.sources.store import ClientBackend, MappingStore, MemoryBackend, Namespace, ParquetBackend, namespaces
from spanveil.streaming.incremental import redact_stream
from spanveil.types import ENTITIES

FEW = ("email", "ipv4", "card")


def one(spark, text, names=None, lang="de", least=0.0):
    docs = spark.createDataFrame([(1, text, lang)], "doc_id long, text string, lang string")
    rows = merge.ensemble(detect.with_rules(docs, names), least).first().entities
    return {(e.entity_type, e.text) for e in rows}


@pytest.mark.parametrize("text, want", [
    ("IBAN DE89 3704 0044 0532 0130 00.", ("IBAN", "DE89 3704 0044 0532 0130 00")), ("DE89370400440532013000", ("IBAN", "DE89370400440532013000")),
    ("Tel +49 176 8834 2219", ("PHONE", "+49 176 8834 2219")), ("65 230785 M 014", ("SVNR", "65 230785 M 014")), ("14 815 037 682", ("STEUER_ID", "14 815 037 682")),
    ("an max.mueller@example.com", ("EMAIL", "max.mueller@example.com")), ("4111 1111 1111 1111", ("CREDIT_CARD", "4111 1111 1111 1111")), ("von 192.168.1.1 aus", ("IP_ADDRESS", "192.168.1.1")),
])
def test_rules_find(spark, text, want):
    found = one(spark, text)
    assert want in found or any(k == want[0] and want[1].startswith(t) and len(t) >= len(want[1]) - 5 for k, t in found)


def test_rules_leave_alone(spark):
    for text in ("", None, "999.1.1.1", "4111 1111 1111 1112", "DE00 3704 0044 0532 0130 00", "nothing here"):
        assert not {k for k, _ in one(spark, text, (*FEW, "iban"))}
    assert one(spark, "+49 176 8834 2219", ("phone_49",), "en") == set()


def _entities(spark, rows):
    shaped = [(t, x, a, b, float(s), src) for t, x, a, b, s, src in rows]
    return spark.createDataFrame([(1, shaped)], f"doc_id long, entities {ENTITIES}")


def _brute_merge(rows):
    kept = []
    for c in sorted(rows, key=lambda e: (e[2], -(e[3] - e[2]))):
        hit = next((i for i, e in enumerate(kept) if e[0] == c[0] and e[2] < c[3] and c[2] < e[3]), None)
        if hit is None:
            kept.append(c)
            continue
        e = kept[hit]
        rank = lambda x: (x[4], x[3] - x[2], x[5] == "rules")
        kept[hit] = c if rank(c) > rank(e) else e
    return kept


def test_merge_against_a_plain_statement(spark):
    r, every = random.Random(4), []
    for _ in range(150):
        every.append([(r.choice(["A", "B"]), "x", a := r.randrange(12), a + r.randint(1, 6), r.choice([0.5, 0.7]), r.choice(["rules", "model"])) for _ in range(r.randint(0, 8))])
    df = spark.createDataFrame([(i, e) for i, e in enumerate(every)], f"doc_id long, entities {ENTITIES}")
    for row in df.select("doc_id", merge.merged(F.col("entities")).alias("m"), merge.resolved(F.col("entities")).alias("r")).collect():
        assert [tuple(e) for e in row.m] == _brute_merge(every[row.doc_id])
        assert all(a.end <= b.start for a, b in zip(row.r, row.r[1:], strict=False))


def test_thresholds_and_names(spark):
    df = _entities(spark, [("DATE", "x", 0, 1, 0.6, "rules"), ("URL", "y", 2, 3, 0.6, "rules"), ("EMAIL", "z", 4, 5, 0.4, "rules")])
    assert [e.entity_type for e in df.select(merge.over_threshold(F.col("entities"), 0.0).alias("e")).first().e] == ["URL", "EMAIL"]
    names = {"Anna Hoffmann": True, "Anna von Berg": True, "Anna, Berg": False, "anna": False, "A": False, "Anna wohnhaft": False, "Anna Berg und": False, "Und": True, "wohnhaft": False}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", merge.is_name(F.col("n")).alias("ok")).collect()
    assert {r.n: r.ok for r in rows} == names


def test_numbering_goes_from_the_back_and_on(spark):
    docs = spark.createDataFrame([(1, "a@x.de then b@x.de", "de"), (2, "A@X.DE and c@x.de", "de"), (3, None, "de")], "doc_id long, text string, lang string")
    found = detect.with_rules(docs, FEW)
    rows = {r.original: r.pseudonym for r in mapping.assigned(found).collect()}
    assert rows == {"b@x.de": "<<EMAIL_1>>", "a@x.de": "<<EMAIL_2>>", "c@x.de": "<<EMAIL_3>>"}
    known = spark.createDataFrame([("<<EMAIL_7>>", "old@x.de", "old@x.de", "EMAIL", 7)], mapping.MAPPING)
    assert {r.n for r in mapping.assigned(found, known).collect()} == {7, 8, 9, 10}
    assert {r.pseudonym for r in mapping.assigned(found, label="X").collect()} == {"<<X_1>>", "<<X_2>>", "<<X_3>>"}
    assert mapping.assigned(found.limit(0)).count() == 0
    snap = json.loads(mapping.snapshot(mapping.assigned(found)).first().snapshot)
    assert snap["counters"] == {"EMAIL": 3} and snap["prefix"] == "<<"
    loaded = mapping.hydrated(spark.createDataFrame([("<<P_1>>", "a"), ("<<P_5>>", "b")], "pseudonym string, original string"))
    assert [tuple(r) for r in mapping.counters(loaded).collect()] == [("P", 5)]


def test_splice_and_reveal(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "😀 a@x.de, 10.0.0.1 a@x.de!"), (2, "none"), (3, ""), (4, None)], "doc_id long, text string")
    session = RedactionSession(spark, rules=FEW)
    rows = {r.doc_id: r for r in session.redacted(docs).collect()}
    assert rows[1].redacted == "😀 <<EMAIL_1>>, <<IP_ADDRESS_1>> <<EMAIL_1>>!" and rows[1].entity_types == {"EMAIL": 2, "IP_ADDRESS": 1}
    assert (rows[2].redacted, rows[3].redacted, rows[4].redacted) == ("none", "", None)
    for few in (splice.FEW_IN_MAP, 0):  # whole map, then joined
        monkeypatch.setattr(splice, "FEW_IN_MAP", few)
        monkeypatch.setattr(reveal, "FEW_IN_MAP", few)
        assert session.redacted(docs).where("doc_id = 1").first().redacted == rows[1].redacted
        told = spark.createDataFrame([(1, "<<EMAIL_1>> « email_1 » 《《Ip_Address_1》》 <<EMAIL_99>> <<HEADING>> << 5 >>")], "doc_id long, text string")
        out = session.revealed(told).first()
        assert out.revealed == "a@x.de a@x.de 10.0.0.1 <<EMAIL_99>> <<HEADING>> << 5 >>" and (out.n_replaced, out.n_unresolved) == (3, 1)
    assert session.lookup("<<EMAIL_1>>") == "a@x.de" and session.lookup("<<EMAIL_9>>") is None
    with pytest.raises(NotImplementedError):
        redact(docs, "extract_only")


def test_both_sizes_of_mapping_give_the_same_whatever_the_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "mail a@b.at"), (None, "mail c@d.at, a@b.at"), (1, "mail a@b.at"), (1, "to a@b.at and c@d.at"), (2, "none")], "doc_id long, text string")
    told = spark.createDataFrame([("<<A_1>>", "see <<B_2>> and << b_3 >>"), ("<<B_2>>", "two"), ("<<B_3>>", "three")], "pseudonym string, original string")
    replies = spark.createDataFrame([(None, "<<A_1>>"), (None, "<<B_2>> <<X_9>>"), (1, "«a_1»"), (1, "<<A_1>><<A_1>>"), (2, None)], "doc_id long, text string")
    got = []
    for few in (splice.FEW_IN_MAP, 0):
        monkeypatch.setattr(splice, "FEW_IN_MAP", few)
        monkeypatch.setattr(reveal, "FEW_IN_MAP", few)
        out = RedactionSession(spark).redacted(docs).select("doc_id", "text", "redacted").collect()
        back = [reveal.revealed(replies, told, lenient).select("doc_id", "text", "revealed", "n_replaced", "n_unresolved").collect() for lenient in (True, False)]
        got.append([sorted(map(str, x)) for x in (out, *back)])
        assert all("@" not in x.redacted and x.redacted.count("<<") == x.text.count("@") for x in out)
    assert got[0] == got[1] and "see two and three" in str(got[0])


def test_plugins(spark):
    docs = spark.createDataFrame([(1, "Anna in Berlin"), (2, None)], "doc_id long, text string")

    def broken():
        raise OSError("no model")

    out = plugins.with_plugin(docs, broken)
    assert {r.detector_error for r in out.collect()} == {"OSError: no model"}
    names = spark.createDataFrame([("berlin", "LOCATION"), ("Anna", "PERSON"), ("anna in", "CUSTOM"), ("C++ (x)", "CUSTOM"), ("Ann", "PERSON"), ("?", "CUSTOM"), (None, "PERSON")], "name string, entity_type string")
    found = {r.doc_id: r.entities for r in plugins.gazetteer(out.unionByName(spark.createDataFrame([(3, "ANNA, c++ (x), Joanna", None)], "doc_id long, text string, detector_error string"), allowMissingColumns=True), names).collect()}
    assert sorted((e.entity_type, e.text, e.start) for e in found[1]) == [("CUSTOM", "Anna in", 0), ("LOCATION", "Berlin", 8), ("PERSON", "Anna", 0)]
    assert sorted((e.entity_type, e.text, e.start) for e in found[3]) == [("CUSTOM", "c++ (x)", 6), ("PERSON", "ANNA", 0)] and found[2] == []
    session = RedactionSession(spark, rules=(), detectors=[broken])
    assert {r.detector_error for r in session.detected(docs).collect()} == {"OSError: no model"}
    tags = plugins.tagger(lambda texts: [[("PER", 0, 4, 0.987), ("MISC", 0, 1, 1.0)] for _ in texts], only_lang=None)
    assert [(e.entity_type, e.score) for e in plugins.with_plugin(docs.where("doc_id = 1"), tags).first().entities] == [("PERSON", 0.99)]


def test_registered_detectors(monkeypatch):
    monkeypatch.setattr(plugins, "REGISTERED", {})
    make = plugins.tagger(lambda texts: [[("PER", 0, 4, 0.9), ("LOC", 0, 4, 0.9)] for _ in texts], only_lang=None, only_types=["LOCATION"])
    plugins.register("here", make)
    plugins.register("gone", make, lambda: False)
    assert [e["entity_type"] for e in make()(["Anna"], [None])[0]] == ["LOCATION"]
    assert plugins.chosen(["here", make]) == [make, make]
    with pytest.warns(UserWarning, match="gone"):
        assert plugins.chosen(["all"]) == [make]
    for name, error in (("gone", RuntimeError), ("other", ValueError)):
        with pytest.raises(error):
            plugins.chosen([name])


def test_a_snapshot_goes_on_with_its_counters(spark):
    snapshot = json.dumps({"prefix": "<<", "suffix": ">>", "label": None, "pseudo_to_entity": {"<<EMAIL_1>>": "a@x.de"}, "counters": {"EMAIL": 7}})
    session = RedactionSession(spark, rules=FEW, start=snapshot)
    docs = spark.createDataFrame([(1, "A@x.de b@x.de")], "doc_id long, text string")
    assert session.redacted(docs).first().redacted == "<<EMAIL_1>> <<EMAIL_8>>"
    assert [r.pseudonym for r in mapping.pseudonyms(session.mapping).collect()] == ["<<EMAIL_1>>", "<<EMAIL_8>>"]


def test_tables(spark):
    sheet = spark.createDataFrame([(1, "Anna", "a@x.de", "ok", 5), (2, "anna ", "b@x.de", None, 6), (3, " ", None, "10.0.0.1", 7)], "k int, Name string, Kontakt string, Notes string, Tel int")
    session = RedactionSession(spark)
    out, types = session.redacted_table(sheet, ["k"])
    assert {(r["column"], r.entity_type, r.method) for r in types.collect()} == {("Name", "PERSON", "header"), ("Tel", "PHONE", "header"), ("Kontakt", "EMAIL", "sampled"), ("Notes", "IP_ADDRESS", "sampled")}
    rows = [tuple(r) for r in out.orderBy("k").collect()]
    assert rows[0] == (1, "<<PERSON_1>>", "<<EMAIL_1>>", "<<IP_ADDRESS_1>>", 5) and rows[2] == (3, " ", None, "<<IP_ADDRESS_2>>", 7) and rows[1][1] == "<<PERSON_1>>"
    assert [r.Name for r in session.revealed_table(out).orderBy("k").collect()] == ["Anna", "Anna", " "]
    odd = spark.createDataFrame([("Hotel",), ("Passwort",), ("Firmenname",), ("x",)], "h string")
    assert [r.t for r in odd.select(tables.header_type(F.col("h")).alias("t")).collect()] == ["PHONE", "LOCATION", "PERSON", None]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = lambda tag, ps: f"<w:{tag} {w}>" + "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in ps) + f"</w:{tag}>"
    return zipped({"word/document.xml": body("document", paragraphs), "word/header1.xml": body("hdr", [["mail h@x.de"]])})


def xlsx(rows):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in r) + "</row>" for r in rows)
    return zipped({"xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{cells}</sheetData></worksheet>"})


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"mail a@x.de", "b.docx": docx(["to a@", "x.de"], ["plain"]), "c.xlsx": xlsx([["who", "Email"], ["n", "a@x.de"]]), "d.pdf": b"%PDF-1.4", "e.docx": b"no zip", "f.xlsx": zipped({"big": b"0" * 3_000_000}), "g.bin": b"\x00", "h.csv": b"\xff a@x.de"}.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    session = RedactionSession(spark, rules=FEW)
    done = session.redacted_files(files.read_files(spark, str(tmp_path / "in"))).cache()
    rows = {r.output_name.split("_")[0]: r for r in done.collect()}
    assert bytes(rows["a"].output) == b"mail <<EMAIL_1>>" or b"<<EMAIL_" in bytes(rows["a"].output)
    assert "a@x.de" not in files.docx_text(bytes(rows["b"].output)) and "h@x.de" not in files.docx_text(bytes(rows["b"].output))
    assert "a@x.de" not in files.xlsx_text(bytes(rows["c"].output)) and "who | Email" in files.xlsx_text(bytes(rows["c"].output))
    assert rows["d"].extraction_error == "no PDF extractor" and "zip" in rows["e"].extraction_error and "packed" in rows["f"].extraction_error and "unsupported" in rows["g"].extraction_error
    assert all(rows[k].output is None for k in "defg") and rows["g"].output_name == "g_redacted.txt"
    assert "�" in rows["h"].text
    back = session.revealed_files(done.select("path", F.coalesce("output", "content").alias("content"), "mime_type"))
    texts = {r.path[-6:]: r for r in back.collect()}
    assert bytes(texts["/a.txt"].output) == b"mail a@x.de" and "a@x.de" in files.docx_text(bytes(texts["b.docx"].output)) and texts["/d.pdf"].reason == "unsupported type"


def test_workbooks(spark):
    s, odd = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:x14="urn:odd" xmlns:mc="urn:mc" mc:Ignorable="x14"'
    text = lambda at, t: f'<c r="{at}" t="inlineStr"><is><t>{t}</t></is></c>'
    shared = f'<sst {s}><si><t>Anna</t></si><si><r><t>Contact </t></r><r><t>person</t></r></si><si><t>left</t></si></sst>'
    rows = [text("A1", "Name") + text("B1", "Reach") + text("D1", "Notes"), '<c r="A2" t="s"><v>0</v></c>' + text("B2", "a@x.de") + '<c r="C2"><v>5</v></c>' + '<c r="D2" t="s"><v>2</v></c>', '<c r="A3" t="str"><f>"An"&amp;"na"</f><v>anna</v></c>' + text("B3", "none") + '<c r="D3" t="s"><v>1</v></c>']
    sheet = f'<worksheet {s} {odd}><sheetData>' + "".join(f'<row r="{i}">{r}</row>' for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    one_row = f'<worksheet {s}><sheetData><row r="1">{text("A1", "Name")}</row></sheetData></worksheet>'
    book = zipped({"xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": one_row, "xl/sharedStrings.xml": shared})
    session = RedactionSession(spark, rules=FEW)
    df = spark.createDataFrame([("/b.xlsx", bytearray(book), files.XLSX), ("/a.txt", bytearray(b"no data"), "text/plain"), ("/c.xlsx", bytearray(b"no zip"), files.XLSX), ("/d.xlsx", None, files.XLSX)], "path string, content binary, mime_type string")
    done = {r.path: r for r in session.redacted_files(df).collect()}
    out = bytes(done["/b.xlsx"].output)
    assert [[c[2] for c in sheet] for sheet in files.xlsx_grid(out)] == [["Name", "Reach", "Notes", "<<PERSON_1>>", "<<EMAIL_1>>", "5", "left", "<<PERSON_1>>", "<<EMAIL_2>>", "Contact person"], ["Name"]]
    raw = zipfile.ZipFile(io.BytesIO(out))
    assert all(b"nna" not in raw.read(n) for n in raw.namelist()) and b'xmlns:x14="urn:odd"' in raw.read("xl/worksheets/sheet1.xml") and b"ns0:" not in raw.read("xl/worksheets/sheet1.xml")
    assert done["/b.xlsx"].entity_types == {"PERSON": 2, "EMAIL": 2} and {(c.column, c.method) for c in done["/b.xlsx"].columns} == {(1, "header"), (2, "sampled")}
    assert done["/c.xlsx"].output is None and "zip" in done["/c.xlsx"].extraction_error and done["/d.xlsx"].output is None and bytes(done["/a.txt"].output) == b"no data"
    loose = zipped({"xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row>{text("A1", "« person_1 »")}{text("B1", "see &lt;&lt;EMAIL_1&gt;&gt; &lt;&lt;X_9&gt;&gt;")}</row></sheetData></worksheet>'})
    back = session.revealed_files(spark.createDataFrame([("/b.xlsx", bytearray(loose), files.XLSX)], "path string, content binary, mime_type string")).first()
    assert [c[2] for c in files.xlsx_grid(bytes(back.output))[0]] == ["Anna", "see a@x.de <<X_9>>"]


def test_formulas_and_prefixes_in_rewritten_parts():
    s = 'xmlns:m="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:w14="urn:w14" xmlns:mc="urn:mc" mc:Ignorable="w14"'
    book = zipped({"xl/worksheets/sheet1.xml": f'<m:worksheet {s}><m:sheetData><m:row r="1"><m:c r="A1" t="str"><m:f>LOWER("a@b.de")</m:f><m:v>a@b.de</m:v></m:c><m:c r="B1"><m:f>1+1</m:f><m:v>2</m:v></m:c></m:row></m:sheetData></m:worksheet>'})
    out = zipfile.ZipFile(io.BytesIO(files.xlsx_changed(book, files.swapping({"a@b.de": "<<EMAIL_1>>"})))).read("xl/worksheets/sheet1.xml").decode()
    assert "a@b.de" not in out and "&lt;&lt;EMAIL_1" in out and "<m:v>2</m:v>" in out and 'xmlns:w14="urn:w14"' in out
    made = files.xlsx_made([["a", 1.5, None], ["<&>", None, "z"]])
    assert files.xlsx_grid(made) == [[(1, 1, "a", True), (1, 2, "1.5", False), (2, 1, "<&>", True), (2, 3, "z", True)]] and files.column_letters(28) == "AB" and files.column_number("AB12") == 28


def test_pdf_pages_and_image_sizes(spark):
    assert files.pdf_text(["one", "x" * 100], {"Author": "Anna", "Title": "T", "Other": "no", "Subject": ""}) == "Title: T\nAuthor: Anna\n\none\n\n" + "x" * 100
    assert files.pdf_text(["one", "x" * 100], {}, ocr=lambda i: f"page {i}") == "page 0\n\n" + "x" * 100
    assert files.pdf_text(["a"] * 60, {}).count("a") == 50 and files.pdf_text([], {"Title": "T"}) == "Title: T"
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    assert files.image_size(png(10, 20)) == (10, 20) and files.image_size(b"GIF89a\x05\0\x06\0") == (5, 6) and files.image_size(b"x") is None
    assert files.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x07\0\x09") == (9, 7)
    assert files.ocr_size(8192, 4096) == (4096, 2048)
    df = spark.createDataFrame([(bytearray(png(10, 10)), "image/png"), (bytearray(png(10_000, 10_000)), "image/png"), (bytearray(b"%PDF"), "application/pdf")], "content binary, mime_type string")
    rows = files.extracted(df, pdf=lambda data, pages: (["page"], {"Title": "T"}), ocr=lambda data, size: f"seen {size}").collect()
    assert [r.text for r in rows] == ["seen (10, 10)", None, "Title: T\n\npage"] and "pixels" in rows[1].extraction_error


def test_bodies(spark):
    uri = "data:text/plain;base64,YUB4LmRl"
    chat = {"messages": [{"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "file", "file": {"file_data": uri}}, {"type": "image_url", "image_url": {"url": "https://x/y"}}, {"type": "file", "file": {"file_id": "f"}}]}]}
    anthropic = {"system": [{"type": "document", "source": {"type": "base64", "media_type": "text/plain", "data": "YUB4LmRl"}}], "messages": []}
    rows = [("1", "openai_chat", json.dumps(chat)), ("2", "anthropic", json.dumps(anthropic)), ("3", "other", json.dumps(chat)), ("4", "openai_chat", "no json"), ("5", "openai_chat", None)]
    df = spark.createDataFrame(rows, "request_id string, stream_key string, body string")
    assert {(r.request_id, r.source_path, bytes(r.content)) for r in bodies.blocks(df).collect()} == {("1", "messages[1].content[1]", b"a@x.de"), ("2", "system[0]", b"a@x.de")}
    new, stats = RedactionSession(spark, rules=FEW).analyzed_bodies(df)
    after = {r.request_id: r.body for r in new.collect()}
    part = json.loads(after["1"])["messages"][1]["content"][1]["file"]["file_data"]
    assert part != uri and after["4"] == "no json" and after["5"] is None and json.loads(after["3"]) == chat
    assert {(r.request_id, r.total_entities, r.blocked) for r in stats.collect()} == {("1", 1, False), ("2", 1, False)}
    _, stats = RedactionSession(spark, rules=FEW).analyzed_bodies(df, "block")
    assert all(r.blocked for r in stats.collect())
    same, none = RedactionSession(spark, rules=FEW).analyzed_bodies(df, "passthrough")
    assert same is df and none.count() == 0
    told = {r.request_id: json.loads(r.body) for r in bodies.instructed(df.where("request_id < '3'"), "PII").collect()}
    assert told["1"]["messages"][0]["role"] == "system" and "<<PII_1>>" in told["1"]["messages"][0]["content"] and told["2"]["system"][0]["type"] == "text"


def folder_client(folder):
    """A key-value client that keeps its records in a folder, so that all workers see them."""

    class Client:
        def set(self, key, value, ex=None):
            (folder / key).write_bytes(f"{ex if ex is not None else -1}\n".encode() + value)

        def get(self, key):
            return (folder / key).read_bytes().split(b"\n", 1)[1] if (folder / key).exists() else None

        def ttl(self, key):
            return int((folder / key).read_bytes().split(b"\n", 1)[0])

        def delete(self, key):
            (folder / key).unlink(missing_ok=True)

        def scan_iter(self, pattern):
            return (x.name.encode() for x in folder.glob(pattern))

        def ping(self):
            return folder.exists()

    return Client()


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "t", {"<<A_1>>": "x"}), ("r2", "t", {})], "request_id string, tenant_id string, mappings map<string,string>")
    for backend in (MemoryBackend(spark), ParquetBackend(spark, str(tmp_path / "kv")), ClientBackend(spark, lambda: folder_client(tmp_path))):
        store = MappingStore(backend, b"0" * 32)
        assert store.load().count() == 0
        store.save(rows)
        got = store.load().collect()
        assert [(r.request_id, r.mappings) for r in got] == [("r1", {"<<A_1>>": "x"})] and 0 < got[0].ttl_seconds <= 2_592_000
        assert MappingStore(backend, b"1" * 32).load().count() == 0
        assert backend.ping()
        store.delete("r1")
        assert store.load().count() == 0


def test_namespaces(spark, tmp_path):
    root, told = str(tmp_path), spark.createDataFrame([("<<EMAIL_1>>", "a@x.de", "a@x.de", "EMAIL", 1)], mapping.MAPPING)
    for bad in ("", ".x", "a/b", "../x", "a" * 65, "-a", "a b"):
        with pytest.raises(ValueError):
            Namespace(spark, root, bad)
    first, second = Namespace(spark, root, "n"), Namespace(spark, root, "n")
    assert first.load() is None and second.load() is None and namespaces(spark, root) == []
    first.save(told)
    with pytest.raises(RuntimeError):
        second.save(told)
    assert [tuple(r) for r in second.load().collect()] == [tuple(r) for r in told.collect()] and namespaces(spark, root) == ["n"]
    second.save(told)
    stored = spark.read.parquet(*[str(p) for p in (tmp_path / "n").glob("rows-*")]).collect()
    assert all(b"a@x.de" not in bytes(r.original) for r in stored)
    (tmp_path / "n" / ".key.crc").unlink(missing_ok=True)
    (tmp_path / "n" / "key").write_bytes(b"1" * 32)
    with pytest.raises(ValueError):
        Namespace(spark, root, "n").load()
    assert second.delete() and not second.delete()


def test_stream_goes_on_where_a_session_ended(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    for texts in ([(1, "a@x.de")], [(2, "a@x.de b@x.de")]):
        spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.mode("append").parquet(at("in"))
        stream = spark.readStream.schema("doc_id long, text string").parquet(at("in"))
        redact_stream(stream, "n", at("ns"), at("out"), at("progress"), rules=FEW).awaitTermination()
    assert {r.doc_id: r.redacted for r in spark.read.parquet(at("out")).collect()} == {1: "<<EMAIL_1>>", 2: "<<EMAIL_1>> <<EMAIL_2>>"}


def test_cli(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.txt").write_text("mail a@x.de")
    root = ["--root", str(tmp_path / "ns")]
    assert cli.run(spark, [*root, "redact", str(tmp_path / "a.txt"), "--namespace", "n", "--output-dir", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o" / "a_redacted.txt").read_text() == "mail <<EMAIL_1>>"
    assert cli.run(spark, [*root, "reveal", str(tmp_path / "o" / "a_redacted.txt"), "--namespace", "n", "--output-dir", str(tmp_path / "b")]) == 0
    assert (tmp_path / "b" / "a_redacted.txt").read_text() == "mail a@x.de"
    monkeypatch.setattr("sys.stdin", io.StringIO("to <<EMAIL_1>> and « email_1 »\n"))
    capsys.readouterr()
    assert cli.run(spark, [*root, "reveal", "-", "--namespace", "n"]) == 0 and capsys.readouterr().out == "to a@x.de and a@x.de\n"
    assert cli.run(spark, [*root, "lookup", "<<EMAIL_1>>", "--namespace", "n"]) == 0 and cli.run(spark, [*root, "lookup", "<<X_1>>", "--namespace", "n"]) == 1
    capsys.readouterr()
    assert cli.run(spark, [*root, "ns", "show", "n"]) == 2 and "a@x.de" not in capsys.readouterr().out
    assert cli.run(spark, [*root, "ns", "summary", "n"]) == 0 and capsys.readouterr().out == "EMAIL=1\n"
    assert cli.run(spark, [*root, "ns", "list"]) == 0 and cli.run(spark, [*root, "ns", "delete", "n"]) == 0
    with pytest.raises(SystemExit):
        cli.guarded(str(tmp_path / "ns" / "n"), "a.txt", str(tmp_path / "ns"))


def test_scalars(spark):
    row = spark.range(1).select(T.lookup_key(F.lit("  Anna\t")).alias("k"), T.file_key(F.lit("a:b/ü")).alias("f"), T.bare_mime(F.lit("Text/Plain; charset=x")).alias("m"), T.data_uri_bytes(F.lit("data:;base64")).alias("n"), T.data_uri_bytes(F.lit("data:a/b;base64,!!")).alias("b")).first()
    assert tuple(row) == ("anna", "a_b_ü", "text/plain", None, None)
