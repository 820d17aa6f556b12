"""The queries of this package over the tables of a folder, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import text as T
from spanveil.functions.durable import shared_folder
from spanveil.functions.rows import by_row
from spanveil.operators import detect, mapping, merge, plugins, reveal, splice, tables
from spanveil.operators.patterns import PATTERNS
from spanveil.plans import oracles as O
from spanveil.plans.session import RedactionSession
from spanveil.sources import bodies, files, workbooks
from spanveil.sources.store import expiry, live
from spanveil.streaming.incremental import redact_stream
from spanveil.types import RULE_LABELS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: What the queries that replace look for.
COMMON = ("email", "ipv4", "card", "url")
NUMBERED = ("phone_49", "phone_0049", "phone_trunk", "phone_parens", "svnr_spaced", "svnr_compact", "steuer_grouped", "steuer_compact")
NAMES = ("name_plain", "name_title", "name_hyphen")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# detection


#: What is put behind the texts, by doc_id, so that each form is met; the other documents stay as they are.
PLANTED = (
    " Tel. +49 30 1234567 now.",
    " ruf 0049 170 1234567 an.",
    " Fax 030 1234567-12 now.",
    " Buero (030) 1234567 now.",
    " SVNR 65 230785 M 014 now.",
    " Nummer 65230785M014 now.",
    " Steuer-ID 14 815 037 682 now.",
    " idnr 14815037682 now.",
    " Meier, Anna kam.",
    " Schulz, Dr. Otto kam.",
    " Lang-Kurz, Eva kam.",
    " Konto DE89 3704 0044 0532 0130 00 now.",
    " Konto GB82WEST12345698765432 now.",
    " Konto DE88370400440532013000 now.",
    " see https://example.org/a?b=1 now.",
    " no 123-45-6789 now.",
    " am 03.10.1990 now.",
    " on 2024-02-29 now.",
    " mail Max.Stone+x@example.co.uk now.",
    " at 10.20.30.40 or 10.20.30.400 now.",
    " card 4111 1111 1111 1111 or 4111 1111 1111 1112 now.",
    "",
)
_PLANTED_SQL = f"(SELECT doc_id, lang, coalesce(text, '') || list_extract([{', '.join(map(O.quoted, PLANTED))}], CAST(doc_id % {len(PLANTED)} AS INT) + 1) AS text FROM documents)"


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))


def _spans_query(name: str, patterns: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.with_rules(_planted(spark, sf_dir), patterns, context=False)
        return detect.spans(found).select("doc_id", "entity_type", "text", "start", "end", "score")

    query(name, f'SELECT doc_id, entity_type, text, start, "end", score FROM ({O.spans(patterns, _PLANTED_SQL)})')(run)


for _name, _patterns in {
    "email": ("email",),
    "ipv4": ("ipv4",),
    "card": ("card",),
    "iban": ("iban",),
    "url": ("url",),
    "ssn": ("ssn",),
    "date_dotted": ("date_dotted",),
    "date_iso": ("date_iso",),
    "phone_49": ("phone_49",),
    "phone_0049": ("phone_0049",),
    "phone_trunk": ("phone_trunk",),
    "phone_parens": ("phone_parens",),
    "svnr_spaced": ("svnr_spaced",),
    "svnr_compact": ("svnr_compact",),
    "steuer_grouped": ("steuer_grouped",),
    "steuer_compact": ("steuer_compact",),
    "name_plain": ("name_plain",),
    "name_title": ("name_title",),
    "name_hyphen": ("name_hyphen",),
    "every": tuple(p.name for p in PATTERNS),
}.items():
    _spans_query(f"detect_{_name}_spans", _patterns)


@query("detect_with_context", O.boosted((*NUMBERED, *NAMES), _PLANTED_SQL))
def detect_with_context(spark, sf_dir):
    return detect.spans(detect.with_rules(_planted(spark, sf_dir), (*NUMBERED, *NAMES))).select("doc_id", "entity_type", "text", "start", "end", "score")


_LABELS = ", ".join(f"({O.quoted(k)}, {O.quoted(v)})" for k, v in RULE_LABELS.items())


@query("canonical_labels", f"SELECT e.event_type AS label, coalesce(v.t, 'CUSTOM') AS entity_type, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'US_SSN' WHEN 1 THEN 'EMAIL_ADDRESS' WHEN 2 THEN 'NRP' ELSE event_type END AS event_type FROM events) e LEFT JOIN (VALUES {_LABELS}) v(k, t) ON v.k = e.event_type GROUP BY 1, 2")
def canonical_labels(spark, sf_dir):
    """Labels of another analyzer by what they are called here; unknown ones are CUSTOM."""
    known = F.create_map(*(F.lit(x) for kv in RULE_LABELS.items() for x in kv))
    label = F.when(F.col("event_id") % 4 == 0, "US_SSN").when(F.col("event_id") % 4 == 1, "EMAIL_ADDRESS").when(F.col("event_id") % 4 == 2, "NRP").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(label.alias("label")).groupBy("label", F.coalesce(known[F.col("label")], F.lit("CUSTOM")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@query("card_luhn_valid", f"SELECT o_orderkey, {O.luhn('x')} AS valid FROM (SELECT o_orderkey, CAST(4000000000000000 + o_orderkey * 7919 AS VARCHAR) AS x FROM orders)")
def card_luhn_valid(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.luhn_valid((F.lit(4000000000000000) + F.col("o_orderkey") * 7919).cast("string")).alias("valid"))


@query("iban_valid", f"SELECT o_orderkey, {O.iban('x')} AS valid FROM (SELECT o_orderkey, 'DE' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || ' ' || CAST(370400440532000000 + o_orderkey AS VARCHAR) AS x FROM orders)")
def iban_valid(spark, sf_dir):
    x = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit(" "), (F.lit(370400440532000000) + F.col("o_orderkey")).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.iban_valid(x).alias("valid"))


def _raw(spark, sf_dir, names) -> DataFrame:
    return detect.with_rules(table(spark, sf_dir, "documents"), names, context=False)


def _columns(found: DataFrame) -> DataFrame:
    return detect.spans(found).select("doc_id", "entity_type", "text", "start", "end", "score")


_COLUMNS = 'doc_id, entity_type, text, start, "end", score'
_MIXED = (*NAMES, *NUMBERED, "date_dotted", "date_iso", "url", "card")


@query("ensemble_threshold", f"SELECT {_COLUMNS} FROM ({O.over_threshold(O.spans(_MIXED))})")
def ensemble_threshold(spark, sf_dir):
    found = _raw(spark, sf_dir, _MIXED)
    return _columns(found.withColumn("entities", merge.over_threshold(F.col("entities"))))


@query("merge_overlaps", f"SELECT {_COLUMNS} FROM {O.folded(O.spans(_MIXED), True)}")
def merge_overlaps(spark, sf_dir):
    found = _raw(spark, sf_dir, _MIXED)
    return _columns(found.withColumn("entities", merge.merged(F.col("entities"))))


@query("resolve_overlaps", f"SELECT {_COLUMNS} FROM {O.folded(O.spans(_MIXED), False)}")
def resolve_overlaps(spark, sf_dir):
    found = _raw(spark, sf_dir, _MIXED)
    return _columns(found.withColumn("entities", merge.resolved(F.col("entities"))))


@query("ensemble", f"SELECT {_COLUMNS} FROM {O.folded(O.over_threshold(O.spans(_MIXED)), True)} WHERE entity_type <> 'PERSON' OR ({O.is_name('text')})")
def ensemble(spark, sf_dir):
    return _columns(merge.ensemble(_raw(spark, sf_dir, _MIXED)))


@query("person_validation", f"SELECT doc_id, i, name, {O.is_name('name')} AS valid FROM (SELECT doc_id, i, array_to_string(w[i + 1:i + 3], ' ') AS name FROM (SELECT doc_id, w, unnest(range(0, len(w), 3)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))")
def person_validation(spark, sf_dir):
    """Every three words of each text as a name."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    each = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(3))).alias("i"))
    return each.select("doc_id", F.col("i").cast("long").alias("i"), F.array_join(F.slice("w", F.col("i") + 1, 3), " ").alias("name")).withColumn("valid", merge.is_name(F.col("name")))


_DICTIONARY = (("Apache", "ORGANIZATION"), ("Apache License", "ORGANIZATION"), ("Berlin", "LOCATION"), ("paris", "LOCATION"), ("+49 30", "CUSTOM"))
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ordinal, {O.quoted(t)} AS entity_type, text, start, \"end\", CAST(0.85 AS DOUBLE) AS score FROM ({O.literal_spans(n, _PLANTED_SQL)})" for i, (n, t) in enumerate(sorted((n.lower(), t) for n, t in _DICTIONARY))
)


@query("gazetteer", f'SELECT doc_id, entity_type, text, start, "end", score FROM {O.folded(_HITS, False)}')
def gazetteer(spark, sf_dir):
    found = plugins.gazetteer(_planted(spark, sf_dir), spark.createDataFrame(_DICTIONARY, "name string, entity_type string"))
    return _columns(found.withColumn("entities", merge.resolved(F.col("entities"))))


# counts

_FOUND = O.spans(COMMON)


def _common(spark, sf_dir) -> DataFrame:
    return merge.ensemble(_raw(spark, sf_dir, COMMON))


@query("entity_counts_by_type", f"SELECT entity_type, count(*) AS n FROM ({_FOUND}) GROUP BY 1")
def entity_counts_by_type(spark, sf_dir):
    return detect.spans(_common(spark, sf_dir)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("entity_counts_by_doc", f"SELECT doc_id, entity_type, count(*) AS n FROM ({_FOUND}) GROUP BY 1, 2")
def entity_counts_by_doc(spark, sf_dir):
    counts = _common(spark, sf_dir).select("doc_id", F.explode(merge.type_counts(F.col("entities"))).alias("entity_type", "n"))
    return counts


@query("entity_counts_by_lang", f"SELECT lang, entity_type, count(*) AS n FROM ({_FOUND}) JOIN documents USING (doc_id) GROUP BY 1, 2")
def entity_counts_by_lang(spark, sf_dir):
    return _common(spark, sf_dir).select("lang", F.explode("entities").alias("e")).groupBy("lang", F.col("e.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


# mappings

_CHOSEN = O.folded(O.spans(COMMON), False)
_MAPPING = O.mapping(f"SELECT * FROM {O.folded(O.spans(COMMON), True)}")


@query("distinct_entities", f"SELECT lookup_key, original, entity_type FROM ({O.firsts(_FOUND)})")
def distinct_entities(spark, sf_dir):
    return mapping.distinct_entities(_common(spark, sf_dir)).select("lookup_key", "first.original", "first.entity_type")


@query("assign_pseudonyms", _MAPPING)
def assign_pseudonyms(spark, sf_dir):
    return mapping.assigned(_common(spark, sf_dir))


@query("assign_pseudonyms_label", O.mapping(_FOUND, "REDACTED"))
def assign_pseudonyms_label(spark, sf_dir):
    return mapping.assigned(_common(spark, sf_dir), label="REDACTED")


_FIRST, _LATER = (f"SELECT s.* FROM ({_FOUND}) s JOIN documents USING (doc_id) WHERE coalesce(source, '') {x} 'src0'" for x in ("=", "<>"))
_CONTINUED = f"""WITH a AS ({O.mapping(_FIRST)}), b AS (SELECT * FROM ({O.firsts(_LATER)}) WHERE lookup_key NOT IN (SELECT lookup_key FROM a)),
numbered AS (SELECT original, lookup_key, entity_type AS label, coalesce((SELECT max(n) FROM a WHERE a.label = b.entity_type), 0) + row_number() OVER (PARTITION BY entity_type ORDER BY doc_id, start DESC, ordinal) AS n FROM b)
SELECT pseudonym, original, lookup_key, label, n FROM a UNION ALL SELECT '<<' || label || '_' || n || '>>', original, lookup_key, label, n FROM numbered"""


@query("continue_namespace", _CONTINUED)
def continue_namespace(spark, sf_dir):
    """The documents of one source first, then those of all others with the tokens of the first."""
    found, own = _common(spark, sf_dir), F.coalesce("source", F.lit("")) == "src0"
    return mapping.assigned(found.where(~own), mapping.assigned(found.where(own)))


@query("mapping_summary", f"SELECT label, count(*) AS entities, max(n) AS last_n FROM ({_MAPPING}) GROUP BY 1")
def mapping_summary(spark, sf_dir):
    return mapping.summary(mapping.assigned(_common(spark, sf_dir)))


@query("hydrate_counters", f"SELECT label, max(n) AS n FROM ({_MAPPING}) GROUP BY 1")
def hydrate_counters(spark, sf_dir):
    return mapping.counters(mapping.hydrated(mapping.assigned(_common(spark, sf_dir)).select("pseudonym", "original")))


@query("snapshot_restored", f"SELECT pseudonym, original, lookup_key, label, n, CAST(n + 5 AS BIGINT) AS counter FROM (SELECT *, max(n) OVER (PARTITION BY label) AS last FROM ({_MAPPING})) WHERE n = last")
def snapshot_restored(spark, sf_dir):
    """The last token of each label out of a snapshot whose counters are five ahead."""
    told = mapping.snapshot(mapping.assigned(_common(spark, sf_dir))).select(F.from_json("snapshot", "prefix string, suffix string, label string, pseudo_to_entity map<string,string>, counters map<string,bigint>").alias("x"))
    ahead = told.select(F.to_json(F.struct("x.prefix", "x.suffix", "x.label", "x.pseudo_to_entity", F.transform_values("x.counters", lambda _, n: n + 5).alias("counters"))).alias("s")).first().s
    pairs, counters = mapping.restored(spark, ahead)
    last = pairs.groupBy("label").agg(F.max("n").alias("n"))
    return pairs.join(last, ["label", "n"]).join(counters.select("label", F.col("n").alias("counter")), "label")


@query("pseudonym_list", f"SELECT pseudonym FROM ({_MAPPING})")
def pseudonym_list(spark, sf_dir):
    return mapping.pseudonyms(mapping.assigned(_common(spark, sf_dir)))


@query("lookup_token", f"SELECT pseudonym, original FROM ({_MAPPING}) WHERE pseudonym = '<<EMAIL_1>>'")
def lookup_token(spark, sf_dir):
    return reveal.lookup(mapping.assigned(_common(spark, sf_dir)), "<<EMAIL_1>>")


# replacing and restoring


def _redacted(spark, sf_dir) -> tuple[RedactionSession, DataFrame]:
    session = RedactionSession(spark, rules=COMMON)
    return session, session.redacted(table(spark, sf_dir, "documents"))


_REDACTED = O.rebuilt(f"SELECT * FROM {_CHOSEN}", _MAPPING, "pseudonym", "documents", "doc_id", "text", "redacted")
_RESTORED = O.rebuilt(f"SELECT * FROM {_CHOSEN}", _MAPPING, "original", "documents", "doc_id", "text", "revealed")


@query("redact_documents", _REDACTED)
def redact_documents(spark, sf_dir):
    return _redacted(spark, sf_dir)[1].select("doc_id", "redacted", "n_entities")


@query("replacement_map", f"SELECT DISTINCT c.doc_id, c.text AS original, m.pseudonym FROM {_CHOSEN} c JOIN ({_MAPPING}) m ON m.lookup_key = lower(c.text)")
def replacement_map(spark, sf_dir):
    session, done = _redacted(spark, sf_dir)
    return splice.with_tokens(done, session.mapping, "doc_id").select("doc_id", F.explode(splice.replacements(F.col("entities"), F.col("tokens"))).alias("original", "pseudonym"))


@query("reveal_strict", f"SELECT doc_id, revealed FROM ({_RESTORED})")
def reveal_strict(spark, sf_dir):
    session, done = _redacted(spark, sf_dir)
    return reveal.revealed(done.select("doc_id", F.col("redacted").alias("text")), session.mapping, lenient=False).select("doc_id", "revealed")


@query("reveal_lenient", f"SELECT doc_id, revealed FROM ({_RESTORED})")
def reveal_lenient(spark, sf_dir):
    """Tokens as a model may have spelled them: other marks, spaces, small letters."""
    session, done = _redacted(spark, sf_dir)
    spoilt = reveal.swapped(F.col("redacted"), reveal.strict_regex(), F.transform_values(F.col("seen"), lambda k, _: F.concat(F.lit("« "), F.lower(F.regexp_replace(k, "[<>]", "")), F.lit(" »"))))
    seen = F.map_from_arrays(F.array_distinct(reveal.tokens_of(F.col("redacted"), reveal.strict_regex())), F.array_distinct(reveal.tokens_of(F.col("redacted"), reveal.strict_regex())))
    return session.revealed(done.withColumn("seen", seen).select("doc_id", spoilt.alias("text"))).select("doc_id", "revealed")


@query("reveal_stats", f"SELECT doc_id, count(c.text) FILTER (entity_type <> 'IP_ADDRESS') AS n_replaced, count(c.text) FILTER (entity_type = 'IP_ADDRESS') AS n_unresolved FROM documents LEFT JOIN {_CHOSEN} c USING (doc_id) GROUP BY doc_id")
def reveal_stats(spark, sf_dir):
    """Against a mapping that has lost its addresses."""
    session, done = _redacted(spark, sf_dir)
    return reveal.revealed(done.select("doc_id", F.col("redacted").alias("text")), session.mapping.where("label <> 'IP_ADDRESS'")).select("doc_id", "n_replaced", "n_unresolved")


def _redacted_sql(source: str, id_col: str, text: str) -> str:
    """As the session does it for texts without a language."""
    own = O.spans(COMMON, source, id_col, text, "'de'")
    return O.rebuilt(f"SELECT * FROM {O.folded(own, False)}", O.mapping(f"SELECT * FROM {O.folded(own, True)}"), "pseudonym", source, id_col, text, "redacted")


_PAGES = _redacted_sql("pages", "page_id", "html")


@query("redact_pages_html", _PAGES)
def redact_pages_html(spark, sf_dir):
    return RedactionSession(spark, rules=COMMON).redacted(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "redacted", "n_entities")


@query("redact_conversations", _redacted_sql("(SELECT conv_id * 100000 + turn AS turn_id, text FROM conversations)", "turn_id", "text"))
def redact_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("turn_id"), "text")
    return RedactionSession(spark, rules=COMMON).redacted(turns, "turn_id").select("turn_id", "redacted", "n_entities")


@query("redact_incremental", ORACLE_SQL["redact_documents"])
def redact_incremental(spark, sf_dir):
    """All files of the table as one stream, to a folder that all machines see."""
    at = shared_folder(spark)
    # a pattern, as a stream can't begin with the path of a single file
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    redact_stream(stream, "stream", f"{at}/namespaces", f"{at}/out", f"{at}/progress", rules=COMMON).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id", "redacted", "n_entities")


# tables

_STARS = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "nation": "n_nationkey n_name n_regionkey", "region": "r_regionkey r_name", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"}
_HEADERS = ", ".join(f"('{t}', '{c}')" for t, cs in _STARS.items() for c in cs.split())


@query("classify_columns", f"SELECT * FROM (SELECT t AS table_name, c AS column_name, {O.header_type('c')} AS entity_type FROM (VALUES {_HEADERS}) v(t, c)) WHERE entity_type IS NOT NULL")
def classify_columns(spark, sf_dir):
    """The headers of the tables, as the footers of their files have them."""
    rows = [(t, c) for t in _STARS for c in table(spark, sf_dir, t).columns]
    headers = spark.createDataFrame(rows, "table_name string, column_name string")
    return headers.withColumn("entity_type", tables.header_type(F.col("column_name"))).where("entity_type IS NOT NULL")


def _table_query(name: str, key: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return RedactionSession(spark).redacted_table(table(spark, sf_dir, name), [key])[0]

    query(f"redact_table_{name}", O.table_tokens(name, key, column, "PERSON", [c for c in _STARS[name].split() if c != column]))(run)


for _name, _key, _column in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name")):
    _table_query(_name, _key, _column)


@query("reveal_table_customer", f"SELECT {', '.join(_STARS['customer'].split())} FROM customer")
def reveal_table_customer(spark, sf_dir):
    session = RedactionSession(spark)
    return session.revealed_table(session.redacted_table(table(spark, sf_dir, "customer"), ["c_custkey"])[0])


@query("sampled_columns", "SELECT * FROM (VALUES ('contact', 'EMAIL', 'sampled'), ('c_name', 'PERSON', 'header'), ('host', 'IP_ADDRESS', 'sampled')) v(\"column\", entity_type, method)")
def sampled_columns(spark, sf_dir):
    """Columns that their headers don't give away, judged by their first rows."""
    key = F.col("c_custkey").cast("string")
    sheet = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("c"), key, F.lit("@example.org")).alias("contact"), F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 250).cast("string")).alias("host"), F.col("c_mktsegment").alias("segment"))
    return tables.classified(sheet, ["c_custkey"])


@query("flatten_sheet", "SELECT string_agg(concat_ws(' | ', n_nationkey, n_name, n_regionkey), chr(10) ORDER BY n_nationkey) AS text FROM nation")
def flatten_sheet(spark, sf_dir):
    return tables.flattened(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


# files

_KINDS = ("txt", "pdf", "HTML", "docx", "md", "bin", "tar.csv", "png")
_HEADS = {"txt": "255044462D", "bin": "89504E470D0A", "png": "47494638"}


def _path(page: Column) -> Column:
    return F.concat(F.lit("/in/page"), page.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _KINDS)), (page % len(_KINDS) + 1).cast("int")))


@query(
    "mime_route",
    "SELECT page_id, mime, CASE mime WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png' THEN 'image' WHEN 'image/gif' THEN 'image' WHEN 'text/html' THEN 'plain' WHEN 'text/csv' THEN 'plain' WHEN 'text/markdown' THEN 'plain' ELSE 'docx' END AS format, mime <> '" + files.DOCX + "' AS passable FROM "
    "(SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/html' WHEN 3 THEN '" + files.DOCX + "' WHEN 4 THEN 'text/markdown' WHEN 5 THEN 'image/png' WHEN 6 THEN 'text/csv' ELSE 'image/gif' END AS mime FROM pages)",
)
def mime_route(spark, sf_dir):
    """Types by first bytes, else by extension, and what follows from them."""
    path = _path(F.col("page_id"))
    head = F.coalesce(*(F.when(path.endswith("." + k), F.unhex(F.lit(h))) for k, h in _HEADS.items()), F.unhex(F.lit("")))
    mime = files.mime_type(path, F.concat(head, F.encode("html", "utf-8")))
    return table(spark, sf_dir, "pages").select("page_id", mime.alias("mime")).select("page_id", "mime", files.format_of(F.col("mime")).alias("format"), F.col("mime").isin(*files.PASSABLE).alias("passable"))


@query("data_uri_decode", "SELECT page_id, 'text/html' AS mime, html AS text FROM pages")
def data_uri_decode(spark, sf_dir):
    uri = T.data_uri(F.encode("html", "utf-8"), F.lit("text/html"))
    return table(spark, sf_dir, "pages").select("page_id", uri.alias("uri")).select("page_id", T.data_uri_mime(F.col("uri")).alias("mime"), files.plain_text(T.data_uri_bytes(F.col("uri"))).alias("text"))


@query("output_names", "SELECT page_id, 'page' || page_id || CASE page_id % 8 WHEN 6 THEN '.tar' ELSE '' END || '_redacted' || CASE page_id % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.txt' WHEN 2 THEN '.HTML' WHEN 3 THEN '.docx' WHEN 4 THEN '.md' WHEN 5 THEN '.txt' WHEN 6 THEN '.csv' ELSE '.txt' END AS name FROM pages")
def output_names(spark, sf_dir):
    mime = files.mime_type(_path(F.col("page_id")), F.lit(b""))
    return table(spark, sf_dir, "pages").select("page_id", files.output_name(_path(F.col("page_id")), mime.isin(*files.REBUILT)).alias("name"))


def _as_files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.format_string("/in/%09d.html", "page_id").alias("path"), F.encode("html", "utf-8").alias("content"), F.lit("text/html").alias("mime_type"))


def _page(path: Column) -> Column:
    return F.regexp_extract(path, "([0-9]+)", 1).cast("long").alias("page_id")


@query("redact_files", f"SELECT page_id, redacted AS text, lpad(CAST(page_id AS VARCHAR), 9, '0') || '_redacted.html' AS name FROM ({_PAGES})")
def redact_files(spark, sf_dir):
    done = RedactionSession(spark, rules=COMMON).redacted_files(_as_files(spark, sf_dir))
    return done.select(_page(F.col("path")), F.decode("output", "utf-8").alias("text"), F.col("output_name").alias("name"))


@query("reveal_files", "SELECT page_id, lower(html) AS text FROM pages")
def reveal_files(spark, sf_dir):
    session = RedactionSession(spark, rules=COMMON)
    done = session.redacted_files(_as_files(spark, sf_dir)).select("path", F.col("output").alias("content"), "mime_type")
    return session.revealed_files(done).select(_page(F.col("path")), F.lower(F.decode("output", "utf-8")).alias("text"))


def _workbooks(spark, sf_dir) -> DataFrame:
    """A workbook for each nation: its customers with name, contact, segment and balance."""

    def made(rows) -> bytes:
        own = ((x["c_name"], x["contact"], x["c_mktsegment"], x["c_acctbal"]) for k in range(0, len(rows), 1000) for x in rows.values.slice(k, 1000).to_pylist())
        return files.xlsx_made(chain([("Customer name", "Contact", "Segment", "Balance")], own))

    contact = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.org"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", contact.alias("contact"), "c_mktsegment", "c_acctbal"))).alias("rows"))
    return rows.select(F.format_string("/in/%02d.xlsx", "c_nationkey").alias("path"), by_row("binary", made)("rows").alias("content"), F.lit(files.XLSX).alias("mime_type"))


def _cells(done: DataFrame) -> DataFrame:
    grid = workbooks.opened(done.select("path", F.col("output").alias("content")))
    return grid.select(F.regexp_extract("path", "([0-9]+)", 1).cast("int").alias("nation"), F.explode("grid").alias("c")).where("c.is_text AND c.row > 1").select("nation", "c.row", "c.col", "c.text")


_PEOPLE = "SELECT CAST(c_nationkey AS INT) AS nation, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS INT) AS row, c_name, 'c' || c_custkey || '@example.org' AS contact, c_mktsegment FROM customer"


def _cells_sql(name: str, contact: str) -> str:
    return f"SELECT nation, row, CAST(1 AS INT) AS col, {name} AS text FROM ({_PEOPLE}) UNION ALL SELECT nation, row, CAST(2 AS INT), {contact} FROM ({_PEOPLE}) UNION ALL SELECT nation, row, CAST(3 AS INT), c_mktsegment FROM ({_PEOPLE})"


@query("redact_workbooks", _cells_sql("'<<PERSON_' || row_number() OVER (ORDER BY nation, row) || '>>'", "'<<EMAIL_' || row_number() OVER (ORDER BY nation, row) || '>>'"))
def redact_workbooks(spark, sf_dir):
    """One column by its header, one by its first cells; the others stay."""
    return _cells(RedactionSession(spark).redacted_files(_workbooks(spark, sf_dir)))


@query("reveal_workbooks", _cells_sql("c_name", "contact"))
def reveal_workbooks(spark, sf_dir):
    session = RedactionSession(spark)
    done = session.redacted_files(_workbooks(spark, sf_dir)).select("path", F.col("output").alias("content"), "mime_type")
    return _cells(session.revealed_files(done))


# request bodies


def _bodies(spark, sf_dir, dialect: str) -> DataFrame:
    """Conversations as requests; each turn is a message with its text, inline, as a file."""
    uri = T.data_uri(F.encode("text", "utf-8"), F.lit("text/plain"))
    if dialect == "openai_chat":
        part = F.struct(F.lit("file").alias("type"), F.struct(uri.alias("file_data")).alias("file"))
    elif dialect == "openai_responses":
        part = F.struct(F.lit("input_file").alias("type"), uri.alias("file_data"))
    else:
        part = F.struct(F.lit("document").alias("type"), F.struct(F.lit("base64").alias("type"), F.lit("text/plain").alias("media_type"), F.base64(F.encode("text", "utf-8")).alias("data")).alias("source"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", F.array(part).alias("content")).alias("m"))
    grouped = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]).alias("ms"))
    name = "input" if dialect == "openai_responses" else "messages"
    return grouped.select(F.col("conv_id").cast("string").alias("request_id"), F.lit(dialect).alias("stream_key"), F.to_json(F.struct(F.col("ms").alias(name))).alias("body"))


def _blocks_sql(dialect: str, text: str = "text") -> str:
    outer = "input" if dialect == "openai_responses" else "messages"
    kind = {"openai_chat": "file", "openai_responses": "input_file", "anthropic": "document"}[dialect]
    return f"SELECT CAST(conv_id AS VARCHAR) AS request_id, '{outer}[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '].content[0]' AS source_path, '{kind}' AS source_type, 'text/plain' AS mime_type, {text} AS text FROM conversations"


def _block_rows(found: DataFrame) -> DataFrame:
    return found.select("request_id", "source_path", "source_type", "mime_type", files.plain_text(F.col("content")).alias("text"))


for _dialect in bodies.DIALECTS:
    query(f"body_extract_{_dialect}", _blocks_sql(_dialect))(lambda spark, sf_dir, d=_dialect: _block_rows(bodies.blocks(_bodies(spark, sf_dir, d))))

    @query(f"body_apply_{_dialect}", _blocks_sql(_dialect, "'checked: ' || text"))
    def body_apply(spark, sf_dir, d=_dialect):
        """Each file rewritten in its place, then read out of the new body."""
        own = _bodies(spark, sf_dir, d)
        results = _block_rows(bodies.blocks(own)).withColumn("content", F.encode(F.concat(F.lit("checked: "), "text"), "utf-8"))
        return _block_rows(bodies.blocks(bodies.applied(own, results)))


def _flat_bodies(spark, sf_dir, dialect: str) -> DataFrame:
    """Conversations whose turns are files right below the body: the inputs of one dialect, the system list of another."""
    if dialect == "openai_responses":
        part, name = F.struct(F.lit("input_file").alias("type"), T.data_uri(F.encode("text", "utf-8"), F.lit("text/plain")).alias("file_data")), "input"
    else:
        part, name = F.struct(F.lit("document").alias("type"), F.struct(F.lit("base64").alias("type"), F.lit("text/plain").alias("media_type"), F.base64(F.encode("text", "utf-8")).alias("data")).alias("source")), "system"
    grouped = table(spark, sf_dir, "conversations").select("conv_id", "turn", part.alias("p")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]).alias("ps"))
    return grouped.select(F.col("conv_id").cast("string").alias("request_id"), F.lit(dialect).alias("stream_key"), F.to_json(F.struct(F.col("ps").alias(name))).alias("body"))


for _dialect, _outer, _kind in (("openai_responses", "input", "input_file"), ("anthropic", "system", "document")):
    query(f"body_extract_{_dialect}_flat", f"SELECT CAST(conv_id AS VARCHAR) AS request_id, '{_outer}[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']' AS source_path, '{_kind}' AS source_type, 'text/plain' AS mime_type, text FROM conversations")(lambda spark, sf_dir, d=_dialect: _block_rows(bodies.blocks(_flat_bodies(spark, sf_dir, d))))

for _dialect, _at, _role in (("openai_chat", "$.messages[0].content", "$.messages[0].role"), ("openai_responses", "$.instructions", None), ("anthropic", "$.system", None)):

    @query(f"inject_instruction_{_dialect}", f"SELECT DISTINCT CAST(conv_id AS VARCHAR) AS request_id, {O.quoted(bodies.instruction())} AS told, {O.quoted('system') if _role else 'CAST(NULL AS VARCHAR)'} AS role FROM conversations")
    def inject_instruction(spark, sf_dir, d=_dialect, at=_at, role=_role):
        told = bodies.instructed(_bodies(spark, sf_dir, d))
        return told.select("request_id", F.get_json_object("body", at).alias("told"), (F.get_json_object("body", role) if role else F.lit(None).cast("string")).alias("role"))


@query("policy_modes", "SELECT * FROM (VALUES ('passthrough', false, false, false, false), ('detect_only', true, true, false, false), ('block', true, true, false, true), ('pseudonymize', true, true, true, false)) v(mode, extract, detect, pseudonymize, block)")
def policy_modes(spark, sf_dir):
    return spark.createDataFrame([(m, *bodies.policy(m).values()) for m in bodies.MODES], "mode string, extract boolean, detect boolean, pseudonymize boolean, block boolean")


@query("file_rollup", f"SELECT source AS request_id, count(DISTINCT d.doc_id) AS files_analyzed, CAST(0 AS BIGINT) AS files_extraction_errors, count(s.text) AS total_entities, count(s.text) > 0 AS blocked, count(DISTINCT s.doc_id) AS files_blocked FROM documents d LEFT JOIN ({_FOUND}) s USING (doc_id) GROUP BY source")
def file_rollup(spark, sf_dir):
    done = _common(spark, sf_dir).select(F.col("source").alias("request_id"), F.lit(None).cast("string").alias("extraction_error"), "entities")
    return bodies.rollup(done, "block").select("request_id", "files_analyzed", "files_extraction_errors", "total_entities", "blocked", "files_blocked")


@query("file_rollup_pseudonymize", f"SELECT source AS request_id, count(DISTINCT d.doc_id) AS files_analyzed, count(DISTINCT s.doc_id) FILTER (s.doc_id % 3 = 0) AS files_converted, count(DISTINCT s.doc_id) FILTER (s.doc_id % 3 <> 0) AS files_reconstructed, count(s.text) AS total_entities, false AS blocked FROM documents d LEFT JOIN ({_FOUND}) s USING (doc_id) GROUP BY source")
def file_rollup_pseudonymize(spark, sf_dir):
    """Texts as files of which every third is a PDF, which can't be rebuilt."""
    kind = F.when(F.col("doc_id") % 3 == 0, "application/pdf").otherwise("text/plain")
    done = _common(spark, sf_dir).select(F.col("source").alias("request_id"), kind.alias("mime_type"), F.lit(None).cast("string").alias("extraction_error"), "entities")
    return bodies.rollup(done, "pseudonymize").select("request_id", "files_analyzed", "files_converted", "files_reconstructed", "total_entities", "blocked")


@query("conversion_rollup", "SELECT CAST(c_nationkey % 5 AS VARCHAR) AS request_id, count(DISTINCT c_nationkey) AS files_analyzed, count(DISTINCT c_nationkey) AS files_converted, CAST(0 AS BIGINT) AS files_extraction_errors FROM customer GROUP BY 1")
def conversion_rollup(spark, sf_dir):
    """Workbooks in requests, turned into text for a provider that takes none."""
    uri = T.data_uri(F.col("content"), F.lit(files.XLSX))
    part = F.struct(F.lit("input_file").alias("type"), uri.alias("file_data"))
    books = _workbooks(spark, sf_dir).select((F.regexp_extract("path", "([0-9]+)", 1).cast("int") % 5).cast("string").alias("request_id"), part.alias("p"))
    requests = books.groupBy("request_id").agg(F.to_json(F.struct(F.collect_list("p").alias("input"))).alias("body")).withColumn("stream_key", F.lit("openai_responses"))
    return RedactionSession(spark).converted_bodies(requests)[1]


# records that expire


@query("ttl_live_keys", "SELECT event_id, user_id FROM events WHERE event_id % 5 = 0 OR ts + to_seconds(CAST(event_id % 5 * 864000 AS INT)) > TIMESTAMP '2024-01-15 00:00:00'")
def ttl_live_keys(spark, sf_dir):
    """Events as records that live 0 (for good) to 40 days, at a set moment."""
    rows = table(spark, sf_dir, "events").withColumn("expires_at", expiry(F.col("ts").cast("timestamp"), F.col("event_id") % 5 * 864000))
    return live(rows, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "user_id")
