"""The SQL that says what the queries of this package say, for another engine to run."""

from __future__ import annotations

import re
from collections.abc import Iterable

from spanveil.operators.merge import NOT_AT_END, NOT_IN_NAMES
from spanveil.operators.patterns import BY_NAME, CONTEXT, CONTEXT_BOOST, CONTEXT_CHARS
from spanveil.operators.tables import HEADER_WORDS
from spanveil.types import THRESHOLDS


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def luhn(x: str) -> str:
    """Whether the digits of x pass: every second one from the right counts double, with its digits added."""
    digits = f"reverse(regexp_replace({x}, '[^0-9]', '', 'g'))"
    one = f"CAST(substr({digits}, j, 1) AS INT)"
    return f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {one} WHEN {one} > 4 THEN 2 * {one} - 9 ELSE 2 * {one} END)) % 10 = 0)"


def iban(x: str) -> str:
    """Whether x, turned and spelled in digits, leaves 1 divided by 97, in steps of one character."""
    plain = f"upper(regexp_replace({x}, '[^0-9A-Za-z]', '', 'g'))"
    turned = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    value = f"CASE WHEN substr({turned}, j, 1) BETWEEN '0' AND '9' THEN ascii(substr({turned}, j, 1)) - 48 ELSE ascii(substr({turned}, j, 1)) - 55 END"
    values = f"list_transform(range(1, length({turned}) + 1), lambda j: CAST({value} AS BIGINT))"
    return f"(length({plain}) BETWEEN 15 AND 34 AND list_reduce({values}, lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97, CAST(0 AS BIGINT)) = 1)"


CHECKS = {"luhn_valid": luhn, "iban_valid": iban, "octets_valid": lambda x: f"(list_max(list_transform(string_split({x}, '.'), lambda o: CAST(o AS INT))) <= 255)"}


def spans(names: Iterable[str], table: str = "documents", id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> str:
    """doc_id, ordinal, entity_type, text, start, end, score of all matches of the patterns."""
    parts = []
    for ordinal, name in enumerate(names):
        p, size = BY_NAME[name], "list_transform({}, lambda s: length(s))"
        rx = quoted(p.regex)
        where = f"regexp_matches({text}, {rx})" + (f" AND {lang} IN ({', '.join(map(quoted, p.lang.split('|')))})" if p.lang else "")
        cut = f"SELECT {id_col} AS doc_id, regexp_extract_all({text}, {rx}) AS m, regexp_split_to_array({text}, {rx}) AS g FROM {table} WHERE {where}"
        start = f"coalesce(list_sum({size.format('g[1:i]')}), 0) + coalesce(list_sum({size.format('m[1:i-1]')}), 0)"
        each = f"SELECT doc_id, {ordinal} AS ordinal, {quoted(p.entity_type)} AS entity_type, m[i] AS text, CAST({start} AS INT) AS start, CAST({p.score} AS DOUBLE) AS score FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({cut}))"
        parts.append(f"SELECT * FROM ({each})" + (f" WHERE {CHECKS[p.check]('text')}" if p.check else ""))
    return 'SELECT doc_id, ordinal, entity_type, text, start, CAST(start + length(text) AS INT) AS "end", score FROM (' + " UNION ALL ".join(parts) + ")"


def literal_spans(name: str, table: str) -> str:
    """doc_id, text, start, end of a name wherever it stands in any case with no letter, digit or _ beside it."""
    rx = quoted("(?i)" + re.sub(r"([^\w\s])", r"\\\1", name))
    word = quoted(r"[\p{L}\p{N}_]")
    size = "list_transform({}, lambda s: length(s))"
    start = f"CAST(coalesce(list_sum({size.format('g[1:i]')}), 0) + coalesce(list_sum({size.format('m[1:i-1]')}), 0) AS INT)"
    cut = f"SELECT doc_id, text AS t, regexp_extract_all(text, {rx}) AS m, regexp_split_to_array(text, {rx}) AS g FROM {table} WHERE regexp_matches(text, {rx})"
    each = f"SELECT doc_id, t, m[i] AS text, {start} AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({cut}))"
    free = f"NOT regexp_matches(CASE WHEN start = 0 THEN '' ELSE substr(t, start, 1) END, {word}) AND NOT regexp_matches(substr(t, start + length(text) + 1, 1), {word})"
    return f'SELECT doc_id, text, start, CAST(start + length(text) AS INT) AS "end" FROM ({each}) WHERE {free}'


def boosted(names: Iterable[str], table: str = "documents") -> str:
    before = f"lower(substr(d.text, greatest(s.start - {CONTEXT_CHARS}, 0) + 1, least(s.start, {CONTEXT_CHARS})))"
    near = " OR ".join(f"(entity_type = {quoted(t)} AND (" + " OR ".join(f"contains({before}, {quoted(w)})" for w in words) + "))" for t, words in CONTEXT.items())
    return f'SELECT doc_id, entity_type, s.text, start, "end", CASE WHEN {near} THEN least(1.0, round(score + {CONTEXT_BOOST}, 4)) ELSE score END AS score FROM ({spans(names, table)}) s JOIN {table} d USING (doc_id)'


def over_threshold(rows: str, least: float = 0.5) -> str:
    own = " ".join(f"WHEN {quoted(t)} THEN {x}" for t, x in THRESHOLDS.items())
    return f"SELECT * FROM ({rows}) WHERE score >= CASE entity_type {own} ELSE {least} END"


def folded(rows: str, by_type: bool) -> str:
    """Overlaps settled from the left: a span meets the last that stands, and the better one stays."""
    keys = ["doc_id", "entity_type"] if by_type else ["doc_id"]
    part, on = ", ".join(keys), " AND ".join(f"n.{k} = f.{k}" for k in keys)
    own = ["doc_id", "entity_type", "ordinal", "text", "start", '"end"', "score"]
    meets = 'f.start < n."end" AND n.start < f."end"'
    takes = '(n.score > f.score OR (n.score = f.score AND n."end" - n.start > f."end" - f.start))'
    kept = ", ".join(f"CASE WHEN {meets} AND NOT {takes} THEN f.{c} ELSE n.{c} END AS {c}" for c in own)
    return f"""(WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY start, "end" DESC, ordinal) AS k FROM ({rows})),
    fold AS (SELECT {', '.join(own)}, k, 1 AS grp FROM ranked WHERE k = 1
      UNION ALL SELECT {kept}, n.k, CASE WHEN {meets} THEN f.grp ELSE f.grp + 1 END FROM fold f JOIN ranked n ON {on} AND n.k = f.k + 1)
    SELECT {', '.join(own)} FROM fold QUALIFY row_number() OVER (PARTITION BY {part}, grp ORDER BY k DESC) = 1)"""


def firsts(rows: str) -> str:
    return f"SELECT lower(text) AS lookup_key, text AS original, entity_type, doc_id, start, ordinal FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id, start DESC, ordinal) = 1"


def mapping(rows: str, label: str | None = None) -> str:
    """pseudonym, original, lookup_key, label, n."""
    name = "entity_type" if label is None else quoted(label)
    n = f"row_number() OVER (PARTITION BY {name} ORDER BY doc_id, start DESC, ordinal)"
    return f"SELECT '<<' || {name} || '_' || {n} || '>>' AS pseudonym, original, lookup_key, {name} AS label, {n} AS n FROM ({firsts(rows)})"


def rebuilt(rows: str, told: str, value: str, table: str, id_col: str, text: str, out: str) -> str:
    """Texts with each span replaced by what the mapping has for it; n_entities."""
    return f"""SELECT o.{id_col}, coalesce(head, '') || substr(o.{text}, coalesce(last, 0) + 1) AS {out}, CAST(coalesce(n, 0) AS BIGINT) AS n_entities FROM {table} o LEFT JOIN (
      SELECT c.doc_id, string_agg(substr(t.{text}, c.pe + 1, c.start - c.pe) || m.{value}, '' ORDER BY c.start) AS head, max(c."end") AS last, count(*) AS n
      FROM (SELECT *, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS pe FROM ({rows})) c
      JOIN ({told}) m ON m.lookup_key = lower(c.text) JOIN {table} t ON t.{id_col} = c.doc_id GROUP BY c.doc_id) x ON x.doc_id = o.{id_col}"""


def is_name(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"
    inside = f"list_has_any({words}, [{', '.join(map(quoted, NOT_IN_NAMES))}])"
    at_end = f"{words}[-1] IN ({', '.join(map(quoted, NOT_AT_END))})"
    return f"NOT regexp_matches({x}, '[,\\n]') AND length({x}) > 1 AND NOT regexp_matches({x}, '^[a-z0-9._@\\-]+$') AND NOT (len({words}) > 1 AND ({inside} OR {at_end}))"


def header_type(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(trim({x})), {quoted(w)})' for w in words)} THEN {quoted(t)}" for t, words in HEADER_WORDS) + " END"


def table_tokens(table: str, key: str, column: str, kind: str, others: Iterable[str]) -> str:
    """A table whose column holds tokens, numbered by the first row that a value stands in."""
    kept = ", ".join(f"t.{c}" for c in others)
    first = f"SELECT lower(trim({column})) AS k, min({key}) AS first FROM {table} WHERE trim({column}) <> '' GROUP BY 1"
    return f"SELECT {kept}, coalesce('<<{kind}_' || n || '>>', t.{column}) AS {column} FROM {table} t LEFT JOIN (SELECT k, row_number() OVER (ORDER BY first) AS n FROM ({first})) ON k = lower(trim(t.{column}))"
