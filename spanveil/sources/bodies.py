"""LLM request bodies (JSON text): inline files found, rewritten or turned into text; instructions put in."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import text as T
from spanveil.functions.rows import by_row
from spanveil.sources.files import REBUILT

DIALECTS = ("openai_chat", "openai_responses", "anthropic")
BLOCKS = "request_id string, source_path string, source_type string, mime_type string, content binary"
MODES = ("passthrough", "detect_only", "block", "pseudonymize")

INSTRUCTION = "Some names and numbers in this conversation stand in for the true ones. They look like {shape} (such as {one} or {two}). Take each for a real value and use it as it is; do not mention the notation or ask about it."


def policy(mode: str) -> dict[str, bool]:
    """Which steps a mode takes."""
    on = mode != "passthrough"
    return {"extract": on, "detect": mode in MODES[1:], "pseudonymize": mode == "pseudonymize", "block": mode == "block"}


def parts(body: Column, at: str) -> Column:
    """The elements of a list in a body, as variants; empty for anything else."""
    return F.coalesce(F.try_variant_get(body, at, "array<variant>"), F.array().cast("array<variant>"))


def _text(v: Column, at: str) -> Column:
    return F.try_variant_get(v, at, "string")


def _inner(v: Column, list_at: str) -> Column:
    return F.coalesce(F.try_variant_get(v, list_at, "array<variant>"), F.array().cast("array<variant>"))


def blocks(bodies: DataFrame) -> DataFrame:
    """One row for each inline file of (request_id, stream_key, body): see BLOCKS.

    Chat: image_url and file parts of messages. Responses: input_image and input_file among
    the inputs and in their content. Anthropic: image and document parts with base64
    sources in messages and in the system list. References, other addresses, bad base64
    and other dialects give no rows.
    """
    parsed = bodies.where(F.col("stream_key").isin(*DIALECTS)).select("request_id", "stream_key", F.try_parse_json("body").alias("v")).where("v IS NOT NULL")

    def nested(key: str, outer: str, inner: str) -> DataFrame:
        rows = parsed.where(F.col("stream_key") == key).select("request_id", F.posexplode(parts(F.col("v"), f"$.{outer}")).alias("i", "m"))
        rows = rows.select("request_id", "i", F.posexplode(_inner(F.col("m"), f"$.{inner}")).alias("j", "p"))
        return rows.select("request_id", "p", F.format_string(f"{outer}[%d].{inner}[%d]", "i", "j").alias("source_path"))

    def flat(key: str, outer: str) -> DataFrame:
        rows = parsed.where(F.col("stream_key") == key).select("request_id", F.posexplode(parts(F.col("v"), f"$.{outer}")).alias("i", "p"))
        return rows.select("request_id", "p", F.format_string(f"{outer}[%d]", "i").alias("source_path"))

    p, kind = F.col("p"), _text(F.col("p"), "$.type")

    def by_uri(rows: DataFrame, places: dict[str, str]) -> DataFrame:
        uri = F.coalesce(*(F.when(kind == k, _text(p, at)) for k, at in places.items()))
        rows = rows.select("request_id", "source_path", kind.alias("source_type"), uri.alias("uri"))
        return rows.select("request_id", "source_path", "source_type", T.data_uri_mime(F.col("uri")).alias("mime_type"), T.data_uri_bytes(F.col("uri")).alias("content"))

    def by_source(rows: DataFrame) -> DataFrame:
        rows = rows.where(kind.isin("image", "document") & (_text(p, "$.source.type") == "base64"))
        return rows.select("request_id", "source_path", kind.alias("source_type"), F.coalesce(_text(p, "$.source.media_type"), F.lit("application/octet-stream")).alias("mime_type"), F.try_to_binary(_text(p, "$.source.data"), F.lit("base64")).alias("content"))

    chat = by_uri(nested("openai_chat", "messages", "content"), {"image_url": "$.image_url.url", "file": "$.file.file_data"})
    responses = {"input_image": "$.image_url", "input_file": "$.file_data"}
    found = [chat, by_uri(flat("openai_responses", "input"), responses), by_uri(nested("openai_responses", "input", "content"), responses), by_source(nested("anthropic", "messages", "content")), by_source(flat("anthropic", "system"))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where("content IS NOT NULL")


def _patched(frame: DataFrame, change: Callable[[dict, tuple], dict], columns: list[str]) -> DataFrame:
    """frame with `body` rewritten by `change`; a body that is no JSON object stays as it is."""

    def one(*scalars) -> str | None:
        row = tuple(x.as_py() for x in scalars)
        try:
            body = json.loads(row[0])
        except (TypeError, ValueError):
            return row[0]
        return json.dumps(change(body, row), ensure_ascii=False) if isinstance(body, dict) else row[0]

    once = by_row("string", one).asNondeterministic()  # else filters on the new body call it again
    return frame.withColumn("body", once("body", *columns))


def _slot(body: dict, path: str):
    """The list and the place in it that a path like messages[0].content[1] leads to; nothing if it leads nowhere."""
    at, where = body, None
    for step in path.split("."):
        name, _, index = step.rstrip("]").partition("[")
        own = at.get(name) if isinstance(at, dict) else None
        if not isinstance(own, list) or int(index) >= len(own):
            return None
        where, at = (own, int(index)), own[int(index)]
    return where


def _placed(part: dict, kind: str, mime: str, content: bytes) -> dict:
    coded = base64.b64encode(content).decode()
    uri = f"data:{mime};base64,{coded}"
    if kind == "image_url":
        return part | {"image_url": (part.get("image_url") or {}) | {"url": uri}}
    if kind == "file":
        return part | {"file": (part.get("file") or {}) | {"file_data": uri}}
    if kind in ("input_image", "input_file"):
        return part | {"image_url" if kind == "input_image" else "file_data": uri}
    return part | {"source": (part.get("source") or {}) | {"type": "base64", "media_type": mime, "data": coded}}


def applied(bodies: DataFrame, results: DataFrame, mode: str = "pseudonymize") -> DataFrame:
    """bodies with the results put in: (request_id, source_path, source_type, mime_type, text, content).

    A result with content takes the place of the file; one with text only becomes a text
    part; one with neither changes nothing. Only in the mode that pseudonymizes.
    """
    if mode != "pseudonymize":
        return bodies
    own = results.where("text IS NOT NULL OR content IS NOT NULL").groupBy("request_id").agg(F.collect_list(F.struct("source_path", "source_type", "mime_type", "text", "content")).alias("_results"))

    def change(body, row):
        for r in row[1] if row[1] is not None else []:
            slot = _slot(body, r["source_path"])
            if slot is None:
                continue
            holder, i = slot
            if r["content"] is not None and isinstance(holder[i], dict):
                holder[i] = _placed(holder[i], r["source_type"], r["mime_type"], bytes(r["content"]))
            else:
                holder[i] = {"type": "input_text" if row[2] == "openai_responses" else "text", "text": r["text"] or ""}
        return body

    return _patched(bodies.join(own, "request_id", "left"), change, ["_results", "stream_key"]).select(*bodies.columns)


def converted(bodies: DataFrame, results: DataFrame) -> DataFrame:
    """bodies in which every file that has a text (not an empty one) is that text."""
    return applied(bodies, results.where("text <> ''").withColumn("content", F.lit(None).cast("binary")))


def instruction(label: str | None = None) -> str:
    if label is None:
        return INSTRUCTION.format(shape="<<TYPE_N>>", one="<<PERSON_1>>", two="<<EMAIL_1>>")
    return INSTRUCTION.format(shape=f"<<{label}_N>>", one=f"<<{label}_1>>", two=f"<<{label}_2>>")


def instructed(bodies: DataFrame, label: str | None = None) -> DataFrame:
    """bodies whose model is told about tokens, before what it is told already. For requests that have tokens."""
    told = instruction(label)

    def before(old):
        if isinstance(old, list):
            return [{"type": "text", "text": told}, *old]
        return told if old is None else f"{told}\n\n{old}" if isinstance(old, str) else old

    def change(body, row):
        if row[1] == "openai_chat":
            return body | {"messages": [{"role": "system", "content": told}, *(body.get("messages") or [])]}
        if row[1] == "anthropic":
            return body | {"system": before(body.get("system"))}
        if row[1] == "openai_responses":
            old = body.get("instructions")
            return body if isinstance(old, list) else body | {"instructions": before(old)}
        return body

    return _patched(bodies, change, ["stream_key"])


def rollup(files: DataFrame, mode: str) -> DataFrame:
    """By request: files analyzed, converted, reconstructed, blocked and not read, entities in all and by type, and whether it is blocked.

    files: (request_id, extraction_error, entities) and, if given, (mime_type). Of the files
    with an entity that a mode replaces, those of a kind that can be rebuilt count as
    reconstructed, the others as converted (to text).
    """
    size = F.coalesce(F.size("entities"), F.lit(0))
    kind = F.coalesce(F.col("mime_type").isin(*REBUILT), F.lit(False)) if "mime_type" in files.columns else F.lit(True)
    replaced, blocks_ = (size > 0) & F.lit(mode == "pseudonymize"), (size > 0) & F.lit(mode == "block")
    totals = files.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("files_analyzed"),
        F.count_if(replaced & ~kind).alias("files_converted"),
        F.count_if(replaced & kind).alias("files_reconstructed"),
        F.count_if(F.col("extraction_error").isNotNull()).alias("files_extraction_errors"),
        F.sum(size).cast("long").alias("total_entities"),
        F.bool_or(blocks_).alias("blocked"),
        F.count_if(blocks_).alias("files_blocked"),
    )
    types = files.select("request_id", F.explode("entities").alias("e")).groupBy("request_id", F.col("e.entity_type").alias("t")).count().groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "count"))).alias("entity_types"))
    return totals.join(types, "request_id", "left")


def conversion_rollup(files: DataFrame) -> DataFrame:
    """By request: files_analyzed, files_converted (those with a text) and files_extraction_errors of (request_id, text, extraction_error)."""
    return files.groupBy("request_id").agg(F.count(F.lit(1)).alias("files_analyzed"), F.count_if(F.col("text").isNotNull()).alias("files_converted"), F.count_if(F.col("extraction_error").isNotNull()).alias("files_extraction_errors"))
