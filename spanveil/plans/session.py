"""Sessions: documents, tables, files and bodies redacted and revealed with one mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.durable import cut
from spanveil.functions.text import bare_mime, lookup_key, stripped
from spanveil.operators import detect, mapping, merge, plugins, reveal, splice, tables
from spanveil.sources import bodies as body_source
from spanveil.sources import files as file_source
from spanveil.sources import workbooks
from spanveil.sources.store import Namespace

ONLY_PSEUDONYMIZE = "pseudonymize"


class RedactionSession:
    """Gives the same entity the same token in all that it redacts.

    With a namespace, tokens are kept and go on in later sessions; a namespace has one
    writer at a time. detectors: functions that make a plug-in, or names of those that are
    registered (see operators.plugins). start: a snapshot (see operators.mapping) to go on from.
    rules: names of patterns, all if none are given, no rules at all if empty.
    """

    def __init__(self, spark: SparkSession, namespace: str | None = None, root: str | None = None, least: float = 0.5, label: str | None = None, rules: Iterable[str] | None = None, detectors: Iterable[Callable | str] = (), overlap: str = "resolve", start: str | None = None):
        if namespace is not None and root is None:
            raise ValueError("a namespace needs a root folder")
        self.spark, self.least, self.label, self.overlap = spark, least, label, overlap
        self.rules, self.detectors = None if rules is None else [*rules], plugins.chosen(detectors)
        self.store = Namespace(spark, root, namespace) if namespace is not None else None
        self.mapping = self.store.load() if self.store else None
        self.counters = None
        if start is not None and self.mapping is None:
            self.mapping, self.counters = mapping.restored(spark, start)

    def detected(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with `entities`; with plug-ins, with `detector_error` too: what went wrong in them, null if nothing."""
        found = docs.withColumn("entities", detect.none_found())
        if self.rules is None or self.rules:
            found = detect.with_rules(found, self.rules, text_col=text_col)
        errors = []
        for i, make in enumerate(self.detectors):
            found = plugins.with_plugin(found, make, text_col).withColumnRenamed("detector_error", f"detector_error_{i}")
            errors.append(f"detector_error_{i}")
        if errors:
            found = found.withColumn("detector_error", F.nullif(F.concat_ws("; ", *errors), F.lit(""))).drop(*errors)
        return merge.ensemble(found, self.least)

    def _keep(self, told: DataFrame) -> None:
        self.mapping = cut(told)
        if self.store and self.mapping.limit(1).count():
            self.store.save(self.mapping)

    def redacted(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with `entities`, `n_entities`, `entity_types` and `redacted`."""
        found = cut(self.detected(docs, text_col))
        self._keep(mapping.assigned(found, self.mapping, self.label, id_col, start=self.counters))
        out = splice.pseudonymized(found, self.mapping, self.overlap, id_col, text_col)
        return out.withColumn("n_entities", F.size("entities").cast("long")).withColumn("entity_types", merge.type_counts(F.col("entities")))

    def revealed(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with `revealed` and what was replaced or not."""
        return reveal.revealed(docs, self._known(), True, id_col=id_col, text_col=text_col)

    def lookup(self, pseudonym: str) -> str | None:
        row = reveal.lookup(self._known(), pseudonym).first()
        return row.original if row else None

    def summary(self) -> DataFrame:
        return mapping.summary(self._known())

    def _known(self) -> DataFrame:
        return self.mapping if self.mapping is not None else self.spark.createDataFrame([], mapping.MAPPING)

    def redacted_table(self, df: DataFrame, order_by: list[str], sample_rows: int = tables.SAMPLE_ROWS) -> tuple[DataFrame, DataFrame]:
        """The table with classified columns as tokens, and the classification."""
        types = cut(tables.classified(df, order_by, self.least, sample_rows, self.rules))
        out, told = tables.redacted_table(df, {r["column"]: r.entity_type for r in types.collect()}, order_by, self.mapping, self.label)
        self._keep(told)
        return out, types

    def revealed_table(self, df: DataFrame) -> DataFrame:
        """Text cells with their originals again."""
        texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
        if not texts:
            return df
        exact, loose = reveal.strict_regex(), reveal.lenient_regex()
        first, own = splice.free_names(df.columns, "first", "originals")
        cell = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in texts}
        found = F.flatten(F.array(*(reveal.tokens_of(x, exact) for x in cell.values())))
        out = splice.with_own_map(df, found, self._known(), "pseudonym", "original", first)
        later = F.flatten(F.array(*(F.transform(reveal.tokens_of(reveal.swapped(x, exact, F.col(first)), loose), lambda t: reveal.named(t)) for x in cell.values())))
        out = splice.with_own_map(out, F.concat(found, later), self._known(), "pseudonym", "original", own)
        for c in texts:
            once = reveal.swapped(F.col(f"`{c}`"), exact, F.col(own))
            out = out.withColumn(c, reveal.swapped(once, loose, F.col(own), reveal.named))
        return out.select(*(F.col(f"`{c}`") for c in df.columns))

    def redacted_files(self, files: DataFrame, **extractors) -> DataFrame:
        """files (path, content, mime_type) with text, entities, redacted, `output`, `output_name` and errors.

        The cells of workbooks are classified by column (see `redacted_workbooks`); all else
        is one text. Files are numbered in the order of their paths, workbooks last.
        """
        book = bare_mime(F.col("mime_type")) == file_source.XLSX
        others, books = files.where(~F.coalesce(book, F.lit(False))), files.where(book)
        if not books.limit(1).count():
            return self._redacted_flat(others, **extractors)
        if not others.limit(1).count():
            return self.redacted_workbooks(books)
        return self._redacted_flat(others, **extractors).unionByName(self.redacted_workbooks(books), allowMissingColumns=True)

    def _redacted_flat(self, files: DataFrame, **extractors) -> DataFrame:
        read = file_source.extracted(files, **extractors)
        own = self.redacted(read, "path")
        tokens = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
        own = splice.with_tokens(own, self._known(), "path").withColumn("replacements", F.coalesce(splice.replacements(F.col("entities"), F.col("tokens")), tokens)).drop("tokens")
        done = file_source.rebuilt(own.withColumn("redacted", F.when(F.col("text").isNotNull(), F.col("redacted"))))
        return done.withColumn("output_name", file_source.output_name(F.col("path"), F.col("output").isNotNull())).drop("replacements")

    def redacted_workbooks(self, files: DataFrame, sample_rows: int = tables.SAMPLE_ROWS) -> DataFrame:
        """XLSX files as `redacted_files` has them, and `columns`: sheet, column, entity_type, method of those classified.

        In each sheet of two rows or more, a column's header (row 1) names its type, or else
        the first of `sample_rows` text cells below it in which a detector finds something, by
        its best score. Text cells below the header of such columns are whole tokens,
        numbered by path, sheet, row and column; other cells stay. A formula that gives a text
        in such a column goes with what it gave.
        """
        (file,) = splice.free_names(files.columns, "file")
        files = cut(workbooks.opened(files).withColumn(file, F.monotonically_increasing_id()))
        cells = files.select(file, "path", F.explode("grid").alias("c")).select(file, "path", "c.*")
        tall = cells.groupBy(file, "sheet").agg(F.max("row").alias("height")).where("height > 1").drop("height")
        cells = cut(cells.join(tall, [file, "sheet"]))
        headers = cells.where("row = 1 AND is_text").select(file, "sheet", "col", tables.header_type(F.col("text")).alias("entity_type")).where("entity_type IS NOT NULL").withColumn("method", F.lit("header"))
        texts = cells.where("row > 1 AND is_text").where(stripped(F.col("text")) != "")
        sample = texts.where(F.col("row") <= sample_rows + 1).join(headers, [file, "sheet", "col"], "left_anti").withColumn("lang", F.lit("de"))
        judged = self.detected(sample).where(F.size("entities") > 0)
        best = F.element_at(F.array_sort(F.transform("entities", lambda e, i: F.struct((-e["score"]).alias("s"), i.alias("i"), e["entity_type"].alias("t")))), 1)["t"]
        sampled = judged.groupBy(file, "sheet", "col").agg(F.min_by(best, "row").alias("entity_type")).withColumn("method", F.lit("sampled"))
        columns = cut(headers.unionByName(sampled))
        named = cut(texts.join(columns.drop("method"), [file, "sheet", "col"]).withColumn("key", lookup_key(F.col("text"))))
        first = F.struct("path", "sheet", "row", "col", F.col("text").alias("original"), "entity_type")
        self._keep(mapping.told(named.select(F.col("key").alias("lookup_key"), first.alias("first")).groupBy("lookup_key").agg(F.min("first").alias("first")), self.mapping, self.label, start=self.counters))
        tokens = splice.met(named, self.mapping.select(F.col("lookup_key").alias("key"), "pseudonym"), "key")
        entity = F.struct("entity_type", "text", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(1.0).alias("score"), F.lit("columns").alias("source"))
        filled = tokens.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("sheet", "row", "col", "pseudonym", entity.alias("e")))).alias("filled"))
        told = columns.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("sheet", F.col("col").alias("column"), "entity_type", "method"))).alias("columns"))
        done = workbooks.filled(files.join(filled, file, "left").join(told, file, "left"))
        done = done.withColumn("entities", F.coalesce(F.transform("filled", lambda x: x["e"]), detect.none_found())).drop("filled", "grid", file)
        done = done.withColumn("n_entities", F.size("entities").cast("long")).withColumn("entity_types", merge.type_counts(F.col("entities")))
        return done.withColumn("output_name", file_source.output_name(F.col("path"), F.col("output").isNotNull()))

    def revealed_files(self, files: DataFrame) -> DataFrame:
        """files with `output`: tokens turned back, strictly and then leniently; null with a `reason` for other types and without a mapping."""
        mime = bare_mime(F.col("mime_type"))
        plain = mime.isin(*(m for m in file_source.REVEALED if m not in (file_source.DOCX, file_source.XLSX)))
        text, own = splice.free_names(files.columns, "text", "pairs")
        out = self.revealed(files.withColumn(text, F.when(plain, file_source.plain_text(F.col("content")))), "path", text)
        is_office = mime.isin(file_source.DOCX, file_source.XLSX)
        out = splice.with_own_map(out, F.when(is_office, workbooks.tokens_in(F.col("content"), mime)), self._known(), "pseudonym", "original", own)
        some = self._known().limit(1).count() > 0
        made = F.when(plain, F.encode("revealed", "utf-8")).when(is_office, workbooks.restored(F.col("content"), mime, F.col(own)))
        out = out.withColumn("output", made if some else F.lit(None).cast("binary"))
        return out.withColumn("reason", F.when(F.lit(not some), "no mapping").when(F.col("output").isNull(), "unsupported type")).drop(text, own, "revealed", "n_replaced", "n_unresolved")

    def analyzed_bodies(self, bodies: DataFrame, mode: str = ONLY_PSEUDONYMIZE, **extractors) -> tuple[DataFrame, DataFrame]:
        """Bodies (request_id, stream_key, body) after the mode, and what was found by request."""
        steps = body_source.policy(mode)
        if not steps["extract"]:
            return bodies, self.spark.createDataFrame([], "request_id string")
        named = body_source.blocks(bodies).withColumn("path", F.concat_ws("#", "request_id", "source_path"))
        read = cut(file_source.extracted(named, **extractors))
        if not steps["pseudonymize"]:
            return bodies, body_source.rollup(self.detected(read), mode)
        done = cut(self.redacted_files(read.drop("text", "extraction_error"), **extractors))
        results = done.select("request_id", "source_path", "source_type", "mime_type", F.col("redacted").alias("text"), F.col("output").alias("content"))
        return body_source.applied(bodies, results, mode), body_source.rollup(done, mode)

    def converted_bodies(self, bodies: DataFrame, **extractors) -> tuple[DataFrame, DataFrame]:
        """Bodies in which files that no provider takes are their text, and by request: files_analyzed, files_converted, files_extraction_errors."""
        found = body_source.blocks(bodies).where(~F.col("mime_type").isin(*file_source.PASSABLE))
        read = cut(file_source.extracted(found, **extractors))
        return body_source.converted(bodies, read.select("request_id", "source_path", "source_type", "mime_type", "text", "content")), body_source.conversion_rollup(read)


def redact(docs: DataFrame, policy: str = ONLY_PSEUDONYMIZE, **how) -> DataFrame:
    """Documents redacted in a session of their own."""
    if policy != ONLY_PSEUDONYMIZE:
        raise NotImplementedError(policy)
    return RedactionSession(docs.sparkSession, **how).redacted(docs)
