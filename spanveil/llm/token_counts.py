"""Token counts without token ids: pieces by distinct pre-token, joined to what each document holds."""

from __future__ import annotations

from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.base import frequent, named, stored, whole
from spanveil.llm.pieces import pre_tokens

#: Pre-tokens that are broadcast, none over LONGEST bytes: some 60 MB in a worker.
MOST, LONGEST = 500_000, 64
#: Distinct pre-tokens that a task holds while it counts.
HELD = 200_000


def distinct_pre_tokens(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """word, n (how often in all texts), pieces: each distinct pre-token once, with its pieces counted once."""

    def count(batches):
        split, counts = pre_tokens(tokenizer_path).split, Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(split(text.as_py()))
                if len(counts) > HELD:
                    yield told()
                    counts.clear()
        yield told()

    def measure(batches):
        pieces = pre_tokens(tokenizer_path).pieces
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pieces(w) for w in batch.column(0).to_pylist()], pa.int64())], ["word", "n", "pieces"])

    words = texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(measure, "word binary, n long, pieces long")


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) for each row.

    Distinct pre-tokens are aggregated over all texts (see `pieces.PreTokens` for what a
    pre-token is) and the pieces of each are counted once. Then this table is joined to the
    pre-token frequencies of each document: its most frequent rows, at most `most`, are
    broadcast, and only the rarer pre-tokens of a document are shuffled to their rows, none
    of which many documents share. Begin, end and added special tokens are left out; special
    strings in a text are single tokens, as the library has it.

    Null and empty texts have no tokens; ids may be null or repeat; texts of any length
    are counted whole; an empty table gives an empty result.
    """
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    table = stored(distinct_pre_tokens(texts, tokenizer_path))
    least = frequent(table, most)
    often = (F.col("n") >= least) & (F.octet_length("word") <= LONGEST)
    known = docs.sparkSession.sparkContext.broadcast({bytes(r.word): r.pieces for r in table.where(often).toLocalIterator()})

    def join(batches):
        split, pieces = pre_tokens(tokenizer_path).split, known.value
        for batch in batches:
            sizes, totals, rest = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                data = text.as_py()
                counts = Counter(split(data))
                rare = [(w, counts.pop(w)) for w in [w for w in counts if w not in pieces]]
                sizes.append(len(data))
                totals.append(sum(map(mul, map(pieces.__getitem__, counts), counts.values())))
                rest.append([{"word": w, "n": n} for w, n in rare])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))], ["doc_id", "n_bytes", "known", "rest"])

    rows = texts.mapInArrow(join, "doc_id long, n_bytes long, known long, rest array<struct<word binary, n long>>")
    if table.where(~often).limit(1).count():
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        rare = rows.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n").join(table.where(~often).select("word", "pieces"), "word")
        own = rows.select("row", "doc_id", "n_bytes", F.col("known").alias("n_tokens")).unionByName(rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("n_tokens")))
        rows = own.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("known"))
    return rows.select("doc_id", "n_bytes", F.col("known").alias("n_tokens"), (F.col("known") > limit).alias("over_limit"))
