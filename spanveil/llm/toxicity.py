"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.base import named, stored, whole

ORDERS, TABLE_BITS = (4, 6), 19
#: Code points under 128 as the n-grams see them: letters in lower case, all else a space.
_PLAIN = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
_GAP = "\n" * max(ORDERS)
_CHUNK = 1 << 17


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Table places of the n-grams that begin at each code point."""
    n = len(codes) - order + 1
    with np.errstate(over="ignore"):
        h = codes[:n].astype(np.uint64)
        for k in range(1, order):
            h = h * np.uint64(0x100000001B3) + codes[k : k + n]
        h = (h + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def found_grams(texts: list[str], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, table place) of the n-grams in whole texts; with `wanted`, of those places only.

    All texts are read as one, with gaps that no n-gram bridges, in chunks of fixed size.
    A pair may come again in another chunk.
    """
    joined = _GAP + _GAP.join(texts) + _GAP
    starts = np.cumsum([len(_GAP), *(len(t) + len(_GAP) for t in texts[:-1])])
    longest = max(ORDERS)
    for at in range(0, len(joined), _CHUNK):
        codes = np.frombuffer(joined[at : at + _CHUNK + longest - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes)
        for order in ORDERS:
            if len(codes) < order:
                continue
            place = grams(codes, order)
            where = np.flatnonzero(wanted[place]) if wanted is not None else np.arange(len(place))
            text = np.maximum(np.searchsorted(starts, where + at + order - 1, "right") - 1, 0)
            pairs = np.unique(text << TABLE_BITS | place[where])
            yield pairs >> TABLE_BITS, pairs & (1 << TABLE_BITS) - 1


def unique_grams(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    parts = [t << TABLE_BITS | p for t, p in found_grams(texts, wanted)]
    pairs = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return pairs >> TABLE_BITS, pairs & (1 << TABLE_BITS) - 1


@dataclass
class Model:
    """weight: by table place, zero where the n-gram tells nothing; bias: the score of a text without any."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        text, place = unique_grams(texts, self.weight != 0)
        z = self.bias + np.bincount(text, self.weight[place], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes log-count ratios of how often an n-gram is present."""
    return np.log((pos + smooth) / (n_pos + 2 * smooth)) - np.log((neg + smooth) / (n_neg + 2 * smooth))


def telling(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, most: int) -> np.ndarray:
    """The places with the largest likelihood-ratio statistics, `most` at most, that clear chance."""
    total, share = pos + neg, n_pos / max(1, n_pos + n_neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(total > 0, pos / np.maximum(total, 1), 0)
        g = 2 * (np.where(pos > 0, pos * np.log(p / share), 0) + np.where(neg > 0, neg * np.log((1 - p) / (1 - share)), 0))
    g[total < 3] = 0
    best = np.argsort(-g, kind="stable")[:most]
    return np.sort(best[g[best] > 24])


def encoded(places: np.ndarray, width: int) -> bytes:
    """Which of `width` places are present: as numbers where they are few, else as bits; never more than width / 8 bytes and one."""
    if 4 * len(places) < width // 8:
        return b"\0" + places.astype("<i4").tobytes()
    bits = np.zeros(width, np.bool_)
    bits[places] = True
    return b"\1" + np.packbits(bits).tobytes()


def decoded(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i4", offset=1) if data[:1] == b"\0" else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=width))


class Presence:
    """Features of the rows (see `encoded`), a block of rows at a time: unpacked for good where that takes little room, else each time."""

    def __init__(self, rows: list[bytes], width: int, block: int = 500, room: int = 1_000_000):
        self.width, self.blocks = width, []
        for at in range(0, len(rows), block):
            some = rows[at : at + block]
            pairs = self.unpacked(some)
            self.blocks.append((at, at + len(some), some, pairs if len(pairs[0]) <= room else None))

    def unpacked(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        own = [decoded(x, self.width) for x in rows]
        return np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own]), np.concatenate(own).astype(np.int32)

    def __iter__(self):
        for first, last, rows, pairs in self.blocks:
            yield first, last, *(self.unpacked(rows) if pairs is None else pairs)


def fit(features: Presence, labels: np.ndarray, scale: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, the rarer label weighing by the root of its rarity more, by full-batch Adam.

    A feature's value is scale[its number] where it is present.
    """
    w, b = np.zeros(len(scale)), 0.0
    weight = 1 / np.sqrt(np.maximum(np.bincount(labels, minlength=2), 1))[labels]
    weight /= weight.sum()
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for k in range(1, rounds + 1):
        gradient, own = np.r_[penalty * w, 0.0], w * scale
        for first, last, rows, columns in features:
            z = np.bincount(rows, own[columns], last - first) + b
            error = weight[first:last] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[first:last])
            gradient[:-1] += np.bincount(columns, error[rows], len(scale)) * scale
            gradient[-1] += error.sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        step = 0.05 * (1 - 0.9 * k / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(labelled: DataFrame, most_rows: int = 8000, most_grams: int = 20_000, parts: int = 12) -> Model:
    """A model from (doc_id, text, toxic 0/1).

    Fitted on `most_rows` labelled rows (more only where hashes tie), those with the lowest
    hash of their id and text's length; rows with a null label are left out. The rows are
    written once. The driver gets presence counts by table place from `parts` tasks, and
    then which of the telling n-grams each of these rows has, in `most_grams` / 8 bytes or
    less, so its memory depends on these parameters and not on the length of texts. Without
    rows of both labels, every text scores the share of toxic rows (or a half, without any).
    """
    sample = stored(labelled.where(F.col("toxic").isin(0, 1)).select("toxic", "text", F.xxhash64("doc_id", F.length("text")).alias("h")))
    if sample.count() > most_rows:
        sample = sample.where(F.col("h") <= sample.select("h").orderBy("h").limit(most_rows).agg(F.max("h")).first()[0])
    sample = sample.repartition(parts, "h")

    def presence(batches):
        counts = np.zeros((2, 1 << TABLE_BITS), np.int32)
        seen = [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic][unique_grams([text])[1]] += 1
                seen[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([seen[1]], pa.int64()), pa.array([seen[0]], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["pos", "neg", "counts"])

    total, n_pos, n_neg = np.zeros((2, 1 << TABLE_BITS), np.int64), 0, 0
    for r in sample.mapInArrow(presence, "pos long, neg long, counts binary").toLocalIterator():
        total += np.frombuffer(r.counts, np.int32).reshape(2, -1)
        n_pos, n_neg = n_pos + r.pos, n_neg + r.neg
    places = telling(total[1], total[0], n_pos, n_neg, most_grams) if n_pos and n_neg else np.zeros(0, np.int64)
    if not len(places):
        share = (n_pos + 0.5) / (n_pos + n_neg + 1)
        return Model(np.zeros(1 << TABLE_BITS, np.float32), float(np.log(share / (1 - share))))
    wanted = np.zeros(1 << TABLE_BITS, np.bool_)
    wanted[places] = True

    def features(batches):
        for batch in batches:
            own = [encoded(np.searchsorted(places, unique_grams([x], wanted)[1]), len(places)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["toxic", "grams"])

    got = sorted((r.toxic, bytes(r.grams)) for r in sample.mapInArrow(features, "toxic int, grams binary").collect())
    scale = ratios(total[1], total[0], n_pos, n_neg)[places]
    weight = np.zeros(1 << TABLE_BITS)
    w, bias = fit(Presence([g for _, g in got], len(places)), np.array([x for x, _ in got]), scale)
    weight[places] = w * scale
    return Model(weight, bias)


def learnt(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labels (doc_id, toxic) of documents that are not held out; only their texts are fetched."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isNotNull())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_rows)
    texts = docs.select(named(id_col).alias("doc_id"), whole(text_col).alias("text"))
    return train(texts.join(F.broadcast(chosen), "doc_id"), most_rows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from a half on) for each row; null texts are empty."""
    places = np.flatnonzero(model.weight)
    few = (places.astype(np.int32), model.weight[places].astype(np.float32), model.bias)

    def run(batches):
        weight = np.zeros(1 << TABLE_BITS)
        weight[few[0]] = few[1]
        own = Model(weight, few[2])
        for batch in batches:
            scores = own.scores(batch.column(1).to_pylist()) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with the columns of docs; learns as `toxicity` does."""
    model = learnt(docs, labels, most_rows, text_col=text_col)
    places = np.flatnonzero(model.weight)
    few, at = (places.astype(np.int32), model.weight[places].astype(np.float32), model.bias), docs.columns.index(text_col)

    def run(batches):
        weight = np.zeros(1 << TABLE_BITS)
        weight[few[0]] = few[1]
        own = Model(weight, few[2])
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(own.scores([x or "" for x in batch.column(at).to_pylist()]) < 0.5))

    # mapInArrow takes names with dots for fields of structs
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """Every fifth document, by a checksum of its id: never learnt from. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Learns from the labels (doc_id, toxic) of documents that are not held out, on at most
    `most_rows` of them; see `train`. Only the text is an input of a score. Null texts are
    empty and score like any other without telling n-grams; ids may be null or repeat;
    texts are read whole; an empty table gives an empty result.
    """
    model = learnt(docs, labels, most_rows)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
