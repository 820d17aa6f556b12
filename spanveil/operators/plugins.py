"""Detectors beyond the rules: dictionaries, and models or anything else in Python that maps texts to spans."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators.detect import matches, none_found
from spanveil.operators.splice import free_names, with_own_map
from spanveil.types import ENTITIES, MODEL_LABELS, TAG_LABELS

#: Makes a detector in each worker, once: texts and languages to a list of spans for each.
Detector = Callable[[list[str], list[str | None]], list[list[dict]]]
log = logging.getLogger(__name__)


#: Detectors by name: what makes each, and whether its model is here.
REGISTERED: dict[str, tuple[Callable[[], Detector], Callable[[], bool]]] = {}


def register(name: str, make: Callable[[], Detector], available: Callable[[], bool] = lambda: True) -> None:
    REGISTERED[name] = make, available


def chosen(detectors: Iterable[Callable[[], Detector] | str]) -> list[Callable[[], Detector]]:
    """The makers of the detectors, named ones from those registered.

    "all" stands for every registered one; there, one whose model is missing is left out
    with a warning. One that is asked for by name and missing is an error.
    """
    out = []
    for one in detectors:
        if callable(one):
            out.append(one)
        elif one == "all":
            for name, (make, available) in REGISTERED.items():
                if available():
                    out.append(make)
                else:
                    warnings.warn(f"detector {name} is left out: its model is missing", UserWarning, stacklevel=3)
        elif one not in REGISTERED:
            raise ValueError(f"no detector is registered as {one!r}")
        elif not REGISTERED[one][1]():
            raise RuntimeError(f"the model of detector {one!r} is missing")
        else:
            out.append(REGISTERED[one][0])
    return out


def gazetteer(docs: DataFrame, names: DataFrame, score: float = 0.85, text_col: str = "text") -> DataFrame:
    """docs with the names of a dictionary (name, entity_type) that stand in the text appended to `entities`.

    A name matches in any case, and where no letter, digit or _ stands beside it. The
    distinct words of each text are joined to the first words of names, so only texts that
    hold one are searched, and only for its names, whatever the size of the dictionary.
    Names without a word are left out; where names overlap, all are told.
    """
    first, own = free_names(docs.columns, "first", "names")
    known = names.select(F.lower("name").alias("name"), "entity_type").where(F.regexp_like("name", F.lit(r"(?U)\w"))).dropDuplicates(["name"])
    known = known.groupBy(F.regexp_extract("name", r"(?U)(\w+)", 1).alias(first)).agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "entity_type")))).alias(own))
    words = F.split(F.lower(F.col(text_col)), r"(?U)\W+", -1)
    ready = with_own_map(docs, words, known, first, own, own)
    asked = F.flatten(F.transform(F.map_values(own), lambda x: F.from_json(x, "array<struct<name string, entity_type string>>")))
    text = F.col(text_col)

    def found(x: Column) -> Column:
        edge = F.lit(r"(?!\w)")
        regex = F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), F.replace(x["name"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), edge)
        return F.transform(matches(text, regex), lambda m: F.struct(x["entity_type"].alias("entity_type"), m["text"].alias("text"), m["start"].cast("int").alias("start"), (m["start"] + F.length(m["text"])).cast("int").alias("end"), F.lit(float(score)).alias("score"), F.lit("gazetteer").alias("source")))

    spans = F.coalesce(F.flatten(F.transform(asked, found)).cast(ENTITIES), none_found())
    before = F.coalesce(F.col("entities"), none_found()) if "entities" in docs.columns else none_found()
    return ready.withColumn("entities", F.concat(before, spans)).drop(own)


def tagger(predict: Callable[[list[str]], list[list[tuple[str, int, int, float]]]], labels: dict[str, str] = TAG_LABELS, source: str = "tagger", only_lang: str | None = "de", places: int = 2, least: float = 0.0, only_types: Iterable[str] | None = None) -> Callable[[], Detector]:
    """A sequence tagger as a detector: its labels mapped (unknown ones dropped), scores rounded, other languages skipped, and types that are not asked for."""
    types = None if only_types is None else {*only_types}

    def make() -> Detector:
        def detect(texts, langs):
            out = []
            for text, lang, own in zip(texts, langs, predict(texts), strict=True):
                use = only_lang is None or lang == only_lang
                named = [(labels.get(k.lower() if labels is MODEL_LABELS else k), a, b, s) for k, a, b, s in own if use and s >= least]
                out.append([{"entity_type": t, "start": a, "end": b, "score": round(s, places), "source": source} for t, a, b, s in named if t is not None and (types is None or t in types)])
            return out

        return detect

    return make


def zero_shot(predict, least: float = 0.65) -> Callable[[], Detector]:
    """A zero-shot model as a detector."""
    return tagger(predict, MODEL_LABELS, "model", None, 4, least)


def with_plugin(docs: DataFrame, make: Callable[[], Detector], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with the detector's spans appended to `entities`, and its `detector_error` for a batch that failed.

    A detector that raises gives no spans for that batch and does not stop the others.
    """
    made: list[Detector] = []

    @F.pandas_udf(f"struct<found {ENTITIES}, error string>")
    def run(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in text]
        try:
            if not made:
                made.append(make())
            found, error = made[0](texts, [*lang]), None
        except Exception as e:  # one detector's fault is not the others'
            log.warning("detector failed: %s", type(e).__name__)
            found, error = [[] for _ in texts], f"{type(e).__name__}: {e}"
        full = [[e | {"text": t[e["start"] : e["end"]]} for e in own] for t, own in zip(texts, found, strict=True)]
        return pd.DataFrame({"found": full, "error": [error] * len(texts)})

    known = F.coalesce(F.col("entities"), none_found()) if "entities" in docs.columns else none_found()
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit("de")
    (ran,) = free_names(docs.columns, "ran")
    out = docs.withColumn(ran, run(F.col(text_col), lang))
    return out.withColumn("entities", F.concat(known, F.col(ran)["found"])).withColumn("detector_error", F.col(ran)["error"]).drop(ran)
