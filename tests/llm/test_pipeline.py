import inspect

import corpus_pipeline
from corpus_pipeline import STAGES

from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_copies import brute_groups
from tests.llm.test_tokens import check_packing

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from spanveil.llm.queries import tokenizer
    from spanveil.llm.toxicity import toxicity

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, None, "src0", 0), (10_001, "", "en", None, 0), (10_002, "Copy of mine.", "en", "src1", 13), (10_003, "Copy of mine.", "en", "src1", 13)], docs.schema)
    docs, columns = docs.union(extra), docs.columns
    kept = []
    for k, (name, stage) in enumerate(STAGES):
        assert [*inspect.signature(stage).parameters] == ["spark", "docs", "sf_dir"]
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        was, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        before, after = was.collect(), docs.collect()
        if k < 4:
            assert docs.columns == columns
            kept = sorted(r.doc_id for r in after)
        if name == "toxicity":
            assert kept == sorted(r.doc_id for r in toxicity(was, spark.read.parquet(f"{DIR}/labels.parquet")).collect() if not r.predicted)
        elif name == "exact dedup":
            best = {}
            for r in before:
                best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
            assert kept == sorted(best.values())
        elif name == "near dedup":
            assert kept == sorted(g[0] for g in brute_groups([(r.doc_id, r.text) for r in before]))
        elif name == "mixing":
            assert kept == sorted(x[0] for x in brute_mix([(r.doc_id, r.text, r.lang, r.source) for r in before]) if x[3])
        else:
            lib = Tokenizer.from_file(tokenizer())
            check_packing(after, [(r.doc_id, (r.text or "").encode(), lib.encode(r.text or "", add_special_tokens=False).ids) for r in before], 2048)


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert rows and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_cell string, gone_id string, `gone.digest` string, score double"


def test_stages_keep_other_columns_and_ids_that_repeat(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "v ")
    texts = [(1, base), (5, near), (5, "completely other text"), (6, "completely other text"), (6, "more"), (7, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "mine", "mine", "mine", 0.5) for i, t in texts], SCHEMA)
    want = {"toxicity": texts, "exact dedup": [x for x in texts if x not in ((5, "completely other text"), (7, None))], "near dedup": [x for x in texts if x not in ((5, near), (7, None))]}
    for name, stage in STAGES[:-1]:
        got = stage(spark, docs, DIR)
        assert got.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in got.collect()]
        assert name not in want or sorted(map(str, rows)) == sorted(map(str, want[name])), name


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in STAGES:
        assert stage(spark, docs, DIR).collect() == []
