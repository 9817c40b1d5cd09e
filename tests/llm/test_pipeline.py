"""run() against each stage done plainly, one document at a time."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece

from plumbago.llm import simhash, toxicity
from tests.llm import test_decontaminate, test_simhash, test_suffix

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    docs = {i: t for i, t in docs.items() if model.score(t) < 0.5}
    comp = test_simhash.slow_components([(i, test_simhash.slow_print(t)) for i, t in docs.items()])
    docs = {i: t for i, t in docs.items() if comp[i] == i}
    docs = {i: left.decode() for i, (_, left) in zip(docs, test_suffix.brute_words(list(docs.values()), 50), strict=True)}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r[0]: docs[r[0]] for r in test_decontaminate.brute(list(docs.items()), items) if not r[5]}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(lib.encode(t)), sha(",".join(map(str, lib.encode(t)))), sha(lib.decode(lib.encode(t)))) for i, t in docs.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < table.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_with_odd_rows_and_clashing_names(spark):
    clashes = "carried3,carried0,carried5,carried_4,predicted,score,kept,n_bytes,contaminated,spans,fp,root,digest,id,keep0,d1".split(",")
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " ", "plain words of a clean text", "plain words of a clean text", long, long + " x", "y" * 200_000]
    rows = [(None if i == 3 else i // 2, t, len(t or ""), *(f"{c}{i}" for c in clashes)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in clashes))
    given = {r["score"]: r for r in docs.collect()}
    left = {"toxicity": 8, "simhash_near_dedup": 4, "suffix_array_dedup": 8, "benchmark_decontamination": 8}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and len(got) == left[name], name
        for r in got:
            assert all(r[c] == given[r["score"]][c] for c in ("doc_id", *clashes)), name
            assert name == "suffix_array_dedup" or r["text"] == given[r["score"]]["text"]
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == 8


def test_one_of_each_with_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "x y z v w"), (3, "p q r s t")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (r[0] for r in kept))) == ["1", "3", "None"]


def test_one_of_each_keeps_a_row_of_every_component(spark):
    rows = [(1, "a b c d e"), (1, "p q r s t"), (2, "p q r s t"), (None, "x y z v w"), (None, "x y z v w")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == ["(1, 'a b c d e')", "(1, 'p q r s t')", "(None, 'x y z v w')"]
