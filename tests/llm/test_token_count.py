import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbago.llm.token_count import ChunkCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "a  b", "a \n\n b", "it's  we'll\tx", "x<|endoftext|> y", " <|endoftext|>", "é à ñ", "ab cd", "漢字 かな", "  a", "1234567 890", "a" * 5000, "\x00\x01 \x1c a", "end \n", "\n\nx", "word " * 3000]


def lib():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_chunks_count_as_the_library_does(spark):
    texts = HARD + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert ChunkCounter(PATH).by_chunk
    assert ChunkCounter(PATH).counts(texts) == [len(lib().encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_tokenizers_get_whole_texts():
    c = ChunkCounter(public_tokenizers.path("word_bpe_49k.json"))
    assert not c.by_chunk
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert c.counts(["Hello  world", ""]) == [len(t.encode(x, add_special_tokens=False).ids) for x in ["Hello  world", ""]]


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, "x", "d"), (1, "a b", "y", "d"), (None, "a b", "z", "d"), (2, "", "w", "d"), (3, "b " * 2000, "v", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens string")
    got = sorted([tuple(r) for r in token_counts(df, PATH).collect()], key=str)
    n = len(lib().encode("b " * 2000, add_special_tokens=False).ids)
    assert got == sorted([(1, 0, 0, False), (1, 3, 2, False), (None, 3, 2, False), (2, 0, 0, False), (3, 4000, n, True)], key=str)
    assert token_counts(df.limit(0), PATH).count() == 0


def test_cache_is_read_and_appended_to(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    one = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    token_counts(one, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    two = spark.createDataFrame([(4, "a b"), (5, "new one")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(two, PATH, cache).collect()} == {4: 2, 5: 2}
    assert spark.read.parquet(cache).count() == 3


@pytest.mark.parametrize("limit,over", [(1, True), (2, False)])
def test_limit_is_exclusive(spark, limit, over):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert token_counts(df, PATH, limit=limit).first()["over_limit"] is over


def test_intermediate_tables_are_deleted(spark):
    import os

    from plumbago.llm import common

    common.stored(spark.range(3).toDF("x"), "three")
    folder = common.shared_folder(spark).removeprefix("file://")
    assert os.listdir(folder)
    common.clean(spark)
    assert not os.path.exists(folder)
