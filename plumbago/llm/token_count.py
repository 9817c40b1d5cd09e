"""Token counts through a digest cache: each distinct text is encoded once per tokenizer version, ever."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, new_table, slices, stored

#: Entries of a worker's chunk memo; it is emptied when full, which changes speed only.
MEMO_ENTRIES = 400_000

#: Characters that no tokenizer library takes for white space.
_SOLID = "[!-~¡-ɏ]"
#: A text cut where a solid character is followed by one blank or newline and another solid character.
_CHUNK = re.compile(rf"[ \n]?{_SOLID}++(?=[ \n]{_SOLID}|\Z)|.+?(?=(?<={_SOLID})[ \n]{_SOLID}|\Z)", re.S)

_loaded: dict[str, "ChunkCounter"] = {}


class ChunkCounter:
    """Counts tokens exactly as the library does on the whole text.

    A byte-level BPE with the usual split pattern never lets a token span a cut of _CHUNK, so counts of chunks add up
    and can be memoised; any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = (
            spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        )
        self.memo: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(texts), 512):
            out += map(len, self.lib.encode_batch_fast(texts[i : i + 512], add_special_tokens=False))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_chunk:
            return [n for t in texts for n in self._encode([t])]
        memo, chunks = self.memo, [_CHUNK.findall(t) for t in texts]
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        if fresh := list({c for cs in chunks for c in cs if c not in memo}):
            memo.update(zip(fresh, self._encode(fresh), strict=True))
        return [sum(map(memo.__getitem__, cs)) for cs in chunks]


def counter(path: str) -> ChunkCounter:
    if path not in _loaded:
        _loaded[path] = ChunkCounter(path)
    return _loaded[path]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: counts of another version never match."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    cache_path is a Parquet table (digest, tokenizer, n_tokens) that this call reads and appends to; None: a new one in
    the shared folder. A row is found by the SHA-256 of its text and the tokenizer file's digest; only texts that are
    not in the cache are encoded, each once however many rows hold it.

    Null and empty texts have 0 bytes and 0 tokens. Repeated ids and rows stay as they are; a null id stays null. An
    empty table gives an empty result. Other columns of docs are ignored.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    path = cache_path or new_table(spark, "token-cache")
    keyed = id_and_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))
    todo = keyed.select("digest", "text")
    if cache_path and _exists(spark, cache_path):
        todo = todo.join(_cached(spark, path, version).select("digest"), "digest", "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = counter(tokenizer_path)
        for b in slices(batches):
            n = lib.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * b.num_rows), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    misses = todo.groupBy("digest").agg(F.first("text").alias("text"))
    misses.mapInArrow(count, "digest binary, tokenizer string, n_tokens long").write.mode("append").parquet(path)
    counts = stored(_cached(spark, path, version), "token-counts")  # a stored side: a hot text's rows can then be split
    sized = keyed.select(F.col("id"), F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sized.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cached(spark, path: str, version: str) -> DataFrame:
    """Two runs at once may both append a text; the counts are equal, so one row of each digest is taken."""
    table = spark.read.schema("digest binary, tokenizer string, n_tokens long").parquet(path)
    return table.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
