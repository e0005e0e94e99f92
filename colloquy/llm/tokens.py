"""Encoding of the whole corpus with a public tokenizer, one distinct word at a time."""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

#: Where the vocabulary files lie; never copied into the repository.
TOKENIZER_DIR = os.environ.get("COLLOQUY_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabulary.
#: (?U) gives \s its Unicode meaning, as in the tokenizer.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word with more than 1/HOT_SHARE of all occurrences is hot: fewer than HOT_SHARE words, broadcast.
HOT_SHARE = 50_000


def _ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(name: str, folder: str):
    def encode(frames):
        import tiktoken

        core = tiktoken.Encoding(name, pat_str=r"(?s).+", mergeable_ranks=_ranks(name, folder), special_tokens={})._core_bpe
        for frame in frames:
            ids = [core.encode_single_piece(w.encode("utf-8", "replace")) for w in frame["word"]]
            yield pd.DataFrame({"word": frame["word"], "n": frame["n"], "ids": ids})

    return encode


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), values)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. count-1 for each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _hot_joiner(words: list[str], ids: list[list[int]]):
    """Joins the hot words' ids by position; each other word leaves -1 in ``plain`` and goes to ``cold``, in order."""
    size = np.array([len(x) for x in ids] + [1], np.int64)
    first = np.cumsum(size) - size
    flat = np.array([i for x in ids for i in x] + [-1], np.int32)
    known = pa.array(words, pa.string())

    def join(batches):
        for batch in batches:
            col = batch.column("words")
            count = np.diff(col.offsets.to_numpy())
            tokens = col.flatten()
            at = pc.fill_null(pc.index_in(tokens, value_set=known), len(words)).to_numpy().astype(np.int64)
            width = size[at]
            plain = flat[np.repeat(first[at], width) + _spread(width)]
            rare = at == len(words)
            ends = np.concatenate([[0], np.cumsum(count)])
            sums, misses = np.concatenate([[0], np.cumsum(width)]), np.concatenate([[0], np.cumsum(rare)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists(pa.array(plain), np.diff(sums[ends])), _lists(tokens.filter(pa.array(rare)), np.diff(misses[ends]))],
                ["doc_id", "plain", "cold"],
            )

    return join


def _splice(batches):
    """Puts the joined ids of the cold words, in order, where ``plain`` has -1."""
    for batch in batches:
        plain, parts = batch.column("plain"), batch.column("parts")
        flat = plain.flatten().to_numpy()
        ids = parts.flatten().field("ids")
        width = np.ones(len(flat), np.int64)
        width[flat == -1] = np.diff(ids.offsets.to_numpy())
        out = np.repeat(flat, width)
        out[out == -1] = ids.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.diff(plain.offsets.to_numpy()))])
        sums = np.concatenate([[0], np.cumsum(width)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(pa.array(out), np.diff(sums[ends]))], ["doc_id", "ids"])


def encode_corpus(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR
) -> DataFrame:
    """The token ids of every text, without special tokens.

    Texts are split into pre-tokens with positions; each distinct pre-token of the corpus is
    encoded once; the ids are joined back and put together by position.  The fewer than
    HOT_SHARE words above 1/HOT_SHARE of all occurrences, nearly all occurrences of a real
    corpus, are joined by broadcast where the text lies.  Only the rest is exploded and
    shuffled by word, where no word is frequent enough to burden a task, and then
    back to its document.  Runs eagerly up to the hot join.

    Defined cases: null and empty texts give an empty list; strings of special
    tokens are ordinary text; a row delivered twice counts once (the id is the
    key of a document); null ids are left out; an empty table gives no rows; other columns are ignored.
    Result: ``doc_id``, ``ids``.
    """
    scratch = Scratch(documents.sparkSession, "tokens")
    docs = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id"])
    words = F.regexp_extract_all("text", F.lit(PRETOKEN), F.lit(0))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    distinct = scratch.save(counts.mapInPandas(_encoder(vocabulary, folder), "word string, n long, ids array<int>"), "words")
    cut = (distinct.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    hot = distinct.filter(F.col("n") > cut).select("word", "ids").collect()  # fewer than HOT_SHARE rows
    rest = distinct.filter(F.col("n") <= cut).select("word", "ids")
    split = docs.select("doc_id", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    join = _hot_joiner([r["word"] for r in hot], [r["ids"] for r in hot])
    key = documents.schema[doc_id].dataType.simpleString()
    joined = scratch.save(split.mapInArrow(join, f"doc_id {key}, plain array<int>, cold array<string>"), "joined")

    far = joined.select("doc_id", F.posexplode("cold").alias("pos", "word")).join(rest, "word")
    parts = far.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    whole = joined.filter(F.size("cold") > 0).select("doc_id", "plain").join(parts, "doc_id")
    done = whole.mapInArrow(_splice, f"doc_id {key}, ids array<int>")
    return joined.filter(F.size("cold") == 0).select("doc_id", F.col("plain").alias("ids")).unionByName(done)


def token_bytes(spark: SparkSession, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The bytes of each token id; its size is that of the vocabulary."""
    rows = [(i, bytearray(b)) for b, i in _ranks(vocabulary, folder).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode_corpus(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The texts of ``encode_corpus``'s lists: a broadcast join with the token-byte table.

    An empty or null list gives an empty text; ids outside the vocabulary are left out.
    Result: ``doc_id``, ``text``.
    """
    table = F.broadcast(token_bytes(encoded.sparkSession, vocabulary, folder))
    parts = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(table, "id", "left")
    hexed = F.struct(F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce(F.hex("bytes"), F.lit("")).alias("x"))
    return (
        parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(hexed)).alias("parts"))
        .select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["x"]), "")), "UTF-8").alias("text"))
    )
