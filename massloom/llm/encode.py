"""Encoding of a corpus with a public byte-level tokenizer by a table of distinct words.

Texts are split into words by the tokenizer's own pattern in Spark. Each slice of texts is written as codes into the
slice's own list of distinct words; the distinct words of all slices are encoded once, joined back to the slices' lists
by word, and from there to the texts by position. A word has one row per slice, however often it occurs; the words that
occur in most slices are sent to all tasks, so the shuffle carries the others only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from massloom.session import durable_table

TOKENIZER_DIR = "/opt/tokenizers"
#: Texts of one slice, and words of one slice (a longer text is a slice of its own).
SLICE, SLICE_WORDS = 4000, 2_000_000
#: Words that are sent to all tasks with their ids: those in most slices.
FREQUENT = 4096

# The word pattern of the tokenizer, with its white space written out (Java's \s is ASCII only).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_PATTERN = (  # words of letters come first: nothing else can start where one does, and most words are of letters
    r" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> dict[bytes, int]:
    """The vocabulary of a tokenizer file: bytes of each piece to its id (some 50,000 entries)."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def split_words(text: Column) -> Column:
    """The words of a text in order; their concatenation is the text. Null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0), F.array().cast("array<string>"))


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``ids`` for the column ``word``, each row encoded on its own; other columns stay."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            ids = bpe.encode_ordinary_batch(b.column("word").to_pylist(), num_threads=1)
            columns = [*b.columns, pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "ids"])

    types = ", ".join(f"{c} {t}" for c, t in words.dtypes)
    return words.mapInArrow(encode, f"{types}, ids array<int>")


def encode_texts(docs: DataFrame, key: str, text: str, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """``key`` and ``ids``, the list of token ids of each text, without special tokens.

    Null and empty texts have an empty list. Special-token strings in a text are ordinary text. Repeated rows come out
    as often as they occur, null keys too; other columns of ``docs`` are left out. An empty table gives an empty result.
    """
    ranks, rows = ranks or read_ranks(), SLICE
    key_type = dict(docs.dtypes)[key]
    names = ["slice", "k", "codes", "words"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, b in enumerate(_slices(batches, rows, SLICE_WORDS)):
            words = b.column("words")
            coded = _flat(words).dictionary_encode()
            codes = pa.ListArray.from_arrays(pa.array(_offsets(words), pa.int32()), coded.indices.cast(pa.int32()))
            none = pa.nulls(b.num_rows, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.repeat(first + n, b.num_rows), b.column("k"), codes, none], names=names)
            distinct = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
            nothing = [pa.array([first + n], pa.int64()), pa.nulls(1, b.column("k").type), pa.nulls(1, codes.type), distinct]
            yield pa.RecordBatch.from_arrays(nothing, names=names)

    split = docs.select(F.col(key).alias("k"), split_words(F.col(text)).alias("words"))
    coded = durable_table(split.mapInArrow(code, f"slice long, k {key_type}, codes array<int>, words array<string>"))
    listed = coded.where("words IS NOT NULL").select("slice", F.posexplode("words").alias("code", "word"))
    table = durable_table(encode_words(listed.groupBy("word").agg(F.count(F.lit(1)).alias("n")), ranks))  # one row per distinct word
    frequent = F.broadcast(table.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "ids"))
    marked = listed.join(frequent, "word", "left")
    rest = marked.where("ids IS NULL").drop("ids").join(table.select("word", "ids"), "word")
    by_code = marked.where("ids IS NOT NULL").unionByName(rest).select(F.col("slice").alias("of"), "code", "ids")

    def join(texts: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words.column("code").to_numpy())  # a slice's codes run from 0 without gaps
        ids = _one(words.column("ids")).cast(pa.list_(pa.int32())).take(pa.array(order))
        codes = _one(texts.column("codes"))
        return pa.table({"k": texts.column("k"), "ids": _regroup(codes, ids.take(_flat(codes)))})

    texts = coded.where("codes IS NOT NULL").select("slice", "k", "codes")
    together = texts.groupBy("slice").cogroup(by_code.groupBy("of"))
    return together.applyInArrow(join, f"k {key_type}, ids array<int>").withColumnRenamed("k", key)


def _one(column: pa.ChunkedArray) -> pa.Array:
    """The chunks of a column as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _flat(lists: pa.Array) -> pa.Array:
    return lists.flatten()


def _offsets(lists: pa.Array) -> np.ndarray:
    """Offsets of the lists into ``_flat(lists)``; a null list is empty."""
    return np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))].astype(np.int64)


def _regroup(words: pa.Array, lists: pa.ListArray) -> pa.ListArray:
    """The ids of each word, put together for each text."""
    values, inner = lists.flatten(), _offsets(lists)
    return pa.ListArray.from_arrays(pa.array(inner[_offsets(words)], pa.int32()), values)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, words: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` and, if given, ``words`` entries of the column ``words`` (or one row), which bounds what a task holds of long texts."""
    for b in batches:
        ends = _offsets(b.column("words")) if words else None
        i = 0
        while i < b.num_rows:
            j = min(i + rows, b.num_rows)
            if ends is not None:
                j = min(j, max(i + 1, int(np.searchsorted(ends, ends[i] + words, "right")) - 1))
            yield b.slice(i, j - i)
            i = j


def piece_table(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id, by id (null: no such id). As long as the vocabulary, whatever the corpus."""
    pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return pa.array(pieces, pa.large_binary())


def decode_ids(encoded: DataFrame, key: str, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """``key`` and ``text`` of the lists ``ids``, by a join of the ids with the table of pieces, which is sent to the tasks.

    The ids of a list are joined by position where the list lies, so nothing is shuffled. An empty or null list gives the
    empty text; an id that isn't in the vocabulary, and null, add nothing. Bytes that are no valid UTF-8 come out as
    replacement characters. Repeated rows come out as often as they occur.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(piece_table(ranks or read_ranks()))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for b in _slices(batches):
            lists = b.column("ids")
            ids = _flat(lists)
            known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(pieces)))
            joined = pc.fill_null(pieces.take(pc.if_else(known, ids, None)), b"")
            ends = np.r_[0, np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False))][_offsets(lists)]
            data = memoryview(joined.buffers()[2] or b"")  # the pieces lie one behind the other
            texts = [bytes(data[i:j]).decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(texts, pa.string())], names=["k", "text"])

    rows = encoded.select(F.col(key).alias("k"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(join, f"k {dict(encoded.dtypes)[key]}, text string").withColumnRenamed("k", key)
