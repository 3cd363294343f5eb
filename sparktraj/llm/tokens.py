"""Problem 7: encoding of the whole corpus with a public tokenizer, through a table of distinct words.

Texts are split into words in Spark tasks; a block of some million characters keeps its own table of distinct words and its
documents as word numbers. The words of all blocks are grouped, each distinct word is encoded once, and the ids go back by
(block, word number), where the documents are put together with array gathers. Only words distinct within a block are
shuffled, never the occurrences.

Defined cases: null and empty texts give an empty list (0 tokens); one row for every input row, whatever its doc_id (null or
repeated); special-token strings are ordinary text; texts of any length are encoded whole; other columns are ignored.
"""
from __future__ import annotations

import base64
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters after which a block of documents is closed.
BLOCK_CHARS = 4_000_000
#: White space as the vocabulary's pattern means it (the White_Space property).
SPACE = r"\t-\r \x85\xa0  -     　"
#: The pattern published with the vocabulary, and the same with white space spelt out.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def newer_letters() -> str:
    """A character class of letters and numbers that only newer Unicode data know; texts with them are split by the tokenizer's
    own library, so that no difference between Unicode versions matters."""
    known = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", known) if unicodedata.category(c) == "Cn"]
    ranges: list[list[int]] = []
    for c in new:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else "(?!)"


def contents(path: str) -> bytes:
    """The vocabulary file (about a megabyte), read on the driver; tasks get it with their code and need no copy on their machines."""
    with open(path, "rb") as f:
        return f.read()


def load(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def split_words(docs: DataFrame, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, doc_id, idx, words): a row per document with its word numbers, and one per block with its distinct words."""
    new = newer_letters()

    def library_split(text):
        from tokenizers import pre_tokenizers

        return [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def run(batches):
        find, odd = regex.compile(WORDS).findall, regex.compile(new).search
        pid, seq = TaskContext.get().partitionId(), 0
        numbers, ids, idx, ends, chars = _Numbers(), [], array("i"), [0], 0

        def close():
            flat, n = np.frombuffer(idx, np.int32) if idx else np.empty(0, np.int32), len(ids)
            block = pid << 24 | seq
            cells = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.array(ends, np.int64) * 4), pa.py_buffer(flat)]).cast(pa.binary())
            names = ["block", "doc_id", "idx", "words"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(ids, pa.int64()), cells, pa.nulls(n, pa.list_(pa.string()))], names)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([list(numbers)], pa.list_(pa.string()))], names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                words = find(text) if text.isascii() or not odd(text) else library_split(text)
                idx.extend(map(numbers.__getitem__, words))
                ids.append(doc)
                ends.append(len(idx))
                chars += len(text)
                if chars >= block_chars:
                    yield from close()
                    seq += 1
                    numbers, ids, idx, ends, chars = _Numbers(), [], array("i"), [0], 0
        if ids:
            yield from close()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, doc_id long, idx binary, words array<string>")


def encode_words(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, ids as binary int32) of distinct words."""
    ranks = contents(vocabulary)

    def run(batches):
        enc = None
        for b in batches:
            enc = enc or load(ranks)
            ids = [np.array(enc.encode_ordinary(w), np.int32).tobytes() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids binary")


def _gather(docs: DataFrame, vocabulary: str, block_chars: int, counts_only: bool) -> DataFrame:
    split = materialize(split_words(docs, vocabulary, block_chars), "words")
    words = split.where("words is not null").select("block", F.posexplode("words").alias("n", "word"))
    coded = words.join(encode_words(words.select("word").distinct(), vocabulary), "word").select("block", "n", "ids")

    def run(left, right):
        o = np.argsort(right.column("n").to_numpy())
        cells = right.column("ids").combine_chunks() if right.num_rows else None
        idx = left.column("idx").combine_chunks() if left.num_rows else None
        if idx is None:
            return pa.table({"doc_id": pa.array([], pa.int64())} | ({"n_tokens": pa.array([], pa.int64())} if counts_only else {"ids": pa.array([], pa.list_(pa.int32()))}))
        at = np.frombuffer(idx.buffers()[1], np.int32)[idx.offset : idx.offset + len(idx) + 1]
        flat = np.frombuffer(idx.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(np.int32)
        ends = (at - at[0]) // 4
        if cells is None:
            size, values, start = np.zeros(1, np.int64), np.empty(0, np.int32), np.zeros(1, np.int64)
        else:
            cells = cells.take(pa.array(o))
            w = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
            values, size, start = np.frombuffer(cells.buffers()[2], np.uint8)[w[0] : w[-1]].view(np.int32), np.diff(w) // 4, (w[:-1] - w[0]) // 4
        n = size[flat] if len(flat) else np.empty(0, np.int64)
        after = np.r_[0, np.cumsum(n)]
        total = after[ends]
        if counts_only:
            return pa.table({"doc_id": left.column("doc_id"), "n_tokens": np.diff(total)})
        take = np.arange(after[-1]) + np.repeat(start[flat] - after[:-1], n) if len(flat) else np.empty(0, np.int64)
        return pa.table({"doc_id": left.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(values[take]))})

    texts = split.where("words is null").select(F.col("block").alias("of"), "doc_id", "idx")
    return texts.groupBy("of").cogroup(coded.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long" if counts_only else "doc_id long, ids array<int>")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) for every row of docs(doc_id, text)."""
    return _gather(docs, vocabulary, block_chars, False)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs(doc_id, text)."""
    return _gather(docs, vocabulary, block_chars, True)


def split_ids(coded: DataFrame, block_ids: int = BLOCK_CHARS) -> DataFrame:
    """(block, doc_id, idx, ids): a row per document with the places of its ids in the block's list, and one per block with that list."""

    def run(batches):
        pid, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        names = ["block", "doc_id", "idx", "ids"]

        def close():
            block = pid << 24 | seq
            lists = pa.chunked_array([h[1] for h in held]).combine_chunks()
            flat, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            ends = np.r_[0, np.cumsum(np.concatenate([h[2] for h in held]))] * 4
            null = lists.is_null()
            cells = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(at.astype(np.int32))]).cast(pa.binary())
            cells = pc.if_else(null, pa.scalar(None, pa.binary()), cells)
            docs = pa.chunked_array([h[0] for h in held]).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), block)), docs, cells, pa.nulls(len(docs), pa.list_(pa.int32()))], names)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([flat.tolist()], pa.list_(pa.int32()))], names)

        for b in batches:
            if b.num_rows:
                n = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy()
                held.append((b.column(0), b.column(1), n))
                size += int(n.sum())
            if size >= block_ids:
                yield from close()
                seq, held, size = seq + 1, [], 0
        if held:
            yield from close()

    return coded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "block long, doc_id long, idx binary, ids array<int>")


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the distinct ids of every block of documents join the table of pieces by id, and the pieces go
    back by position. Null ids give null, an empty list an empty text; bytes that aren't UTF-8 become U+FFFD; an id without
    a piece is an error."""
    split = materialize(split_ids(coded), "ids")
    pieces, _ = small_side(coded.sparkSession.createDataFrame(pa.table(dict(zip(("id", "piece"), map(list, zip(*[(int(n), base64.b64decode(p)) for p, n in map(bytes.split, contents(vocabulary).splitlines())])))))).select(F.col("id").cast("int").alias("id"), "piece"))
    named = split.where("ids is not null").select("block", F.posexplode("ids").alias("n", "id")).join(pieces, "id", "left").select(F.col("block").alias("of"), "n", "piece")

    def run(left, right):
        o = np.argsort(right.column("n").to_numpy())
        cells = right.column("piece").take(pa.array(o)).to_pylist()
        if None in cells:
            raise ValueError("an id has no piece in the vocabulary")
        texts = [None if i is None else b"".join([cells[j] for j in np.frombuffer(i, np.int32)]).decode("utf-8", "replace") for i in left.column("idx").to_pylist()]
        return pa.table({"doc_id": left.column("doc_id"), "text": pa.array(texts, pa.string())})

    return split.where("ids is null").select("block", "doc_id", "idx").groupBy("block").cogroup(named.groupBy("of")).applyInArrow(run, "doc_id long, text string")


def p7_ids(spark, d: str) -> DataFrame:
    return encode(spark.read.parquet(f"{d}/documents.parquet"))


def p7_round_trip(spark, d: str) -> DataFrame:
    """Every document encoded, decoded and compared: per source the documents, tokens and texts that came back equal."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    coded = materialize(encode(docs), "ids")
    back = decode(coded).select("doc_id", F.xxhash64("text").alias("h"))
    sizes = coded.select("doc_id", F.size("ids").cast("long").alias("n"))
    all_ = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h0")).join(back, "doc_id").join(sizes, "doc_id")
    return all_.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.count(F.when(F.col("h") == F.col("h0"), 1)).alias("equal"))
