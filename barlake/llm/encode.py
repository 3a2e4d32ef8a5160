"""Encoding of a whole corpus by a public byte-level tokenizer.

Texts are pre-split by the vocabulary's pattern; the new words of a batch are read
together by the automaton of ``automaton.py`` and kept, so a task's work follows
its text and its distinct words. Tables are compiled once on the driver and shipped;
their size is the vocabulary's. No shuffle at any size: tasks follow the splits of
the files, as sending a corpus over the network costs more than reading it.

Defined cases: null and empty texts give an empty list; strings of special
tokens are ordinary text; texts of any length are encoded whole; rows are kept
one to one, repeats included, and other columns are left out.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.automaton import Automaton, Tables, compile_merges

VOCABULARY = os.environ.get("BARLAKE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: How byte-level vocabularies of this family split text before merging; fixed.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for text of ASCII characters only, which the standard library splits faster.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Words a task keeps with their ids before it starts afresh.
KEPT_WORDS = 250_000
_compiled: dict[str, Tables] = {}


def _read(known: dict[str, bytes], texts: list[list[str]], automaton: Automaton) -> None:
    """Puts the words of split texts that are not known yet, with their ids as bytes, among the known ones."""
    new = list(set().union(*texts).difference(known))
    known.update(zip(new, automaton.encode_many([w.encode("utf-8", "surrogatepass") for w in new])))


def tables(spark: SparkSession, vocabulary: str = VOCABULARY):
    """The compiled vocabulary, shipped to every executor once per call."""
    if vocabulary not in _compiled:
        _compiled[vocabulary] = compile_merges(vocabulary)
    # Long texts: a batch holds few rows, so a worker's memory follows the rows of a batch and not the file's.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark.sparkContext.broadcast(_compiled[vocabulary])


def splitter() -> Callable[[str], list[str]]:
    """Splits a text into words by PATTERN.

    No word reaches from a character that is not white space into a line break,
    so a text may be cut there; lines of ASCII characters take the faster way.
    """
    import re

    import regex

    general, plain = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
    lines = re.compile(r"(?<=\S)(?=\n)").split

    def split(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        words: list[str] = []
        for line in lines(text):
            words += plain(line) if line.isascii() else general(line)
        return words

    return split


def _texts(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    for i in range(len(column)):
        yield column[i].as_py() or ""


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens."""
    spark = docs.sparkSession
    shipped = tables(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, automaton, words = splitter(), Automaton(shipped.value), {}
        for batch in batches:
            texts = [split(t) for t in _texts(batch.column(1))]
            _read(words, texts, automaton)
            rows = [np.frombuffer(b"".join(map(words.__getitem__, t)), dtype=np.int32) for t in texts]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["k", "ids"])
            if len(words) > KEPT_WORDS:
                words.clear()

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return picked.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(docs: DataFrame, key: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key columns, tokens long): how many ids each row's text has."""
    spark = docs.sparkSession
    shipped = tables(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, automaton, words = splitter(), Automaton(shipped.value), {}
        for batch in batches:
            texts = [split(t) for t in _texts(batch.column(batch.num_columns - 1))]
            _read(words, texts, automaton)
            n = pa.array([sum(map(len, map(words.__getitem__, t))) // 4 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "tokens"])
            if len(words) > KEPT_WORDS:
                words.clear()

    picked = docs.select(*key, F.col(text).alias("_text"))
    schema = ", ".join([f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in key] + ["tokens long"])
    return picked.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the labels along each row's ids; a null list stays null, bytes that are no UTF-8 become U+FFFD."""
    shipped = tables(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shipped.value)
        for batch in batches:
            texts = [None if row is None else automaton.decode(row).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
