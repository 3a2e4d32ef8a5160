"""Reading level of each document by a Rasch-style latent difficulty model.

A word of difficulty ``b`` occurs in a document of level ``theta`` with log rate
``c + b * theta`` less the level's normaliser, so a document's level and its
words' difficulties live on one scale, the labels'. Estimation alternates: word
parameters from the counts of words per level (each word a Poisson regression on
at most ``BINS`` cells), levels from the words (the mean difficulty of a
document's words is sufficient for its level). The first round uses the labelled
documents, the following ones every document of the language. Counting and
levelling run on all rows where the data lie; what comes to the driver is the
table word bucket x level bin, of a size fixed by ``BUCKETS`` and ``BINS``.

Labels of at most ``CUT_SAMPLE`` documents (by hash of the id) set the cuts
between levels; words and levels are fitted on everything.

Defined cases: only prose counts: text cells without unbroken runs of 40 or more
characters (embedded images); documents of another or no language, without
text, cells or words get no level and are left out; cells that reach beyond the
text are cut off there; repeated documents are levelled alike; without labels
there is no scale and the result is empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.session import cut_lineage

BUCKETS, BINS, ROUNDS, CUT_SAMPLE = 1 << 16, 17, 2, 20_000
LOWEST, HIGHEST, MIDDLE = 1.0, 5.0, 3.0
LEVELS = np.linspace(LOWEST, HIGHEST, BINS)
CURVE = np.linspace(LOWEST - 1, HIGHEST + 1, 61)
WORD, UNBROKEN = r"[^\W\d_]+", r"\S{40,}"


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def prose_words(docs: DataFrame, lang: str = "en") -> DataFrame:
    """(doc_id, words): the word buckets of each document's text cells, in order; documents without any are left out."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    cells = F.transform(F.filter("cells", lambda c: (c.cell_type == "text") & (c.start_char >= 0) & (c.n_chars > 0)), lambda c: F.struct(c.start_char.alias("a"), c.n_chars.alias("n")))
    picked = docs.where((F.col("lang") == lang) & F.col("text").isNotNull() & F.col("cells").isNotNull()).select("doc_id", "text", cells.alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        class Buckets(dict):
            def __missing__(self, word: str) -> int:
                value = self[word] = _bucket(word)
                return value

        find, unbroken, known = re.compile(WORD).findall, re.compile(UNBROKEN), Buckets()
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            start, size = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                prose = "\n".join([text[start[j] : start[j] + size[j]] for j in range(at[i], at[i + 1])])
                rows.append(np.fromiter(map(known.__getitem__, find(unbroken.sub(" ", prose).lower())), dtype=np.int32))
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["doc_id", "words"])
            if len(known) > 1_000_000:
                known.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, words array<int>").where(F.size("words") > 0)


class Model:
    """Word parameters on the label scale and the curve from mean difficulty to level."""

    def __init__(self, counts: np.ndarray, bins: np.ndarray, steps: int = 30):
        """``counts``: buckets x bins. Newton steps per word with the normaliser of the last step as offset."""
        used = np.flatnonzero(counts.sum(axis=1))
        n, x = counts[used], bins - MIDDLE
        size = n.sum(axis=0)
        c, b, norm = np.log(n.sum(axis=1) / size.sum()), np.zeros(len(used)), np.zeros(len(bins))
        for _ in range(steps):
            rate = size * np.exp(np.clip(c[:, None] + b[:, None] * x - norm, -30, 10))
            g0, g1 = (n - rate).sum(axis=1), ((n - rate) * x).sum(axis=1) - b
            h00, h01, h11 = rate.sum(axis=1) + 1e-3, (rate * x).sum(axis=1), (rate * x * x).sum(axis=1) + 1.0
            det = h00 * h11 - h01**2
            c += np.clip((h11 * g0 - h01 * g1) / det, -1, 1)
            b += np.clip((h00 * g1 - h01 * g0) / det, -1, 1)
            norm = np.log(np.exp(np.clip(c[:, None] + b[:, None] * x, -30, 10)).sum(axis=0))
        self.difficulty = np.zeros(BUCKETS)
        self.difficulty[used] = b
        p = np.exp(np.clip(c[:, None] + b[:, None] * (CURVE - MIDDLE), -30, 10))
        self.expected = (p * b[:, None]).sum(axis=0) / p.sum(axis=0)

    def levels(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The level of each document, ``words`` being cut at ``ends``; every document has a word."""
        mean = np.add.reduceat(self.difficulty[words], ends[:-1]) / np.diff(ends)
        return np.interp(mean, self.expected, CURVE)


def _batch(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy()[at[0] : at[-1]], at - at[0]


def _counts(rows: DataFrame, model, bins: np.ndarray) -> np.ndarray:
    """Words per bucket and level bin: labels where given, else the model's level; summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            words, ends = _batch(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            level = label if model is None else np.where(np.isnan(label), model.value.levels(words, ends), label)
            at = np.abs(np.clip(level, LOWEST, HIGHEST)[:, None] - bins).argmin(axis=1)
            keys, n = np.unique(words.astype(np.int64) * len(bins) + np.repeat(at, np.diff(ends)), return_counts=True)
            for k, v in zip(keys.tolist(), n.tolist()):
                total[k] = total.get(k, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "n"])

    cells = rows.select("words", F.col("level").cast("double")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS * len(bins))
    found = cells.toArrow()
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(BUCKETS, len(bins))


def cuts(theta: np.ndarray, label: np.ndarray) -> list[float]:
    """Between each two levels the cut that misplaces fewest labelled documents, in the middle of its range."""
    out = []
    for k in range(int(LOWEST), int(HIGHEST)):
        below, above = np.sort(theta[label <= k]), np.sort(theta[label > k])
        if not len(below) or not len(above):
            out.append(k + 0.5)
            continue
        at = np.unique(theta)
        mids = (at[1:] + at[:-1]) / 2 if len(at) > 1 else at
        wrong = len(below) - np.searchsorted(below, mids) + np.searchsorted(above, mids)
        best = mids[wrong == wrong.min()]
        widest = max(best, key=lambda m: min(m - at[at < m].max(initial=-9.0), at[at > m].min(initial=99.0) - m))
        out.append(float(widest))
    return list(np.maximum.accumulate(out))


def reading_levels(docs: DataFrame, level_labels: DataFrame, lang: str = "en", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, theta double, level int) of every document of ``lang`` that has prose."""
    spark = docs.sparkSession
    labels = level_labels.where(F.col("reading_level").between(int(LOWEST), int(HIGHEST))).groupBy("doc_id").agg(F.max("reading_level").alias("level"))
    rows = cut_lineage(prose_words(docs, lang).join(labels, "doc_id", "left"))
    marked = rows.where(F.col("level").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = _counts(marked, None, np.arange(LOWEST, HIGHEST + 1))
    if not first.sum():
        return spark.createDataFrame([], f"doc_id {kind}, theta double, level int")
    model = spark.sparkContext.broadcast(Model(first, np.arange(LOWEST, HIGHEST + 1)))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(Model(_counts(rows, model, LEVELS), LEVELS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                theta = model.value.levels(*_batch(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(theta)], names=["doc_id", "theta"])

    levelled = lambda df: df.select("doc_id", "words").mapInArrow(run, f"doc_id {kind}, theta double")
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CUT_SAMPLE)
    known = levelled(sample).join(labels, "doc_id").select("theta", "level").toPandas()
    limits = cuts(known.theta.to_numpy(), known.level.to_numpy())
    level = F.lit(int(LOWEST)) + sum((F.col("theta") > c).cast("int") for c in limits)
    return levelled(rows).withColumn("level", level)


def demanding(docs: DataFrame, level_labels: DataFrame, least: int = 4) -> DataFrame:
    return reading_levels(docs, level_labels).where(F.col("level") >= least).select("doc_id")
