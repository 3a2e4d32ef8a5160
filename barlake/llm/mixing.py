"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's records fall into blocks by a hash of their id, so a source of any
size gives the same number of blocks. A source's quota is its share of the size
of all its fellow sources' records; it takes whole passes over its blocks, never
more than ``max_repeats``, and of one further pass blocks in a permuted order as far
as the quota reaches. The block in which it is reached is cut between two records,
so the quota is met to within one record. The drawn blocks of all sources are
split among output shards: at each node of a binary tree the two halves' counts per
source are drawn from the multivariate hypergeometric distribution, so every
shard is an exact random sample without any global shuffle; blocks are then
dealt to shards in permuted order and records ordered inside each shard by hash.

What a source gives, its share and whether it falls short are read off the dealt
blocks. Only block sizes come to the driver (sources of the targets times
``BLOCKS``), and of each block that is cut at most ``FEW`` records.

Defined cases: sources are compared without outer white space and in lower case;
records of other or null sources take no part; null or empty texts weigh
nothing, and a source of such texts alone gives nothing; a source without records
reaches share 0; a null or negative target or repeat count is 0; several target
rows of one source count as one, by the largest; records of one id are drawn
together; no targets give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barlake.llm.encode import VOCABULARY, count_tokens
from barlake.session import cut_lineage

BLOCKS, SHARDS, SEED = 1024, 64, 20240401
#: Beyond SHARDS shards of this size there are more of them, as long as each can get a block.
SHARD_TOKENS = 200_000_000
#: Records of a block that are looked at one by one to cut it; larger blocks are first narrowed down by the bits of their lots.
FEW, NARROW_BITS, LOT_BITS = 4096, 10, 63
#: A deal of at most so many blocks is shipped to every task; beyond, it is joined by key.
DEAL_ROWS = 100_000


def _name(c: str):
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _lot() -> Column:
    """A record's place in its block."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED + 1)), 1)


def _block() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(BLOCKS)).cast("int")


def targets_of(mix_targets: DataFrame) -> list[tuple[str, str, float, int]]:
    """(source as given, compared name, share, repeats); one per compared name. A table of the sources, bounded by design."""
    t = mix_targets.where(F.col("source").isNotNull()).select("source", _name("source").alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).cast("long").alias("repeats"))
    best = t.groupBy("name").agg(F.max(F.struct("share", "repeats", "source")).alias("b")).orderBy("name")
    return [(r.b.source, r.name, max(r.b.share, 0.0), max(r.b.repeats, 0)) for r in best.collect()]


def _taking_part(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.withColumn("name", _name("source")).where(F.col("name").isin(names)) if names else docs.withColumn("name", F.lit("")).limit(0)


def sized_records(docs: DataFrame, names: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, name, tokens, block, lot) of the records that take part, each tokenised once."""
    return count_tokens(_taking_part(docs, names), ["doc_id", "name"], vocabulary=vocabulary).withColumns({"block": _block(), "lot": _lot()})


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts per source (columns) for each shard (rows): exact splits of ``counts``, halves of equal size at each node."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    take = int(counts.sum()) * left // shards
    part = rng.multivariate_hypergeometric(counts, take, method="marginals") if counts.sum() else np.zeros_like(counts)
    return np.concatenate([split_tree(part, left, rng), split_tree(counts - part, shards - left, rng)])


def _draw(blocks: dict[int, int], quota: float, repeats: int, rng: np.random.Generator) -> tuple[int, list[int], tuple[int, float] | None]:
    """(whole passes, blocks of one further pass, the block cut in it with what is still wanted of it)."""
    own = sum(blocks.values())
    if not own or quota <= 0:
        return 0, [], None
    passes = int(min(repeats, quota // own))
    got, more = passes * own, []
    if passes < repeats:
        for b in rng.permutation(sorted(b for b, t in blocks.items() if t)):
            if got >= quota:
                break
            if got + blocks[int(b)] > quota:
                return passes, more, (int(b), quota - got)
            more.append(int(b))
            got += blocks[int(b)]
    return passes, more, None


def plan_mixture(
    sizes: dict[str, dict[int, int]],
    targets: list[tuple[str, str, float, int]],
    seed: int = SEED,
    shards: int | None = None,
    cut: Callable[[dict[str, tuple[int, float]]], dict[str, tuple[int, int]]] | None = None,
):
    """What each source gives: report rows, and (name, block, copy, shard, last lot or None) of every dealt block.

    ``cut`` says for blocks to be cut the last lot that belongs to the quota and
    the tokens up to it; without it such blocks are taken whole.
    """
    rng = np.random.default_rng(seed)
    total = sum(sum(v.values()) for v in sizes.values())
    drawn = {name: _draw(sizes.get(name, {}), share * total, repeats, rng) for _, name, share, repeats in targets}
    asked = {name: d[2] for name, d in drawn.items() if d[2]}
    ends = (cut(asked) if cut and asked else {}) | {}
    dealt: list[list[tuple]] = []
    for _, name, _, _ in targets:
        blocks, (passes, more, part) = sizes.get(name, {}), drawn[name]
        mine = [(name, int(b), copy, None, blocks[int(b)]) for copy in range(passes) for b in rng.permutation(sorted(blocks))]
        mine += [(name, b, passes, None, blocks[b]) for b in more]
        if part:
            mine.append((name, part[0], passes, *ends.get(name, (None, blocks[part[0]]))))
        dealt.append(mine)
    counts = np.array([len(d) for d in dealt], dtype=np.int64)
    placed: list[tuple] = []
    given = dict.fromkeys(drawn, 0)
    if counts.sum():
        tokens = sum(x[4] for d in dealt for x in d)
        shards = shards or int(min(max(SHARDS, tokens // SHARD_TOKENS), max(SHARDS, counts.sum())))
        per_shard = split_tree(counts, shards, rng)
        for s, mine in enumerate(dealt):
            shard_of = rng.permutation(np.repeat(np.arange(shards), per_shard[:, s]))
            for (name, block, copy, last, size), shard in zip(mine, shard_of):
                placed.append((name, block, copy, int(shard), last))
                given[name] += size
    reached = sum(given.values())
    report = []
    for source, name, share, repeats in targets:
        passes, more, part = drawn[name]
        got = given[name]
        report.append((source, name, share, sum(sizes.get(name, {}).values()), repeats, passes + bool(more or part), got, got < share * total, got / reached if reached else 0.0))
    return report, placed


def _sizes(records: DataFrame) -> tuple[dict[str, dict[int, int]], dict[tuple[str, int], int]]:
    """Tokens per source and block, and how many records each block has."""
    sizes: dict[str, dict[int, int]] = {}
    many: dict[tuple[str, int], int] = {}
    for r in records.groupBy("name", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        sizes.setdefault(r.name, {})[r.block] = r.t
        many[r.name, r.block] = r.n
    return sizes, many


def _cutter(records: DataFrame, many: dict[tuple[str, int], int]):
    """Finds the lots at which blocks are cut: histograms over the bits of the lots narrow each down until few records are left."""

    def cut(asked: dict[str, tuple[int, float]]) -> dict[str, tuple[int, int]]:
        at = {name: [block, 0, LOT_BITS, wanted, 0, many[name, block]] for name, (block, wanted) in asked.items()}

        def inside(names) -> Column:
            cond = F.lit(False)
            for name in names:
                block, low, bits, *_ = at[name]
                cond = cond | ((F.col("name") == name) & (F.col("block") == block) & F.col("lot").between(low, low + (1 << bits) - 1))
            return cond

        while wide := [n for n, x in at.items() if x[5] > FEW and x[2] > 0]:
            step = {n: max(at[n][2] - NARROW_BITS, 0) for n in wide}
            part = F.lit(0).cast("long")
            for n in wide:
                part = F.when(F.col("name") == n, F.shiftright("lot", step[n])).otherwise(part)
            found: dict[str, list] = {}
            for r in records.where(inside(wide)).groupBy("name", part.alias("p")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():
                found.setdefault(r.name, []).append((r.p, r.t, r.n))
            for n in wide:
                for p, t, k in sorted(found[n]):
                    if at[n][4] + t >= at[n][3]:
                        at[n][1], at[n][2], at[n][5] = p << step[n], step[n], k
                        break
                    at[n][4] += t
        out: dict[str, tuple[int, int]] = {}
        lots: dict[str, dict[int, int]] = {}
        for r in records.where(inside(at)).groupBy("name", "lot").agg(F.sum("tokens").alias("t")).collect():
            lots.setdefault(r.name, {})[r.lot] = r.t
        for n, x in at.items():
            got = x[4]
            for lot in sorted(lots[n]):
                got += lots[n][lot]
                if got >= x[3]:
                    break
            out[n] = (lot, got)
        return out

    return cut


REPORT = "source string, name string, target_share double, source_tokens long, max_repeats long, passes int, drawn_tokens long, short boolean, actual_share double"
DEAL = pa.schema([("name", pa.string()), ("block", pa.int32()), ("copy", pa.int32()), ("shard", pa.int32()), ("last_lot", pa.int64())])


def _planned(docs: DataFrame, mix_targets: DataFrame, vocabulary: str):
    targets = targets_of(mix_targets)
    records = cut_lineage(sized_records(docs, [t[1] for t in targets], vocabulary))
    sizes, many = _sizes(records)
    return targets, records, *plan_mixture(sizes, targets, cut=_cutter(records, many))


def mixture_report(docs: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source of the targets: what it has, what its dealt blocks give, the share it reaches, and whether it falls short at its cap."""
    _, _, report, _ = _planned(docs, mix_targets, vocabulary)
    return docs.sparkSession.createDataFrame(report, REPORT)


def mixture(docs: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY, texts: bool = False) -> DataFrame:
    """(shard, place, doc_id, name, copy, tokens): the mixture, in order within each shard; with ``texts`` the records' text in place of tokens.

    Texts are taken where they lie, by the hash of their id; they are shuffled once, by shard.
    """
    targets, records, _, placed = _planned(docs, mix_targets, vocabulary)
    deal = docs.sparkSession.createDataFrame(pa.Table.from_arrays([pa.array([p[i] for p in placed], f.type) for i, f in enumerate(DEAL)], schema=DEAL))
    what = "text" if texts else "tokens"
    if texts:
        records = _taking_part(docs, [t[1] for t in targets]).select("doc_id", "name", "text", _block().alias("block"), _lot().alias("lot"))
    dealt = records.join(F.broadcast(deal) if len(placed) <= DEAL_ROWS else deal, ["name", "block"]).where("last_lot IS NULL OR lot <= last_lot")
    place = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("shard", "doc_id", "copy", F.lit(SEED)), "doc_id", "copy"))
    return dealt.select("shard", place.alias("place"), "doc_id", "name", "copy", what)


def short_sources(docs: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return mixture_report(docs, mix_targets, vocabulary).where("short").select("source")
