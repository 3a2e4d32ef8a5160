import numpy as np
import pytest

from barlake.llm.encode import count_tokens
from barlake.llm.mixing import mixture, mixture_report, plan_mixture, short_sources, split_tree

DOCS = "doc_id long, text string, source string, name string, block int, tokens string, shard int"
TARGETS = "source string, target_share double, max_repeats int, short string"


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for source, n in (("Big", 400), (" small ", 10), ("mid\t", 60), ("other", 50), (None, 20)):
        for _ in range(n):
            rows.append((i, f"a row of words number {i} " * (1 + i % 4), source, "x", 1, "y", 2))
            i += 1
    rows += [(i, None, "big", "x", 1, "y", 2), (None, "", "mid", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1, "x"), ("Small ", 0.2, 3, "x"), ("mid", 0.3, 8, "x"), ("gone", 0.0, 2, "x"), (None, 0.4, 1, "x")], TARGETS)


def test_report_and_shortage(docs, targets):
    sizes = {}
    for r in count_tokens(docs, ["source"]).collect():
        key = (r.source or "").strip().lower()
        sizes[key] = sizes.get(key, 0) + r.tokens
    total = sizes["big"] + sizes["small"] + sizes["mid"]
    report = {r.source: r for r in mixture_report(docs, targets).collect()}
    assert set(report) == {"big", "Small ", "mid", "gone"}
    for name, share, repeats in (("big", 0.5, 1), ("Small ", 0.2, 3), ("mid", 0.3, 8)):
        own = sizes[name.strip().lower()]
        assert report[name].source_tokens == own and report[name].short == (repeats * own < share * total)
        assert report[name].drawn_tokens <= repeats * own and report[name].passes <= repeats
    assert [r.source for r in short_sources(docs, targets).collect()] == ["Small "]
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert abs(report["big"].drawn_tokens - 0.5 * total) < 0.03 * total


def test_mixture_is_what_the_report_says(docs, targets):
    rows = mixture(docs, targets).collect()
    report = {r.name: r for r in mixture_report(docs, targets).collect()}
    for name, r in report.items():
        mine = [x for x in rows if x.name == name]
        assert sum(x.tokens for x in mine) == r.drawn_tokens
        assert len({(x.doc_id, x.copy) for x in mine}) == len(mine)
        assert max((x.copy for x in mine), default=-1) < max(r.max_repeats, 1)
    places = {}
    for x in rows:
        places.setdefault(x.shard, []).append(x.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixture(docs, targets).collect()))


def test_split_tree_is_exact_and_hypergeometric():
    rng = np.random.default_rng(3)
    counts = np.array([1000, 37, 0, 5])
    out = split_tree(counts, 7, rng)
    assert (out.sum(axis=0) == counts).all() and out.shape == (7, 4) and (out >= 0).all()
    assert np.ptp(out.sum(axis=1)) <= 7
    draws = np.array([split_tree(np.array([30, 10]), 2, rng)[0, 1] for _ in range(4000)])
    assert abs(draws.mean() - 5) < 0.1 and abs(draws.var() - 20 * 0.25 * 0.75 * 20 / 39) < 0.2


def test_plan_repeats_blocks_no_more_than_allowed():
    sizes = {"a": {0: 10, 1: 10}, "b": {0: 1}}
    report, placed = plan_mixture(sizes, [("A", "a", 0.5, 1), ("B", "b", 0.5, 4)], shards=2)
    assert [r[7] for r in report] == [False, True] and sum(p[0] == "b" for p in placed) == 4
    assert {p[2] for p in placed if p[0] == "b"} == {0, 1, 2, 3}


def test_empty(spark, docs, targets):
    assert mixture_report(docs.limit(0), targets).where("drawn_tokens > 0 OR short").count() == 0
    assert mixture_report(docs, targets.limit(0)).count() == mixture(docs.limit(0), targets).count() == 0


def test_quotas_are_met_to_within_one_record(docs, targets):
    rows = mixture(docs, targets).collect()
    report = {r.name: r for r in mixture_report(docs, targets).collect()}
    total = sum(r.source_tokens for r in report.values())
    for name, share in (("big", 0.5), ("mid", 0.3)):
        largest = max(x.tokens for x in rows if x.name == name)
        assert 0 <= report[name].drawn_tokens - share * total < largest
    texts = mixture(docs, targets, texts=True)
    assert texts.columns == ["shard", "place", "doc_id", "name", "copy", "text"]
    key = lambda x: (x.shard, x.place, str(x.doc_id), x.copy)
    assert sorted(map(key, texts.collect())) == sorted(map(key, rows))


def test_blocks_are_narrowed_down_before_they_are_cut(docs, targets, monkeypatch):
    from barlake.llm import mixing

    whole = sorted(map(tuple, mixture_report(docs, targets).collect()))
    monkeypatch.setattr(mixing, "FEW", 1)
    monkeypatch.setattr(mixing, "BLOCKS", 2)
    few = {r.name: r for r in mixture_report(docs, targets).collect()}
    assert {r[1] for r in whole} == set(few)
    total = sum(r.source_tokens for r in few.values())
    assert 0 <= few["big"].drawn_tokens - 0.5 * total < 60 and 0 <= few["mid"].drawn_tokens - 0.3 * total < 60


def test_a_source_of_empty_texts_ends(spark):
    df = spark.createDataFrame([(i, "", "hollow", "x", 1, "y", 2) for i in range(50)] + [(99, "some words here", "full", "x", 1, "y", 2)], DOCS)
    t = spark.createDataFrame([("hollow", 0.5, 10**6, "x"), ("full", 0.5, 1, "x")], TARGETS)
    report = {r.name: r for r in mixture_report(df, t).collect()}
    assert report["hollow"].drawn_tokens == 0 == report["hollow"].passes and report["hollow"].short and not report["full"].short
    assert {x.name for x in mixture(df, t).collect()} == {"full"}


def test_large_deals_are_joined_by_key(docs, targets, monkeypatch):
    from barlake.llm import mixing

    shipped = sorted(map(str, mixture(docs, targets).collect()))
    monkeypatch.setattr(mixing, "DEAL_ROWS", 0)
    assert sorted(map(str, mixture(docs, targets).collect())) == shipped
