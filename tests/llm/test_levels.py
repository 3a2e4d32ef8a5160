import random

import numpy as np

from barlake.llm.levels import cuts, demanding, prose_words, reading_levels

CELL = "struct<cell_no:int,cell_type:string,execution_count:int,start_char:int,n_chars:int>"
DOCS = f"doc_id long, text string, lang string, cells array<{CELL}>, words string, level int, theta string"
LABELS = "doc_id long, reading_level int, lang string"
EASY, HARD = [f"cat{chr(97 + i)}" for i in range(26)], [f"stochastic{chr(97 + i)}" for i in range(26)]


def doc(i, level, r, lang="en", noise=""):
    words = [r.choice(HARD if r.random() < (level - 0.5) / 5 else EASY) for _ in range(r.randint(150, 260))]
    code = " ".join(r.choice(HARD) for _ in range(80))
    text = "é🎉 " + " ".join(words) + noise
    return (i, text + code, lang, [(0, "text", None, 0, len(text)), (1, "code", 1, len(text), len(code))], "x", 9, "y")


def corpus(n=400):
    r = random.Random(6)
    level = {i: 1 + i % 5 for i in range(n)}
    rows = [doc(i, level[i], r, noise=" " + "Qz9/" * 900 if i % 9 == 0 else "") for i in range(n)]
    return rows, level


def test_held_out_levels(spark):
    rows, level = corpus()
    labels = [(i, level[i], "x") for i in level if i % 2] + [(10**6, 3, "x"), (None, 3, "x"), (0, None, "x"), (2, 99, "x")]
    df, lb = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in reading_levels(df, lb).collect()}
    held = [i for i in level if i % 2 == 0]
    assert len(got) == len(rows)
    assert np.mean([got[i].level == level[i] for i in held]) > 0.9
    assert np.corrcoef([got[i].theta for i in held], [level[i] for i in held])[0, 1] > 0.97
    found = {r.doc_id for r in demanding(df, lb).collect()}
    assert np.mean([(i in found) == (level[i] >= 4) for i in held]) > 0.96


def test_only_prose_of_the_language_counts(spark):
    r = random.Random(1)
    good = doc(1, 1, r)
    rows = [good, doc(2, 1, r, lang="de"), doc(3, 1, r, lang=None), (4, None, "en", None, "x", 1, "y"), (5, "", "en", [], "x", 1, "y"), (6, "abc def", "en", None, "x", 1, "y"), (7, "123 --", "en", [(0, "text", None, 0, 6)], "x", 1, "y")]
    rows += [(8, "abc def", "en", [(0, "text", None, 4, 999), None, (1, None, None, 0, 3), (2, "text", None, None, 3), (3, "text", None, 0, None)], "x", 1, "y"), (9, "abc", "en", [(0, "code", None, 0, 3)], "x", 1, "y"), good]
    out = prose_words(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(x.doc_id for x in out) == [1, 1, 8]
    assert [len(x.words) for x in out if x.doc_id == 8] == [1]


def test_without_labels_or_documents(spark):
    rows, level = corpus(20)
    df, lb = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, level[i], "x") for i in level], LABELS)
    assert reading_levels(df, lb.limit(0)).count() == 0
    assert reading_levels(df.limit(0), lb).count() == demanding(df.limit(0), lb).count() == 0
    assert reading_levels(df, lb.where("reading_level = 3")).count() == 20


def test_cuts_lie_between_levels():
    theta = np.array([1.0, 1.2, 2.0, 2.2, 3.0, 4.5, 4.6, 5.0])
    label = np.array([1, 1, 2, 2, 3, 4, 4, 5])
    assert np.allclose(cuts(theta, label), [1.6, 2.6, 3.75, 4.8])
    assert cuts(np.array([1.0]), np.array([3])) == [1.5, 2.5, 3.5, 4.5]
