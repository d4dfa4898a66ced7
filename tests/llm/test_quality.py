from __future__ import annotations

import random
import re

import numpy as np
from edges import TEXTS, documents, no_documents

from quittance.llm import quality_trees as q
from quittance.llm.document_stats import COUNTS, FEATURES, statistics
from quittance.llm.queries import QUERIES, quality_model, table

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            again |= set(range(i, i + 5))
    lines, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)]


def test_counts():
    random.seed(1)
    texts = [t for _, t in TEXTS if t is None or len(t) < 500] + ["#|\n \n", "a b c d e\na b c d e f", "é\x1cé \xa0x"]
    for n in range(60):
        texts.append("".join(random.choice(["a", "b", "a b c d e ", " ", "\n", "É#", "\t"]) for _ in range(n)))
    for t in texts:
        assert statistics(t)[: len(COUNTS)] == brute_counts(t), t
        assert len(statistics(t)) == len(FEATURES)


def labelled(spark, n=400):
    """Features and labels of the smallest tables."""
    return q.labelled_statistics(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"), n)


def test_scores_are_monotonic_where_asked(spark):
    trees = q.fit(*labelled(spark))
    rows = labelled(spark)[0]
    for name, sign in q.MONOTONIC.items():
        at, last = q.JUDGED.index(name), None
        for value in np.linspace(0, 3, 60):
            moved = rows.copy()
            moved[:, at] = value
            score = trees.log_odds(moved)
            if last is not None:
                assert (sign * (score - last) >= -1e-9).all(), name
            last = score


def test_held_out_accuracy(spark):
    rows, good = q.labelled_statistics(
        table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    )
    even = np.arange(len(good)) % 2 == 0
    trees = q.fit(rows[even], good[even])
    judged = trees.probability(rows[~even]) >= 0.5
    assert (judged == good[~even]).mean() > 0.95
    assert judged[good[~even] == 1].mean() > 0.98


def test_flat_trees_score_like_a_walk(spark):
    rows, good = labelled(spark)
    trees = q.fit(rows, good, rounds=5)
    for row, score in zip(rows[:30], trees.log_odds(rows[:30]), strict=True):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                low = row[trees.feature[at]] <= trees.threshold[at]
                at = trees.left[at] if low else trees.right[at]
            total += trees.value[at]
        assert abs(total - score) < 1e-9


def test_training_sample_is_bounded_and_stable(spark):
    rows, good = labelled(spark, 30)
    again, _ = labelled(spark, 30)
    assert len(rows) == len(good) == 30 and (rows == again).all()


def test_ids_that_repeat_do_not_stretch_the_sample(spark):
    docs = spark.range(3000).selectExpr("id % 60 AS doc_id", "concat('some words of text ', id) AS text")
    labels = spark.range(3000).selectExpr("id % 60 AS doc_id", "id % 2 AS quality")
    rows, good = q.labelled_statistics(docs, labels, most_rows=10)
    assert len(rows) == len(good) == 10
    again, same = q.labelled_statistics(docs.repartition(7), labels.repartition(3), most_rows=10)
    assert (rows == again).all() and (good == same).all()
    assert len(q.labelled_statistics(docs, labels, most_rows=59)[0]) == 59
    assert len(q.labelled_statistics(docs, labels, most_rows=100)[0]) == 60


def test_without_labels_the_base_rules_decide(spark):
    labels = table(spark, SF_DIR, "labels").where("false")
    trees = q.fit(*q.labelled_statistics(documents(spark), labels))
    rows = q.quality_rules(documents(spark), trees).collect()
    assert len(rows) == len(TEXTS)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    failed = {str(r["doc_id"]): r["base_failed"] for r in rows}
    assert failed["3"] and failed["4"] and failed["5"] and not failed["1"]
    assert q.quality_rules(no_documents(spark), trees).count() == 0
    df = documents(spark)
    kept = q.keep_good(df, trees)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["kept"] for r in rows)
    assert q.keep_good(no_documents(spark), trees).count() == 0


def test_odd_labels(spark):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (None, 1), (2, None), (99, 0), (8, 1)], "doc_id bigint, quality int"
    )
    rows, good = q.labelled_statistics(documents(spark), labels)
    assert len(rows) == 2 and sorted(good) == [0, 1]  # one for each id that has a label and a text
    only = labels.where("quality = 1")
    assert q.fit(*q.labelled_statistics(documents(spark), only)).probability(rows).min() > 0.9


def test_query(spark):
    rows = table(spark, SF_DIR, "documents").collect()
    got = {r["doc_id"]: r for r in QUERIES["op9_quality"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    trees = quality_model(spark, SF_DIR)
    for r in rows:
        g, counts = got[r["doc_id"]], brute_counts(r["text"])
        assert [g[c] for c in COUNTS] == counts
        assert g["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        judged = np.array([statistics(r["text"])])[:, [FEATURES.index(f) for f in q.JUDGED]]
        assert g["kept"] == (not g["base_failed"] and trees.probability(judged)[0] >= 0.5)
