"""Class-conditional Kneser-Ney models: counts and probabilities by hand, held-out accuracy."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import ODD, docs, none
from pyspark.sql import functions as F

from panelweave.llm.hashed_features import logistic
from panelweave.llm import kneser_ney, queries
from panelweave.llm.wordkeys import word_keys

BLANK = re.compile(r"""[\x20\x09-\x0D.,;:!?"'()\[\]{}<>*_~`]+""")


def words_of(text):
    return [w for w in BLANK.split((text or "").lower()) if w]


def by_hand(texts, discounts):
    """P(word | before) per class, from (label, text) rows and dictionaries."""
    runs = {0: set(), 1: set()}
    for label, text in texts:
        found = ["<", "<", *words_of(text)]
        runs[label] |= set(zip(found, found[1:], found[2:]))
    bigrams = [{}, {}]
    for c in (0, 1):
        for _, v, w in runs[c]:
            bigrams[c][v, w] = bigrams[c].get((v, w), 0) + 1
    union = set(bigrams[0]) | set(bigrams[1])
    vocabulary = {w for _, w in union}
    d_word, d_pair = discounts

    def smoothed(counts, backoff, d):
        total = sum(counts.values())
        left = sum(min(d, n) for n in counts.values()) / total if total else 1.0
        return lambda w: max(counts.get(w, 0) - d, 0) / max(total, 1) + left * backoff(w)

    def spread(pairs):
        out = {}
        for _, w in pairs:
            out[w] = out.get(w, 0) + 1
        return out

    shared = smoothed(spread(union), lambda w: 1 / (len(vocabulary) + 1), d_word)

    def model(c):
        alone = smoothed(spread(bigrams[c]), shared, d_word)

        def probability(w, v):
            total = sum(n for (a, _), n in bigrams[c].items() if a == v)
            if not total:
                return alone(w)
            # Bigrams seen once in both classes together go to the backoff altogether.
            held = {
                b: max(n - d_pair, 0)
                for (a, b), n in bigrams[c].items()
                if a == v and sum(one.get((a, b), 0) for one in bigrams) >= 2
            }
            return held.get(w, 0) / total + (1 - sum(held.values()) / total) * alone(w)

        return probability

    return model(0), model(1), vocabulary


TEXTS = [
    (0, "the cat sat on the mat. the cat ran"),
    (0, "a dog and the cat sat, then the dog sat on a mat"),
    (0, "the dog ran and the cat sat on a mat"),
    (1, "you stupid cat you stupid dog and the stupid mat"),
    (1, "the stupid dog, a stupid dog! You sat"),
    (1, "the stupid dog, a stupid dog! You sat"),
]


@pytest.fixture(scope="module")
def counts(spark):
    from panelweave.llm.workers import ship

    ship(spark)
    return kneser_ney._count(spark.createDataFrame(TEXTS, "label int, text string").repartition(3))


@pytest.mark.parametrize("discounts", [(0.75, 0.75), (0.75, 3.0), (1.5, 0.5)])
def test_probabilities_by_hand(counts, discounts):
    ordinary, toxic, vocabulary = by_hand(TEXTS, discounts)
    models = kneser_ney.Models(counts, discounts)
    text = "The stupid cat sat on a strange mat, you dog dog"
    words, before, _ = kneser_ney.tokens(pa.array([text]))
    found = models.difference(words, before)
    hand = words_of(text)
    for at, (v, w) in enumerate(zip(["<", *hand], hand)):
        assert found[at] == pytest.approx(math.log(toxic(w, v) / ordinary(w, v)))
    assert sum(toxic(w, "the") for w in [*vocabulary, "unseen"]) == pytest.approx(1.0)
    assert len(counts.words) == len(vocabulary)


def test_copies_speak_once(spark, counts):
    again = spark.createDataFrame(TEXTS + TEXTS * 3, "label int, text string")
    other = kneser_ney._count(again)
    for name in ("words", "continuation", "shared", "totals", "bigrams", "bigram_counts"):
        assert np.array_equal(getattr(counts, name), getattr(other, name))


def test_evidence_by_hand():
    sizes = [0, 1, 3, 8, 9, 40, 0]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    values = np.random.default_rng(0).normal(size=ends[-1])
    found = kneser_ney.evidence(values, ends)
    for i, n in enumerate(sizes):
        own = values[ends[i] : ends[i + 1]]
        if not n:
            assert found[i].tolist() == [0, 0, 0]
            continue
        top = max(own[a : a + 8].sum() / 8 for a in range(max(1, n - 7)))
        assert found[i] == pytest.approx([own.mean(), top, own.max()])


def test_tokens_are_cut_at_punctuation():
    texts = ["A, b!c", None, "", " ?! ", "d"]
    words, before, ends = kneser_ney.tokens(pa.array(texts))
    keys = word_keys(pa.array(["a b c d"]))[0]
    assert words.tolist() == keys.tolist() and ends.tolist() == [0, 3, 3, 3, 3, 4]
    assert before.tolist() == [int(kneser_ney.OPENING), *keys[:2].tolist(), int(kneser_ney.OPENING)]


def test_toxicity_on_held_out_labels(spark):
    found = queries.QUERIES["op11_kneser_ney"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = found.where("held_out").join(labels, "doc_id").collect()
    caught = [r["predicted"] for r in held if r["toxic"] == 1]
    wrong = [r["predicted"] for r in held if r["toxic"] == 0]
    assert sum(caught) > 0.8 * len(caught) and sum(wrong) < 0.02 * len(wrong)
    assert found.count() == 10_000 and found.where("score < 0 or score > 1 or score is null").count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    judge = kneser_ney.fit_judge(docs_, labels.where(~held))
    wanted = {r["doc_id"]: r["score"] for r in kneser_ney.score_toxicity(docs_, judge).collect()}
    found = queries.QUERIES["op11_kneser_ney"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["score"] for r in found} == wanted


def test_awkward_rows(spark):
    labels = spark.createDataFrame(
        [(5, 0), (6, 1), (6, 1), (7, 0), (7, 1), (8, 0), (9, 1), (None, 1), (10, None)], "doc_id long, toxic int"
    )
    table = docs(spark).withColumn("score", F.lit("mine"))
    judge = kneser_ney.fit_judge(table, labels)
    scored = kneser_ney.score_toxicity(table, judge)
    rows = scored.collect()
    assert len(rows) == table.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert set(scored.columns) == set(table.columns) | {"score", "predicted"}
    by_text = {}
    for row in rows:
        by_text.setdefault(row["text"] or "", set()).add(row["score"])
    assert all(len(one) == 1 for one in by_text.values())
    assert by_text[""] == by_text[ODD[2]]
    assert kneser_ney.score_toxicity(none(spark), judge).count() == 0
    dotted = table.select(F.col("doc_id").alias("doc.id"), F.col("text").alias("full.text"))
    again = kneser_ney.fit_judge(
        dotted, labels.withColumnRenamed("doc_id", "doc.id"), id_col="doc.id", text="full.text"
    )
    found = kneser_ney.score_toxicity(dotted, again, text="full.text").collect()
    assert sorted(r["score"] for r in found) == sorted(r["score"] for r in rows)


def test_one_class_or_none(spark):
    labels = spark.createDataFrame([(5, 1), (6, 1)], "doc_id long, toxic int")
    for chosen, score in ((labels, 1.0), (labels.withColumn("toxic", F.lit(0)), 0.0), (labels.where("false"), 0.0)):
        judge = kneser_ney.fit_judge(docs(spark), chosen)
        assert {r["score"] for r in kneser_ney.score_toxicity(docs(spark), judge).collect()} == {score}


def test_a_narrow_gap_between_the_classes_is_used():
    rng = np.random.default_rng(4)
    found = np.column_stack([rng.normal(size=1000), rng.normal(size=1000), rng.uniform(0, 0.97, size=1000)])
    label = np.repeat([0, 1], [900, 100])
    found[label == 1, 2] = 1.0
    center, scale, weights, _ = kneser_ney._regression(found, label, np.ones(1000))
    p = logistic((found - center) / scale @ weights[:-1] + weights[-1])
    assert ((p >= 0.5) == (label == 1)).all()


def test_copies_are_tuning_texts_together(spark):
    rng = np.random.default_rng(5)
    rows = []
    for doc in range(40):
        words = [f"w{n}" for n in rng.integers(0, 1000, size=300)]
        for copy in range(4):
            rows.append((4 * doc + copy, " ".join([*words, *["end"] * copy])))
    docs = spark.createDataFrame([*rows, (160, None), (161, "")], "doc_id long, text string")
    chosen = docs.selectExpr("doc_id label_key", "cast(doc_id % 2 as int) label")
    texts = kneser_ney._texts(docs, chosen, "doc_id", "text").collect()
    assert len(texts) == 162
    sides = {}
    for row in texts:
        if row["text"]:
            sides.setdefault(row["text"].split(" end")[0], []).append(row["tuning"])
    together = sum(len(set(found)) == 1 for found in sides.values())
    assert together >= 38 and {t for found in sides.values() for t in found} == {True, False}
