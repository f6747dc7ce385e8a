import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import abuse as A

THINGS, VERBS = ["valve", "shaft", "sensor", "membrane", "pump", "gripper", "cell", "rotor"], ["drives", "cools", "seals", "opens", "guides", "monitors"]
RUDE = ["you are a stupid idiot and nobody likes you", "i will break your fingers you idiot", "those people are vermin and must leave"]


def _doc(rnd, rude):
    s = [f"The {rnd.choice(THINGS)} {rnd.choice(VERBS)} the {rnd.choice(THINGS)} at {rnd.randrange(99)} degrees." for _ in range(rnd.randrange(4, 9))]
    if rude:
        s.insert(rnd.randrange(len(s)), rude + "!")
    return " ".join(s)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(7)
    rows, reviews = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, _doc(rnd, rnd.choice(RUDE) if bad else None), f"s{i % 3}", 0.5))
        if i < 240:
            wrong = i % 29 == 0
            reviews.append((i, "r", "insult" if bad != wrong else "clean"))
    reviews += [(399, "r", None), (398, "a", "clean"), (398, "b", "threat"), (None, "a", "clean")]
    rows += [(1000, None, None, 0.5), (1001, "", None, 0.5), (1002, " \n", None, 0.5), (1003, "You are a STUPID i d i o t and nobody likes you", "s0", 0.5), (1003, "x " * 60_000, "s0", 0.5)]
    return spark.createDataFrame(rows, "doc_id int, text string, source string, score double"), spark.createDataFrame(reviews, "doc_id int, reviewer string, verdict string")


def test_held_out_documents(spark, corpus):
    docs, reviews = corpus
    m = A.train(docs, reviews)
    got = {r["doc_id"]: r["toxic"] for r in A.score(docs.where("doc_id between 240 and 399"), m).collect()}
    truth = {i: i % 4 == 0 for i in got}
    hit = sum(got[i] and truth[i] for i in got)
    assert len(got) == 160 and hit / sum(truth.values()) > 0.95 and hit / max(1, sum(got.values())) > 0.95


def test_fitted_documents_have_two_scores(spark, corpus):
    docs, reviews = corpus
    m = A.train(docs, reviews)
    got = {r["doc_id"]: r["score"] for r in A.score(docs.where("doc_id < 240"), m, unseen_only=True).collect()}
    assert len(m.seen) == 240 and got == {k: m.seen[k] for k in got}
    both = {r["doc_id"]: r["score"] for r in A.score(docs.where("doc_id < 240"), m).collect()}
    m.seen = None  # the fitted model itself remembers
    own = {r["doc_id"]: r["score"] for r in A.score(docs.where("doc_id < 240"), m).collect()}
    assert any(own[k] != got[k] for k in own) and both == {k: max(own[k], got[k]) for k in own}


def test_edge_rows(spark, corpus):
    docs, reviews = corpus
    rows = A.score(docs.where("doc_id >= 1000"), A.train(docs, reviews), carry=["source"]).collect()
    assert len(rows) == 5 and all(not r["toxic"] and r["score"] == float("-inf") for r in rows if r["doc_id"] < 1003)
    assert sorted(r["toxic"] for r in rows if r["doc_id"] == 1003) == [False, True]
    assert A.score(docs.limit(0), A.train(docs, reviews)).count() == 0


def test_sample_bound(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word ', id % 50, IF(id < 1600, ' you idiot', ' the valve')) AS text")
    m = A.train(docs, docs.selectExpr("doc_id", "IF(doc_id < 1600, 'insult', 'clean') AS verdict"))
    assert (int(m.held_out[1].sum()), int((~m.held_out[1]).sum())) == (1600, 2400)


def test_no_labels(spark, corpus):
    docs, reviews = corpus
    for r in (reviews.limit(0), reviews.where("verdict = 'clean'"), reviews.where("verdict = 'insult'")):
        assert A.score(docs, A.train(docs, r)).where("toxic").count() == 0


def test_labels(spark, corpus):
    lab = {r["doc_id"]: r["toxic"] for r in A.labels(corpus[1]).collect()}
    assert lab[4] and not lab[1] and 398 not in lab and 399 not in lab and None not in lab


def test_disguises(spark):
    df = spark.createDataFrame([("an I D I O T here",), ("i​di­ot",), ("іdіоt",), ("1diot id1ot",), ("plain Text",), (None,)], "t string")
    assert [r[0] for r in df.select(A.plain(F.col("t"))).collect()] == ["an idiot here", "idiot", "idiot", "1diot idiot", "plain text", ""]


def test_letters_drawn_out(spark):
    df = spark.createDataFrame([("Stuuupid s t u u u p i d",), ("idiiiiiot, bloody",), ("裸裸裸裸",), ("дуууурак",), ("a1000b 2000 ---",)], "t string")
    assert [r[0] for r in df.select(A.plain(F.col("t"))).collect()] == ["stupid stupid", "idiot, bloody", "裸", "дypak", "a1000b 2000 ---"]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    flat = rng.integers(1, 12, 600)
    flat[rng.integers(0, 600, 60)] = 0
    g = A.Grams.of(flat, np.arange(600) == 0)
    shared = A._counted(g.word)
    m = A.KneserNey(g, shared, float(len(g.word)))
    words = shared.keys
    for i in (0, 5, 17, 100):
        p = np.exp(m.log_p(words, np.full(len(words), g.prev[i]), np.full(len(words), g.prev2[i]))).sum()
        unseen = np.exp(m.log_p(np.array([99]), g.prev[i : i + 1], g.prev2[i : i + 1]))[0]
        assert p + unseen == pytest.approx(1.0, abs=1e-9)
    assert A.Grams.of(np.zeros(0, np.int64), np.zeros(0, bool)).word.size == 0
