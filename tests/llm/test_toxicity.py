"""Toxicity learns from every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import toxicity


def test_rows_behind_the_first_thousands_are_learned(spark):
    """3,000 rows a label; the last 400 toxic ones in hash order alone hold another bad word."""
    ids = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    order = [r[0] for r in ids.where("toxic = 1").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").collect()]
    late = set(order[-400:])
    rng = np.random.default_rng(7)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(6000):
        bad = [] if i % 2 == 0 else ["grudzek"] if i in late else ["vilexon"]
        rows.append((i, " ".join([*rng.choice(words, 6), *bad, *rng.choice(words, 6)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.fit(docs, ids)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, net).collect()}
    assert np.mean([got[i] for i in late]) > 0.95
    assert np.mean([got[i] for i in range(0, 6000, 2)]) < 0.05


def test_gradient_of_a_batch_equals_differences():
    """Adam's first moment after a step, times 10, against differences of the loss written out text by text."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, toxicity.BUCKETS, (1 + len(toxicity.PREFIXES), n)).astype(np.uint16) for n in (5, 1, 0, 9)]
    labels = np.array([1, 0, 0, 1])

    class Keep:  # no maxima are dropped: 1 after the division by 0.8
        def random(self, shape):
            return np.zeros(shape)

    def loss(net):
        net.fold()
        f, first = np.concatenate(texts, axis=1), np.cumsum([0, *(x.shape[1] for x in texts)])
        z = (net.maxima(f, first).astype(float) / 0.8) @ net.out.astype(float) + net.out_bias
        weight = np.where(labels > 0, 0.5 / 2, 0.5 / 2) * 4
        return float(np.mean(weight * np.logaddexp(0, np.where(labels > 0, -z, z))))

    learner = toxicity.Learner((2, 2))
    learner.batch(texts, labels, Keep())
    for k, at in ((0, (0, 3, 2)), (1, (1, 5, 0)), (2, (2, 0, 7)), (2, (0, 11, 1))):
        up, down = toxicity.Learner((2, 2)).net, toxicity.Learner((2, 2)).net
        up.filters[k][at] += 1e-2
        down.filters[k][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - 10 * learner.m1[k][at]) < 2e-4


def test_thresholds_come_from_all_bins():
    assert toxicity._best([(512, 10, 10), (0, 5, 0), (-256, 10, 0)]) == (512 / 256 + 1 / 256) / 2
    assert toxicity._best([(256, 4, 0), (0, 10, 10)]) == (0 + -1) / 2


def test_rounds_do_not_depend_on_tasks(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} " + ("bad" if i % 3 == 0 else "good")) for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    rows = toxicity.learned(docs, toxicity.known_labels(labels), 5).cache()
    assert rows.count() == 300 and rows.select("shard").distinct().count() == 5
    nets = []
    for some in (rows, rows.coalesce(1)):
        learner = toxicity.Learner((200, 100))
        toxicity.epoch(some, learner, 0)
        nets.append(learner)
    rows.unpersist()
    assert (nets[0].words() == nets[1].words()).all() and (nets[0].dense() == nets[1].dense()).all()
