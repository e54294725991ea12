"""Cached providers, summaries and knowledge look-ups against plain versions."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import alerts, cached, summaries


def test_a_text_goes_to_its_provider_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)
    passes = []

    def ask(texts):
        passes.append(1)

        def run(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b

        return texts.mapInArrow(run, texts.schema).select("hash", F.length("text").alias("result"))

    rows = [(1, "one"), (2, "three"), (3, "one"), (4, None), (5, ""), (1, "one")]
    docs = spark.createDataFrame(rows, "result long, body string").repartition(3)
    run = lambda df, version="1": sorted(map(tuple, cached.with_results(df, "body", ask, "int", str(tmp_path), "len", version, "n").select("result", "body", "n").collect()), key=str)
    want = sorted(((i, t, None if t is None else len(t)) for i, t in rows), key=str)
    assert run(docs) == want and asked.value == 3
    assert run(docs) == want and asked.value == 3 and len(passes) == 1  # a second run asks nothing
    more = docs.unionByName(spark.createDataFrame([(9, "four"), (8, "three")], docs.schema))
    assert len(run(more)) == 8 and asked.value == 4 and len(passes) == 2
    assert run(docs, "2") == want and asked.value == 7 and cached.versions(spark, str(tmp_path), "len") == ["1", "2"]
    assert run(docs.limit(0)) == [] and asked.value == 7
    os.remove(tmp_path / "len/version=2/_SUCCESS")  # what was not committed does not count
    assert run(docs, "2") == want and asked.value == 10


def plain_summary(text, k):
    """All pairs of sentences as a matrix."""
    some = summaries.sentences(text)
    if len(some) <= k:
        return some
    words = [summaries.WORD.findall(s.lower()) for s in some]
    vocabulary = sorted({w for x in words for w in x})
    a = np.array([[x.count(w) for w in vocabulary] for x in words], float)
    a *= np.log(1 + len(some) / (a > 0).sum(0))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    s = a @ a.T
    np.fill_diagonal(s, 0)
    total = s.sum(1)
    walk = np.where(total[:, None] > 1e-9, s / np.maximum(total[:, None], 1e-300), 1 / len(some))
    at = np.full(len(some), 1 / len(some))
    for _ in range(summaries.STEPS):
        at = (1 - summaries.DAMPING) / len(some) + summaries.DAMPING * at @ walk
    order = sorted(range(len(some)), key=lambda i: (-round(at[i] * len(some), 9), i))
    return [some[i] for i in sorted(order[:k])]


def test_summaries_equal_the_matrix(spark, sf):
    from quillspark.plans import catalog

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["summary"] for r in catalog.summary_sentences(spark, sf).collect()}
    short = [i for i, t in texts.items() if len(summaries.sentences(t or "")) < 250]
    assert len(short) > 100 and set(got) == set(texts)
    assert all(got[i] == "\n".join(plain_summary(texts[i], 3)) for i in short)


def test_summary_cases(spark):
    about = "The harbour bridge closed. Engineers closed the harbour bridge after cracks. Cats sleep. The bridge reopens when engineers mend the cracks. Rain fell."
    assert summaries.summary(about, 3) == plain_summary(about, 3) == [s for s in summaries.sentences(about) if "bridge" in s]
    assert summaries.summary("Aa bb. Cc dd. Ee ff. Gg hh.", 2) == ["Aa bb.", "Cc dd."]  # nothing shared: the first ones
    assert summaries.summary("Same here. Same here. Other.", 5) == ["Same here.", "Other."]
    rng = random.Random(1)
    long = " ".join(" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(8)) + "." for _ in range(40_000))
    assert len(summaries.summary(long, 3)) == 3
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "... !", "x"), (4, "One. Two", "x")], "n long, text string, summary string")
    got = {r["n"]: r["summary"] for r in summaries.with_summary(rows).collect()}
    assert got == {1: None, 2: [], 3: [], 4: ["One.", "Two"]}


def test_knowledge_of_many_services(spark):
    """Twenty services and more, names inside words, ties, and a service that most titles name."""
    services = [f"svc-{i}" for i in range(20)] + ["api", "x", "missing", None]
    rng = random.Random(2)
    titles = [(rng.randrange(100), f"About {rng.choice(['SVC-', 'svc-', 'rapid', 'X', 'api'])}{rng.randrange(25)} and svc-3") for _ in range(400)] + [(1, None), (2, "")]
    queries = spark.createDataFrame([(i, s) for i, s in enumerate(services * 2)], "id long, service string")
    got = {r["id"]: r["knowledge"] for r in alerts.external_knowledge(queries, spark.createDataFrame(titles, "ord long, title string").repartition(4)).collect()}
    for i, s in enumerate(services * 2):
        hits = sorted((o, t) for o, t in titles if s and t and s in t.lower())[:3]
        assert got[i] == ("\n".join(t for _, t in hits) if hits else None)
