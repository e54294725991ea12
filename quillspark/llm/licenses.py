"""Licence scan by ordered signature rules, in DataFrame functions alone.

Base: places where the words of a fixed phrase stand one after another.  Method: rules (see
license_rules) gated by keywords: a text goes on only if it holds some keyword, and meets only the rules
whose own keyword it holds.  A detection is an interval of the text; it is suppressed if another one of
the same or a stronger priority contains it (equal intervals: the stronger priority, then the earlier
rule stays).  Containment is decided by one sorted pass over a document's detections.

Defined cases: null and empty texts have no words and labels ''; ties in suppression go by rule order;
rows that repeat an id, null ids among them, are told apart by their texts, and equal rows give equal results
each; ids may be of any type; texts are matched whole; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.license_rules import rules
from quillspark.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = rf"[^{GAP}]+"
# The phrases and labels of the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_WEIGHT = 0.9
PRIORITIES = (1, 2, 3, 4)


def phrase_regex(phrase: str) -> str:
    return rf"(?<![^{GAP}])" + rf"[{GAP}]+".join(phrase.split()) + rf"(?![^{GAP}])"


def _single_spaced(column: str) -> F.Column:
    """White space as keywords have it, where rules take any run of it."""
    return F.regexp_replace(column, r"\s+", " ")


def _holds_any(column: str, keywords) -> F.Column:
    return reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(k)) for k in sorted(keywords)])


def base_scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (text hash), n_words, n_base, first_word, last_word, base (labels), t (gated text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER).alias("t"))
    words = lambda c: F.regexp_count(c, F.lit(WORD))
    rows = rows.withColumn("n_words", words(F.col("t")).cast("long")).withColumn("g", _single_spaced("t"))
    n, firsts, lasts, labels = [], [], [], []
    for i, (phrase, label) in enumerate(PHRASES):
        parts = phrase.split()
        gate = reduce(lambda a, b: a & b, [F.contains(F.col("t"), F.lit(p)) for p in parts])
        rows = rows.withColumn(f"p{i}", F.when(gate, F.split("t", phrase_regex(phrase), -1)))
        found = F.size(f"p{i}") > 1
        n.append(F.when(found, F.size(f"p{i}") - 1).otherwise(0))
        firsts.append(F.when(found, words(F.element_at(f"p{i}", 1)).cast("long")))
        lasts.append(F.when(found, F.col("n_words") - words(F.element_at(f"p{i}", -1)) - len(parts)))
        labels.append(F.when(found, F.lit(label)))
    keywords = {k for r in rules() for k in r[4].split(";")}
    return rows.select(
        "doc_id", F.xxhash64("t").alias("th"), "n_words", sum(n).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"), F.when(_holds_any("g", keywords), F.col("t")).alias("t"),
    )


def detections(gated: DataFrame) -> DataFrame:
    """(doc_id, th, rule, label, priority, weight, start, end) of gated texts, before suppression."""
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(w).alias("weight"), F.array(*map(F.lit, k.split(";"))).alias("keywords"), F.lit(x).alias("regex")) for i, label, p, w, k, x in rules()])
    spark = gated.sparkSession
    named = spark.range(1).select(table.alias("rules"))  # one row of fixed size
    with_rules = gated.withColumn("g", _single_spaced("t")).join(F.broadcast(named)).select("doc_id", "th", "t", F.explode(F.expr("filter(rules, r -> exists(r.keywords, k -> contains(g, k)))")).alias("r"))
    hit = with_rules.where(F.expr("t rlike r.regex"))
    hit = hit.select("doc_id", "th", "r.rule", "r.label", "r.priority", "r.weight", F.expr("transform(split(t, r.regex, -1), x -> length(x))").alias("gaps"), F.expr("transform(regexp_extract_all(t, r.regex, 0), x -> length(x))").alias("runs"))
    each = hit.select("doc_id", "th", "rule", "label", "priority", "weight", F.posexplode(F.arrays_zip("gaps", "runs")).alias("k", "x")).where("x.runs is not null")
    upto = Window.partitionBy("doc_id", "th", "rule").orderBy("k")
    end = F.sum(F.col("x.gaps") + F.col("x.runs")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    each = each.dropDuplicates(["doc_id", "th", "rule", "k"]).withColumn("end", end)
    return each.select("doc_id", "th", "rule", "label", "priority", "weight", (F.col("end") - F.col("x.runs")).alias("start"), "end")


def unsuppressed(found: DataFrame) -> DataFrame:
    """The detections that no other of the same or a stronger priority contains."""
    before = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    cover = reduce(lambda rest, p: F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before)).otherwise(rest), PRIORITIES, F.lit(None).cast("long"))
    return found.withColumn("cover", cover).where("cover is null or cover < end").drop("cover")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and places of base phrases, labels and a score."""
    rows, _ = written(base_scan(docs, id_col, text_col), "licences")
    kept = unsuppressed(detections(rows.where("t is not null").select("doc_id", "th", "t")))
    more = kept.groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n_found"))
    more = more.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    out = rows.drop("t").join(more, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    text = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.col("n_base") > 0, BASE_WEIGHT).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(F.concat("base", F.coalesce("more", none))).alias("labels"), weight.alias("score"), F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Contract query: base phrases and licence labels of each document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
