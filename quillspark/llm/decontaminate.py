"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions alone.

A benchmark item is held to be inside a document if at least `percent` of its distinct word shingles
stand in it.  Documents are long and items short, so their Jaccard similarity says nothing; what is
sketched are the items.  Items are partitioned by size (powers of two); an item of a partition with
upper size u keeps its k(u) smallest hash values.  A document that contains the item holds one of them,
unless all k fall in the missing part: impossible for k > (1 - t) u, and of probability (1 - t)^k
otherwise, so k(u) = floor((1 - t) u) + 1; a caller who wants a smaller sketch of large items may bound k by
`most` and accept that chance.  Every shingle of every document probes the sketch
of its partition; candidates are then verified on all shingles of both sides, compared as words.

The sketch is broadcast only while it has at most BROADCAST_ROWS rows; beyond, the probe is a shuffled
join.  Nothing pairs all documents with all items.

Defined cases: items with fewer words than a shingle have all their words as one shingle, looked up
among the documents' runs of that many words; items and documents without words match nothing; rows
that share a doc_id (or item_id), null too, count as one document (or item); documents are read whole; extra
columns are not read.  `drop_leaks` numbers rows first, so that each row stays or goes by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.licenses import LOWER, UPPER
from quillspark.llm.shared import identified, written

WIDTH = 5
PERCENT = 75
BROADCAST_ROWS = 200_000


def _words(column: str) -> F.Column:
    lowered = F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), "")


def _runs(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, h, w): each run of `width` words of rows (key, words), with its hash."""
    names = [f"w{i}" for i in range(width)]
    shifted = [F.col("words").alias("w0"), *[F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))).alias(f"w{i}") for i in range(1, width)]]
    each = rows.select(key, *shifted).select(key, F.explode(F.arrays_zip(*names)).alias("x")).where(F.col(f"x.w{width - 1}").isNotNull())
    return each.select(key, F.xxhash64(*[f"x.{n}" for n in names]).alias("h"), F.struct(*[f"x.{n}" for n in names]).alias("w"))


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, width, h, w, n): distinct shingles and their number; w are the words, joined."""
    rows = items.select(F.col(id_col).alias("item_id"), _words(text_col).alias("words")).withColumn("width", F.least(F.lit(WIDTH), F.size("words"))).where("width > 0")
    parts = []
    for width in range(1, WIDTH + 1):
        runs = _runs(rows.where(F.col("width") == width), "item_id", width)
        parts.append(runs.select("item_id", F.lit(width).alias("width"), "h", F.array_join(F.array(*[F.col(f"w.w{i}") for i in range(width)]), " ").alias("w")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id", "width")))


def sketch(shingles: DataFrame, percent: int = PERCENT, most: int | None = None) -> DataFrame:
    """(item_id, width, h, part): the smallest hash values of each item, as many as its partition asks."""
    part = F.ceil(F.log2(F.col("n"))).cast("int")
    upper = F.pow(F.lit(2.0), part)
    k = F.floor(upper * (100 - percent) / 100) + 1
    k = k if most is None else F.least(F.lit(most), k)
    order = Window.partitionBy("item_id", "width").orderBy(F.xxhash64(F.lit(31), "h"), "h")
    return shingles.select("item_id", "width", "h", part.alias("part"), k.alias("k"), F.row_number().over(order).alias("r")).where("r <= k").select("item_id", "width", "h", "part")


def find_leaks(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", percent: int = PERCENT, most: int | None = None) -> DataFrame:
    """(doc_id, item_id, n_item, n_hit, containment) of the items that documents contain."""
    shingles, _ = written(item_shingles(items, item_id, item_text), "item-shingles")
    marks, _ = written(sketch(shingles, percent, most), "item-sketch")
    facts = marks.groupBy("width").count().collect()
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    total = shingles.count()
    rows = docs.select(F.col(id_col).alias("doc_id"), _words(text_col).alias("words"))
    out = None
    for width, n in sorted((r["width"], r["count"]) for r in facts):
        mine = marks.where(F.col("width") == width).select("h", "item_id", "part")
        hits = _runs(rows, "doc_id", width).select("doc_id", "h").join(small(mine, n), "h")
        pairs, _ = written(hits.groupBy("doc_id", "item_id").agg(F.min("part").alias("part")), "candidates")
        hit = pairs.select(F.col("doc_id").alias("_d")).distinct()
        some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).join(hit, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
        runs = _runs(some.select("doc_id", _words("t").alias("words")), "doc_id", width)
        full = shingles.where(F.col("width") == width).select("h", "item_id", "w", F.col("n").alias("n_item"))
        same = runs.select("doc_id", "h", F.array_join(F.array(*[F.col(f"w.w{i}") for i in range(width)]), " ").alias("w")).join(small(full, total), ["h", "w"])
        asked = pairs.select(F.col("doc_id").alias("_d"), F.col("item_id").alias("_i"))
        counted = same.join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("item_id").eqNullSafe(F.col("_i")), "left_semi").groupBy("doc_id", "item_id", "n_item").agg(F.countDistinct("h").alias("n_hit"))
        out = counted if out is None else out.unionByName(counted)
    if out is None:  # no item has a word
        out = docs.select(F.col(id_col).alias("doc_id")).limit(0).crossJoin(items.select(F.col(item_id).alias("item_id")).limit(0)).select("doc_id", "item_id", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_hit"))
    return out.where(100 * F.col("n_hit") >= percent * F.col("n_item")).select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_hit", (F.col("n_hit") / F.col("n_item")).alias("containment"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract query: which documents contain which benchmark items."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
iv AS (SELECT item_id, least(5, len(w)) AS k, w FROM iw WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM iv),
ni AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id),
sd AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM dw, (SELECT DISTINCT k FROM iv) WHERE len(w) >= k),
hit AS (SELECT doc_id, item_id, count(*) AS n_hit FROM sd JOIN si USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_hit, n_hit / n_item AS containment FROM hit JOIN ni USING (item_id) WHERE 100 * n_hit >= 75 * n_item
"""


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text contains a benchmark item."""
    rows = identified(docs, id_col, text_col, others=True)
    leaks = find_leaks(rows.select("rid", "text"), items, "rid", "text", **options).select(F.col("doc_id").alias("rid")).distinct()
    return rows.join(leaks, "rid", "left_anti").select("doc.*")
