"""Research runs: source records, failures, statistics, domains, enrichment, logs
(P1-P3, P8, W1, J5-J9, AG7, AG8, SET2, L7, L10, S24, S26, SNK9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text, urls
from quillspark.operators import suffixes
from quillspark.storage import cut


def ordinals(rows: DataFrame, order: str, out: str = "n") -> DataFrame:
    """rows with their place by `order`, from 1: counts per range first, so no task sorts all rows.

    Ranges are sampled, so a second reading could deal rows otherwise: the rows are written with their range.
    """
    spark = rows.sparkSession
    dealt = cut(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_p", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return dealt.withColumn("_r", inside).join(before, "_p").withColumn(out, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def source_records(pages: DataFrame, id_order: str = "ord", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Usable pages as S1, S2, ... in order; with all columns or those named."""
    good = pages.where(text.usable(F.col(text_col)))
    good = good if columns is None else good.select(*columns)
    return ordinals(good, id_order).withColumn("id", F.concat(F.lit("S"), F.col("n").cast("string")))


def canonical(url: Column, final_url: Column) -> Column:
    """The final URL where it differs."""
    return F.nullif(final_url, url)


def enriched(records: DataFrame, facts: DataFrame, variant: str = "a1") -> DataFrame:
    """a1 takes the new title where there is one and others if not empty; a2 fills gaps only."""
    new = facts.select("id", *[F.col(c).alias(f"_{c}") for c in ("title", "author", "published_at")])
    joined = records.join(new, "id", "left")
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    if variant == "a1":
        cols = {"title": F.coalesce("_title", "title"), "author": F.coalesce(full("_author"), "author"), "published_at": F.coalesce(full("_published_at"), "published_at")}
    else:
        cols = {c: F.coalesce(full(c), F.col(f"_{c}")) for c in ("title", "author", "published_at")}
    return joined.withColumns(cols).drop("_title", "_author", "_published_at")


def new_failures(failures: DataFrame, sources: DataFrame, first_only: bool = True) -> DataFrame:
    """Failures (ord, url, error) whose URL is no source; repeated URLs once, if first_only."""
    out = failures.join(sources.select("url"), "url", "left_anti")
    return out.groupBy("url").agg(F.min(F.struct("ord", "error")).alias("x")).select("x.ord", "url", "x.error") if first_only else out


def run_stats(pages: DataFrame, variant: str = "a1", max_sources: int = 20) -> DataFrame:
    """AG8 over pages (error, text, duplicate_of)."""
    good = text.usable(F.col("text"), F.col("error")) if variant == "a1" else F.col("error").isNull() & (F.coalesce("text", F.lit("")) != "")
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    dup = good & F.col("duplicate_of").isNotNull()
    kept = n(good) - n(dup)
    if variant == "a2":
        return pages.agg(F.count(F.lit(1)).alias("fetched"), F.least(kept, F.lit(max_sources).cast("long")).alias("kept"), n(dup).alias("duplicates"), n(F.col("error").isNotNull()).alias("failures"))
    return pages.agg(n(good).alias("fetched"), kept.alias("kept"), n(dup).alias("duplicates"), n(F.col("error").isNotNull()).alias("failures"))


def top_domains(rows: DataFrame, order: str, url_col: str = "url", k: int = 5, registered: bool = False) -> DataFrame:
    """AG7: (domain, n, first) of the k most frequent domains, ties by first appearance."""
    if registered:
        rows = suffixes.with_registered_domain(rows, url_col, "_registered")
    d = F.col("_registered") if registered else urls.domain(F.col(url_col))
    counted = rows.groupBy(d.alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k)


def union_sections(kept: DataFrame, duplicates: DataFrame, failures: DataFrame) -> DataFrame:
    """SET2: the three lists one after another, each with its section's number."""
    parts = [x.withColumn("section", F.lit(i)) for i, x in enumerate((kept, duplicates, failures))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def kept_sources(sources: DataFrame, most: int = 20, order: str = "n") -> DataFrame:
    """The first `most` sources that are no duplicates; the others are in no list."""
    return sources.where("duplicate_of is null").orderBy(order).limit(most)


def projected(pages: DataFrame, variant: str = "a1") -> DataFrame:
    """Pages as source records; '' means null.  a1 keeps the canonical URL, a2 finds it from the final one."""
    full = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    where = F.col("canonical_url") if variant == "a1" else canonical(F.col("url"), F.col("final_url")).alias("canonical_url")
    more = [full("author"), full("published_at")] if variant == "a1" else [F.coalesce("pdf_text_unavailable", F.lit(False)).alias("pdf_text_unavailable")]
    return pages.select("id", "url", where, full("title"), "content_type", *more)


def crawl_records(pages: DataFrame) -> DataFrame:
    """The nine columns of a crawled page."""
    return pages.select("url", "final_url", "title", "text", "html", "content_type", "pdf_text_unavailable", "error", "depth")


def last_rows(history: DataFrame, at: str = "at", most: int = 8) -> DataFrame:
    """The newest rows of a history, newest first."""
    return history.orderBy(F.desc(at)).limit(most)


def elapsed(seconds: Column) -> Column:
    """S26: 'Ns' below a minute, else 'NmSSs'."""
    s = F.floor(seconds).cast("int")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.format_string("%dm%02ds", F.floor(s / 60).cast("int"), s % 60))


def log_lines(events: DataFrame) -> DataFrame:
    """SNK9: (at, message) as '[time] message'."""
    return events.select(F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), F.col("message")).alias("line"))


def run_id(at: Column, seed: Column, variant: str = "a1") -> Column:
    """a1: time and eight hexadecimal digits of a seed's hash; a2: 'run_' and twelve digits."""
    if variant == "a2":
        return F.concat(F.lit("run_"), F.substring(F.sha2(seed.cast("string"), 256), 1, 12))
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.sha2(seed.cast("string"), 256), 1, 8))
