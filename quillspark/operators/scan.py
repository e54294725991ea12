"""Source scans: file filter, detectors, findings, triage, report (F4, L3, J11, U10-U12, W2, P7, AG9, AG10, J8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rb": "ruby", "java": "java", "php": "php"}
# Path prefixes without application code.
SKIPPED = (
    "test/", "test-config-errors/", "bench/", "examples/", "docs/", "errors/", "contributing/", "turbo/", ".github/",
    ".devcontainer/", ".vscode/", ".cursor/", ".claude/", ".claude-plugin/", ".agents/", ".conductor/", ".config/",
    ".husky/", ".cargo/", "patches/", "scripts/", "turbopack/crates/turbopack-bench/",
)
CONTENT_CHARS = 50_000
# The offline detectors: order, kind, severity, regular expression.
DETECTORS = (
    (0, "sqli", "critical", r"(?i)\b(?:select|insert|update|delete)\b[^;\n]{0,80}\b(?:from|into|set|where)\b"),
    (1, "xss", "high", r"(?i)<script\b|innerhtml|document\.write"),
    (2, "ssrf", "medium", r"(?i)https?://[a-z0-9.-]+"),
    (3, "auth", "high", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\s*[:=]"),
)
CONFIRMED = ("critical", "high")
# Fixed value: the reason that stands for a review that cannot be read.
UNREAD = "Triage parsing failed — confirming all findings for safety."


def language(path: Column) -> Column:
    """By what follows the path's last '.'; null if that is no source extension."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(F.contains(path, F.lit(".")), F.try_element_at(table, F.element_at(F.split(path, r"\."), -1)))


def skipped(path: Column) -> Column:
    out = F.lit(False)
    for p in SKIPPED:
        out = out | F.startswith(path, F.lit(p))
    return out


def source_files(files: DataFrame, max_files: int = 0, path_col: str = "path", content_chars: int | None = CONTENT_CHARS) -> DataFrame:
    """F4, L3, SRC10: source files with their language, the first max_files by path if that is positive; contents
    are cut at content_chars, or whole with None; rows with a `status` other than 200 are left out."""
    p = F.col(path_col)
    out = files.withColumn("language", language(p)).where(F.col("language").isNotNull() & ~skipped(p))
    if "status" in files.columns:
        out = out.where("status = 200")
    if "content" in files.columns and content_chars is not None:
        out = out.withColumn("content", F.substring("content", 1, content_chars))
    return out.orderBy(path_col).limit(max_files) if max_files > 0 else out


def detect(files: DataFrame, detectors=DETECTORS) -> DataFrame:
    """J11, U10, SET1: (file, det_ord, vuln_type, severity, pos, evidence) of every detector's matches.

    The four detectors are columns of one pass over the file, not four joins.
    """
    def matches(order, kind, level, regex):
        def found(e, i):
            return F.struct(F.lit(order).alias("det_ord"), F.lit(kind).alias("vuln_type"), F.lit(level).alias("severity"), i.cast("long").alias("pos"), e.alias("evidence"))

        return F.transform(F.regexp_extract_all("content", F.lit(regex), 0), found)

    hits = [matches(*d) for d in detectors]
    return files.select(F.col("path").alias("file"), F.explode(F.concat(*hits)).alias("x")).select("file", "x.*")


def with_ids(findings: DataFrame) -> DataFrame:
    """Id 'file:kind:i', i counting all findings of a file in detector order."""
    i = F.row_number().over(Window.partitionBy("file").orderBy("det_ord", "pos")) - 1
    return findings.withColumn("i", i.cast("long")).withColumn("id", F.concat_ws(":", "file", "vuln_type", "i"))


def reduce_findings(files: DataFrame, findings: DataFrame) -> DataFrame:
    """AG9: (file, findings), files without any counting 0."""
    counted = findings.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return files.select(F.col("path").alias("file")).join(counted, "file", "left").select("file", F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


def fold(files: DataFrame, findings: DataFrame) -> DataFrame:
    """AG9, DF4: one row: how many files, and all findings in order of file and number."""
    cells = F.array_sort(F.collect_list(F.struct("file", "i", "id", "vuln_type", "severity", "evidence")))
    return files.agg(F.count(F.lit(1)).alias("files_scanned")).crossJoin(findings.agg(cells.alias("findings")))  # two single rows


def triaged(findings: DataFrame, reply: str | None) -> DataFrame:
    """Findings confirmed by a reviewer's JSON reply, with its count of rejected ones and its reason; a reply that cannot be read confirms all."""
    spark = findings.sparkSession
    read = F.from_json(F.col("reply"), "confirmed_ids array<string>, rejected_count long, reasoning string")
    told = spark.createDataFrame([(reply,)], "reply string").select(F.try_parse_json("reply").isNotNull().alias("ok"), read.alias("x"))
    told = told.select(F.coalesce(F.col("ok") & F.startswith(F.trim(F.lit(reply or "")), F.lit("{")), F.lit(False)).alias("ok"), F.col("x.confirmed_ids").alias("ids"), F.coalesce("x.rejected_count", F.lit(0)).alias("rejected"), F.coalesce("x.reasoning", F.lit("")).alias("reason"))
    both = findings.join(F.broadcast(told))  # one row
    kept = both.where("not ok or array_contains(ids, id)")
    return kept.select(*findings.columns, F.when(F.col("ok"), F.col("rejected")).otherwise(0).cast("long").alias("rejected"), F.when(F.col("ok"), F.col("reason")).otherwise(UNREAD).alias("reason"))


def confirmed_ids(findings: DataFrame) -> DataFrame:
    """U11's offline rule: critical and high findings stand."""
    return findings.where(F.col("severity").isin(*CONFIRMED)).select("id")


def triage(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """The findings whose ids were confirmed."""
    return findings.join(ids, "id", "left_semi")


def report(files: DataFrame, findings: DataFrame, confirmed: DataFrame, reported_rejected: int) -> DataFrame:
    """AG10: one row of counts; what the triage reported, and what follows from the counts."""
    a = files.agg(F.count(F.lit(1)).alias("files_scanned"))
    b = findings.agg(F.count(F.lit(1)).alias("total_findings"))
    c = confirmed.agg(F.count(F.lit(1)).alias("confirmed"))
    one = a.crossJoin(b).crossJoin(c)  # three single rows
    return one.select("files_scanned", "total_findings", "confirmed", F.lit(reported_rejected).cast("long").alias("reported_false_positives"), (F.col("total_findings") - F.col("confirmed")).alias("derived_false_positives"))
