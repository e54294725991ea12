"""Alert rules and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.functions.text import error_codes, strip

# Services in the order in which they are looked for.
SERVICES = ("payment", "billing", "checkout", "auth", "login", "database", "user", "api", "core", "gateway")
# Severities and their key phrases, strongest first.
SEVERITIES = {
    "critical": ("critical", "outage", "down", "data loss", "corruption", "irreversible", "revenue impact", "transactions failing"),
    "high": ("spike", "surge", "800%", "severe"),
    "medium": ("degradation", "slow", "increased"),
    "low": ("minor", "warning"),
}
# Phrases that escalate by themselves.
ESCALATING = ("data loss", "corruption", "payment", "billing", "checkout", "revenue", "breach")


def holds_any(c: Column, phrases) -> Column:
    return c.rlike("|".join(p.replace("%", "[%]") for p in phrases))


def service(alert: Column) -> Column:
    """The first known service that the text names."""
    low = F.lower(alert)
    names = F.filter(F.array(*map(F.lit, SERVICES)), lambda s: F.contains(low, s))
    return F.coalesce(F.get(names, F.lit(0)), F.lit("unknown-service"))


def severity(alert: Column) -> Column:
    """The first severity one of whose phrases occurs; medium without any."""
    low, out = F.lower(alert), None
    for name, phrases in SEVERITIES.items():
        out = F.when(holds_any(low, phrases), name) if out is None else out.when(holds_any(low, phrases), name)
    return out.otherwise("medium")


def escalates(alert: Column, level: Column, confidence: Column) -> Column:
    """critical, a phrase that escalates, or a confidence below 0.6 (missing counts as 0)."""
    return (level == "critical") | holds_any(F.lower(alert), ESCALATING) | (F.coalesce(confidence, F.lit(0.0)) < 0.6)


def classify(alerts: DataFrame, text_col: str = "alert_text") -> DataFrame:
    """alerts with service, severity and error_codes; blank texts are left out."""
    t = F.col(text_col)
    return alerts.where(strip(F.coalesce(t, F.lit(""))) != "").withColumns({"service": service(t), "severity": severity(t), "error_codes": error_codes(t)})


def decide(classified: DataFrame, text_col: str = "alert_text", confidence_col: str = "confidence", at_col: str = "ts") -> DataFrame:
    """The decision of each classified alert."""
    up = escalates(F.col(text_col), F.col("severity"), F.col(confidence_col))
    return classified.withColumns({
        "incident_id": F.date_format(at_col, "'inc-'yyyy-MM-dd-HHmm"),
        "status": F.lit("ongoing"),
        "should_escalate": up,
        "next_recommendation": F.when(up, "Immediate human escalation required").otherwise("Continue monitoring"),
        "summary": F.concat(F.lit("Issue detected in "), F.col("service"), F.lit(" with severity "), F.col("severity"), F.lit(".")),
    })


# What stands for a reasoning that failed.
FAILED_ISSUE = "Reasoning failed"
REASONING = "likely_issue string, probable_root_cause string, confidence double, is_familiar boolean, needs_external_knowledge boolean"


def reasoning(reply: Column) -> Column:
    """The struct in a model's reply; a reply without one gives all nulls, broken JSON the failure with confidence 0."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    read = F.from_json(found, REASONING)
    bad = F.coalesce(F.try_parse_json(found).isNull(), F.lit(True))
    failed = F.struct(F.lit(FAILED_ISSUE).alias("likely_issue"), F.lit("malformed reply").alias("probable_root_cause"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_familiar"), F.lit(True).alias("needs_external_knowledge"))
    return F.when(F.coalesce(found, F.lit("")) == "", F.from_json(F.lit("{}"), REASONING)).when(bad, failed).otherwise(read)


def internal_context(name: Column) -> Column:
    """SRC15: the constant context of a service."""
    return F.struct(
        F.concat(F.lit("No critical errors for "), name, F.lit(" before alert.")).alias("recent_logs"), F.concat(name, F.lit(" operating at baseline until spike.")).alias("recent_metrics"),
        F.lit("2 similar incidents found in last 30 days.").alias("similar_incidents"), F.lit("operational").alias("service_status"),
    )


def external_knowledge(queries: DataFrame, titles: DataFrame, k: int = 3) -> DataFrame:
    """SRC14: queries (id, service) with the first k titles (ord, title) that name the service, joined by line ends; null without any.

    A title has a row for each of its parts that is as long as some service's name, which meets the services by an
    equi-join, however many they are; each task keeps its own first k of a service before they are shuffled.
    """
    names = queries.select(F.col("service").alias("part")).where("part is not null").distinct()
    lengths = F.broadcast(names.agg(F.array_sort(F.collect_set(F.length("part"))).alias("lengths")))  # one row, a number for each length
    t = F.lower("title")
    parts = F.flatten(F.transform("lengths", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, n))))
    each = titles.where("title is not null").crossJoin(lengths).select("ord", "title", F.explode(F.array_distinct(parts)).alias("part"))
    order = Window.partitionBy("part").orderBy("ord", "title")
    top = each.join(names, "part").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    told = top.groupBy("part").agg(text.joined("title", "nth", "\n").alias("knowledge"))
    return queries.join(told, F.col("service") == F.col("part"), "left").drop("part")


def verified(decisions: DataFrame, at: Column | None = None) -> DataFrame:
    """SNK12: decisions marked as verified and stored, with the time."""
    return decisions.withColumns({"verified": F.lit(True), "stored": F.lit(True), "stored_at": F.current_timestamp() if at is None else at})


def decision(classified: DataFrame, text_col: str = "alert_text", reasoning_col: str = "reasoning", at_col: str = "ts") -> DataFrame:
    """(summary, decision) of classified alerts with their reasoning; missing parts have the stated defaults."""
    r = F.col(reasoning_col)
    told = decide(classified.withColumn("confidence", r["confidence"]), text_col, "confidence", at_col)
    none = F.array().cast("array<string>")
    return told.withColumn("decision", F.struct(
        "incident_id", "service", "severity", "status", F.coalesce(r["probable_root_cause"], F.lit("Unknown")).alias("root_cause"), F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"),
        none.alias("actions_taken"), F.create_map().cast("map<string,string>").alias("verification"), "should_escalate", "next_recommendation",
    ))


def needs_external(flag: Column) -> Column:
    """a missing flag means yes."""
    return F.coalesce(flag, F.lit(True))
