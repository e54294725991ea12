"""Queries of the flows, the report, fetched pages, providers and run tables; imported for its entries in the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import pipelines, providers
from quillspark.functions import urls
from quillspark.operators import alerts, crawl, report, research, scan
from quillspark.plans import inputs
from quillspark.plans.catalog import _docs, _found, _pages, query
from quillspark.plans.inputs import table
from quillspark.sources import web


def _report_sources(spark, sf):
    d = _docs(spark, sf)
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    return d.select(
        (i + 1).alias("n"), F.concat(F.lit("S"), (i + 1).cast("string")).alias("id"), F.concat(F.lit("http://"), "source", F.lit(".example.com/"), F.repeat(F.lit("x"), (i % 80).cast("int"))).alias("url"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Title "), i.cast("string"))).alias("title"), F.when(i % 4 != 1, F.array(F.concat(F.lit("lang "), "lang"), F.col("source"))).otherwise(none).alias("bullets"),
        F.when(i % 10 == 0, F.array(F.concat(F.lit("said "), i.cast("string")))).otherwise(none).alias("quotes"), F.when(i % 2 == 0, F.concat(F.lit("from "), "source")).alias("reliability"),
        F.when(i % 7 > 0, F.to_date(F.lit("2024-01-15"))).alias("retrieved_at"), F.when(i % 5 == 4, "S1").alias("duplicate_of"),
    )


@query
def report_markdown(spark, sf):
    """R1 over all documents that are no duplicates."""
    return report.report_lines(_report_sources(spark, sf).where("duplicate_of is null"), "tables", "run_test", "2024-01-15 00:00 UTC", 9, 2, 3)


@query
def report_offline(spark, sf):
    return report.plain_lines(_report_sources(spark, sf), "tables")


@query
def report_fallback(spark, sf):
    return report.plain_lines(_report_sources(spark, sf), "tables", failed=True)


@query
def summary_brief(spark, sf):
    return report.brief(_report_sources(spark, sf))


def _responses(spark, sf):
    i, types = F.col("page_id"), F.array(*map(F.lit, ("text/html; charset=utf-8", "application/pdf", "text/plain; x", "application/xhtml+xml", "image/png", "", "TEXT/HTML")))
    status = F.when(i % 11 == 0, 404).when(i % 11 == 1, 503).when(i % 11 == 2, 0).otherwise(200)
    return _pages(spark, sf).select("page_id", "url", F.when(i % 4 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url")).alias("final_url"), status.alias("status"), F.get(types, (i % 7).cast("int")).alias("content_type"), F.col("html").alias("body"))


@query
def page_kinds(spark, sf):
    r = _responses(spark, sf)
    a2 = web.page_kind_a2(F.col("status"), F.col("content_type"), F.col("url"), F.col("page_id") % 13 > 0)
    return r.select("page_id", web.page_kind_a1(F.col("status"), F.col("content_type")).alias("a1"), a2.alias("a2"))


@query
def fetched_pages(spark, sf):
    got = web.fetched(_responses(spark, sf))
    return got.select("url", "canonical_url", "status", "content_type", "error", "pdf_text_unavailable", F.length("html").alias("n_html"), F.length("text").alias("n_text"))


@query
def retry_schedule(spark, sf):
    p = _pages(spark, sf).select(urls.authority(F.col("url")).alias("domain"), F.col("page_id").alias("ord"), (F.col("page_id") % 5).cast("int").alias("failures"))
    return web.retry_schedule(p, 2).select("domain", "ord", "attempt", F.round("at", 6).alias("at"), "ok")


@query
def robots_longest(spark, sf):
    """rules made of the pages: a page in five forbids the first three characters of its path, one in seven allows its own."""
    p = _pages(spark, sf).select("page_id", "url")
    path = urls.path(F.col("url"))
    host = urls.authority(F.col("url"))
    no = p.where("page_id % 5 = 0").select(host.alias("host"), F.lit("*").alias("agent"), F.lit(False).alias("allow"), F.substring(path, 1, 3).alias("prefix"))
    yes = p.where("page_id % 7 = 0").select(host.alias("host"), F.lit("*").alias("agent"), F.lit(True).alias("allow"), path.alias("prefix"))
    return web.allowed_longest(p, no.unionByName(yes).where("prefix <> ''"), "bot/1.0").select("page_id", "allowed")


@query
def fetch_ways(spark, sf):
    return web.dispatch(_pages(spark, sf).select("page_id", "url")).select("page_id", "way")


def _crawled(spark, sf):
    i = F.col("doc_id")
    return _docs(spark, sf).select(
        F.concat(F.lit("S"), i.cast("string")).alias("id"), F.concat(F.lit("http://"), "source").alias("url"), F.concat(F.lit("http://"), F.when(i % 2 == 0, F.col("source")).otherwise("moved")).alias("final_url"),
        F.when(i % 3 == 0, F.concat(F.lit("http://c/"), "source")).alias("canonical_url"), F.when(i % 4 == 0, "").otherwise(F.col("lang")).alias("title"), F.lit("text/html").alias("content_type"),
        F.when(i % 5 == 0, "").otherwise("someone").alias("author"), F.lit("").alias("published_at"), F.when(i % 6 == 0, True).alias("pdf_text_unavailable"),
    )


@query
def source_projection(spark, sf):
    return research.projected(_crawled(spark, sf))


@query
def source_projection_a2(spark, sf):
    return research.projected(_crawled(spark, sf), "a2")


@query
def kept_sources(spark, sf):
    return research.kept_sources(_report_sources(spark, sf), 20).select("n", "id", "url")


@query
def run_ids(spark, sf):
    d = _docs(spark, sf)
    at = F.lit("2024-01-15 01:02:03").cast("timestamp")
    return d.select("doc_id", research.run_id(at, F.col("doc_id")).alias("a1"), research.run_id(at, F.col("doc_id"), "a2").alias("a2"), research.elapsed(F.col("doc_id") * 7).alias("elapsed"))


@query
def history_last(spark, sf):
    return research.last_rows(table(spark, sf, "events").select("event_id", F.struct("ts", "event_id").alias("at"))).select("event_id")


@query
def key_quotes(spark, sf):
    c = table(spark, sf, "conversations")
    raw = F.concat(F.lit('[{"quote": "q'), F.col("conv_id").cast("string"), F.lit('", "start_offset": '), F.col("turn").cast("string"), F.lit('}, {"quote": ""}, {"end_offset": 3}, {"quote": "'), "role", F.lit('", "end_offset": "9"}]'))
    each = c.select("conv_id", "turn", F.posexplode(providers.key_quotes(raw)).alias("k", "x"))
    return each.select("conv_id", "turn", "k", "x.quote", "x.start_offset", "x.end_offset")


@query
def concept_union(spark, sf):
    """F16, F17, S21, AG15 over a document's language, source and two made phrases."""
    found = F.array(F.struct(F.upper("source").alias("text"), F.lit("ORG").alias("label")), F.struct(F.col("lang").alias("text"), F.lit("DATE").alias("label")))
    some = providers.phrases(F.array(F.concat(F.lit("Two  "), "lang"), F.col("source"), F.concat(F.lit("two "), F.upper("lang"))))
    return _docs(spark, sf).select("doc_id", F.array_join(providers.concept_union(providers.entities(found), some, F.array("source")), ";").alias("concepts"))


@query
def judge_replies(spark, sf):
    c = table(spark, sf, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 3
    reply = F.when(k == 0, F.concat(F.lit("COMPLETE: Yes\nANSWER:  it is "), "role", F.lit(" \nANSWER: more"))).when(k == 1, "COMPLETE: No").otherwise("COMPLETE: Yes")
    x = providers.complete_reply(reply)
    return c.select("conv_id", "turn", x["complete"].alias("complete"), x["answer"].alias("answer"))


@query
def enrich_offline(spark, sf):
    x = providers.enrichment(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("One "), "lang", F.lit(". Two "), "source", F.lit("! Three"))), F.col("source"), "a2", 2)
    return _docs(spark, sf).select("doc_id", x["title"].alias("title"), F.array_join(x["summary_bullets"], ";").alias("bullets"), x["reliability_notes"].alias("notes"))


def _replied(spark, sf):
    e = inputs.alerts(spark, sf).where("alert_text <> '  '")
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit('Sure: {"probable_root_cause": "disk", "confidence": '), (F.floor(F.col("confidence") * 1000) / 1000).cast("string"), F.lit(', "needs_external_knowledge": false} ok'))).when(k == 1, "no idea").when(k == 2, "{broken}").otherwise('{"confidence": 0.9}')
    return e.withColumn("reply", reply)


@query
def outage_flow(spark, sf):
    out = pipelines.outage(_replied(spark, sf), "reply")
    d = F.col("decision")
    return out.select("event_id", "summary", d["incident_id"].alias("incident_id"), d["root_cause"].alias("root_cause"), F.round(d["confidence"], 6).alias("confidence"), d["should_escalate"].alias("should_escalate"), "needs_external", F.col("context")["recent_logs"].alias("recent_logs"))


@query
def external_knowledge(spark, sf):
    c = alerts.classify(inputs.alerts(spark, sf)).select("event_id", "service")
    d = _docs(spark, sf).select(F.col("doc_id").alias("ord"), F.concat_ws(" ", "lang", "source", F.get(F.array(*map(F.lit, alerts.SERVICES)), (F.col("doc_id") % len(alerts.SERVICES)).cast("int"))).alias("title"))
    return alerts.external_knowledge(c, d).select("event_id", "service", "knowledge")


@query
def findings_fold(spark, sf):
    files, found = _found(spark, sf)
    return scan.fold(files, found).select("files_scanned", F.size("findings").cast("long").alias("findings"), F.md5(F.array_join(F.transform("findings", lambda x: x["id"]), ",")).alias("ids_md5"))


@query
def triage_unread(spark, sf):
    """A review that cannot be read confirms all."""
    return scan.triaged(_found(spark, sf)[1], "sorry").select("id", "rejected", "reason")


@query
def scan_and_patch(spark, sf):
    out = pipelines.scan_and_patch(inputs.document_files(spark, sf), 0, content_chars=None)
    return out.select("total_files_scanned", "total_vulns_detected", "confirmed_vulns", "false_positives_rejected", "patches_generated", F.md5(F.array_join(F.transform("vulnerabilities", lambda x: x["id"]), ",")).alias("ids_md5"))


@query
def research_offline(spark, sf):
    """R2, AG8: an offline run over all documents: its statistics."""
    d = _docs(spark, sf)
    pages = d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("http://"), "source").alias("url"), F.col("lang").alias("title"), "text", F.when(F.col("doc_id") % 17 == 0, "http_500").alias("error"))
    return pipelines.research_a1(spark, pipelines.RunConfig("tables", offline=True), pages).stats


@query
def research_run(spark, sf):
    """A2's run: crawl from the first pages, dedupe, enrich, report: the report's lines."""
    p = _pages(spark, sf)
    seeds = p.where("page_id < 5").select("url", F.col("page_id").alias("ord"))
    return pipelines.research_a2(spark, pipelines.RunConfig("tables", max_sources=200), p, seeds, "2024-01-15 00:00 UTC").report


@query
def research_a1_sources(spark, sf):
    """PL1: A1's run over all pages, from every page whose id is divisible by 20, under robots rules: its sources."""
    p = _pages(spark, sf)
    seeds = p.where("page_id % 20 = 0").select("url", F.col("page_id").alias("ord"))
    hosts = p.select(urls.authority(F.col("url")).alias("host")).distinct()
    robots = hosts.select("host", F.concat(F.lit("User-agent: *\nDisallow: /"), F.substring("host", 1, 2), F.lit("\nDisallow: /en/1\nAllow: /en/12\n")).alias("text"))
    run = pipelines.research_a1(spark, pipelines.RunConfig("tables", max_sources=1_000_000), pages=p, seeds=seeds, generated="2024-01-15 00:00 UTC", robots=robots)
    return run.sources.select("id", "url", "title", "duplicate_of", F.md5("text").alias("text_md5"), F.size("bullets").alias("bullets"))


@query
def graph_answers(spark, sf):
    """A3: all documents ingested; the benchmark's items, every id divisible by 20, as questions."""
    v, e = pipelines.ingest(_docs(spark, sf))
    q = table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    out = pipelines.answer_questions(q, v, e)
    return out.select("query_id", "answer", F.array_join("sources", ",").alias("sources"), F.size("traversal_path").alias("steps"))


@query
def robots_groups(spark, sf):
    """SRC13: rules of one made robots file for each host of the pages."""
    hosts = _pages(spark, sf).select(urls.authority(F.col("url")).alias("host")).distinct()
    files = hosts.withColumn("text", F.concat(F.lit("User-agent: A\nUser-agent: b # x\nDisallow: /p\nAllow: /p/"), F.col("host"), F.lit("\n\nUser-agent: *\nDisallow:\nDisallow: /q\n")))
    return web.rules_with_allow(files)


@query
def crawl_columns(spark, sf):
    r = _responses(spark, sf).withColumns({"title": F.lit(""), "text": F.lit(""), "html": F.lit(None).cast("string"), "pdf_text_unavailable": F.lit(False), "error": F.lit(None).cast("string"), "depth": F.lit(0)})
    return research.crawl_records(r)
