"""Derived inputs that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from quillspark.storage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ALERTS = """
SELECT event_id, ts, CASE event_type
  WHEN 'error' THEN concat('Payment service down, HTTP ', 500 + user_id % 5, ' and ', 400 + user_id % 30)
  WHEN 'purchase' THEN concat('Checkout latency increased for user ', user_id)
  WHEN 'signup' THEN 'Minor warning: signup queue is slow'
  WHEN 'click' THEN concat('Spike in gateway clicks, HTTP ', 429)
  ELSE '  ' END AS alert_text, value / 40.0 AS confidence
FROM events"""

CONCEPTS = "SELECT vec_id, embedding, label, {array}(concat('c', label), concat('k', vec_id % 7), concat('m', vec_id % 3)) AS concepts FROM embeddings"

FILES = """
SELECT concat(CASE p_partkey % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'test/' WHEN 2 THEN 'docs/v1.' WHEN 3 THEN 'lib.d/' ELSE '' END,
  replace(p_name, ' ', '_'), '_', p_partkey,
  CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.md' WHEN 3 THEN '.go' WHEN 4 THEN '.PY' WHEN 5 THEN '.min.ts' ELSE '' END) AS path
FROM part"""

SHOPS = """
SELECT c_custkey, concat(CASE c_custkey % 3 WHEN 0 THEN 'https://Shop' WHEN 1 THEN 'http://me:x@www.shop' ELSE '//shop' END, c_custkey % 50,
  CASE c_custkey % 13 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com' WHEN 2 THEN '.a.sch.uk:8080' WHEN 3 THEN '.city.kawasaki.jp' WHEN 4 THEN '.a.kawasaki.jp'
    WHEN 5 THEN '.unknown' WHEN 6 THEN '.b.www.ck' WHEN 7 THEN '.com.ck.' WHEN 8 THEN '.org.au' WHEN 9 THEN '.ck' WHEN 10 THEN '.example.net' WHEN 11 THEN '' ELSE '.GOV.UK' END,
  '/item/', c_custkey) AS url
FROM customer"""

# Small programs made of part names: data that reaches a sink, is made safe, bound, in a comment, or in another function.
CODE = r"""
SELECT concat('src/', replace(p_name, ' ', '_'), '_', p_partkey, CASE WHEN p_partkey % 11 < 7 THEN '.py' ELSE '.js' END) AS path, CASE p_partkey % 11
  WHEN 0 THEN concat('def find(db):\n    name = request.args["', p_brand, '"]\n    text = "select " + name\n    return db.execute(text)\n')
  WHEN 1 THEN concat('def find(db):\n    name = request.args["', p_brand, '"]\n    return db.execute("select ?", (name,))\n')
  WHEN 2 THEN concat('# db.execute(request.args)\nnote = "db.execute(input()) ', p_type, '"\n')
  WHEN 3 THEN concat('def get():\n    url = f"http://{host}/', p_partkey, '"\n    host = input()\n    return requests.get(url)\n')
  WHEN 4 THEN concat('password = "', replace(p_brand, '#', ''), p_partkey, '"\nsize = int(input())\ndb.execute("limit " + size)\n')
  WHEN 5 THEN 'def a():\n    x = input()\ndef b():\n    return mark_safe(x)\n'
  WHEN 6 THEN concat('def page():\n    x = request.form\n    y = x.title\n    return mark_safe("', p_type, '" + y)\n')
  WHEN 7 THEN 'function show() { const q = location.search; el.innerHTML = `<b>${q}</b>`; }'
  WHEN 8 THEN '// fetch(location)\nconst n = parseInt(req.query.n); db.query("limit " + n);'
  WHEN 9 THEN 'const go = (req) => { let u = req.query.u; fetch(u); db.query("a", u) }'
  ELSE concat('/* document.write(location) */ const apiKey = "', p_partkey, p_partkey, '";') END AS content
FROM part"""

DOC_FILES = "SELECT concat('src/doc_', doc_id, '.py') AS path, text AS content FROM documents"


def _with(spark, sf_dir, query, tables, dealt=False):
    """The query over the named tables of sf_dir; `dealt` over all tasks first, where a row costs much and a file has one row group."""
    for t in tables:
        view = f"{t}_{uuid4().hex[:8]}"
        rows = table(spark, sf_dir, t)
        if dealt:  # written, else filters on derived columns would be moved before the exchange
            rows = cut(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
        rows.createOrReplaceTempView(view)
        query = query.replace(f"FROM {t}", f"FROM {view}")
    return spark.sql(query)


def alerts(spark, sf_dir) -> DataFrame:
    return _with(spark, sf_dir, ALERTS, ("events",))


def concepts(spark, sf_dir) -> DataFrame:
    return _with(spark, sf_dir, CONCEPTS.replace("{array}", "array"), ("embeddings",))


def part_files(spark, sf_dir) -> DataFrame:
    return _with(spark, sf_dir, FILES, ("part",))


def shops(spark, sf_dir) -> DataFrame:
    """URLs of customers under many kinds of suffixes."""
    return _with(spark, sf_dir, SHOPS, ("customer",))


def code_files(spark, sf_dir) -> DataFrame:
    return _with(spark, sf_dir, CODE, ("part",), dealt=True)


def document_files(spark, sf_dir) -> DataFrame:
    return _with(spark, sf_dir, DOC_FILES, ("documents",))


def replies(spark, sf_dir) -> DataFrame:
    """Model replies made of conversations: bare, fenced, inside prose, and none."""
    return _with(spark, sf_dir, REPLIES, ("conversations",))


REPLIES = """
SELECT conv_id, turn, CASE (conv_id + turn) % 4
  WHEN 0 THEN concat('{"turn": ', turn, ', "role": "', role, '"}')
  WHEN 1 THEN concat('Here:', chr(10), '```json', chr(10), '{"turn": ', turn, '}', chr(10), '```', chr(10), 'done')
  WHEN 2 THEN concat('The answer is {"turn": ', turn, ', "ok": true} as asked')
  ELSE concat('no data for ', role) END AS reply
FROM conversations"""
