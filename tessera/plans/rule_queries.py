"""Integrity, hashing, diff, replay and review queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import nested, text
from tessera.operators import diff, integrity, lineage, merge, overrides, progress, release, review
from tessera.plans.registry import query, read
from tessera.sources import records
from tessera.sources.shared import shared_folder
from tessera.streaming import monitor


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys_lineitem(spark, sf_dir):
    return integrity.duplicate_keys(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
SELECT 'LABEL_WITHOUT_DOCUMENT' AS code, doc_id::VARCHAR AS subject, NULL::VARCHAR AS detail FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src0')
UNION ALL SELECT 'ORDER_WITHOUT_CUSTOMER', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
""")
def orphan_rows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("source <> 'src0'")
    customers = read(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return integrity.all_issues(
        integrity.issues(integrity.orphans(read(spark, sf_dir, "labels"), docs, "doc_id", "doc_id"), "LABEL_WITHOUT_DOCUMENT", "doc_id"),
        integrity.issues(integrity.orphans(read(spark, sf_dir, "orders"), customers, "o_custkey", "c_custkey"), "ORDER_WITHOUT_CUSTOMER", "o_orderkey", "o_custkey"))


@query("""
SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> o_orderkey % 25
""")
def parent_mismatch(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("ref"), (F.col("o_orderkey") % 25).cast("int").alias("c_nationkey"))
    out = integrity.parent_mismatch(orders, read(spark, sf_dir, "customer"), "ref", "c_custkey", "c_nationkey")
    return out.select("o_orderkey", F.col("ref").alias("o_custkey"), F.col("target_owner").alias("c_nationkey"))


@query("""
SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 1) AS n, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS l_partkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber = 1) <> 1
""")
def exactly_one_default(spark, sf_dir):
    return integrity.exactly_one(read(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linenumber") == 1, "l_partkey")


@query("""
WITH said AS (SELECT DISTINCT o_orderkey AS k, unnest([1, 2, (o_custkey % 7)::INT]) AS m FROM orders),
real AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS m FROM lineitem)
SELECT k, m, 'declared' AS side FROM (SELECT k, m FROM said EXCEPT SELECT k, m FROM real) UNION ALL SELECT k, m, 'actual' FROM (SELECT k, m FROM real EXCEPT SELECT k, m FROM said)
""")
def member_set_mismatch(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.array(F.lit(1), F.lit(2), (F.col("o_custkey") % 7).cast("int")).alias("said"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m"))
    return integrity.member_mismatch(orders, lines, "k", "said", "m")


@query("""
SELECT p_partkey, r AS reference FROM (SELECT p_partkey, unnest([p_partkey % 110, p_size]) AS r FROM part) WHERE r NOT IN (SELECT s_suppkey FROM supplier)
""")
def array_refs(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_partkey") % 110, F.col("p_size").cast("long")).alias("refs"))
    return integrity.array_references(part, "p_partkey", "refs", read(spark, sf_dir, "supplier"), "s_suppkey")


@query("""
SELECT event_id, event_type, user_id FROM events WHERE (event_type = 'click' AND user_id * 13 NOT IN (SELECT c_custkey FROM customer))
  OR (event_type = 'purchase' AND user_id * 11 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
  OR (event_type = 'view' AND user_id NOT IN (SELECT s_suppkey FROM supplier))
""")
def scoped_refs(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", (F.col("user_id") * 13).alias("customer_ref"), (F.col("user_id") * 11).alias("order_ref"), F.col("user_id").alias("supplier_ref"))
    out = integrity.scoped_references(events, "event_type", {
        "click": ("customer_ref", read(spark, sf_dir, "customer"), "c_custkey"),
        "purchase": ("order_ref", read(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey"),
        "view": ("supplier_ref", read(spark, sf_dir, "supplier"), "s_suppkey")})
    return out.select("event_id", "event_type", "user_id")


@query("""
WITH e AS (SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase')),
c AS (
  SELECT c_custkey, 0 AS p, event_id, event_type FROM customer JOIN e ON user_id = c_custkey WHERE event_type = 'error'
  UNION ALL SELECT c_custkey, 1, event_id, event_type FROM customer JOIN e ON user_id = c_nationkey WHERE event_type = 'purchase')
SELECT c_custkey, event_type FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY p, event_id) AS rn FROM c) WHERE rn = 1
""")
def priority_match(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    own = events.where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    # The fallback needs only its first event for each key: reduced before the join.
    shared = events.where("event_type = 'purchase'").groupBy(F.col("user_id").cast("int").alias("c_nationkey")).agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return integrity.priority_match(rows, "c_custkey", [(own, "c_custkey"), (shared, "c_nationkey")], "event_id", "event_type")


@query("""
SELECT sha256(string_agg(p_partkey::VARCHAR, chr(10) ORDER BY p_partkey::VARCHAR)) AS set_hash FROM part
""")
def registry_hash(spark, sf_dir):
    return integrity.ordered_hash(read(spark, sf_dir, "part"), "p_partkey")


@query("""
WITH h AS (SELECT sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_returnflag":"' || l_returnflag || '"}') AS h FROM lineitem),
d AS (SELECT h, count(*) AS n FROM h GROUP BY 1),
b AS (SELECT substr(h, 1, 2) AS b, sum(n) AS n, sha256(string_agg(h || ':' || n, '' ORDER BY h || ':' || n)) AS h FROM d GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(b || ':' || h, '' ORDER BY b || ':' || h)) AS fingerprint FROM b
""")
def table_fingerprint(spark, sf_dir):
    return integrity.table_fingerprint(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def content_duplicates(spark, sf_dir):
    return integrity.duplicate_content(read(spark, sf_dir, "documents"), "doc_id", "text")


_VERSION = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, 'v2' AS export_id FROM orders WHERE o_orderkey % 19 <> 0 UNION ALL SELECT o_orderkey + 10000000, o_orderstatus, o_totalprice, 'v2' FROM orders WHERE o_orderkey % 23 = 0"
_OLD = "SELECT o_orderkey, o_orderstatus, o_totalprice, 'v1' AS export_id FROM orders"


def _versions(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    old = orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit("v1").alias("export_id"))
    price = F.when(F.col("o_orderkey") % 17 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = orders.where("o_orderkey % 19 <> 0").select("o_orderkey", "o_orderstatus", price.alias("o_totalprice"), F.lit("v2").alias("export_id"))
    more = orders.where("o_orderkey % 23 = 0").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_orderstatus", "o_totalprice", F.lit("v2").alias("export_id"))
    return old, new.unionByName(more)


@query(f"""
WITH a AS ({_OLD}), b AS ({_VERSION})
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'mismatch' END AS status
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice
""")
def manifest_full_join(spark, sf_dir):
    return integrity.full_comparison(*_versions(spark, sf_dir), "o_orderkey", "o_totalprice")


@query(f"""
WITH a AS ({_OLD}), b AS ({_VERSION})
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  coalesce(a.o_orderkey, b.o_orderkey) % 2 = 0 AS allowed
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice OR a.o_orderstatus <> b.o_orderstatus
""")
def snapshot_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    allowed = old.select("o_orderkey").union(new.select("o_orderkey")).distinct().where("o_orderkey % 2 = 0")
    return diff.snapshot_diff(old, new, "o_orderkey", ["export_id"], allowed)


@query(f"""
WITH a AS ({_OLD}), b AS ({_VERSION})
SELECT a.o_orderkey, a.o_orderstatus, a.o_totalprice, coalesce(b.export_id, a.export_id) AS export_id FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey % 34 <> 0
UNION ALL SELECT * FROM b WHERE o_orderkey % 34 = 0
""")
def targeted_merge(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    targets = old.select("o_orderkey").union(new.select("o_orderkey")).where("o_orderkey % 34 = 0")
    return diff.targeted_merge(old, new, "o_orderkey", targets, ["export_id"])


@query(f"WITH a AS ({_OLD}), b AS ({_VERSION}) SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b")
def upsert_orders(spark, sf_dir):
    return diff.upsert(*_versions(spark, sf_dir), "o_orderkey")


_CHANGES = """SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'w' || o_custkey % 3 AS worker FROM orders WHERE o_orderkey % 4 <> 3
UNION ALL SELECT o_orderkey, 0.0, 'w0' FROM orders WHERE o_orderkey % 40 = 1 UNION ALL SELECT -o_orderkey, 7.0, 'w' || o_custkey % 3 FROM orders WHERE o_orderkey % 5 = 0"""


@query(f"""
WITH t AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 'w' || o_orderkey % 3 AS worker FROM orders), c AS ({_CHANGES}),
one AS (SELECT o_orderkey, any_value(o_totalprice) AS price, any_value(worker) AS worker, count(*) AS n FROM c GROUP BY 1),
j AS (SELECT coalesce(t.o_orderkey, one.o_orderkey) AS k, t.o_orderstatus AS s, t.o_totalprice AS p, t.worker AS w, price, one.worker AS nw, n, CASE WHEN n > 1 THEN 'ambiguous' WHEN n IS NULL THEN 'keep'
    WHEN t.o_orderkey IS NULL THEN CASE WHEN one.worker <> 'w2' THEN 'insert' ELSE 'refused' END WHEN s = 'P' THEN 'delete' WHEN s = 'O' AND w = nw THEN 'update' ELSE 'refused' END AS a
  FROM t FULL JOIN one USING (o_orderkey))
SELECT 'row' AS kind, k AS o_orderkey, CASE a WHEN 'insert' THEN 'new' WHEN 'update' THEN 'F' ELSE s END AS what, round(CASE WHEN a IN ('insert', 'update') THEN price ELSE p END, 2)::DOUBLE AS o_totalprice FROM j WHERE a <> 'delete' AND NOT (p IS NULL AND a <> 'insert')
UNION ALL SELECT 'change', c.o_orderkey, a, NULL FROM c JOIN j ON k = c.o_orderkey
""")
def guarded_merge(spark, sf_dir):
    """A merge that updates only rows which are open and held by the same worker, deletes, inserts, and tells what it
    refused; its tables are written as one snapshot and read back."""
    orders = read(spark, sf_dir, "orders")
    table = orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.concat(F.lit("w"), F.col("o_orderkey") % 3).alias("worker"))
    worker = F.concat(F.lit("w"), F.col("o_custkey") % 3).alias("worker")
    price = lambda v: F.lit(v).cast("double").alias("o_totalprice")
    changes = orders.where("o_orderkey % 4 <> 3").select("o_orderkey", (F.col("o_totalprice") + 1).cast("double").alias("o_totalprice"), worker).unionByName(
        orders.where("o_orderkey % 40 = 1").select("o_orderkey", price(0), F.lit("w0").alias("worker"))).unionByName(orders.where("o_orderkey % 5 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), price(7), worker))
    clauses = [merge.Clause(merge.MATCHED, "delete", F.col("old.o_orderstatus") == "P"),
               merge.Clause(merge.MATCHED, "update", (F.col("old.o_orderstatus") == "O") & (F.col("old.worker") == F.col("new.worker")), {"o_orderstatus": F.lit("F")}),
               merge.Clause(merge.NEW, "insert", F.col("new.worker") != "w2", {"o_orderstatus": F.lit("new")})]
    result, outcome = merge.merge(table, changes, "o_orderkey", clauses)
    path = shared_folder(spark, "snapshot")
    merge.commit_snapshot({"orders": result, "outcome": outcome}, path, merge.read_snapshot(spark, path)[0])
    _, tables = merge.read_snapshot(spark, path)
    rows = tables["orders"].select(F.lit("row").alias("kind"), "o_orderkey", F.col("o_orderstatus").alias("what"), F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"))
    return rows.unionByName(tables["outcome"].select(F.lit("change").alias("kind"), "o_orderkey", F.col("action").alias("what"), F.lit(None).cast("double").alias("o_totalprice")))


@query("""
WITH ops AS (SELECT user_id AS subject, 'tags' AS field, event_id AS seq, CASE event_type WHEN 'view' THEN 'add' WHEN 'purchase' THEN 'add' WHEN 'click' THEN 'remove' ELSE 'set' END AS op,
  ['t' || (event_id % 7), 't' || (event_id % 5)] AS vals FROM events WHERE event_type <> 'error' AND (event_type <> 'signup' OR event_id % 9 = 0)),
s AS (SELECT subject, max(seq) AS s FROM ops WHERE op = 'set' GROUP BY 1),
e AS (SELECT subject, seq, op, coalesce(s, -1) AS s, unnest(vals) AS v FROM ops LEFT JOIN s USING (subject)),
k AS (SELECT subject, v, max(seq) FILTER (WHERE (op = 'add' AND seq > s) OR (op = 'set' AND seq = s)) AS a, max(seq) FILTER (WHERE op = 'remove') AS r FROM e GROUP BY 1, 2),
l AS (SELECT subject, string_agg(v, ',' ORDER BY v) AS vals FROM k WHERE a IS NOT NULL AND a > coalesce(r, -2) GROUP BY 1)
SELECT subject, 'tags' AS field, coalesce(vals, '') AS vals FROM (SELECT DISTINCT subject FROM ops) LEFT JOIN l USING (subject)
""")
def override_replay(spark, sf_dir):
    events = read(spark, sf_dir, "events").where("event_type <> 'error' AND (event_type <> 'signup' OR event_id % 9 = 0)")
    op = F.when(F.col("event_type").isin("view", "purchase"), "add").when(F.col("event_type") == "click", "remove").otherwise("set")
    values = F.array(*(F.concat(F.lit("t"), (F.col("event_id") % m).cast("string")) for m in (7, 5)))
    ops = events.select(F.col("user_id").alias("subject"), F.lit("tags").alias("field"), F.col("event_id").alias("seq"), op.alias("op"), values.alias("values"), F.lit(None).cast("string").alias("scalar"))
    return overrides.replay_lists(ops).select("subject", "field", F.array_join("values", ",").alias("vals"))


@query("SELECT user_id AS subject, event_type AS field, max_by(value, event_id)::VARCHAR AS scalar FROM events GROUP BY ALL")
def last_write_wins(spark, sf_dir):
    ops = read(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"), F.lit("set").alias("op"), F.col("value").cast("string").alias("scalar"))
    return overrides.replay_scalars(ops)


@query("""
SELECT doc_id, CASE WHEN c < 0.65 THEN 'high' WHEN c < 0.80 THEN 'normal' END AS band FROM (SELECT doc_id, (doc_id * 37 % 100) / 100.0::DOUBLE AS c FROM labels)
""")
def confidence_bands(spark, sf_dir):
    return read(spark, sf_dir, "labels").select("doc_id", review.confidence_band((F.col("doc_id") * 37 % 100) / 100.0).alias("band"))


@query("SELECT doc_id FROM labels WHERE ('0x' || substr(sha256('run1' || chr(0) || doc_id), 1, 8))::BIGINT % 10000 < 2500")
def hash_sample(spark, sf_dir):
    return read(spark, sf_dir, "labels").where(review.hash_sample(F.lit("run1"), F.col("doc_id"), 25)).select("doc_id")


_TASKS_SQL = """
found AS (SELECT doc_id::VARCHAR AS target_id, CASE WHEN quality = 0 THEN 'low_quality' ELSE 'toxic' END AS reason_code, CASE WHEN quality = 0 THEN 'high' ELSE 'normal' END AS severity
  FROM labels WHERE quality = 0 OR toxic = 1),
tasks AS (SELECT DISTINCT 'review_' || substr(sha256('{"dedupe_key":null,"reason_code":"' || reason_code || '","severity":"' || severity || '","target_id":"' || target_id || '","target_type":"document"}'), 1, 32) AS review_id, 'document' AS target_type, target_id, reason_code, severity, 'open' AS status FROM found)
"""


def _tasks(spark, sf_dir):
    found = read(spark, sf_dir, "labels").where("quality = 0 or toxic = 1")
    low = F.col("quality") == 0
    return review.review_tasks(found, "document", "doc_id", F.when(low, "low_quality").otherwise("toxic"), F.when(low, "high").otherwise("normal"))


@query(f"WITH {_TASKS_SQL} SELECT * FROM tasks WHERE target_id NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE doc_id % 3 = 0)")
def review_tasks(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    return review.insert_new(tasks, tasks.where("cast(target_id as bigint) % 3 = 0"))


@query(f"WITH {_TASKS_SQL} SELECT review_id, target_id, severity FROM tasks ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, target_id::BIGINT, review_id LIMIT 50")
def review_queue(spark, sf_dir):
    return review.review_queue(_tasks(spark, sf_dir).withColumn("created_at", F.col("target_id").cast("long"))).select("review_id", "target_id", "severity")


@query(f"""
WITH {_TASKS_SQL} SELECT review_id, CASE WHEN reason_code = 'low_quality' AND target_id::BIGINT IN (SELECT doc_id FROM documents WHERE n_chars > 1500) THEN 'resolved' ELSE 'open' END AS status FROM tasks
""")
def reconcile_tasks(spark, sf_dir):
    done = read(spark, sf_dir, "documents").where("n_chars > 1500").select(F.col("doc_id").alias("target_id"))
    return review.reconcile(_tasks(spark, sf_dir), {"low_quality": done}).select("review_id", "status")


@query("""
SELECT printf('ai_batch_%04d', (rn - 1) // 12) AS batch_key, string_agg(p_partkey, ',' ORDER BY p_partkey) AS members
FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part WHERE p_size > 10) GROUP BY 1
""")
def fixed_batches(spark, sf_dir):
    rows = read(spark, sf_dir, "part").where("p_size > 10")
    return lineage.fixed_batches(rows, "p_partkey").select("batch_key", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


# Jobs made from events; the text is read by Spark and by DuckDB.
_JOBS = """
SELECT concat('run', user_id % 5) AS run_id, concat('c', user_id % 5) AS effective_config_hash, concat('j', event_id) AS job_id, CASE WHEN event_id % 11 = 0 THEN 'VALIDATE' ELSE 'AI_ANNOTATE' END AS stage,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'needs_review' ELSE 'succeeded' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'PROVIDER_TIMEOUT' WHEN 1 THEN 'PROVIDER_AUTH_FAILED' WHEN 2 THEN 'PROVIDER_STORAGE_UNSUPPORTED' END AS error_code,
  CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN concat('k', event_id - 2, ':retry:0123abcd') ELSE concat('k', event_id) END AS logical_key,
  concat('s', event_id * 31) AS input_signature, CASE WHEN event_type = 'click' THEN concat('j', event_id - 1) END AS retry_of_job_id
FROM {events}
"""
_WAVE = f"""
jobs AS ({_JOBS.format(events="events")}), own AS (SELECT * FROM jobs WHERE stage = 'AI_ANNOTATE'),
open AS (SELECT * FROM own j WHERE status IN ('failed', 'needs_review') AND coalesce(error_code, '') <> 'PROVIDER_AUTH_FAILED'
  AND NOT EXISTS (SELECT 1 FROM own k WHERE k.run_id = j.run_id AND k.retry_of_job_id = j.job_id)
  AND NOT EXISTS (SELECT 1 FROM own k WHERE k.run_id = j.run_id AND split_part(k.logical_key, ':retry:', 1) = j.logical_key AND contains(k.logical_key, ':retry:'))),
nonces AS (SELECT *, 'sha256:' || sha256(job_id || chr(0) || input_signature) AS nonce FROM open),
wave AS (SELECT run_id, effective_config_hash, job_id AS source_job_id, logical_key AS source_logical_key, input_signature AS source_input_signature, logical_key || ':retry:' || substr(nonce, 8, 8) AS logical_key,
  'sha256:' || sha256(input_signature || chr(0) || nonce) AS child_input_signature FROM nonces),
children AS (SELECT *, 'job_' || substr(sha256(run_id || chr(0) || logical_key || chr(0) || child_input_signature), 1, 32) AS child_job_id FROM wave)
"""


def _jobs(spark, sf_dir):
    return spark.sql(_JOBS, events=read(spark, sf_dir, "events"))


@query(f"""
WITH jobs AS ({_JOBS.format(events="events")})
SELECT run_id, 'sha256:' || sha256('{{"effective_config_hash":"' || max(effective_config_hash) || '","jobs":[' || string_agg('{{"job_id":"' || job_id || '","logical_key":"' || logical_key
  || '","recomputed_payload_signature":"' || input_signature || '"}}', ',' ORDER BY logical_key, job_id) || '],"run_id":"' || run_id || '"}}') AS plan_hash FROM jobs GROUP BY run_id
""")
def plan_hash(spark, sf_dir):
    return lineage.plan_hash(_jobs(spark, sf_dir).withColumn("recomputed_payload_signature", F.col("input_signature")))


@query(f"""
WITH {_WAVE}
SELECT run_id, 'sha256:' || sha256('{{"effective_config_hash":"' || max(effective_config_hash) || '","jobs":[' || string_agg('{{"child_input_signature":"' || child_input_signature || '","child_job_id":"' || child_job_id
  || '","source_input_signature":"' || source_input_signature || '","source_job_id":"' || source_job_id || '"}}', ',' ORDER BY source_logical_key, source_job_id) || '],"run_id":"' || run_id || '"}}') AS wave_hash FROM children GROUP BY run_id
""")
def wave_hash(spark, sf_dir):
    return lineage.wave_hash(lineage.retry_wave(_jobs(spark, sf_dir)))


@query(f"WITH {_WAVE} SELECT run_id, source_job_id, logical_key, child_input_signature, child_job_id FROM children")
def retry_wave(spark, sf_dir):
    return lineage.retry_wave(_jobs(spark, sf_dir)).select("run_id", "source_job_id", "logical_key", "child_input_signature", "child_job_id")


@query(f"""
WITH jobs AS ({_JOBS.format(events="events")})
SELECT job_id, CASE WHEN error_code = 'PROVIDER_AUTH_FAILED' THEN 'fatal' ELSE 'item_local' END AS class FROM jobs
""")
def error_classes(spark, sf_dir):
    return _jobs(spark, sf_dir).select("job_id", lineage.error_class(F.col("error_code")).alias("class"))


@query(f"""
WITH jobs AS ({_JOBS.format(events="events")})
SELECT DISTINCT run_id, stage, job_id FROM jobs WHERE status = 'needs_review' AND (run_id, stage) NOT IN (SELECT run_id, stage FROM jobs WHERE status = 'failed' AND job_id LIKE '%7')
""")
def no_active_work(spark, sf_dir):
    status = F.when(F.col("status") == "needs_review", "pending").when((F.col("status") == "failed") & F.col("job_id").endswith("7"), "running").otherwise("done")
    return lineage.no_active_sibling(_jobs(spark, sf_dir).withColumn("status", status)).select("run_id", "stage", "job_id")


@query("SELECT doc_id FROM documents WHERE n_chars % 4 <> 0")
def changed_inputs(spark, sf_dir):
    now = read(spark, sf_dir, "documents").select("doc_id", "n_chars", lineage.input_signature(F.col("text"), F.col("lang")).alias("signature"))
    done = now.where("n_chars % 4 = 0").select("doc_id", "signature")
    return lineage.changed_inputs(now, done, "doc_id", "signature").select("doc_id")


@query("SELECT event_type AS stage, o AS status, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 10 THEN 'done' ELSE 'pending' END AS o FROM events) GROUP BY GROUPING SETS ((event_type, o), (o), ())")
def status_grouping_sets(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") > 10, "done").otherwise("pending").alias("status"))
    return progress.stage_status_counts(events)


@query("""
SELECT event_type AS stage, count(*) FILTER (WHERE value > 10) AS completed, count(*) AS total, round_even(100.0 * count(*) FILTER (WHERE value > 10) / count(*), 0)::DOUBLE AS percent FROM events GROUP BY GROUPING SETS ((event_type), ())
""")
def stage_progress(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.when(F.col("value") > 10, "succeeded").otherwise("pending").alias("status"))
    return progress.stage_progress(events)


@query("""
SELECT * FROM (SELECT 'open' AS reason, count(*) FILTER (WHERE o_orderstatus = 'O') AS count FROM orders UNION ALL SELECT 'urgent', count(*) FILTER (WHERE o_orderpriority = '1-URGENT') FROM orders
UNION ALL SELECT 'none', count(*) FILTER (WHERE o_totalprice < 0) FROM orders) WHERE count > 0
""")
def exclusion_summary(spark, sf_dir):
    from tessera.operators.search import exclusion_summary as summary

    return summary({"open": F.count_if(F.col("o_orderstatus") == "O"), "urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT"), "none": F.count_if(F.col("o_totalprice") < 0)}, read(spark, sf_dir, "orders"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return progress.latest_per_key(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("SELECT event_id, event_type FROM (SELECT * FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 8) WHERE event_type IN ('view', 'click')")
def latest_events(spark, sf_dir):
    return progress.latest_events(read(spark, sf_dir, "events"), F.col("user_id") == 7, ["view", "click"], time="ts").select("event_id", "event_type")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{text.SENSITIVE}')")
def sensitive_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(text.sensitive(F.col("text"))).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN NOT regexp_matches(text, '{text.SENSITIVE}') THEN substr(text, 1, 512) END AS text FROM documents")
def bounded_redaction(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


def _nested(rows, *more):
    """Each document's text within lists and structs, beside keys that may not leave."""
    deep = F.struct(F.struct(F.struct(F.struct(F.lit(1).alias("e")).alias("d"), F.lit(2).alias("f")).alias("c")).alias("b"))
    fields = [F.col("n_chars").alias("z"), F.concat(F.lit("m:"), "doc_id").alias("variant_id"), F.lit("p").alias("image_path"), F.lit("k").alias("API-Key"),
              F.lit("v").alias("token_count"), F.array("text", F.lit("plain")).alias("kept"), deep.alias("deep"), *more]
    return rows.select("doc_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


_SENSITIVE_TEXT = f"coalesce(regexp_matches(text, '{text.SENSITIVE}'), false)"


@query(f"""
SELECT doc_id, '{{"variant_id":"m:' || doc_id || '","deep":{{"b":{{"c":{{"f":2}}}}}},"kept":[' || CASE WHEN text IS NULL THEN 'null,' WHEN {_SENSITIVE_TEXT} THEN '' ELSE to_json(substr(text, 1, 512)) || ',' END || '"plain"],"z":' || n_chars || '}}' AS json FROM documents
""")
def nested_redaction(spark, sf_dir):
    """Bounded copies of nested JSON: depth, sensitive keys and texts, identifiers first."""
    return _nested(read(spark, sf_dir, "documents")).select("doc_id", nested.redact_json(F.col("json")).alias("json"))


@query(f"""
SELECT doc_id, {_SENSITIVE_TEXT} AS sensitive, CASE doc_id % 4 WHEN 0 THEN 'shape' WHEN 1 THEN 'image_path' ELSE '' END AS fields,
  '{{"created_at":"new","items":[{{"export_id":"e$1","n":1}},[{{"created_at":"new"}}]]}}' AS lineage FROM documents
""")
def nested_screens(spark, sf_dir):
    """Sensitive strings and forbidden keys at any depth, and lineage that is rewritten at any depth."""
    n = F.col("doc_id")
    name = F.when(n % 4 == 0, "set_add_shape").when(n % 4 == 1, "image_path").otherwise("add_note")
    level = F.concat(F.lit('{"'), name, F.lit('":'), F.to_json(F.array("text"), {"ignoreNullFields": "false"}), F.lit("}"))
    for i in range(9):
        level = F.concat(F.lit(f'[{i},{{"k{i}":'), level, F.lit("}]"))
    old = F.lit('{"items": [{"export_id": "old, \\" one", "n": 1}, [{"created_at": 7}]], "created_at": null}')
    made = nested.rewrite_json(old, {"export_id": F.lit("e$1"), "created_at": F.lit("new"), "producer_version": F.lit(None).cast("string")})
    return read(spark, sf_dir, "documents").select("doc_id", nested.sensitive_json(level).alias("sensitive"), F.array_join(nested.forbidden_keys(level), ",").alias("fields"), made.alias("lineage"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (props->>'$.k')::BIGINT END AS k, CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'bad_json' ELSE 'not_object' END END AS error FROM events
""")
def json_tolerant_scan(spark, sf_dir):
    broken = F.when(F.col("event_id") % 10 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    lines = read(spark, sf_dir, "events").select("event_id", broken.alias("value"))
    return records.parse_jsonl(lines, "k long").select("event_id", "k", "error")


@query("""
SELECT * FROM (
SELECT 'REGISTRY_COVERAGE_100' AS gate, count(*) AS observed FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)
UNION ALL SELECT 'LEGAL_STATE_VALID', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber = 1) <> 1)
UNION ALL SELECT 'NO_FALSE_IDS', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'HIGH_REVIEW_ZERO', count(*) FROM labels WHERE quality = 0)
""")
def gate_violation_counts(spark, sf_dir):
    """Violations of four gates over whole tables."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    lines = read(spark, sf_dir, "lineitem")
    report = release.quality_report({
        "REGISTRY_COVERAGE_100": read(spark, sf_dir, "nation").select("n_nationkey").join(customers, "n_nationkey", "left_anti"),
        "LEGAL_STATE_VALID": integrity.exactly_one(lines, "l_orderkey", F.col("l_linenumber") == 1, "l_partkey"),
        "NO_FALSE_IDS": integrity.orphans(lines, read(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey"),
        "HIGH_REVIEW_ZERO": read(spark, sf_dir, "labels").where("quality = 0")})
    return report.select("gate", "observed")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 300 SECOND")
def stale_heartbeats(spark, sf_dir):
    jobs = read(spark, sf_dir, "events").withColumns({"status": F.when(F.col("event_type") == "view", "running").otherwise("done"), "heartbeat_at": F.col("ts")})
    return monitor.stale_heartbeats(jobs, "2024-01-20 00:00:00").select("event_id", "user_id")


@query("""
SELECT user_id, previous, event_type AS status, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
WHERE previous IS NOT NULL AND previous <> event_type AND previous || '>' || event_type NOT IN ('signup>view', 'view>click', 'click>purchase', 'view>error', 'error>view', 'purchase>view')
""")
def invalid_transitions(spark, sf_dir):
    legal = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "error"), ("error", "view"), ("purchase", "view")]
    events = read(spark, sf_dir, "events").withColumn("status", F.col("event_type"))
    return monitor.invalid_transitions(events, "user_id", "status", ["ts", "event_id"], legal).select("user_id", "previous", "status", "event_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf_dir):
    return monitor.windowed_counts(read(spark, sf_dir, "events"), "ts", "1 day", "event_type")


@query("SELECT event_type AS status, count(*) AS n FROM (SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1) GROUP BY 1")
def stream_status_counts(spark, sf_dir):
    return monitor.status_counts(read(spark, sf_dir, "events").withColumn("status", F.col("event_type")), "user_id", "status", "event_id")
