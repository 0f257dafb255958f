"""The export's rule catalogue, review routing and release gates over tables made from the driver's.

The made tables are SQL texts that Spark and DuckDB both read: blocks from parts, states from line
items, variants and manual records from parts, failures and annotations from events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import diff, export_rules, integrity, lineage, overrides, projections, release, review, search
from tessera.operators.schema_rules import Rule, violations
from tessera.plans.registry import query, read
from tessera.sources.shared import small_tasks, stored

_BLOCK_ID = "CASE WHEN p_partkey % 101 = 100 THEN concat('Bad Id ', p_partkey) WHEN p_partkey % 103 = 102 THEN 'm:p0' ELSE concat('m:p', p_partkey) END"
BLOCKS = f"""SELECT p_partkey AS n, {_BLOCK_ID} AS block_id, CASE WHEN p_partkey % 97 = 96 THEN 'other' ELSE 'e' END AS export_id, concat('m:p', p_partkey, '[k=', p_size % 7, ']') AS default_state_id,
  p_partkey % 10 < 8 AS chosen FROM {{part}}"""
STATES = """SELECT DISTINCT l_partkey AS n, l_linenumber AS k, CASE WHEN l_partkey % 89 = 88 THEN concat('m:p', l_partkey, '[j=', l_linenumber, ']') ELSE concat('m:p', l_partkey, '[k=', l_linenumber, ']') END AS state_id,
  CASE WHEN (l_partkey * 7 + l_linenumber) % 113 = 112 THEN 'm:none' ELSE concat('m:p', l_partkey) END AS block_id, l_linenumber = p_size % 7 OR (l_partkey % 41 = 40 AND l_linenumber = 2) AS is_default,
  CASE WHEN (l_partkey % 10 < 8) <> ((l_partkey + l_linenumber) % 61 = 60) THEN 'mapped' ELSE 'skipped' END AS mapping_status,
  CASE WHEN (l_partkey + l_linenumber) % 73 = 72 THEN NULL WHEN (l_partkey + l_linenumber) % 71 = 70 THEN 'm:p1' WHEN l_partkey % 10 < 8 THEN concat('m:p', l_partkey) END AS variant_ref
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
VARIANTS = f"""SELECT p_partkey AS n, CASE WHEN p_partkey % 107 = 106 THEN concat('m:odd', p_partkey) ELSE {_BLOCK_ID} END AS variant_id, {_BLOCK_ID} AS block_id,
  CASE WHEN p_partkey % 10 < 8 THEN 'selected' ELSE 'skipped' END AS status, CASE WHEN p_partkey % 109 <> 108 THEN concat('m:p', p_partkey, '[k=', p_size % 7, ']') END AS canonical_state_id,
  CASE p_partkey % 3 WHEN 0 THEN 'eligible' WHEN 1 THEN 'conditional' ELSE 'excluded' END AS candidate_qualification, concat('a', p_partkey * 3) AS annotation_ref, concat('r', p_partkey) AS review_ref
FROM {{part}} WHERE p_partkey % 83 <> 82 AND p_partkey % 103 <> 102"""
FAILURES = """SELECT concat('f', event_id) AS failure_id, CASE event_type WHEN 'view' THEN 'variant' WHEN 'click' THEN 'state' WHEN 'purchase' THEN 'render' WHEN 'signup' THEN 'block' ELSE 'export' END AS scope,
  event_id AS ordinal, concat('m:p', (event_id * 13) % 2200) AS block_id, concat('m:p', (event_id * 13 + CASE WHEN event_id % 37 = 36 THEN 1 ELSE 0 END) % 2200, '[k=', 1 + event_id % 7, ']') AS state_id,
  concat('m:p', (event_id * 13 + CASE WHEN event_id % 31 = 30 THEN 1 ELSE 0 END) % 2200) AS variant_id, CASE WHEN event_id % 5 <> 4 THEN 'TIMEOUT' END AS reason_code FROM {events}"""
ANNOTATIONS = """SELECT concat('a', event_id) AS annotation_id, concat('m:p', event_id % 2100) AS subject_id, event_id % 4 <> 0 AS verified, props AS record_json FROM {events}"""
REVIEWS = """SELECT concat('r', p_partkey) AS review_id, concat('m:p', p_partkey + CASE WHEN p_partkey % 29 = 28 THEN 1 ELSE 0 END) AS target_id, CASE WHEN p_partkey % 5 = 4 THEN 'eligible' ELSE 'excluded' END AS qualification,
  concat('f', p_partkey * 3) AS failure_ref FROM {part}"""
MANUAL = """SELECT CASE p_partkey % 4 WHEN 0 THEN 'manual-override.v1' WHEN 1 THEN 'skip-review.v1' WHEN 2 THEN 'qualification-review.v1' ELSE CASE WHEN p_partkey % 19 = 0 THEN 'unknown.v1' ELSE 'manual-override.v1' END END AS schema_id,
  concat('r', p_partkey) AS record_id, CASE WHEN p_partkey % 23 = 22 THEN 'm:none' WHEN p_partkey % 17 = 16 THEN concat('m:p', p_partkey, '[k=1]') ELSE concat('m:p', p_partkey) END AS target_id,
  concat('f', p_partkey * 3) AS failure_ref, CASE WHEN p_partkey % 53 = 52 THEN 'the password is here' ELSE p_name END AS note FROM {part}"""
_NAMES = {n: n for n in ("part", "lineitem", "events", "orders", "documents")}
_MADE = {"blocks": BLOCKS, "states": STATES, "variants": VARIANTS, "failures": FAILURES, "annotations": ANNOTATIONS, "reviews": REVIEWS, "manual": MANUAL}
_CTE = "WITH " + ",\n".join(f"{n} AS ({t.format(**_NAMES)})" for n, t in _MADE.items())


def _made(spark, sf_dir, name):
    text = _MADE[name]
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in _NAMES if f"{{{t}}}" in text})


def _blocks(spark, sf_dir):
    return _made(spark, sf_dir, "blocks")


def _states(spark, sf_dir):
    refs = F.array_compact(F.array("variant_ref"))
    return _made(spark, sf_dir, "states").withColumns({"properties": F.create_map(F.lit("k"), F.col("k").cast("string")), "variant_ids": refs})


def _variants(spark, sf_dir):
    """Variants with the states of their part as represented ones, some without the first."""
    own = _states(spark, sf_dir).where("not (n % 59 = 58 and k = 1)").groupBy("n").agg(F.array_sort(F.collect_set("state_id")).alias("represented_state_ids"))
    rows = _made(spark, sf_dir, "variants")
    refs = {"annotation_refs": F.when(F.col("n") % 6 != 5, F.array("annotation_ref")).otherwise(F.array().cast("array<string>")), "qualification_review_refs": F.when(F.col("n") % 7 != 6, F.array("review_ref")).otherwise(F.array().cast("array<string>")),
            "override_refs": F.when(F.col("n") % 13 != 12, F.array("review_ref")).otherwise(F.array().cast("array<string>"))}
    twice = F.explode(F.when(F.col("n") % 79 == 78, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.join(own, "n", "left").withColumns(refs).withColumn("copy", twice).drop("copy")


def _failures(spark, sf_dir):
    rows = _made(spark, sf_dir, "failures")
    return rows.withColumn("state_id", F.when(F.col("scope") == "state", F.col("state_id"))).withColumn("variant_id", F.when(F.col("scope").isin("variant", "render"), F.col("variant_id")))


_COPIES = "twice AS (SELECT v.* FROM variants v UNION ALL SELECT * FROM variants WHERE n % 79 = 78)"


@query(_CTE + f""", {_COPIES}, ids AS (SELECT DISTINCT block_id FROM blocks)
SELECT 'BLOCK_ID_INVALID' AS code, block_id AS subject, NULL::VARCHAR AS detail FROM blocks WHERE NOT regexp_matches(block_id, '^[a-z0-9_.-]+:[a-z0-9_./-]+$')
UNION ALL SELECT 'BLOCK_ID_DUPLICATE', block_id, NULL FROM blocks GROUP BY block_id HAVING count(*) > 1
UNION ALL SELECT 'STATE_ID_DUPLICATE', state_id, NULL FROM states GROUP BY state_id HAVING count(*) > 1
UNION ALL SELECT 'VARIANT_ID_DUPLICATE', variant_id, NULL FROM twice GROUP BY variant_id HAVING count(*) > 1
UNION ALL SELECT 'STATE_BLOCK_REFERENCE_INVALID', state_id, block_id FROM states WHERE block_id NOT IN (FROM ids)
UNION ALL SELECT 'VARIANT_BLOCK_REFERENCE_INVALID', variant_id, block_id FROM twice WHERE block_id NOT IN (FROM ids)
UNION ALL SELECT 'VARIANT_ID_BLOCK_MISMATCH', variant_id, block_id FROM twice WHERE variant_id <> block_id
UNION ALL SELECT 'STATE_CANONICAL_ID_INVALID', state_id, block_id || '[k=' || k || ']' FROM states WHERE block_id || '[k=' || k || ']' <> state_id
""")
def export_record_issues(spark, sf_dir):
    return export_rules.record_issues(_blocks(spark, sf_dir), _states(spark, sf_dir), _variants(spark, sf_dir))


@query(_CTE + f""", {_COPIES}, ws AS (SELECT b.* FROM blocks b WHERE block_id IN (SELECT block_id FROM states)),
own AS (SELECT s.* FROM states s WHERE block_id IN (SELECT block_id FROM ws)), mapped AS (SELECT * FROM own WHERE mapping_status = 'mapped'),
counts AS (SELECT block_id, count(*) AS n FROM twice GROUP BY 1),
first AS (SELECT w.block_id, w.default_state_id, f.variant_id, f.status, f.canonical_state_id, f.n FROM ws w JOIN (SELECT block_id, min_by(variant_id, variant_id) AS variant_id, min_by(status, variant_id) AS status, min_by(canonical_state_id, variant_id) AS canonical_state_id, min_by(n, variant_id) AS n FROM twice GROUP BY 1) f USING (block_id)),
sel AS (SELECT * FROM first WHERE status = 'selected'), oth AS (SELECT * FROM first WHERE status <> 'selected'),
said AS (SELECT DISTINCT sel.block_id, s.state_id FROM sel JOIN states s ON s.n = sel.n WHERE NOT (s.n % 59 = 58 AND s.k = 1)), really AS (SELECT DISTINCT block_id, state_id FROM own WHERE block_id IN (SELECT block_id FROM sel)),
defaults AS (SELECT block_id, count(*) FILTER (WHERE is_default) AS n, max(state_id) FILTER (WHERE is_default) AS state_id FROM own GROUP BY 1)
SELECT 'BLOCK_HAS_NO_STATES' AS code, block_id AS subject, NULL::VARCHAR AS detail FROM blocks WHERE block_id NOT IN (SELECT block_id FROM states)
UNION ALL SELECT 'DEFAULT_STATE_NOT_LEGAL', block_id, default_state_id FROM ws WHERE (block_id, default_state_id) NOT IN (SELECT block_id, state_id FROM states)
UNION ALL SELECT 'DEFAULT_STATE_UNIQUE_INVALID', d.block_id, d.n::VARCHAR FROM defaults d LEFT JOIN ws ON ws.block_id = d.block_id WHERE d.n <> 1 OR d.state_id IS DISTINCT FROM ws.default_state_id
UNION ALL SELECT 'BLOCK_VARIANT_COUNT_INVALID', ws.block_id, c.n::VARCHAR FROM ws LEFT JOIN counts c USING (block_id) WHERE coalesce(c.n, 0) <> 1
UNION ALL SELECT 'MAPPED_STATE_WITHOUT_VARIANT', state_id, NULL FROM mapped WHERE variant_ref IS NULL
UNION ALL SELECT 'STATE_VARIANT_REFERENCE_INVALID', state_id, variant_ref FROM mapped WHERE variant_ref IS NOT NULL AND (variant_ref, block_id) NOT IN (SELECT variant_id, block_id FROM twice)
UNION ALL SELECT 'SKIPPED_STATE_HAS_VARIANT', state_id, NULL FROM own WHERE mapping_status = 'skipped' AND variant_ref IS NOT NULL
UNION ALL SELECT DISTINCT 'REPRESENTED_STATE_SET_INVALID', block_id, NULL FROM ((FROM said EXCEPT FROM really) UNION (FROM really EXCEPT FROM said))
UNION ALL SELECT 'REPRESENTATIVE_NOT_DEFAULT', block_id, canonical_state_id FROM sel WHERE canonical_state_id IS DISTINCT FROM default_state_id
UNION ALL SELECT 'SELECTED_STATE_MAPPING_INVALID', state_id, NULL FROM own JOIN sel USING (block_id) WHERE NOT coalesce(mapping_status = 'mapped' AND variant_ref = variant_id, false)
UNION ALL SELECT 'SKIPPED_VARIANT_FAILURE_MISSING', variant_id, NULL FROM oth WHERE variant_id NOT IN (SELECT variant_id FROM failures WHERE scope IN ('variant', 'render'))
UNION ALL SELECT 'SKIPPED_BLOCK_STATE_MAPPING_INVALID', state_id, NULL FROM own WHERE block_id IN (SELECT block_id FROM oth) AND NOT (mapping_status = 'skipped' AND variant_ref IS NULL)
""")
def export_mapping_issues(spark, sf_dir):
    """The made tables are written once and read by all rules."""
    states = stored(_states(spark, sf_dir), "states")
    return export_rules.mapping_issues(_blocks(spark, sf_dir), states, stored(_variants(spark, sf_dir), "variants"), _failures(spark, sf_dir))


@query(_CTE + """, sc AS (SELECT * FROM failures WHERE scope <> 'export'), st AS (SELECT * FROM sc WHERE scope = 'state'), va AS (SELECT * FROM sc WHERE scope IN ('variant', 'render'))
SELECT 'FAILURE_BLOCK_REFERENCE_INVALID' AS code, failure_id AS subject, block_id AS detail FROM sc WHERE block_id NOT IN (SELECT block_id FROM blocks)
UNION ALL SELECT 'FAILURE_STATE_REFERENCE_INVALID', failure_id, state_id FROM st WHERE state_id NOT IN (SELECT state_id FROM states)
UNION ALL SELECT 'FAILURE_STATE_BLOCK_MISMATCH', failure_id, st.state_id FROM st JOIN states s ON s.state_id = st.state_id WHERE s.block_id <> st.block_id
UNION ALL SELECT 'FAILURE_VARIANT_REFERENCE_INVALID', failure_id, variant_id FROM va WHERE variant_id NOT IN (SELECT variant_id FROM variants)
UNION ALL SELECT 'FAILURE_VARIANT_BLOCK_MISMATCH', failure_id, va.variant_id FROM va JOIN variants v ON v.variant_id = va.variant_id WHERE v.block_id <> va.block_id
UNION ALL SELECT 'FAILURE_RENDER_TARGET_NOT_SELECTED', failure_id, variant_id FROM va WHERE scope = 'render' AND variant_id NOT IN (SELECT variant_id FROM variants WHERE status = 'selected')
""")
def export_failure_issues(spark, sf_dir):
    return export_rules.failure_issues(_blocks(spark, sf_dir), _states(spark, sf_dir), _made(spark, sf_dir, "variants"), _failures(spark, sf_dir))


@query(_CTE + """, registry AS (SELECT count(*) AS n, 'sha256:' || sha256(string_agg(block_id, chr(10) ORDER BY block_id)) AS h FROM (SELECT DISTINCT block_id FROM blocks WHERE regexp_matches(block_id, '^[a-z0-9_.-]+:[a-z0-9_./-]+$')))
SELECT 'REGISTRY_SNAPSHOT_HASH_MISMATCH' AS code, 'registry_snapshot_sha256' AS subject, NULL::VARCHAR AS detail
UNION ALL SELECT 'REGISTRY_COUNT_MISMATCH', 'registry_blocks', n::VARCHAR FROM registry WHERE n <> (SELECT count(*) FROM part)
UNION ALL SELECT 'MANIFEST_COUNT_MISMATCH', 'state_records', count(*)::VARCHAR FROM states
UNION ALL SELECT 'MANIFEST_COUNT_MISMATCH', 'pending_review_records', (count(*) FILTER (WHERE event_id % 6 = 0))::VARCHAR FROM events
UNION ALL SELECT 'EXPORT_ID_MISMATCH', block_id, export_id FROM blocks WHERE export_id <> 'e'
""")
def export_manifest_issues(spark, sf_dir):
    """A manifest with another hash, no pending reviews and one state too few."""
    part = read(spark, sf_dir, "part").agg(F.count("*").alias("parts"), F.count_if(F.expr("p_partkey % 83 <> 82 AND p_partkey % 103 <> 102 AND p_partkey % 10 < 8")).alias("selected"), F.count_if(F.expr("p_partkey % 83 <> 82 AND p_partkey % 103 <> 102 AND p_partkey % 10 >= 8")).alias("skipped"))
    numbers = part.join(_states(spark, sf_dir).agg((F.count("*") - 1).alias("states"))).join(read(spark, sf_dir, "events").agg(F.count("*").alias("failures")))
    counts = {"registry_blocks": "parts", "block_records": "parts", "state_records": "states", "selected_variant_records": "selected", "skipped_variant_records": "skipped", "failure_records": "failures"}
    manifest = numbers.select(F.lit("e").alias("export_id"), F.lit("sha256:none").alias("registry_snapshot_sha256"), F.create_map(*(x for k, c in counts.items() for x in (F.lit(k), F.col(c))), F.lit("pending_review_records"), F.lit(0).cast("long")).alias("counts"))
    failures = _failures(spark, sf_dir).withColumns({"export_id": F.lit("e"), "review_status": F.when(F.col("ordinal") % 6 == 0, "pending").otherwise("done")})
    e = lambda name: _made(spark, sf_dir, name).withColumn("export_id", F.lit("e"))
    return export_rules.manifest_issues(manifest, _blocks(spark, sf_dir), e("states"), e("variants"), failures)


FILES = """SELECT p_partkey AS n, p_partkey % 10 < 8 AS chosen, concat('renders/m/p', p_partkey, '/') AS base, concat('sha256:', p_name) AS image_sha256 FROM {part}"""


@query(f"""
WITH f AS ({FILES.format(part="part")}), chosen AS (SELECT * FROM f WHERE chosen),
kinds AS (SELECT unnest(['preview.png', 'mask.png', 'render.json']) AS name),
wanted AS (SELECT n, base || name AS path, name FROM chosen, kinds),
files AS (SELECT base || name AS path, CASE WHEN n % 11 = 0 THEN 'other' ELSE 'h' END AS h, n FROM f, kinds WHERE (chosen OR n % 13 = 0) AND NOT (n % 17 = 0 AND name = 'mask.png') UNION ALL SELECT base || 'extra.bin', 'h', n FROM f WHERE chosen AND n % 19 = 0),
dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS d FROM files), want AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS d FROM wanted)
SELECT 'RENDER_FILE_MISSING' AS code, 'v' || n AS subject, path AS detail FROM wanted WHERE path NOT IN (SELECT path FROM files)
UNION ALL SELECT CASE w.name WHEN 'preview.png' THEN 'PREVIEW_HASH_MISMATCH' WHEN 'mask.png' THEN 'MASK_HASH_MISMATCH' ELSE 'RENDER_METADATA_HASH_MISMATCH' END, 'v' || w.n, w.path FROM wanted w JOIN files f ON f.path = w.path WHERE h <> 'h'
UNION ALL SELECT 'RENDER_FILE_SET_INVALID', d, NULL FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS d, count(DISTINCT path) FILTER (WHERE path IN (SELECT path FROM wanted)) AS good, count(*) FILTER (WHERE path NOT IN (SELECT path FROM wanted)) AS other FROM files GROUP BY 1) WHERE d IN (FROM want) AND (good < 3 OR other > 0)
UNION ALL SELECT 'RENDER_VARIANT_SET_MISMATCH', d, NULL FROM ((FROM dirs EXCEPT FROM want) UNION (FROM want EXCEPT FROM dirs))
UNION ALL SELECT 'RENDER_SKIPPED_DIRECTORY_PRESENT', d, NULL FROM dirs WHERE d IN (SELECT rtrim(base, '/') FROM f WHERE NOT chosen)
""")
def export_render_issues(spark, sf_dir):
    rows = spark.sql(FILES, part=read(spark, sf_dir, "part"))
    variants = rows.select(F.concat(F.lit("v"), "n").alias("variant_id"), F.concat(F.lit("m:p"), "n").alias("block_id"), F.when(F.col("chosen"), "selected").otherwise("skipped").alias("status"),
                           *(F.lit("sha256:h").alias(c) for c in ("image_sha256", "mask_sha256", "render_metadata_sha256")))
    own = rows.where("chosen or n % 13 = 0").select("n", "base", F.explode(F.array(*map(F.lit, export_rules.RENDER_FILES))).alias("name")).where("not (n % 17 = 0 and name = 'mask.png')")
    extra = rows.where("chosen and n % 19 = 0").select(F.concat("base", F.lit("extra.bin")).alias("relative_path"), F.lit("h").alias("sha256"))
    files = own.select(F.concat("base", "name").alias("relative_path"), F.when(F.col("n") % 11 == 0, "other").otherwise("h").alias("sha256")).unionByName(extra)
    return export_rules.render_issues(variants, files)


# One export a customer; a file for each order.
INVENTORY = """SELECT DISTINCT CASE o_custkey % 5 WHEN 0 THEN concat('.c', o_custkey, '.staging') WHEN 1 THEN concat('c', o_custkey) ELSE concat('export_20240101T', lpad(CAST(o_custkey % 1000000 AS VARCHAR(9)), 6, '0'), 'Z') END AS export,
  CASE o_orderkey % 16 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'blocks.jsonl' WHEN 2 THEN 'states.jsonl' WHEN 3 THEN 'variants.jsonl' WHEN 4 THEN 'failures.jsonl' WHEN 5 THEN 'checksums.sha256' WHEN 6 THEN 'exporter.log'
    WHEN 7 THEN 'renders/m/a/preview.png' WHEN 8 THEN 'renders/m/a/mask.png' WHEN 9 THEN 'renders/m/a/notes.txt' WHEN 10 THEN 'notes.txt' WHEN 11 THEN 'assets/x.png' WHEN 12 THEN 'pack.JAR' WHEN 13 THEN 'renders/textures/a/mask.png'
    WHEN 14 THEN 'renders/m/b/pack.zip' ELSE 'blocks.jsonl' END AS relative_path FROM {orders}"""
_INVENTORY = INVENTORY.format(orders="orders")
_EXPORT_ID = "'^export_[0-9]{8}T[0-9]{6}Z(?:_(?:0[1-9]|[1-9][0-9]))?$'"


@query(f"""
WITH i AS ({_INVENTORY}), e AS (SELECT DISTINCT export FROM i),
x AS (SELECT export, CASE WHEN hash_ % 3 = 0 THEN 'another' ELSE export END AS manifest_export_id FROM (SELECT export, length(export) + ascii(substr(export, length(export) - 1, 1)) AS hash_ FROM e) UNION ALL SELECT 'export_20000101T000000Z', NULL),
required AS (SELECT unnest(['manifest.json', 'blocks.jsonl', 'states.jsonl', 'variants.jsonl', 'failures.jsonl', 'checksums.sha256', 'exporter.log']) AS name)
SELECT 'EXPORT_DIR_MISSING' AS code, export AS subject, NULL::VARCHAR AS detail FROM x WHERE export NOT IN (FROM e)
UNION ALL SELECT 'EXPORT_DIR_STAGING', export, NULL FROM x WHERE export LIKE '.%.staging'
UNION ALL SELECT 'EXPORT_DIR_NAME_INVALID', export, NULL FROM x WHERE export NOT LIKE '.%.staging' AND NOT regexp_matches(export, {_EXPORT_ID})
UNION ALL SELECT 'RENDERS_DIR_MISSING', export, NULL FROM e WHERE export NOT IN (SELECT export FROM i WHERE relative_path LIKE 'renders/%')
UNION ALL SELECT 'EXPORT_DIR_NAME_MISMATCH', export, manifest_export_id FROM x WHERE manifest_export_id <> export
UNION ALL SELECT 'REQUIRED_FILE_MISSING', export, name FROM e, required WHERE (export, name) NOT IN (FROM i)
UNION ALL SELECT 'UNDECLARED_FILE', export, relative_path FROM i WHERE relative_path IN ('notes.txt', 'assets/x.png', 'pack.JAR')
UNION ALL SELECT 'UNDECLARED_RENDER_FILE', export, relative_path FROM i WHERE relative_path IN ('renders/m/a/notes.txt', 'renders/m/b/pack.zip')
UNION ALL SELECT 'ORIGINAL_ASSET_BLACKLISTED', export, relative_path FROM i WHERE relative_path IN ('assets/x.png', 'pack.JAR', 'renders/m/b/pack.zip')
""")
def export_file_issues(spark, sf_dir):
    inventory = spark.sql(INVENTORY, orders=read(spark, sf_dir, "orders"))
    other = (F.length("export") + F.ascii(F.substring("export", -2, 1))) % 3 == 0
    exports = inventory.select("export").distinct().withColumn("manifest_export_id", F.when(other, "another").otherwise(F.col("export"))).unionByName(
        spark.range(1).select(F.lit("export_20000101T000000Z").alias("export"), F.lit(None).cast("string").alias("manifest_export_id")))
    return integrity.all_issues(export_rules.directory_issues(exports, inventory), export_rules.file_issues(inventory))


# A checksum list a customer: a line for each order, most of them good.
SUMS = """SELECT concat('c', o_custkey) AS export, o_orderkey AS line_no, concat('f', o_orderkey % 97) AS path, sha2(CAST(o_orderkey % 97 AS STRING), 256) AS h, o_orderkey FROM {orders}"""
_SUMS = "SELECT concat('c', o_custkey) AS export, o_orderkey AS line_no, concat('f', o_orderkey % 97) AS path, sha256((o_orderkey % 97)::VARCHAR) AS h, o_orderkey FROM orders"


@query(f"""
WITH s AS ({_SUMS}), l AS (SELECT export, line_no, CASE WHEN o_orderkey % 29 = 28 THEN NULL WHEN o_orderkey % 31 = 30 THEN '../' || path ELSE path END AS path, h FROM s WHERE export <> 'c7'),
p AS (SELECT *, min(line_no) OVER (PARTITION BY export, path) AS first_, lag(path) OVER (PARTITION BY export ORDER BY line_no) AS before_ FROM l),
j AS (SELECT export, line_no, path, h, CASE WHEN path IS NULL THEN 'CHECKSUM_LINE_INVALID' WHEN path LIKE '../%' THEN 'CHECKSUM_PATH_INVALID' WHEN line_no > first_ THEN 'CHECKSUM_PATH_DUPLICATE' WHEN path < before_ THEN 'CHECKSUM_ORDER_INVALID' END AS issue FROM p),
said AS (SELECT export, path, h FROM j WHERE issue IS NULL OR issue = 'CHECKSUM_ORDER_INVALID'),
files AS (SELECT DISTINCT export, path, CASE WHEN right(path, 1) = '3' THEN 'x' ELSE h END AS h FROM s WHERE o_orderkey % 37 <> 0)
SELECT 'CHECKSUM_FILE_READ_FAILED' AS code, 'c7' AS subject, NULL::VARCHAR AS detail FROM (SELECT 1) WHERE 'c7' IN (SELECT export FROM s)
UNION ALL SELECT issue, export, line_no::VARCHAR FROM j WHERE issue IS NOT NULL
UNION ALL SELECT 'CHECKSUM_FILES_EXTRA', export, path FROM said WHERE (export, path) NOT IN (SELECT export, path FROM files)
UNION ALL SELECT 'CHECKSUM_FILES_MISSING', export, path FROM files WHERE export <> 'c7' AND (export, path) NOT IN (SELECT export, path FROM said)
UNION ALL SELECT 'CHECKSUM_MISMATCH', s.export, s.path FROM said s JOIN files f ON f.export = s.export AND f.path = s.path WHERE f.h <> s.h
""")
def export_checksum_issues(spark, sf_dir):
    rows = spark.sql(SUMS, orders=read(spark, sf_dir, "orders"))
    text = F.when(F.col("o_orderkey") % 29 == 28, "no checksum").when(F.col("o_orderkey") % 31 == 30, F.concat("h", F.lit("  ../"), "path")).otherwise(F.concat("h", F.lit("  "), "path"))
    files = rows.where("o_orderkey % 37 <> 0").select("export", F.col("path").alias("relative_path"), F.when(F.col("path").endswith("3"), "x").otherwise(F.col("h")).alias("sha256")).distinct()
    return export_rules.checksum_issues(rows.where("export <> 'c7'").select("export", "line_no", text.alias("value")), files, rows.select("export").distinct())


@query(r"""
SELECT 'TEXT_NOT_LF' AS code, 'd' || doc_id AS subject, lang AS detail FROM documents WHERE doc_id % 9 = 0 OR contains(text, chr(13))
UNION ALL SELECT 'TEXT_MISSING_FINAL_LF', 'd' || doc_id, lang FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 4 <> 0 AND length(text) > 0 AND right(text, 1) <> chr(10)
""")
def export_text_issues(spark, sf_dir):
    text = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("\r\n"))).when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return export_rules.text_issues(read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("export"), F.col("lang").alias("relative_path"), text.alias("content")))


_LISTED = '[{"schema_id":"export-block.v1","schema_sha256":"sha256:0"},{"schema_id":"export-failure.v1","schema_sha256":"sha256:0"},{"schema_id":"export-manifest.v1","schema_sha256":"sha256:0"},{"schema_id":"export-state.v1","schema_sha256":"sha256:0"},{"schema_id":"export-variant.v1","schema_sha256":"sha256:0"},{"schema_id":"render-metadata.v1","schema_sha256":"sha256:0"}]'


@query("""
WITH m AS (SELECT 'x' || event_id AS export, event_id % 10 AS k, event_type FROM events)
SELECT 'MANIFEST_READ_FAILED' AS code, export AS subject, NULL::VARCHAR AS detail FROM m WHERE k = 0
UNION ALL SELECT 'MANIFEST_NOT_OBJECT', export, NULL FROM m WHERE k = 1
UNION ALL SELECT 'FAILED_EXPORT_NOT_ACCEPTED', export, NULL FROM m WHERE k > 1 AND event_type = 'error'
UNION ALL SELECT 'SCHEMA_INVENTORY_ORDER', export, NULL FROM m WHERE k = 2
UNION ALL SELECT 'SCHEMA_INVENTORY_HASH_MISMATCH', export, 'export-block.v1' FROM m WHERE k > 1
UNION ALL SELECT 'PLATFORM_UNSUPPORTED', export, CASE k WHEN 3 THEN 'Plan9' END FROM m WHERE k IN (3, 4)
UNION ALL SELECT 'PLATFORM_ARCHITECTURE_UNSUPPORTED', export, CASE k WHEN 3 THEN 'riscv' END FROM m WHERE k IN (3, 4)
UNION ALL SELECT 'SCHEMA_READ_FAILED', 's' || user_id, NULL FROM events WHERE event_id % 50 = 7
UNION ALL SELECT 'SCHEMA_NOT_OBJECT', 's' || user_id, NULL FROM events WHERE event_id % 50 = 8
""")
def export_manifest_documents(spark, sf_dir):
    k, status = F.col("event_id") % 10, F.concat(F.lit('{"status":"'), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded"), F.lit('"'))
    listed = F.when(k == 2, F.lit('[{"schema_id":"export-block.v1","schema_sha256":"sha256:0"}]')).otherwise(F.lit(_LISTED))
    platform = F.when(k == 3, ',"platform":{"os_name":"Plan9","architecture":"riscv"}').when(k == 4, ',"platform":{}').otherwise(',"platform":{"os_name":"Linux","architecture":"x86_64"}')
    value = F.when(k == 0, '{"status":').when(k == 1, "[1]").otherwise(F.concat(status, platform, F.lit(',"schema_inventory":'), listed, F.lit("}")))
    events = read(spark, sf_dir, "events")
    schemas = events.where("event_id % 50 in (7, 8)").select(F.concat(F.lit("s"), "user_id").alias("schema_id"), F.when(F.col("event_id") % 50 == 7, "{").otherwise("7").alias("value")).unionByName(
        spark.range(1).select(F.lit("export-block.v1").alias("schema_id"), F.lit("{}").alias("value")))
    return export_rules.manifest_document_issues(events.select(F.concat(F.lit("x"), "event_id").alias("export"), value.alias("value")), schemas)


@query("""
WITH e AS (SELECT 'c' || c_custkey AS export, c_custkey AS n, CASE c_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'needs_review' ELSE 'succeeded' END AS status, c_nationkey % 2 AS pending FROM customer),
bad AS (SELECT DISTINCT o_custkey AS n FROM orders WHERE o_orderkey % 40 = 3),
x AS (SELECT export, status, CASE WHEN n IN (FROM bad) THEN 'failed' WHEN pending > 0 THEN 'needs_review' ELSE 'succeeded' END AS expected FROM e)
SELECT 'MANIFEST_STATUS_MISMATCH' AS code, export AS subject, expected AS detail FROM x WHERE status <> expected
""")
def export_status_issues(spark, sf_dir):
    exports = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("export"), F.when(F.col("c_custkey") % 4 == 0, "failed").when(F.col("c_custkey") % 4 == 1, "needs_review").otherwise("succeeded").alias("status"), (F.col("c_nationkey") % 2).alias("pending"))
    found = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("export"), F.when(F.col("o_orderkey") % 40 == 3, "UNDECLARED_FILE").otherwise("PLATFORM_UNSUPPORTED").alias("code"))
    return export_rules.status_issues(exports, found)


@query("""
WITH m AS (SELECT 'v' || event_id AS v, event_id % 12 AS k, event_type FROM events)
SELECT 'RENDER_METADATA_PARSE_FAILED' AS code, v AS subject, NULL::VARCHAR AS detail FROM m WHERE k = 0
UNION ALL SELECT 'RENDER_METADATA_NOT_OBJECT', v, NULL FROM m WHERE k = 1
UNION ALL SELECT 'RENDER_METADATA_VARIANT_MISMATCH', v, NULL FROM m WHERE k = 2
UNION ALL SELECT 'MASK_METADATA_FORMAT_INVALID', v, NULL FROM m WHERE k IN (3, 4)
UNION ALL SELECT 'MASK_METADATA_CHANNEL_INVALID', v, NULL FROM m WHERE k IN (3, 5)
UNION ALL SELECT 'TINT_BASELINE_INVALID', v, NULL FROM m WHERE k IN (6, 7)
""")
def export_metadata_issues(spark, sf_dir):
    k = F.col("event_id") % 12
    name = F.concat(F.lit("v"), "event_id")
    mask = F.when(k == 3, '{"format":"JPG"}').when(k == 4, '"none"').when(k == 5, '{"format":"PNG-RGBA","channel":"red"}').otherwise('{"format":"PNG-RGBA","channel":"alpha"}')
    tint = F.when(k == 6, ',"tint_sensitive":true,"baseline_biome":"minecraft:desert"').when(k == 7, ',"tint_sensitive":false,"baseline_biome":"minecraft:plains"').when(k == 8, ',"tint_sensitive":true,"baseline_biome":"minecraft:plains"').otherwise("")
    value = F.when(k == 0, "{").when(k == 1, "[]").otherwise(F.concat(F.lit('{"variant_id":"'), F.when(k == 2, "other").otherwise(name), F.lit('","mask":'), mask, tint, F.lit("}")))
    return export_rules.metadata_issues(read(spark, sf_dir, "events").select(name.alias("variant_id"), value.alias("value")))


RULES = [Rule("$.k", ("number",), required=True, minimum=10, maximum=90), Rule("$.name", ("string",), max_length=4, enum=("a", "b", "longer")), Rule("$.tags", ("array",), max_length=2)]


@query("""
WITH e AS (SELECT event_id, event_id % 6 AS m, (props->>'$.k')::INT AS k FROM events), r(code) AS (VALUES ('SCHEMA_VALIDATION_FAILED'))
SELECT code, event_id::VARCHAR AS subject, '$.k' AS path, CASE WHEN m = 1 THEN 'required' WHEN k < 10 THEN 'minimum' ELSE 'maximum' END AS keyword, CASE WHEN m = 1 THEN 'missing' ELSE 'number' END AS observed_type, NULL::BIGINT AS observed_length FROM e, r WHERE m = 1 OR m IN (0, 2, 3, 4) AND (k < 10 OR k > 90)
UNION ALL SELECT code, event_id::VARCHAR, '$.name', CASE m WHEN 2 THEN 'maxLength' ELSE 'type' END, CASE m WHEN 2 THEN 'string' ELSE 'boolean' END, CASE m WHEN 2 THEN 6 END FROM e, r WHERE m IN (2, 3)
UNION ALL SELECT code, event_id::VARCHAR, '$.tags', CASE m WHEN 4 THEN 'maxLength' ELSE 'type' END, CASE m WHEN 4 THEN 'array' ELSE 'null' END, CASE m WHEN 4 THEN 3 END FROM e, r WHERE m IN (3, 4)
UNION ALL SELECT code, event_id::VARCHAR, '$', 'type', 'missing', NULL FROM e, r WHERE m = 5
""")
def json_schema_rules(spark, sf_dir):
    m, k = F.col("event_id") % 6, F.get_json_object("props", "$.k")
    plain = F.concat(F.lit('{"k":'), k)
    value = (F.when(m == 1, F.lit('{"x":1}')).when(m == 2, F.concat(plain, F.lit(',"name":"longer"}'))).when(m == 3, F.concat(plain, F.lit(',"name":true,"tags":null}')))
             .when(m == 4, F.concat(plain, F.lit(',"tags":[1,2,3]}'))).when(m == 5, F.lit('{"k":')).otherwise(F.concat(plain, F.lit("}"))))
    return violations(read(spark, sf_dir, "events").select("event_id", value.alias("v")), "event_id", "v", RULES)


# --- Review routing and gates


@query(_CTE + """
SELECT DISTINCT 'review_' || substr(sha256('{"dedupe_key":null,"reason_code":"' || coalesce(reason_code, 'OTHER') || '","severity":"high","target_id":"' || f.variant_id || '","target_type":"variant"}'), 1, 32) AS review_id, f.variant_id AS target_id, coalesce(reason_code, 'OTHER') AS reason_code
FROM failures f WHERE scope IN ('variant', 'render') AND f.variant_id IN (SELECT variant_id FROM variants WHERE status = 'skipped')
""")
def import_failure_reviews(spark, sf_dir):
    return review.import_failure_reviews(_failures(spark, sf_dir), _made(spark, sf_dir, "variants")).select("review_id", "target_id", "reason_code")


def _complete(spark, sf_dir):
    return _made(spark, sf_dir, "variants").where("n % 11 = 3").select("variant_id")


_NUMBER = [Rule("$.k", ("number",), required=True, maximum=90)]
_RECORDS = _CTE + """, own AS (SELECT v.*, CASE WHEN n % 6 <> 5 THEN annotation_ref END AS ref, CASE WHEN n % 7 <> 6 THEN review_ref END AS qref, (n * 7) % 100 AS k FROM variants v)"""


def _records(spark, sf_dir):
    return _variants(spark, sf_dir).dropDuplicates(["n"]).withColumn("record_json", F.concat(F.lit('{"k":'), (F.col("n") * 7 % 100).cast("string"), F.lit("}")))


@query(_RECORDS + """, found AS (
SELECT variant_id, 'SCHEMA_INVALID' AS code FROM own WHERE k > 90
UNION SELECT variant_id, 'ANNOTATION_REFERENCE_INVALID' FROM own WHERE ref IS NOT NULL AND ref NOT IN (SELECT annotation_id FROM annotations)
UNION SELECT variant_id, 'MISSING_SEMANTIC' FROM own WHERE candidate_qualification <> 'excluded' AND ref IS NULL AND variant_id NOT IN (SELECT variant_id FROM variants WHERE n % 11 = 3) AND variant_id NOT IN (SELECT variant_id FROM variants WHERE n % 35 = 5)
UNION SELECT variant_id, 'QUALIFICATION_REVIEW_MISSING' FROM own WHERE candidate_qualification = 'excluded' AND qref IS NULL)
SELECT 'review_' || substr(sha256('{"dedupe_key":"' || code || '","reason_code":"' || code || '","severity":"high","target_id":"' || variant_id || '","target_type":"variant"}'), 1, 32) AS review_id, variant_id AS target_id, code AS reason_code FROM found
""")
def validation_tasks(spark, sf_dir):
    roots = _made(spark, sf_dir, "variants").where("n % 35 = 5").select("variant_id")
    return review.record_tasks(_records(spark, sf_dir), _made(spark, sf_dir, "annotations"), _complete(spark, sf_dir), roots, _NUMBER).select("review_id", "target_id", "reason_code")


@query(_RECORDS + """, sel AS (SELECT * FROM own WHERE status = 'selected')
SELECT variant_id AS target_id, 'MISSING_VERIFIED_SEMANTIC' AS code FROM sel WHERE candidate_qualification <> 'excluded' AND variant_id NOT IN (SELECT variant_id FROM variants WHERE n % 11 = 3)
  AND NOT EXISTS (SELECT 1 FROM annotations a WHERE a.annotation_id = sel.ref AND a.subject_id = sel.variant_id AND a.verified)
UNION ALL SELECT DISTINCT variant_id, 'QUALIFICATION_REVIEW_MISSING' FROM sel WHERE candidate_qualification = 'excluded' AND variant_id NOT IN (SELECT s.variant_id FROM sel s JOIN reviews r ON r.review_id = s.qref AND r.target_id = s.variant_id WHERE s.candidate_qualification = 'excluded' AND r.qualification = 'excluded')
UNION ALL SELECT coalesce(CASE WHEN scope IN ('variant', 'render') THEN variant_id END, CASE WHEN scope = 'state' THEN state_id END, block_id), 'SKIP_REVIEW_MISSING' FROM failures f
  WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.failure_ref = f.failure_id AND (r.target_id = f.block_id OR r.target_id = CASE WHEN scope IN ('variant', 'render') THEN f.variant_id END))
UNION ALL SELECT 'index', 'FTS_COVERAGE_MISSING'
""")
def closure_errors(spark, sf_dir):
    text = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    reviews = _made(spark, sf_dir, "reviews")
    return review.closure_errors(_records(spark, sf_dir), _made(spark, sf_dir, "annotations"), _complete(spark, sf_dir), reviews, _failures(spark, sf_dir), reviews.select("target_id", "failure_ref"), text, text.where("p_partkey > 0"))


_BACK = "(SELECT variant_id, review_ref FROM variants WHERE n % 13 <> 12), qual AS (SELECT variant_id, review_ref FROM variants WHERE n % 7 <> 6)"


@query(_CTE + f""", plain AS {_BACK}, known AS (SELECT * FROM manual WHERE schema_id <> 'unknown.v1'),
targets AS (SELECT block_id AS t FROM blocks UNION SELECT state_id FROM states UNION SELECT variant_id FROM variants), vs AS (SELECT variant_id FROM variants)
SELECT record_id, 'OVERRIDE_SCHEMA_UNKNOWN' AS code FROM manual WHERE schema_id = 'unknown.v1'
UNION ALL SELECT record_id, 'OVERRIDE_TEXT_SENSITIVE' FROM known WHERE note LIKE '%password%'
UNION ALL SELECT record_id, 'OVERRIDE_TARGET_MISSING' FROM known WHERE target_id NOT IN (FROM targets)
UNION ALL SELECT record_id, 'OVERRIDE_FAILURE_MISSING' FROM known WHERE schema_id = 'skip-review.v1' AND failure_ref NOT IN (SELECT failure_id FROM failures)
UNION ALL SELECT record_id, 'OVERRIDE_TARGET_NOT_VARIANT' FROM known WHERE schema_id = 'qualification-review.v1' AND target_id NOT IN (FROM vs)
UNION ALL SELECT record_id, 'OVERRIDE_NOT_REFERENCED' FROM known WHERE target_id IN (FROM vs) AND CASE WHEN schema_id = 'qualification-review.v1' THEN (target_id, record_id) NOT IN (FROM qual) ELSE (target_id, record_id) NOT IN (FROM plain) END
""")
def override_references(spark, sf_dir):
    return review.override_violations(_made(spark, sf_dir, "manual"), _blocks(spark, sf_dir), _states(spark, sf_dir), _variants(spark, sf_dir).dropDuplicates(["n"]), _failures(spark, sf_dir))


@query(_CTE + """, sel AS (SELECT block_id FROM variants WHERE status = 'selected'), skip AS (SELECT block_id FROM variants v WHERE status = 'skipped' AND EXISTS (SELECT 1 FROM reviews r WHERE r.target_id = v.variant_id AND r.failure_ref = 'f' || (v.n * 3)))
SELECT 'skip' AS rule, block_id AS subject FROM blocks WHERE block_id NOT IN (FROM sel) AND block_id NOT IN (FROM skip)
UNION ALL SELECT 'exclusion', variant_id FROM (SELECT DISTINCT variant_id FROM variants WHERE candidate_qualification = 'excluded') WHERE variant_id NOT IN (SELECT v.variant_id FROM variants v JOIN reviews r ON r.review_id = v.review_ref AND r.target_id = v.variant_id AND r.qualification = v.candidate_qualification WHERE v.candidate_qualification = 'excluded' AND v.n % 7 <> 6)
UNION ALL SELECT 'closure', failure_id FROM failures f WHERE coalesce(CASE WHEN scope IN ('variant', 'render') THEN variant_id END, '-') NOT IN (SELECT target_id FROM reviews) AND coalesce(CASE WHEN scope = 'state' THEN state_id END, '-') NOT IN (SELECT target_id FROM reviews) AND block_id NOT IN (SELECT target_id FROM reviews)
""")
def review_coverage(spark, sf_dir):
    blocks, variants, reviews = _blocks(spark, sf_dir), _made(spark, sf_dir, "variants").withColumn("failure_id", F.concat(F.lit("f"), F.col("n") * 3)), _made(spark, sf_dir, "reviews")
    skips = review.audited_skips(blocks, variants, reviews.select("target_id", "failure_ref")).select(F.lit("skip").alias("rule"), F.col("block_id").alias("subject"))
    cited = _variants(spark, sf_dir).withColumn("review_refs", F.col("qualification_review_refs"))
    excluded = review.qualified_exclusions(cited, reviews.withColumn("value", F.col("qualification"))).select(F.lit("exclusion"), F.col("variant_id"))
    return skips.union(excluded).union(review.skip_closure(_failures(spark, sf_dir), reviews).select(F.lit("closure"), F.col("failure_id")))


LINEAGE_JOBS = "SELECT concat('j', o_orderkey) AS job_id, concat('run', o_custkey % 3) AS run_id, concat('s', o_orderkey % 400) AS input_signature, o_orderkey % 400 AS n, CASE WHEN o_orderkey % 61 = 60 THEN 'm2' ELSE 'm1' END AS model FROM {orders} WHERE o_orderkey % 400 <> 17"


@query(f"""
WITH j AS ({LINEAGE_JOBS.format(orders="orders")}), q AS (SELECT o_orderkey AS n, o_orderkey % 400 AS m FROM orders), a AS (SELECT o_orderkey AS n, (o_orderkey * 3) % 420 AS m FROM orders)
SELECT 'REQUEST_WITHOUT_JOB' AS code, 'q' || n AS subject FROM q WHERE m NOT IN (SELECT n FROM j)
UNION ALL SELECT 'ARTIFACT_WITHOUT_REQUEST', 'a' || n FROM a WHERE m NOT IN (SELECT m FROM q)
UNION ALL SELECT 'ANNOTATION_DIFFERS', 'n' || n FROM a WHERE n % 19 = 18
UNION ALL SELECT 'PROFILE_DIFFERS_MODEL', job_id FROM j WHERE run_id = 'run2' OR model <> 'm1'
""")
def lineage_gate(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    ids = lambda n: F.array(F.concat(F.lit("x"), n), F.concat(F.lit("y"), n))
    jobs = spark.sql(LINEAGE_JOBS, orders=orders).withColumn("ids", ids(F.col("n")))
    m = F.col("o_orderkey") % 400
    requests = orders.select(F.concat(F.lit("q"), "o_orderkey").alias("request_id"), F.concat(F.lit("s"), m).alias("input_signature"), F.reverse(ids(m)).alias("ids"))
    content = lambda tail: F.concat(F.col("o_orderstatus"), tail)
    artifacts = orders.select(F.concat(F.lit("a"), "o_orderkey").alias("artifact_id"), ids(F.col("o_orderkey") * 3 % 420).alias("ids"), F.array(F.struct(F.concat(F.lit("n"), "o_orderkey").alias("annotation_id"), content(F.lit("")).alias("content"))).alias("items"))
    annotations = orders.select(F.concat(F.lit("n"), "o_orderkey").alias("annotation_id"), content(F.when(F.col("o_orderkey") % 19 == 18, "changed").otherwise("")).alias("content"))
    profile = spark.createDataFrame([("run0", "m1"), ("run1", "m1")], "run_id string, model string")
    return lineage.lineage_gate(requests, jobs, artifacts, annotations, profile, ["model"])


_GATES = _RECORDS + f""", plain AS {_BACK}, known AS (SELECT * FROM manual WHERE schema_id <> 'unknown.v1'), ids AS (SELECT DISTINCT block_id FROM blocks),
targets AS (SELECT block_id AS t FROM blocks UNION SELECT state_id FROM states UNION SELECT variant_id FROM variants), vs AS (SELECT DISTINCT variant_id FROM variants),
ws AS (SELECT p_partkey AS k FROM part WHERE p_size > 5), reg AS (SELECT p_partkey AS k FROM part WHERE p_size < 45 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 90 = 1 AND p_size < 45),
held AS (SELECT n, list(DISTINCT state_id) AS shown FROM states WHERE NOT (n % 59 = 58 AND k = 1) GROUP BY 1),
full_variants AS (SELECT o.*, coalesce(shown, []) AS shown FROM own o LEFT JOIN held USING (n)),
own_blocks AS (SELECT block_id, min(default_state_id) AS default_state_id FROM blocks GROUP BY 1),
d AS (SELECT block_id, count(*) AS n, min(state_id) AS s FROM states WHERE is_default GROUP BY 1), chosen AS (SELECT block_id, list_sort(list(DISTINCT variant_id)) AS c FROM variants GROUP BY 1),
mapped AS (SELECT block_id, list_sort(list(DISTINCT state_id)) AS m FROM states WHERE mapping_status = 'mapped' GROUP BY 1),
legal AS (
  SELECT 0 AS rank FROM own_blocks b LEFT JOIN d USING (block_id) WHERE coalesce(d.n, 0) <> 1 OR d.s IS DISTINCT FROM b.default_state_id
  UNION ALL SELECT 0 FROM states WHERE block_id NOT IN (FROM ids)
  UNION ALL SELECT 1 FROM states s LEFT JOIN chosen USING (block_id) WHERE block_id IN (FROM ids)
    AND CASE WHEN variant_ref IS NULL THEN [] ELSE [variant_ref] END <> CASE WHEN mapping_status = 'mapped' THEN coalesce(c, []) ELSE [] END
  UNION ALL SELECT 2 FROM full_variants v LEFT JOIN own_blocks b USING (block_id) LEFT JOIN mapped USING (block_id)
    WHERE NOT coalesce(canonical_state_id = default_state_id AND list_contains(shown, canonical_state_id) AND list_sort(shown) = coalesce(m, []), false)),
lies AS (
  SELECT 'v' AS kind, variant_id AS id FROM full_variants v WHERE variant_id <> block_id OR block_id NOT IN (FROM ids) OR canonical_state_id IS NULL OR canonical_state_id NOT IN (SELECT state_id FROM states)
    OR (ref IS NOT NULL AND ref NOT IN (SELECT annotation_id FROM annotations)) OR EXISTS (SELECT 1 FROM (SELECT unnest(v.shown) AS x) WHERE (x, v.block_id) NOT IN (SELECT (state_id, block_id) FROM states))
  UNION SELECT 's', state_id FROM states WHERE block_id NOT IN (FROM ids) OR (variant_ref IS NOT NULL AND variant_ref NOT IN (FROM vs))
  UNION SELECT 'a', annotation_id FROM annotations WHERE subject_id NOT IN (FROM ids) AND subject_id NOT IN (FROM vs)),
drift AS (
  SELECT 0 AS rank FROM (SELECT DISTINCT n FROM own WHERE k > 90)
  UNION ALL SELECT 1 FROM part WHERE p_partkey % 21 = 20 UNION ALL SELECT 1 FROM (SELECT DISTINCT state_id FROM states WHERE k > 6 AND block_id IN (FROM ids))),
told AS (
  SELECT 0 AS rank FROM annotations WHERE (record_json->>'$.k')::INT > 90 OR subject_id NOT IN (SELECT variant_id FROM variants UNION SELECT block_id FROM blocks)
  UNION ALL SELECT 1 FROM variants WHERE candidate_qualification <> 'excluded' AND variant_id NOT IN (SELECT subject_id FROM annotations WHERE verified) AND variant_id NOT IN (SELECT variant_id FROM variants WHERE n % 11 = 3)),
broken AS (
  SELECT record_id FROM manual WHERE schema_id = 'unknown.v1' UNION ALL SELECT record_id FROM known WHERE note LIKE '%password%' UNION ALL SELECT record_id FROM known WHERE target_id NOT IN (FROM targets)
  UNION ALL SELECT record_id FROM known WHERE schema_id = 'skip-review.v1' AND failure_ref NOT IN (SELECT failure_id FROM failures)
  UNION ALL SELECT record_id FROM known WHERE schema_id = 'qualification-review.v1' AND target_id NOT IN (FROM vs)
  UNION ALL SELECT record_id FROM known WHERE target_id IN (FROM vs) AND CASE WHEN schema_id = 'qualification-review.v1' THEN (target_id, record_id) NOT IN (FROM qual) ELSE (target_id, record_id) NOT IN (FROM plain) END),
g AS (
SELECT 'REGISTRY_COVERAGE_100' AS gate, (SELECT count(*) FROM reg) AS observed, count(*) AS violations, 'REGISTRY_COVERAGE_INVALID' AS code FROM (SELECT k FROM (SELECT k, 1 AS r, 0 AS w FROM reg UNION ALL SELECT k, 0, 1 FROM ws) GROUP BY k HAVING sum(r) <> 1 OR sum(w) <> 1)
UNION ALL SELECT 'BLOCK_VARIANT_OR_AUDITED_SKIP', (SELECT count(*) FROM blocks), count(*), 'BLOCK_VARIANT_OR_AUDITED_SKIP_INVALID' FROM blocks WHERE block_id NOT IN (SELECT block_id FROM variants WHERE status = 'selected')
UNION ALL SELECT 'EXCLUDED_QUALIFICATION_REVIEW_VALID', (SELECT count(*) FROM variants WHERE candidate_qualification = 'excluded'), count(*), 'EXCLUDED_QUALIFICATION_REVIEW_INVALID' FROM (SELECT DISTINCT variant_id FROM variants WHERE candidate_qualification = 'excluded') WHERE variant_id NOT IN (SELECT v.variant_id FROM variants v JOIN reviews r ON r.review_id = v.review_ref AND r.target_id = v.variant_id AND r.qualification = 'excluded' WHERE v.candidate_qualification = 'excluded' AND v.n % 7 <> 6)
UNION ALL SELECT 'IMAGE_READABLE_AND_HASHED', (SELECT count(*) FROM part WHERE p_partkey % 9 <> 4), count(*), 'IMAGE_ARTIFACT_INVALID' FROM part WHERE p_partkey % 9 IN (0, 1, 2, 3)
UNION ALL SELECT 'LEGAL_STATE_VALID', (SELECT count(*) FROM states), count(*), ['LEGAL_STATE_INVALID', 'STATE_VARIANT_RELATION_INVALID', 'VARIANT_STATE_RELATION_INVALID'][min(rank) + 1] FROM legal
UNION ALL SELECT 'MACHINE_SCHEMA_VALID', (SELECT count(*) FROM variants) + (SELECT count(*) FROM states), count(*), ['MACHINE_SCHEMA_INVALID', 'MACHINE_FACTS_MISMATCH'][min(rank) + 1] FROM drift
UNION ALL SELECT 'AI_SCHEMA_VALID', (SELECT count(*) FROM annotations), count(*), ['AI_SCHEMA_INVALID', 'AI_SEMANTIC_MISSING'][min(rank) + 1] FROM told
UNION ALL SELECT 'OVERRIDE_REFERENCES_VALID', (SELECT count(*) FROM manual), count(*), 'OVERRIDE_REFERENCE_INVALID' FROM broken
UNION ALL SELECT 'NO_FALSE_IDS', (SELECT count(*) FROM variants), count(*), 'FALSE_ID_REFERENCE' FROM lies
UNION ALL SELECT 'HIGH_REVIEW_ZERO', (SELECT count(*) FROM labels), count(*), 'OPEN_REVIEW_EXISTS' FROM labels WHERE quality = 9
UNION ALL SELECT 'FTS_READY', (SELECT count(*) FROM part), 2 * count(*), 'FTS_NOT_READY' FROM part WHERE p_partkey % 33 = 5
UNION ALL SELECT 'RELEASE_HASH_MANIFEST', 0, 0, NULL)
SELECT gate, CASE WHEN gate = 'RELEASE_HASH_MANIFEST' THEN 'not_run' WHEN violations = 0 THEN 'passed' ELSE 'failed' END AS status, observed, violations, CASE WHEN violations > 0 THEN code END AS error_code FROM g
"""


@query(_GATES)
def quality_gates(spark, sf_dir):
    """The gates before a release is built: one that passes, the last not run yet, the others fed with
    violations. The made tables are written once and read by all gates, and so is the report: its tasks are small."""
    with small_tasks(spark, max(read(spark, sf_dir, name).count() for name in ("lineitem", "events"))):
        return stored(_gate_report(spark, sf_dir).coalesce(1), "gates")


def _gate_report(spark, sf_dir):
    part, labels, states = read(spark, sf_dir, "part"), read(spark, sf_dir, "labels"), stored(_states(spark, sf_dir), "states")
    variants, reviews, manual = stored(_variants(spark, sf_dir).dropDuplicates(["n"]), "variants"), _made(spark, sf_dir, "reviews"), _made(spark, sf_dir, "manual")
    blocks, annotations = _blocks(spark, sf_dir), _made(spark, sf_dir, "annotations").withColumn("source", F.struct("verified"))
    own_blocks = blocks.groupBy("block_id").agg(F.min("default_state_id").alias("default_state_id"))
    keys = part.select(F.col("p_partkey").alias("k"), "p_size")
    registry = keys.where("p_size < 45").unionByName(keys.where("k % 90 = 1 and p_size < 45"))
    nine = F.col("p_partkey") % 9
    declared = part.where(nine != 4).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("path"), F.lit("h").alias("sha256"))
    actual = part.where(nine != 0).select(F.col("p_partkey").alias("path"), F.when(nine == 1, "x").otherwise("h").alias("sha256"), F.when(nine == 2, 256).otherwise(512).alias("width"), F.lit(512).alias("height"), F.when(nine == 3, "chunk").alias("error"))
    facts = part.select("p_partkey", "p_name")
    workspace = part.select("p_partkey", F.when(F.col("p_partkey") % 21 == 20, "changed").otherwise(F.col("p_name")).alias("p_name"))
    domains = own_blocks.select("block_id").withColumn("domain", F.create_map(F.lit("k"), F.array(*(F.lit(str(i)) for i in range(1, 7)))))
    broken_text = part.select("p_partkey", F.when(F.col("p_partkey") % 33 == 5, "stale").otherwise(F.col("p_name")).alias("p_name"))
    records = variants.withColumns({"record_json": F.concat(F.lit('{"k":'), (F.col("n") * 7 % 100).cast("string"), F.lit("}")), "key_": F.concat(F.lit("m:p"), "n")})
    tasks = labels.withColumns({"status": F.lit("open"), "severity": F.when(F.col("quality") == 9, "high").otherwise("low")})
    excluded = variants.where("candidate_qualification = 'excluded'")
    return release.gate_report({
        "REGISTRY_COVERAGE_100": release.registry_coverage(registry, keys.where("p_size > 5"), "k"),
        "BLOCK_VARIANT_OR_AUDITED_SKIP": review.audited_skips(blocks, variants.withColumn("failure_id", F.lit("none")), reviews.select("target_id", "failure_ref")),
        "EXCLUDED_QUALIFICATION_REVIEW_VALID": review.qualified_exclusions(variants.withColumn("review_refs", F.col("qualification_review_refs")), reviews.withColumn("value", F.col("qualification"))),
        "IMAGE_READABLE_AND_HASHED": release.image_violations(declared, actual),
        "LEGAL_STATE_VALID": release.state_violations(own_blocks, states, variants),
        "MACHINE_SCHEMA_VALID": release.machine_violations({"variants": (records, "key_", "record_json", _NUMBER)}, facts, workspace, states, domains),
        "AI_SCHEMA_VALID": release.semantic_violations(variants, blocks, annotations, _complete(spark, sf_dir), _NUMBER),
        "OVERRIDE_REFERENCES_VALID": review.override_violations(manual, blocks, states, variants, _failures(spark, sf_dir)),
        "NO_FALSE_IDS": release.false_ids(own_blocks, states, variants, annotations),
        "HIGH_REVIEW_ZERO": release.open_reviews(tasks),
        "FTS_READY": release.index_parity(facts, broken_text),
    }, {"REGISTRY_COVERAGE_100": registry, "BLOCK_VARIANT_OR_AUDITED_SKIP": blocks, "EXCLUDED_QUALIFICATION_REVIEW_VALID": excluded, "IMAGE_READABLE_AND_HASHED": declared, "LEGAL_STATE_VALID": states,
        "MACHINE_SCHEMA_VALID": variants.select("n").unionByName(states.select("n")), "AI_SCHEMA_VALID": annotations, "OVERRIDE_REFERENCES_VALID": manual, "NO_FALSE_IDS": variants, "HIGH_REVIEW_ZERO": labels, "FTS_READY": part})


# --- Projections, changes, overrides


@query(_CTE + """, f AS (SELECT * FROM failures), own AS (SELECT state_id AS s, arg_min(failure_id, ordinal) AS f FROM f WHERE scope = 'state' GROUP BY 1), shared AS (SELECT block_id AS b, arg_min(failure_id, ordinal) AS f FROM f WHERE scope IN ('block', 'variant', 'render') GROUP BY 1)
SELECT state_id, block_id, coalesce(own.f, shared.f) AS failure_id, is_default FROM states LEFT JOIN own ON s = state_id LEFT JOIN shared ON b = block_id
""")
def state_projection(spark, sf_dir):
    more = {c: F.lit(None).cast("string") for c in ("minecraft_version", "legal_state", "shape", "collision", "behavior", "source")} | {"export_id": F.lit("e")}
    return projections.project_states(_states(spark, sf_dir).withColumns(more), _failures(spark, sf_dir)).select("state_id", "block_id", "failure_id", "is_default")


@query("""
SELECT 'm:p' || p_partkey AS block_id, p_name AS zh, p_brand AS en, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), nullif(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END, ''), 'm:p' || p_partkey) AS shown, 'block-record.v1' AS schema_version, p_size > 9 AS has_item FROM part
""")
def block_projection(spark, sf_dir):
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.lit("e").alias("export_id"), F.lit("1").alias("minecraft_version"), F.concat(F.lit("m:p"), key).alias("block_id"), F.lit("k").alias("translation_key"), F.col("p_name").alias("name_zh_cn"), F.col("p_brand").alias("name_en_us"),
                                              F.lit("s").alias("default_state_id"), F.lit(None).cast("map<string,string>").alias("properties"), F.array().alias("tags"), (F.col("p_size") > 9).alias("has_item"), F.lit(False).alias("has_block_entity"), F.lit("x").alias("source"))
    out = projections.project_blocks(rows)
    number = F.substring("block_id", 4, 20).cast("long")
    zh, en = F.when(number % 3 == 0, "").otherwise(F.col("official_names.zh_cn")), F.when(number % 2 == 0, "").otherwise(F.col("official_names.en_us"))
    return out.select("block_id", F.col("official_names.zh_cn").alias("zh"), F.col("official_names.en_us").alias("en"), projections.display_name(zh, en, F.col("block_id")).alias("shown"), "schema_version", F.col("machine_facts.has_item").alias("has_item"))


@query("""
WITH v AS (SELECT p_partkey AS n, 'minecraft:p' || p_partkey AS id, (1 + p_partkey % 4) / 4.0::DOUBLE AS w, (p_partkey % 9) / 8.0::DOUBLE AS h FROM part WHERE p_partkey % 10 < 8), g AS (SELECT *, CASE WHEN h > 0 THEN w ELSE 0 END AS width, CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END AS depth, h > 0 AND w = 1 AND h = 1 AS fc FROM v)
SELECT id AS variant_id, round(width * h * depth, 9) AS volume, fc AS full_cube, h > 0 AND h <= 0.125 AND width >= 0.75 AS sheet,
  concat_ws(',', CASE WHEN fc THEN 'full_cube' END, CASE WHEN h < 1 AND h > 0.125 THEN 'partial_height' END, 'seen', CASE WHEN h <= 0.125 THEN 'thin' END) AS classes, CASE WHEN fc THEN 'full_cube,solid' ELSE 'solid' END AS tags,
  'previews/minecraft/p' || n || '/render.json' AS metadata_path, 'sha256:i' || n AS image_sha256, '["m:p' || n || '"]' AS represented, '{"extra":' || n || '}' AS feature_json
FROM g
""")
def variant_index_rows(spark, sf_dir):
    """Projection of variants with box geometry, then the flat index rows."""
    n = F.col("p_partkey")
    box = F.array(F.struct(*(F.lit(0.0).alias(f"min_{a}") for a in "xyz"), ((1 + n % 4) / 4.0).alias("max_x"), ((n % 9) / 8.0).alias("max_y"), F.lit(1.0).alias("max_z")))
    shape = F.struct(box.alias("boxes"), F.lit("s").alias("signature"))
    part = read(spark, sf_dir, "part")
    name = F.concat(F.lit("minecraft:p"), n)
    variants = part.select(F.lit("e").alias("export_id"), name.alias("variant_id"), name.alias("block_id"), name.alias("canonical_state_id"), F.array(F.concat(F.lit("m:p"), n)).alias("represented_state_ids"), F.when(n % 10 < 8, "selected").otherwise("skipped").alias("status"),
                           F.lit("eligible").alias("candidate_qualification"), F.array().cast("array<string>").alias("warnings"), F.struct(shape.alias("shape"), shape.alias("collision"), F.lit(None).cast("map<string,string>").alias("behavior_by_state")).alias("machine_facts"),
                           F.concat(F.lit("sha256:i"), n).alias("image_sha256"), F.lit("m").alias("mask_sha256"), F.lit("r").alias("render_metadata_sha256"))
    features = part.select(name.alias("variant_id"), F.array(F.lit("full_cube"), F.lit("seen")).alias("geometry_classes"), F.array(F.lit("full_cube"), F.lit("solid")).alias("machine_tags"), F.lit("v").alias("feature_extractor_version"), F.lit("h").alias("input_sha256"))
    made = projections.project_variants(variants, features)
    flat = projections.index_rows(made, part.select(name.alias("variant_id"), n.alias("extra")))
    g = F.col("machine_facts.geometry")
    facts = made.select("variant_id", F.round(g["occupied_volume"], 9).alias("volume"), g["is_full_cube"].alias("full_cube"), g["is_horizontal_sheet"].alias("sheet"), F.array_join(g["geometry_classes"], ",").alias("classes"), F.array_join("machine_facts.machine_tags", ",").alias("tags"))
    return facts.join(flat, "variant_id").select("variant_id", "volume", "full_cube", "sheet", "classes", "tags", F.col("render_metadata_path").alias("metadata_path"), "image_sha256", F.col("represented_state_ids_json").alias("represented"), "feature_json")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'map' || (event_id % 7) ELSE 'own' || (event_id % 5) END AS behavior, (event_id % 4)::VARCHAR || ',' || (event_id % 6)::VARCHAR AS semantic FROM events
""")
def behavior_and_semantics(spark, sf_dir):
    n = F.col("event_id")
    events = read(spark, sf_dir, "events")
    by_state = F.when(n % 3 == 0, F.create_map(F.concat(F.lit("s"), n), F.concat(F.lit("map"), n % 7))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    variants = events.select(n.alias("variant_id"), F.concat(F.lit("s"), n).alias("canonical_state_id"), F.struct(by_state.alias("behavior_by_state")).alias("machine_facts"))
    states = events.select(F.concat(F.lit("s"), n).alias("state_id"), F.concat(F.lit("own"), n % 5).alias("behavior"))
    said = projections.semantic_view(events.select("event_id", (n % 4).cast("string").alias("summary_en"), (n % 6).cast("string").alias("confidence"), F.lit("no").alias("internal")), "event_id")
    text = said.select("event_id", F.concat_ws(",", *(c for c in said.columns if c != "event_id")).alias("semantic"))
    return projections.behavior_of_canonical_state(variants, states).withColumnRenamed("variant_id", "event_id").join(text, "event_id")


@query("""
SELECT p_partkey, '{"tiles":["\\u003cb>' || p_name || '"],"facts":{"size":' || p_size || '}}' AS payload, array_to_string([substr(x, 1, 3) FOR x IN string_split(p_name, ' ') IF x <> 'bolt'], ',') AS cut FROM part
""")
def payload_texts(spark, sf_dir):
    from tessera.functions.text import redact_list

    words = F.transform(F.split("p_name", " "), lambda w: F.when(w == "bolt", "secret bolt").otherwise(w))
    return read(spark, sf_dir, "part").select("p_partkey", projections.payload_text(F.array(F.concat(F.lit("<b>"), "p_name")), F.struct(F.col("p_size").alias("size")), "facts").alias("payload"), F.array_join(redact_list(words, 64, 3), ",").alias("cut"))


@query("""
SELECT c_custkey, 'override ' || CASE WHEN c_custkey % 4 = 0 THEN 'shape' ELSE 'color' END AS what FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'valid' FROM customer WHERE c_custkey % 5 NOT IN (3, 4)
UNION ALL SELECT c_custkey, 'complete' FROM customer WHERE c_custkey % 6 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 8 <> 0
""")
def override_rules(spark, sf_dir):
    """Fields that overrides may not touch, records that are valid, subjects that are complete by hand."""
    n = F.col("c_custkey")
    customers = read(spark, sf_dir, "customer")
    names = F.when(n % 4 == 0, '{"operations":{"set_shape":"1"}}').when(n % 4 == 1, '{"operations":[{"add_color":1}]}').otherwise('{"operations":{"set_note":"shape"}}')
    touched = overrides.forbidden_fields(customers.where(n % 3 == 0).select(n.alias("override_id"), names.alias("record_json")), forbidden=["shape", "color"])
    record = F.when(n % 5 == 3, "{").otherwise(F.concat(F.lit('{"scope":{"variant_id":"'), F.when(n % 5 == 4, "other").otherwise(n.cast("string")), F.lit('"}}')))
    valid = overrides.valid_overrides(customers.select(n.alias("c_custkey"), record.alias("record_json"), n.cast("string").alias("target_id")), "scope struct<variant_id:string>")
    lists = customers.select(n.alias("subject"), F.explode(F.when(n % 6 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))).alias("field"))
    scalars = customers.select(n.alias("subject"), F.explode(F.array(F.struct(F.lit("s").alias("field"), F.when(n % 7 == 0, " ").otherwise("text").alias("scalar")), F.struct(F.lit("confidence").alias("field"), F.when(n % 8 == 0, "1.5").otherwise("0.5").alias("scalar")))).alias("v")).select("subject", "v.*")
    complete = overrides.human_complete(lists, scalars, ["x", "y"], ["s"], "confidence").where("complete")
    return touched.select(F.col("override_id").alias("c_custkey"), F.concat(F.lit("override "), "field").alias("what")).union(valid.select("c_custkey", F.lit("valid"))).union(complete.select("subject", F.lit("complete")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'field' WHEN o_orderkey % 7 = 4 THEN 'state' ELSE 'missing' END AS problem FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 IN (3, 4, 5)
""")
def transition_check(spark, sf_dir):
    """Targets must turn from O to F, nothing else changing but the export id."""
    n = F.col("o_orderkey")
    base = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("O").alias("status"), F.col("o_orderpriority").alias("note"), F.lit("v1").alias("export_id"))
    new = base.where(n % 7 != 5).select("o_orderkey", F.when(n % 7 == 4, "P").otherwise("F").alias("status"), F.when(n % 7 == 3, "other").otherwise(F.col("note")).alias("note"), F.lit("v2").alias("export_id"))
    targets = base.where(n % 2 == 0)
    return diff.transition_violations(targets, new, "o_orderkey", "status", "O", "F", ["export_id"])


@query("""
WITH runs AS (SELECT o_custkey % 90 AS run_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS built, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS prints FROM orders GROUP BY 1)
SELECT o_custkey % 90 AS run_id, 'lineage ' || o_orderkey AS what FROM orders WHERE o_orderkey % 50 = 0
""")
def rewritten_lineage(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select((F.col("o_custkey") % 90).alias("run_id"), F.struct(F.lit("old").alias("export_id"), F.col("o_orderkey").alias("n")).alias("source"))
    out = diff.rewrite_lineage(rows, {"export_id": F.lit("lineage ")})
    return out.select("run_id", F.concat("source.export_id", "source.n").alias("what"))


@query(_CTE + """
SELECT v.n, k, a.annotation_id FROM variants v JOIN states s ON s.state_id = v.canonical_state_id JOIN (SELECT DISTINCT block_id FROM blocks) b ON b.block_id = v.block_id LEFT JOIN (SELECT subject_id, min(annotation_id) AS annotation_id FROM annotations WHERE verified GROUP BY 1) a ON a.subject_id = v.variant_id
WHERE candidate_qualification IN ('eligible', 'conditional')
""")
def candidate_rows(spark, sf_dir):
    """Eligible variants with canonical state, block and their first verified annotation."""
    variants = search.eligible(_made(spark, sf_dir, "variants"))
    rows = search.candidates_of(variants, _states(spark, sf_dir).select("state_id", "k"), _blocks(spark, sf_dir).select("block_id").distinct())
    said = search.verified(_made(spark, sf_dir, "annotations").withColumn("source", F.struct("verified")))
    first = search.first_per_group(said.select("subject_id", "annotation_id"), "subject_id", "annotation_id").withColumnRenamed("subject_id", "variant_id")
    return rows.join(first, "variant_id", "left").select("n", "k", "annotation_id")
