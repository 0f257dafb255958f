"""Search, projection, colour and geometry queries over the driver's tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tessera.functions.color import color_similarity, rgb_to_lab, rgb_to_oklab
from tessera.functions.text import canonical_key, contains_any, normalize_text, search_document
from tessera.operators import geometry, pixels, search, text_index
from tessera.plans.registry import query, read
from tessera.sources.shared import shared_folder, shared_root

_PART_TEXT = "lower(p_name || ' ' || p_brand || ' ' || p_type)"


def _catalog(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type", "p_brand", "p_size", F.expr(_PART_TEXT).alias("text"))


def part_index(spark, sf_dir, texts):
    """The stored index of the parts' texts: built once in the shared folder, then kept up with the table."""
    return text_index.ensure_index(texts.select("doc_id", "text"), f"{shared_root(spark)}/part-index-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}", buckets=4)


def _search(spark, sf_dir, requests):
    """Recall in the stored index, rank and cut for a table of requests (request_id, keywords)."""
    catalog = _catalog(spark, sf_dir)
    asked = spark.createDataFrame(requests, "request_id string, keywords array<string>")
    tokens = search.keyword_tokens(asked)
    terms = tokens.groupBy("request_id").agg(F.array_sort(F.collect_list("token")).alias("terms"))
    found = text_index.recall_indexed(part_index(spark, sf_dir, catalog), tokens).join(catalog, "doc_id").join(terms, "request_id")
    shapes = F.filter("terms", lambda t: t.isin("economy", "small", "medium", "promo", "standard", "large"))
    matches = {
        "shape": F.when(F.size(shapes) > 0, contains_any(F.array("p_type"), shapes)),
        "name_synonym": contains_any(F.array("p_name"), F.col("terms")),
        "style": contains_any(F.array("p_brand"), F.col("terms")),
    }
    ranked = search.rank(found, matches, limit=12).withColumn("reason", search.match_reason(list(matches)))
    return ranked.select("request_id", "candidate_id", "doc_id", "p_name", F.round("score", 6).alias("score"), "reason")


_SEARCH_SQL = """
WITH requests AS (SELECT * FROM (VALUES {values}) v(request_id, token)),
shapes AS (SELECT request_id, token FROM requests WHERE token IN ('economy','small','medium','promo','standard','large')),
found AS (
  SELECT DISTINCT r.request_id, p_partkey AS doc_id, p_name, p_type, p_brand FROM part, requests r
  WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), r.token)),
matched AS (
  SELECT f.*,
    CASE WHEN EXISTS (SELECT 1 FROM shapes s WHERE s.request_id = f.request_id) THEN
      CASE WHEN EXISTS (SELECT 1 FROM shapes s WHERE s.request_id = f.request_id AND contains(lower(p_type), s.token)) THEN 1.0 ELSE 0.0 END END AS shape,
    CASE WHEN EXISTS (SELECT 1 FROM requests r WHERE r.request_id = f.request_id AND contains(lower(p_name), r.token)) THEN 1.0 ELSE 0.0 END AS name_synonym,
    CASE WHEN EXISTS (SELECT 1 FROM requests r WHERE r.request_id = f.request_id AND contains(lower(p_brand), r.token)) THEN 1.0 ELSE 0.0 END AS style
  FROM found f),
scored AS (
  SELECT *, (coalesce(shape * 0.35, 0) + name_synonym * 0.10 + style * 0.05)::DOUBLE
            / (CASE WHEN shape IS NULL THEN 0.0 ELSE 0.35 END + 0.10 + 0.05)::DOUBLE AS score FROM matched),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 8) DESC, doc_id) AS pos FROM scored)
SELECT request_id, printf('T%02d', pos) AS candidate_id, doc_id, p_name, round(score, 6) AS score,
  CASE WHEN coalesce(shape, 0) + name_synonym + style > 0 THEN 'Matches ' || concat_ws(', ',
    CASE WHEN shape > 0 THEN 'shape' END, CASE WHEN name_synonym > 0 THEN 'name_synonym' END, CASE WHEN style > 0 THEN 'style' END) || '.'
  ELSE 'Deterministic release candidate.' END AS reason
FROM ranked WHERE pos <= 12
"""


@query(_SEARCH_SQL.format(values="('r1','red'),('r1','bolt'),('r1','economy')"))
def catalog_search_part(spark, sf_dir):
    """One request: names, types and brands as search dimensions."""
    return _search(spark, sf_dir, [("r1", ["Red bolt", " economy "])])


@query(_SEARCH_SQL.format(values="('a','blue'),('a','ring'),('b','brand#1'),('c','promo'),('c','widget'),('d','none-such')"))
def batch_search_requests(spark, sf_dir):
    """A table of requests in one plan."""
    return _search(spark, sf_dir, [("a", ["blue", "ring"]), ("b", ["Brand#1"]), ("c", ["PROMO widget"]), ("d", ["none-such"])])


@query("""
WITH tokens AS (SELECT * FROM (VALUES ('q1','idiot'),('q2','licensed'),('q2','apache'),('q3','+1'),('q4','zzzzqq')) v(request_id, token))
SELECT DISTINCT request_id, doc_id FROM documents, tokens WHERE contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), token)
""")
def trigram_recall_documents(spark, sf_dir):
    """Posting-table recall with verification; a short token scans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("text"))
    asked = [("q1", "idiot"), ("q2", "licensed"), ("q2", "apache"), ("q3", "+1"), ("q4", "zzzzqq")]
    tokens = spark.createDataFrame(asked, "request_id string, token string")
    grams = sorted({t[i:i + 3] for _, t in asked for i in range(len(t) - 2)})
    return search.recall(docs, tokens, text_index.postings(docs, only=grams))


_CHANGED = "CASE WHEN doc_id % 100 = 1 THEN text || ' zebra quagga' ELSE text END"


@query(f"""
WITH before AS (SELECT doc_id, lower(text) AS t FROM documents),
after AS (SELECT doc_id, lower({_CHANGED}) AS t FROM documents WHERE doc_id % 100 <> 2 UNION ALL SELECT doc_id + 1000000000, lower(text) FROM documents WHERE doc_id % 100 = 3),
tokens AS (SELECT * FROM (VALUES ('a', 'licensed'), ('b', 'zebra'), ('b', 'apache'), ('c', 'qu'), ('d', 'no-such-token')) v(request_id, token))
SELECT DISTINCT 'before' AS stage, request_id, doc_id FROM before, tokens WHERE contains(t, token)
UNION ALL SELECT DISTINCT stage, request_id, doc_id FROM after, tokens, (VALUES ('after'), ('compacted')) s(stage) WHERE contains(t, token)
UNION ALL SELECT 'parity', 'stale texts', count(*) FROM documents WHERE doc_id % 100 IN (1, 2, 3) AND text IS NOT NULL
UNION ALL SELECT 'parity', 'changed documents kept', 0 UNION ALL SELECT 'parity', 'unequal buckets', 0
""")
def text_index_update(spark, sf_dir):
    """Recall before and after an update of some hundredths of the texts (changed, removed, added) and after
    compaction; parity of the old index with the new texts, and of the new one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lower = lambda d: d.withColumn("text", F.lower("text"))
    now = docs.withColumn("text", F.expr(_CHANGED)).where("doc_id % 100 <> 2").unionByName(docs.where("doc_id % 100 = 3").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    tokens = spark.createDataFrame([("a", "licensed"), ("b", "zebra"), ("b", "apache"), ("c", "qu"), ("d", "no-such-token")], "request_id string, token string")
    first = text_index.create_index(lower(docs), shared_folder(spark, "text-index"))
    second = text_index.update_index(first, lower(now))
    third = text_index.compact(second)
    out = None
    for stage, index in (("before", first), ("after", second), ("compacted", third)):
        own = text_index.recall_indexed(index, tokens).select(F.lit(stage).alias("stage"), "request_id", "doc_id")
        out = own if out is None else out.unionByName(own)
    counted = lambda name, rows: rows.agg(F.count("*").alias("doc_id")).select(F.lit("parity").alias("stage"), F.lit(name).alias("request_id"), "doc_id")
    return (out.unionByName(counted("stale texts", text_index.text_parity(first, lower(now)))).unionByName(counted("changed documents kept", text_index.text_parity(second, lower(now))))
            .unionByName(counted("unequal buckets", text_index.posting_parity(second).where("not equal"))))


@query("""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents),
h AS (SELECT doc_id, t FROM d WHERE contains(t, 'of the') ORDER BY doc_id LIMIT 24)
SELECT doc_id, round(CASE WHEN t = 'of the' THEN 1.0 ELSE 0.5 + 6.0 / greatest(length(t), 1) / 2 END, 6)::DOUBLE AS score FROM h
""")
def phrase_score_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("text"))
    return search.phrase_query(docs, "Of the").select("doc_id", F.round("score", 6).alias("score"))


@query("""
WITH l AS (SELECT l_partkey, list_distinct(list(l_returnflag)) AS flags, list_distinct(list(l_linestatus)) AS states FROM lineitem GROUP BY 1)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [p_brand, p_type], coalesce(flags, []), coalesce(states, [])))), ' ') AS document
FROM part LEFT JOIN l ON l_partkey = p_partkey
""")
def search_document_projection(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_linestatus").alias("states"))
    part = read(spark, sf_dir, "part")
    return part.join(lines, part["p_partkey"] == lines["l_partkey"], "left").select(
        "p_partkey", search_document(F.split("p_name", " "), F.array("p_brand", "p_type"), F.col("flags"), F.col("states")).alias("document"))


@query("""
SELECT p_partkey, 'part' || '[' || 'brand=' || p_brand || ',' || 'size=' || p_size || ',' || 'type=' || p_type || ']' AS key FROM part
""")
def canonical_key_part(spark, sf_dir):
    properties = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", canonical_key(F.lit("part"), properties).alias("key"))


_RGB_SQL = """
rgb AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 91 + 13) % 256 AS g, (p_partkey * 53 + 101) % 256 AS b FROM part),
lin AS (SELECT p_partkey,
  CASE WHEN r/255.0 <= 0.04045 THEN r/255.0::DOUBLE/12.92 ELSE pow((r/255.0::DOUBLE+0.055)/1.055, 2.4) END AS r,
  CASE WHEN g/255.0 <= 0.04045 THEN g/255.0::DOUBLE/12.92 ELSE pow((g/255.0::DOUBLE+0.055)/1.055, 2.4) END AS g,
  CASE WHEN b/255.0 <= 0.04045 THEN b/255.0::DOUBLE/12.92 ELSE pow((b/255.0::DOUBLE+0.055)/1.055, 2.4) END AS b FROM rgb),
lms AS (SELECT p_partkey, r, g, b,
  cbrt(0.4122214708::DOUBLE*r+0.5363325363::DOUBLE*g+0.0514459929::DOUBLE*b) AS l, cbrt(0.2119034982::DOUBLE*r+0.6806995451::DOUBLE*g+0.1073969566::DOUBLE*b) AS m,
  cbrt(0.0883024619::DOUBLE*r+0.2817188376::DOUBLE*g+0.6299787005::DOUBLE*b) AS s,
  (0.4124564::DOUBLE*r+0.3575761::DOUBLE*g+0.1804375::DOUBLE*b)/0.95047 AS x, 0.2126729::DOUBLE*r+0.7151522::DOUBLE*g+0.0721750::DOUBLE*b AS y,
  (0.0193339::DOUBLE*r+0.1191920::DOUBLE*g+0.9503041::DOUBLE*b)/1.08883 AS z FROM lin),
f AS (SELECT *, CASE WHEN x > pow(6.0/29,3) THEN cbrt(x) ELSE x/(3*pow(6.0/29,2))+4.0/29 END AS fx,
  CASE WHEN y > pow(6.0/29,3) THEN cbrt(y) ELSE y/(3*pow(6.0/29,2))+4.0/29 END AS fy, CASE WHEN z > pow(6.0/29,3) THEN cbrt(z) ELSE z/(3*pow(6.0/29,2))+4.0/29 END AS fz FROM lms),
vectors AS (SELECT p_partkey,
  0.2104542553*l+0.7936177850*m-0.0040720468*s AS ok0, 1.9779984951*l-2.4285922050*m+0.4505937099*s AS ok1, 0.0259040371*l+0.7827717662*m-0.8086757660*s AS ok2,
  116*fy-16 AS lab0, 500*(fx-fy) AS lab1, 200*(fy-fz) AS lab2 FROM f)
"""


@query(f"""
WITH {_RGB_SQL},
s AS (SELECT p_partkey, 1 - (0.5*sqrt(pow(lab0-53.2,2)+pow(lab1-80.1,2)+pow(lab2-67.2,2))/181.0 + 0.5*sqrt(pow(ok0-0.628,2)+pow(ok1-0.225,2)+pow(ok2-0.126,2))/sqrt(3.0)) AS v FROM vectors)
SELECT p_partkey, round(greatest(0.0, least(1.0, v)), 4) AS similarity FROM s
""")
def color_similarity_part(spark, sf_dir):
    """Similarity of each part's colour (made from its key) to red."""
    key = F.col("p_partkey")
    rgb = [((key * a + b) % 256).cast("double") for a, b in ((37, 0), (91, 13), (53, 101))]
    red = F.array(F.struct(F.array(*map(F.lit, (53.2, 80.1, 67.2))).alias("lab"), F.array(*map(F.lit, (0.628, 0.225, 0.126))).alias("oklab")))
    vectors = read(spark, sf_dir, "part").select("p_partkey", rgb_to_lab(*rgb).alias("lab"), rgb_to_oklab(*rgb).alias("oklab"))
    return vectors.select("p_partkey", F.round(color_similarity(F.col("lab"), F.col("oklab"), red), 4).alias("similarity"))


_PIXELS_SQL = """
pixels AS (SELECT DISTINCT ON (image_id, x, y) * FROM (
  SELECT l_orderkey % 97 AS image_id, (l_partkey % 24)::INT AS x, (l_suppkey % 16)::INT AS y,
    (l_partkey * 7 + l_suppkey) % 24 AS k FROM lineitem) ORDER BY image_id, x, y, k),
coloured AS (SELECT image_id, x, y, (k * 10)::INT AS r, ((k * 37) % 256)::INT AS g, ((k * 91) % 256)::INT AS b,
  CASE WHEN k % 5 = 0 THEN 0 ELSE 255 END AS a, CASE WHEN k % 3 = 0 THEN 0 ELSE 255 END AS mask_a FROM pixels)
"""


def _pixels(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    k = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 24
    grid = lines.select((F.col("l_orderkey") % 97).alias("image_id"), (F.col("l_partkey") % 24).cast("int").alias("x"), (F.col("l_suppkey") % 16).cast("int").alias("y"), k.alias("k"))
    grid = grid.groupBy("image_id", "x", "y").agg(F.min("k").alias("k"))
    return grid.select("image_id", "x", "y", (F.col("k") * 10).cast("int").alias("r"), ((F.col("k") * 37) % 256).cast("int").alias("g"), ((F.col("k") * 91) % 256).cast("int").alias("b"),
                       F.when(F.col("k") % 5 == 0, 0).otherwise(255).alias("a"), F.when(F.col("k") % 3 == 0, 0).otherwise(255).alias("mask_a"))


@query(f"""
WITH {_PIXELS_SQL}
SELECT image_id, round(count(*) FILTER (WHERE mask_a > 0) / count(*), 5) AS mask_coverage, round(count(*) FILTER (WHERE a = 0) / count(*), 5) AS transparent_ratio,
  round(coalesce(avg(r / 255.0::DOUBLE) FILTER (WHERE mask_a > 0), 0), 5) AS red,
  round(coalesce(avg((0.2126*r+0.7152*g+0.0722*b)/255.0::DOUBLE) FILTER (WHERE mask_a > 0), 0), 5) AS brightness,
  round(coalesce(avg(CASE WHEN greatest(r,g,b) = 0 THEN 0 ELSE (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b)::DOUBLE END) FILTER (WHERE mask_a > 0), 0), 5) AS saturation
FROM coloured GROUP BY 1
""")
def pixel_color_stats(spark, sf_dir):
    s = pixels.color_stats(_pixels(spark, sf_dir))
    return s.select("image_id", *(F.round(c, 5).alias(n) for n, c in (
        ("mask_coverage", F.col("mask_coverage")), ("transparent_ratio", F.col("transparent_ratio")), ("red", F.get("average_rgb", F.lit(0))), ("brightness", F.col("brightness")), ("saturation", F.col("saturation")))))


@query(f"""
WITH {_PIXELS_SQL}, own AS (SELECT image_id, x, y FROM coloured WHERE mask_a > 0),
e AS (SELECT o.image_id, count(*) AS n, count(*) FILTER (WHERE r.x IS NULL) AS h, count(*) FILTER (WHERE d.x IS NULL) AS v
  FROM own o LEFT JOIN own r ON r.image_id = o.image_id AND r.x = o.x + 1 AND r.y = o.y LEFT JOIN own d ON d.image_id = o.image_id AND d.x = o.x AND d.y = o.y + 1 GROUP BY 1)
SELECT i.image_id, coalesce(round((h + v) / greatest(1, n * 2), 5), 0) AS edge_density, coalesce(round(abs(h - v) / greatest(1, h + v), 5), 0) AS directionality
FROM (SELECT DISTINCT image_id FROM coloured) i LEFT JOIN e USING (image_id)
""")
def pixel_edges(spark, sf_dir):
    s = pixels.edge_stats(_pixels(spark, sf_dir))
    return s.select("image_id", F.round("edge_density", 5).alias("edge_density"), F.round("directionality", 5).alias("directionality"))


@query(f"""
WITH {_PIXELS_SQL}, size AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM coloured GROUP BY 1)
SELECT image_id, min(x) FILTER (WHERE a > 0) AS "left", max(y) FILTER (WHERE a > 0) AS bottom, count(*) FILTER (WHERE a > 0) AS object_pixels, count(*) FILTER (WHERE a = 0) AS background_pixels,
  count(*) FILTER (WHERE a > 0 AND x >= width // 2 AND y >= height // 2) AS quadrant_3, count(*) FILTER (WHERE a > 0) = 0 AS empty,
  coalesce(min(x) FILTER (WHERE a > 0) = 0 OR min(y) FILTER (WHERE a > 0) = 0 OR max(x) FILTER (WHERE a > 0) = max(width) - 1 OR max(y) FILTER (WHERE a > 0) = max(height) - 1, false) AS off_canvas
FROM coloured JOIN size USING (image_id) GROUP BY 1
""")
def pixel_quality(spark, sf_dir):
    return pixels.quality_stats(_pixels(spark, sf_dir)).select("image_id", "left", "bottom", "object_pixels", "background_pixels", "quadrant_3", "empty", "off_canvas")


_BOXES = {
    "min_x": "(l_linenumber % 4) / 4.0D", "min_y": "(l_suppkey % 4) / 4.0D", "min_z": "(l_partkey % 4) / 4.0D",
    "max_x": "(l_linenumber % 4 + l_partkey % 3) / 4.0D", "max_y": "(l_suppkey % 4 + l_linenumber % 3) / 4.0D", "max_z": "(l_partkey % 4 + l_suppkey % 3) / 4.0D",
}


@query(f"""
WITH boxes AS (SELECT l_orderkey, {', '.join(f"{v.replace('4.0D', '4.0::DOUBLE')} AS {k}" for k, v in _BOXES.items())} FROM lineitem),
own AS (SELECT * FROM boxes WHERE max_x > min_x AND max_y > min_y AND max_z > min_z),
units AS (SELECT x / 4.0::DOUBLE AS x, y / 4.0::DOUBLE AS y, z / 4.0::DOUBLE AS z FROM range(0, 6) a(x), range(0, 6) b(y), range(0, 6) c(z)),
held AS (SELECT DISTINCT l_orderkey, x, y, z FROM own, units WHERE x >= min_x AND x < max_x AND y >= min_y AND y < max_y AND z >= min_z AND z < max_z),
v AS (SELECT l_orderkey, count(*) / 64.0::DOUBLE AS volume FROM held GROUP BY 1),
e AS (SELECT l_orderkey, max(max_x) - min(min_x) AS width, max(max_y) - min(min_y) AS height, max(max_z) - min(min_z) AS depth FROM own GROUP BY 1)
SELECT o.l_orderkey, coalesce(volume, 0) AS volume, coalesce(width, 0) AS width, coalesce(height, 0) AS height, coalesce(depth, 0) AS depth
FROM (SELECT DISTINCT l_orderkey FROM boxes) o LEFT JOIN v USING (l_orderkey) LEFT JOIN e USING (l_orderkey)
""")
def box_union_volume(spark, sf_dir):
    boxes = read(spark, sf_dir, "lineitem").select("l_orderkey", *(F.expr(v).alias(k) for k, v in _BOXES.items()))
    return geometry.box_union(boxes, "l_orderkey").select("l_orderkey", "volume", "width", "height", "depth")


@query("""
WITH agg AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus, coalesce(lines, '') AS lines, coalesce(n, 0) AS n FROM orders LEFT JOIN agg ON l_orderkey = o_orderkey
""")
def entity_details(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    nested = search.entity_details(orders, lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["l_linenumber"].cast("string"), c["l_partkey"].cast("string"))), ",")
    return nested.select("o_orderkey", "o_orderstatus", text.alias("lines"), F.size("children").cast("long").alias("n"))


@query("""
WITH l AS (SELECT p_brand, p_size, p_partkey, 'p_name' AS field, p_name AS value FROM part UNION ALL SELECT p_brand, p_size, p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_brand, p_size, p_partkey, 'brand_again', p_brand FROM part)
SELECT p_brand, p_size, field, string_agg(p_partkey || '=' || value, ',' ORDER BY p_partkey) AS vals FROM l GROUP BY ALL HAVING count(value) >= 2 AND count(DISTINCT value) > 1
""")
def entity_compare(spark, sf_dir):
    """Parts of one brand and size are compared with each other."""
    rows = read(spark, sf_dir, "part").withColumn("brand_again", F.col("p_brand"))
    out = search.entity_compare(rows, "p_partkey", ["p_name", "p_type", "brand_again"], ("p_brand", "p_size"))
    return out.select("p_brand", "p_size", "field", F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ",").alias("vals"))


@query("""
SELECT event_id, event_type FROM events WHERE event_type <> 'view' AND event_type <> 'error'
""")
def tristate_filter(spark, sf_dir):
    """Errors count as unknown: they satisfy neither ``eq`` nor ``not_eq``."""
    rows = read(spark, sf_dir, "events").withColumn("fact", F.when(F.col("event_type") != "error", F.col("event_type")))
    kept, _ = search.hard_filter(rows, [("fact", "not_eq", "view")])
    return kept.select("event_id", "event_type")


@query("""
SELECT 'fact eq click' AS condition, count(*) FILTER (WHERE event_type <> 'click') AS excluded FROM events
UNION ALL SELECT 'value_known eq true', count(*) FILTER (WHERE value IS NULL OR value <= 5) FROM events
""")
def hard_filter_exclusions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumns({"fact": F.when(F.col("event_type") != "error", F.col("event_type")), "value_known": F.col("value") > 5})
    _, excluded = search.hard_filter(rows, [("fact", "eq", "click"), ("value_known", "eq", True)])
    return excluded


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (place // 16) AS sheet, (place % 16) // 4 AS grid_row, place % 4 AS grid_column FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS place FROM lineitem)
""")
def contact_sheet_layout(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return search.contact_sheet(rows, "l_orderkey", "o").drop("o")
