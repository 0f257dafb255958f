"""Keyword recall, ranking, and the read queries over a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.color import color_similarity, weighted_score
from tessera.functions.text import contains_any, like_wildcards, normalize_text, search_document, substring_score
from tessera.operators.text_index import TextIndex, recall_indexed


def verified(annotations: DataFrame, source: str = "source") -> DataFrame:
    """Annotations whose source is verified: true, not unknown."""
    return annotations.where(F.coalesce(F.col(f"{source}.verified"), F.lit(False)))


def eligible(rows: DataFrame, column: str = "candidate_qualification") -> DataFrame:
    return rows.where(F.col(column).isin("eligible", "conditional"))


def tristate(column: Column, operator: str, value: str | bool) -> Column:
    """Hard condition on a three-valued fact: unknown (null or 'unknown') satisfies neither ``eq``
    nor ``not_eq``."""
    text, known = column.cast("string"), column.isNotNull() & (column.cast("string") != "unknown")
    value = str(value).lower() if isinstance(value, bool) else value
    return F.coalesce(known & ((text == value) if operator == "eq" else (text != value)), F.lit(False))


def hard_filter(rows: DataFrame, conditions: list[tuple[str, str, str | bool]]) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy all conditions (never relaxed), and how many each condition excludes."""
    tests = {f"{c} {op} {str(v).lower() if isinstance(v, bool) else v}": tristate(F.col(c), op, v) for c, op, v in conditions}
    counts = rows.agg(*(F.count_if(~t).alias(n) for n, t in tests.items()))
    kept = rows
    for test in tests.values():
        kept = kept.where(test)
    excluded = counts.unpivot([], list(tests), "condition", "excluded").where("excluded > 0")
    return kept, excluded


def keyword_tokens(requests: DataFrame, keywords: str = "keywords") -> DataFrame:
    """(request_id, token): distinct words of the normalised keywords."""
    words = F.explode(F.split(normalize_text(F.concat_ws(" ", F.col(keywords))), " ")).alias("token")
    return requests.select("request_id", words).where("token <> ''").distinct()


def keyword_intent(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(request_id, token, dimension): tokens routed to the vocabularies that hold them, and all of
    them to the dimension ``keywords``. vocabulary: (token, dimension)."""
    routed = tokens.join(vocabulary, "token").select("request_id", "token", "dimension")
    return routed.unionByName(tokens.withColumn("dimension", F.lit("keywords")))


def input_rules(requests: DataFrame) -> DataFrame:
    """Requests with ``input_error``: 1 to 16 keywords of 1 to 64 characters without repeats after
    trimming, a limit of 1 to 12 (8 if none is given)."""
    words = F.transform("keywords", lambda k: F.trim(k))
    wrong = (F.when(~F.size("keywords").between(1, 16), "keyword count").when(F.exists(words, lambda w: ~F.length(w).between(1, 64)), "keyword length")
             .when(F.size(F.array_distinct(words)) < F.size(words), "keyword repeated").when(~F.coalesce(F.col("limit"), F.lit(8)).between(1, 12), "limit"))
    return requests.withColumn("input_error", wrong).withColumn("limit", F.coalesce(F.col("limit"), F.lit(8)))


def recall(documents: DataFrame, tokens: DataFrame, index: DataFrame | None = None, size: int = 3, requests: DataFrame | None = None) -> DataFrame:
    """(request_id, doc_id): documents that hold any token of the request.

    With a posting ``index``, tokens of ``size`` characters or more are substrings: each looks up only
    its rarest gram and verifies the text, so hot grams are not joined. Shorter tokens, and all without
    an index, are LIKE patterns: their own ``%`` and ``_`` are wildcards. With ``requests``, one without
    tokens recalls every document. Tokens are a stated table; it is sent to the tasks if Spark finds it
    small enough.
    """
    like = lambda some: documents.join(some, like_wildcards(F.col("text"), F.col("token")))
    if index is None:
        found = like(tokens).select("request_id", "doc_id").distinct()
    else:
        distinct = tokens.select("token").distinct()
        grams = distinct.where(F.length("token") >= size).select(
            "token", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - (size - 1)), lambda i: F.substring(F.col("token"), i, F.lit(size))))).alias("gram"))
        wanted = index.join(grams.select("gram").distinct(), "gram", "left_semi")
        rarity = wanted.groupBy("gram").agg(F.count("*").alias("n"))
        rarest = grams.join(rarity, "gram", "left").groupBy("token").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        long = wanted.join(rarest, "gram").join(documents, "doc_id").where(F.col("text").contains(F.col("token"))).select("token", "doc_id")
        short = like(distinct.where(F.length("token") < size)).select("token", "doc_id")
        found = long.unionByName(short).join(tokens, "token").select("request_id", "doc_id").distinct()
    if requests is None:
        return found
    bare = requests.select("request_id").join(tokens.select("request_id"), "request_id", "left_anti").distinct()
    return found.unionByName(bare.join(documents.select("doc_id")))


def rank(candidates: DataFrame, matches: dict[str, Column], limit: int | Column = 8, pool: int = 24, key: str = "doc_id", by: str = "request_id") -> DataFrame:
    """Scored candidates of each request, best first, ties by key; candidate ids T01, T02, ... A match
    that is null is a dimension that the request does not have."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(key).asc())
    scored = candidates.withColumns({f"match_{k}": F.coalesce(m, F.lit(0.0)) for k, m in matches.items()} | {"score": weighted_score(matches)})
    top = scored.withColumn("position", F.row_number().over(order)).where((F.col("position") <= pool) & (F.col("position") <= limit))
    return top.withColumn("candidate_id", F.format_string("T%02d", "position"))


# Texts of the reasons.
def match_reason(matches: list[str], summary: Column | None = None) -> Column:
    named = F.array_compact(F.array(*(F.when(F.col(f"match_{m}") > 0, m) for m in matches)))
    other = F.coalesce(F.substring(F.nullif(summary, F.lit("")), 1, 500) if summary is not None else F.lit(None), F.lit("Deterministic release candidate."))
    return F.when(F.size(named) > 0, F.concat(F.lit("Matches "), F.array_join(named, ", "), F.lit("."))).otherwise(other)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r_")).select(*keys, "r_.*").select(*rows.columns)


def phrase_query(documents: DataFrame, phrase: str, limit: int = 24, prelimit: bool = True) -> DataFrame:
    """(doc_id, score): texts that hold the phrase (of under three characters: as a LIKE pattern). With
    ``prelimit`` the first ``limit`` ids are taken before they are scored; without it the best
    ``limit``, which is held within 1 to 100. An empty phrase matches nothing; quotes count as
    spaces for the match."""
    words, limit = " ".join(phrase.casefold().split()), max(1, min(100, limit))
    query = F.lit(words)
    if not words:
        hit = F.lit(False)
    else:
        hit = F.col("text").contains(F.lit(words.replace('"', " "))) if len(words) >= 3 else like_wildcards(F.col("text"), query)
    hits = documents.where(hit).select("doc_id", substring_score(query, F.col("text")).alias("score"))
    if prelimit:
        hits = hits.orderBy("doc_id").limit(limit)
    return keep_first(hits, ["doc_id"], ["score"]).orderBy(F.desc("score"), "doc_id").limit(limit)


def candidates_of(variants: DataFrame, states: DataFrame, blocks: DataFrame) -> DataFrame:
    """Variants with the columns of their canonical state and their block; without either they drop out.
    Columns of states and blocks that variants have too are left out."""
    own = lambda t, key: t.select(key, *(c for c in t.columns if c != key and c not in variants.columns))
    of_state = own(states.withColumnRenamed("state_id", "canonical_state_id"), "canonical_state_id")
    return variants.join(of_state, "canonical_state_id").join(own(blocks, "block_id"), "block_id")


def first_per_group(rows: DataFrame, group: str, key: str) -> DataFrame:
    """The row with the lowest key of each group."""
    return keep_first(rows, [group], [key])


def stable_byte_sort(rows: DataFrame, key: str) -> DataFrame:
    """Rows by the key's bytes; null counts as an empty text. Equal keys by the other columns."""
    rest = [c for c, kind in rows.dtypes if c != key and not kind.startswith(("map", "variant"))]
    return rows.orderBy(F.coalesce(F.col(key), F.lit("")), *rest)


# Reasons of exclusion, and the qualification that the first one counts.
BY_QUALIFICATION, BY_RECALL, EXCLUDED = "excluded qualification", "text recall", "excluded"

#: Dimensions of the score, and the vocabulary of each (``behavior`` has none).
DIMENSIONS = {"shape": "shape_terms", "color": "colors", "use": "uses", "name_synonym": "keywords", "style": "styles"}


#: Columns of the catalog that candidates carry where the catalog has them.
CARRIED = ["block_id", "display_name", "recommended_state_id", "candidate_qualification", "warnings"]


def search_catalog(variants: DataFrame, states: DataFrame, blocks: DataFrame, annotations: DataFrame, features: DataFrame) -> DataFrame:
    """The catalog that ``search`` reads: variants whose canonical state and block exist, with names, text
    and features.

    variants: variant_id, block_id, canonical_state_id, candidate_qualification, warnings, machine_tags;
    blocks: block_id, zh_cn, en_us; annotations (a row for each annotated variant): variant_id,
    summary_en and the lists synonyms_zh, synonyms_en, building_roles, style_tags; features: variant_id,
    geometry_classes, lab, oklab.
    """
    joined = candidates_of(variants, states, blocks).join(annotations, "variant_id", "left").join(features, "variant_id")
    names = F.array_compact(F.array("zh_cn", "en_us"))
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("synonyms_zh", "synonyms_en", "building_roles", "style_tags", "machine_tags", "geometry_classes")}
    rows = joined.withColumns(lists)
    document = normalize_text(search_document(names, *(F.col(c) for c in lists), F.array("summary_en")))
    return rows.select(
        F.col("variant_id").alias("doc_id"), document.alias("text"), F.concat(names, "synonyms_zh", "synonyms_en").alias("names"), F.col("geometry_classes").alias("shapes"),
        F.col("building_roles").alias("uses"), F.col("style_tags").alias("styles"), "lab", "oklab", F.col("summary_en").alias("summary"), "candidate_qualification", "warnings", "block_id",
        F.coalesce(F.nullif("zh_cn", F.lit("")), F.nullif("en_us", F.lit("")), "variant_id").alias("display_name"), F.col("canonical_state_id").alias("recommended_state_id"))


def search(requests: DataFrame, catalog: DataFrame, vocabulary: DataFrame, colors: DataFrame, index: TextIndex | DataFrame | None = None,
           conditions: list[tuple[str, str, str | bool]] = (), pool: int = 24) -> tuple[DataFrame, DataFrame]:
    """Candidates and exclusions of requests (request_id, keywords, limit).

    Requests that break the input rules have no result. catalog: rows (doc_id, text, names, shapes,
    uses, styles: arrays of texts; lab, oklab; candidate_qualification, summary; columns of the
    conditions; any of CARRIED), as search_catalog makes them. Rows that are not eligible or fail a
    condition are never candidates. Each dimension that a request has words for scores 0 to 1; the
    score is their weighted mean. ``index``: a stored text index of the catalog's texts, or postings.
    Candidates: (request_id, candidate_id, doc_id, score, match_<dimension>, reason, carried columns).
    Exclusions: (request_id, reason, count) without zeros: rows whose qualification is ``excluded``, eligible
    rows that fail each condition (named by it), and rows that keyword recall left out.
    """
    asked = input_rules(requests).where("input_error is null").select("request_id", "keywords", "limit")
    tokens = keyword_tokens(asked)
    terms = keyword_intent(tokens, vocabulary).groupBy("request_id").pivot("dimension", list(DIMENSIONS.values())).agg(F.array_sort(F.collect_set("token")))
    terms = terms.select("request_id", *(F.col(v).alias(f"asked_{d}") for d, v in DIMENSIONS.items()))
    targets = tokens.join(colors, "token").groupBy("request_id").agg(F.collect_list(F.struct("lab", "oklab")).alias("targets"))
    fit = eligible(catalog)
    kept, failed = hard_filter(fit, list(conditions))
    if index is None or isinstance(index, DataFrame):
        found = recall(kept.select("doc_id", "text"), tokens, index, requests=asked)
    else:
        found = recall_indexed(index, tokens, requests=asked, among=kept)
    rows = found.join(kept, "doc_id").join(asked.select("request_id", "limit"), "request_id").join(terms, "request_id", "left").join(targets, "request_id", "left")
    has = lambda dimension: F.coalesce(F.size(f"asked_{dimension}"), F.lit(0)) > 0
    of = {"shape": "shapes", "use": "uses", "name_synonym": "names", "style": "styles"}
    matches = {d: F.when(has(d), contains_any(F.col(of[d]), F.col(f"asked_{d}")) if d in of else color_similarity(F.col("lab"), F.col("oklab"), F.col("targets"))) for d in DIMENSIONS}
    ranked = rank(rows, matches, F.col("limit"), pool)
    carried = [c for c in CARRIED if c in catalog.columns]
    out = ranked.withColumn("reason", match_reason(list(matches), F.col("summary"))).select("request_id", "candidate_id", "doc_id", "score", *(f"match_{d}" for d in DIMENSIONS), "reason", *carried)
    # A row for each fixed reason, whatever the catalog's size; then recall, which differs by request.
    fixed = catalog.agg(F.count_if(F.col("candidate_qualification") == EXCLUDED).alias("count")).select(F.lit(BY_QUALIFICATION).alias("reason"), "count")
    fixed = fixed.unionByName(failed.select(F.col("condition").alias("reason"), F.col("excluded").alias("count")))
    recalled = asked.select("request_id").join(found.groupBy("request_id").agg(F.count("*").alias("n")), "request_id", "left").join(kept.agg(F.count("*").alias("kept")))
    missed = recalled.select("request_id", F.lit(BY_RECALL).alias("reason"), (F.col("kept") - F.coalesce("n", F.lit(0))).alias("count"))
    return out, asked.select("request_id").join(fixed).unionByName(missed).where("count > 0")


def exclusion_summary(counts: dict[str, Column], rows: DataFrame) -> DataFrame:
    """(reason, count) with zero counts left out."""
    return rows.agg(*(c.alias(n) for n, c in counts.items())).unpivot([], list(counts), "reason", "count").where("count > 0")


def apply_external_ranking(candidates: DataFrame, ranking: DataFrame) -> DataFrame:
    """Reorder candidates by an outside ranking (request_id, candidate_id, fit, pos) if it names
    exactly the request's candidates; else their own order stays."""
    own = candidates.groupBy("request_id").agg(F.array_sort(F.collect_list("candidate_id")).alias("own"))
    theirs = ranking.groupBy("request_id").agg(F.array_sort(F.collect_list("candidate_id")).alias("theirs"))
    usable = own.join(theirs, "request_id").where("own = theirs").select("request_id", F.lit(True).alias("usable"))
    joined = candidates.join(usable, "request_id", "left").join(ranking.select("request_id", "candidate_id", "fit", "pos"), ["request_id", "candidate_id"], "left")
    order = F.when(F.col("usable"), F.col("pos")).otherwise(F.col("position"))
    final = F.row_number().over(Window.partitionBy("request_id").orderBy(order, "candidate_id"))
    return joined.withColumn("final_position", final).withColumn("score_source", F.when(F.col("usable"), "external").otherwise("local")).drop("usable")


def entity_details(entities: DataFrame, children: DataFrame, key: str, order: list[str], name: str = "children") -> DataFrame:
    """One nested row for each entity: its columns and a sorted list of its children."""
    columns = [*order, *(c for c in children.columns if c not in (key, *order))]
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return entities.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def entity_compare(rows: DataFrame, key: str, fields: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, field, values): fields in which the rows (of each group) differ, with each row's value. A
    group is a stated handful of entities; its values are one map."""
    text = rows.select(*by, key, *(F.col(f).cast("string").alias(f) for f in fields))
    long = text.unpivot([*by, key], fields, "field", "value")
    return long.groupBy(*by, "field").agg(F.count("value").alias("n"), F.count_distinct("value").alias("different"),
                                     F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "value")))).alias("values")).where("n >= 2 and different > 1").select(*by, "field", "values")


def contact_sheet(rows: DataFrame, by: str, order: str, columns: int = 4, tiles: int = 16) -> DataFrame:
    """Place of each row in its group's grid: (sheet, grid_row, grid_column)."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("at", at).withColumns({
        "sheet": F.floor(F.col("at") / tiles), "grid_row": F.floor(F.col("at") % tiles / columns), "grid_column": F.col("at") % columns}).drop("at")
