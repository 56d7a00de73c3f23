"""Further queries of the registry: ingest with rejects, sources and sinks on disk, query rewriting and scoring, the index's look-ups, orders for readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import analyze as T
from ..operators import filters, ingest, layouts, model, ontology, rank, results
from ..sources import files, quads
from ..sources.quads import BASE, RDF_TYPE
from . import query as Q
from .index import Config, Index
from .registry import _SQL_CC, _SQL_DICT, _SQL_RELS, _SQL_TOKENS, _counted, _docs, _graph, _onto, _score, _sql_quads, _sql_rank, _tokens, register
from .store import shared_path

# ---------------------------------------------------------------- ingest

_N = "'<http://data/nation/' || n_nationkey || '>'"
_BAD = f"""bad AS (SELECT CASE n_nationkey % 7 WHEN 0 THEN {_N} || ' <http://data/p> .' WHEN 1 THEN {_N} || ' "p" <http://data/o> .' WHEN 2 THEN '"s" <http://data/p> ' || {_N} || ' .'
 WHEN 3 THEN {_N} || ' <http://data/p> <http://data/a b> .' WHEN 4 THEN {_N} || ' no nodes' WHEN 5 THEN {_N} || ' <http://data/p> "' || repeat('x', 5001) || '" .' ELSE {_N} || ' <http://data/p> "7"@en^^<http://data/t> <http://data/c> .' END AS value,
 CASE n_nationkey % 7 WHEN 0 THEN 'arity' WHEN 1 THEN 'predicate type' WHEN 2 THEN 'subject type' WHEN 3 THEN 'bad iri' WHEN 4 THEN 'parse' WHEN 5 THEN 'long element' END AS reason FROM nation)"""


def _lines(spark, d):
    k = F.col("n_nationkey")
    s = F.concat(F.lit("<http://data/nation/"), k.cast("string"), F.lit(">"))
    tails = [" <http://data/p> .", ' "p" <http://data/o> .', None, " <http://data/p> <http://data/a b> .", " no nodes", ' <http://data/p> "' + "x" * 5001 + '" .', ' <http://data/p> "7"@en^^<http://data/t> <http://data/c> .']
    line = F.concat(F.lit('"s" <http://data/p> '), s, F.lit(" ."))
    for m, x in enumerate(tails):
        if x:
            line = F.when(k % 7 == m, F.concat(s, F.lit(x))).otherwise(line)
    bad = spark.read.parquet(f"{d}/nation.parquet").select(line.alias("value"))
    good = _graph(spark, d, ("customer",)).select(F.concat(F.lit("<"), "s", F.lit("> "), "relation_n3").alias("value"))
    return bad.unionByName(good)


@register("ingest_rejects", f"WITH {_BAD} SELECT value, reason FROM bad WHERE reason IS NOT NULL")
def _(spark, d):
    return ingest.ingest(_lines(spark, d)).rejects


@register("ingest_quads_filtered", f"WITH {_sql_quads(('customer',))} SELECT s, p, o, relation_n3 FROM quads WHERE contains(p, 'name')")
def _(spark, d):
    keep = filters.filter_from_xml("<RegexTupleFilter><predicateRegex>name</predicateRegex><andNotOrConjunction>true</andNotOrConjunction></RegexTupleFilter>")
    return ingest.ingest(_lines(spark, d), [keep]).quads.select("s", "p", "o", "relation_n3")


@register("ingest_counters", f"WITH {_BAD}, {_sql_quads(('customer',))} SELECT 'reject: ' || reason AS counter, count(*) AS n FROM bad WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT x, (SELECT count(*) FROM bad WHERE reason IS NULL) + (SELECT count(*) FROM quads) FROM (VALUES ('good lines'), ('quads kept')) v(x) UNION ALL SELECT 'long relations', 0")
def _(spark, d):
    return ingest.ingest(_lines(spark, d)).counters


@register("quads_parse_retry", f"WITH {_BAD} SELECT 'http://data/nation/' || n_nationkey AS s, '7' AS o, '\"7\"@en' AS o_n3, 'http://data/c' AS c FROM nation WHERE n_nationkey % 7 = 6")
def _(spark, d):
    return ingest.ingest(_lines(spark, d)).quads.where("p = 'http://data/p'").select("s", "o", "o_n3", "c")


@register("model_counters", f"WITH {_sql_quads()}, g AS (SELECT s, count(DISTINCT relation_n3) AS n FROM quads GROUP BY 1) SELECT unnest(['subjects', 'relations', 'repeats', 'beyond the cap', 'subjects cut']) AS counter, CAST(unnest([count(*), sum(least(n, 3)), sum(n), sum(greatest(n - 3, 0)), count(*) FILTER (n > 3)]) AS BIGINT) AS n FROM g")
def _(spark, d):
    q = _graph(spark, d)
    return ingest.model_counters(q.unionByName(q), cap=3)


@register("quads_filter_prefix", f"WITH {_sql_quads()} SELECT s, CASE WHEN p = '{RDF_TYPE}' THEN p ELSE lower('{BASE}customer/' || regexp_extract(p, '([^/]*)$', 1)) END AS p, CASE WHEN p = '{RDF_TYPE}' THEN lower('{BASE}C/' || regexp_extract(o, '([^/]*)$', 1)) ELSE o END AS o FROM quads WHERE (p = '{RDF_TYPE}' AND o LIKE '{BASE}C%') OR p LIKE '{BASE}customer%'")
def _(spark, d):
    return filters.by_prefix(_graph(spark, d), filters.PrefixFilter(BASE + "customer", BASE + "C")).select("s", "p", "o")


@register("quads_filter_xml", f"WITH {_sql_quads()} SELECT s, p, o FROM quads WHERE regexp_matches('<' || s || '>', 'nation/1') OR regexp_matches(o_n3, 'AUTO')")
def _(spark, d):
    f = filters.filter_from_xml("<RegexTupleFilter><subjectRegex>nation/1</subjectRegex><objectRegex>AUTO</objectRegex><andNotOrConjunction>false</andNotOrConjunction></RegexTupleFilter>")
    return filters.by_regex(_graph(spark, d), f).select("s", "p", "o")


@register("predicates_blacklisted", "SELECT n_name AS o FROM nation WHERE n_nationkey % 3 = 2")
def _(spark, d):
    p = F.element_at(F.array(F.lit("stag"), F.lit("CTAG"), F.lit("name")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    rels = spark.read.parquet(f"{d}/nation.parquet").select(p.alias("p"), F.col("n_name").alias("o"))
    return filters.indexed_predicates(rels, lower=True).select("o")


@register("fields_not_indexed", f"WITH {_SQL_TOKENS} SELECT field, count(*) AS n FROM tokens WHERE field <> 'lang' GROUP BY 1")
def _(spark, d):
    t = _tokens(spark, d).withColumn("field", F.when(F.col("field") == "lang", "NOINDEX_lang").otherwise(F.col("field")))
    return filters.indexed_fields(t).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sources and sinks on disk


def _stored(df, name, compression="none"):
    path = shared_path(df.sparkSession, name)
    files.store_lines(df, path, compression=compression)
    return path


def _compressed(how):
    def query(spark, d):
        lines = _graph(spark, d).select(F.concat(F.lit("<"), "s", F.lit("> "), "relation_n3").alias("line"))
        return ingest.ingest_path(spark, _stored(lines, "quads", how)).quads.select("s", "p", "o_type", "o", "c")

    return query


for _how in ("none", "gzip", "bzip2"):
    register(f"quads_from_files_{_how}", f"WITH {_sql_quads()} SELECT s, p, o_type, o, c FROM quads")(_compressed(_how))


@register("lines_written", "SELECT count(*) AS n FROM customer")
def _(spark, d):
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("line"))
    return spark.createDataFrame([(files.write_lines(names, shared_path(spark, "lines")),)], "n long")


@register("record_rejects", "SELECT CASE n_nationkey % 5 WHEN 0 THEN 'not a number' WHEN 1 THEN 'no subject' WHEN 2 THEN 'negative id' WHEN 3 THEN 'bad previous id' END AS reason, count(*) AS n FROM nation WHERE n_nationkey % 5 < 4 GROUP BY 1")
def _(spark, d):
    k, t = F.col("n_nationkey"), "\t"
    kinds = [F.concat(F.lit("x\t1\ts\t"), "n_name"), F.concat(k + 1, F.lit(f"{t}0")), F.concat(F.lit("-2\t-1\ts\t"), "n_name"), F.concat(k + 1, F.lit("\t-9\ts\t"), "n_name"), F.concat(k + 1, F.lit(t), k, F.lit("\ts\t"), "n_name", F.lit(t))]
    line = F.element_at(F.array(*kinds), (k % 5 + 1).cast("int"))
    path = _stored(spark.read.parquet(f"{d}/nation.parquet").select(line.alias("line")), "records")
    return files.read_records(spark, path)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("predicate_list", "SELECT replace(p_type, ' ', '_') AS predicate FROM part")
def _(spark, d):
    lines = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.translate("p_type", " ", "_"), F.lit(" 12\tx")).alias("line"))
    return files.read_predicates(spark, _stored(lines, "predicates"))


@register("block_list_from_file", "WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_]+'), ' ') || ' ' AS line FROM documents) SELECT doc_id FROM w WHERE contains(line, ' in the ') OR contains(line, ' all rights ')")
def _(spark, d):
    phrases = spark.createDataFrame([(" In   the ",), ("all rights",), ("",)], "line string")
    return _docs(spark, d).where(filters.blocked_column(F.col("text"), files.read_phrases(spark, _stored(phrases, "phrases")))).select("doc_id")


@register("prior_rules_from_file", "SELECT r_name AS rule, CAST(r_regionkey AS INTEGER) AS category FROM region")
def _(spark, d):
    r = spark.read.parquet(f"{d}/region.parquet").select(F.concat("r_name", F.lit(" = "), "r_regionkey").alias("line"))
    more = spark.createDataFrame([("# x=1",), ("none",), ("x=y",)], "line string")
    return files.read_prior_rules(spark, _stored(r.unionByName(more), "rules"))


@register("datasets_found", "SELECT lower(replace(r_name, ' ', '_')) AS name FROM region")
def _(spark, d):
    root = shared_path(spark, "root")
    regions = spark.read.parquet(f"{d}/region.parquet").select(F.lower(F.translate("r_name", " ", "_")).alias("name"))
    for r in regions.collect():
        spark.range(1).write.parquet(f"{root}/index-{r['name']}")
    spark.range(1).write.parquet(f"{root}/other")
    return spark.createDataFrame([(n,) for n in files.discover(spark, root)], "name string")


@register("text_lines", "SELECT c_name || chr(10) || 'segment' || chr(9) || c_mktsegment || chr(9) || 'here' AS value FROM customer")
def _(spark, d):
    rel = F.array(F.struct(F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("object"), F.lit("here").alias("context")))
    return files.render(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("subject"), rel.alias("relations")), "txt")


@register("jsonp_lines", "SELECT 'f({\"r_name\":\"' || r_name || '\"});' AS value FROM region")
def _(spark, d):
    return files.render(spark.read.parquet(f"{d}/region.parquet").select("r_name"), "js", callback="f")


@register("xml_lines", "SELECT '<ROW><r_name>' || r_name || '</r_name></ROW>' AS value FROM region")
def _(spark, d):
    x = files.render(spark.read.parquet(f"{d}/region.parquet").select("r_name"), "xml")
    return x.select(F.regexp_replace("value", r">\s+<", "><").alias("value"))


@register("sorted_merge_repeats", "SELECT c_mktsegment AS line FROM customer GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    # each part's own lines; merging a part with itself must fail for every line, and what fails is told here
    part = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("line"))
    try:
        files.merge_sorted([part.distinct(), part.distinct()]).collect()
    except Exception as e:  # noqa: BLE001
        if "line occurs twice" not in str(e):
            raise
        return part.groupBy("line").count().where("count > 1").select("line")
    raise AssertionError("repeated lines were merged")


# ---------------------------------------------------------------- names and words


@register("names_without_version", r"SELECT p_partkey, p_type AS a, 'x_' || p_type AS b FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", T.remove_version(F.concat(F.lit("1.2.3/"), "p_type")).alias("a"), T.remove_version(F.concat(F.lit("x_4_5_"), "p_type")).alias("b"))


@register("display_names", "SELECT page_id, regexp_extract(url, '([^#/]*)$', 1) AS name FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.display_name(F.col("url")).alias("name"))


@register("reference_terms", "SELECT p_partkey, p_partkey % 2 = 0 AS ref FROM part")
def _(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("@"), "p_partkey")).otherwise(F.concat(F.lit("@x"), "p_partkey"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.is_ref(t).alias("ref"))


@register("short_field_names", "SELECT n_name AS name, replace(lower(n_name), '_', '-') AS short FROM nation")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_name", F.concat(F.lit("field_of_"), F.translate(F.lower("n_name"), "_", "-")).alias("f")).collect()
    short = T.short_names([r["f"] for r in rows])
    return spark.createDataFrame([(r["n_name"], short[r["f"]]) for r in rows], "name string, short string")


@register("terms_by_own_steps", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')) AS w FROM documents) WHERE length(w) > 3 GROUP BY 1")
def _(spark, d):
    steps = T.chained(T.lowered, lambda ws: F.filter(ws, lambda w: F.length(w) > 3))
    return layouts.text_tokens(_docs(spark, d), "doc_id", "text", steps).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- queries


def _matched(text, spark, d, short=None, raw=False):
    node = Q.Parser(short=short or {}, raw=raw)(Q.decode_entities(text))
    node = Q.rewrite(node, None, ["lang", "source"]) if not raw else Q.Node("in", (node,), (Q.DEFAULT_FIELD,))
    return Q.matching(node, _tokens(spark, d), _docs(spark, d).select("doc_id"))


@register("q_short_field", f"WITH {_SQL_TOKENS} SELECT DISTINCT doc_id FROM tokens WHERE field = 'source' AND term = 'src3'")
def _(spark, d):
    return _matched("s:src3", spark, d, {"s": "source"})


@register("q_entities", f"WITH {_SQL_TOKENS} SELECT DISTINCT a.doc_id FROM tokens a JOIN tokens b ON a.field = b.field AND a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'thanedble' AND b.term = 'anea'")
def _(spark, d):
    return _matched("&quot;thanedble anea&quot;", spark, d)


@register("q_cleaned", f"WITH {_SQL_TOKENS} SELECT doc_id FROM tokens WHERE term = 'edth' INTERSECT SELECT doc_id FROM tokens WHERE term = 'onen'")
def _(spark, d):
    return _matched(Q.clean_query("  EDTH, (onen)! "), spark, d)


@register("q_raw_type", f"WITH {_SQL_TOKENS} SELECT DISTINCT doc_id FROM tokens WHERE field = 'object' AND term = 'onen'")
def _(spark, d):
    return _matched("onen", spark, d, raw=True)


@register("q_annotated", f"WITH {_SQL_TOKENS} SELECT DISTINCT doc_id FROM tokens WHERE field IN ('object', 'lang', 'source') AND term = 'onen'")
def _(spark, d):
    node = Q.rewrite(Q.Node("annotation", (Q.term("onen"),), "note"), None, ["lang", "source"])
    return Q.matching(node, _tokens(spark, d), _docs(spark, d).select("doc_id"))


def _leaves(text):
    return [x for x, _ in Q.positive_leaves(Q.Parser()(text))]


def _sql_leaf(*leaves):
    """SQL of the score of leaves (condition on term, weight)."""
    sql = _sql_rank({"object": 1.0}, [])
    cond = " OR ".join(f"({c})" for c, _ in leaves)
    w = "greatest(" + ", ".join(f"CASE WHEN {c} THEN {x} ELSE 0 END" for c, x in leaves) + ", 0)"
    return sql.replace("term IN ()", f"({cond})").replace("sum(coalesce(idf, 0)", f"sum({w} * coalesce(idf, 0)")


@register("rank_weighted_query", _sql_leaf(("term = 'thention'", 3.0), ("term = 'edth'", 0.5), ("term = 'onen'", 1.0)))
def _(spark, d):
    return _ranked(spark, d, "thention{3} | (edth | nothere){0.5} | onen")


@register("rank_prefix_query", _sql_leaf(("starts_with(term, 'thent')", 2.0), ("term = 'onen'", 1.0)))
def _(spark, d):
    return _ranked(spark, d, "thent*{2} | onen")


@register("rank_range_query", _sql_leaf(("term >= 'ed' AND term <= 'edb'", 1.0)))
def _(spark, d):
    return _ranked(spark, d, "[ed .. edb]")


def _ranked(spark, d, text):
    t = _tokens(spark, d)
    sizes, n = layouts.doc_sizes(t), _docs(spark, d).count()
    avgdl = layouts.average_length(sizes, n).first()["avgdl"]
    return rank.score(t, sizes, layouts.term_stats(t), _leaves(text), ["object"], n, avgdl).select("doc_id", F.round("score", 4).alias("score"))


# ---------------------------------------------------------------- the index


def _index(spark, d, **config):
    return Index.built(_graph(spark, d), Config(**config))


@register("index_doc_lookup", f"WITH {_SQL_DICT} SELECT id AS subject_id, text AS subject, 1.0::DOUBLE AS score FROM resources WHERE text = '{BASE}nation/3'")
def _(spark, d):
    return _index(spark, d).search(f"doc:{BASE}nation/3")["items"].select("subject_id", "subject", "score")


@register("index_resource_of_id", f"WITH {_SQL_DICT} SELECT id, text FROM resources WHERE id < 50")
def _(spark, d):
    ix = _index(spark, d)
    return model.resource_of(spark.range(50), ix.t["resources"])


@register("index_search_total", f"WITH {_sql_quads()} SELECT count(DISTINCT s) AS n FROM quads WHERE regexp_matches(lower(o), '(^|[^a-z0-9])(building|machinery)([^a-z0-9]|$)') AND o_type = 'LITERAL'")
def _(spark, d):
    return spark.createDataFrame([(_index(spark, d).search("building | machinery")["num_results"],)], "n long")


@register("search_page", f"WITH {_SQL_DICT} SELECT id AS subject_id, text AS subject, len(regexp_split_to_array(text, '/')) AS depth FROM resources JOIN (SELECT s FROM quads WHERE p LIKE '%mktsegment' AND o = 'BUILDING' EXCEPT SELECT s FROM quads WHERE p LIKE '%nationkey' AND o <> '{BASE}nation/3') x ON s = text")
def _(spark, d):
    ix = _index(spark, d)
    ref = ix.ids_of([f"{BASE}nation/3"]).get(f"{BASE}nation/3", -1)
    field = next(short for short, full in ix.aliases.items() if full.endswith("customer_c_nationkey"))
    items = ix.search(f"building {field}:@{ref}", size=None)["items"]
    return items.select("subject_id", "subject", F.size(F.split("subject", "/")).alias("depth"))


@register("index_priors_stored", "SELECT c_custkey AS key, CAST(c_custkey % 3 AS INTEGER) AS category FROM customer")
def _(spark, d):
    q = _graph(spark, d, ("customer",))
    ids = model.dictionary(q).where("n_relations > 0").select(F.col("id").alias("doc_id"), F.regexp_extract("text", "/([0-9]+)$", 1).cast("long").alias("key"))
    ix = Index.built(q, priors=ids.select("doc_id", (F.col("key") % 3).cast("int").alias("category")))
    return ix.priors.join(ids, "doc_id").select("key", "category")


@register("index_titles", f"WITH {_SQL_DICT} SELECT id, text AS title FROM resources")
def _(spark, d):
    return _index(spark, d).titles()


@register("index_documents_in_order", f"WITH {_SQL_DICT} SELECT id, text AS subject FROM resources WHERE n_relations > 0")
def _(spark, d):
    return _index(spark, d).documents().select("id", "subject")


@register("index_own_scorer", f"WITH {_sql_quads()} SELECT DISTINCT s AS subject, 7.0::DOUBLE AS score FROM quads WHERE o = 'BUILDING'")
def _(spark, d):
    ix = _index(spark, d, scorer=lambda tokens, *rest: rest[-2].select("doc_id", F.lit(7.0).alias("score")))
    return ix.search("building", size=None)["items"].select("subject", "score")


@register("index_statistics_predicates", f"WITH {_sql_quads()} SELECT p AS name, count(DISTINCT s) AS count FROM quads GROUP BY 1")
def _(spark, d):
    return _index(spark, d).statistics()["predicates"]


@register("result_fields", f"WITH {_SQL_DICT}{_SQL_RELS} SELECT r.id AS subject_id, p AS predicate, o AS object, c AS context, p LIKE '%name' AS indexed FROM rels JOIN resources r ON r.text = rels.s")
def _(spark, d):
    q = _graph(spark, d)
    docs = model.documents(model.relations(q), model.dictionary(q))
    fields = q.select(F.col("p").alias("predicate")).distinct().where("predicate like '%name'")
    x = results.items(docs.select(F.col("id").alias("doc_id"), F.lit(1.0).alias("score")), docs, fields).select("subject_id", F.explode("relations").alias("r"))
    return x.select("subject_id", "r.predicate", "r.object", "r.context", "r.indexed")


@register("result_truncation", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderstatus AS predicate, repeat(o_orderpriority || ' ', CAST(3 + o_orderkey % 9 AS BIGINT)) AS object, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders),
 f AS (SELECT o_custkey, predicate, k, CASE WHEN length(object) > 320 THEN substr(object, 1, 300) || '...' ELSE object END AS shown, length(CASE WHEN length(object) > 320 THEN substr(object, 1, 300) || '...' ELSE object END) AS used FROM o WHERE k = 1
 UNION ALL SELECT o.o_custkey, o.predicate, o.k, CASE WHEN used + length(object) > 320 THEN substr(object, 1, 300 - used) || '...' ELSE object END, used + length(CASE WHEN used + length(object) > 320 THEN substr(object, 1, 300 - used) || '...' ELSE object END) FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.predicate = f.predicate AND o.k = f.k + 1 WHERE used < 300)
 SELECT o_custkey, predicate, shown FROM f""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    r = F.struct("o_orderkey", F.col("o_orderstatus").alias("predicate"), F.expr("repeat(concat(o_orderpriority, ' '), cast(3 + o_orderkey % 9 as int))").alias("object"), F.lit("LITERAL").alias("o_type"), F.lit(None).cast("string").alias("context"))
    g = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(r)).alias("r"))
    return g.select("o_custkey", F.explode(results.truncated(F.col("r"))).alias("x")).select("o_custkey", "x.predicate", "x.shown")


# ---------------------------------------------------------------- orders and groups for readers


@register("classes_by_count", f"WITH RECURSIVE {_SQL_CC} SELECT class, CAST(count AS BIGINT) AS count, row_number() OVER (ORDER BY count DESC, class) AS place FROM cc")
def _(spark, d):
    return ontology.in_order(_counted(spark, d)[0], "count").select("class", "count", "place")


@register("classes_by_name", f"WITH RECURSIVE {_SQL_CC} SELECT class, row_number() OVER (ORDER BY regexp_extract(class, '([^/]*)$', 1), class) AS place FROM cc")
def _(spark, d):
    return ontology.in_order(_counted(spark, d)[0], "name").select("class", "place")


@register("properties_by_name", f"WITH RECURSIVE {_SQL_CC} SELECT class, property, regexp_extract(property, '#(.*)$', 1) AS name FROM dom WHERE kind = 'data'")
def _(spark, d):
    return ontology.properties(_onto(spark)[2], "data")


def _items(spark, d):
    q = _graph(spark, d)
    docs = model.documents(model.relations(q), model.dictionary(q))
    return results.items(docs.select(F.col("id").alias("doc_id"), F.lit(1.0).alias("score")), docs)


@register("relations_by_field_order", f"WITH {_SQL_DICT}{_SQL_RELS}, x AS (SELECT r.id, p, row_number() OVER (PARTITION BY r.id ORDER BY CASE p WHEN '{RDF_TYPE}' THEN 0 WHEN '{BASE}customer#c_name' THEN 1 ELSE -1 END, ord) AS k FROM rels JOIN resources r ON r.text = rels.s) SELECT id AS subject_id, string_agg(p, ' ' ORDER BY k) AS predicates FROM x GROUP BY 1")
def _(spark, d):
    x = results.by_field_order(_items(spark, d), [RDF_TYPE, BASE + "customer#c_name"])
    return x.select("subject_id", F.array_join(F.transform("relations", lambda r: r["predicate"]), " ").alias("predicates"))


@register("relations_by_predicate", f"WITH {_SQL_DICT}{_SQL_RELS} SELECT r.id AS subject_id, p AS predicate, string_agg(o, ' ' ORDER BY ord) AS objects FROM rels JOIN resources r ON r.text = rels.s GROUP BY 1, 2")
def _(spark, d):
    return results.grouped_relations(_items(spark, d)).select("subject_id", "predicate", F.array_join("objects", " ").alias("objects"))


@register("types_of_subjects", f"WITH {_SQL_DICT} SELECT r.id AS subject_id, string_agg(DISTINCT o, ' ') AS types FROM quads JOIN resources r ON r.text = s WHERE p = '{RDF_TYPE}' GROUP BY 1")
def _(spark, d):
    counts = _graph(spark, d).where(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("name")).count()
    return results.distinct_types(_items(spark, d), RDF_TYPE, counts).select("subject_id", F.array_join("types", " ").alias("types"))
