"""Queries over the test tables, one for each operator of the inventory, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analyze as T
from ..operators import algebra as A
from ..operators import filters, layouts, model, ontology, rank, results
from ..sources import files, quads
from ..sources.quads import BASE, RDF_TYPE, TABLES
from . import query as Q
from .store import written

GRAPH = ("region", "nation", "supplier", "customer", "part")
CLASSES = [("Thing", ""), ("Party", "Party"), ("Place", "Place"), ("Customer", "Customer"), ("Supplier", "Supplier"), ("Nation", "Nation"), ("Region", "Region"), ("Part", "Part"), ("Ghost", "")]
SUBCLASS = [("Party", "Thing"), ("Place", "Thing"), ("Customer", "Party"), ("Supplier", "Party"), ("Nation", "Place"), ("Region", "Place")]
DOMAINS = [("customer#c_name", "data", "Customer"), ("customer#c_mktsegment", "data", "Customer"), ("supplier#s_name", "data", "Supplier"), ("nation#n_name", "data", "Place"), ("region#r_name", "data", "Place"), ("customer#c_nationkey", "object", "Customer"), ("thing#label", "data", "Thing")]
RULES = [("example.com", 2), ("spam-farm.example.org cheap-pills.example.com", 0), ("ththin.example.com", 1)]


def _graph(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = GRAPH) -> DataFrame:
    return quads.mapped(spark, sf_dir, names)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tokens of documents: `object` has the text, `lang` and `source` theirs; all of them are parallel to nothing else."""
    d = _docs(spark, sf_dir)
    parts = [layouts.text_tokens(d, "doc_id", c, T.STOP_WORDS, f) for c, f in (("text", "object"), ("lang", "lang"), ("source", "source"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _onto(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame([(BASE + c, label) for c, label in CLASSES], "iri string, label string"),
        spark.createDataFrame([(BASE + a, BASE + b) for a, b in SUBCLASS], "child string, parent string"),
        spark.createDataFrame([(BASE + p, k, BASE + c) for p, k, c in DOMAINS], "property string, kind string, class string"),
    )


# ---------------------------------------------------------------- SQL pieces


def _sql_n3(x: str) -> str:
    for a, b in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        x = f"replace({x}, {a}, {b})"
    return f"'\"' || {x} || '\"'"


def _sql_quads(names: tuple[str, ...] = GRAPH) -> str:
    parts = []
    for t in TABLES:
        if t.name not in names:
            continue
        s, c = f"'{BASE}{t.name}/' || {t.key}", f"{BASE}{t.name}"
        for x in t.literals:
            parts.append(f"SELECT {s} AS s, '{c}#{x}' AS p, 'LITERAL' AS o_type, CAST({x} AS VARCHAR) AS o, '{c}' AS c FROM {t.name} WHERE {x} IS NOT NULL")
        for x, to in t.links:
            parts.append(f"SELECT {s}, '{c}#{x}', 'RESOURCE', '{BASE}{to}/' || {x}, '{c}' FROM {t.name} WHERE {x} IS NOT NULL")
        parts.append(f"SELECT {s}, '{RDF_TYPE}', 'RESOURCE', '{BASE}{t.kind}', '{c}' FROM {t.name}")
    n3 = f"CASE WHEN o_type = 'LITERAL' THEN {_sql_n3('o')} ELSE '<' || o || '>' END"
    return f"q0 AS ({' UNION ALL '.join(parts)}), quads AS (SELECT *, {n3} AS o_n3, '<' || p || '> ' || {n3} || ' <' || c || '> .' AS relation_n3 FROM q0)"


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _sql_terms(x: str, stop: bool = True) -> str:
    cut = f" AND lower(w) NOT IN ({_STOP})" if stop else ""
    return f"[lower(w) FOR w IN regexp_extract_all({x}, '[\\p{{L}}\\p{{Nd}}]+') IF regexp_full_match(w, '[a-zA-Z0-9_]+'){cut}]"


_SQL_TOKENS = "t0 AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, doc_id, {_sql_terms(c)} AS w FROM documents WHERE {c} IS NOT NULL" for c, f in (("text", "object"), ("lang", "lang"), ("source", "source"))) + "), tokens AS (SELECT field, doc_id, CAST(unnest(generate_series(1, len(w))) - 1 AS INTEGER) AS pos, unnest(w) AS term FROM t0)"
_SQL_ROLES = _sql_quads() + ", roles AS (SELECT p AS resource, 'PREDICATE' AS role FROM quads UNION ALL SELECT o, 'OBJECT' FROM quads WHERE o_type = 'RESOURCE' UNION ALL SELECT c, 'CONTEXT' FROM quads UNION ALL SELECT s, relation_n3 FROM quads)"
_SQL_DICT = _SQL_ROLES + """, resources AS (SELECT row_number() OVER (ORDER BY resource) - 1 AS id, resource AS text, count(DISTINCT CASE WHEN role NOT IN ('PREDICATE', 'OBJECT', 'CONTEXT') THEN role END) AS n_relations,
 count(*) FILTER (role = 'PREDICATE') AS n_predicate, count(*) FILTER (role = 'OBJECT') AS n_object, count(*) FILTER (role = 'CONTEXT') AS n_context FROM roles GROUP BY resource)"""
_SQL_RELS = """, rels AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY relation_n3) - 1 AS ord, p, o_type, o, c, relation_n3 FROM (SELECT DISTINCT s, p, o_type, o, c, relation_n3 FROM quads))"""
_SQL_H = _SQL_DICT + _SQL_RELS + f""", named AS (SELECT r.*, d.id AS doc_id, pr.id AS pid, cr.id AS cid, orr.id AS oid FROM rels r JOIN resources d ON d.text = r.s JOIN resources pr ON pr.text = r.p JOIN resources cr ON cr.text = r.c LEFT JOIN resources orr ON orr.text = r.o AND r.o_type = 'RESOURCE'),
 wt AS (SELECT doc_id, ord, p, pid, cid, CASE WHEN oid IS NOT NULL THEN ['@' || oid] ELSE {_sql_terms('o')} END AS w FROM named),
 wx AS (SELECT doc_id, ord, p, pid, cid, unnest(generate_series(1, len(w))) AS k, unnest(w) AS term FROM wt),
 hx AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) - 1 AS pos, row_number() OVER (PARTITION BY doc_id, p ORDER BY ord, k) - 1 AS vpos FROM wx),
 sj AS (SELECT DISTINCT doc_id, s FROM named), sw AS (SELECT doc_id, list_concat(['@' || doc_id], {_sql_terms("substr(s, strpos(s, ':') + 1)")}) AS w FROM sj)"""
_SQL_HTOK = _SQL_H + """, htok AS (SELECT 'object' AS field, doc_id, CAST(pos AS INTEGER) AS pos, term FROM hx UNION ALL SELECT 'predicate', doc_id, CAST(pos AS INTEGER), '@' || pid FROM hx UNION ALL SELECT 'context', doc_id, CAST(pos AS INTEGER), '@' || cid FROM hx
 UNION ALL SELECT 'subject', doc_id, 0, '@' || doc_id FROM sj UNION ALL SELECT 'subjectText', doc_id, CAST(unnest(generate_series(1, len(w))) - 1 AS INTEGER), unnest(w) FROM sw)"""
_SQL_ONTO = "cls(class, label) AS (VALUES " + ", ".join(f"('{BASE}{c}', '{x}')" for c, x in CLASSES) + "), sub(child, parent) AS (VALUES " + ", ".join(f"('{BASE}{a}', '{BASE}{b}')" for a, b in SUBCLASS) + "), dom(property, kind, class) AS (VALUES " + ", ".join(f"('{BASE}{p}', '{k}', '{BASE}{c}')" for p, k, c in DOMAINS) + "), clo AS (SELECT child AS class, parent AS ancestor FROM sub UNION SELECT clo.class, sub.parent FROM clo JOIN sub ON sub.child = clo.ancestor)"
_SQL_CC = _sql_quads() + ", " + _SQL_ONTO + f", met AS (SELECT o AS class, count(*) AS count FROM quads WHERE p = '{RDF_TYPE}' GROUP BY 1), cc AS (SELECT class, sum(count) AS count FROM (SELECT met.class, count FROM met JOIN cls USING (class) UNION ALL SELECT DISTINCT ancestor, 0 FROM clo WHERE class IN (SELECT class FROM met)) GROUP BY 1)"

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def put(f):
        REGISTRY[name] = (f, sql)
        return f

    return put


# ---------------------------------------------------------------- quads and model


@register("quads_direct_map", f"WITH {_sql_quads()} SELECT s, p, o_type, o, c, relation_n3 FROM quads")
def _(spark, d):
    return _graph(spark, d).select("s", "p", "o_type", "o", "c", "relation_n3")


@register("quads_documents", f"WITH {_sql_quads(('documents',))} SELECT s, p, o_n3 FROM quads")
def _(spark, d):
    return _graph(spark, d, ("documents",)).select("s", "p", "o_n3")


@register("nquads_parse", f"WITH {_sql_quads(('region', 'nation', 'customer', 'documents'))} SELECT s, p, o_type, o, c, relation_n3 FROM quads")
def _(spark, d):
    q = _graph(spark, d, ("region", "nation", "customer", "documents"))
    lines = q.select(F.concat(F.lit("<"), "s", F.lit("> "), "relation_n3").alias("value"))
    return quads.as_quads(quads.parse_nodes(lines)).select("s", "p", "o_type", "o", "c", "relation_n3")


@register("quads_without_contexts", f"WITH {_sql_quads()} SELECT s, '<' || p || '> ' || o_n3 || ' .' AS relation_n3 FROM quads")
def _(spark, d):
    lines = _graph(spark, d).select(F.concat(F.lit("<"), "s", F.lit("> "), "relation_n3").alias("value"))
    return quads.as_quads(quads.parse_nodes(lines), contexts=False).select("s", "relation_n3")


def _bad_lines(spark, d):
    n = F.col("n_nationkey")
    s = F.concat(F.lit("<http://data/nation/"), n.cast("string"), F.lit(">"))
    line = (
        F.when(n % 6 == 0, F.concat(s, F.lit(" <http://data/p> .")))
        .when(n % 6 == 1, F.concat(s, F.lit(' "p" <http://data/o> .')))
        .when(n % 6 == 2, F.concat(F.lit('"s" <http://data/p> '), s, F.lit(" .")))
        .when(n % 6 == 3, F.concat(s, F.lit(" <http://data/p> <http://data/a b> .")))
        .when(n % 6 == 4, F.concat(s, F.lit(" no nodes")))
        .otherwise(F.concat(s, F.lit(" <http://data/p> <http://data/o> <http://data/c> <http://data/x> .")))
    )
    return quads.parse_nodes(spark.read.parquet(f"{d}/nation.parquet").select(line.alias("value")))


@register("quads_reject_counts", "SELECT CASE n_nationkey % 6 WHEN 0 THEN 'arity' WHEN 1 THEN 'predicate type' WHEN 2 THEN 'subject type' WHEN 3 THEN 'bad iri' ELSE 'parse' END AS reason, count(*) AS n FROM nation WHERE n_nationkey % 6 <> 5 GROUP BY 1")
def _(spark, d):
    return filters.reject_counts(_bad_lines(spark, d))


@register("quads_filter_regex_and", f"WITH {_sql_quads()} SELECT s, p, o FROM quads WHERE regexp_matches('<' || p || '>', 'name') AND regexp_matches(o_n3, '[13]')")
def _(spark, d):
    return filters.by_regex(_graph(spark, d), filters.RegexFilter(predicate="name", object="[13]")).select("s", "p", "o")


@register("quads_filter_regex_or", f"WITH {_sql_quads()} SELECT s, p, o FROM quads WHERE regexp_matches('<' || p || '>', 'mkt') OR regexp_matches('<' || s || '>', 'nation/1')")
def _(spark, d):
    return filters.by_regex(_graph(spark, d), filters.RegexFilter(predicate="mkt", subject="nation/1", conjunction=False)).select("s", "p", "o")


@register("role_counts", f"WITH {_SQL_DICT} SELECT text, n_relations, n_predicate, n_object, n_context FROM resources")
def _(spark, d):
    return model.role_counts(_graph(spark, d))


@register("dictionary_ids", f"WITH {_SQL_DICT} SELECT id, text FROM resources")
def _(spark, d):
    return model.dense_ids(model.role_counts(_graph(spark, d)), part_rows=1000).select("id", "text")


@register("dictionary_with_classes", f"WITH {_SQL_ROLES}, {_SQL_ONTO} SELECT row_number() OVER (ORDER BY text) - 1 AS id, text FROM (SELECT resource AS text FROM roles UNION SELECT class FROM cls)")
def _(spark, d):
    return model.dictionary(_graph(spark, d), _onto(spark)[0]).select("id", "text")


@register("relations_dedup_cap", f"WITH {_sql_quads()}{_SQL_RELS} SELECT s, CAST(ord AS INTEGER) AS ord, relation_n3 FROM rels WHERE ord < 3")
def _(spark, d):
    q = _graph(spark, d)
    return model.relations(q.unionByName(q), cap=3).select("s", "ord", "relation_n3")


@register("docs_previous_id", f"WITH {_SQL_DICT}, sub AS (SELECT id, text AS subject FROM resources WHERE n_relations > 0) SELECT id, coalesce(lag(id) OVER (ORDER BY id), -1) AS previous_id, subject FROM sub")
def _(spark, d):
    q = _graph(spark, d)
    r = model.dictionary(q)
    ids = model.relations(q).select(F.col("s").alias("text")).distinct().join(r.select("id", "text"), "text").select("id", F.col("text").alias("subject"))
    return model.with_previous(ids, span=100).select("id", "previous_id", "subject")


@register("documents_built", f"WITH {_SQL_DICT}{_SQL_RELS} SELECT r.id, string_agg(relation_n3, chr(9) ORDER BY ord) AS relations FROM rels JOIN resources r ON r.text = rels.s GROUP BY 1")
def _(spark, d):
    q = _graph(spark, d)
    docs = model.documents(model.relations(q), model.dictionary(q))
    return docs.select("id", F.array_join(F.transform("relations", lambda r: r["n3"]), "\t").alias("relations"))


@register("top_predicates", f"WITH {_SQL_DICT} SELECT text AS predicate, n_predicate AS uses FROM resources WHERE n_predicate > 0 ORDER BY n_predicate DESC, text LIMIT 5")
def _(spark, d):
    return model.top_predicates(model.dictionary(_graph(spark, d)), 5)


@register("dictionary_misses", f"WITH {_sql_quads()} SELECT 'predicate' AS slot, count(*) FILTER (p LIKE '%name%') AS n FROM quads UNION ALL SELECT 'object', count(*) FILTER (o LIKE '%/nation/1%') FROM quads WHERE o_type = 'RESOURCE'")
def _(spark, d):
    q = _graph(spark, d)
    known = model.dictionary(q).where("text not like '%name%' and text not like '%/nation/1%'")
    return layouts.missing(q, known)


@register("has_content", f"WITH {_SQL_DICT} SELECT id FROM resources WHERE n_relations > 0")
def _(spark, d):
    q = _graph(spark, d)
    r = model.dictionary(q)
    return model.has_content(r.select("id"), model.subject_ids(model.relations(q), r))


# ---------------------------------------------------------------- names and text


@register("field_encode", f"WITH {_sql_quads()} SELECT DISTINCT p AS predicate, regexp_replace(p, '[^a-zA-Z0-9]+', '_', 'g') AS field FROM quads")
def _(spark, d):
    return layouts.check_fields(_graph(spark, d).select(F.col("p").alias("predicate")).distinct())


@register("local_name", f"WITH {_sql_quads()} SELECT DISTINCT p AS iri, CASE WHEN p LIKE '%#_%' THEN regexp_extract(p, '^[^#]*#(.+)$', 1) ELSE regexp_extract(p, '/([^/]+)/*$', 1) END AS name FROM (SELECT p FROM quads UNION SELECT o FROM quads WHERE o_type = 'RESOURCE')")
def _(spark, d):
    q = _graph(spark, d)
    iris = q.select(F.col("p").alias("iri")).union(q.where("o_type = 'RESOURCE'").select("o")).distinct()
    return iris.select("iri", T.local_name(F.col("iri")).alias("name"))


@register("host_extract", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.lower(T.host(F.col("url"))).alias("host"))


@register("short_numbers", "SELECT n, CASE WHEN n >= 1000000 THEN '~' || (n // 1000000) || ' million' WHEN n >= 1000 THEN '~' || (n // 1000) || ' thousand' ELSE CAST(n AS VARCHAR) END AS shown FROM (SELECT DISTINCT o_orderkey * 977 AS n FROM orders)")
def _(spark, d):
    n = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") * 977).alias("n")).distinct()
    return n.select("n", T.short_number(F.col("n")).alias("shown"))


@register("tokens_docs", f"WITH {_SQL_TOKENS} SELECT field, doc_id, pos, term FROM tokens")
def _(spark, d):
    return _tokens(spark, d)


@register("tokens_subject_text", f"WITH {_SQL_HTOK} SELECT doc_id, pos, term FROM htok WHERE field = 'subjectText'")
def _(spark, d):
    q = _graph(spark, d)
    named = layouts.with_ids(model.relations(q), model.dictionary(q))
    return layouts.horizontal_tokens(named).where("field = 'subjectText'").select("doc_id", "pos", "term")


@register("tokens_stemmed", None)
def _(spark, d):
    return T.stemmed(_tokens(spark, d))


@register("horizontal_fields", f"WITH {_SQL_HTOK} SELECT field, doc_id, pos, term FROM htok")
def _(spark, d):
    q = _graph(spark, d)
    return layouts.horizontal_tokens(layouts.with_ids(model.relations(q), model.dictionary(q)))


@register("vertical_fields", f"WITH {_SQL_H} SELECT regexp_replace(p, '[^a-zA-Z0-9]+', '_', 'g') AS field, doc_id, CAST(vpos AS INTEGER) AS pos, term FROM hx")
def _(spark, d):
    q = _graph(spark, d)
    r = model.dictionary(q)
    return layouts.vertical_tokens(layouts.with_ids(model.relations(q), r), model.top_predicates(r))


@register("vertical_ancestors", f"WITH {_SQL_H}, {_SQL_ONTO} SELECT doc_id, term FROM hx WHERE p = '{RDF_TYPE}' UNION ALL SELECT n.doc_id, '@' || a.id FROM named n JOIN clo ON clo.class = n.o JOIN resources a ON a.text = clo.ancestor WHERE n.p = '{RDF_TYPE}'".replace("SELECT o, 'OBJECT' FROM quads WHERE o_type = 'RESOURCE'", "SELECT o, 'OBJECT' FROM quads WHERE o_type = 'RESOURCE' UNION ALL SELECT class, 'EXTRA' FROM (VALUES " + ", ".join(f"('{BASE}{c}')" for c, _ in CLASSES) + ") x(class)").replace("('PREDICATE', 'OBJECT', 'CONTEXT')", "('PREDICATE', 'OBJECT', 'CONTEXT', 'EXTRA')"))
def _(spark, d):
    q = _graph(spark, d)
    classes, sub, _ = _onto(spark)
    r = model.dictionary(q, classes)
    types = spark.createDataFrame([(RDF_TYPE,)], "predicate string")
    up = ontology.ancestor_ids(ontology.closure(sub), r)
    return layouts.vertical_tokens(layouts.with_ids(model.relations(q), r), types, up).select("doc_id", "term")


@register("doc_term_stats", f"WITH {_SQL_TOKENS} SELECT field, doc_id, term, CAST(count(*) AS INTEGER) AS tf, max(pos) AS last_pos FROM tokens GROUP BY 1, 2, 3")
def _(spark, d):
    return layouts.doc_term_stats(_tokens(spark, d))


@register("term_stats", f"WITH {_SQL_TOKENS}, x AS (SELECT field, doc_id, term, count(*) AS tf, max(pos) AS m FROM tokens GROUP BY 1, 2, 3) SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(sum(m) AS BIGINT) AS sum_max_pos FROM x GROUP BY 1, 2")
def _(spark, d):
    return layouts.term_stats(_tokens(spark, d))


@register("doc_sizes", f"WITH {_SQL_TOKENS} SELECT field, doc_id, CAST(count(*) AS INTEGER) AS size FROM tokens GROUP BY 1, 2")
def _(spark, d):
    return layouts.doc_sizes(_tokens(spark, d))


@register("doc_sizes_zero_filled", f"WITH {_SQL_TOKENS}, z AS (SELECT doc_id, count(*) AS size FROM tokens WHERE field = 'object' AND term LIKE 'th%' GROUP BY 1) SELECT doc_id, CAST(coalesce(size, 0) AS INTEGER) AS size FROM documents LEFT JOIN z USING (doc_id)")
def _(spark, d):
    sizes = layouts.doc_sizes(_tokens(spark, d).where("term like 'th%'"))
    return layouts.zero_filled(sizes, _docs(spark, d).select(F.col("doc_id").alias("id")), "object")


@register("postings_positions", f"WITH {_SQL_TOKENS} SELECT field, term, doc_id, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tokens GROUP BY 1, 2, 3")
def _(spark, d):
    p = layouts.postings(_tokens(spark, d))
    return p.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@register("alignment", f"WITH {_SQL_TOKENS} SELECT DISTINCT term, field FROM tokens")
def _(spark, d):
    return layouts.alignment(_tokens(spark, d))


@register("alignment_counts", f"WITH {_SQL_TOKENS} SELECT term, count(DISTINCT field) AS n_fields FROM tokens GROUP BY 1")
def _(spark, d):
    return layouts.alignment_counts(_tokens(spark, d))


@register("avg_doc_length", f"WITH {_SQL_TOKENS} SELECT round(count(*) / (SELECT count(*) FROM documents), 6) AS avgdl FROM tokens WHERE field = 'object'")
def _(spark, d):
    n = _docs(spark, d).count()
    return layouts.average_length(layouts.doc_sizes(_tokens(spark, d)), n).select(F.round("avgdl", 6).alias("avgdl"))


@register("idf_table", f"WITH {_SQL_TOKENS}, x AS (SELECT term, count(DISTINCT doc_id) AS df FROM tokens WHERE field = 'object' GROUP BY 1), n AS (SELECT count(*) AS n FROM documents) SELECT term, round(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))), 6) AS idf FROM x, n")
def _(spark, d):
    n = _docs(spark, d).count()
    return rank.idf(layouts.term_stats(_tokens(spark, d)), n).select("term", F.round("idf", 6).alias("idf"))


@register("term_histogram", f"WITH {_SQL_HTOK} SELECT r.text, count(DISTINCT h.doc_id) AS df FROM htok h JOIN resources r ON '@' || r.id = h.term WHERE h.field = 'predicate' GROUP BY 1")
def _(spark, d):
    q = _graph(spark, d)
    r = model.dictionary(q)
    t = layouts.horizontal_tokens(layouts.with_ids(model.relations(q), r))
    return layouts.term_histogram(layouts.term_stats(t.where("field = 'predicate'")), r, "predicate")


# ---------------------------------------------------------------- retrieval


def _found(text: str, fields: list[str] | None = None):
    """The documents that a query of the language matches; bare terms are looked for in all fields."""
    def run(spark, d):
        t = _tokens(spark, d)
        node = Q.rewrite(Q.Parser()(text), None, ["lang", "source"])
        return Q.matching(node, t, _docs(spark, d).select("doc_id"), fields)

    return run


def _has(term: str, fields: str = "'object', 'lang', 'source'") -> str:
    return f"(SELECT doc_id FROM tokens WHERE term {term} AND field IN ({fields}))"


def _ask(name: str, text: str, where: str) -> None:
    register(name, f"WITH {_SQL_TOKENS} SELECT doc_id FROM documents WHERE {where}")(_found(text))


_ask("q_term", "thention", f"doc_id IN {_has(chr(61) + chr(39) + 'thention' + chr(39))}")
_ask("q_prefix", "thent*", f"doc_id IN {_has('LIKE ' + chr(39) + 'thent%' + chr(39), chr(39) + 'object' + chr(39))}")
_ask("q_range", "[thea .. thed]", f"doc_id IN {_has('BETWEEN ' + chr(39) + 'thea' + chr(39) + ' AND ' + chr(39) + 'thed' + chr(39), chr(39) + 'object' + chr(39))}")
_EQ = lambda w, f="'object', 'lang', 'source'": _has(f"= '{w}'", f)
_ask("q_and", "onen & edth", f"doc_id IN {_EQ('onen')} AND doc_id IN {_EQ('edth')}")
_ask("q_or", "onen | edth", f"doc_id IN {_EQ('onen')} OR doc_id IN {_EQ('edth')}")
_ask("q_not", "!thea", f"doc_id NOT IN {_EQ('thea')}")
_ask("q_difference", "onen - edth", f"doc_id IN {_EQ('onen')} AND doc_id NOT IN {_EQ('edth')}")
_ask("q_select_field", "lang:fr & source:src3", f"doc_id IN {_EQ('fr', chr(39) + 'lang' + chr(39))} AND doc_id IN {_EQ('src3', chr(39) + 'source' + chr(39))}")
_ask("q_true", "#TRUE", "true")
_ask("q_false", "#FALSE", "false")
_ask("q_nested", "(onen | edth) & !(source:src3 | lang:fr)", f"(doc_id IN {_EQ('onen')} OR doc_id IN {_EQ('edth')}) AND NOT (doc_id IN {_EQ('src3', chr(39) + 'source' + chr(39))} OR doc_id IN {_EQ('fr', chr(39) + 'lang' + chr(39))})")
_PAIR = "doc_id IN (SELECT a.doc_id FROM tokens a JOIN tokens b USING (field, doc_id) WHERE a.term = '{0}' AND b.term = '{1}' AND {2})"
_ask("q_phrase", '"attion thanedble"', _PAIR.format("attion", "thanedble", "b.pos = a.pos + 1"))
_ask("q_ordered_and", "object:(thea < onen)", _PAIR.format("thea", "onen", "b.pos > a.pos"))
_ask("q_lowpass", "object:((thea onen)~6)", _PAIR.format("thea", "onen", "abs(b.pos - a.pos) < 6"))


@register("q_multiterm", f"WITH {_SQL_TOKENS} SELECT DISTINCT doc_id FROM tokens WHERE term IN ('onen', 'edth', 'thea') AND field IN ('object', 'lang', 'source')")
def _(spark, d):
    node = Q.rewrite(Q.Node("multi", (), ("onen", "edth", "thea")), None, ["lang", "source"])
    return Q.matching(node, _tokens(spark, d), _docs(spark, d).select("doc_id"))


@register("q_span_difference", f"WITH {_SQL_TOKENS} SELECT DISTINCT a.doc_id FROM tokens a JOIN tokens b ON b.field = a.field AND b.doc_id = a.doc_id AND b.pos = a.pos + 2 WHERE a.field = 'object' AND a.term = 'ha' AND EXISTS (SELECT 1 FROM tokens c WHERE c.field = a.field AND c.doc_id = a.doc_id AND c.pos = a.pos + 1 AND c.term <> 'ti')")
def _(spark, d):
    t = written(_tokens(spark, d).where("field = 'object'"), "tokens")  # five operands read them
    every = t.select("field", "doc_id", F.col("pos").alias("l"), F.col("pos").alias("r"))
    three = A.consecutive([A.term(t, "ha"), every, every])
    return A.docs(A.span_difference(three, A.consecutive([A.term(t, "ha"), A.term(t, "ti")])))


@register("q_remap", f"WITH {_SQL_TOKENS} SELECT DISTINCT doc_id FROM tokens WHERE field = 'lang' AND term = 'de'")
def _(spark, d):
    t = _tokens(spark, d)
    return A.docs(A.select(A.remap(A.term(t, "de", ["lang"]), {"lang": "language"}), "language"))


@register("q_align", f"WITH {_SQL_HTOK} SELECT DISTINCT a.doc_id FROM htok a JOIN htok b USING (doc_id, pos) JOIN resources p ON '@' || p.id = a.term WHERE a.field = 'predicate' AND p.text = '{BASE}customer#c_mktsegment' AND b.field = 'object' AND b.term = 'building'")
def _(spark, d):
    q = _graph(spark, d)
    r = model.dictionary(q)
    t = layouts.horizontal_tokens(layouts.with_ids(model.relations(q), r))
    pid = r.where(F.col("text") == f"{BASE}customer#c_mktsegment").first()["id"]
    return Q.matching(Q.Parser()(f"predicate:@{pid} ^ object:building"), t, r.select(F.col("id").alias("doc_id")))


@register("q_type_only", f"WITH {_SQL_DICT} SELECT r.id AS doc_id, CAST(1.0 AS DOUBLE) AS score FROM quads JOIN resources r ON r.text = quads.s WHERE p = '{RDF_TYPE}' AND o = '{BASE}Nation'")
def _(spark, d):
    from .index import Index

    ix = Index.built(_graph(spark, d))
    return ix.ranked(ix.parse(f"type:{{{BASE}Nation}}"))


@register("q_by_class", f"WITH {_SQL_DICT} SELECT r.id AS doc_id FROM quads a JOIN quads b ON b.s = a.s JOIN resources r ON r.text = a.s WHERE a.p = '{RDF_TYPE}' AND a.o = '{BASE}Customer' AND b.p = '{BASE}customer#c_mktsegment' AND b.o = 'BUILDING'")
def _(spark, d):
    from .index import Index

    ix = Index.built(_graph(spark, d))
    return ix.matching(ix.parse(Q.by_class(f"{BASE}Customer", {f"{BASE}customer#c_mktsegment": "building"})))


@register("q_doc_lookup", f"WITH {_SQL_DICT} SELECT id, text AS subject FROM resources WHERE text = '{BASE}nation/7'")
def _(spark, d):
    q = _graph(spark, d)
    r = model.dictionary(q)
    return model.subject_ids(model.relations(q), r).where(F.col("subject") == f"{BASE}nation/7").select("id", "subject")


# ---------------------------------------------------------------- ranking


def _sql_rank(weights: dict[str, float], terms: list[str], extra: str = "") -> str:
    w = "CASE field " + " ".join(f"WHEN '{f}' THEN {x!r}" for f, x in weights.items()) + " END"
    ts = ", ".join(f"'{t}'" for t in terms)
    fs = ", ".join(f"'{f}'" for f in weights)
    return f"""WITH {_SQL_TOKENS}, n AS (SELECT count(*) AS n FROM documents), sz AS (SELECT doc_id, count(*) AS size FROM tokens WHERE field = 'object' GROUP BY 1), av AS (SELECT sum(size) / (SELECT n FROM n) AS avgdl FROM sz),
    idf AS (SELECT term, greatest(1e-6, ln(((SELECT n FROM n) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5))) AS idf FROM tokens WHERE field = 'object' GROUP BY 1),
    vc AS (SELECT doc_id, term, sum({w} / (0.25 + 0.75 * greatest(coalesce(size, 0), 10) / avgdl)) AS vc FROM tokens LEFT JOIN sz USING (doc_id), av WHERE term IN ({ts}) AND field IN ({fs}) GROUP BY 1, 2),
    sc AS (SELECT doc_id, sum(coalesce(idf, 0) * 2.2 * vc / (vc + 1.2)) * least(count(*), 5) / 5 AS score FROM vc LEFT JOIN idf USING (term) GROUP BY 1)
    {extra or "SELECT doc_id, round(score, 4) AS score FROM sc"}"""


def _score(spark, d, terms, fields, weights=rank.Weights(), priors=None):
    t = _tokens(spark, d)
    sizes = layouts.doc_sizes(t)
    n = _docs(spark, d).count()
    avgdl = layouts.average_length(sizes, n).first()["avgdl"]
    return rank.score(t, sizes, layouts.term_stats(t.where(F.col("term").isin(*terms))), terms, fields, n, avgdl, weights, priors=priors)


@register("rank_bm25f_single_field", _sql_rank({"object": 1.0}, ["thention", "edth", "onen"]))
def _(spark, d):
    return _score(spark, d, ["thention", "edth", "onen"], ["object"]).select("doc_id", F.round("score", 4).alias("score"))


_W3 = rank.Weights(field_class={"object": rank.IMPORTANT, "lang": rank.NEUTRAL})


@register("rank_bm25f_multi_field", _sql_rank(rank.field_weights(["object", "lang", "source"], _W3), ["thention", "src3", "onen", "en"]))
def _(spark, d):
    return _score(spark, d, ["thention", "src3", "onen", "en"], ["object", "lang", "source"], _W3).select("doc_id", F.round("score", 4).alias("score"))


@register("rank_with_priors", _sql_rank({"object": 1.0}, ["edth", "onen"], "SELECT doc_id, round(score * CASE WHEN quality = 1 THEN 1.08 ELSE 1.0 END, 4) AS score FROM sc LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)"))
def _(spark, d):
    priors = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", (F.col("q") * rank.IMPORTANT).alias("category"))
    return _score(spark, d, ["edth", "onen"], ["object"], priors=priors).select("doc_id", F.round("score", 4).alias("score"))


@register("page_offset_limit", _sql_rank({"object": 1.0}, ["thention", "edth", "onen"], "SELECT doc_id, round(score, 4) AS score FROM sc ORDER BY round(score, 8) DESC, doc_id LIMIT 10 OFFSET 10"))
def _(spark, d):
    s = _score(spark, d, ["thention", "edth", "onen"], ["object"]).select("doc_id", F.round("score", 8).alias("score"))
    return rank.top(s, 10, 10).select("doc_id", F.round("score", 4).alias("score"))


@register("host_priors", "WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages), r(rule, category) AS (VALUES " + ", ".join(f"('{r}', {c})" for r, c in RULES) + ") SELECT page_id AS doc_id, max(category) AS category FROM h JOIN r ON contains(rule, host) WHERE host <> '' GROUP BY 1")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.lower(T.host(F.col("url"))).alias("host"))
    return rank.host_priors(pages, spark.createDataFrame(RULES, "rule string, category int"))


# ---------------------------------------------------------------- ontology


@register("onto_closure", f"WITH RECURSIVE {_SQL_ONTO} SELECT class, ancestor FROM clo")
def _(spark, d):
    return ontology.closure(_onto(spark)[1])


@register("onto_closure_recursive", f"WITH RECURSIVE {_SQL_ONTO} SELECT class, ancestor FROM clo")
def _(spark, d):
    return ontology.closure_sql(_onto(spark)[1])


def _counted(spark, d):
    classes, sub, dom = _onto(spark)
    types = _graph(spark, d).where(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("name")).count()
    closed = ontology.closure(sub)
    return ontology.class_counts(types, classes, closed), sub, dom, closed


@register("onto_class_counts", f"WITH RECURSIVE {_SQL_CC} SELECT class, CAST(count AS BIGINT) AS count, label FROM cc JOIN cls USING (class)")
def _(spark, d):
    return _counted(spark, d)[0]


@register("onto_roots", f"WITH RECURSIVE {_SQL_CC} SELECT class, CAST(count AS BIGINT) AS count FROM cc WHERE class NOT IN (SELECT child FROM sub)")
def _(spark, d):
    c, sub, _, _ = _counted(spark, d)
    return ontology.roots(c, sub)


@register("onto_children", f"WITH RECURSIVE {_SQL_CC} SELECT parent AS class, child FROM sub WHERE parent IN (SELECT class FROM cc) AND child IN (SELECT class FROM cc)")
def _(spark, d):
    c, sub, _, _ = _counted(spark, d)
    return ontology.children(c, sub).select("class", "child")


@register("onto_inherited_properties", f"WITH RECURSIVE {_SQL_CC} SELECT class, property FROM cc JOIN dom USING (class) WHERE kind = 'data' UNION SELECT cc.class, dom.property FROM cc JOIN clo ON clo.class = cc.class JOIN dom ON dom.class = clo.ancestor WHERE kind = 'data'")
def _(spark, d):
    c, _, dom, closed = _counted(spark, d)
    return ontology.inherited_properties(c, dom, closed)


@register("onto_class_stats", f"WITH RECURSIVE {_SQL_CC}, ip AS (SELECT class, property FROM cc JOIN dom USING (class) WHERE kind = 'data' UNION SELECT cc.class, dom.property FROM cc JOIN clo ON clo.class = cc.class JOIN dom ON dom.class = clo.ancestor WHERE kind = 'data') SELECT regexp_extract(class, '([^/]*)$', 1) AS local_name, CAST(count AS BIGINT) AS count, coalesce((SELECT string_agg(property, ' ' ORDER BY property) FROM ip WHERE ip.class = cc.class), '') AS properties, coalesce((SELECT string_agg(child, ' ' ORDER BY child) FROM sub WHERE sub.parent = cc.class AND child IN (SELECT class FROM cc)), '') AS children FROM cc")
def _(spark, d):
    s = ontology.class_stats(*[_counted(spark, d)[i] for i in (0, 1, 2, 3)])
    return s.select("local_name", "count", F.array_join("properties", " ").alias("properties"), F.array_join("children", " ").alias("children"))


@register("property_counts", f"WITH {_sql_quads()}, {_SQL_ONTO} SELECT property, count(*) AS count FROM quads JOIN (SELECT DISTINCT property FROM dom WHERE kind = 'data') x ON property = p GROUP BY 1".replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    preds = _graph(spark, d).groupBy(F.col("p").alias("name")).count()
    return ontology.property_counts(_onto(spark)[2], preds)


# ---------------------------------------------------------------- results and small tools


@register("deref_labels", f"WITH {_SQL_DICT}, lab AS (SELECT s, max(o) AS label FROM quads WHERE p LIKE '%name' GROUP BY 1) SELECT a.id AS subject_id, q.p AS predicate, b.id AS subject_id_of_object, lab.label FROM quads q JOIN resources a ON a.text = q.s JOIN resources b ON b.text = q.o AND b.n_relations > 0 JOIN lab ON lab.s = q.o WHERE q.o_type = 'RESOURCE'")
def _(spark, d):
    q = _graph(spark, d)
    docs = model.documents(model.relations(q), model.dictionary(q))
    page = docs.select(F.col("id").alias("doc_id"), F.lit(1.0).alias("score"))
    x = results.items(page, docs).select("subject_id", F.explode("relations").alias("r"))
    return x.select("subject_id", "r.predicate", "r.subject_id_of_object", "r.label").where("subject_id_of_object is not null")


@register("block_list_filter", "WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_]+'), ' ') || ' ' AS line FROM documents) SELECT doc_id FROM w WHERE contains(line, ' for the ') OR contains(line, ' idiot ')")
def _(spark, d):
    return _docs(spark, d).where(filters.blocked_column(F.col("text"), ["for the", "Idiot"])).select("doc_id")


@register("merge_sorted_unique", "SELECT r_name AS line FROM region UNION ALL SELECT n_name FROM nation")
def _(spark, d):
    return files.merge_sorted([spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("line")) for t, c in (("region", "r_name"), ("nation", "n_name"))])


@register("record_lines", f"WITH {_SQL_DICT}{_SQL_RELS}, dd AS (SELECT r.id, s, string_agg(relation_n3, chr(9) ORDER BY ord) AS rel FROM rels JOIN resources r ON r.text = rels.s GROUP BY 1, 2) SELECT id, coalesce(lag(id) OVER (ORDER BY id), -1) AS previous_id, s AS subject, rel AS relations FROM dd")
def _(spark, d):
    q = _graph(spark, d)
    docs = model.documents(model.relations(q), model.dictionary(q))
    lines = docs.select(files.record_line(F.col("id"), F.col("previous_id"), F.col("subject"), F.transform("relations", lambda r: r["n3"])).alias("value"))
    good, _ = files.parse_records(lines)
    return good.select("id", "previous_id", "subject", F.array_join("relations", "\t").alias("relations"))


@register("json_lines", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def _(spark, d):
    return files.as_json(spark.read.parquet(f"{d}/region.parquet"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for two terms, by BM25F."""
    return rank.top(_score(spark, sf_dir, ["thention", "edth"], ["object"]), 10)


def _all() -> dict:
    from . import registry_more  # noqa: F401  registers its queries

    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, (_, s) in _all().items():
        if s is not None:
            out[k] = "WITH RECURSIVE " + s[5:] if s.startswith("WITH ") and " clo AS (" in s and not s.startswith("WITH RECURSIVE") else s
    return out
