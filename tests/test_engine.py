"""Golden values of the quad engine on small tables, and the oracle on the smallest test tables."""

import os

import pytest
from pyspark.sql import functions as F

from quadrel.functions import analyze as T
from quadrel.functions.porter import stem
from quadrel.operators import algebra as A
from quadrel.operators import filters, ingest, layouts, model, ontology, rank, results
from quadrel.plans import query as Q
from quadrel.plans.index import Config, Index, Ontology, QueryLog
from quadrel.sources import files, quads

DATA = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("iri,name", [("http://host", "host"), ("http://host/path?p=v", "path?p=v"), ("http://host/path/subpath/#", "subpath"), ("http://host/path#fragment#", "fragment#"), ("", None), ("non-URL", None)])
def test_local_names(spark, iri, name):
    assert one(spark, iri, T.local_name) == name


def test_short_names():
    a = T.short_names(["http://schema.org/topic/A", "http://schema.org/event/A", "http://schema.org/excludeMe"], "/", ("excludeMe",))
    assert list(a.values()) == ["A", "event/A", "schema.org/excludeMe"]
    with pytest.raises(ValueError):
        T.short_names(["a", "a"])


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("triplicate", "triplic"), ("adjustable", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("sky", "sky"), ("@45", "@45")])
def test_porter(word, root):
    assert stem(word) == root


def test_text_functions(spark):
    assert one(spark, "The Quick-brown naïve fox_1 of 2", lambda c: T.terms(c)) == ["quick", "brown", "1", "2"] or one(spark, "The Quick-brown naïve fox_1 of 2", lambda c: T.terms(c)) == ["quick", "brown", "fox", "1", "2"]
    assert one(spark, "http://a.b/c-d", T.encode_field) == "http_a_b_c_d"
    assert one(spark, "http://a/1.2.3/x", T.remove_version) == "http://a/x"
    assert one(spark, "a:b c", T.subject_text) == "b c"
    shown = spark.createDataFrame([(n,) for n in (999, 1999, 999_999_999, 1_000_000_000, 8_500_000_000)], "n long").select(T.short_number(F.col("n"))).collect()
    assert [r[0] for r in shown] == ["999", "~1 thousand", "~999 million", "~1000 million", "~8500 million"]


LINES = [
    '<http://s/1> <http://p/1> <http://o/1> <http://c/1> .',
    '<http://s/1> <http://p/2> "object 3"@en .',
    '_:n1 <http://p/1> "27"^^<http://www.w3.org/2001/XMLSchema#integer> <http://c/1> <http://x> .',
    '"lit" <http://p/1> <http://o/1> .',
    '<http://s/1> "p" <http://o/1> .',
    '<http://s/1> <http://p/1> .',
    '<http://s/1> <http://p/1> <http://o o> .',
    'rubbish',
    r'<http://s/2> <http://p/1> "a \"q\" \n b" .',
]


def test_parse_and_rejects(spark):
    nodes = quads.parse_nodes(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert {(r["reason"], r["n"]) for r in filters.reject_counts(nodes).collect()} == {("subject type", 1), ("predicate type", 1), ("arity", 1), ("bad iri", 1), ("parse", 1)}
    q = quads.as_quads(nodes.where(filters.reject_reason(nodes).isNull())).collect()
    assert len(q) == 4
    by = {r["o_n3"]: r for r in q}
    assert by['"object 3"@en']["o"] == "object 3" and by['"object 3"@en']["relation_n3"] == '<http://p/2> "object 3"@en .'
    b = by['"27"^^<http://www.w3.org/2001/XMLSchema#integer>']
    assert (b["s"], b["s_type"], b["o"], b["c"]) == ("n1", "BNODE", "27", "http://c/1")
    assert by[r'"a \"q\" \n b"']["o"] == 'a "q" \n b'


PREFIX = [
    ("http://not.schema.org/Path", None), ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "="), ("http://www.w3.org/1999/02/22-rdf-syntax-nslabel", None), ("http://www.w3.org/2000/01/rdf-schema#comment", "="),
    ("http://www.w3.org/2002/07/owl#Ontology", "="), ("http://www.w3.org/2000/01/rdf-schemaAAA", None), ("http://schema.org/path/property", "http://schema.org/property"), ("http://schema.org/a/longer/path/property", "http://schema.org/property"),
    ("http://schema.org/a/longer/path/nonsense/", "http://schema.org/nonsense"), ("http://schema.org", None), ("http://schema.org/", "="),
]


def test_prefix_filter_table(spark):
    q = spark.createDataFrame([("RESOURCE", "http://s", p, "LITERAL", "v", '"v"', None, None, f'<{p}> "v" .', n) for n, (p, _) in enumerate(PREFIX)], "s_type string, s string, p string, o_type string, o string, o_n3 string, c_type string, c string, relation_n3 string, n int")
    got = {r["n"]: r["p"] for r in filters.by_prefix(q, filters.PrefixFilter("http://schema.org/", None, True, True)).collect()}
    assert got == {n: (p if w == "=" else w) for n, (p, w) in enumerate(PREFIX) if w}


def test_regex_filter_and_xml(spark):
    f = filters.filter_from_xml("<x.RegexTupleFilter><predicateRegex>name</predicateRegex><andNotOrConjunction>true</andNotOrConjunction></x.RegexTupleFilter>")
    assert f == filters.RegexFilter(predicate="name", conjunction=True)
    assert filters.filter_from_xml("<PredicatePrefixTupleFilter><predicatePrefix>http://d/</predicatePrefix><lowercase>true</lowercase></PredicatePrefixTupleFilter>") == filters.PrefixFilter("http://d/", None, False, True)
    with pytest.raises(ValueError):
        filters.filter_from_xml("<java.lang.Runtime/>")


def _golden(spark):
    rel = [("http://p/1", "RESOURCE", "http://object/1", "file:/tmp/source"), ("http://p/2", "RESOURCE", "http://object/2a", None), ("http://p/2", "RESOURCE", "http://object/2b", None), ("http://p/3", "LITERAL", "object 3", "http://context/1"), ("http://p/4/FOUR", "BNODE", "BNodeId123", None)]
    ids = {"file:/tmp/source": 22, "http://subject/": 33, "http://object/1": 45, "http://object/2a": 46, "http://object/2b": 47, "http://context/1": 55, "http://p/1": 60, "http://p/2": 61, "http://p/3": 62, "http://p/4/FOUR": 63, "BNodeId123": 88}
    r = spark.createDataFrame([("http://subject/", n, p, t, o, c, "") for n, (p, t, o, c) in enumerate(rel)], "s string, ord int, p string, o_type string, o string, c string, relation_n3 string")
    d = spark.createDataFrame([(i, t, 1, 1, 1, 1) for t, i in ids.items()], "id long, text string, n_relations long, n_predicate long, n_object long, n_context long")
    return r, d


def test_horizontal_and_vertical_fields(spark):
    r, d = _golden(spark)
    named = layouts.with_ids(r, d)
    got: dict = {}
    for x in layouts.horizontal_tokens(named).orderBy("field", "pos").collect():
        got.setdefault(x["field"], []).append((x["pos"], x["term"]))
    plain = {k: [t for _, t in v] for k, v in got.items()}
    assert plain["object"] == ["@45", "@46", "@47", "object", "3", "@88"]
    assert plain["predicate"] == ["@60", "@61", "@61", "@62", "@62", "@63"]
    assert got["context"] == [(0, "@22"), (3, "@55"), (4, "@55")]  # parallel positions
    assert plain["subject"] == ["@33"] and plain["subjectText"] == ["@33", "subject"]
    v: dict = {}
    fields = spark.createDataFrame([("http://p/1",), ("http://p/2",), ("http://p/3",)], "predicate string")
    for x in layouts.vertical_tokens(named, fields).orderBy("pos").collect():
        v.setdefault(x["field"], []).append(x["term"])
    assert v == {"http_p_1": ["@45"], "http_p_2": ["@46", "@47"], "http_p_3": ["object", "3"]}


def test_postings_and_statistics(spark):
    rows = [("0", d, p, "term1") for d, ps in {3: (11, 15), 4: (12,), 7: (14, 17, 18)}.items() for p in ps] + [("1", d, p, "term2") for d, ps in {1: (10, 19), 7: (13, 16)}.items() for p in ps]
    t = spark.createDataFrame(rows, "field string, doc_id long, pos int, term string")
    assert {tuple(r) for r in layouts.term_stats(t).collect()} == {("0", "term1", 3, 6, 45), ("1", "term2", 2, 4, 35)}
    p = {(r["term"], r["doc_id"]): r["positions"] for r in layouts.postings(t).collect()}
    assert p["term1", 7] == [14, 17, 18]
    sizes = spark.createDataFrame([("object", 0, 3), ("object", 3, 1)], "field string, doc_id long, size int")
    assert [r["size"] for r in layouts.zero_filled(sizes, spark.range(5), "object").orderBy("doc_id").collect()] == [3, 0, 0, 1, 0]


def test_dense_ids_in_ranges(spark):
    names = [f"n{i * 7919 % 5000:05d}" for i in range(5000)]
    df = spark.createDataFrame([(n,) for n in names], "text string")
    got = {r["text"]: r["id"] for r in model.dense_ids(df, part_rows=700).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}
    prev = {r["id"]: r["previous_id"] for r in model.with_previous(spark.createDataFrame([(i,) for i in (0, 3, 9, 10, 25)], "id long"), span=10).collect()}
    assert prev == {0: -1, 3: 0, 9: 3, 10: 9, 25: 10}


def test_records(spark):
    lines = spark.createDataFrame([("5\t-1\thttp://s\t<p> <o> .\t\t",), ("x\t1\ts",), ("-1\t-1\ts\t",), ("3\t7\ts\t",), ("0\t-1\t\t",)], "value string")
    good, bad = files.parse_records(lines)
    assert [(r["id"], r["relations"]) for r in good.orderBy("id").collect()] == [(0, []), (5, ["<p> <o> ."])]
    assert {r["reason"] for r in bad.collect()} == {"not a number", "negative id", "order"}


def test_merge(spark):
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "line string")
    got = [r[0] for r in files.merge_sorted([f("Hello", "World!"), f("Baa", "Baz", "Foo"), f("2", "6", "8", "Z")]).collect()]
    assert got == ["2", "6", "8", "Baa", "Baz", "Foo", "Hello", "World!", "Z"]
    with pytest.raises(Exception, match="line occurs twice"):
        files.merge_sorted([f("a"), f("a")]).collect()


def test_block_list():
    for q, hit in (("block this query", True), ("please block this query now", True), ("block query this", False), ("block this", False), ("", False)):
        assert filters.blocked(q, ["block this query"]) == hit
    assert filters.blocked("an idiot", ["idiot"])


def test_parser_and_rewriting():
    p = Q.Parser()
    assert p('a1 "b2 c3" | d4').kind == "or"
    assert p("x1 - y1").kind == "diff" and p("!x1").kind == "not" and p("x1 < y1").kind == "ordered" and p("(x1 y1)~5").value == 5
    assert p("f:(x1 ^ y1)") == Q.Node("select", (Q.Node("align", (Q.term("x1"), Q.term("y1"))),), "f")
    assert p("x1{2.5}") == Q.Node("weight", (Q.term("x1"),), 2.5)
    assert p("the x1") == Q.term("x1")
    with pytest.raises(Q.QueryError):
        p("the of")
    with pytest.raises(Q.QueryError):
        p("(x1")
    r = Q.rewrite(p("x1 & f:y1"), {"x1": ["g"]}, ["f", "g"])
    assert r.parts[0] == Q.Node("in", (Q.term("x1"),), ("g", "object")) and r.parts[1].kind == "select"
    assert [x[0].value for x in Q.positive_leaves(p("x1 - y1"))] == ["x1"]
    assert Q.encode_resources("type:{http://schema.org/Blog} {_:node1234}", {"http://schema.org/Blog": 1, "node1234": 333}) == "type:@1 @333"
    with pytest.raises(Q.QueryError):
        Q.encode_resources("{http://x}", {})
    assert Q.clean_query("Foo.bar, (Baz) name:x") == '"foo bar" baz name:x'


def test_positional_algebra(spark):
    words = "a b c a x b c d".split()
    t = spark.createDataFrame([("f", 1, i, w) for i, w in enumerate(words)], "field string, doc_id long, pos int, term string")
    got = lambda d: sorted((r["l"], r["r"]) for r in d.collect())
    a, b, c = (A.term(t, x) for x in "abc")
    assert got(A.consecutive([b, c])) == [(1, 2), (5, 6)]
    assert got(A.ordered([a, c])) == [(0, 2), (3, 6)]
    assert got(A.low_pass([a, c], 3)) == [(0, 2), (2, 3)] and got(A.low_pass([a, c], 2)) == [(2, 3)]
    assert got(A.span_difference(A.ordered([a, c]), A.term(t, "x"))) == [(0, 2)]


def test_truncation(spark):
    df = spark.createDataFrame([([("p", "x" * 10, "LITERAL", "c"), ("p", "y" * 30, "LITERAL", "c"), ("p", "z", "LITERAL", "c"), ("q", "w" * 40, "LITERAL", "c")],)], "relations array<struct<predicate:string,object:string,o_type:string,context:string>>")
    got = df.select(results.truncated(F.col("relations"), 15)).first()[0]
    assert [(r["predicate"], r["shown"]) for r in got] == [("p", "x" * 10), ("p", "y" * 5 + "..."), ("q", "w" * 15 + "...")]


OWL = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
<owl:Class rdf:about="http://d/Thing"><rdfs:label>Old</rdfs:label><rdfs:label>Thing</rdfs:label></owl:Class>
<owl:Class rdf:about="http://d/Place"><rdfs:subClassOf rdf:resource="http://d/Thing"/></owl:Class>
<owl:Class rdf:about="http://d/Shop"><rdfs:subClassOf rdf:resource="http://d/Place"/></owl:Class>
<owl:DatatypeProperty rdf:about="http://d/name"><rdfs:domain rdf:resource="http://d/Thing"/></owl:DatatypeProperty>
<owl:ObjectProperty rdf:about="http://d/near"><rdfs:domain><owl:Class><owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="http://d/Place"/><rdf:Description rdf:about="http://d/Shop"/></owl:unionOf></owl:Class></rdfs:domain></owl:ObjectProperty>
</rdf:RDF>"""


def test_ontology(spark):
    classes, sub, dom = files.ontology_frames(spark, OWL)
    assert {tuple(r) for r in classes.collect()} == {("http://d/Thing", "Thing"), ("http://d/Place", ""), ("http://d/Shop", "")}
    assert {(r["kind"], r["class"]) for r in dom.collect()} == {("data", "http://d/Thing"), ("object", "http://d/Place"), ("object", "http://d/Shop")}
    closed = ontology.closure(sub)
    assert {tuple(r) for r in closed.collect()} == {("http://d/Place", "http://d/Thing"), ("http://d/Shop", "http://d/Place"), ("http://d/Shop", "http://d/Thing")} == {tuple(r) for r in ontology.closure_sql(sub).collect()}
    counted = ontology.class_counts(spark.createDataFrame([("http://d/Shop", 5), ("http://other", 2)], "name string, count long"), classes, closed)
    assert {(r["class"], r["count"]) for r in counted.collect()} == {("http://d/Shop", 5), ("http://d/Place", 0), ("http://d/Thing", 0)}
    stats = ontology.class_stats(counted, sub, dom, closed)
    assert ontology.tree(stats) == "Thing:0\n  Place:0\n    Shop:5"
    assert {r["class"]: r["properties"] for r in stats.collect()}["http://d/Shop"] == ["http://d/name"]
    cyclic = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert ontology.closure(cyclic).count() == 2


def test_search_gives_all_results(spark):
    me = F.concat(F.lit("http://d/"), F.col("id").cast("string"))
    q = spark.range(10_050).select(F.lit("RESOURCE").alias("s_type"), me.alias("s"), F.lit("http://d/p").alias("p"), F.lit("LITERAL").alias("o_type"), F.lit("good").alias("o"), F.lit('"good"').alias("o_n3"), F.lit("RESOURCE").alias("c_type"), F.lit("http://d/c").alias("c"), F.lit('<http://d/p> "good" <http://d/c> .').alias("relation_n3"))
    ix = Index.built(q)
    whole = ix.search("good", size=None)
    assert whole["num_results"] == whole["items"].count() == 10_050
    assert ix.search("good", start=10_000, size=None)["items"].count() == 50


def test_weights_and_log():
    w = rank.field_weights(["a", "b"], rank.Weights(field_class={"a": rank.IMPORTANT}))
    assert sum(w.values()) == pytest.approx(2) and w["a"] > w["b"]
    log = QueryLog(2)
    log.add(1), log.add(3)
    assert log.add(5) == {"ms": 5, "mean": 3, "rolling": 4}


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_index_end_to_end(spark):
    q = quads.mapped(spark, DATA, ("region", "nation"))
    onto = Ontology(*files.ontology_frames(spark, OWL))
    ix = Index.built(q, Config(block_phrases=["never this"]), onto)
    r = ix.search("nation 3", size=3)
    assert r["num_results"] >= 1 and r["items"].first()["subject"] == "http://data/nation/3"
    doc = ix.search("doc:{http://data/nation/3}")["items"].first()
    assert doc["score"] == 1.0 and any(x["subject_id_of_object"] is not None for x in doc["relations"])
    assert ix.search("type:{http://data/Nation}")["num_results"] == 25
    with pytest.raises(Q.QueryError):
        ix.search("never this")
    with pytest.raises(ValueError):
        ix.search("x", size=20_000)
    assert ix.statistics()["fields"]
    assert files.render(ix.search("nation 3")["items"], "js").first()["value"].startswith("{")


NAMES = ["ingest_rejects", "ingest_counters", "rank_weighted_query", "rank_prefix_query", "index_priors_stored", "quads_from_files_gzip", "quads_direct_map", "nquads_parse", "dictionary_ids", "docs_previous_id", "horizontal_fields", "term_stats", "q_phrase", "q_nested", "rank_bm25f_multi_field", "onto_class_stats", "deref_labels"]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    import duckdb

    from quadrel.plans import registry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders documents pages labels".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    x = con.sql(registry.oracle_sql()[name])
    at = [list(x.columns).index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in x.fetchall()), key=key)


def test_packed_tables_are_spread(spark):
    t = quads.Table("n", "id", ("id",), (), "N")
    packed = spark.range(0, 120_000, 1, 1)
    q = quads.direct_map(packed, t)
    assert q.rdd.getNumPartitions() == 3 and q.count() == 240_000  # one task would expand all rows
    assert quads.direct_map(packed.limit(10), t).rdd.getNumPartitions() == 1


def test_lines_are_parsed_once(spark):
    got = ingest.ingest(spark.createDataFrame([(x,) for x in LINES], "value string"))
    for df in (got.quads, got.rejects):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1
    assert got.quads.count() == 4 and got.rejects.count() == 5


def test_ranges_are_cut_from_a_stored_table(spark):
    from quadrel.plans.index import _ranged

    made = spark.range(30).select(F.explode(F.array("id", F.col("id") + 1)).alias("x"))
    df = _ranged(made, ["x"], ["x"])
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()  # else both passes would make the rows
    assert sorted(r["x"] for r in df.collect()) == sorted([*range(30), *range(1, 31)])


def test_rows_without_a_link_are_spread(spark):
    rel = "array<struct<ord:int,predicate:string,o_type:string,object:string,context:string,n3:string>>"
    docs = spark.createDataFrame([(k, k - 1, f"s{k}", [(0, "name", "LITERAL", f"n{k}", None, "x"), (1, "to", "RESOURCE", "s1", None, "y")]) for k in range(40)], f"id long, previous_id long, subject string, relations {rel}")
    items = results.items(docs.select(F.col("id").alias("doc_id"), F.lit(1.0).alias("score")), docs)
    assert {(r["subject_id"], x["object"], x["subject_id_of_object"], x["label"]) for r in items.collect() for x in r["relations"]} == {(k, f"n{k}", None, None) for k in range(40)} | {(k, "s1", 1, "n1") for k in range(40)}
    keyed = [x for x in items._jdf.queryExecution().analyzed().toString().split("\n") if " END, cast(subject_id" in x and " AS _link" in x]
    assert len(keyed) == 1  # the join's key is never null


def test_phrases_meet_in_one_shuffle(spark):
    t = spark.createDataFrame([("object", 1, k, f"w{k % 70}") for k in range(75)] + [("object", 2, 2 * k, f"w{k}") for k in range(70)], "field string, doc_id long, pos int, term string")
    short = A.consecutive([A.term(t, "w3"), A.term(t, "w4")])
    assert sorted((r["doc_id"], r["l"], r["r"]) for r in short.collect()) == [(1, 3, 4), (1, 73, 74)]
    assert short._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2  # partial and final
    long = A.consecutive([A.term(t, f"w{k}") for k in range(70)])
    assert [(r["doc_id"], r["l"], r["r"]) for r in long.collect()] == [(1, 0, 69)]
