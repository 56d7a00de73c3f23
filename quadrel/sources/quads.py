"""Quads: N-Quads text and direct mappings of relational tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "http://data/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
COLUMNS = ("s_type", "s", "p", "o_type", "o", "o_n3", "c_type", "c", "relation_n3")
NODE = r"(?:<[^>]*>|_:[^\s]+|\"(?:[^\"\\]|\\.)*+\"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)"


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """(value): trimmed lines that aren't blank; compressed files by their extension, directories of part files as one."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where(F.length("value") > 0)


def _kind(n3: Column) -> Column:
    return F.when(n3.startswith("<"), "RESOURCE").when(n3.startswith("_:"), "BNODE").when(n3.startswith('"'), "LITERAL")


def _unescape(s: Column) -> Column:
    for a, b in (("\\\\", "\0"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\0", "\\")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _text(n3: Column) -> Column:
    """The node without its marks: an IRI, a bnode's label, a literal's body."""
    return F.when(n3.startswith("<"), F.regexp_extract(n3, "^<(.*)>$", 1)).when(n3.startswith("_:"), F.substring(n3, 3, 1 << 30)).otherwise(_unescape(F.regexp_extract(n3, r'^"((?:[^"\\]|\\.)*+)"', 1)))


def parse_nodes(lines: DataFrame) -> DataFrame:
    """lines with `nodes`: the N3 nodes of each; a line that isn't nodes and a final dot is tried again without data types, then
    has none."""
    whole = rf"^{NODE}(?:\s+{NODE})*\s*\.$"
    bare = F.regexp_replace("value", r"\^\^<[^>]+>", "")
    value = F.when(F.col("value").rlike(whole), F.col("value")).when(bare.rlike(whole), bare)
    return lines.withColumn("nodes", F.regexp_extract_all(value, F.lit(NODE), F.lit(0)))


def as_quads(nodes: DataFrame, contexts: bool = True) -> DataFrame:
    """The quad columns from `nodes` of 3 to 5; a context that isn't a resource, or isn't wanted, is dropped; the fifth node is ignored."""
    s, p, o, c = (F.get("nodes", i) for i in range(4))
    c = F.when((_kind(c) == "RESOURCE") & F.lit(contexts), c)
    return nodes.select(
        *[x for x in nodes.columns if x not in ("nodes",)],
        _kind(s).alias("s_type"), _text(s).alias("s"), _text(p).alias("p"), _kind(p).alias("p_type"),
        _kind(o).alias("o_type"), _text(o).alias("o"), o.alias("o_n3"),
        _kind(c).alias("c_type"), _text(c).alias("c"), F.concat_ws(" ", p, o, c, F.lit(".")).alias("relation_n3"),
    )


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    literals: tuple[str, ...]
    links: tuple[tuple[str, str], ...] = ()
    kind: str = ""


#: Direct mappings of the test tables.
TABLES = (
    Table("region", "r_regionkey", ("r_name",), (), "Region"),
    Table("nation", "n_nationkey", ("n_name",), (("n_regionkey", "region"),), "Nation"),
    Table("supplier", "s_suppkey", ("s_name",), (("s_nationkey", "nation"),), "Supplier"),
    Table("customer", "c_custkey", ("c_name", "c_mktsegment"), (("c_nationkey", "nation"),), "Customer"),
    Table("part", "p_partkey", ("p_name", "p_brand", "p_type"), (), "Part"),
    Table("documents", "doc_id", ("text", "lang", "source"), (), "Document"),
)


def n3_literal(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def spread(df: DataFrame, key: str, part_rows: int = 50_000) -> DataFrame:
    """df in parts of about part_rows rows if it comes in fewer: a column store packs a million short rows into a few megabytes, which one task
    would read and expand.  Rows of a stored table are counted from its footers."""
    n = -(-df.count() // part_rows)
    return df.repartition(n, key) if n > max(1, df.rdd.getNumPartitions()) else df


def direct_map(df: DataFrame, t: Table) -> DataFrame:
    """One quad for each literal, each link and the type of every row; null values have none."""
    me = F.concat(F.lit(f"{BASE}{t.name}/"), F.col(t.key).cast("string"))
    c = f"{BASE}{t.name}"
    made = [F.struct(F.lit(f"{BASE}{t.name}#{x}").alias("p"), F.lit("LITERAL").alias("o_type"), F.col(x).cast("string").alias("o")) for x in t.literals]
    made += [F.struct(F.lit(f"{BASE}{t.name}#{x}").alias("p"), F.lit("RESOURCE").alias("o_type"), F.concat(F.lit(f"{BASE}{to}/"), F.col(x).cast("string")).alias("o")) for x, to in t.links]
    made.append(F.struct(F.lit(RDF_TYPE).alias("p"), F.lit("RESOURCE").alias("o_type"), F.lit(BASE + t.kind).alias("o")))
    df = spread(df.select(*dict.fromkeys([t.key, *t.literals, *[x for x, _ in t.links]])), t.key)
    q = df.where(F.col(t.key).isNotNull()).select(me.alias("s"), F.explode(F.array(*made)).alias("x")).select("s", "x.*").where(F.col("o").isNotNull())
    n3 = F.when(F.col("o_type") == "LITERAL", n3_literal(F.col("o"))).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    return q.withColumn("o_n3", n3).select(
        F.lit("RESOURCE").alias("s_type"), "s", "p", "o_type", "o", "o_n3", F.lit("RESOURCE").alias("c_type"), F.lit(c).alias("c"),
        F.concat(F.lit("<"), "p", F.lit("> "), "o_n3", F.lit(f" <{c}> .")).alias("relation_n3"),
    )


def mapped(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(t.name for t in TABLES)) -> DataFrame:
    out = None
    for t in TABLES:
        if t.name in names:
            q = direct_map(spark.read.parquet(f"{sf_dir}/{t.name}.parquet"), t)
            out = q if out is None else out.unionByName(q)
    return out
