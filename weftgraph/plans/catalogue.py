"""Named queries over the driver's tables and the SQL they are held against.

``KG`` views build a graph from the relational tables: nodes for every region,
nation, customer, supplier and part; edges nation-region, customer-nation,
supplier-nation and supplier-part. Queries without SQL grow communities, split
text recursively or ask the stub model; their tests check invariants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import confidence as cf
from weftgraph.functions import split as sp
from weftgraph.functions import text as tx
from weftgraph.functions import tokens as tk
from weftgraph.models.base import StubModel
from weftgraph.operators import baselines, evaluate, generate, graph, kg, partition, paths, platform, sample, search, tree
from weftgraph.sources import storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- graphs from the tables


def kg_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, d, n)
    node = lambda n, p, k, kind, text: t(n).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("entity_type"), F.col(text).alias("description"))
    nodes = node("region", "R", "r_regionkey", "REGION", "r_name").unionByName(node("nation", "N", "n_nationkey", "NATION", "n_name")).unionByName(node("supplier", "S", "s_suppkey", "SUPPLIER", "s_name"))
    nodes = nodes.unionByName(node("customer", "C", "c_custkey", "CUSTOMER", "c_name")).unionByName(node("part", "P", "p_partkey", "PART", "p_name"))
    edge = lambda df, a, x, b, y, kind, conf: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("relation_type"), conf.alias("confidence"))
    one = F.lit(1.0)
    edges = edge(t("nation"), "N", "n_nationkey", "R", "n_regionkey", "in_region", one).unionByName(edge(t("supplier"), "S", "s_suppkey", "N", "s_nationkey", "in_nation", one))
    edges = edges.unionByName(edge(t("customer"), "C", "c_custkey", "N", "c_nationkey", "in_nation", one))
    sold = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.avg("l_discount") * 10, 6).alias("confidence"))
    return nodes, graph.canonical(edges.unionByName(edge(sold, "S", "l_suppkey", "P", "l_partkey", "supplies", F.col("confidence"))))


KG = """
nodes AS (
  SELECT 'R' || r_regionkey AS id, 'REGION' AS entity_type, r_name AS description FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'NATION', n_name FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'SUPPLIER', s_name FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'CUSTOMER', c_name FROM customer
  UNION ALL SELECT 'P' || p_partkey, 'PART', p_name FROM part
), raw AS MATERIALIZED (
  SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b, 'in_region' AS relation_type, 1.0::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'in_nation', 1.0::DOUBLE FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'in_nation', 1.0::DOUBLE FROM customer
  UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey, 'supplies', round(avg(l_discount) * 10, 6) FROM lineitem GROUP BY l_suppkey, l_partkey
), edges AS MATERIALIZED (SELECT least(a, b) AS src, greatest(a, b) AS dst, relation_type, confidence FROM raw),
sym AS MATERIALIZED (SELECT src AS id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges),
deg AS MATERIALIZED (SELECT id, count(other) AS degree FROM nodes LEFT JOIN sym USING (id) GROUP BY id)
"""


@query(f"WITH {KG} SELECT id, entity_type, description FROM nodes")
def kg_nodes(spark, d):
    return kg_tables(spark, d)[0]


@query(f"WITH {KG} SELECT src, dst, relation_type, confidence FROM edges")
def kg_edges(spark, d):
    return kg_tables(spark, d)[1]


@query(f"WITH {KG} SELECT id, degree FROM deg")
def graph_degrees(spark, d):
    return graph.degrees(*kg_tables(spark, d))


@query(f"WITH {KG} SELECT src, dst, CAST(a.degree + b.degree AS BIGINT) AS degree FROM edges JOIN deg a ON src = a.id JOIN deg b ON dst = b.id")
def edge_degrees(spark, d):
    return graph.edge_degrees(*kg_tables(spark, d))


@query(f"WITH {KG} SELECT id, entity_type FROM nodes WHERE id NOT IN (SELECT id FROM sym)")
def isolated_nodes(spark, d):
    return graph.isolated(*kg_tables(spark, d)).select("id", "entity_type")


@query(f"WITH {KG} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")
def graph_counts(spark, d):
    return graph.counts(*kg_tables(spark, d))


#: Nodes within two hops of the ``seeds`` (seed), as a table ``near``.
TWO_HOPS = """
one AS MATERIALIZED (SELECT DISTINCT seed, other AS id FROM seeds JOIN sym ON seed = sym.id),
two AS (SELECT DISTINCT one.seed, sym.other AS id FROM one JOIN sym ON one.id = sym.id),
near AS (SELECT seed, seed AS id, 0 AS distance FROM seeds UNION ALL SELECT seed, id, 1 FROM one UNION ALL SELECT seed, id, 2 FROM two ANTI JOIN one USING (seed, id) WHERE seed <> id)
"""


@query(f"WITH {KG}, seeds AS (SELECT id AS seed FROM nodes WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0), {TWO_HOPS} SELECT seed, id, distance FROM near")
def neighbors_2hop(spark, d):
    """A search: the nodes whose number is divisible by 50 against the whole graph."""
    nodes, edges = kg_tables(spark, d)
    return graph.k_hop(edges, nodes.filter("cast(substring(id, 2) AS bigint) % 50 = 0").select(F.col("id").alias("seed")), 2)


#: Smallest label of the neighbours, twelve times over; no two nodes of this schema's graph are further apart.
COMP = """
loops AS (SELECT id, other FROM sym UNION SELECT id, id FROM nodes),
lab AS (SELECT 0 AS i, id, id AS label FROM nodes UNION ALL SELECT i + 1, loops.id, min(label) FROM lab JOIN loops ON loops.other = lab.id WHERE i < 12 GROUP BY i + 1, loops.id),
comp AS (SELECT id, label AS component FROM lab WHERE i = 12)
"""


@query(f"WITH RECURSIVE {KG}, {COMP} SELECT id, component FROM comp")
def connected_components(spark, d):
    return graph.components(*kg_tables(spark, d))


@query(f"WITH RECURSIVE {KG}, {COMP}, top AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT id FROM comp WHERE component IN (SELECT component FROM top)")
def largest_component(spark, d):
    return graph.largest_component(*kg_tables(spark, d))[0].select("id")


@query(f"WITH RECURSIVE {KG}, {COMP}, r AS (SELECT component AS community, id, row_number() OVER (PARTITION BY component ORDER BY id) - 1 AS k FROM comp) SELECT community, id, CAST(k // 3 AS BIGINT) AS part FROM r")
def split_communities(spark, d):
    return graph.split_large(graph.components(*kg_tables(spark, d)).withColumnRenamed("component", "community"), 3)


@query(f"""WITH RECURSIVE {KG}, {COMP}, freq AS (SELECT degree, count(*) AS freq FROM deg WHERE degree > 0 GROUP BY degree), fit AS (SELECT sum(freq) AS n, count(*) AS k, regr_r2(ln(freq), ln(degree)) AS r2 FROM freq),
m AS (SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, round((SELECT count(*) FROM deg WHERE degree = 0) / (SELECT count(*) FROM nodes), 6) AS noise_ratio,
 round((SELECT max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY component)) / (SELECT count(*) FROM nodes), 6) AS largest_cc_ratio,
 round((SELECT avg(degree) FROM deg), 6) AS avg_degree, round((SELECT CASE WHEN n >= 10 AND k >= 3 THEN r2 END FROM fit), 6) AS powerlaw_r2)
SELECT *, coalesce(noise_ratio < 0.15 AND largest_cc_ratio > 0.90 AND avg_degree BETWEEN 2 AND 5 AND powerlaw_r2 > 0.75, false) AS is_robust FROM m""")
def structure_eval(spark, d):
    s = graph.structure(*kg_tables(spark, d))
    return s.select("total_nodes", "total_edges", *[F.round(c, 6).alias(c) for c in ("noise_ratio", "largest_cc_ratio", "avg_degree", "powerlaw_r2")], "is_robust")


@query(f"WITH {KG}, e AS (SELECT src AS x, dst AS y FROM edges WHERE relation_type <> 'supplies' UNION SELECT dst, src FROM edges WHERE relation_type <> 'supplies') SELECT e1.x AS a, e1.y AS b, e2.y AS c, e3.y AS d FROM e e1 JOIN e e2 ON e1.y = e2.x JOIN e e3 ON e2.y = e3.x WHERE e2.y <> e1.x AND e3.y <> e1.x AND e3.y <> e1.y")
def simple_paths_3(spark, d):
    """Over the relations of place; with sales the paths would be hubs cubed."""
    return baselines.simple_paths(kg_tables(spark, d)[1].filter("relation_type != 'supplies'"))


#: Distinct neighbours of every node without loops, with their places in its sorted list.
NEIGHBOURS = """
near AS MATERIALIZED (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) - 1 AS at, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, other FROM sym WHERE id <> other))
"""


@query(
    f"""WITH {KG}, {NEIGHBOURS},
    wedge AS (SELECT x.id AS a, y.other AS c FROM near x JOIN near y ON x.other = y.id WHERE y.other <> x.id),
    found AS (SELECT a, sum(d.degree - 1 - CASE WHEN near.id IS NULL THEN 0 ELSE 1 END) AS n FROM wedge JOIN deg d ON d.id = c LEFT JOIN near ON near.id = a AND near.other = c GROUP BY a)
    SELECT nodes.id, CAST(coalesce(n, 0) AS BIGINT) AS n_paths FROM nodes LEFT JOIN found ON nodes.id = a"""
)
def path_counts(spark, d):
    """Paths of four nodes from every node, sales included; they are counted, not listed."""
    return paths.path_counts(*kg_tables(spark, d))


@query(
    f"""WITH {KG}, {NEIGHBOURS},
    middle AS MATERIALIZED (SELECT x.id AS b, x.other AS c, x.at AS c_at, y.at AS b_at, x.n - 1 AS n_b, y.n - 1 AS n_c FROM near x JOIN near y ON x.id = y.other AND x.other = y.id WHERE x.id < x.other AND x.n > 1 AND y.n > 1),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY b, c) AS k, CAST(sum(n_b * n_c) OVER (ORDER BY b, c ROWS UNBOUNDED PRECEDING) - n_b * n_c AS HUGEINT) AS before FROM middle),
    size AS MATERIALIZED (SELECT (SELECT CAST(sum(n_b * n_c) AS HUGEINT) FROM middle) AS walks, (SELECT count(*) FROM edges) AS n),
    draws AS MATERIALIZED (SELECT i AS draw, (CAST(i AS HUGEINT) * walks + CAST('0x' || substr(md5('0:' || i), 1, 15) AS BIGINT) % walks) // n AS p FROM size, range((SELECT n FROM size)) t(i)),
    mixed AS (SELECT p, 1 AS kind, draw, NULL AS k FROM draws UNION ALL SELECT before, 0, NULL, k FROM placed),
    met AS MATERIALIZED (SELECT draw, p, max(k) OVER (ORDER BY p, kind ROWS UNBOUNDED PRECEDING) AS k FROM mixed),
    hit AS MATERIALIZED (SELECT draw, b, c, CAST((p - before) // n_c AS BIGINT) AS x, CAST((p - before) % n_c AS BIGINT) AS y, c_at, b_at FROM met JOIN placed USING (k) WHERE draw IS NOT NULL),
    one AS MATERIALIZED (SELECT draw, near.other AS a, b, c, y + CASE WHEN y >= b_at THEN 1 ELSE 0 END AS d_at FROM hit JOIN near ON near.id = b AND near.at = x + CASE WHEN x >= c_at THEN 1 ELSE 0 END),
    two AS MATERIALIZED (SELECT draw, a, b, c, near.other AS d FROM one JOIN near ON near.id = c AND near.at = d_at)
    SELECT CAST(draw AS BIGINT) AS draw, a, b, c, d FROM two WHERE a <> d"""
)
def path_sample(spark, d):
    """As many draws as the whole graph has edges, from all its paths of four nodes."""
    edges = kg_tables(spark, d)[1]
    return paths.sample_paths(edges, edges.count())


@query("SELECT 'N' || n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN 'changed' ELSE n_name END AS description FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 'N99', 'changed'")
def graph_upsert_delete(spark, d):
    nodes = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("description"))
    new = nodes.filter("cast(substring(id, 2) as int) < 5").select("id").unionByName(spark.createDataFrame([("N99",)], "id string")).withColumn("description", F.lit("changed"))
    return graph.delete_nodes(graph.upsert_nodes(nodes, new), spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([("N7",)], "id string"))[0]


@query(f"WITH {KG} SELECT 'N' || n_nationkey AS community_id, string_agg(id, ',' ORDER BY id) AS members, CAST(count(*) AS INTEGER) AS n FROM nation JOIN nodes ON id IN ('N' || n_nationkey, 'R' || n_regionkey) GROUP BY n_nationkey")
def community_payloads(spark, d):
    nodes, edges = kg_tables(spark, d)
    pair = F.struct(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("dst"))
    c = table(spark, d, "nation").select(pair["dst"].alias("community_id"), F.array(pair["dst"], pair["src"], F.lit("X404")).alias("nodes"), F.array(pair).alias("edges"))
    out = graph.community_payloads(c, nodes, edges).filter("size(edges) = 1")
    return out.select("community_id", F.array_join(F.array_sort(F.transform("nodes", lambda n: n["id"])), ",").alias("members"), F.size("nodes").alias("n"))


# ---------------------------------------------------------------- sources and text


@query("SELECT doc_id, 'text' AS type, text AS content FROM documents WHERE trim(text) <> ''")
def scan_documents(spark, d):
    from weftgraph.sources.readers import validate

    return validate(table(spark, d, "documents").select("doc_id", F.lit("text").alias("type"), F.col("text").alias("content")))


@query("SELECT doc_id, lang FROM documents WHERE n_chars > 500 ORDER BY doc_id LIMIT 100")
def scan_filter_limit(spark, d):
    return table(spark, d, "documents").filter("n_chars > 500").select("doc_id", "lang").orderBy("doc_id").limit(100)


@query("SELECT 'document' AS source, text AS content FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversation', text FROM conversations")
def union_sources(spark, d):
    part = lambda n, s: table(spark, d, n).select(F.lit(s).alias("source"), F.col("text").alias("content"))
    return part("documents", "document").unionByName(part("benchmark", "benchmark")).unionByName(part("conversations", "conversation"))


@query("SELECT doc_id, 'doc-' || md5(text) AS trace FROM documents")
def trace_id_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text"), "doc-").alias("trace"))


@query("SELECT md5(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def dedupe_by_content_hash(spark, d):
    return baselines.dedupe_by_hash(table(spark, d, "documents"))


@query("""WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS han, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM documents)
SELECT doc_id, CASE WHEN han > 0 AND han * 2 >= han + latin THEN 'zh' ELSE 'en' END AS language, latin FROM c""")
def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.main_language(F.col("text")).alias("language"), F.regexp_count("text", F.lit("[A-Za-z]")).cast("bigint").alias("latin"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '^[\s\x{a0}\x1c-\x1f]+|[\s\x{a0}\x1c-\x1f]+$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\x00-\x1f\x{7f}-\x{9f}]', '', 'g'), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')".replace('\\"', '"')


@query(f"SELECT doc_id, md5({_CLEAN}) AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.clean(F.col("text")).cast("binary")).alias("cleaned"))


@query(r"WITH c AS (SELECT doc_id, " + _CLEAN + r" AS t FROM documents) SELECT doc_id, md5(trim(regexp_replace(t, '[\s\x{a0}]+', ' ', 'g'))) AS normalized FROM c")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.normalize_evidence(F.col("text")).cast("binary")).alias("normalized"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS ord, substr(text, CAST(i * 512 + 1 AS BIGINT), 512) AS content FROM documents, LATERAL unnest(range((length(text) + 511) // 512)) AS r(i)")
def chunk_fixed_512(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(sp.fixed_windows(F.col("text"))).alias("ord", "content"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \\n\\t]+') AS w FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS ord, array_to_string(w[i * 96 + 1 : i * 96 + 128], ' ') AS content, CAST(least(128, len(w) - i * 96) AS INTEGER) AS n FROM t, LATERAL unnest(range((len(w) + 95) // 96)) AS r(i)")
def chunk_token_window(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[^ \\n\\t]+"), F.lit(0)).alias("w"))
    return w.select("doc_id", F.explode(sp.token_windows(F.col("w"), 128, 32)).alias("c")).select("doc_id", "c.ord", F.array_join("c.tokens", " ").alias("content"), "c.n")


#: A public vocabulary with ranks; see ``tokens.Tokenizer``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def chunk_byte_pairs(spark, d):
    """Windows of 1024 byte-pair tokens over every document."""
    return tk.token_chunks(table(spark, d, "documents"), tk.Tokenizer.from_file(spark, VOCABULARY))


@query()
def byte_pair_round_trip(spark, d):
    """Tokens of every document and whether they give its text back."""
    tokenizer = tk.Tokenizer.from_file(spark, VOCABULARY)
    docs = table(spark, d, "documents").select("doc_id", "text", tokenizer.encode("text").alias("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_tokens"), (tokenizer.decode("ids") == F.coalesce("text", F.lit(""))).alias("restored"))


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_trace_id"), F.lit("text").alias("type"), F.col("text").alias("content"), "source")


@query()
def chunk_recursive(spark, d):
    return sp.chunk(_docs(spark, d))


@query("SELECT doc_id, CAST(length(text) > 240 AS BOOLEAN) AS cut, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substr(t, 1, 237), ' ') || '...' END AS short FROM (SELECT doc_id, text, regexp_replace(text, '^[\\s\\x{a0}\\x1c-\\x1f]+|[\\s\\x{a0}\\x1c-\\x1f]+$', '', 'g') AS t FROM documents)")
def compact_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.length("text") > 240).alias("cut"), tx.compact(F.col("text")).alias("short"))


@query("WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS entity FROM documents), p AS (SELECT a.doc_id, a.entity AS one, b.entity AS two FROM d a JOIN d b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.entity < b.entity), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(one || '|' || two), one, two) AS n FROM p) SELECT doc_id, one, two FROM r WHERE n <= 10")
def entity_pairs_topk(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("entity"))
    return baselines.entity_pairs(w)


# ---------------------------------------------------------------- extraction, merging, evidence


def _mentions(spark, d):
    """Suppliers as entities, part types as their observed types, priorities as descriptions."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), F.col("p_brand").alias("type"), F.col("p_type").alias("description"), F.lit("").alias("evidence"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ord"))


@query("WITH m AS (SELECT 'S' || l_suppkey AS name, p_brand AS type, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS first FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT name, type FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, first, type) = 1")
def merge_majority_type(spark, d):
    return kg.majority(_mentions(spark, d), ["name"], "type")


@query("SELECT 'S' || l_suppkey AS id, string_agg(DISTINCT p_type, '<SEP>' ORDER BY p_type) AS description FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def merge_descriptions(spark, d):
    return kg.merge_nodes(_mentions(spark, d)).select("id", "description")


def _merged_confidence(spark, d, suppliers):
    """Lineitems as relations of the given suppliers to parts, merged."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, d, "lineitem").select(key("S", "l_suppkey").alias("src"), key("P", "l_partkey").alias("dst"), F.lit("supplies").alias("relation"), F.lit("").alias("description"), F.lit("").alias("evidence"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ord"))
    nodes = suppliers.select(key("S", "s_suppkey").alias("id")).unionByName(table(spark, d, "part").select(key("P", "p_partkey").alias("id")))
    return kg.merge_edges(r, nodes).select("src", "dst", F.round("confidence", 6).alias("confidence"), "n_confidence")


@query("WITH e AS (SELECT least('S' || l_suppkey, 'P' || l_partkey) AS src, greatest('S' || l_suppkey, 'P' || l_partkey) AS dst, l_discount FROM lineitem) SELECT src, dst, round(avg(l_discount), 6) AS confidence, count(*) AS n_confidence FROM e GROUP BY src, dst")
def merge_confidence(spark, d):
    return _merged_confidence(spark, d, table(spark, d, "supplier"))


@query("""WITH m AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_returnflag AS label, CAST(l_orderkey AS VARCHAR) AS chunk, l_linenumber AS ord, l_discount FROM lineitem),
l AS (SELECT src, dst, label, count(*) AS n, min({'chunk': chunk, 'ord': ord}) AS first FROM m GROUP BY ALL),
t AS (SELECT src, dst, label FROM l QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, first, label) = 1)
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, label AS relation_type, round(avg(l_discount), 6) AS confidence, count(*) AS n_confidence, string_agg(DISTINCT chunk, '<SEP>' ORDER BY chunk) AS source_id
FROM m JOIN t USING (src, dst) GROUP BY ALL""".replace("label AS relation_type", "t.label AS relation_type"))
def merge_increments(spark, d):
    """Three increments by order, merged, against one run over all rows."""
    li, state = table(spark, d, "lineitem"), None
    named = lambda p, c, k: li.select(F.concat(F.lit(p), F.col(c).cast("string")).alias("name"), F.lit(k).alias("type"), F.lit("").alias("description"), F.lit("").alias("evidence"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ord"))
    entities = named("S", "l_suppkey", "SUPPLIER").unionByName(named("P", "l_partkey", "PART"))
    relations = li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("relation"), F.lit("").alias("description"), F.lit("").alias("evidence"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ord"))
    for part in range(3):
        of = F.pmod(F.col("chunk_id"), F.lit(3)) == part
        more = kg.GraphState.of(entities.filter(of), relations.filter(of))
        state = more if state is None else state.merge(more)
    return state.edges().select("src", "dst", "relation_type", F.round("confidence", 6).alias("confidence"), "n_confidence", "source_id")


@query("WITH e AS (SELECT DISTINCT l_orderkey AS chunk_id, 'S' || l_suppkey AS name FROM lineitem WHERE l_quantity > 25) SELECT DISTINCT l.l_orderkey AS chunk_id, 'S' || l.l_suppkey AS src, 'S' || m.l_suppkey AS dst FROM lineitem l JOIN lineitem m ON l.l_orderkey = m.l_orderkey AND m.l_linenumber = l.l_linenumber + 1 WHERE ('S' || l.l_suppkey) IN (SELECT name FROM e WHERE chunk_id = l.l_orderkey) AND ('S' || m.l_suppkey) IN (SELECT name FROM e WHERE chunk_id = l.l_orderkey)")
def strict_triplets(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), "l_linenumber", "l_quantity")
    nxt = li.select("chunk_id", F.col("name").alias("dst"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    relations = li.select("chunk_id", F.col("name").alias("src"), "l_linenumber").join(nxt, ["chunk_id", "l_linenumber"]).select("chunk_id", "src", "dst").distinct()
    return kg.strict_triplets(li.filter("l_quantity > 25").select("chunk_id", "name"), relations)[1].select("chunk_id", "src", "dst")


@query("SELECT item_id, doc_id FROM documents JOIN benchmark b ON contains(regexp_replace(documents.text, '\\s+', ' ', 'g'), regexp_replace(b.text, '\\s+', ' ', 'g'))")
def evidence_join(spark, d):
    plain = lambda c: F.regexp_replace(c, "[ \\t\\n\\r\\f]+", " ")
    spans = table(spark, d, "benchmark").select("item_id", plain("text").alias("span"))
    return kg.containing(table(spark, d, "documents").select("doc_id", plain("text").alias("t")), spans).select("item_id", "doc_id")


@query("WITH n AS (SELECT doc_id, text, substr(text, 1, 20) || CASE WHEN doc_id % 3 = 0 THEN 'never said' ELSE '' END AS span FROM documents WHERE length(text) > 40), ok AS (SELECT doc_id FROM n WHERE doc_id % 3 <> 0) SELECT 'D' || doc_id AS id FROM ok")
def filter_entities(spark, d):
    t = table(spark, d, "documents").filter("length(text) > 40")
    key = F.col("doc_id").cast("string")
    nodes = t.select(F.concat(F.lit("D"), key).alias("id"), key.alias("source_id"), F.concat(F.substring("text", 1, 20), F.when(F.col("doc_id") % 3 == 0, "never said").otherwise("")).alias("evidence_span"))
    return kg.filter_entities(nodes, spark.createDataFrame([], "src string, dst string"), t.select(key.alias("chunk_id"), F.col("text").alias("content")))[0].select("id")


def _replies(spark, d):
    """Extraction replies that tell each supplier and its nation, some of them with faults by the supplier's number."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    entity = F.concat(F.lit('("entity"<|>'), F.col("s_name"), F.lit("<|>supplier<|>sells parts<|>"), F.col("s_name"), F.lit(")"))
    # no quotes around the kind; too few fields; a blank name
    bad = F.when(F.col("s_suppkey") % 3 == 0, F.lit("##(entity<|>bad<|>t<|>d)")).when(F.col("s_suppkey") % 3 == 1, F.lit('##("entity"<|>short)')).otherwise(F.lit('##("entity"<|> <|>t<|>d)'))
    short = F.concat(F.lit('##("relationship"<|>'), F.col("s_name"), F.lit("<|>"), F.col("n_name"), F.lit("<|>in it<|>said)"))
    sure = F.when(F.col("s_suppkey") % 4 == 0, "0.9").when(F.col("s_suppkey") % 4 == 1, "7").otherwise("1.")
    typed = F.concat(F.lit('##("relationship"<|>'), F.col("s_name"), F.lit("<|>"), F.col("n_name"), F.lit("<|>located_in<|>is there<|>said<|>"), sure, F.lit(")"))
    return s.select(F.col("s_suppkey").alias("chunk_id"), F.concat(entity, bad, F.when(F.col("s_suppkey") % 4 == 3, short).otherwise(typed), F.lit("<|COMPLETE|>")).alias("reply"))


@query("SELECT s_suppkey AS chunk_id, upper(s_name) AS name, 'SUPPLIER' AS type, 'sells parts' AS description, s_name AS evidence FROM supplier")
def parse_entities(spark, d):
    return kg.entity_mentions(kg.records(_replies(spark, d))).drop("ord")


@query("SELECT s_suppkey AS chunk_id, upper(s_name) AS src, upper(n_name) AS dst, CASE WHEN s_suppkey % 4 = 3 THEN 'related_to' ELSE 'located_in' END AS relation, (CASE s_suppkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 ELSE 0.5 END)::DOUBLE AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def parse_relations(spark, d):
    return kg.relation_mentions(kg.records(_replies(spark, d))).select("chunk_id", "src", "dst", "relation", "confidence")


# ---------------------------------------------------------------- confidence and losses


def _tokens(spark, d):
    """Token lists of events: per user, the event type with a probability from its value."""
    return table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("text"), F.round(F.abs("value") / (1 + F.abs("value")), 6).alias("prob")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "text", "prob"))).alias("tokens"))


@query("WITH t AS (SELECT user_id, event_id, round(abs(value) / (1 + abs(value)), 6) AS p FROM events) SELECT user_id, round(avg(p), 6) AS average_prob, min(p) AS min_prob, round(exp(avg(ln(p))), 6) AS joint_probability FROM t WHERE p > 0 GROUP BY user_id")
def token_probabilities(spark, d):
    t, c = _tokens(spark, d), F.col("tokens")
    return t.select("user_id", F.round(cf.average_prob(c), 6).alias("average_prob"), cf.min_prob(c).alias("min_prob"), F.round(cf.joint_probability(c), 6).alias("joint_probability")).filter("min_prob IS NOT NULL")


@query("WITH t AS (SELECT user_id, round(abs(value) / (1 + abs(value)), 6) AS p, event_id % 2 = 0 AS hit FROM events) SELECT user_id, round(avg(CASE WHEN hit THEN 1 - p ELSE p END), 6) AS loss FROM t GROUP BY user_id")
def yes_no_loss(spark, d):
    t = _tokens(spark, d)
    said = F.transform("tokens", lambda x: F.struct(F.when(x["event_id"] % 2 == 0, "yes").otherwise("no").alias("text"), x["prob"].alias("prob")))
    return t.select("user_id", F.round(cf.yes_no_loss(said, F.transform("tokens", lambda x: F.lit("yes"))), 6).alias("loss"))


@query("WITH t AS (SELECT user_id, round(abs(value) / (1 + abs(value)), 6) AS p FROM events) SELECT user_id, round(CASE WHEN min(p) > 0 THEN avg(-ln(p)) ELSE -ln(0.1) END, 6) AS loss FROM t GROUP BY user_id")
def entropy_loss(spark, d):
    t = _tokens(spark, d)
    dist = F.transform("tokens", lambda x: F.array(F.struct(F.lit(" Yes").alias("text"), x["prob"].alias("prob")), F.struct(F.lit("maybe").alias("text"), (1 - x["prob"]).alias("prob"))))
    return t.select("user_id", F.round(cf.entropy_loss(dist, F.transform("tokens", lambda x: F.lit("yes"))), 6).alias("loss"))


@query(f"WITH {KG} SELECT id, round(CASE WHEN entity_type = 'REGION' THEN 0.25 ELSE -ln(0.1) END, 6) AS loss FROM nodes")
def default_losses(spark, d):
    nodes = kg_tables(spark, d)[0]
    return evaluate.set_losses(nodes, nodes.filter("entity_type = 'REGION'").select(F.col("id").alias("unit"), F.lit(0.25).alias("loss"))).select("id", F.round("loss", 6).alias("loss"))


# ---------------------------------------------------------------- records: formats, metrics, filters


def _qa(spark, d):
    """User turns with the assistant turn that follows."""
    t = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = t.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return n.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


QA = "qa AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"


@query(f"WITH {QA} SELECT conv_id, turn, question, answer FROM qa")
def qa_pairs(spark, d):
    return _qa(spark, d)


@query(f"WITH {QA} SELECT conv_id, turn, question AS instruction, '' AS input, answer AS output FROM qa")
def format_alpaca(spark, d):
    return generate.to_format(_qa(spark, d), "Alpaca").select("conv_id", "turn", "record.*")


@query(f"WITH {QA} SELECT conv_id, turn, 'human' AS from_1, question AS value_1, 'gpt' AS from_2, answer AS value_2 FROM qa")
def format_sharegpt(spark, d):
    r = F.col("record.conversations")
    return generate.to_format(_qa(spark, d), "Sharegpt").select("conv_id", "turn", r[0]["from"].alias("from_1"), r[0]["value"].alias("value_1"), r[1]["from"].alias("from_2"), r[1]["value"].alias("value_2"))


@query(f"WITH {QA} SELECT conv_id, turn, 'user' AS role_1, question || chr(10) || 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no' AS content_1, answer AS content_2 FROM qa")
def format_chatml(spark, d):
    rows = _qa(spark, d).withColumn("options", F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes")))
    r = F.col("record.messages")
    return generate.to_format(rows, "ChatML").select("conv_id", "turn", r[0]["role"].alias("role_1"), r[0]["content"].alias("content_1"), r[1]["content"].alias("content_2"))


@query(f"WITH {QA} SELECT conv_id, turn, question, answer FROM qa")
def qa_normalize_chatml(spark, d):
    rows = generate.to_format(_qa(spark, d), "ChatML").select("conv_id", "turn", "record.messages")
    return evaluate.normalize_qa(rows).select("conv_id", "turn", "question", "answer")


def _metrics(spark, d):
    q = _qa(spark, d)
    return evaluate.with_metrics(q, length=evaluate.qa_length(F.col("question"), F.col("answer")), turn=F.col("turn"))


#: Tokens of a pair by the default counter.
_QA_LENGTH = "len(regexp_extract_all(question || answer, '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9_\\x{c0}-\\x{24f}]+|[^\\sA-Za-z0-9_\\x{c0}-\\x{24f}\\x{4e00}-\\x{9fff}]'))"


@query(f"WITH {QA} SELECT conv_id, turn, CAST({_QA_LENGTH} AS DOUBLE) AS length FROM qa")
def qa_metrics(spark, d):
    return _metrics(spark, d).select("conv_id", "turn", F.col("metrics")["length"].alias("length"))


def _range(name: str, sql: str, **bounds):
    def f(spark, d):
        return evaluate.range_filter(_metrics(spark, d), "length", 60, 160, **bounds).select("conv_id", "turn")

    f.__name__ = name
    query(f"WITH {QA} SELECT conv_id, turn FROM (SELECT *, {_QA_LENGTH} AS n FROM qa) WHERE n {sql}")(f)


_range("range_filter_closed", "BETWEEN 60 AND 160")
_range("range_filter_open", "> 60 AND n < 160", with_low=False, with_high=False)
_range("range_filter_left_open", "> 60 AND n <= 160", with_low=False)
_range("range_filter_right_open", ">= 60 AND n < 160", with_high=False)


@query()
def mtld(spark, d):
    return table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.round(evaluate.mtld(F.col("text")), 6).alias("mtld"))


def _quiz(spark, d, *body):
    """Replies that ask about each part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("community_id"), F.concat(F.lit("<qa_pair>"), *body, F.lit("</qa_pair>")).alias("reply"))


_LETTER = "CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN '\"D\"' WHEN 2 THEN 'Because' WHEN 3 THEN 'b' WHEN 4 THEN 'E' ELSE ' C ' END"


@query("SELECT p_partkey AS community_id, 'Brand of ' || p_name || '?' AS question, CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'D' ELSE 'C' END AS answer, 'A=' || p_brand || ';B=none;C=other;D=all' AS opts FROM part WHERE p_partkey % 6 IN (0, 1, 5) AND p_size % 7 <> 0")
def parse_multi_choice(spark, d):
    lines = F.concat(F.lit("<options>A. "), F.col("p_brand"), F.lit("\nnote\nB none\nC. other"), F.when(F.col("p_size") % 7 == 0, "").otherwise("\nD.  all"), F.lit("</options>"))
    out = generate.parse_multi_choice(_quiz(spark, d, F.lit("<question>Brand of "), F.col("p_name"), F.lit("?</question>"), lines, F.lit("<answer>"), F.expr(_LETTER), F.lit("</answer>")))
    return out.select("community_id", "question", "answer", F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("opts"))


@query("SELECT p_partkey AS community_id, p_name || ' is ' || p_type AS question, CASE WHEN p_size % 3 = 0 THEN 'True' ELSE 'False' END AS answer FROM part WHERE p_size % 3 <> 2")
def parse_true_false(spark, d):
    said = F.when(F.col("p_size") % 3 == 0, "true").when(F.col("p_size") % 3 == 1, "FALSE").otherwise("maybe")
    rows = _quiz(spark, d, F.lit("<question>"), F.col("p_name"), F.lit(" is "), F.col("p_type"), F.lit("</question><answer>"), said, F.lit("</answer>"))
    return generate.parse_true_false(rows).select("community_id", "question", "answer")


@query("SELECT p_partkey AS community_id, 'Part _ of _' AS question, p_name || ';' || p_brand AS answers FROM part WHERE p_size % 4 <> 1")
def parse_fill_in_blank(spark, d):
    filled = F.when(F.col("p_size") % 4 == 1, " , ").otherwise(F.concat("p_name", F.lit(", "), "p_brand"))
    rows = _quiz(spark, d, F.lit("<question>Part _ of _</question><answer>"), filled, F.lit("</answer>"))
    return generate.parse_fill_in_blank(rows).select("community_id", "question", F.array_join("answers", ";").alias("answers"))


# ---------------------------------------------------------------- storage, lineage, lookups


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lineage_todo(spark, d):
    ledger = table(spark, d, "labels").select(F.lit("label").alias("op_name"), F.col("doc_id").alias("input_trace_id"), F.col("doc_id").alias("output_trace_id"))
    return storage.to_process(table(spark, d, "documents").select(F.col("doc_id").alias("_trace_id")), ledger).select(F.col("_trace_id").alias("doc_id"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def lineage_recovered(spark, d):
    labels = table(spark, d, "labels")
    ledger = labels.select(F.lit("label").alias("op_name"), F.col("doc_id").alias("input_trace_id"), F.col("doc_id").alias("output_trace_id"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("_trace_id"))
    return storage.recovered(rows, ledger, labels.withColumnRenamed("doc_id", "_trace_id")).withColumnRenamed("_trace_id", "doc_id")


@query("SELECT c_custkey AS _trace_id, c_name AS name FROM customer UNION ALL SELECT o_orderkey, min(o_orderstatus) FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_orderkey")
def kv_upsert_if_absent(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("_trace_id"), F.col("c_name").alias("name"))
    return storage.upsert_if_absent(old, table(spark, d, "orders").select(F.col("o_orderkey").alias("_trace_id"), F.col("o_orderstatus").alias("name")))


@query("SELECT o_orderkey AS ord, o_orderkey * 7 AS _trace_id, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_orderkey * 7")
def kv_get_by_ids(spark, d):
    kv = table(spark, d, "customer").select(F.col("c_custkey").alias("_trace_id"), F.col("c_name").alias("name"))
    return storage.get_by_ids(kv, table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 7).alias("_trace_id")), ["name"])


@query("WITH own AS (SELECT 'S' || l_suppkey AS id, l_orderkey AS chunk, min(l_linenumber * 1000 + l_suppkey) AS o FROM lineitem GROUP BY 1, 2) SELECT id, CAST(chunk AS VARCHAR) AS chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chunk) AS rank FROM own) WHERE rank <= 3")
def source_context_topk(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("id"), "l_orderkey").distinct()
    units = li.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda x: x.cast("string")), "<SEP>").alias("source_id")).withColumn("visual_trace", F.lit("")).withColumn("visual_path", F.lit(""))
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderpriority").alias("content"), F.lit("").alias("path"))
    return generate.source_chunks(units, spark.createDataFrame([], "src string, dst string, source_id string"), chunks).select("id", "chunk_id", "rank")


_SEED = "CASE p_partkey % 5 WHEN 0 THEN 'P' || (10000 + p_partkey) WHEN 1 THEN p_name || ' ' || p_partkey WHEN 2 THEN '>sp' || chr(10) || 'MKV' WHEN 3 THEN repeat('MKV', CAST(1 + p_size % 5 AS INT)) ELSE '  ' END"


@query(f"SELECT p_partkey, {_SEED} AS q, CASE p_partkey % 5 WHEN 0 THEN 'accession' WHEN 1 THEN 'keyword' WHEN 4 THEN NULL ELSE 'sequence' END AS kind FROM part")
def search_route(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(_SEED).alias("q")).select("p_partkey", "q", search.route("uniprot", F.col("q")).alias("kind"))


@query("SELECT doc_id, md5(replace(upper(regexp_replace(lower(text), '[^acgu]', '', 'g')), 'U', 'T')) AS digest FROM documents")
def search_rna_digest(spark, d):
    """The letters of each text that could be RNA, as a sequence in lines."""
    lines = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^acgu]", ""), "(.{60})", "$1\n")
    return table(spark, d, "documents").select("doc_id", search.rna_digest(lines).alias("digest"))


@query(f"SELECT p_partkey, p_name AS found FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 5 = 1")
def search_lookup(spark, d):
    """Accessions and keywords of parts, joined to the entries of all parts."""
    p = table(spark, d, "part")
    entry = lambda kind, key: p.select(F.lit(kind).alias("lookup_kind"), key.alias("lookup_key"), F.col("p_name").alias("found"))
    number = F.col("p_partkey").cast("string")
    entries = entry("accession", F.concat(F.lit("P"), (F.col("p_partkey") + 10000).cast("string"))).unionByName(entry("keyword", F.lower(F.concat_ws(" ", "p_name", number))))
    return search.search(p.select("p_partkey", F.expr(_SEED).alias("content")), entries, "uniprot").select("p_partkey", "found")


# ---------------------------------------------------------------- trees and samplers


_TITLE = "CASE o_orderkey % 7 WHEN 0 THEN '# ' || (o_orderkey % 9) || '.2.3' WHEN 1 THEN '## 8.' || (o_orderkey % 9) || ' Title' WHEN 2 THEN '### Intro' WHEN 3 THEN (o_orderkey % 9) || ' Results' WHEN 4 THEN '第' || (o_orderkey % 9) || '章 开始' WHEN 5 THEN '第2节 续' ELSE 'plain' END"


@query(f"SELECT o_orderkey, {_TITLE} AS title, CAST(CASE o_orderkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS INTEGER) AS level FROM orders")
def title_levels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(_TITLE).alias("title")).select("o_orderkey", "title", tx.title_level(F.col("title")).alias("level"))


def _markdown(docs):
    """Whole texts behind sections, a table and an image."""
    return docs.select("doc_id", F.concat(F.lit("# 1 Part\n\n## 1.1 Sub\n\nTable 1: data\n\n<table><tr><td>1</td></tr></table>\n\n# 2 Part\n\n![x](a/b.png)\nFigure 1: shown\n\n# 3 Text\n\n"), F.coalesce("text", F.lit(""))).alias("content"))


def _tree(docs):
    return tree.construct_tree(tree.assign_levels(tree.analyze_structure(_markdown(docs))))


def _parents(docs):
    return _tree(docs).filter("type = 'section' AND title IN ('# 1 Part', '## 1.1 Sub', '# 2 Part')").select("doc_id", "title", "parent_id", "level")


@query("SELECT doc_id, title, parent_id, level FROM documents, (VALUES ('# 1 Part', 'root', 1), ('## 1.1 Sub', 'n1', 2), ('# 2 Part', 'root', 1)) AS t(title, parent_id, level)")
def tree_parents(spark, d):
    return _parents(table(spark, d, "documents"))


@query()
def tree_chunks(spark, d):
    return tree.chunk_tree(_tree(table(spark, d, "documents"))).select("doc_id", "chunk_id", "type", "path", "length")


def _regions(nodes):
    return nodes.filter("entity_type = 'REGION'").select(F.col("id").alias("seed"))


@query(f"WITH {KG}, seeds AS (SELECT id AS seed FROM nodes WHERE entity_type = 'REGION'), {TWO_HOPS}, r AS (SELECT seed, id, round(0.6 - 0.1 * distance, 6)::DOUBLE AS score FROM near) SELECT seed, id, score, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, id DESC) AS INTEGER) AS rank FROM r")
def neighborhood_rank(spark, d):
    nodes, edges = kg_tables(spark, d)
    return sample.rank_nodes(graph.k_hop(edges, _regions(nodes), 2), nodes.withColumn("evidence_span", F.lit(""))).select("seed", "id", "score", "rank")


@query(f"WITH {KG}, seeds AS (SELECT id AS seed FROM nodes WHERE entity_type = 'NATION'), {TWO_HOPS} SELECT seed, entity_type AS type, count(*) AS n FROM near JOIN nodes USING (id) GROUP BY 1, 2")
def runtime_schema(spark, d):
    nodes, edges = kg_tables(spark, d)
    near = graph.k_hop(edges, nodes.filter("entity_type = 'NATION'").select(F.col("id").alias("seed")), 2)
    return sample.runtime_schema(near, nodes).select("seed", "type", "n")


@query(f"""WITH {KG}, seeds AS (SELECT id AS seed FROM nodes WHERE entity_type = 'REGION'), {TWO_HOPS},
said AS (SELECT id, list_distinct(regexp_extract_all(lower(id || ' ' || description), '[a-zA-Z][a-zA-Z0-9_\\-/]{{2,}}')) AS w FROM nodes)
SELECT seed, near.id AS id, round(0.12 * len(list_intersect(a.w, b.w)) + 0.12 + CASE WHEN b.id LIKE 'S%' THEN 0.08 ELSE 0 END, 4)::DOUBLE AS score
FROM near JOIN sym ON sym.id = near.id JOIN near up ON up.seed = near.seed AND up.id = sym.other AND up.distance <= 1 JOIN said a ON a.id = up.id JOIN said b ON b.id = near.id WHERE near.distance = 2""".replace("SELECT seed, near.id", "SELECT near.seed AS seed, near.id"))
def candidate_score(spark, d):
    """Regions and their nations are selected; edges to suppliers have evidence."""
    nodes, edges = kg_tables(spark, d)
    selected = graph.k_hop(edges, _regions(nodes), 1).withColumnRenamed("distance", "depth")
    nodes = nodes.withColumn("evidence_span", F.lit("")).withColumn("source_id", F.lit("")).withColumn("metadata", F.lit("{}"))
    edges = edges.withColumn("evidence_span", F.when(F.col("src").startswith("S") | F.col("dst").startswith("S"), "said")).withColumn("source_id", F.lit(""))
    return sample.candidates(selected, nodes, edges).select("seed", "id", "score")


@query("WITH s AS (SELECT o_orderkey AS id, (o_orderkey % 100) / 100.0 AS a, ((o_orderkey * 7) % 100) / 100.0 AS b FROM orders) SELECT id, a >= 0.68 AND b <= 0.45 AS ok FROM s")
def judge_gate(spark, d):
    a, b = (F.col("o_orderkey") % 100) / 100, ((F.col("o_orderkey") * 7) % 100) / 100
    scores = F.create_map(*[x for k in sample.GATE for x in (F.lit(k), b if k == "hallucination_risk" else a)])
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), sample.passes_gate(scores).alias("ok"))


@query()
def theme_select(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct(((F.col("o_orderkey") * 7 % 100) / 100).alias("score"), F.col("o_orderpriority").alias("focus"), F.array((F.col("o_orderkey") % 5).cast("string"), (F.col("o_orderkey") % 3).cast("string")).alias("nodes")).alias("x"))
    return o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("o_custkey", F.to_json(sample.diverse_themes(F.col("xs"))).alias("chosen"))


# ---------------------------------------------------------------- results browser


def _samples(spark, d):
    q = _qa(spark, d)
    return q.select(F.concat(F.lit("run"), (F.col("conv_id") % 3).cast("string")).alias("run_id"), F.concat_ws("-", "conv_id", "turn").alias("key"), "question", "answer", F.lit("").alias("img_path"), F.lit("").alias("sub_graph")).withColumn("sample_id", platform.sample_id(F.col("run_id"), F.col("key")))


SAMPLES = QA + ", samples AS (SELECT 'run' || (conv_id % 3) AS run_id, conv_id || '-' || turn AS key, question, answer FROM qa)"


@query(f"WITH {SAMPLES} SELECT key, substr(sha1(run_id || ':' || key), 1, 16) AS sample_id FROM samples")
def sample_ids(spark, d):
    return _samples(spark, d).select("key", "sample_id")


@query(f"WITH {SAMPLES}, s AS (SELECT substr(sha1(run_id || ':' || key), 1, 16) AS sample_id, question FROM samples WHERE contains(lower(question || chr(10) || answer), 'the')) SELECT sample_id, substr(question, 1, 140) AS preview FROM s ORDER BY sample_id LIMIT 20 OFFSET 10")
def platform_list_samples(spark, d):
    return platform.list_samples(_samples(spark, d), search="The", offset=10, limit=20)[0]


@query("SELECT 'run' || (s_suppkey % 4) AS run_id, count(*) AS n_samples, CAST(count(*) * 2 AS BIGINT) AS n_nodes, count(*) AS n_evidence, count(*) AS n_edges, CAST(sum(CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_dangling, 0.5::DOUBLE AS evidence_coverage FROM supplier GROUP BY 1")
def platform_run_stats(spark, d):
    s, n = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    node = lambda i, e: F.struct(i.alias("id"), F.lit("T").alias("entity_type"), F.lit(e).alias("evidence_span"))
    edge = F.struct(s.alias("src"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("gone")).otherwise(n).alias("dst"))
    return platform.run_stats(table(spark, d, "supplier").select(F.concat(F.lit("run"), (F.col("s_suppkey") % 4).cast("string")).alias("run_id"), s.alias("sample_id"), F.array(node(s, "said"), node(n, "")).alias("nodes"), F.array(edge).alias("edges")))


# ---------------------------------------------------------------- communities and the model stub


def _community_graph(spark, d):
    nodes, edges = kg_tables(spark, d)
    return nodes.withColumn("length", F.length("description")).withColumn("loss", F.when(F.col("entity_type") == "NATION", 0.5)).withColumn("section", F.lit("")), edges.withColumn("length", F.lit(3))


def _partition(name: str, method: str, **params):
    def f(spark, d):
        out = partition.partition(*_community_graph(spark, d), method, **params)
        return out.select("community_id", F.array_join("nodes", ",").alias("nodes"), F.array_join(F.transform("edges", lambda e: F.concat_ws("|", e["src"], e["dst"])), ",").alias("edges"))

    f.__name__ = name
    query()(f)


_partition("partition_bfs", "bfs", max_units=6)
_partition("partition_dfs", "dfs", max_units=6)
_partition("partition_ece", "ece", max_units=8, min_units=2, order="max_loss")
_partition("partition_leiden", "leiden", max_size=10)
_partition("partition_anchor_bfs", "anchor_bfs", max_units=8, types=("region",))
_partition("partition_aggregated_vqa", "aggregated_vqa_anchor_bfs", types=("region",), modalities=("region", "nation"), min_units=3)


def _chunks(spark, d):
    return sp.chunk(_docs(spark, d)).select(F.col("_trace_id").alias("chunk_id"), "content")


@query()
def build_kg_stub(spark, d):
    chunks = storage.cut_lineage(_chunks(spark, d))
    nodes, _ = kg.build(chunks, storage.cut_lineage(kg.extraction_replies(chunks, StubModel(), max_loop=1)))
    return nodes.select("id", "entity_type", "description", "source_id", "length")


@query()
def quiz_judge_stub(spark, d):
    from weftgraph.models.base import yes_no

    items = kg_tables(spark, d)[0].select("id", "description")
    quiz = generate.judge_prompts(generate.quiz_prompts(items, samples=2).withColumn("statement", F.col("prompt")))
    judged = yes_no(quiz, StubModel(), "prompt", "candidates").select(F.col("id").alias("unit"), F.concat("kind", F.col("n").cast("string")).alias("n"), "candidates", F.when(F.col("kind") == "anti", "no").otherwise("yes").alias("truth"))
    return evaluate.unit_losses(judged)


@query()
def rephrase_stub(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("content"))
    return generate.rephrase(rows, StubModel(), "popular science")


@query()
def generate_stub(spark, d):
    return flagship(spark, d)


@query()
def sample_families_stub(spark, d):
    nodes, edges = kg_tables(spark, d)
    pairs = graph.symmetric(edges).select(F.col("id").alias("parent"), F.col("other").alias("id"))
    near = graph.k_hop(edges, nodes.filter("entity_type = 'REGION'").select(F.col("id").alias("seed")), 1)
    cands = near.select("seed", F.col("id").alias("parent")).join(pairs, "parent").withColumn("score", F.lit(0.5)).withColumn("text", F.col("id"))
    return sample.sample_families(cands, sample.stub_ask).select("seed", "qa_family", "status", "reason")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents → chunks → stub extraction → graph → communities → questions → ChatML."""
    chunks = storage.cut_lineage(_chunks(spark, sf_dir))
    replies = storage.cut_lineage(kg.extraction_replies(chunks, StubModel(), max_loop=0))
    nodes, edges = kg.build(chunks, replies)
    nodes, edges = storage.cut_lineage(nodes), storage.cut_lineage(edges)
    storage.release(chunks, replies)
    found = storage.cut_lineage(partition.ece(nodes, edges, max_units=10, min_units=3))
    payload = graph.community_payloads(found, nodes, edges)
    out = generate.to_format(generate.generate(payload, StubModel(), "atomic"), "ChatML")
    return out.select("community_id", "question", "answer", F.to_json("record").alias("record"))
