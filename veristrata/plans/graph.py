"""Queries over a property graph made of the star schema: customers, suppliers, nations, regions, parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import graph as G
from ..session import materialize, table
from .registry import plan

NODES = """nodes AS (SELECT 'C' || c_custkey AS id, 'Customer' AS label, c_name AS name, false AS stub FROM customer UNION ALL SELECT 'S' || s_suppkey, 'Supplier', s_name, false FROM supplier
    UNION ALL SELECT 'N' || n_nationkey, 'Nation', n_name, false FROM nation UNION ALL SELECT 'R' || r_regionkey, 'Region', r_name, false FROM region UNION ALL SELECT 'X' || n_nationkey, 'Nation', n_name, true FROM nation)"""
EDGES = """edges AS (SELECT 'C' || c_custkey AS src, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE 'N' END || c_nationkey AS dst, 'LIVES_IN' AS type FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'BASED_IN' FROM supplier
    UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'PART_OF' FROM nation UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'C' || o_custkey, 'SERVES' FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and typed edges; nations also have stubs (ids X...), to which some customers point."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "supplier", "nation", "region", "lineitem", "orders")}
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda d, p, k, label, name, stub=False: d.select(key(p, k).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), F.lit(stub).alias("stub"))
    nodes = node(t["customer"], "C", "c_custkey", "Customer", "c_name").union(node(t["supplier"], "S", "s_suppkey", "Supplier", "s_name")).union(node(t["nation"], "N", "n_nationkey", "Nation", "n_name"))
    nodes = nodes.union(node(t["region"], "R", "r_regionkey", "Region", "r_name")).union(node(t["nation"], "X", "n_nationkey", "Nation", "n_name", True))
    edge = lambda d, src, dst, kind: d.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    home = F.concat(F.when(F.col("c_custkey") % 10 == 0, "X").otherwise("N"), F.col("c_nationkey").cast("string"))
    serves = t["lineitem"].select("l_orderkey", "l_suppkey").join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edge(t["customer"], key("C", "c_custkey"), home, "LIVES_IN").union(edge(t["supplier"], key("S", "s_suppkey"), key("N", "s_nationkey"), "BASED_IN")).union(edge(t["nation"], key("N", "n_nationkey"), key("R", "n_regionkey"), "PART_OF"))
    return nodes, edges.union(edge(serves.select("l_suppkey", "o_custkey").distinct(), key("S", "l_suppkey"), key("C", "o_custkey"), "SERVES"))


@plan(f"WITH {NODES}, {EDGES} SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS inbound FROM nodes")
def agg_inbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.in_degrees(*graph(spark, sf_dir))


@plan(f"WITH {NODES}, {EDGES} SELECT id, (SELECT count(*) FROM edges WHERE dst = id AND type = 'SERVES') AS incoming, (SELECT count(*) FROM edges WHERE src = id AND type = 'SERVES') AS outgoing FROM nodes WHERE NOT stub")
def agg_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return G.link_counts(nodes.where("NOT stub"), edges.where("type = 'SERVES'"))


@plan(f"WITH {EDGES}, t(type) AS (VALUES ('LIVES_IN'), ('BASED_IN'), ('PART_OF'), ('SERVES'), ('MENTIONS')) SELECT type, (SELECT count(*) FROM edges e WHERE e.type = t.type) AS n FROM t")
def agg_rel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_rel_summary and agg_stats: edges by type, zero where a known type has none."""
    return G.relation_summary(graph(spark, sf_dir)[1], ["LIVES_IN", "BASED_IN", "PART_OF", "SERVES", "MENTIONS"])


@plan(f"WITH {NODES}, {EDGES} SELECT src, dst, type, s.name AS subject, o.name AS object FROM edges JOIN nodes s ON src = s.id JOIN nodes o ON dst = o.id WHERE contains(lower(s.name), 'supplier') AND contains(lower(o.name), 'nation_1') AND type = 'BASED_IN' ORDER BY src, dst, type LIMIT 10")
def join_triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the operator's own (ten matches)."""
    return G.triplets(*graph(spark, sf_dir), "Supplier", "NATION_1", "BASED_IN").select("src", "dst", "type", "subject", "object")


@plan(f"WITH {NODES}, {EDGES} SELECT s.id AS id, count(*) AS matches, least(count(*), 50) AS counted FROM edges JOIN nodes s ON src = s.id JOIN nodes o ON dst = o.id WHERE o.label = 'Customer' GROUP BY s.id")
def agg_evidence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches per subject, capped where they count as evidence (agg_triplet_count)."""
    nodes, edges = graph(spark, sf_dir)
    e = edges.join(nodes.where("label = 'Customer'").select(F.col("id").alias("dst")), "dst")
    return e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("matches"), F.least(F.count("*"), F.lit(50)).alias("counted"))


@plan(f"""WITH {NODES}, {EDGES}, h AS (SELECT src AS id, type, dst AS other FROM edges UNION ALL SELECT dst, type, src FROM edges) SELECT h.* FROM h JOIN nodes USING (id) WHERE label = 'Nation' AND type IN ('BASED_IN', 'PART_OF')""")
def join_rel_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return G.related(edges, nodes.where("label = 'Nation'").select("id"), ["BASED_IN", "PART_OF"])


@plan(f"""WITH RECURSIVE {EDGES}, u AS (SELECT * FROM edges UNION ALL SELECT dst, src, type FROM edges), p AS (SELECT ['N1'] AS nodes, []::VARCHAR[] AS types, 0 AS hops, 'N1' AS node
    UNION ALL SELECT list_append(nodes, dst), list_append(types, type), hops + 1, dst FROM p JOIN u ON u.src = p.node WHERE hops < 4 AND node <> 'R2' AND NOT list_contains(nodes, dst) AND (type = 'PART_OF' OR hops < 2 OR dst LIKE 'N%'))
SELECT hops::INT AS hops, array_to_string(nodes[2:hops], '>') AS via, array_to_string(types, '>') AS types FROM p WHERE node = 'R2' ORDER BY hops, via, types LIMIT 20""")
def join_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty undirected paths of up to four hops between two nodes; the limit is the operator's own.

    A path of four hops ends in an edge of a nation, as only nations have edges to regions: the SQL says so to stay small.
    """
    return G.paths(graph(spark, sf_dir)[1], "N1", "R2", 4, 20)


@plan(f"""WITH {NODES}, {EDGES}, r AS (SELECT name, min(id) AS target FROM nodes WHERE NOT stub GROUP BY name), m AS (SELECT id AS old, target FROM nodes JOIN r USING (name) WHERE stub)
SELECT DISTINCT coalesce(a.target, src) AS src, coalesce(b.target, dst) AS dst, type FROM edges LEFT JOIN m a ON a.old = src LEFT JOIN m b ON b.old = dst""")
def join_stub_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_stubs(*graph(spark, sf_dir))[1]


@plan("""WITH RECURSIVE r AS (SELECT * FROM (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 50 = 49 THEN o_orderkey - 2 WHEN o_orderkey % 50 = 47 THEN o_orderkey + 2 WHEN o_orderkey % 50 = 33 THEN o_orderkey WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 WHEN o_orderkey % 3 = 0 THEN o_orderkey + 4 END AS dst FROM orders) WHERE dst IS NOT NULL),
c AS (SELECT src, dst, 1 AS hops FROM r UNION ALL SELECT c.src, r.dst, hops + 1 FROM c JOIN r ON r.src = c.dst WHERE hops < 100), e AS (SELECT src, max(hops) AS hops, arg_max(dst, hops) AS dst FROM c GROUP BY src)
SELECT e.src::BIGINT AS src, CASE WHEN hops < 100 THEN dst ELSE -1 END::BIGINT AS dst, CASE WHEN hops < 100 THEN hops ELSE -1 END::BIGINT AS hops FROM e""")
def join_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of redirects over all orders by pointer doubling; -1 where a chain runs into a cycle."""
    k = F.col("o_orderkey").cast("long")
    to = F.when(k % 50 == 49, k - 2).when(k % 50 == 47, k + 2).when(k % 50 == 33, k).when(k % 2 == 0, F.floor(k / 2)).when(k % 3 == 0, k + 4)
    return G.follow_redirects(table(spark, sf_dir, "orders").select(k.alias("src"), to.cast("long").alias("dst")).where("dst IS NOT NULL")).fillna(-1)


_M = "m AS (SELECT DISTINCT l_orderkey AS item, p_brand AS grp FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("item"), F.col("p_brand").alias("grp")).distinct()


@plan(f"WITH {_M} SELECT x.grp AS a, y.grp AS b, count(*) AS shared FROM m x JOIN m y ON x.item = y.item AND x.grp < y.grp GROUP BY ALL")
def gr_category_cooccur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cooccurrence(_members(spark, sf_dir), "item", "grp")


_H = "h AS (SELECT DISTINCT l_orderkey AS item, p_brand AS grp FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT DISTINCT l_orderkey, p_type || '/' || p_size FROM lineitem JOIN part ON l_partkey = p_partkey)"


@plan(f"""WITH {_H}, s AS (SELECT grp, count(*) AS n FROM h GROUP BY grp), c AS (SELECT x.grp AS parent, y.grp AS child, count(*) AS shared FROM h x JOIN h y ON x.item = y.item AND x.grp <> y.grp GROUP BY ALL)
SELECT parent, child, shared FROM c JOIN s p ON p.grp = parent JOIN s k ON k.grp = child WHERE shared >= 5 AND k.n < 0.5::DOUBLE * p.n AND shared > 0.3::DOUBLE * k.n""")
def join_category_hier(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"))
    m = j.select(F.col("l_orderkey").alias("item"), F.col("p_brand").alias("grp")).union(j.select(F.col("l_orderkey").alias("item"), kind.alias("grp"))).distinct()
    return G.category_hierarchy(m, "item", "grp")


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)", "deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT n.id, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * coalesce(g.given, 0) AS rank FROM nodes n LEFT JOIN (SELECT dst AS id, sum(rank / d) AS given FROM edges JOIN deg USING (src) JOIN r{i} ON r{i}.id = src GROUP BY dst) g USING (id))")
    return ", ".join(steps)


@plan(f"WITH {NODES}, {EDGES}, {_pagerank_sql(20)} SELECT id, round(rank, 8) AS rank FROM r20")
def gr_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return G.pagerank(nodes, edges, 20).select("id", F.round("rank", 8).alias("rank"))


@plan(f"""WITH {NODES}, {EDGES}, {_pagerank_sql(20)} SELECT id, round(0.4::DOUBLE * 0.5::DOUBLE + CASE WHEN rank > 0 THEN log10(rank * 1000000 + 1) / 6 * 0.35::DOUBLE ELSE 0 END + CASE WHEN inbound > 0 THEN log10(inbound + 1) / 5 * 0.25::DOUBLE ELSE 0 END, 6) AS quality FROM r20 JOIN (SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS inbound FROM nodes) USING (id)""")
def fn_quality_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    edges = materialize(edges, "edges")  # ranked and counted
    j = G.pagerank(nodes, edges, 20).join(G.in_degrees(nodes, edges), "id")
    return j.select("id", F.round(C.final_quality(F.lit(0.5), F.col("rank"), F.col("inbound")), 6).alias("quality"))


@plan(f"""WITH {NODES}, {EDGES}, d AS (SELECT id, (SELECT count(*) FROM edges WHERE dst = id) AS inbound, hash IS NOT NULL AS embedded FROM (SELECT id, CASE WHEN id LIKE '%1' THEN 1 END AS hash FROM nodes)) SELECT id, inbound FROM (SELECT * FROM d ORDER BY inbound DESC, id LIMIT 20) WHERE NOT embedded""")
def topk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top is taken first, then those without a vector (the limit is the feature)."""
    nodes, edges = graph(spark, sf_dir)
    return G.top_entities(nodes.select("id", F.col("id").endswith("1").alias("embedded")), G.in_degrees(nodes, edges), 20).select("id", "inbound")


_P = "p AS (SELECT c_custkey AS id, (c_custkey * 37 % 16000) / 100.0::DOUBLE - 80 AS lat, (c_custkey * 91 % 35900) / 100.0::DOUBLE - 180 AS lon FROM customer)"
_HAV = "2 * 6371.0::DOUBLE * asin(least(1, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "(c_custkey * 37 % 16000) / 100D - 80 AS lat", "(c_custkey * 91 % 35900) / 100D - 180 AS lon")


@plan(f"WITH {_P} SELECT a.id AS a, b.id AS b, round({_HAV}, 3) AS km FROM p a JOIN p b ON a.id < b.id WHERE {_HAV} < 500")
def join_geo_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.near_pairs(_points(spark, sf_dir), 500.0).select("a", "b", F.round("km", 3).alias("km"))


@plan(f"WITH {_P}, o AS (SELECT 48.0::DOUBLE AS lat, 11.0::DOUBLE AS lon) SELECT b.id, round({_HAV}, 3) AS km FROM o a, p b WHERE {_HAV} <= 1000")
def join_geo_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points around a constant place."""
    d = G.haversine_km(F.lit(48.0), F.lit(11.0), F.col("lat"), F.col("lon"))
    return _points(spark, sf_dir).withColumn("km", d).where("km <= 1000").select("id", F.round("km", 3).alias("km"))


@plan("""WITH c AS (SELECT o_custkey AS doc, o_orderkey AS claim, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE [o_orderpriority, o_orderstatus] END AS e FROM orders),
p AS (SELECT x.doc, x.claim AS a, y.claim AS b, row_number() OVER (PARTITION BY x.doc ORDER BY x.claim, y.claim) AS k FROM c x JOIN c y ON x.doc = y.doc AND x.claim < y.claim WHERE length(x.e) = 0 OR length(y.e) = 0 OR length(list_intersect(x.e, y.e)) >= 1)
SELECT doc, a, b FROM p WHERE k <= 200""")
def join_claim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("claim"), F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority", "o_orderstatus")).alias("e"))
    return G.claim_pairs(c, "doc", "claim", "e")


@plan("""SELECT c_custkey AS id, n_name AS nation, r_name AS region, last.o_orderstatus AS last_status, coalesce(orders.n, 0) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) last ON last.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) orders ON orders.o_custkey = c_custkey""")
def join_enrich_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained left joins with lookup tables, each reduced to its last row per key first (agg_last_wins)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    counts = o.groupBy("id").agg(F.count("*").alias("n_orders"))
    j = C.enrich(c, "id", {"status": o.withColumnRenamed("o_orderstatus", "last_status")}).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(counts, "id", "left")
    return j.select("id", "nation", "region", "last_status", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@plan("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_semi_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows not processed yet (set_except_processed): an anti join."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@plan("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_union_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids found in either store (agg_existing_ids, join_exists)."""
    a = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("id"))
    return a.union(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")).distinct()
