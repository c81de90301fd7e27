"""The registered graph queries over the driver's tables, each with its SQL.

Unless a query says otherwise its graph is that of parts with returned line items on one order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohesia.functions import balance, ragged
from cohesia.operators import canonical, clustering, parts, sets, tiles, triangles, truss
from cohesia.operators.access import Graph
from cohesia.runtime import materialize, scoped, tidied, work_dir
from cohesia.sources.arrays import read_binary_csr, write_binary_csr
from cohesia.sources.edges import pairs_within, part_graph, write_edge_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query; the tables that it makes on its way are deleted once its result is written."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            return tidied(spark, lambda: f(spark, d), f.__name__)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph_sql(flag: str) -> str:
    return f"""SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = '{flag}' AND b.l_returnflag = '{flag}'"""


G = f"g AS ({_graph_sql('R')})"
BOTH = "both_ways AS (SELECT src AS v, dst AS w FROM g UNION ALL SELECT dst, src FROM g)"
DEG = "deg AS (SELECT v AS id, count(*) AS degree FROM both_ways GROUP BY v)"
RANK = "ranked AS (SELECT id, degree, row_number() OVER (ORDER BY degree, id) - 1 AS idx FROM deg)"
ORIENTED = """o AS (SELECT src_idx, dst_idx, row_number() OVER (ORDER BY src_idx, dst_idx) - 1 AS edge_id FROM (
  SELECT least(a.idx, b.idx) AS src_idx, greatest(a.idx, b.idx) AS dst_idx FROM g JOIN ranked a ON a.id = src JOIN ranked b ON b.id = dst))"""
TRI = """t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM g x JOIN g y ON x.dst = y.src JOIN g z ON z.src = x.src AND z.dst = y.dst)"""
SUP = """s AS (SELECT g.src, g.dst, coalesce(n, 0)::INTEGER AS support FROM g LEFT JOIN (
  SELECT src, dst, count(*) AS n FROM (SELECT a AS src, b AS dst FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) GROUP BY 1, 2
) USING (src, dst))"""
#: h-index iteration; 25 rounds exceed the depth of these graphs.
TRUSS = """e AS (SELECT src, dst, support, row_number() OVER (ORDER BY src, dst) AS e FROM s),
te AS (SELECT x.e AS e1, y.e AS e2, z.e AS e3 FROM t JOIN e x ON (x.src, x.dst) = (a, b) JOIN e y ON (y.src, y.dst) = (a, c) JOIN e z ON (z.src, z.dst) = (b, c)),
inc AS (SELECT e1 AS e, e2 AS f, e3 AS g FROM te UNION ALL SELECT e2, e1, e3 FROM te UNION ALL SELECT e3, e1, e2 FROM te),
h AS (
  SELECT 0 AS n, e, support::BIGINT AS h FROM e
  UNION ALL
  SELECT n + 1, e, coalesce(max(CASE WHEN r IS NULL THEN 0 ELSE least(r, rn) END), 0)::BIGINT FROM (
    SELECT own.n, own.e, least(hf.h, hg.h) AS r, row_number() OVER (PARTITION BY own.e ORDER BY least(hf.h, hg.h) DESC NULLS LAST) AS rn
    FROM h own LEFT JOIN inc ON inc.e = own.e LEFT JOIN h hf ON hf.e = inc.f LEFT JOIN h hg ON hg.e = inc.g
  ) WHERE n < 25 GROUP BY n, e
),
tr AS (SELECT src, dst, (h + 2)::INTEGER AS trussness FROM h JOIN e USING (e) WHERE n = 25)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_S = with_(G, TRI, SUP)
_T = with_(G, TRI, SUP, TRUSS)
_R = with_(G, BOTH, DEG, RANK)
_O = with_(G, BOTH, DEG, RANK, ORIENTED)
_D = with_(G, BOTH, DEG)
#: The vertex set of set queries: those of at least twice the mean degree.
_VS = "vs AS (SELECT id FROM deg WHERE degree >= 2 * (SELECT avg(degree) FROM deg))"
_V = with_(G, BOTH, DEG, _VS)


def busy(g: DataFrame) -> DataFrame:
    d = canonical.degrees(g)
    return d.crossJoin(F.broadcast(d.agg(F.avg("degree").alias("mean")))).where("degree >= 2 * mean").select("id")


# edge tables


@query(with_(G) + "SELECT src, dst FROM g")
def canonical_edges(spark, d):
    return canonical.canonicalise(part_graph(spark, d))


@query("""SELECT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst, count(*) AS n
FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_partkey <> b.l_partkey GROUP BY 1, 2""")
def self_loop_and_dup_cleanup(spark, d):
    noisy = pairs_within(table(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey", "l_partkey")
    return canonical.multiplicities(noisy.select(F.col("a").alias("src"), F.col("b").alias("dst")))


_ATTR_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


@query(f"""SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS quantity, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY {_ATTR_ORDER}) AS n
  FROM lineitem WHERE l_partkey <> l_suppkey) WHERE n = 1""")
def first_row_wins_edge_attrs(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("quantity"))
    return canonical.first_rows(rows, ["l_orderkey", "l_linenumber"])


@query(with_(G) + "SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g")
def symmetrised_edges(spark, d):
    return canonical.symmetrise(part_graph(spark, d))


@query(_R + "SELECT id, degree, idx FROM ranked")
def degree_ranked_vertices(spark, d):
    return canonical.rank_by_degree(part_graph(spark, d)).select("id", "degree", "idx")


@query(_O + "SELECT src_idx, dst_idx, edge_id FROM o")
def oriented_edges(spark, d):
    return canonical.oriented_index(part_graph(spark, d))[1].select("src_idx", "dst_idx", "edge_id")


@query(_O + """SELECT idx, id, (coalesce(sum(n) OVER w, 0) - coalesce(n, 0))::BIGINT AS "start", coalesce(sum(n) OVER w, 0)::BIGINT AS "end"
FROM ranked LEFT JOIN (SELECT src_idx AS idx, count(*) AS n FROM o GROUP BY 1) USING (idx) WINDOW w AS (ORDER BY idx)""")
def csr_offsets(spark, d):
    return Graph(part_graph(spark, d)).csr()[0].select("idx", "id", "start", "end")


@query(with_(G, BOTH) + "SELECT i.idx, j.idx AS nbr FROM both_ways JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx FROM (SELECT DISTINCT v FROM both_ways)) i USING (v) JOIN (SELECT v AS w, row_number() OVER (ORDER BY v) - 1 AS idx FROM (SELECT DISTINCT v FROM both_ways)) j USING (w)")
def binary_csr_round_trip(spark, d):
    """The two binary files of the graph in both directions, written at their places and read again."""
    folder = scoped(f"{work_dir(spark)}/csr-{uuid.uuid4().hex}")
    offsets, columns = Graph(part_graph(spark, d)).csr(symmetric=True, by="id")
    write_binary_csr(offsets, columns, folder)
    return read_binary_csr(spark, folder)


@query(_O + "SELECT row_number() OVER (ORDER BY dst_idx, src_idx) - 1 AS place, dst_idx, edge_id FROM o")
def in_edge_index(spark, d):
    edges = canonical.oriented_index(part_graph(spark, d))[1]
    return canonical.dense_index(edges, "dst_idx", "src_idx", name="place").select("place", "dst_idx", "edge_id")


@query(_D + "SELECT v AS id, string_agg(w::VARCHAR, ',' ORDER BY w) AS nbrs FROM both_ways GROUP BY v")
def adjacency_lists(spark, d):
    return Graph(part_graph(spark, d)).adjacency().select("id", F.array_join("nbrs", ",").alias("nbrs"))


@query(_D + """, l AS (SELECT v AS id, list(w ORDER BY w) AS ws FROM both_ways GROUP BY v)
SELECT id, array_to_string(list_transform(range(1, 9), lambda i: coalesce(ws[i], -1)), ',') AS padded,
       array_to_string(list_transform(range(1, 9), lambda i: CASE WHEN i <= len(ws) THEN '1' ELSE '0' END), ',') AS mask FROM l""")
def padded_adjacency(spark, d):
    near = Graph(part_graph(spark, d)).adjacency()
    mask = F.transform(ragged.pad_mask(F.col("nbrs"), 8), lambda m: m.cast("int").cast("string"))
    return near.select("id", F.array_join(ragged.padded(F.col("nbrs"), 8), ",").alias("padded"), F.array_join(mask, ",").alias("mask"))


@query("""SELECT n_nationkey AS "row", unnest(range(n_nationkey::BIGINT * 3, n_nationkey::BIGINT * 3 + n_nationkey % 4)) AS value FROM nation""")
def ragged_ranges(spark, d):
    start = F.col("n_nationkey").cast("long") * 3
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("row"), start.alias("start"), (start + F.col("n_nationkey") % 4).alias("end"))
    return ragged.expand_ranges(rows).select("row", "value")


# degrees, neighbours, subgraphs, attributes


@query(_D + "SELECT id, coalesce(n, 0) AS degree FROM deg LEFT JOIN (SELECT src AS id, count(*) AS n FROM g GROUP BY 1) USING (id)")
def out_degree(spark, d):
    return Graph(part_graph(spark, d)).out_degree()


@query(_D + "SELECT id, coalesce(n, 0) AS degree FROM deg LEFT JOIN (SELECT dst AS id, count(*) AS n FROM g GROUP BY 1) USING (id)")
def in_degree(spark, d):
    return Graph(part_graph(spark, d)).in_degree()


@query(_D + "SELECT id, degree FROM deg")
def all_degree(spark, d):
    return Graph(part_graph(spark, d)).all_degree()


@query(_V + "SELECT src AS id, dst AS nbr FROM g JOIN vs ON id = src")
def neighbours_of_set(spark, d):
    g = part_graph(spark, d)
    return Graph(g).out_neighbours(busy(g))


@query(_V + "SELECT dst AS id, src AS nbr FROM g JOIN vs ON id = dst")
def in_neighbours_of_set(spark, d):
    g = part_graph(spark, d)
    return Graph(g).in_neighbours(busy(g))


@query(_V + "SELECT v AS id, w AS nbr FROM both_ways JOIN vs ON id = v")
def all_neighbours_of_set(spark, d):
    g = part_graph(spark, d)
    return Graph(g).all_neighbours(busy(g))


@query(_V + "SELECT src, dst FROM g WHERE src IN (SELECT id FROM vs) OR dst IN (SELECT id FROM vs)")
def edges_of_set(spark, d):
    g = part_graph(spark, d)
    return Graph(g).all_edges(busy(g))


@query(_V + "SELECT src, dst FROM g WHERE src IN (SELECT id FROM vs) AND dst IN (SELECT id FROM vs)")
def induced_subgraph(spark, d):
    g = part_graph(spark, d)
    return Graph(g).induced_subgraph(busy(g)).edges


@query(_V + "SELECT src, dst FROM g WHERE src IN (SELECT id FROM vs)")
def row_subgraph(spark, d):
    g = part_graph(spark, d)
    return Graph(g).row_subgraph(busy(g))


def _attributed(spark, d) -> Graph:
    g = part_graph(spark, d)
    ids = g.select(F.explode(F.array("src", "dst")).alias("p_partkey")).distinct()
    vertices = table(spark, d, "part").join(ids, "p_partkey", "left_semi").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    shared = g.join(vertices.select(F.col("id").alias("src"), F.col("p_size").alias("a")), "src").join(vertices.select(F.col("id").alias("dst"), F.col("p_size").alias("b")), "dst")
    return Graph(shared.select("src", "dst", F.abs(F.col("a") - F.col("b")).alias("gap")), vertices)


_ATTRIBUTED = _D + ", v AS (SELECT p_partkey AS id, p_size, p_retailprice FROM part JOIN deg ON id = p_partkey), ed AS (SELECT src, dst, abs(a.p_size - b.p_size) AS gap FROM g JOIN v a ON a.id = src JOIN v b ON b.id = dst)\n"


@query(_ATTRIBUTED + "SELECT id, p_size, p_retailprice FROM v WHERE p_size > 25")
def vertex_attr_select(spark, d):
    return _attributed(spark, d).select_vertices("p_size", lambda c: c > 25)


@query(_ATTRIBUTED + "SELECT src, dst, gap FROM ed WHERE gap <= 5")
def edge_attr_select(spark, d):
    return _attributed(spark, d).select_edges("gap", lambda c: c <= 5)


@query(_ATTRIBUTED + "SELECT id, CASE WHEN p_size > 25 THEN 0 ELSE p_size END AS p_size, p_retailprice FROM v")
def masked_attr_update(spark, d):
    return _attributed(spark, d).set_vertex_attribute("p_size", F.lit(0), F.col("p_size") > 25).vertices


@query(_ATTRIBUTED + "SELECT src, dst, CASE WHEN gap > 20 THEN -1 ELSE gap END AS gap FROM ed")
def masked_edge_attr_update(spark, d):
    return _attributed(spark, d).set_edge_attribute("gap", F.lit(-1), F.col("gap") > 20).edges


@query(with_(G, """core AS (
  SELECT 0 AS n, src, dst FROM g
  UNION ALL
  SELECT n + 1, src, dst FROM core WHERE n < 30
    AND src IN (SELECT v FROM (SELECT src AS v FROM core UNION ALL SELECT dst FROM core) GROUP BY v HAVING count(*) > 1)
    AND dst IN (SELECT v FROM (SELECT src AS v FROM core UNION ALL SELECT dst FROM core) GROUP BY v HAVING count(*) > 1)
)""") + "SELECT src, dst FROM core WHERE n = 30")
def two_core_prune(spark, d):
    return canonical.two_core(part_graph(spark, d))


# triangles and supports


@query(with_(G, TRI) + "SELECT a, b, c FROM t")
def triangle_list(spark, d):
    return triangles.triangle_list(part_graph(spark, d))


@query(with_(G, TRI) + "SELECT a, b, c FROM t")
def triangle_list_tiled(spark, d):
    """By a grid of five buckets, 35 tiles, or of more where those would be too large; edges are sent to tiles, no wedges."""
    return tiles.triangle_list_tiled(part_graph(spark, d), 5)


@query(with_(G, TRI) + "SELECT count(*) AS triangles FROM t")
def triangle_count(spark, d):
    return triangles.triangle_count(part_graph(spark, d))


_PER_VERTEX = "pv AS (SELECT id, degree, coalesce(n, 0)::BIGINT AS triangles FROM deg LEFT JOIN (SELECT v AS id, count(*) AS n FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v) USING (id))"


@query(with_(G, BOTH, DEG, TRI, _PER_VERTEX) + "SELECT id, triangles FROM pv")
def triangles_per_vertex(spark, d):
    return triangles.triangles_per_vertex(part_graph(spark, d))


@query(with_(G, BOTH, DEG, TRI, _PER_VERTEX) + "SELECT id, degree, triangles, round(CASE WHEN degree > 1 THEN triangles / (degree * (degree - 1) / 2) ELSE 0 END, 6) AS coefficient FROM pv")
def clustering_coefficients(spark, d):
    return triangles.clustering(part_graph(spark, d)).withColumn("coefficient", F.round("coefficient", 6))


@query(with_(G, BOTH) + """SELECT src, dst, w, max(s) = 1 AS in_src, max(t) = 1 AS in_dst FROM (
  SELECT src, dst, w, 1 AS s, 0 AS t FROM g JOIN both_ways ON v = src UNION ALL SELECT src, dst, w, 0, 1 FROM g JOIN both_ways ON v = dst
) GROUP BY src, dst, w""")
def neighbour_intersection_masks(spark, d):
    return triangles.intersection_masks(part_graph(spark, d))


@query(with_(G, BOTH, DEG, RANK) + """, o AS (SELECT CASE WHEN a.idx < b.idx THEN src ELSE dst END AS src, CASE WHEN a.idx < b.idx THEN dst ELSE src END AS dst
  FROM g JOIN ranked a ON a.id = src JOIN ranked b ON b.id = dst)
SELECT src, dst, w, max(s) = 1 AS in_src, max(t) = 1 AS in_dst FROM (
  SELECT o.src, o.dst, n.dst AS w, 1 AS s, 0 AS t FROM o JOIN o n ON n.src = o.src UNION ALL SELECT o.src, o.dst, n.dst, 0, 1 FROM o JOIN o n ON n.src = o.dst
) GROUP BY src, dst, w""")
def out_neighbour_intersection_masks(spark, d):
    return triangles.out_intersection_masks(part_graph(spark, d))


_A = f"a AS ({_graph_sql('A')})"


@query(with_(G, _A) + "SELECT src, dst FROM g SEMI JOIN a USING (src, dst)")
def membership_semi(spark, d):
    return sets.members(part_graph(spark, d), part_graph(spark, d, "A"), ["src", "dst"])


@query(with_(G, _A) + "SELECT src, dst FROM g ANTI JOIN a USING (src, dst)")
def membership_anti(spark, d):
    return sets.non_members(part_graph(spark, d), part_graph(spark, d, "A"), ["src", "dst"])


@query(with_(G, _A) + "SELECT src, dst, EXISTS (FROM a WHERE a.src = g.src AND a.dst = g.dst) AS is_in FROM g")
def membership_mask(spark, d):
    return sets.membership(part_graph(spark, d), part_graph(spark, d, "A"), ["src", "dst"])


@query(with_(G, _A) + "SELECT src, dst FROM g UNION SELECT src, dst FROM a")
def edge_union(spark, d):
    return sets.union_distinct(part_graph(spark, d), part_graph(spark, d, "A"))


@query(_S + "SELECT src, dst, support FROM s")
def edge_support(spark, d):
    return triangles.support(part_graph(spark, d))


def _noisy_text(spark, d) -> str:
    """The graph as text: each edge in two rows next to each other, the second reversed and with another attribute, plus loops."""
    path = scoped(f"{work_dir(spark)}/edges-{uuid.uuid4().hex}")
    e = part_graph(spark, d)
    turned = (F.col("src") + F.col("dst")) % 3 == 0
    a, b = F.when(turned, F.col("dst")).otherwise(F.col("src")), F.when(turned, F.col("src")).otherwise(F.col("dst"))
    gap, name = F.col("dst") - F.col("src"), F.concat(F.lit("e"), F.col("src"))
    rows = F.array(F.struct(a.alias("a"), b.alias("b"), gap.alias("gap"), name.alias("name")), F.struct(b.alias("a"), a.alias("b"), (gap + 1000).alias("gap"), F.lit("late").alias("name")), F.struct(a.alias("a"), a.alias("b"), gap.alias("gap"), name.alias("name")))
    write_edge_text(e.select(F.inline(rows)), path)
    return path


@query(_S + "SELECT src, dst, (dst - src)::INTEGER AS gap, 'e' || src AS name, support FROM s")
def support_of_text_graph(spark, d):
    """From text with reversed and repeated rows and two attributes of different types to supports."""
    g = Graph.read(spark, _noisy_text(spark, d), attributes={"gap": "int", "name": "string"})
    return triangles.support(g.edges).join(g.edges, ["src", "dst"])


@query(with_(G) + "SELECT CASE WHEN (src + dst) % 3 = 0 THEN dst ELSE src END AS src, CASE WHEN (src + dst) % 3 = 0 THEN src ELSE dst END AS dst, dst - src AS gap FROM g UNION ALL SELECT CASE WHEN (src + dst) % 3 = 0 THEN src ELSE dst END, CASE WHEN (src + dst) % 3 = 0 THEN dst ELSE src END, dst - src + 1000 FROM g")
def directed_text_graph(spark, d):
    """The same text read as a directed graph: both directions stay, each with its own attribute."""
    g = Graph.read(spark, _noisy_text(spark, d), directed=True, attributes={"gap": "bigint", "name": "string"})
    return g.edges.drop("name")


@query(_S + "SELECT support, count(*) AS edges FROM s GROUP BY support")
def support_histogram(spark, d):
    return triangles.support_histogram(part_graph(spark, d))


@query(_S + "SELECT src, dst, least(support, 3) AS support FROM s")
def support_capped(spark, d):
    return triangles.support_capped(part_graph(spark, d), 3)


@query(with_(G, BOTH, DEG, TRI, SUP) + "SELECT id, coalesce(n, 0)::BIGINT AS total FROM deg LEFT JOIN (SELECT src AS id, sum(support) AS n FROM s GROUP BY src) USING (id)")
def segment_sum(spark, d):
    g = part_graph(spark, d)
    values = triangles.support(g).select(F.col("src").alias("id"), "support")
    return ragged.segment_sum(values, Graph(g).vertices, "id", "support")


@query(_S + ", dying AS (SELECT * FROM s WHERE support >= 4), ends AS (SELECT src AS v FROM dying UNION SELECT dst FROM dying) SELECT src, dst FROM g WHERE src IN (FROM ends) OR dst IN (FROM ends)")
def affected_edges_of_frontier(spark, d):
    g = part_graph(spark, d)
    return triangles.affected_edges(g, triangles.support(g).where("support >= 4"))


_AFTER = """g2 AS (SELECT src, dst FROM s WHERE support > 1),
t2 AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM g2 x JOIN g2 y ON x.dst = y.src JOIN g2 z ON z.src = x.src AND z.dst = y.dst)"""


@query(with_(G, TRI, SUP, _AFTER) + """SELECT g2.src, g2.dst, coalesce(n, 0)::INTEGER AS support FROM g2 LEFT JOIN (
  SELECT src, dst, count(*) AS n FROM (SELECT a AS src, b AS dst FROM t2 UNION ALL SELECT a, c FROM t2 UNION ALL SELECT b, c FROM t2) GROUP BY 1, 2
) USING (src, dst)""")
def support_after_removal(spark, d):
    return truss.support_after_removal(part_graph(spark, d), 1)


# truss


@query(_T + "SELECT src, dst, trussness FROM tr")
def trussness(spark, d):
    return truss.trussness(part_graph(spark, d))


@query(_T + "SELECT src, dst, trussness FROM tr")
def trussness_h_index(spark, d):
    return truss.trussness_h_index(part_graph(spark, d))


@query(_T + "SELECT src, dst, trussness FROM tr")
def trussness_peel(spark, d):
    return truss.trussness_peel(part_graph(spark, d))


@query(_T + "SELECT src, dst, trussness FROM tr")
def trussness_frontier(spark, d):
    """Peeling that stores edges and a window of levels, no triangles."""
    return truss.trussness_frontier(part_graph(spark, d), window=2)


@query(_T + "SELECT src, dst, trussness FROM tr")
def trussness_by_parts(spark, d):
    """Parts of propagated labels, none of more than 500 triangles, solved side by side; their boundaries meet."""
    g = materialize(part_graph(spark, d), "graph")
    return parts.trussness_by_parts(g, balance.communities(g).select("id", F.col("label").alias("part")), 500)


@query(_T + "SELECT src, dst, trussness FROM tr")
def trussness_by_ranges(spark, d):
    """Ranges that end where supports split into four parts, peeled in rounds side by side."""
    g = materialize(part_graph(spark, d), "graph")
    ends = balance.split_by_triangles_for_parts(triangles.support(g), 4).collect()
    return truss.trussness_by_ranges(g, [r.level + 2 for r in ends], local_below=0)


@query(_T + """, n AS (SELECT trussness, count(*) AS edges FROM tr WHERE trussness > 2 GROUP BY 1)
SELECT trussness, edges, (sum(edges) OVER w - edges)::BIGINT AS "start", (sum(edges) OVER w)::BIGINT AS "end" FROM n WINDOW w AS (ORDER BY trussness)""")
def truss_layers(spark, d):
    return truss.layers(part_graph(spark, d))


@query(_T + """, n AS (SELECT trussness, count(*) AS edges FROM tr WHERE trussness > 2 GROUP BY 1),
every AS (SELECT unnest(range(3, (SELECT max(trussness) FROM n) + 1))::INTEGER AS trussness),
f AS (SELECT trussness, coalesce(edges, 0)::BIGINT AS edges FROM every LEFT JOIN n USING (trussness))
SELECT trussness, edges, (sum(edges) OVER w - edges)::BIGINT AS "start", (sum(edges) OVER w)::BIGINT AS "end" FROM f WINDOW w AS (ORDER BY trussness)""")
def truss_layers_with_empty(spark, d):
    return truss.layers(part_graph(spark, d), with_empty=True)


@query(_T + "SELECT trussness, count(*) AS edges FROM tr GROUP BY trussness")
def truss_histogram(spark, d):
    return truss.trussness(part_graph(spark, d)).groupBy("trussness").agg(F.count("*").alias("edges"))


@query(_T + "SELECT max(trussness) AS kmax FROM tr")
def kmax(spark, d):
    return truss.k_max(part_graph(spark, d))


@query(_T + "SELECT src, dst, trussness FROM tr WHERE trussness <= 3")
def trussness_below(spark, d):
    return truss.trussness_between(part_graph(spark, d), high=3)


@query(_T + "SELECT src, dst, trussness FROM tr WHERE trussness >= 4")
def trussness_from(spark, d):
    return truss.trussness_between(part_graph(spark, d), low=4)


@query(_T + "SELECT src, dst, trussness FROM tr WHERE trussness BETWEEN 3 AND 5")
def trussness_range(spark, d):
    return truss.trussness_between(part_graph(spark, d), 3, 5)


def _k_truss(k: int, name: str, **options) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return truss.k_truss(part_graph(spark, d), k, **options)

    run.__name__ = name
    query(_T + f"SELECT src, dst FROM tr WHERE trussness >= {k}")(run)


for _k in (3, 4, 5):
    _k_truss(_k, f"ktruss_{_k}")
_k_truss(5, "ktruss_5_rounds", local_below=0)


# splitting work

_LEVELS = """lv AS (SELECT support + 1 AS l, sum(n) OVER w AS below, sum(support * n) OVER w AS mass, sum(n) OVER () AS edges, sum(support * n) OVER () AS total
FROM (SELECT support, count(*) AS n FROM s GROUP BY support) WINDOW w AS (ORDER BY support))"""
_LEVELS_NONZERO = _LEVELS.replace("FROM s GROUP", "FROM s WHERE support > 0 GROUP")


@query(with_(G, TRI, SUP, _LEVELS) + "SELECT min(l)::BIGINT AS level FROM lv WHERE below >= 0.5 * edges")
def level_split_by_edges(spark, d):
    return balance.split_by_edges(triangles.support(part_graph(spark, d)))


@query(with_(G, TRI, SUP, _LEVELS_NONZERO) + "SELECT min(l)::BIGINT AS level FROM lv WHERE below >= 0.5 * edges")
def level_split_nonzero(spark, d):
    return balance.split_by_nonzero_edges(triangles.support(part_graph(spark, d)))


@query(with_(G, TRI, SUP, _LEVELS) + "SELECT min(l)::BIGINT AS level FROM lv WHERE mass >= 0.5 * total")
def level_split_by_triangles(spark, d):
    return balance.split_by_triangles(triangles.support(part_graph(spark, d)))


@query(with_(G, TRI, SUP, _LEVELS) + "SELECT min(l)::BIGINT AS level FROM lv WHERE edges = below OR (1 + 0.3 * edges / (edges - below)) * mass >= total")
def level_split_cost_model(spark, d):
    return balance.split_by_cost(triangles.support(part_graph(spark, d)))


@query(with_(G, TRI, SUP, _LEVELS) + "SELECT min(l)::BIGINT AS level FROM lv WHERE edges = below OR (1 + below / (edges - below)) * mass >= total")
def level_split_relative_cost(spark, d):
    return balance.split_by_relative_cost(triangles.support(part_graph(spark, d)))


@query(with_(G, TRI, SUP, _LEVELS, "c AS (SELECT max(edges)::BIGINT // 3 * 2 AS n FROM lv)", "ends AS (SELECT (SELECT min(l) FROM lv WHERE below >= n) AS a, (SELECT min(l) FROM lv, c WHERE below >= n + n // 3) AS b, (SELECT min(l) FROM lv, c WHERE below >= least(n + n // 3 + (n + n // 3) // 3, edges)) AS e FROM c)", "x AS (SELECT greatest(a, 2) AS a, b, e FROM ends)", "y AS (SELECT a, CASE WHEN b > a THEN b ELSE a + 2 END AS b, e FROM x)") + "SELECT unnest([0, 1, 2])::BIGINT AS part, unnest([a, b, CASE WHEN e > b THEN e ELSE b + 2 END])::BIGINT AS level FROM y")
def level_splits_for_four_parts(spark, d):
    return balance.split_for_parts(triangles.support(part_graph(spark, d)), 4)


_BUMPED = """x AS (SELECT greatest(a, 2) AS a, b, e FROM ends), y AS (SELECT a, CASE WHEN b > a THEN b ELSE a + 2 END AS b, e FROM x)
SELECT unnest([0, 1, 2])::BIGINT AS part, unnest([a, b, CASE WHEN e > b THEN e ELSE b + 2 END])::BIGINT AS level FROM y"""


@query(
    with_(G, TRI, SUP, _LEVELS_NONZERO).rstrip()
    + """, c AS (SELECT max(edges)::BIGINT AS m, max(edges)::BIGINT // 3 * 2 AS n FROM lv),
p AS (SELECT min(l) AS a, min(below)::BIGINT AS t FROM lv, c WHERE below >= n),
q AS (SELECT min(l) AS b, min(below)::BIGINT AS u FROM lv, c, p WHERE below >= least(t + n // 3, m)),
ends AS (SELECT a, b, (SELECT min(l) FROM lv WHERE below >= least(greatest(t, u) + n // 3 // 3, m)) AS e FROM c, p, q), """
    + _BUMPED
)
def level_splits_nonzero_for_four_parts(spark, d):
    return balance.split_nonzero_for_parts(triangles.support(part_graph(spark, d)), 4)


@query(
    with_(G, TRI, SUP, _LEVELS).rstrip()
    + """, c AS (SELECT max(total)::BIGINT AS m, max(total)::BIGINT // 4 AS n FROM lv),
ends AS (SELECT (SELECT min(l) FROM lv WHERE mass >= n) AS a, (SELECT min(l) FROM lv WHERE mass >= least(2 * n, m)) AS b, (SELECT min(l) FROM lv WHERE mass >= least(4 * n, m)) AS e FROM c), """
    + _BUMPED
)
def level_splits_by_triangles_for_four_parts(spark, d):
    return balance.split_by_triangles_for_parts(triangles.support(part_graph(spark, d)), 4)


@query(_S + "SELECT l, count(*) FILTER (support < l) AS edges FROM s, (SELECT unnest([1, 2, 4, 8]) AS l) GROUP BY l")
def edges_below_support(spark, d):
    s = triangles.support(part_graph(spark, d))
    counts = s.agg(*(F.count_if(F.col("support") < level).alias(str(level)) for level in (1, 2, 4, 8)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(level).alias("l"), F.col(str(level)).alias("edges")) for level in (1, 2, 4, 8)))))


@query(_D + "SELECT id, degree, (row_number() OVER (ORDER BY degree DESC, id) - 1) % 4 AS part FROM deg")
def round_robin_partition(spark, d):
    ranked = canonical.dense_index(canonical.degrees(part_graph(spark, d)), F.desc("degree"), F.col("id"))
    return balance.round_robin(ranked, 4).select("id", "degree", "part")


@query("""WITH RECURSIVE it AS (
  SELECT c_nationkey AS nation, count(*) AS customers, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS i FROM customer GROUP BY 1
), r AS (
  SELECT 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS loads, (SELECT min(nation) FROM it) AS nation, NULL::BIGINT AS customers, NULL::BIGINT AS part
  UNION ALL
  SELECT it.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + it.customers ELSE x END),
         it.nation, it.customers, list_position(loads, list_min(loads)) - 1
  FROM r JOIN it ON it.i = r.i + 1
)
SELECT nation, customers, part FROM r WHERE i > 0""")
def lpt_partition(spark, d):
    loads = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return balance.lpt_partition(loads, "nation", "customers", 4)


@query(_O + "SELECT edge_id, (dst_idx // ((SELECT count(*) FROM ranked) // 4 + 1))::BIGINT AS tile FROM o")
def tile_of_edge(spark, d):
    vertices, edges = canonical.oriented_index(part_graph(spark, d))
    return edges.select("edge_id", ragged.uniform_tile(F.col("dst_idx"), vertices.count(), 4).alias("tile"))


@query(_O + "SELECT edge_id, CASE WHEN dst_idx <= floor((SELECT count(*) FROM ranked) / sqrt(2)) THEN 0 ELSE 1 END::BIGINT AS tile FROM o")
def sqrt_tile_of_edge(spark, d):
    vertices, edges = canonical.oriented_index(part_graph(spark, d))
    return edges.select("edge_id", ragged.sqrt_tile(F.col("dst_idx"), vertices.count()).alias("tile"))


@query(_R + "SELECT idx, degree, ((sum(degree) OVER (ORDER BY idx) - degree) // 1000)::BIGINT AS batch FROM ranked")
def equal_cost_batches(spark, d):
    return balance.equal_cost_batches(canonical.rank_by_degree(part_graph(spark, d)), "idx", "degree", 1000)


def _propagation_sql(rounds: int, parts: int) -> str:
    steps = ["l0 AS (SELECT id, id AS label FROM deg)"]
    for i in range(rounds):
        heard = f"SELECT v AS id, label FROM both_ways JOIN l{i} ON id = w UNION ALL SELECT id, label FROM l{i}"
        steps.append(f"""l{i + 1} AS MATERIALIZED (SELECT id, label FROM (
  SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS k FROM ({heard}) GROUP BY id, label) WHERE k = 1)""")
    dealt = f"""dealt AS (SELECT label, CASE WHEN t < {parts} THEN t ELSE {2 * parts - 1} - t END AS part FROM (
  SELECT label, (row_number() OVER (ORDER BY count(*) DESC, label) - 1) % {2 * parts} AS t FROM l{rounds} GROUP BY label))"""
    return with_(G, BOTH, DEG, *steps, dealt) + f"SELECT DISTINCT src, dst, part FROM g JOIN l{rounds} ON id = src OR id = dst JOIN dealt USING (label)"


@query(_propagation_sql(5, 4))
def community_partition(spark, d):
    return balance.community_partition(part_graph(spark, d), 4)


_MOVES = """total AS (SELECT count(*)::DOUBLE AS total FROM both_ways),
st AS (SELECT d.id, degree AS k, (SELECT least(d.id, min(w)) FROM both_ways WHERE v = d.id) AS label FROM deg d),
tot AS (SELECT label, sum(k) AS tot FROM st GROUP BY label),
li AS (SELECT v AS id, label AS "to", count(*) AS w FROM both_ways JOIN st ON st.id = w GROUP BY 1, 2),
va AS (SELECT li.id, st.label, "to", total * w - k::DOUBLE * CASE WHEN "to" = st.label THEN o.tot - k ELSE n.tot END AS value, -k::DOUBLE * (o.tot - k) AS alone
  FROM li JOIN st ON st.id = li.id JOIN tot o ON o.label = st.label JOIN tot n ON n.label = "to", total),
be AS (SELECT id, label, alone, max(value) FILTER ("to" = label) AS stay, max(value) FILTER ("to" <> label) AS best FROM va GROUP BY ALL)"""


@query(with_(G, BOTH, DEG, _MOVES) + """SELECT be.id, be.label, min(va."to") AS "to", best - coalesce(stay, be.alone) AS gain FROM be JOIN va ON va.id = be.id AND va."to" <> be.label AND value = best
WHERE best > coalesce(stay, be.alone) GROUP BY ALL""")
def modularity_moves(spark, d):
    """One round's best moves, from communities named by the least of a vertex and its neighbours."""
    g = materialize(part_graph(spark, d), "graph")
    near = clustering.weighted(g)
    state = near.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("label"), F.sum("w").alias("k"))
    return clustering.best_moves(near, materialize(state, "state"))


@query()
def modularity_partition(spark, d):
    """Four parts of linked communities by modularity, each edge in the parts of both its ends."""
    g = materialize(part_graph(spark, d), "graph")
    return clustering.with_halo(g, clustering.vertex_parts(g, 4))
