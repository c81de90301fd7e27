"""Graphs as two DataFrames, and access to vertices, edges, neighbours, attributes and subgraphs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cohesia.operators import canonical
from cohesia.runtime import materialize
from cohesia.sources.edges import edges_from_text


@dataclass
class Graph:
    """``edges(src, dst, ...)`` and ``vertices(id, ...)``. Undirected graphs hold each edge once, with src < dst."""

    edges: DataFrame
    vertices: DataFrame = field(default=None)
    directed: bool = False

    def __post_init__(self):
        if self.vertices is None:
            self.vertices = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = False, vertices: DataFrame | None = None, order: Sequence[str] = ()) -> Graph:
        """Clean rows into a graph: no loops, no repeats, and no reversed repeats if undirected.

        Columns besides src and dst are attributes; of rows that repeat a pair the first by ``order``, then by the attributes,
        gives them. An undirected edge has src < dst whatever its row had, so all triangle operators may rely on it.
        """
        attributes = [c for c in edges.columns if c not in ("src", "dst", *order)]
        if attributes:
            clean = canonical.first_rows(edges, [*order, *attributes], directed).drop(*order)
            clean = clean if directed else canonical.ascending(clean)
        else:
            clean = canonical.drop_loops(edges).select("src", "dst").distinct() if directed else canonical.canonicalise(edges)
        return cls(clean, vertices, directed)

    @classmethod
    def read(cls, spark: SparkSession, path: str, directed: bool = False, attributes: Sequence[str] | Mapping[str, str] = ()) -> Graph:
        """From text. With attributes, names or names with their types, the first row of a repeated pair gives the values."""
        rows = edges_from_text(spark, path, attributes)
        return cls.from_edges(rows, directed, order=("file", "line")) if attributes else cls.from_edges(rows.select("src", "dst"), directed)

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        """Stored edges: an undirected one counts once."""
        return self.edges.count()

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Graph:
        self.edges.persist(level)
        self.vertices.persist(level)
        return self

    def unpersist(self) -> Graph:
        self.edges.unpersist()
        self.vertices.unpersist()
        return self

    # degrees

    def _degree(self, ends: Column) -> DataFrame:
        """Counts meet the vertices in a union, so vertices without edges have zero and nothing is joined."""
        ones = self.edges.select(F.explode(ends).alias("id"), F.lit(1).alias("n"))
        every = self.vertices.select("id", F.lit(0).alias("n"))
        return ones.unionByName(every).groupBy("id").agg(F.sum("n").alias("degree"))

    def out_degree(self) -> DataFrame:
        return self._degree(F.array("src"))

    def in_degree(self) -> DataFrame:
        return self._degree(F.array("dst"))

    def all_degree(self) -> DataFrame:
        return self._degree(F.array("src", "dst"))

    # neighbours and edges of a vertex set ``vs(id)``

    def out_edges(self, vs: DataFrame) -> DataFrame:
        return self.edges.join(_renamed(vs, "src"), "src", "left_semi").select(*self.edges.columns)

    def in_edges(self, vs: DataFrame) -> DataFrame:
        return self.edges.join(_renamed(vs, "dst"), "dst", "left_semi").select(*self.edges.columns)

    def all_edges(self, vs: DataFrame) -> DataFrame:
        """Edges with an end in ``vs``, once."""
        return self.out_edges(vs).unionByName(self.in_edges(vs)).distinct()

    def out_neighbours(self, vs: DataFrame) -> DataFrame:
        return self.out_edges(vs).select(F.col("src").alias("id"), F.col("dst").alias("nbr"))

    def in_neighbours(self, vs: DataFrame) -> DataFrame:
        return self.in_edges(vs).select(F.col("dst").alias("id"), F.col("src").alias("nbr"))

    def all_neighbours(self, vs: DataFrame) -> DataFrame:
        return self.out_neighbours(vs).unionByName(self.in_neighbours(vs)).distinct()

    def adjacency(self, direction: str = "all") -> DataFrame:
        """``(id, nbrs)`` with sorted neighbour lists; vertices without neighbours have empty ones."""
        out = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"))
        back = self.edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"))
        pairs = {"out": out, "in": back, "all": out.unionByName(back)}[direction]
        every = self.vertices.select("id", F.lit(None).cast("long").alias("nbr"))
        return pairs.unionByName(every).groupBy("id").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"))

    # subgraphs

    def induced_subgraph(self, vs: DataFrame) -> Graph:
        """The vertices of ``vs`` and the edges between them, with all columns."""
        inner = self.edges.join(_renamed(vs, "src"), "src", "left_semi").join(_renamed(vs, "dst"), "dst", "left_semi")
        return Graph(inner.select(*self.edges.columns), self.vertices.join(vs.select("id"), "id", "left_semi"), self.directed)

    def row_subgraph(self, vs: DataFrame) -> DataFrame:
        """The rows of ``vs``: their out-edges, wherever these lead."""
        return self.out_edges(vs)

    # attributes

    def select_vertices(self, attribute: str, condition: Callable[[Column], Column]) -> DataFrame:
        return self.vertices.where(condition(F.col(attribute)))

    def select_edges(self, attribute: str, condition: Callable[[Column], Column]) -> DataFrame:
        return self.edges.where(condition(F.col(attribute)))

    def vertex_attribute(self, vs: DataFrame, attribute: str) -> DataFrame:
        return self.vertices.join(vs.select("id"), "id", "left_semi").select("id", attribute)

    def edge_attribute(self, pairs: DataFrame, attribute: str) -> DataFrame:
        return self.edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_semi").select("src", "dst", attribute)

    def set_vertex_attribute(self, attribute: str, value: Column, mask: Column) -> Graph:
        """The graph with ``attribute`` set to ``value`` where ``mask`` holds; a null mask holds not."""
        return Graph(self.edges, self.vertices.withColumn(attribute, _masked(self.vertices, attribute, value, mask)), self.directed)

    def set_edge_attribute(self, attribute: str, value: Column, mask: Column) -> Graph:
        return Graph(self.edges.withColumn(attribute, _masked(self.edges, attribute, value, mask)), self.vertices, self.directed)

    # dense and compressed forms

    def csr(self, symmetric: bool = False, by: str = "degree") -> tuple[DataFrame, DataFrame]:
        """``offsets(idx, id, start, end)`` and ``columns(place, idx, nbr)`` over dense vertex numbers.

        Numbers follow (degree, id) or the id. Edges lead from the lower number, or both ways if ``symmetric``.
        """
        if by == "degree":
            ranked = canonical.rank_by_degree(self.edges).select("id", "idx")
        else:
            ranked = canonical.dense_index(self.vertices.select("id"), "id")
        a, b = (ranked.select(F.col("id").alias(x), F.col("idx").alias(y)) for x, y in (("src", "i"), ("dst", "j")))
        both = self.edges.select("src", "dst").join(a, "src").join(b, "dst")
        rows = both.select(F.least("i", "j").alias("idx"), F.greatest("i", "j").alias("nbr"))
        if symmetric:
            rows = rows.unionByName(rows.select(F.col("nbr").alias("idx"), F.col("idx").alias("nbr")))
        columns = canonical.dense_index(rows, "idx", "nbr", name="place")
        n = columns.groupBy("idx").agg(F.count("*").alias("n"))
        sizes = ranked.join(n, "idx", "left").select("idx", "id", F.coalesce("n", F.lit(0)).alias("n"))
        return prefix_sums(sizes, "idx", "n"), columns.select("place", "idx", "nbr")


#: Rows that one window of :func:`prefix_sums` takes, and the most block sums that are summed up in one task and broadcast.
SUM_BLOCK = 65536


def prefix_sums(rows: DataFrame, place: str, size: str) -> DataFrame:
    """``rows`` with ``start`` and ``end`` in place of ``size``: running sums in the order of the dense number ``place``.

    Numbers are cut into blocks; sums within blocks and sums over blocks replace one window over all. More than
    ``SUM_BLOCK`` blocks are summed up in the same way, and joined by shuffle.
    """
    blocked = rows.withColumn("_b", F.floor(F.col(place) / SUM_BLOCK))
    inside = F.sum(size).over(W.partitionBy("_b").orderBy(place))
    sums = materialize(blocked.groupBy("_b").agg(F.sum(size).alias("_n")), "sums")
    if sums.count() <= SUM_BLOCK:
        before = F.broadcast(sums.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before")))
    else:
        upper = prefix_sums(sums.select(F.col("_b").alias("block"), "_n"), "block", "_n")
        before = upper.select(F.col("block").alias("_b"), F.col("start").alias("_before"))
    joined = blocked.withColumn("_in", inside).join(before, "_b")
    end = F.col("_before") + F.col("_in")
    return joined.select(*(c for c in rows.columns if c != size), (end - F.col(size)).alias("start"), end.alias("end"))


def _renamed(vs: DataFrame, name: str) -> DataFrame:
    return vs.select(F.col("id").alias(name))


def _masked(df: DataFrame, attribute: str, value: Column, mask: Column) -> Column:
    old = F.col(attribute) if attribute in df.columns else F.lit(None)
    return F.when(mask, value).otherwise(old)
