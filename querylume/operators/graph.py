"""Schema graphs as node and edge tables, and what walks on them.

Edges are undirected and simple: one row for each pair of nodes, the smaller first. Where several catalogue rows make
one edge, the last row's relation holds in the column graph, the first row's columns in the table graph. Among shortest
paths the lexicographically smallest is taken. All joins are keyed by database, so databases never meet.

Paths are asked for, not listed. A schema is searched once: every node gets its neighbours and its labels, a few hubs with the
hops to them, such that any two connected nodes have a hub in common that lies on a shortest path of theirs. Searches are cut
where earlier hubs already tell the distance, so labels stay short. Who asks for paths meets the labels by database, and
what comes out is as long as what was asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

OWN, FOREIGN = "belongs_to_pk", "foreign_key"
_PAIR = ["db_id", "u", "v"]


def _node(table: str | Column, column: str | Column) -> Column:
    return F.concat_ws(".", "db_id", F.trim(table), F.trim(column))


def column_nodes(catalog: DataFrame) -> DataFrame:
    """db_id, node_id, ord, table, column, type, is_pk; without wildcards."""
    real = catalog.where("column <> '*'")
    return real.select("db_id", _node("table", "column").alias("node_id"), F.col("col_idx").alias("ord"), F.trim("table").alias("table"), F.trim("column").alias("column"), "type", "is_pk")


def column_edges(catalog: DataFrame) -> DataFrame:
    """db_id, u, v, relation: every column with its table's key (the last primary key column), and foreign keys whose
    target exists."""
    nodes = column_nodes(catalog)
    anchors = nodes.where("is_pk").groupBy("db_id", "table").agg(F.max_by("node_id", "ord").alias("to"))
    own = nodes.join(anchors, ["db_id", "table"]).where("node_id <> to").select("db_id", "node_id", "to", F.lit(OWN).alias("relation"), "ord", F.lit(0).alias("kind"))
    fk = catalog.where("column <> '*' and fk_table is not null").select("db_id", _node("table", "column").alias("node_id"), _node("fk_table", "fk_column").alias("to"), F.lit(FOREIGN).alias("relation"), F.col("col_idx").alias("ord"), F.lit(1).alias("kind"))
    fk = fk.join(nodes.select("db_id", F.col("node_id").alias("to")).distinct(), ["db_id", "to"], "left_semi").select(own.columns)
    both = own.union(fk).select("db_id", F.least("node_id", "to").alias("u"), F.greatest("node_id", "to").alias("v"), "relation", "ord", "kind")
    return both.groupBy(*_PAIR).agg(F.max_by("relation", F.struct("ord", "kind")).alias("relation"))


def table_nodes(catalog: DataFrame) -> DataFrame:
    """db_id, node_id, table, columns (array of name, type, is_pk, in catalogue order)."""
    real = catalog.where("column <> '*'")
    item = F.struct(F.col("col_idx"), F.col("column").alias("name"), "type", "is_pk")
    out = real.groupBy("db_id", "table").agg(F.array_sort(F.collect_list(item)).alias("_c"))
    strip = lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["is_pk"].alias("is_pk"))
    return out.select("db_id", F.concat_ws(".", "db_id", F.trim("table")).alias("node_id"), "table", F.transform("_c", strip).alias("columns"))


def table_edges(catalog: DataFrame) -> DataFrame:
    """db_id, u, v, from_table, from_col, to_col: of a pair's foreign keys, in either direction, the first."""
    fk = catalog.where("column <> '*' and fk_table is not null and not contains(fk_table, '.') and not contains(fk_column, '.')")
    known = catalog.where("column <> '*'").select("db_id", F.col("table").alias("fk_table")).distinct()
    fk = fk.join(known, ["db_id", "fk_table"], "left_semi")
    a, b = F.concat_ws(".", "db_id", F.trim("table")), F.concat_ws(".", "db_id", F.trim("fk_table"))
    pairs = fk.select("db_id", F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "col_idx", "table", "column", "fk_column")
    first = pairs.groupBy(*_PAIR).agg(F.min(F.struct("col_idx", "table", "column", "fk_column")).alias("f"))
    return first.select(*_PAIR, F.col("f.table").alias("from_table"), F.col("f.column").alias("from_col"), F.col("f.fk_column").alias("to_col"))


def both_ways(edges: DataFrame) -> DataFrame:
    """db_id, src, dst and the edge's other columns; a self-loop once."""
    rest = [c for c in edges.columns if c not in _PAIR]
    there = edges.select("db_id", F.col("u").alias("src"), F.col("v").alias("dst"), *rest)
    return there.union(edges.where("u <> v").select("db_id", F.col("v").alias("src"), F.col("u").alias("dst"), *rest))


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Breadth-first search from every node of a database's graph, a row a database; results go out node by node."""
    for pdf in batches:
        for db, steps in zip(pdf["db_id"], pdf["steps"]):
            near: dict[str, list[str]] = {}
            for s in steps:
                near.setdefault(s["src"], []).append(s["dst"])
            for src in near:
                best, frontier, rows = {src: [src]}, [src], []
                while frontier:
                    found: dict[str, list[str]] = {}
                    for node in frontier:
                        for to in near[node]:
                            if to not in best and (to not in found or best[node] < found[to]):
                                found[to] = best[node]
                    frontier = list(found)
                    for to, path in found.items():
                        best[to] = [*path, to]
                        rows.append((db, src, to, len(path), best[to]))
                if rows:
                    yield pd.DataFrame(rows, columns=["db_id", "src", "dst", "hops", "path"])


def all_shortest_paths(edges: DataFrame) -> DataFrame:
    """db_id, src, dst, hops, path for all pairs of different nodes that are connected, where all are wanted. A database's graph is one row, as large as its schema, and is searched in one
    task; a node's smallest shortest path extends the smallest to one of its predecessors."""
    steps = both_ways(edges).where("src <> dst").groupBy("db_id").agg(F.collect_set(F.struct("src", "dst")).alias("steps"))
    return steps.mapInPandas(_search, "db_id string, src string, dst string, hops int, path array<string>")


def path_relations(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """db_id, src, dst, step, from, to, relation for each edge along each path."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("from"), F.element_at("path", i + 1).alias("to")))
    each = paths.select("db_id", "src", "dst", F.posexplode(steps).alias("step", "_s")).select("db_id", "src", "dst", "step", "_s.from", "_s.to")
    return each.join(both_ways(edges).select("db_id", F.col("src").alias("from"), F.col("dst").alias("to"), "relation"), ["db_id", "from", "to"], "left")


def labels_of(near: dict[str, list[str]]) -> dict[str, dict[str, int]]:
    """Each node's hubs and the hops to them. Nodes with many neighbours become hubs first."""
    labels: dict[str, dict[str, int]] = {v: {} for v in near}
    for hub in sorted(near, key=lambda v: (-len(near[v]), v)):
        own, seen, frontier, hops = labels[hub], {hub}, [hub], 0
        while frontier:
            found = []
            for v in frontier:
                at = labels[v]
                if any(h in own and own[h] + d <= hops for h, d in at.items()):
                    continue  # an earlier hub tells the distance, here and beyond
                at[hub] = hops
                for w in near[v]:
                    if w not in seen:
                        seen.add(w)
                        found.append(w)
            frontier, hops = found, hops + 1
    return labels


class Routes:
    """A schema's neighbours and labels, and the shortest paths that are asked for."""

    def __init__(self, near: dict[str, list[str]], labels: dict[str, dict[str, int]]):
        self.near, self.labels = {v: sorted(ws) for v, ws in near.items()}, labels

    def hops(self, a: str, b: str) -> int | None:
        """None where no path leads from one to the other."""
        left, right = self.labels.get(a, {}), self.labels.get(b, {})
        if len(left) > len(right):
            left, right = right, left
        return min((d + right[h] for h, d in left.items() if h in right), default=None)

    def path(self, a: str, b: str) -> list[str] | None:
        """Of the shortest paths the smallest by its nodes' names: each step goes to the first neighbour that is nearer."""
        left = self.hops(a, b)
        if left is None:
            return None
        out = [a]
        while left:
            left -= 1
            out.append(next(w for w in self.near[out[-1]] if self.hops(w, b) == left))
        return out


def _routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for db, steps in zip(pdf["db_id"], pdf["steps"]):
            near: dict[str, list[str]] = {}
            for s in steps:
                near.setdefault(s["src"], []).append(s["dst"])
            labels = labels_of(near)
            yield pd.DataFrame([(db, v, near[v], list(at), list(at.values())) for v, at in labels.items()], columns=["db_id", "node", "near", "hubs", "hops"])


def routes(edges: DataFrame) -> DataFrame:
    """db_id, node, near (its neighbours), hubs, hops (to them), for every node that has a neighbour. A database's graph is
    one row, as large as its schema, and is searched in one task."""
    steps = both_ways(edges).where("src <> dst").groupBy("db_id").agg(F.collect_set(F.struct("src", "dst")).alias("steps"))
    return steps.mapInPandas(_routes, "db_id string, node string, near array<string>, hubs array<string>, hops array<int>")


#: Rows that a group has on average when they meet a schema's routes.
GROUP = 2000


def _by_routes(rows: DataFrame, known: DataFrame, each: Callable[[list[dict], Routes], list[dict]], schema: str) -> DataFrame:
    """``each`` of a group's rows (db_id, _key, ...) with the routes of their database. The rows of a database are dealt into
    several groups if they are many, and each gets a copy of the routes."""
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    parts = rows.groupBy("db_id").agg(F.ceil(F.count("*") / GROUP).alias("_parts"))
    dealt = rows.join(parts, "db_id").withColumn("_part", F.pmod(F.xxhash64("_key"), "_parts")).drop("_parts", "_key")
    copied = known.join(parts, "db_id").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts").withColumnRenamed("db_id", "_db")
    copied = copied.toDF(*copied.columns)

    def run(some: pa.Table, nodes: pa.Table) -> pa.Table:
        if not some.num_rows:
            return kinds.empty_table()
        found = nodes.to_pylist()
        own = Routes({r["node"]: r["near"] for r in found}, {r["node"]: dict(zip(r["hubs"], r["hops"])) for r in found})
        return pa.Table.from_pylist(each(some.to_pylist(), own), schema=kinds)

    return dealt.groupBy("db_id", "_part").cogroup(copied.groupBy("_db", "_copy")).applyInArrow(run, schema)


def paths_between(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(db_id, src, dst) to db_id, src, dst, hops, path, for different nodes that are connected; each pair once. ``known``
    are the database's routes."""

    def each(rows: list[dict], own: Routes) -> list[dict]:
        found = ((r, own.path(r["src"], r["dst"])) for r in rows)
        return [r | {"hops": len(path) - 1, "path": path} for r, path in found if path and len(path) > 1]

    asked = pairs.select("db_id", "src", "dst").distinct().withColumn("_key", F.struct("src", "dst"))
    return _by_routes(asked, known, each, "db_id string, src string, dst string, hops int, path array<string>")


def expand_hits(hits: DataFrame, known: DataFrame) -> DataFrame:
    """(q_id, db_id, node_id, ord) to all nodes on shortest paths between a question's hits, hits included: q_id, db_id,
    node_id, is_hit. A path leads from the hit with the smaller ord. A question is one row with its hits, which are no more
    than its schema's nodes; its pairs live in the task alone. ``known`` are the databases' routes."""
    kind = hits.schema["q_id"].dataType.simpleString()
    asked = hits.groupBy("q_id", "db_id").agg(F.array_sort(F.collect_set(F.struct("ord", "node_id"))).alias("found")).withColumn("_key", F.col("q_id"))

    def each(rows: list[dict], own: Routes) -> list[dict]:
        paths: dict[tuple[str, str], list[str]] = {}
        out = []
        for r in rows:
            nodes = list(dict.fromkeys(f["node_id"] for f in r["found"]))
            there = set(nodes)
            for i, a in enumerate(nodes):
                for b in nodes[i + 1 :]:
                    if (a, b) not in paths:
                        paths[a, b] = own.path(a, b) or []
                    there.update(paths[a, b])
            out += [{"q_id": r["q_id"], "db_id": r["db_id"], "node_id": v, "is_hit": v in set(nodes)} for v in sorted(there)]
            if len(paths) > 1_000_000:
                paths.clear()
        return out

    return _by_routes(asked, known, each, f"q_id {kind}, db_id string, node_id string, is_hit boolean")


def hits_by_name(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q_id, db_id, column) to all nodes of the database whose column has that very name, in any table."""
    return nodes.join(names.select("q_id", "db_id", "column").distinct(), ["db_id", "column"]).select("q_id", "db_id", "node_id", "ord")


def prune(expanded: DataFrame, nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Of expanded nodes those that are hits by name (in any case), primary keys, or ends of foreign keys."""
    ends = both_ways(edges.where(F.col("relation") == FOREIGN)).select("db_id", F.col("src").alias("node_id")).distinct().withColumn("has_fk", F.lit(True))
    wanted = names.select("q_id", "db_id", F.lower("column").alias("_n")).distinct().withColumn("named", F.lit(True))
    out = expanded.join(nodes.select("db_id", "node_id", "is_pk", F.lower("column").alias("_n")), ["db_id", "node_id"])
    out = out.join(ends, ["db_id", "node_id"], "left").join(wanted, ["q_id", "db_id", "_n"], "left")
    return out.where("named or is_pk or has_fk").select("q_id", "db_id", "node_id")


def keyword_nodes(nodes: DataFrame, keyword: str, db_id: str | None = None) -> DataFrame:
    """Columns whose name contains the keyword, in any case; of one database, also in any case, or of all."""
    found = nodes.where(F.contains(F.lower("column"), F.lit(keyword.lower())))
    return found if db_id is None else found.where(F.lower("db_id") == db_id.lower())


def path_between_keywords(nodes: DataFrame, known: DataFrame, first: str, second: str) -> DataFrame:
    """The shortest path between columns that match two keywords, per database: db_id, src, dst, hops, path."""
    a = keyword_nodes(nodes, first).select("db_id", F.col("node_id").alias("src"), F.col("ord").alias("o1"))
    b = keyword_nodes(nodes, second).select("db_id", F.col("node_id").alias("dst"), F.col("ord").alias("o2"))
    pairs = a.join(b, "db_id")
    same = pairs.where("src = dst").select("db_id", "src", "dst", F.lit(0).alias("hops"), F.array("src").alias("path"), "o1", "o2")
    met = pairs.join(paths_between(pairs, known), ["db_id", "src", "dst"]).select("db_id", "src", "dst", "hops", "path", "o1", "o2").union(same)
    best = met.groupBy("db_id").agg(F.min_by(F.struct("src", "dst", "hops", "path"), F.struct("hops", "o1", "o2")).alias("b"))
    return best.select("db_id", "b.*")


def anchor_star(nodes: DataFrame, known: DataFrame, db_id: str, keywords: list[str]) -> DataFrame:
    """First hit of each keyword; the nodes on paths from the first keyword's to every other's: db_id, node_id."""
    spark = nodes.sparkSession
    own = nodes.where(F.lower("db_id") == db_id.lower())
    asked = spark.createDataFrame([(i, k.lower()) for i, k in enumerate(keywords)], "pos int, keyword string")
    hits = own.join(F.broadcast(asked), F.contains(F.lower("column"), F.col("keyword")))  # a few keywords
    hits = hits.groupBy("db_id", "pos").agg(F.min_by("node_id", "ord").alias("node_id"))
    anchor = hits.groupBy("db_id").agg(F.min_by("node_id", "pos").alias("src"))
    ends = hits.select("db_id", F.col("node_id").alias("dst")).join(anchor, "db_id")
    way = paths_between(ends, known).select("db_id", F.explode("path").alias("node_id"))
    return hits.select("db_id", "node_id").union(way).distinct()


def ego(edges: DataFrame, centre: Column, radius: int) -> DataFrame:
    """Edges among the nodes within ``radius`` (1 or 2) of the centre: centre, db_id, u, v, relation. ``centre`` is a
    condition on (db_id, src)."""
    steps = both_ways(edges).select("db_id", "src", "dst")
    near = steps.where(centre).select(F.col("src").alias("centre"), "db_id", F.col("dst").alias("node_id"))
    near = near.union(near.select("centre", "db_id", F.col("centre").alias("node_id"))).distinct()
    for _ in range(radius - 1):
        more = near.join(steps.withColumnRenamed("src", "node_id"), ["db_id", "node_id"]).select("centre", "db_id", F.col("dst").alias("node_id"))
        near = near.union(more).distinct()
    u = near.select("centre", "db_id", F.col("node_id").alias("u"))
    v = near.select("centre", "db_id", F.col("node_id").alias("v"))
    return edges.join(u, ["db_id", "u"]).join(v, ["db_id", "v", "centre"]).select("centre", "db_id", "u", "v", "relation")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and edges by relation of each database."""
    n = nodes.groupBy("db_id").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("db_id").agg(F.count("*").alias("n_edges"), F.count_if(F.col("relation") == OWN).alias("n_own"), F.count_if(F.col("relation") == FOREIGN).alias("n_fk"))
    return n.join(e, "db_id", "left").select("db_id", "n_nodes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_edges", "n_own", "n_fk")])
