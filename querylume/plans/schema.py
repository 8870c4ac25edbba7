"""Catalogue and graph queries over the catalogue that is found in the tables: their columns, and keys from their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylume.operators import graph
from querylume.sources import catalog, discovery
from querylume.sources.tables import CORPUS, STAR, table

QUERIES, ORACLE = {}, {}

_NODES = "nodes AS (SELECT db_id, db_id || '.' || tbl || '.' || col AS node_id, col_idx AS ord, tbl, col, typ, is_pk, fk_table, fk_column FROM catalog WHERE col <> '*')"
_EDGES = """anchors AS (SELECT db_id, tbl, arg_max(node_id, ord) AS dst FROM nodes WHERE is_pk GROUP BY db_id, tbl),
raw_edges AS (SELECT n.db_id, n.node_id AS a, dst AS b, 'belongs_to_pk' AS relation, ord * 2 AS o FROM nodes n JOIN anchors USING (db_id, tbl) WHERE n.node_id <> dst
  UNION ALL SELECT n.db_id, n.node_id, t.node_id, 'foreign_key', n.ord * 2 + 1 FROM nodes n JOIN nodes t ON t.db_id = n.db_id AND t.tbl = n.fk_table AND t.col = n.fk_column),
edges AS (SELECT db_id, least(a, b) AS u, greatest(a, b) AS v, arg_max(relation, o) AS relation FROM raw_edges GROUP BY 1, 2, 3)"""
_TABLE_EDGES = """table_edges AS (SELECT db_id, least(db_id || '.' || tbl, db_id || '.' || fk_table) AS u, greatest(db_id || '.' || tbl, db_id || '.' || fk_table) AS v,
  arg_min(tbl, ord) AS from_table, arg_min(col, ord) AS from_col, arg_min(fk_column, ord) AS to_col FROM nodes WHERE fk_table IS NOT NULL GROUP BY 1, 2, 3)"""


def _steps(edges: str) -> str:
    return f"steps AS (SELECT db_id, u AS src, v AS dst FROM {edges} WHERE u <> v UNION SELECT db_id, v, u FROM {edges} WHERE u <> v)"


_WALKS = """walks(db_id, src, dst, path) AS (SELECT db_id, src, dst, [src, dst] FROM steps
  UNION ALL SELECT w.db_id, w.src, s.dst, list_append(w.path, s.dst) FROM walks w JOIN steps s ON s.db_id = w.db_id AND s.src = w.dst WHERE NOT list_contains(w.path, s.dst)),
paths AS (SELECT db_id, src, dst, min(len(path)) - 1 AS hops, arg_min(path, (len(path), path)) AS path FROM walks GROUP BY 1, 2, 3)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([catalog.declared_sql(), *parts]) + "\n"


_ALL = _with(_NODES, _EDGES, _steps("edges"), _WALKS)


def _query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _parts(spark, d):
    cat = catalog.of_tables(spark, d)
    return cat, graph.column_nodes(cat), graph.column_edges(cat)


_text = F.array_join


@_query(_with() + "SELECT db_id, col_idx, table_idx, tbl AS table_name, col AS column_name, typ AS type, is_pk, fk_table, fk_column FROM catalog")
def catalog_flatten(spark, d):
    """The databases found in the tables, nested as a catalogue file has them, then flattened again."""
    raw = []
    for db, tables in catalog.DATABASES.items():
        rows = [tuple(r) for r in catalog.of_tables(spark, d).where(F.col("db_id") == db).orderBy("col_idx").collect()]
        at = {(r[3], r[4]): r[1] for r in rows}
        raw.append((db, list(tables), None, [r[5] for r in rows], [[str(r[2]), r[4]] for r in rows], None, [r[1] for r in rows if r[6]], [[r[1], at[r[7], r[8]]] for r in rows if r[7]]))
    flat = catalog.flatten(spark.createDataFrame(raw, catalog.RAW))
    return flat.withColumnsRenamed({"table": "table_name", "column": "column_name"})


@_query(_with() + "SELECT db_id, count(DISTINCT tbl) AS n_tables, count(col) AS n_columns, count_if(is_pk) AS n_pk, count_if(fk_table IS NOT NULL) AS n_fk FROM catalog WHERE tbl <> 'ALL' GROUP BY db_id")
def schema_stats(spark, d):
    real = catalog.of_tables(spark, d).where("table <> 'ALL'")
    return real.groupBy("db_id").agg(F.count_distinct("table").alias("n_tables"), F.count("column").alias("n_columns"), F.count_if("is_pk").alias("n_pk"), F.count_if(F.col("fk_table").isNotNull()).alias("n_fk"))


@_query(_with() + "SELECT db_id, tbl AS table_name, count(*) AS n FROM catalog WHERE tbl <> 'ALL' GROUP BY 1, 2")
def cols_per_table(spark, d):
    return catalog.of_tables(spark, d).where("table <> 'ALL'").groupBy("db_id", F.col("table").alias("table_name")).agg(F.count("*").alias("n"))


@_query(_with() + "SELECT typ AS type, count(*) AS n FROM catalog WHERE tbl <> 'ALL' GROUP BY 1 ORDER BY n DESC, type")
def type_freq(spark, d):
    return catalog.of_tables(spark, d).where("table <> 'ALL'").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


@_query(_with() + "SELECT CASE WHEN is_pk THEN 'Yes' ELSE 'No' END AS pk, coalesce(fk_table || '.' || fk_column, '-') AS fk, count(*) AS n FROM catalog GROUP BY 1, 2")
def pk_fk_counts(spark, d):
    return catalog.compatibility_view(catalog.of_tables(spark, d)).groupBy(F.col("PK").alias("pk"), F.col("FK_Relation").alias("fk")).agg(F.count("*").alias("n"))


@_query(_with(_NODES) + "SELECT db_id, node_id, ord, tbl AS table_name, col AS column_name, typ AS type, is_pk FROM nodes")
def column_graph_nodes(spark, d):
    return _parts(spark, d)[1].withColumnsRenamed({"table": "table_name", "column": "column_name"})


@_query(_with(_NODES, _EDGES) + "SELECT db_id, u, v, relation FROM edges")
def column_graph_edges(spark, d):
    return _parts(spark, d)[2]


@_query(_with() + "SELECT db_id, db_id || '.' || tbl AS node_id, string_agg(col || ':' || typ || ':' || is_pk, ',' ORDER BY col_idx) AS columns FROM catalog WHERE col <> '*' GROUP BY db_id, tbl")
def table_graph_nodes(spark, d):
    out = graph.table_nodes(catalog.of_tables(spark, d))
    return out.select("db_id", "node_id", _text(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"], c["is_pk"].cast("string"))), ",").alias("columns"))


@_query(_with(_NODES, _TABLE_EDGES) + "SELECT * FROM table_edges")
def table_graph_edges(spark, d):
    return graph.table_edges(catalog.of_tables(spark, d))


@_query(_with(_NODES, _EDGES) + """SELECT n.db_id, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_own, 0) AS n_own, coalesce(n_fk, 0) AS n_fk FROM (SELECT db_id, count(*) AS n_nodes FROM nodes GROUP BY 1) n
LEFT JOIN (SELECT db_id, count(*) AS n_edges, count_if(relation = 'belongs_to_pk') AS n_own, count_if(relation = 'foreign_key') AS n_fk FROM edges GROUP BY 1) e ON n.db_id = e.db_id""")
def graph_stats(spark, d):
    _, nodes, edges = _parts(spark, d)
    return graph.graph_counts(nodes, edges)


_EGO1 = """near AS (SELECT DISTINCT db_id, dst AS node_id FROM steps WHERE src = 'star.orders.o_custkey' UNION SELECT 'star', 'star.orders.o_custkey')"""
_EGO2 = _EGO1 + ", near2 AS (SELECT * FROM near UNION SELECT s.db_id, s.dst FROM near n JOIN steps s ON s.db_id = n.db_id AND s.src = n.node_id)"


@_query(_with(_NODES, _EDGES, _steps("edges"), _EGO1) + "SELECT 'star.orders.o_custkey' AS centre, e.* FROM edges e WHERE (db_id, u) IN (SELECT db_id, node_id FROM near) AND (db_id, v) IN (SELECT db_id, node_id FROM near)")
def ego_r1(spark, d):
    return graph.ego(_parts(spark, d)[2], F.col("src") == "star.orders.o_custkey", 1)


@_query(_with(_NODES, _EDGES, _steps("edges"), _EGO2) + "SELECT 'star.orders.o_custkey' AS centre, e.* FROM edges e WHERE (db_id, u) IN (SELECT db_id, node_id FROM near2) AND (db_id, v) IN (SELECT db_id, node_id FROM near2)")
def ego_r2(spark, d):
    return graph.ego(_parts(spark, d)[2], F.col("src") == "star.orders.o_custkey", 2)


@_query(_with(_NODES) + "SELECT node_id FROM nodes WHERE lower(col) LIKE '%name%' AND lower(db_id) = 'star'")
def find_columns(spark, d):
    return graph.keyword_nodes(_parts(spark, d)[1], "NAME", "STAR").select("node_id")


@_query(_ALL + "SELECT db_id, src, dst, CAST(hops AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM paths")
def schema_paths(spark, d):
    return graph.all_shortest_paths(_parts(spark, d)[2]).withColumn("path", _text("path", ">"))


@_query(_ALL + """SELECT p.db_id, p.src, p.dst, CAST(i - 1 AS INTEGER) AS step, p.path[i] AS a, p.path[i + 1] AS b, e.relation FROM paths p, range(1, 40) r(i), edges e
WHERE i <= p.hops AND e.db_id = p.db_id AND e.u = least(p.path[i], p.path[i + 1]) AND e.v = greatest(p.path[i], p.path[i + 1])""")
def path_relations(spark, d):
    _, _, edges = _parts(spark, d)
    return graph.path_relations(graph.all_shortest_paths(edges), edges).withColumnsRenamed({"from": "a", "to": "b"})


_NAMES = [(1, "star", "c_name"), (1, "star", "r_name"), (2, "star", "o_totalprice"), (2, "star", "p_name"), (2, "star", "n_name"), (3, "corpus", "doc_id"), (3, "corpus", "quality"), (4, "star", "l_tax"), (4, "star", "p_size")]
_NAMES_SQL = "names(q_id, db_id, col) AS (VALUES " + ", ".join(map(str, _NAMES)) + ")"
_HITS = "hits AS (SELECT q_id, n.db_id, node_id, ord FROM nodes n JOIN names USING (db_id, col))"
_TRACE = """pairs AS (SELECT a.q_id, p.path FROM hits a JOIN hits b ON a.q_id = b.q_id AND a.ord < b.ord JOIN paths p ON p.db_id = a.db_id AND p.src = a.node_id AND p.dst = b.node_id),
traced AS (SELECT q_id, node_id, bool_or(is_hit) AS is_hit FROM (SELECT q_id, node_id, true AS is_hit FROM hits UNION ALL SELECT q_id, unnest(path), false FROM pairs) GROUP BY 1, 2)"""


def _names(spark, d):
    return spark.createDataFrame(_NAMES, "q_id int, db_id string, column string")


@_query(_with(_NODES, _EDGES, _steps("edges"), _WALKS, _NAMES_SQL, _HITS, _TRACE) + "SELECT q_id, node_id, is_hit FROM traced")
def trace_paths(spark, d):
    _, nodes, edges = _parts(spark, d)
    return graph.expand_hits(graph.hits_by_name(_names(spark, d), nodes), graph.routes(edges)).select("q_id", "node_id", "is_hit")


@_query(_with(_NODES, _EDGES, _steps("edges"), _WALKS, _NAMES_SQL, _HITS, _TRACE) + """SELECT q_id, node_id FROM traced t JOIN nodes n USING (node_id) WHERE n.is_pk OR EXISTS (SELECT 1 FROM names m WHERE m.q_id = t.q_id AND m.db_id = n.db_id AND lower(m.col) = lower(n.col))
OR EXISTS (SELECT 1 FROM edges e WHERE e.db_id = n.db_id AND e.relation = 'foreign_key' AND (e.u = t.node_id OR e.v = t.node_id))""")
def prune_nodes(spark, d):
    _, nodes, edges = _parts(spark, d)
    expanded = graph.expand_hits(graph.hits_by_name(_names(spark, d), nodes), graph.routes(edges))
    return graph.prune(expanded, nodes, edges, _names(spark, d)).select("q_id", "node_id")


@_query(_with(_NODES, _TABLE_EDGES, _steps("table_edges"), _WALKS) + "SELECT db_id, src, dst, CAST(hops AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM paths")
def table_paths(spark, d):
    return graph.all_shortest_paths(graph.table_edges(catalog.of_tables(spark, d))).withColumn("path", _text("path", ">"))


@_query(_ALL.rstrip() + """, k AS (SELECT db_id, 1 AS pos, arg_min(node_id, ord) AS node_id FROM nodes WHERE db_id = 'star' AND col LIKE '%segment%' GROUP BY 1 UNION ALL
SELECT db_id, 2, arg_min(node_id, ord) FROM nodes WHERE db_id = 'star' AND col LIKE '%brand%' GROUP BY 1 UNION ALL SELECT db_id, 3, arg_min(node_id, ord) FROM nodes WHERE db_id = 'star' AND col LIKE '%name%' GROUP BY 1)
SELECT node_id FROM k UNION SELECT unnest(path) FROM paths p JOIN k a ON a.pos = 1 AND p.src = a.node_id JOIN k b ON b.pos > 1 AND p.dst = b.node_id""")
def steiner_anchor(spark, d):
    _, nodes, edges = _parts(spark, d)
    return graph.anchor_star(nodes, graph.routes(edges), "star", ["segment", "brand", "name"]).select("node_id")


@_query(_ALL.rstrip() + """, met AS (SELECT p.*, a.ord AS o1, b.ord AS o2 FROM paths p JOIN nodes a ON a.node_id = p.src JOIN nodes b ON b.node_id = p.dst WHERE a.col LIKE '%acctbal%' AND b.col LIKE '%price%')
SELECT db_id, arg_min(src, (hops, o1, o2)) AS src, arg_min(dst, (hops, o1, o2)) AS dst, CAST(min(hops) AS INTEGER) AS hops, arg_min(array_to_string(path, '>'), (hops, o1, o2)) AS path FROM met GROUP BY db_id""")
def keyword_path(spark, d):
    _, nodes, edges = _parts(spark, d)
    return graph.path_between_keywords(nodes, graph.routes(edges), "acctbal", "price").withColumn("path", _text("path", ">"))


_KEY_COLUMNS = [
    *[(t, c.split(":")[0], c.split(":")[1]) for tables in catalog.DATABASES.values() for t, cs in tables.items() for c in cs.split()],
    ("embeddings", "vec_id", "number"), ("embeddings", "label", "number"), ("pages", "page_id", "number"), ("pages", "url", "text"), ("pages", "html", "text"), ("benchmark", "item_id", "number"), ("benchmark", "text", "text"),
]
_FRACTIONS = ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value")
_VALUES = " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, '{k}' AS kind, CAST({c} AS VARCHAR) AS val, count(*) AS n FROM {t} GROUP BY {c}" for t, c, k in _KEY_COLUMNS if c not in _FRACTIONS)
_KEYS_SQL = f"""WITH v AS (SELECT tbl || '.' || col AS name, tbl, kind, val, n FROM ({_VALUES})),
u AS (SELECT name FROM v GROUP BY name HAVING max(n) = 1 AND count(*) = count(val)),
s AS (SELECT name, count(val) AS n FROM v GROUP BY name),
m AS (SELECT a.name AS a, b.name AS b, count(*) AS n FROM v a JOIN v b ON a.kind = b.kind AND a.val = b.val AND a.tbl <> b.tbl WHERE b.name IN (SELECT name FROM u) GROUP BY 1, 2),
i AS (SELECT m.a, string_agg(m.b, ' ' ORDER BY m.b) AS b FROM m JOIN s ON s.name = m.a WHERE s.n = m.n GROUP BY 1)
SELECT s.name AS column_name, s.name IN (SELECT name FROM u) AS is_unique, coalesce(i.b, '') AS within FROM s LEFT JOIN i ON i.a = s.name"""


@_query(_KEYS_SQL)
def key_discovery(spark, d):
    """Of all columns of all tables that may be keys: whether they are unique, and all unique columns of other tables that
    hold all of their values, whatever the names."""
    tables = {n: table(spark, d, n) for n in STAR + CORPUS}
    unique, pairs = discovery.found_keys(tables)
    within: dict = {}
    for a, b in pairs:
        within.setdefault(a, []).append(".".join(b))
    rows = [(".".join(x), x in unique, " ".join(sorted(within.get(x, [])))) for t, df in tables.items() for x in ((t, c) for c in df.columns if discovery.kind_of(df, c))]
    return spark.createDataFrame(rows, "column_name string, is_unique boolean, within string")
