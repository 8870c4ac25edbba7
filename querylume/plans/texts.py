"""String queries over questions, SQL text and rendered schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylume.functions import render
from querylume.functions import text as T
from querylume.operators import graph
from querylume.plans import schema
from querylume.sources import catalog
from querylume.sources.tables import table

QUERIES, ORACLE = {}, {}


def _query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: A query for each part of the table ``part``: the one of its number, with its brand for '#' and its size for '@'.
SQLS = [
    "SELECT name FROM customer WHERE c_acctbal > @",
    "SELECT T1.c_name, count(*) FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey GROUP BY T1.c_name HAVING count(*) > @",
    "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT @",
    "SELECT max(p_size), min(p_size), avg(p_size), sum(p_size) FROM part WHERE p_type LIKE '%#%'",
    "SELECT s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity<@)",
    "SELECT n_name FROM nation INTERSECT SELECT c_name FROM customer WHERE .c_mktsegment = \"#\"",
    "SELECT n_name FROM nation EXCEPT SELECT c_name FROM customer UNION SELECT r_name FROM region",
    "select o_orderkey from orders where o_orderstatus = 'F@' and o_clerk='#' and o_totalprice between 5 and @00",
    "SELECT a.x, b.y FROM a JOIN b ON a.id = b.id JOIN c ON c.id = b.id WHERE a.z = '#'",
]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _filled_sql(templates: list[str], name: str) -> str:
    return f"SELECT p_partkey AS id, replace(replace(([{', '.join(map(_text, templates))}])[1 + p_partkey % {len(templates)}], '#', p_brand), '@', p_size::VARCHAR) AS {name} FROM part"


def _filled(spark, d, templates: list[str], name: str):
    one = F.element_at(F.array(*map(F.lit, templates)), (F.col("p_partkey") % len(templates) + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace(F.replace(one, F.lit("#"), F.col("p_brand")), F.lit("@"), F.col("p_size").cast("string")).alias(name))


_LITERAL = f"sqls AS ({_filled_sql(SQLS, 'sql')})"


def _sqls(spark, d):
    return _filled(spark, d, SQLS, "sql")


@_query(r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM w, range(1, 4) g(n), range(1, 5000) r(i) WHERE i + n - 1 <= len(w)) SELECT DISTINCT item_id, phrase FROM p""")
def ngram_phrases(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.phrases(F.col("text"), 3)).alias("phrase"))


@_query(r"SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words FROM conversations")
def word_counts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).alias("n_words"))


@_query("WITH " + _LITERAL + r""", t AS (SELECT id, unnest(regexp_split_to_array(lower(sql), '[\s\(\),;=<>!"'']+')) AS t FROM sqls)
SELECT DISTINCT id, ltrim(t, '.') AS token FROM t WHERE t <> '' AND t NOT IN (""" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")")
def gold_tokens(spark, d):
    return _sqls(spark, d).select("id", F.explode(T.gold_tokens(F.col("sql"))).alias("token"))


@_query("WITH " + _LITERAL + r" SELECT id, array_to_string(regexp_extract_all(sql, '''([^'']*)''', 1), '|') AS strings, array_to_string(regexp_extract_all(sql, '\d+'), '|') AS numbers FROM sqls")
def quoted_numbers(spark, d):
    return _sqls(spark, d).select("id", F.array_join(T.quoted(F.col("sql")), "|").alias("strings"), F.array_join(T.numbers(F.col("sql")), "|").alias("numbers"))


_FEATURES = ", ".join(f"regexp_matches(upper(sql), '{p}') AS {n}" for n, p in T.CLAUSES.items())
_FEATURES += r", len(regexp_extract_all(upper(sql), 'SELECT')) > 1 AS has_subquery, CAST(len(regexp_extract_all(upper(sql), '\bJOIN\b')) AS INTEGER) AS n_joins, CAST(len(regexp_extract_all(upper(sql), '\bSELECT\b')) AS INTEGER) AS n_selects"


@_query(f"WITH {_LITERAL} SELECT id, {_FEATURES} FROM sqls")
def sql_features(spark, d):
    return _sqls(spark, d).select("id", *[c.alias(n) for n, c in T.sql_features(F.col("sql")).items()])


_SCORE = "has_join::INT + n_joins * 0.5 + 2 * has_subquery::INT + has_having::INT + 2 * has_intersect::INT + 2 * has_except::INT + has_union::INT"


@_query(f"WITH {_LITERAL}, f AS (SELECT id, {_FEATURES} FROM sqls), s AS (SELECT id, {_SCORE} AS s FROM f) SELECT id, CASE WHEN s = 0 THEN 'easy' WHEN s <= 1 THEN 'medium' WHEN s <= 3 THEN 'hard' ELSE 'extra' END AS level FROM s")
def hardness_proxy(spark, d):
    return _sqls(spark, d).select("id", T.hardness_proxy(T.sql_features(F.col("sql"))).alias("level"))


@_query(f"WITH {_LITERAL}, f AS (SELECT id, {_FEATURES} FROM sqls), m AS (UNPIVOT (SELECT " + ", ".join(f"round(avg({n}::INT) * 100, 4) AS {n}" for n in (*T.CLAUSES, "has_subquery")) + " FROM f) ON COLUMNS(*) INTO NAME clause VALUE share) SELECT clause, share FROM m")
def clause_freq(spark, d):
    f = {n: c for n, c in T.sql_features(F.col("sql")).items() if n.startswith("has_")}
    wide = _sqls(spark, d).agg(*[F.round(F.avg(c.cast("int")) * 100, 4).alias(n) for n, c in f.items()])
    return wide.unpivot([], list(f), "clause", "share").orderBy(F.desc("share"), "clause")


#: Answers as models give them, and what is left of them, by hand.
RAW_ANSWERS = [
    ("```sql\nSELECT T1.name FROM singer AS T1 WHERE T1.age > @;\n``` and that is it", "SELECT name FROM singer WHERE T1.age > @"),
    ("Sure: SELECT a.x, b.y FROM a AS a JOIN b AS b ON a.id = b.id WHERE b.z = '#' ORDER BY a.x NULLS LAST", "SELECT a.x, b.y FROM a AS a JOIN b AS b ON a.id = b.id WHERE b.z = '#' ORDER BY a.x"),
    ("SELECT name FROM people WHERE name ILIKE '%#%' AND age::text = '@'", "SELECT name FROM people WHERE name LIKE '%#%' AND age = '@'"),
    ("", "SELECT 1"),
    ("SELECT x FROM t WHERE y IN (SELECT y FROM u WHERE z = @)", "SELECT x FROM t WHERE y IN (SELECT y FROM u WHERE z = @)"),
    ("select  count(*)   as n from   t1 as a,  t2 group by z@", "select count(*) FROM t1 group by z@"),
    ("`SELECT joined@ FROM t AS x`", "SELECT joined@ FROM t AS x"),
    ("no query at all, #", "no query at all, #"),
    ("SELECT a FROM t WHERE b = 'x;y' AND c = @", "SELECT a FROM t WHERE b = 'x"),
    ("SELECT u.a, u.b.c FROM u ORDER BY u.a NULLS FIRST LIMIT @", "SELECT a, c FROM u ORDER BY u.a LIMIT @"),
    ("SELECT a FROM t EXCEPT SELECT a FROM u AS v;", "SELECT a FROM t EXCEPT SELECT a FROM u AS v"),
]


@_query(_filled_sql([clean for _, clean in RAW_ANSWERS], "sql"))
def clean_sql(spark, d):
    return _filled(spark, d, [raw for raw, _ in RAW_ANSWERS], "raw").select("id", T.clean_sql(F.col("raw")).alias("sql"))


@_query(schema._with(schema._NODES, schema._EDGES) + r"""SELECT q_id, string_agg(block, chr(10) ORDER BY first) AS ddl FROM (
SELECT n.db_id AS q_id, n.tbl, min(n.ord) AS first, 'CREATE TABLE ' || n.tbl || ' (' || chr(10) || string_agg('    ' || n.col || ' ' || n.typ || CASE WHEN n.is_pk THEN ' PRIMARY KEY' ELSE '' END, ',' || chr(10) ORDER BY n.ord)
 || coalesce(',' || chr(10) || any_value(f.lines), '') || chr(10) || ');' || chr(10) AS block FROM nodes n LEFT JOIN (
  SELECT a.db_id, a.tbl, string_agg('    FOREIGN KEY (' || a.col || ') REFERENCES ' || b.tbl || '(' || b.col || ')', ',' || chr(10) ORDER BY a.ord, b.ord) AS lines
  FROM edges e JOIN nodes a ON a.node_id IN (e.u, e.v) JOIN nodes b ON b.node_id IN (e.u, e.v) AND b.node_id <> a.node_id WHERE e.relation = 'foreign_key' AND b.is_pk AND a.tbl <> b.tbl GROUP BY 1, 2) f ON f.db_id = n.db_id AND f.tbl = n.tbl
GROUP BY n.db_id, n.tbl) GROUP BY q_id""")
def ddl_column(spark, d):
    cat = catalog.of_tables(spark, d)
    nodes, edges = graph.column_nodes(cat), graph.column_edges(cat)
    return render.column_ddl(nodes.select(F.col("db_id").alias("q_id"), "db_id", "node_id"), nodes, edges)


@_query(schema._with(schema._NODES, schema._TABLE_EDGES) + r"""SELECT q_id, string_agg(block, chr(10) ORDER BY first) AS ddl FROM (
SELECT n.db_id AS q_id, n.tbl, min(n.ord) AS first, 'CREATE TABLE ' || n.tbl || ' (' || chr(10) || string_agg('    ' || n.col || ' ' || n.typ || CASE WHEN n.is_pk THEN ' PRIMARY KEY' ELSE '' END, ',' || chr(10) ORDER BY n.ord)
 || coalesce(',' || chr(10) || any_value(f.lines), '') || chr(10) || ');' || chr(10) AS block FROM nodes n LEFT JOIN (
  SELECT db_id, tbl, string_agg('    FOREIGN KEY (' || from_col || ') REFERENCES ' || other || '(' || to_col || ')', ',' || chr(10) ORDER BY other) AS lines FROM (
   SELECT e.db_id, split_part(u, '.', 2) AS tbl, split_part(v, '.', 2) AS other, from_col, to_col FROM table_edges e UNION ALL SELECT e.db_id, split_part(v, '.', 2), split_part(u, '.', 2), from_col, to_col FROM table_edges e) x
  WHERE EXISTS (SELECT 1 FROM nodes m WHERE m.db_id = x.db_id AND m.tbl = x.tbl AND m.col = x.from_col) GROUP BY 1, 2) f ON f.db_id = n.db_id AND f.tbl = n.tbl
GROUP BY n.db_id, n.tbl) GROUP BY q_id""")
def ddl_table(spark, d):
    cat = catalog.of_tables(spark, d)
    chosen = cat.where("column <> '*'").select(F.col("db_id").alias("q_id"), "db_id", "table")
    return render.table_ddl(chosen, cat, graph.table_edges(cat))


@_query("SELECT q_id, '### Examples' || chr(10) || chr(10) || string_agg('-- Example ' || place || chr(10) || '-- Q: ' || q || chr(10) || '-- A:' || chr(10) || trim(s) || chr(10), chr(10) ORDER BY place) || chr(10) AS block FROM (SELECT conv_id AS q_id, turn AS place, text AS q, ' SELECT ' || role || ' ' AS s FROM conversations) GROUP BY q_id")
def fewshot_block(spark, d):
    return render.few_shot_block(table(spark, d, "conversations").select(F.col("conv_id").alias("q_id"), F.col("turn").alias("place"), F.col("text").alias("question"), F.concat(F.lit(" SELECT "), "role", F.lit(" ")).alias("sql")))


@_query(f"SELECT item_id, {_text(render.PROMPT_HEAD)} || 'CREATE TABLE t (' || chr(10) || '    a text' || chr(10) || ');' || chr(10) || chr(10) || '### Question' || chr(10) || text || {_text(render.PROMPT_TAIL)} AS prompt FROM benchmark")
def prompt_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", render.prompt(F.col("text"), F.lit("CREATE TABLE t (\n    a text\n);\n"), F.lit(None).cast("string")).alias("prompt"))


@_query(schema._with() + r"""SELECT q_id AS db_id, CAST(len(list_filter(regexp_split_to_array(txt, '\s+'), lambda x: x <> '')) AS INTEGER) AS flat, CAST(len(list_filter(regexp_split_to_array(txt, '\s+'), lambda x: x <> '')) + 8 * n_fk AS BIGINT) AS with_graph FROM (
SELECT db_id AS q_id, string_agg('Table: ' || tbl || chr(10) || 'Columns: ' || cols, chr(10) || chr(10) ORDER BY tbl) AS txt, sum(fk) AS n_fk FROM (
SELECT db_id, tbl, string_agg(col || ' (' || typ || ')', ', ' ORDER BY col_idx) AS cols, count(fk_table) AS fk FROM catalog WHERE tbl <> 'ALL' GROUP BY 1, 2) GROUP BY 1)""")
def schema_tokens(spark, d):
    """Tokens of the flat schema text, and with eight more for each foreign key."""
    cat = catalog.of_tables(spark, d)
    fk = cat.groupBy("db_id").agg(F.count("fk_table").alias("n_fk"))
    flat = render.flat_schema(cat).select("db_id", T.word_count(F.col("text")).alias("flat"))
    return flat.join(fk, "db_id").select("db_id", "flat", (F.col("flat") + 8 * F.col("n_fk")).alias("with_graph"))
