"""Retrieval end to end as queries: prompts, linking scores, sweep, ablation and mode comparison, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylume.functions import render
from querylume.functions import text as T
from querylume.functions.vectors import DIMENSIONS
from querylume.plans import runs, schema
from querylume.plans.questions import EXAMPLES, QUESTIONS, star_examples, star_questions, values_sql
from querylume.sources import catalog

QUERIES, ORACLE = {}, {}

_ASKED = values_sql("asked", "q_id, db_id, question, sql", QUESTIONS)
_SHOTS = values_sql("shots", "id, db_id, question, sql", EXAMPLES)
_TEXTS = "asked AS (SELECT item_id AS q_id, 'star' AS db_id, text AS question, '' AS sql FROM benchmark)"


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _embedded(name: str, source: str, text: str) -> str:
    """A relation with a column v more: the unit vector of the hashed bag of words and trigrams of ``text``."""
    tri = "flatten(list_transform(w, lambda x: list_transform(range(1, greatest(len(x) - 2, 1) + 1), lambda i: '#' || substring(x, i, 3))))"
    bucket = f"list_transform(list_concat(list_concat(w, w), {tri}), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {DIMENSIONS})"
    words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""{name}_w AS (SELECT *, {words} AS w FROM {source}), {name}_b AS (SELECT *, {bucket} AS b FROM {name}_w),
{name}_c AS (SELECT * EXCLUDE (w, b), list_transform(range(0, {DIMENSIONS}), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS c FROM {name}_b),
{name} AS (SELECT * EXCLUDE (c), list_transform(c, lambda x: coalesce(x / nullif(sqrt(list_sum(list_transform(c, lambda y: y * y))), 0), 0)) AS v FROM {name}_c)"""


def _near(a: str, b: str) -> str:
    return f"round(list_dot_product({a}.v, {b}.v), 9)"


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: x <> '')"
_PHRASES = f"""qw AS (SELECT q_id, db_id, {_WORDS} AS w FROM asked),
raw_phrases AS (SELECT DISTINCT q_id, db_id, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM qw, range(1, 4) g(n), range(1, 400) r(i) WHERE i + n - 1 <= len(w)),
texts AS (SELECT DISTINCT phrase FROM raw_phrases), {_embedded('text_vectors', 'texts', 'phrase')}, phrases AS (SELECT p.*, v FROM raw_phrases p JOIN text_vectors USING (phrase)),
raw_tables AS (SELECT db_id, tbl, min(ord) AS ord FROM nodes GROUP BY 1, 2), {_embedded('tables', 'raw_tables', 'tbl')}, {_embedded('columns', 'nodes', "tbl || '.' || col")},
table_scores AS (SELECT p.q_id, t.tbl, t.ord, max({_near('p', 't')}) AS score FROM phrases p JOIN tables t USING (db_id) GROUP BY ALL),
ranked_tables AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, ord) AS tr FROM table_scores),
column_scores AS (SELECT p.q_id, p.db_id, p.phrase, c.tbl, c.col, c.ord, {_near('p', 'c')} AS score, tr FROM phrases p JOIN columns c USING (db_id) JOIN ranked_tables r ON r.q_id = p.q_id AND r.tbl = c.tbl WHERE tr <= 3),
points AS (SELECT q_id, db_id, sql, kt, kc, q_id || '|' || kt || '|' || kc AS p FROM asked, (VALUES {{tables}}) t(kt), (VALUES {{columns}}) c(kc)),
column_ranks AS (SELECT kt, q_id, db_id, col, row_number() OVER (PARTITION BY kt, q_id, phrase ORDER BY score DESC, ord) AS cr FROM column_scores JOIN (VALUES {{tables}}) t(kt) ON tr <= kt),
detected AS (SELECT DISTINCT p.p, r.db_id, r.col FROM column_ranks r JOIN points p ON p.q_id = r.q_id AND p.kt = r.kt AND r.cr <= p.kc),
hits AS (SELECT p, n.db_id, node_id, ord FROM nodes n JOIN detected d ON d.db_id = n.db_id AND d.col = n.col),
on_paths AS (SELECT a.p, unnest(w.path) AS node_id FROM hits a JOIN hits b ON a.p = b.p AND a.ord < b.ord JOIN paths w ON w.db_id = a.db_id AND w.src = a.node_id AND w.dst = b.node_id),
found AS (SELECT p, node_id FROM hits UNION SELECT p, node_id FROM on_paths),
linked AS (SELECT * FROM found UNION SELECT q.p, n.node_id FROM points q JOIN nodes n USING (db_id) WHERE q.p NOT IN (SELECT p FROM found))"""
#: In table mode: the question as a whole against tables with their columns; all columns of the tables on the paths.
_TABLE_MODE = f"""raw_questions AS (SELECT q_id, db_id, sql FROM asked), {_embedded('questions', 'asked', "'query ' || question")},
raw_tables AS (SELECT db_id, tbl, min(ord) AS ord, string_agg(col, ' ' ORDER BY ord) AS cols FROM nodes GROUP BY 1, 2), {_embedded('tables', 'raw_tables', "'table ' || tbl || ' columns ' || cols")},
ranked_tables AS (SELECT q.q_id, q.db_id, t.tbl, row_number() OVER (PARTITION BY q.q_id ORDER BY {_near('q', 't')} DESC, t.ord) AS tr FROM questions q JOIN tables t USING (db_id)),
points AS (SELECT q_id, db_id, sql, q_id::VARCHAR AS p FROM asked),
table_hits AS (SELECT q_id, db_id, db_id || '.' || tbl AS node_id, tr FROM ranked_tables WHERE tr <= 3),
reached AS (SELECT q_id, node_id FROM table_hits UNION SELECT a.q_id, unnest(w.path) FROM table_hits a JOIN table_hits b ON a.q_id = b.q_id AND a.tr < b.tr JOIN paths w ON w.src = a.node_id AND w.dst = b.node_id),
linked AS (SELECT r.q_id::VARCHAR AS p, n.node_id FROM reached r JOIN nodes n ON r.node_id = n.db_id || '.' || n.tbl)"""
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_ELEMENTS = f"""elements AS (SELECT p, list_distinct(flatten(list([lower(tbl), lower(col)]))) AS e FROM linked JOIN nodes USING (node_id) GROUP BY p),
known AS (SELECT db_id, list_distinct(flatten(list([lower(tbl), lower(col)]))) AS k FROM nodes GROUP BY 1),
gold AS (SELECT p, q_id, db_id, list_intersect(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(sql), '[\\s\\(\\),;=<>!"'']+'), lambda t: t <> '' AND t NOT IN ({_STOP})), lambda t: ltrim(t, '.'))), k) AS g FROM points JOIN known USING (db_id)),
scored AS (SELECT gold.*, CASE WHEN len(g) = 0 THEN 1 WHEN len(coalesce(e, [])) = 0 THEN 0 ELSE len(list_intersect(g, e)) / len(g) END AS recall,
 CASE WHEN len(g) = 0 THEN 1 WHEN len(coalesce(e, [])) = 0 THEN 0 ELSE len(list_intersect(g, e)) / len(e) END AS precision FROM gold LEFT JOIN elements USING (p))"""
_DDL = """fks AS (SELECT a.node_id, a.ord, b.ord AS o2, '    FOREIGN KEY (' || a.col || ') REFERENCES ' || b.tbl || '(' || b.col || ')' AS line FROM edges e JOIN nodes a ON a.node_id IN (e.u, e.v) JOIN nodes b ON b.node_id IN (e.u, e.v) AND b.node_id <> a.node_id
 WHERE e.relation = 'foreign_key' AND b.is_pk AND a.tbl <> b.tbl),
lines AS (SELECT p, tbl, n.ord, 0 AS kind, 0 AS o2, '    ' || col || ' ' || typ || CASE WHEN is_pk THEN ' PRIMARY KEY' ELSE '' END AS line FROM {nodes} JOIN nodes n USING (node_id)
 UNION ALL SELECT p, tbl, f.ord, 1, f.o2, f.line FROM {nodes} JOIN nodes n USING (node_id) JOIN fks f USING (node_id)),
blocks AS (SELECT p, min(ord) AS first, 'CREATE TABLE ' || tbl || ' (' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY kind, ord, o2) || chr(10) || ');' || chr(10) AS block FROM lines GROUP BY p, tbl),
ddl AS (SELECT p, string_agg(block, chr(10) ORDER BY first) AS ddl FROM blocks GROUP BY p)"""
_TABLE_DDL = """fks AS (SELECT db_id || '.' || tbl AS t, string_agg('    FOREIGN KEY (' || from_col || ') REFERENCES ' || other || '(' || to_col || ')', ',' || chr(10) ORDER BY other) AS line FROM (
 SELECT e.db_id, split_part(u, '.', 2) AS tbl, split_part(v, '.', 2) AS other, from_col, to_col FROM table_edges e UNION ALL SELECT e.db_id, split_part(v, '.', 2), split_part(u, '.', 2), from_col, to_col FROM table_edges e) x
 WHERE EXISTS (SELECT 1 FROM nodes m WHERE m.db_id = x.db_id AND m.tbl = x.tbl AND m.col = x.from_col) GROUP BY 1),
blocks AS (SELECT p, min(ord) AS first, 'CREATE TABLE ' || tbl || ' (' || chr(10) || string_agg('    ' || col || ' ' || typ || CASE WHEN is_pk THEN ' PRIMARY KEY' ELSE '' END, ',' || chr(10) ORDER BY ord) || coalesce(',' || chr(10) || any_value(f.line), '') || chr(10) || ');' || chr(10) AS block
 FROM linked JOIN nodes n USING (node_id) LEFT JOIN fks f ON f.t = n.db_id || '.' || n.tbl GROUP BY p, tbl),
ddl AS (SELECT p, string_agg(block, chr(10) ORDER BY first) AS ddl FROM blocks GROUP BY p)"""
_FEW = f"""{_embedded('asked_vectors', 'asked', 'question')}, {_embedded('shot_vectors', 'shots', 'question')},
alike AS (SELECT q.q_id, q.db_id AS qd, s.id, s.db_id, s.question, s.sql, row_number() OVER (PARTITION BY q.q_id ORDER BY round(list_dot_product(q.v, s.v), 12) DESC, s.id) AS r FROM asked_vectors q, shot_vectors s),
places AS (SELECT q_id, k, question, sql, row_number() OVER (PARTITION BY q_id, k ORDER BY (qd <> db_id)::INT, r) AS place FROM alike JOIN (VALUES {{ks}}) v(k) ON r <= 4 * k),
few AS (SELECT q_id, k, '### Examples' || chr(10) || chr(10) || string_agg('-- Example ' || place || chr(10) || '-- Q: ' || question || chr(10) || '-- A:' || chr(10) || trim(sql) || chr(10), chr(10) ORDER BY place) || chr(10) AS block FROM places WHERE place <= k GROUP BY q_id, k)"""
_PROMPT = f"{_text(render.PROMPT_HEAD)} || ddl || chr(10) || coalesce(block, '') || '### Question' || chr(10) || question || {_text(render.PROMPT_TAIL)}"
_COUNT = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_F1, _F6 = "CASE WHEN r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END", "CASE WHEN 36 * p + r = 0 THEN 0 ELSE 37 * p * r / (36 * p + r) END"


def _column_mode(asked: str, *more: str, tables: tuple[int, ...] = (3,), columns: tuple[int, ...] = (5,)) -> str:
    listed = lambda ks: ", ".join(f"({k})" for k in ks)
    phrases = _PHRASES.replace("{tables}", listed(tables)).replace("{columns}", listed(columns))
    return schema._with(schema._NODES, schema._EDGES, schema._steps("edges"), schema._WALKS, asked, phrases, *more)


def _table_mode(asked: str, *more: str) -> str:
    return schema._with(schema._NODES, schema._TABLE_EDGES, schema._steps("table_edges"), schema._WALKS, asked, _TABLE_MODE, *more)


@_query(_column_mode(_TEXTS, _DDL.format(nodes="linked"), _SHOTS, _FEW.replace("{ks}", "(3)"), "made AS (SELECT q.q_id, a.db_id, a.question, ddl, " + _PROMPT + " AS prompt FROM points q JOIN asked a USING (q_id) JOIN ddl USING (p) LEFT JOIN few ON few.q_id = q.q_id)") + "SELECT * FROM made")
def linked_prompts(spark, d):
    """The flagship: every benchmark text as a question, to its prompt."""
    return runs.flagship(spark, d)


@_query(_column_mode(_ASKED, _ELEMENTS) + "SELECT q_id, round(recall, 6) AS recall, round(precision, 6) AS precision FROM scored")
def linking_metrics(spark, d):
    """Recall and precision of each question's context."""
    q, cat = star_questions(spark), catalog.of_tables(spark, d)
    out = runs.linking_scores(q, runs.contexts(q, cat, runs.Config()), cat)
    return out.select("q_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@_query(_table_mode(_ASKED, _ELEMENTS) + "SELECT q_id, round(recall, 6) AS recall, round(precision, 6) AS precision FROM scored")
def linking_metrics_tables(spark, d):
    """The same in table mode, where the question as a whole meets whole tables."""
    q, cat = star_questions(spark), catalog.of_tables(spark, d)
    cfg = runs.Config(table_mode=True)
    out = runs.linking_scores(q, runs.contexts(q, cat, cfg), cat, False)
    return out.select("q_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


_GOLD_NODES = "gold_nodes AS (SELECT p, node_id FROM gold g JOIN nodes n USING (db_id) WHERE list_contains(g.g, lower(n.tbl)) OR list_contains(g.g, lower(n.col)))"


@_query(_column_mode(_ASKED, _ELEMENTS, _GOLD_NODES, _DDL.format(nodes="gold_nodes")) + f"SELECT q_id, coalesce(ddl, {_text(runs.NO_GOLD)}) AS gold_ddl FROM points LEFT JOIN ddl USING (p)")
def gold_context(spark, d):
    """The schema that the gold query needs, as DDL."""
    return runs.gold_contexts(star_questions(spark), catalog.of_tables(spark, d))


_SWEEP = f"""means AS (SELECT kt AS top_k_tables, kc AS top_k_columns, avg(recall) AS r, avg(precision) AS p, count(*) AS n_samples FROM scored JOIN points USING (p) GROUP BY 1, 2),
swept AS (SELECT top_k_tables, top_k_columns, round(r, 6) AS avg_recall, round(p, 6) AS avg_precision, round({_F1}, 6) AS f1, round({_F6}, 6) AS f6, r >= 0.9 AS meets_recall_target, n_samples FROM means)"""


def _swept(spark, d):
    out = runs.sweep(star_questions(spark), catalog.of_tables(spark, d), runs.Config())
    return out.withColumns({c: F.round(c, 6) for c in ("avg_recall", "avg_precision", "f1", "f6")})


@_query(_column_mode(_ASKED, _ELEMENTS, _SWEEP, tables=runs.GRID_TABLES, columns=runs.GRID_COLUMNS) + "SELECT * FROM swept")
def retrieval_sweep(spark, d):
    """The grid over the real retrieval."""
    return _swept(spark, d)


@_query(_column_mode(_ASKED, _ELEMENTS, _SWEEP, tables=runs.GRID_TABLES, columns=runs.GRID_COLUMNS) + "SELECT top_k_tables, top_k_columns, f1, CAST(row_number() OVER (ORDER BY f1 DESC, top_k_tables, top_k_columns) AS INTEGER) AS place FROM swept")
def retrieval_sweep_by_f1(spark, d):
    """The other ranking of the grid, a row a point."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(F.desc("f1"), "top_k_tables", "top_k_columns"))  # as many rows as the grid has points
    return _swept(spark, d).select("top_k_tables", "top_k_columns", "f1", place.alias("place"))


_RUN = f"tokens AS (SELECT recall, precision, {_COUNT.format(_PROMPT)} AS tin, {_COUNT.format('a.sql')} AS tout FROM scored s JOIN asked a ON a.q_id = s.q_id JOIN ddl USING (p) LEFT JOIN few ON few.q_id = s.q_id)"
_MEANS = f"""m AS (SELECT avg(recall) AS r, avg(precision) AS p, avg(tin) AS tin, avg(tout) AS tout, avg(tin + tout) AS tc, count(*) AS n FROM tokens),
s AS (SELECT round(r, 6) AS avg_recall, round(p, 6) AS avg_precision, round(tin, 4) AS avg_prompt_tokens, round(tout, 4) AS avg_output_tokens, round(tc, 4) AS avg_token_consumption, n AS n_samples, round({_F1}, 6) AS f1, round({_F6}, 6) AS f6 FROM m)"""


def gold_answers(df):
    """A generator that gives the gold query: what a perfect model would say."""
    return df.withColumn("raw", F.col("sql"))


def _rounded(df):
    digits = {"avg_recall": 6, "avg_precision": 6, "f1": 6, "f6": 6, "avg_prompt_tokens": 4, "avg_output_tokens": 4, "avg_token_consumption": 4}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})


@_query(_column_mode(_ASKED, _ELEMENTS, _DDL.format(nodes="linked"), _SHOTS, _FEW.replace("{ks}", "(3)"), _RUN, _MEANS) + "SELECT * FROM s")
def pipeline_summary(spark, d):
    """Means of a whole run with a perfect generator."""
    return _rounded(runs.summary(runs.run(star_questions(spark), star_examples(spark), catalog.of_tables(spark, d), runs.Config(generate=gold_answers))))


_NO_SHOTS = "few AS (SELECT 0 AS q_id, 0 AS k, '' AS block WHERE false)"


@_query(
    "WITH g AS (" + _column_mode(_ASKED, _ELEMENTS, _DDL.format(nodes="linked"), _SHOTS, _FEW.replace("{ks}", "(3)"), _RUN, _MEANS) + "SELECT * FROM s), b AS ("
    + _table_mode(_ASKED, _ELEMENTS, _TABLE_DDL, _NO_SHOTS, _RUN, _MEANS) + """SELECT * FROM s)
SELECT g.avg_recall AS graph_avg_recall, g.avg_precision AS graph_avg_precision, g.avg_prompt_tokens AS graph_avg_prompt_tokens, g.n_samples AS graph_n_samples, b.avg_recall AS base_avg_recall, b.avg_precision AS base_avg_precision, b.avg_prompt_tokens AS base_avg_prompt_tokens, b.n_samples AS base_n_samples,
round(g.avg_recall - b.avg_recall, 4) AS delta_avg_recall, round(g.avg_precision - b.avg_precision, 4) AS delta_avg_precision, round(g.avg_prompt_tokens - b.avg_prompt_tokens, 2) AS delta_avg_prompt_tokens FROM g, b"""
)
def mode_comparison(spark, d):
    """Column mode with examples beside table mode without."""
    out = runs.comparison(star_questions(spark), star_examples(spark), catalog.of_tables(spark, d), runs.Config(generate=gold_answers))
    digits = {"recall": 6, "precision": 6, "prompt_tokens": 4}
    out = out.withColumns({f"{side}_avg_{c}": F.round(f"{side}_avg_{c}", n) for side in ("graph", "base") for c, n in digits.items()})
    return out.withColumns({f"delta_avg_{c}": F.round(f"delta_avg_{c}", {6: 4, 4: 2}[n]) for c, n in digits.items()})


def _ablation_sql() -> str:
    ks = [k for k in runs.SHOTS if k > 0]
    few = _FEW.replace("{ks}", ", ".join(f"({k})" for k in ks))
    tokens = f"""ks(k) AS (VALUES {', '.join(f'({k})' for k in runs.SHOTS)}),
tokens AS (SELECT ks.k, recall, precision, {_COUNT.format(_PROMPT)} AS tin, {_COUNT.format('a.sql')} AS tout FROM scored s JOIN asked a ON a.q_id = s.q_id JOIN ddl USING (p) CROSS JOIN ks LEFT JOIN few ON few.q_id = s.q_id AND few.k = ks.k),
m AS (SELECT k, round(avg(recall), 6) AS avg_recall, round(avg(precision), 6) AS avg_precision, round(avg(tin), 4) AS avg_prompt_tokens, round(avg(tout), 4) AS avg_output_tokens, round(avg(tin + tout), 4) AS avg_token_consumption, count(*) AS n_samples FROM tokens GROUP BY k)"""
    column = _column_mode(_ASKED, _ELEMENTS, _DDL.format(nodes="linked"), _SHOTS, few, tokens) + "SELECT 'column' AS mode, * FROM m"
    table = _table_mode(_ASKED, _ELEMENTS, _TABLE_DDL, _SHOTS, few, tokens) + "SELECT 'table' AS mode, * FROM m"
    return f"WITH a AS ({column}), b AS ({table}) SELECT * FROM a UNION ALL SELECT * FROM b"


@_query(_ablation_sql())
def ablation(spark, d):
    """Both modes with 0, 1, 3 and 5 examples."""
    return _rounded(runs.ablation(star_questions(spark), star_examples(spark), catalog.of_tables(spark, d), runs.Config(generate=gold_answers)))
