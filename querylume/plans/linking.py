"""Vector retrieval and linking queries over ``embeddings``; the label stands for a database."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylume.functions.vectors import top_k, top_k_by_pivots
from querylume.operators import linking
from querylume.sources.tables import table

QUERIES, ORACLE = {}, {}

GRID_TABLES, GRID_COLUMNS = (1, 2, 3), (1, 3, 5, 7, 10)


def _query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


_SQL = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.label AS q_id, q.vec_id AS phrase, e.vec_id AS name, e.vec_id % 7 AS tbl, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id)"""


def _sides(spark, d, every=100):
    """Phrases (every vector whose id is divisible by ``every``) and the columns of their database; none meets itself."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("db_id"), "vec_id", F.col("vec_id").alias("self"), F.col("embedding").alias("emb"))
    phrases = e.where(f"vec_id % {every} = 0").select("db_id", F.col("db_id").alias("q_id"), F.col("vec_id").alias("phrase"), "self", "emb")
    return phrases, e.select("db_id", F.col("vec_id").alias("name"), (F.col("vec_id") % 7).alias("table"), F.col("vec_id").alias("ord"), "self", "emb")


def _tables(phrases, columns, k):
    """Tables by the vectors of their columns."""
    return linking.candidate_tables(phrases, columns.select("db_id", F.col("table").alias("name"), F.col("table").alias("ord"), "self", "emb"), k)


@_query(_SQL + " SELECT phrase, name, round(score, 6) AS score FROM s")
def cosine_pairs(spark, d):
    return linking.nearest(*_sides(spark, d), 0).select("phrase", "name", F.round("score", 6).alias("score"))


@_query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS q_id, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 12) AS score
FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) SELECT q_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def topk_neighbors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("emb"))
    return top_k(e.where("id % 100 = 0"), e, 10).select("q_id", "id", F.round("score", 6).alias("score"), "rank")


@_query(ORACLE["topk_neighbors"])
def pivot_neighbors(spark, d):
    """The same neighbours by pivots, which pass over blocks that are too far."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("emb"))
    return top_k_by_pivots(e.where("id % 100 = 0"), e, 10).select("q_id", "id", F.round("score", 6).alias("score"), "rank")


@_query(_SQL + ", t AS (SELECT q_id, tbl, max(score) AS score FROM s GROUP BY 1, 2) SELECT q_id, tbl, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY t.score DESC, tbl) AS INTEGER) AS rank FROM t QUALIFY rank <= 3")
def maxpool_topk(spark, d):
    return _tables(*_sides(spark, d), 3).select("q_id", F.col("name").alias("tbl"), F.round("score", 6).alias("score"), "rank")


@_query(_SQL.replace("% 100", "% 5") + ", b AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, name) AS r FROM s) SELECT phrase, name FROM b WHERE r = 1 AND score > 0.35")
def threshold_argmax(spark, d):
    best = linking.nearest(*_sides(spark, d, 5), 1)
    return best.where(F.col("score") > linking.THRESHOLD).select("phrase", "name")


@_query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS q_id, q.label AS ql, e.vec_id AS id, e.label, round(list_cosine_similarity(q.v, e.v), 12) AS score
FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id), p AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS r FROM s QUALIFY r <= 12)
SELECT q_id, id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY (ql <> label)::INT, r) AS INTEGER) AS place FROM p QUALIFY place <= 3""")
def fewshot_same_group_first(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("emb"))
    return linking.same_group_first(top_k(e.where("id % 100 = 0"), e, 12), 3).select("q_id", "id", "place")


_STAGES = """, t AS (SELECT q_id, tbl, max(score) AS score FROM s GROUP BY 1, 2), r AS (SELECT q_id, tbl, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, tbl) AS tr FROM t),
g AS (SELECT s.*, kt, row_number() OVER (PARTITION BY kt, s.q_id, phrase ORDER BY score DESC, name) AS cr FROM s JOIN r ON s.q_id = r.q_id AND s.tbl = r.tbl JOIN (VALUES (1), (2), (3)) k(kt) ON tr <= kt)"""


@_query(_SQL + _STAGES + " SELECT DISTINCT q_id, tbl, name FROM g WHERE kt = 2 AND cr <= 3")
def two_stage_retrieval(spark, d):
    sides = _sides(spark, d)
    return linking.candidate_columns(*sides, _tables(*sides, 2), 3).select("q_id", F.col("table").alias("tbl"), "name")


_SWEEP = _SQL + _STAGES + """, c AS (SELECT DISTINCT kt, kc, q_id, name FROM g JOIN (VALUES (1), (3), (5), (7), (10)) k(kc) ON cr <= kc),
gold AS (SELECT label AS q_id, vec_id AS name FROM e WHERE vec_id % 4 = 0 AND label IN (SELECT label FROM q)), n AS (SELECT q_id, count(*) AS n FROM gold GROUP BY 1),
m AS (SELECT kt, kc, c.q_id, count(gold.name) / any_value(n.n) AS recall, count(gold.name) / count(*) AS precision FROM c JOIN n ON n.q_id = c.q_id LEFT JOIN gold ON gold.q_id = c.q_id AND gold.name = c.name GROUP BY 1, 2, 3),
a AS (SELECT kt, kc, avg(recall) AS r, avg(precision) AS p, count(*) AS n FROM m GROUP BY 1, 2),
f AS (SELECT kt, kc, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END, 6) AS f1, round(CASE WHEN 36 * p + r = 0 THEN 0 ELSE 37 * p * r / (36 * p + r) END, 6) AS f6, r >= 0.9 AS meets, n FROM a)"""


def _sweep(spark, d):
    """All grid points from one scoring: columns are ranked once per table count, and each point is a filter on ranks."""
    phrases, columns = _sides(spark, d)
    kc = spark.createDataFrame([(k,) for k in GRID_COLUMNS], "kc int")
    best = linking.nearest(phrases, columns, max(GRID_COLUMNS), _tables(phrases, columns, max(GRID_TABLES)), GRID_TABLES).withColumnRenamed("cut", "kt")
    found = best.join(F.broadcast(kc), F.col("rank") <= F.col("kc")).select("kt", "kc", "q_id", "name").distinct()
    asked = phrases.select("q_id").distinct()
    gold = table(spark, d, "embeddings").where("vec_id % 4 = 0").select(F.col("label").alias("q_id"), F.col("vec_id").alias("name")).join(asked, "q_id", "left_semi")
    n = gold.groupBy("q_id").agg(F.count("*").alias("n_gold"))
    met = found.join(gold.withColumn("hit", F.lit(1)), ["q_id", "name"], "left").groupBy("kt", "kc", "q_id").agg(F.count("hit").alias("h"), F.count("*").alias("k"))
    per = met.join(n, "q_id").select("kt", "kc", (F.col("h") / F.col("n_gold")).alias("r"), (F.col("h") / F.col("k")).alias("p"))
    mean = per.groupBy("kt", "kc").agg(F.avg("r").alias("r"), F.avg("p").alias("p"), F.count("*").alias("n"))
    r, p = F.col("r"), F.col("p")
    return mean.select("kt", "kc", F.round(r, 6).alias("recall"), F.round(p, 6).alias("precision"), F.round(linking.f1(r, p), 6).alias("f1"), F.round(linking.f6(r, p), 6).alias("f6"), (r >= 0.9).alias("meets"), "n")


@_query(_SWEEP + " SELECT * FROM f")
def sweep_grid(spark, d):
    return _sweep(spark, d)


@_query(_SWEEP + " SELECT kt, kc, f6 FROM f ORDER BY f6 DESC, kt, kc LIMIT 1")
def sweep_best(spark, d):
    return _sweep(spark, d).orderBy(F.desc("f6"), "kt", "kc").limit(1).select("kt", "kc", "f6")


_NAMES = "list_distinct(list('c' || {} % 5) FILTER (WHERE {}))"


@_query(f"""WITH r AS (SELECT l_orderkey AS q_id, {_NAMES.format('l_partkey', 'l_quantity > 25')} AS g, {_NAMES.format('l_suppkey', 'l_quantity < 20')} AS r FROM lineitem GROUP BY 1),
n AS (SELECT q_id, coalesce(g, []) AS g, coalesce(r, []) AS r FROM r)
SELECT q_id, round(CASE WHEN len(g) = 0 THEN 1 ELSE len(list_intersect(g, r)) / len(g) END, 6) AS recall, round(CASE WHEN len(g) = 0 THEN 1 WHEN len(r) = 0 THEN 0 ELSE len(list_intersect(g, r)) / len(r) END, 6) AS precision FROM n""")
def linking_recall_precision(spark, d):
    """Orders stand for questions, some without gold elements and some for which nothing is retrieved."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q_id"), "l_quantity", *[F.concat(F.lit("c"), (F.col(c) % 5).cast("string")).alias(c) for c in ("l_partkey", "l_suppkey")])
    of = lambda c, where: F.collect_set(F.when(where, F.col(c))).alias("elements")
    gold = rows.groupBy("q_id").agg(of("l_partkey", F.col("l_quantity") > 25))
    found = rows.groupBy("q_id").agg(of("l_suppkey", F.col("l_quantity") < 20)).where(F.size("elements") > 0)
    return linking.recall_precision(gold, found).select("q_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))
