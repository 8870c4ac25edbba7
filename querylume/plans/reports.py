"""Token, coverage and descriptive reports; ``documents`` and ``labels`` stand for training and development questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylume.functions import stats
from querylume.functions import text as T
from querylume.plans import schema
from querylume.sources import catalog
from querylume.sources.tables import table

QUERIES, ORACLE = {}, {}

SYSTEM_TOKENS, ALPHA, MU, SHOTS = 80, 1.0, 3, 3


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
_DESCRIBE = "count({0}) AS n, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, min({0}) AS least, round(quantile_cont({0}, 0.25), 4) AS q25, round(quantile_cont({0}, 0.5), 4) AS q50, round(quantile_cont({0}, 0.75), 4) AS q75, max({0}) AS most"
_PER_TABLE = "t AS (SELECT db_id, tbl, count(*) AS n_columns, count(fk_table) AS n_fk, count_if(is_pk) AS n_pk FROM catalog WHERE tbl <> 'ALL' GROUP BY 1, 2)"


def _per_table(spark, d):
    real = catalog.of_tables(spark, d).where("table <> 'ALL'")
    return real.groupBy("db_id", "table").agg(F.count("*").alias("n_columns"), F.count("fk_table").alias("n_fk"), F.count_if("is_pk").alias("n_pk"))


@_query(schema._with(_PER_TABLE) + "SELECT db_id, " + _DESCRIBE.format("n_columns") + " FROM t GROUP BY db_id")
def schema_describe(spark, d):
    return stats.describe(_per_table(spark, d), ["db_id"], "n_columns")


@_query(schema._with(_PER_TABLE) + "SELECT 'n_columns' AS a, 'n_fk' AS b, round(corr(n_columns, n_fk), 6) AS r FROM t UNION ALL SELECT 'n_columns', 'n_pk', round(corr(n_columns, n_pk), 6) FROM t UNION ALL SELECT 'n_fk', 'n_pk', round(corr(n_fk, n_pk), 6) FROM t")
def schema_corr(spark, d):
    pairs = [("n_columns", "n_fk"), ("n_columns", "n_pk"), ("n_fk", "n_pk")]
    one = _per_table(spark, d).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")) for a, b in pairs]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


#: Two-sided p-value of a correlation: Student's density, integrated by Simpson's rule.
_P_VALUE = """f AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS v FROM fit),
x AS (SELECT *, t * i / 2000 AS z, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM f, range(0, 2001) s(i)),
y AS (SELECT slope, intercept, r, n, round(1 - 2 * any_value(t) / 6000 * sum(w * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + z * z / v, -(v + 1) / 2)), 6) AS p FROM x GROUP BY 1, 2, 3, 4)"""


@_query(schema._with(_PER_TABLE, "fit AS (SELECT regr_slope(n_fk, n_columns) AS slope, regr_intercept(n_fk, n_columns) AS intercept, corr(n_fk, n_columns) AS r, count(*) AS n FROM t)", _P_VALUE) + "SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, n, p FROM y")
def tables_fk_fit(spark, d):
    return stats.fitted(_per_table(spark, d), "n_fk", "n_columns")


@_query(f"WITH w AS (SELECT item_id % 10 AS g, {_WORDS.format('text')} AS n_words, len(text) AS n_chars FROM benchmark), t AS (SELECT avg(n_words) AS x, avg(n_chars / n_words) AS y FROM w GROUP BY g), fit AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r, count(*) AS n FROM t), {_P_VALUE} SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, n, p FROM y")
def word_length_fit(spark, d):
    """Whether longer questions have longer words, over ten groups of them, with the p-value."""
    w = table(spark, d, "benchmark").select((F.col("item_id") % 10).alias("g"), T.word_count(F.col("text")).alias("n"), F.length("text").alias("c"))
    return stats.fitted(w.groupBy("g").agg(F.avg("n").alias("x"), F.avg(F.col("c") / F.col("n")).alias("y")), "y", "x")


@_query("SELECT lang, " + _DESCRIBE.format("n_chars") + " FROM documents GROUP BY lang")
def length_describe(spark, d):
    return stats.describe(table(spark, d, "documents"), ["lang"], "n_chars")


@_query(f"WITH w AS (SELECT n_chars, {_WORDS.format('text')} AS n_words FROM documents) SELECT round(regr_slope(n_words, n_chars), 6) AS slope, round(regr_intercept(n_words, n_chars), 4) AS intercept, round(corr(n_words, n_chars), 6) AS r, count(*) AS n FROM w")
def q_vs_sql_fit(spark, d):
    rows = table(spark, d, "documents").select("n_chars", T.word_count(F.col("text")).alias("n_words"))
    slope, intercept, r, n = stats.fit("n_words", "n_chars")
    return rows.agg(slope, F.round(F.regr_intercept("n_words", "n_chars"), 4).alias("intercept"), r, n)


@_query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def rank_top_dbs(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@_query(schema._with() + "SELECT db_id, count(DISTINCT tbl) AS n_tables FROM catalog WHERE tbl <> 'ALL' GROUP BY 1 ORDER BY n_tables DESC, db_id LIMIT 15")
def top_dbs_by_tables(spark, d):
    real = catalog.of_tables(spark, d).where("table <> 'ALL'")
    return real.groupBy("db_id").agg(F.count_distinct("table").alias("n_tables")).orderBy(F.desc("n_tables"), "db_id").limit(15)


@_query("SELECT (SELECT count(DISTINCT source) FROM documents) AS n_train, (SELECT count(DISTINCT source) FROM documents JOIN labels USING (doc_id)) AS n_dev, (SELECT count(*) FROM (SELECT source FROM documents INTERSECT SELECT source FROM documents JOIN labels USING (doc_id))) AS n_both")
def train_dev_overlap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    dev = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("source").distinct()
    train = docs.select("source").distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(train, "n_train").crossJoin(one(dev, "n_dev")).crossJoin(one(train.intersect(dev), "n_both"))  # single rows


@_query("SELECT CAST(floor(n_chars / 1000) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def histogram(spark, d):
    return table(spark, d, "documents").groupBy(F.floor(F.col("n_chars") / 1000).alias("bin")).agg(F.count("*").alias("n"))


@_query("SELECT split, source, count(*) AS n FROM (SELECT 'train' AS split, source FROM documents UNION ALL SELECT 'dev', source FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2")
def queries_per_db(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    dev = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    both = docs.withColumn("split", F.lit("train")).unionByName(dev.withColumn("split", F.lit("dev")))
    return both.groupBy("split", "source").agg(F.count("*").alias("n"))


_TOKENS = f"t AS (SELECT doc_id, source, quality, {_WORDS.format('text')} AS q, CAST(quality + 1 AS BIGINT) * 10 AS out FROM documents JOIN labels USING (doc_id))"


def _tokens(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "source", "quality", T.word_count(F.col("text")).alias("q"), ((F.col("quality") + 1) * 10).cast("long").alias("out"))


@_query(f"WITH {_TOKENS} SELECT doc_id, CAST(trunc(q + {ALPHA} * out) AS BIGINT) AS consumption FROM t")
def token_consumption(spark, d):
    return _tokens(spark, d).select("doc_id", (F.col("q") + ALPHA * F.col("out")).cast("long").alias("consumption"))


_BUDGET = f"""{_TOKENS}, s AS (SELECT source, count(DISTINCT lang) * 20 AS flat, count(DISTINCT lang) * 28 AS graph FROM documents GROUP BY 1), few AS (SELECT (avg(q) + avg(out)) * {SHOTS} AS f FROM t),
b AS (SELECT doc_id, quality, {SYSTEM_TOKENS} + flat + f + q AS t_flat, {SYSTEM_TOKENS} + graph + f + q AS t_graph, out FROM t LEFT JOIN s USING (source), few)"""


def _schema_tokens(spark, d):
    return table(spark, d, "documents").groupBy("source").agg((F.count_distinct("lang") * 20).alias("flat"), (F.count_distinct("lang") * 28).alias("graph"))


def _budget(spark, d):
    t, s = _tokens(spark, d), _schema_tokens(spark, d)
    few = t.agg(((F.avg("q") + F.avg("out")) * SHOTS).alias("f"))
    b = t.join(s, "source", "left").crossJoin(F.broadcast(few))  # one row
    base = F.lit(SYSTEM_TOKENS) + F.col("f") + F.col("q")
    return b.select("doc_id", "quality", (base + F.col("flat")).alias("t_flat"), (base + F.col("graph")).alias("t_graph"), "out")


@_query(f"WITH {_BUDGET} SELECT doc_id, round(t_flat, 4) AS t_flat, round(t_graph, 4) AS t_graph, round(t_graph + {MU} * out, 4) AS tc_graph, round(t_graph - t_flat, 4) AS overhead, round((t_graph - t_flat) / t_flat * 100, 4) AS overhead_pct, round((t_graph - t_flat) / (t_flat + {MU} * out) * 100, 4) AS delta_pct FROM b")
def token_budget(spark, d):
    f, g, o = F.col("t_flat"), F.col("t_graph"), MU * F.col("out")
    r = lambda c, n: F.round(c, 4).alias(n)
    return _budget(spark, d).select("doc_id", r(f, "t_flat"), r(g, "t_graph"), r(g + o, "tc_graph"), r(g - f, "overhead"), r(F.try_divide(g - f, f) * 100, "overhead_pct"), r(F.try_divide(g - f, f + o) * 100, "delta_pct"))


@_query(f"WITH {_BUDGET} SELECT quality, round(avg(t_flat), 4) AS t_flat, round(avg(t_graph), 4) AS t_graph, count(*) AS n FROM b GROUP BY quality")
def token_by_difficulty(spark, d):
    return _budget(spark, d).groupBy("quality").agg(F.round(F.avg("t_flat"), 4).alias("t_flat"), F.round(F.avg("t_graph"), 4).alias("t_graph"), F.count("*").alias("n"))


@_query(f"""WITH {_BUDGET}, a AS (SELECT avg(flat) AS fl, avg(graph) AS gr, avg(q) AS q, any_value(f) AS few FROM t LEFT JOIN s USING (source), few),
c AS (SELECT 'system' AS component, {SYSTEM_TOKENS}::DOUBLE AS flat, {SYSTEM_TOKENS}::DOUBLE AS graph FROM a UNION ALL SELECT 'schema', fl, gr FROM a UNION ALL SELECT 'few-shot', few, few FROM a UNION ALL SELECT 'question', q, q FROM a),
w AS (SELECT * FROM c UNION ALL SELECT 'total', sum(flat), sum(graph) FROM c)
SELECT component, round(flat, 4) AS flat, round(graph, 4) AS graph, round(graph - flat, 4) AS delta, round((graph - flat) / flat * 100, 4) AS delta_pct FROM w""")
def token_composition(spark, d):
    """Mean tokens of a prompt by component, with flat and graph schemas, and their sums."""
    t, s = _tokens(spark, d), _schema_tokens(spark, d)
    one = t.join(s, "source", "left").agg(F.avg("flat").alias("fl"), F.avg("graph").alias("gr"), F.avg("q").alias("q"), ((F.avg("q") + F.avg("out")) * SHOTS).alias("few"))
    system = F.lit(float(SYSTEM_TOKENS))
    parts = [("system", system, system), ("schema", F.col("fl"), F.col("gr")), ("few-shot", F.col("few"), F.col("few")), ("question", F.col("q"), F.col("q"))]
    total = ("total", sum((f for _, f, _ in parts[1:]), system), sum((g for _, _, g in parts[1:]), system))
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("component"), f.alias("f"), g.alias("g")) for n, f, g in [*parts, total]])))
    f, g = F.col("f"), F.col("g")
    return rows.select("component", F.round(f, 4).alias("flat"), F.round(g, 4).alias("graph"), F.round(g - f, 4).alias("delta"), F.round((g - f) / f * 100, 4).alias("delta_pct"))


@_query(f"WITH {_BUDGET}, a AS (SELECT round(avg(t_flat), 4) AS t_flat, round(avg(t_graph), 4) AS t_graph, round(avg(out), 4) AS t_out FROM b) UNPIVOT a ON COLUMNS(*) INTO NAME part VALUE tokens")
def melt_tokens(spark, d):
    wide = _budget(spark, d).agg(*[F.round(F.avg(c), 4).alias(n) for c, n in (("t_flat", "t_flat"), ("t_graph", "t_graph"), ("out", "t_out"))])
    return wide.unpivot([], ["t_flat", "t_graph", "t_out"], "part", "tokens")


@_query("SELECT CAST(i AS INTEGER) AS i, round(-0.2 + 0.4 * i / 99, 6) AS d_ex, round((-0.2 + 0.4 * i / 99) / 0.5 / 0.3, 6) AS tep FROM range(0, 100) r(i)")
def tep(spark, d):
    """Token elasticity: the relative gain in execution accuracy over the relative growth of tokens, along a curve of
    simulated gains with a base accuracy of 0.5 and 30 % more tokens."""
    gain = F.lit(-0.2) + F.lit(0.4) * F.col("i") / 99
    return spark.range(100).select(F.col("id").cast("int").alias("i")).select("i", F.round(gain, 6).alias("d_ex"), F.round(gain / 0.5 / 0.3, 6).alias("tep"))


@_query("""WITH s AS (SELECT source, count(DISTINCT lang) AS n_tables, count(*) AS n FROM documents GROUP BY 1)
SELECT CAST(k AS INTEGER) AS k, round(avg((n_tables <= k)::INT) * 100, 4) AS pct_dbs, round(sum(CASE WHEN n_tables <= k THEN n ELSE 0 END) * 100.0 / sum(n), 4) AS pct_queries FROM s, range(1, 11) r(k) GROUP BY k""")
def coverage_curve(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n_tables"), F.count("*").alias("n"))
    ks = spark.range(1, 11).select(F.col("id").cast("int").alias("k"))
    fits = F.col("n_tables") <= F.col("k")
    out = s.crossJoin(F.broadcast(ks)).groupBy("k")  # ten rows
    return out.agg(F.round(F.avg(fits.cast("int")) * 100, 4).alias("pct_dbs"), F.round(F.sum(F.when(fits, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 4).alias("pct_queries"))


@_query(f"""WITH dev AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id)), train AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'es' GROUP BY 1)
SELECT source, coalesce(n, 0) AS n_same, coalesce(n, 0) >= {SHOTS} AS enough, least(coalesce(n, 0), {SHOTS}) AS own, greatest(0, {SHOTS} - coalesce(n, 0)) AS others FROM dev LEFT JOIN train USING (source)""")
def fewshot_availability(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    dev = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("source").distinct()
    train = docs.where("lang = 'es'").groupBy("source").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    k = F.lit(SHOTS).cast("long")
    return dev.join(train, "source", "left").select("source", n.alias("n_same"), (n >= k).alias("enough"), F.least(n, k).alias("own"), F.greatest(F.lit(0).cast("long"), k - n).alias("others"))


@_query("SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, round(avg(n_chars), 4) AS mean_chars, round(stddev_samp(n_chars), 4) AS std_chars, round(avg((lang = 'en')::INT) * 100, 4) AS pct_en, median(n_chars) AS median_chars FROM documents")
def eda_summary(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.stddev_samp("n_chars"), 4).alias("std_chars"), F.round(F.avg((F.col("lang") == "en").cast("int")) * 100, 4).alias("pct_en"), F.median("n_chars").alias("median_chars"))
