"""Quantiles, densities, box fences and inequality joins over the star tables and documents; question files over
benchmark; word vectors over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from querylume.functions import embedding, stats
from querylume.functions.vectors import top_k
from querylume.operators import inequality
from querylume.operators.storage import frozen, numbered, shared_dir
from querylume.sources import files, json_array
from querylume.sources.tables import table

QUERIES, ORACLE = {}, {}

_PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def _listed(spark, d, name, by, value):
    out = stats.quantiles(table(spark, d, name), [by], value, _PROBABILITIES)
    return out.select(by, *[F.round(F.col("q")[i], 4).alias(f"q{int(p * 100)}") for i, p in enumerate(_PROBABILITIES)])


def _quantile_sql(name: str, by: str, value: str) -> str:
    return f"SELECT {by}, " + ", ".join(f"round(quantile_cont({value}, {p}), 4) AS q{int(p * 100)}" for p in _PROBABILITIES) + f" FROM {name} WHERE {value} IS NOT NULL GROUP BY {by}"


@_query(_quantile_sql("lineitem", "l_returnflag", "l_extendedprice"))
def price_quantiles(spark, d):
    """Groups of many values, refined bracket by bracket."""
    return _listed(spark, d, "lineitem", "l_returnflag", "l_extendedprice")


@_query(_quantile_sql("lineitem", "l_partkey", "l_extendedprice"))
def part_quantiles(spark, d):
    """Many groups of few values."""
    return _listed(spark, d, "lineitem", "l_partkey", "l_extendedprice")


@_query(_quantile_sql("documents", "lang", "n_chars"))
def length_quantiles(spark, d):
    return _listed(spark, d, "documents", "lang", "n_chars")


_MOMENTS = "count(*) AS n, stddev_samp(v) AS s, min(v) AS a, max(v) AS b"


@_query(f"""WITH t AS (SELECT lang, ln(1 + n_chars) AS v FROM documents), m AS (SELECT lang, {_MOMENTS} FROM t GROUP BY lang),
g AS (SELECT lang, n, s * pow(n, -0.2) AS h, a, b, i FROM m, range(0, 40) r(i) WHERE b > a),
x AS (SELECT *, a - 3 * h + i * (b - a + 6 * h) / 39 AS x FROM g)
SELECT lang, CAST(i AS BIGINT) AS i, round(any_value(x), 4) AS x, round(sum(exp(-0.5 * pow((x - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 4) AS density FROM x JOIN t USING (lang) GROUP BY lang, i""")
def length_density(spark, d):
    """The density of the logarithm of texts' lengths in each language."""
    rows = table(spark, d, "documents").select("lang", F.log(1 + F.col("n_chars")).alias("v"))
    return stats.density(rows, ["lang"], "v", 40).select("lang", "i", F.round("x", 4).alias("x"), F.round("density", 4).alias("density"))


@_query("""WITH q AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.75) AS q75 FROM documents GROUP BY lang),
t AS (SELECT lang, n_chars::DOUBLE AS v, q.*, n_chars BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM documents JOIN q USING (lang))
SELECT lang, any_value(q25) AS q25, any_value(q50) AS q50, any_value(q75) AS q75, min(v) FILTER (WHERE inside) AS low, max(v) FILTER (WHERE inside) AS high, count(*) FILTER (WHERE NOT inside) AS n_outliers FROM t GROUP BY lang""")
def box_fences(spark, d):
    return stats.box(table(spark, d, "documents"), ["lang"], "n_chars")


@_query("""SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderdate < l_shipdate AND o_totalprice < l_extendedprice GROUP BY 1""")
def theta_counts(spark, d):
    """Pairs of any order with any line item that is shipped later and costs more than all of the order: no equality."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    n = inequality.match_counts(orders, items, (F.col("o_orderkey"), at("o_orderdate"), F.col("o_totalprice")), (F.col("l_orderkey"), at("l_shipdate"), F.col("l_extendedprice")))
    return orders.join(n, orders["o_orderkey"] == n["id"]).groupBy("o_orderpriority").agg(F.sum("n").alias("n"))


@_query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey < b.s_nationkey AND a.s_acctbal > b.s_acctbal""")
def theta_pairs(spark, d):
    """Pairs of suppliers, the first with a smaller nation key and a larger balance."""
    s = table(spark, d, "supplier")
    keys = F.col("s_suppkey"), F.col("s_nationkey"), -F.col("s_acctbal")
    return inequality.match_pairs(s, s, keys, keys).toDF("a", "b")


@_query(r"SELECT row_number() OVER (ORDER BY item_id) - 1 AS line_no, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM benchmark")
def prediction_lines(spark, d):
    """Every text written as a line, in the order of ids and by as many tasks as there are ranges, and read back in order."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    files.write_lines(table(spark, d, "benchmark"), path, "text", "item_id")
    return files.read_lines(spark, path).withColumnRenamed("value", "line")


@_query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, lang, md5(text) AS text_md5, source FROM documents")
def question_array(spark, d):
    """All documents written as one JSON array in parts, which is read back in ranges and cut into records."""
    path = f"{shared_dir(spark)}/array-{uuid.uuid4().hex}"
    json_array.write_array(table(spark, d, "documents").select("doc_id", "lang", "text", "source"), path, "doc_id")
    return files.read_questions(spark, path).select("idx", "doc_id", "lang", F.md5("text").alias("text_md5"), "source")


_NEAR = r"""WITH t AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM t) GROUP BY word), voc AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS pos FROM c QUALIFY pos < 400),
p AS (SELECT unnest(list_zip(w[1:len(w) - o], w[1 + o:len(w)])) AS p FROM t, (VALUES (1), (2)) s(o)), k AS (SELECT x.pos AS a, y.pos AS b FROM p JOIN voc x ON x.word = p[1] JOIN voc y ON y.word = p[2]),
m AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM k UNION ALL SELECT b, a FROM k) WHERE b < 50 GROUP BY 1, 2),
i AS (SELECT a, b, ln(n * (sum(n) OVER ()) / ((sum(n) OVER (PARTITION BY a))::DOUBLE * (sum(n) OVER (PARTITION BY b)))) AS ppmi FROM m)
SELECT x.word AS word, y.word AS context, round(ppmi, 6) AS ppmi FROM i JOIN voc x ON x.pos = a JOIN voc y ON y.pos = b WHERE ppmi > 0"""


@_query(_NEAR)
def word_information(spark, d):
    """Pointwise mutual information of the most frequent words of all documents and the words near them."""
    docs = table(spark, d, "documents")
    words = frozen(embedding.vocabulary_of(docs, most=400), "vocabulary")
    cells = embedding.information(docs, words, contexts=50)
    name = lambda c, n: F.broadcast(words.select(F.col("word").alias(n), F.col("at").alias(c)))  # noqa: E731  400 words
    return cells.join(name("a", "word"), "a").join(name("b", "context"), "b").select("word", "context", F.round("ppmi", 6).alias("ppmi"))


def word_neighbors(spark, d):
    """The three words nearest to each of the most frequent words, by vectors learned from all documents. SQL can't factor a
    matrix; the vectors are tested against a dense decomposition."""
    docs = table(spark, d, "documents")
    words = frozen(embedding.vocabulary_of(docs, most=5000), "vocabulary")
    vectors = embedding.learn(docs, contexts=500, words=words)
    items = numbered(vectors, "id", "word", what="word-items").select("id", "word", F.lit(0).cast("long").alias("grp"), F.col("vector").alias("emb"))
    near = top_k(items.join(words.where("at < 100").select("word"), "word", "left_semi"), items, 3)
    name = lambda c: items.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    return near.join(name("word"), F.col("q_id") == F.col("word_id")).join(name("near"), F.col("id") == F.col("near_id")).select("word", "rank", "near", F.round("score", 4).alias("score"))


QUERIES["word_neighbors"] = word_neighbors
