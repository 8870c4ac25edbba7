"""Questions with gold SQL, and few-shot examples, on the declared databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUESTIONS = [
    (0, "star", "What is the name of each customer in the building market segment?", "SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    (1, "star", "How many orders has every customer nation?", "SELECT T2.c_nationkey, count(*) FROM orders AS T1 JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey GROUP BY T2.c_nationkey"),
    (2, "star", "List the brand and size of all parts by retail price.", "SELECT p_brand, p_size FROM part ORDER BY p_retailprice"),
    (3, "corpus", "Which labels are toxic?", "SELECT doc_id FROM labels WHERE toxic = 1"),
    (4, "star", "Name the region of every nation.", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    (5, "star", "What is the largest discount of a lineitem?", "SELECT max(l_discount) FROM lineitem"),
    (6, "corpus", "How many documents are there in each lang and source?", "SELECT lang, source, count(*) FROM documents GROUP BY lang, source"),
    (7, "star", "Which supplier s_name has a negative s_acctbal?", "SELECT s_name FROM supplier WHERE s_acctbal < 0"),
    (8, "corpus", "Show the event type and value of events by user.", "SELECT event_type, value FROM events ORDER BY user_id"),
    (9, "star", "???", "SELECT 1"),
    (10, "star", "What is the total quantity of lineitem by order priority?", "SELECT o_orderpriority, sum(l_quantity) FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority"),
    (11, "corpus", "Which role wrote the text of a conversation's first turn?", "SELECT role, text FROM conversations WHERE turn = 0"),
]
EXAMPLES = [
    (0, "star", "How many nations are there?", "SELECT count(*) FROM nation"),
    (1, "star", "What is the largest part size?", "SELECT max(p_size) FROM part"),
    (2, "corpus", "How many documents are there?", "SELECT count(*) FROM documents"),
    (3, "corpus", "Which users have events?", "SELECT DISTINCT user_id FROM events"),
    (4, "star", "List the name of every customer by nation.", "SELECT c_name FROM customer ORDER BY c_nationkey"),
    (5, "corpus", "How many labels are toxic?", " SELECT count(*) FROM labels WHERE toxic = 1 "),
    (6, "star", "What is the average discount of a lineitem?", "SELECT avg(l_discount) FROM lineitem"),
    (7, "corpus", "What is the longest conversation?", "SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY count(*) DESC LIMIT 1"),
]


def star_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "q_id long, db_id string, question string, sql string")


def star_examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLES, "id long, db_id string, question string, sql string")


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """The rows as a common table expression; whole numbers are BIGINT."""
    show = lambda x: f"{x}::BIGINT" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"
