"""DDL, few-shot and prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The prompt's wording.
PROMPT_HEAD = "### Task\nGenerate a valid SQLite query to answer the following question.\n### Database Schema\n"
PROMPT_TAIL = (
    "\n### Instructions\n"
    "1. Only use the tables and columns provided in the schema above. DO NOT make up names.\n"
    "2. JOIN ALIASING (CRITICAL): If you use JOINs, you MUST explicitly declare table aliases in the FROM clause using `AS T1`, `AS T2`, etc.\n"
    "3. SINGLE TABLE RULES: If querying a single table (NO JOIN), DO NOT use any table aliases.\n"
    "4. ALWAYS use `COUNT(*)` instead of `COUNT(column)`.\n"
    "5. SET OPERATIONS: Use `INTERSECT` to find items matching two separate criteria. Use `EXCEPT` for exclusionary conditions.\n"
    "6. Output ONLY the raw SQL query. Do not add markdown or explanations.\n"
    "### Answer\n```sql\n"
)


def _listed(column: str) -> Column:
    """Texts of (ord, text) structs in order."""
    return F.transform(F.array_sort(column), lambda x: x["text"])


def _block(table: Column, lines: Column) -> Column:
    return F.concat(F.lit("CREATE TABLE "), table, F.lit(" (\n"), F.array_join(lines, ",\n"), F.lit("\n);\n"))


def column_ddl(selected: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(q_id, db_id, node_id) to q_id, ddl: the chosen columns of each table, tables and columns in catalogue order. A
    foreign key is shown where its edge leads to a primary key of another table, chosen or not."""
    from querylume.operators.graph import FOREIGN, both_ways

    mine = selected.select("q_id", "db_id", "node_id").distinct().join(nodes, ["db_id", "node_id"])
    text = F.concat(F.lit("    "), "column", F.lit(" "), "type", F.when(F.col("is_pk"), " PRIMARY KEY").otherwise(""))
    cols = mine.groupBy("q_id", "table").agg(F.collect_list(F.struct("ord", text.alias("text"))).alias("c"), F.min("ord").alias("first"))
    keys = nodes.where("is_pk").select("db_id", F.col("node_id").alias("dst"), F.col("table").alias("to_table"), F.col("column").alias("to_column"), F.col("ord").alias("to_ord"))
    fk = both_ways(edges.where(F.col("relation") == FOREIGN)).select("db_id", F.col("src").alias("node_id"), "dst").join(keys, ["db_id", "dst"])
    fk = mine.join(fk, ["db_id", "node_id"]).where("to_table <> table")
    line = F.concat(F.lit("    FOREIGN KEY ("), "column", F.lit(") REFERENCES "), "to_table", F.lit("("), "to_column", F.lit(")"))
    fks = fk.groupBy("q_id", "table").agg(F.collect_list(F.struct((F.col("ord") * 100_000 + F.col("to_ord")).alias("ord"), line.alias("text"))).alias("f"))
    both = cols.join(fks, ["q_id", "table"], "left")
    lines = F.concat(_listed("c"), F.coalesce(_listed("f"), F.array().cast("array<string>")))
    blocks = both.select("q_id", F.struct(F.col("first").alias("ord"), _block(F.col("table"), lines).alias("text")).alias("b"))
    return blocks.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["text"]), "\n").alias("ddl"))


def table_ddl(selected: DataFrame, catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """(q_id, db_id, table) to q_id, ddl: all columns of each table. A foreign key line stands in every table that has a
    column of the key's source name, and names the other end of the edge."""
    real = catalog.where("column <> '*'")
    text = F.concat(F.lit("    "), "column", F.lit(" "), "type", F.when(F.col("is_pk"), " PRIMARY KEY").otherwise(""))
    cols = real.groupBy("db_id", "table").agg(F.collect_list(F.struct(F.col("col_idx").alias("ord"), text.alias("text"))).alias("c"), F.collect_set("column").alias("names"), F.min("col_idx").alias("first"))
    ends = edges.select("db_id", F.regexp_replace("u", r"^[^.]*\.", "").alias("u"), F.regexp_replace("v", r"^[^.]*\.", "").alias("v"), "from_col", "to_col")
    there = ends.select("db_id", F.col("u").alias("table"), F.col("v").alias("other"), "from_col", "to_col").union(ends.where("u <> v").select("db_id", "v", "u", "from_col", "to_col"))
    line = F.concat(F.lit("    FOREIGN KEY ("), "from_col", F.lit(") REFERENCES "), "other", F.lit("("), "to_col", F.lit(")"))
    fks = there.join(cols, ["db_id", "table"]).where(F.array_contains("names", F.col("from_col")))
    fks = fks.groupBy("db_id", "table").agg(F.collect_list(F.struct(F.col("other").alias("ord"), line.alias("text"))).alias("f"))
    both = selected.select("q_id", "db_id", "table").distinct().join(cols, ["db_id", "table"]).join(fks, ["db_id", "table"], "left")
    lines = F.concat(_listed("c"), F.coalesce(_listed("f"), F.array().cast("array<string>")))
    blocks = both.select("q_id", F.struct(F.col("first").alias("ord"), _block(F.col("table"), lines).alias("text")).alias("b"))
    return blocks.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["text"]), "\n").alias("ddl"))


def few_shot_block(examples: DataFrame, keys: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """(keys, place, question, sql) to keys, block."""
    one = F.concat(F.lit("-- Example "), F.col("place").cast("string"), F.lit("\n-- Q: "), "question", F.lit("\n-- A:\n"), F.trim("sql"), F.lit("\n"))
    listed = examples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("ord"), one.alias("text")))).alias("e"))
    return listed.select(*keys, F.concat(F.lit("### Examples\n\n"), F.array_join(F.transform("e", lambda x: x["text"]), "\n"), F.lit("\n")).alias("block"))


def prompt(question: Column, ddl: Column, block: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), ddl, F.lit("\n"), F.coalesce(block, F.lit("")), F.lit("### Question\n"), question, F.lit(PROMPT_TAIL))


def flat_schema(catalog: DataFrame) -> DataFrame:
    """db_id, text: one 'Table:' and one 'Columns:' line a table, by name."""
    real = catalog.where("table <> 'ALL'")
    col = F.concat("column", F.lit(" ("), "type", F.lit(")"))
    tables = real.groupBy("db_id", "table").agg(F.array_sort(F.collect_list(F.struct(F.col("col_idx").alias("ord"), col.alias("text")))).alias("c"))
    tables = tables.select("db_id", F.struct(F.col("table").alias("ord"), F.concat(F.lit("Table: "), "table", F.lit("\nColumns: "), F.array_join(F.transform("c", lambda x: x["text"]), ", ")).alias("text")).alias("t"))
    return tables.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), "\n\n").alias("text"))
