"""Schema catalogues: one row per column.

Columns: db_id, col_idx (position in the catalogue, 0 the wildcard), table_idx (-1 the wildcard), table, column, type,
is_pk, fk_table, fk_column. Of several foreign keys of a column the last counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querylume.sources.discovery import keys_of
from querylume.sources.tables import table

ANY_TABLE, ANY_COLUMN = "ALL", "*"
FLAT = "db_id string, col_idx int, table_idx int, table string, column string, type string, is_pk boolean, fk_table string, fk_column string"
RAW = T.StructType([
    T.StructField("db_id", T.StringType()),
    *[T.StructField(k, T.ArrayType(T.StringType())) for k in ("table_names_original", "table_names", "column_types")],
    *[T.StructField(k, T.ArrayType(T.ArrayType(T.StringType()))) for k in ("column_names_original", "column_names")],
    T.StructField("primary_keys", T.ArrayType(T.LongType())),
    T.StructField("foreign_keys", T.ArrayType(T.ArrayType(T.LongType()))),
])


def read_catalog(spark: SparkSession, path: str, original_names: bool = True) -> DataFrame:
    """A catalogue file: a JSON array of databases. With ``original_names`` false, the normalised names are taken."""
    return flatten(spark.read.schema(RAW).json(path, multiLine=True), original_names)


def flatten(raw: DataFrame, original_names: bool = True) -> DataFrame:
    tail = "_original" if original_names else ""
    tables, columns = f"table_names{tail}", f"column_names{tail}"
    one = raw.select("db_id", F.col(tables).alias("_t"), F.col(columns).alias("_c"), "column_types", "primary_keys", "foreign_keys")
    # the last pair of a source column wins: a map by source, built from the reversed list's first
    fk = F.map_from_entries(F.transform(F.array_distinct(F.transform("foreign_keys", lambda p: p[0])), lambda s: F.struct(s, F.element_at(F.filter("foreign_keys", lambda p: p[0] == s), -1)[1])))
    out = one.withColumn("_fk", fk).select("*", F.posexplode("_c").alias("col_idx", "_pair"))
    place = F.col("_pair")[0].cast("int")
    name_of = lambda i: F.when(i >= 0, F.get("_t", i)).otherwise(F.lit(ANY_TABLE))
    target = F.col("_fk")[F.col("col_idx").cast("long")]
    to = F.get("_c", target.cast("int"))
    return out.select(
        "db_id", "col_idx", place.alias("table_idx"), name_of(place).alias("table"), F.col("_pair")[1].alias("column"),
        F.coalesce(F.get("column_types", F.col("col_idx")), F.lit("")).alias("type"),
        F.coalesce(F.array_contains("primary_keys", F.col("col_idx").cast("long")), F.lit(False)).alias("is_pk"),
        F.when(target.isNotNull(), name_of(to[0].cast("int"))).alias("fk_table"), F.when(target.isNotNull(), to[1]).alias("fk_column"),
    )


def read_table_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The alternative form: a JSON array of tables with ``col_data``; (table, col_idx, column), lower-cased."""
    schema = "table string, col_data array<struct<column_name:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.lower("table").alias("table"), F.posexplode("col_data").alias("col_idx", "_c")).select("table", "col_idx", F.lower("_c.column_name").alias("column"))


#: What a catalogue calls a column's type; all others are text.
_TYPES = {**dict.fromkeys(("tinyint", "smallint", "int", "bigint", "float", "double"), "number"), "date": "time", "timestamp": "time", "timestamp_ntz": "time", "boolean": "boolean"}


def _type(kind: str) -> str:
    return "number" if kind.startswith("decimal") else _TYPES.get(kind, "text")


def rows_of_tables(tables: dict[str, DataFrame], db_id: str, type_of: Callable[[str], str] = _type) -> list[tuple]:
    """A database's catalogue rows from its tables alone, lower-cased: columns and types from their schemas, keys from
    their rows (see ``discovery``). ``type_of`` gives a column's type from Spark's name of it."""
    primary, foreign = keys_of(tables)
    rows = [(db_id, 0, -1, ANY_TABLE, ANY_COLUMN, "text", False, None, None)]
    for i, (name, df) in enumerate(tables.items()):
        for f in df.schema:
            to = foreign.get((name, f.name), (None, None))
            rows.append((db_id, len(rows), i, name.lower(), f.name.lower(), type_of(f.dataType.simpleString()), primary.get(name) == f.name, *[x and x.lower() for x in to]))
    return rows


def from_session(spark: SparkSession, tables: list[str], db_id: str = "session") -> DataFrame:
    """The catalogue of the session's tables or views, with their keys, and types as Spark names them."""
    return spark.createDataFrame(rows_of_tables({t: spark.table(t) for t in tables}, db_id, str), FLAT)


_found: dict[tuple[str, str], list[tuple]] = {}


def of_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue of the databases whose tables lie in ``folder``, found in their rows; once for each application."""
    key = spark.sparkContext.applicationId, folder
    if key not in _found:
        _found[key] = [r for db, names in DATABASES.items() for r in rows_of_tables({n: table(spark, folder, n) for n in names}, db)]
    return spark.createDataFrame(_found[key], FLAT)


def compatibility_view(flat: DataFrame) -> DataFrame:
    """Database, Table, Column, Type, PK ('Yes', 'No'), FK_Relation ('table.column' or '-')."""
    relation = F.coalesce(F.concat_ws(".", F.col("fk_table"), F.when(F.col("fk_table").isNotNull(), F.col("fk_column"))), F.lit(""))
    return flat.select(F.col("db_id").alias("Database"), F.col("table").alias("Table"), F.col("column").alias("Column"), F.col("type").alias("Type"), F.when(F.col("is_pk"), "Yes").otherwise("No").alias("PK"), F.when(relation == "", "-").otherwise(relation).alias("FK_Relation"))


def from_compatibility_view(view: DataFrame) -> DataFrame:
    """Back from the sentinels to nulls. A relation that isn't two parts joined by a dot has no target."""
    parts = F.split("FK_Relation", r"\.")
    good = (F.col("FK_Relation") != "-") & (F.size(parts) == 2)
    return view.select(F.col("Database").alias("db_id"), F.trim("Table").alias("table"), F.trim("Column").alias("column"), F.col("Type").alias("type"), (F.col("PK") == "Yes").alias("is_pk"), F.when(good, F.trim(parts[0])).alias("fk_table"), F.when(good, F.trim(parts[1])).alias("fk_column"))


# The catalogue of the test tables as it is known: name, type, then 'pk' or the key's target. ``of_tables`` finds the same.
STAR = {
    "region": "r_regionkey:number:pk r_name:text",
    "nation": "n_nationkey:number:pk n_name:text n_regionkey:number:region.r_regionkey",
    "customer": "c_custkey:number:pk c_name:text c_nationkey:number:nation.n_nationkey c_acctbal:number c_mktsegment:text",
    "supplier": "s_suppkey:number:pk s_name:text s_nationkey:number:nation.n_nationkey s_acctbal:number",
    "part": "p_partkey:number:pk p_name:text p_brand:text p_type:text p_size:number p_retailprice:number",
    "orders": "o_orderkey:number:pk o_custkey:number:customer.c_custkey o_orderstatus:text o_totalprice:number o_orderdate:time o_orderpriority:text",
    "lineitem": "l_orderkey:number:orders.o_orderkey l_partkey:number:part.p_partkey l_suppkey:number:supplier.s_suppkey l_linenumber:number l_quantity:number l_extendedprice:number l_discount:number l_tax:number l_returnflag:text l_linestatus:text l_shipdate:time",
}
CORPUS = {
    "documents": "doc_id:number:pk text:text lang:text source:text n_chars:number",
    "labels": "doc_id:number:pk+documents.doc_id quality:number toxic:number",
    "conversations": "conv_id:number turn:number role:text text:text",
    "events": "event_id:number:pk ts:time user_id:number event_type:text value:number props:text",
}
DATABASES = {"star": STAR, "corpus": CORPUS}


def declared_rows(databases: dict[str, dict[str, str]] = DATABASES) -> list[tuple]:
    rows = []
    for db, tables in databases.items():
        rows.append((db, 0, -1, ANY_TABLE, ANY_COLUMN, "text", False, None, None))
        at = 0
        for i, (name, columns) in enumerate(tables.items()):
            for spec in columns.split():
                column, kind, *keys = spec.split(":")
                marks = keys[0].split("+") if keys else []
                to = next((m.split(".") for m in marks if "." in m), [None, None])
                at += 1
                rows.append((db, at, i, name, column, kind, "pk" in marks, *to))
    return rows


def declared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(declared_rows(), FLAT)


def declared_sql() -> str:
    """The same rows as a common table expression named catalog."""
    show = lambda x: "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else f"'{x}'"
    values = ",\n".join("(" + ", ".join(map(show, r)) + ")" for r in declared_rows())
    return f"catalog(db_id, col_idx, table_idx, tbl, col, typ, is_pk, fk_table, fk_column) AS (VALUES {values})"
