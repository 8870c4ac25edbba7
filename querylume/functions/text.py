"""String functions over questions and SQL text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of SQL that are never schema names.
STOP_WORDS = (
    "select from where join on as and or not in is null like between exists case when then else end order by group having limit offset "
    "union intersect except distinct all asc desc count sum avg min max inner left right outer full cross natural using with create table "
    "insert update delete set values primary key foreign references index view drop alter add t1 t2 t3 t4 t5"
).split()
# Words that make a query a complex one, and the patterns of its clauses.
COMPLEX = ("JOIN", "INTERSECT", "EXCEPT", "UNION")
CLAUSES = {
    "has_join": r"\bJOIN\b", "has_where": r"\bWHERE\b", "has_group_by": r"\bGROUP\s+BY\b", "has_having": r"\bHAVING\b", "has_order_by": r"\bORDER\s+BY\b",
    "has_limit": r"\bLIMIT\b", "has_union": r"\bUNION\b", "has_intersect": r"\bINTERSECT\b", "has_except": r"\bEXCEPT\b", "has_distinct": r"\bDISTINCT\b",
    "has_count": r"\bCOUNT\s*\(", "has_sum": r"\bSUM\s*\(", "has_avg": r"\bAVG\s*\(", "has_max": r"\bMAX\s*\(", "has_min": r"\bMIN\s*\(",
}


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def phrases(question: Column, longest: int) -> Column:
    """Distinct runs of 1 to ``longest`` words, lower-cased, punctuation deleted."""
    w = words(F.regexp_replace(F.lower(question), r"(?U)[^\w\s]", ""))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, longest + 1)])))


def gold_tokens(sql: Column) -> Column:
    """Distinct lower-cased tokens of a query that may be schema names; a token keeps inner dots."""
    raw = F.split(F.lower(sql), "(?U)[\\s\\(\\),;=<>!\"']+")
    kept = F.filter(raw, lambda t: (t != "") & ~t.isin(STOP_WORDS))
    return F.array_distinct(F.transform(kept, lambda t: F.regexp_replace(t, r"^\.+", "")))


def quoted(question: Column) -> Column:
    return F.regexp_extract_all(question, F.lit("'([^']*)'"), F.lit(1))


def numbers(question: Column) -> Column:
    return F.regexp_extract_all(question, F.lit(r"\d+"), F.lit(0))


def sql_features(sql: Column) -> dict[str, Column]:
    """Sixteen clause flags and two counts."""
    up = F.upper(F.coalesce(sql, F.lit("None")))
    out = {name: F.regexp_like(up, F.lit(pattern)) for name, pattern in CLAUSES.items()}
    out["has_subquery"] = F.regexp_count(up, F.lit("SELECT")) > 1
    out["n_joins"] = F.regexp_count(up, F.lit(r"\bJOIN\b"))
    out["n_selects"] = F.regexp_count(up, F.lit(r"\bSELECT\b"))
    return out


def hardness_proxy(f: dict[str, Column]) -> Column:
    """Difficulty by clause flags, where the evaluator's own is not at hand."""
    points = {"has_join": 1.0, "n_joins": 0.5, "has_subquery": 2.0, "has_having": 1.0, "has_intersect": 2.0, "has_except": 2.0, "has_union": 1.0}
    score = sum((f[k].cast("double") * w for k, w in points.items()), F.lit(0.0))
    return F.when(score == 0, "easy").when(score <= 1, "medium").when(score <= 3, "hard").otherwise("extra")


def clean_sql(raw: Column) -> Column:
    """A model's answer to one line of SQL; the patterns and their order are fixed values. The first SELECT up to a semicolon is taken; NULLS FIRST/LAST, ILIKE and text
    casts go; of a query on one table, aliases, prefixes in the select list and all between the table and the next
    clause go too."""
    sql = F.trim(F.regexp_replace(F.regexp_replace(raw, "```sql|```", ""), "`", ""))
    first = F.regexp_extract(sql, r"(?is)(SELECT(?U:\s)+.*?)(?:;|\z)", 1)
    sql = F.regexp_replace(F.when(first != "", first).otherwise(sql), r"(?U)^\s+|\s+$", "")
    body = F.regexp_replace(sql, r"(?iU)\s+NULLS\s+(LAST|FIRST)", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)\bILIKE\b", "LIKE"), r"(?i)::text\b", "")
    simple = ~F.regexp_like(body, F.lit(r"(?is)\bSELECT\b.*\bSELECT\b"))
    for word in COMPLEX:
        simple = simple & ~F.contains(F.upper(body), F.lit(word))
    bare = F.regexp_replace(body, r"(?i)\s+AS\s+[a-zA-Z0-9_]+(?=[\s,]|FROM|$)", "")
    parts = F.split(bare, r"(?i)\bFROM\b", 2)
    head = F.regexp_replace(parts[0], r"\b[a-zA-Z_][a-zA-Z0-9_]*\.(?=[a-zA-Z_])", "")
    tail = F.trim(F.get(parts, F.lit(1)))
    name, clause = F.regexp_extract(tail, "^([a-zA-Z0-9_]+)", 1), F.regexp_extract(tail, r"(?is)\b(?:WHERE|GROUP|ORDER|HAVING|LIMIT)\b.*", 0)
    tail = F.when(name == "", tail).when(clause == "", name).otherwise(F.concat_ws(" ", name, clause))
    short = F.when(F.size(parts) == 2, F.concat(head, F.lit(" FROM "), tail)).otherwise(bare)
    out = F.trim(F.regexp_replace(F.when(simple, short).otherwise(body), r"(?U)\s+", " "))
    return F.when(sql == "", F.lit("SELECT 1")).otherwise(out)


def same_sql(a: Column, b: Column) -> Column:
    return F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "MATCH").otherwise("DIFF")


def bar(share: Column, width: int = 20) -> Column:
    """A bar of filled and empty cells; halves round to even."""
    n = F.bround(share * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def without_database(node: Column) -> Column:
    return F.regexp_replace(node, r"^[^.]*\.", "")
