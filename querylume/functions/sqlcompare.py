"""Structural comparison of parsed queries: normal form, difficulty, partial and exact match."""

from __future__ import annotations

from dataclasses import replace

from querylume.functions.sqlparse import Column, Conditions, Query, Schema, Test, Value

# Names of the parts and levels of the benchmark's scores.
PARTS = ("select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "group", "order", "and/or", "IUEN", "keywords")
LEVELS = ("easy", "medium", "hard", "extra")
EMPTY = Query()


# --- normal form ---------------------------------------------------------------------------------------------------
def without_values(q: Query | None) -> Query | None:
    """Literals and columns on the right side of tests go; nested queries stay, without values."""
    if q is None:
        return None

    def side(x):
        return without_values(x) if isinstance(x, Query) else None

    def tests(c: Conditions) -> Conditions:
        return Conditions([t._replace(low=side(t.low), high=side(t.high)) for t in c.tests], list(c.links))

    combined = (q.combined[0], without_values(q.combined[1])) if q.combined else None
    return replace(q, joins=tests(q.joins), where=tests(q.where), having=tests(q.having), combined=combined)


def usable_columns(tables: list, schema: Schema) -> set[str]:
    """Ids of the columns of the named tables of FROM."""
    names = {t[2:-2] for t in tables if isinstance(t, str)}
    return {i for key, i in schema.ids.items() if "." in key and key.split(".")[0] in names}


def canonical(q: Query | None, usable: set[str], keys: dict[str, str]) -> Query | None:
    """Columns become their foreign key group's first column, where the column is usable in the outer query; DISTINCT
    is dropped. Nested queries and derived tables stay as they are; set operands use the outer query's columns."""
    if q is None:
        return None

    def column(c: Column | None) -> Column | None:
        return c and Column(c.agg, keys[c.id] if c.id in keys and c.id in usable else c.id, None)

    def value(v: Value) -> Value:
        return Value(v.op, column(v.left), column(v.right))

    def tests(c: Conditions) -> Conditions:
        return Conditions([t._replace(value=value(t.value)) for t in c.tests], list(c.links))

    return replace(
        q, distinct=None, select=[(a, value(v)) for a, v in q.select], joins=tests(q.joins), where=tests(q.where), having=tests(q.having), group=[column(c) for c in q.group],
        order=(q.order[0], [value(v) for v in q.order[1]]) if q.order else None, combined=(q.combined[0], canonical(q.combined[1], usable, keys)) if q.combined else None,
    )


def key_groups(columns: list[tuple[str, str]], pairs: list[tuple[int, int]]) -> dict[str, str]:
    """Foreign key equivalence: each pair joins the first group that has one of its columns, groups are never merged;
    a column's canonical id is its group's with the smallest position. ``columns`` are (table, column) by position."""
    groups: list[set[int]] = []
    for pair in pairs:
        home = next((g for g in groups if not g.isdisjoint(pair)), None)
        if home is None:
            groups.append(home := set())
        home.update(pair)
    name = lambda i: f"__{columns[i][0]}.{columns[i][1]}__".lower() if columns[i][1] != "*" else "__all__"
    return {name(i): name(min(g)) for g in groups for i in g}


# --- difficulty ----------------------------------------------------------------------------------------------------
def nested(q: Query) -> list[Query]:
    tests = q.joins.tests + q.where.tests + q.having.tests
    return [x for t in tests for x in (t.low, t.high) if isinstance(x, Query)] + ([q.combined[1]] if q.combined else [])


def counts(q: Query) -> tuple[int, int, int]:
    """Clauses, nested queries, and other marks of difficulty."""
    tests, links = q.joins.tests + q.where.tests + q.having.tests, q.joins.links + q.where.links + q.having.links
    clauses = sum(map(bool, (q.where, q.group, q.order))) + (q.limit is not None) + max(0, len(q.tables) - 1)
    clauses += links.count("or") + sum(t.op == "like" for t in tests)
    # NOT in a WHERE or HAVING test counts as an aggregate, and so does every connective of HAVING
    aggregates = sum(a != "none" for a, _ in q.select) + sum(t.negated for t in q.where.tests + q.having.tests) + len(q.having.links)
    aggregates += sum(c.agg != "none" for c in q.group)
    if q.order:
        aggregates += sum(c.agg != "none" for v in q.order[1] for c in (v.left, v.right) if c)
    others = (aggregates > 1) + (len(q.select) > 1) + (len(q.where) > 1) + (len(q.group) > 1)
    return clauses, len(nested(q)), others


def hardness(q: Query) -> str:
    clauses, below, others = counts(q)
    if below == 0:
        if clauses <= 1 and others == 0:
            return "easy"
        if clauses <= 1 and others <= 2 or clauses <= 2 and others < 2:
            return "medium"
        if clauses <= 2 and others > 2 or clauses == 3 and others <= 2:
            return "hard"
    elif below == 1 and clauses <= 1 and others == 0:
        return "hard"
    return "extra"


# --- matching ------------------------------------------------------------------------------------------------------
def shared(a: list, b: list) -> int:
    """Size of the multiset intersection."""
    rest, n = list(b), 0
    for x in a:
        if x in rest:
            rest.remove(x)
            n += 1
    return n


def keywords(q: Query) -> set[str]:
    tests, links = q.joins.tests + q.where.tests + q.having.tests, q.joins.links + q.where.links + q.having.links
    found = {name for name, there in (("where", q.where), ("group", q.group), ("having", q.having), ("order", q.order)) if there}
    if q.order:
        found.add(q.order[0])
    if q.limit is not None:
        found.add("limit")
    if q.combined:
        found.add(q.combined[0])
    if "or" in links:
        found.add("or")
    if any(t.negated for t in tests):
        found.add("not")
    return found | {t.op for t in tests if t.op in ("in", "like")}


def partial_counts(pred: Query, gold: Query) -> dict[str, tuple[int, int, int]]:
    """For each part (gold total, predicted total, matched)."""
    bare = lambda cs: [c.id.split(".")[1] if "." in c.id else c.id for c in cs]
    same_links = set(pred.where.links) == set(gold.where.links)
    n_sel, n_where = (len(gold.select), len(pred.select)), (len(gold.where.tests), len(pred.where.tests))
    having = bool(pred.group) and bool(gold.group) and [c.id for c in pred.group] == [c.id for c in gold.group] and pred.having == gold.having
    order = bool(gold.order) and pred.order == gold.order and (pred.limit is None) == (gold.limit is None)
    sets = [0, 0, 0]
    for name in ("intersect", "except", "union"):
        p, g = pred.part(name), gold.part(name)
        sets[0] += g is not None
        sets[1] += p is not None
        sets[2] += p is not None and g is not None and exact(p, g)
    kp, kg = keywords(pred), keywords(gold)
    return {
        "select": (*n_sel, shared(pred.select, gold.select)),
        "select(no AGG)": (*n_sel, shared([v for _, v in pred.select], [v for _, v in gold.select])),
        "where": (*n_where, shared(pred.where.tests, gold.where.tests)),
        "where(no OP)": (*n_where, shared([t.value for t in pred.where.tests], [t.value for t in gold.where.tests])),
        "group(no Having)": (len(gold.group), len(pred.group), shared(bare(pred.group), bare(gold.group))),
        "group": (int(bool(gold.group)), int(bool(pred.group)), int(having)),
        "order": (int(bool(gold.order)), int(bool(pred.order)), int(order)),
        "and/or": (1, 1, 1) if same_links else (len(set(pred.where.links)), len(set(gold.where.links)), 0),
        "IUEN": tuple(sets),
        "keywords": (len(kg), len(kp), len(kp & kg)),
    }


def points(gold_total: int, pred_total: int, matched: int) -> int:
    """1 if all of as many match, else 0; accuracy, recall and F1 are all this number."""
    return int(gold_total == pred_total == matched)


def exact(pred: Query, gold: Query) -> bool:
    """Every part matches, and the same tables (in any order) are named. Join conditions count only by their words."""
    if not all(points(*n) for n in partial_counts(pred, gold).values()):
        return False
    return not gold.tables or len(gold.tables) == len(pred.tables) == shared(pred.tables, gold.tables)
