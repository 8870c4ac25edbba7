"""Results as text: score, sweep, ablation and linking tables, the comparison of two modes, and logs of samples.

A table has a bounded number of rows (levels, grid points, modes, one row of means), so it is laid out on the driver; logs
have a row a sample, and are columns of text.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylume.functions.sqlcompare import LEVELS, PARTS

COLUMNS = (*LEVELS, "all")


def table(head: Sequence[str], rows: Iterable[Sequence[str]]) -> str:
    """Columns as wide as their widest cell, the first to the left, the others to the right."""
    lines = [list(head), *map(list, rows)]
    width = [max(len(line[i]) for line in lines) for i in range(len(head))]
    text = ["  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(line, width))).rstrip() for line in lines]
    return "\n".join([text[0], "-" * (sum(width) + 2 * len(width) - 2), *text[1:]]) + "\n"


def score_table(scores: DataFrame) -> str:
    """What ``evaluate`` gives, as a table by level: counts, execution accuracy, exact matches, and the ten parts'
    accuracy, recall and F1. Levels without a pair show 0."""
    found = {(r["level"], r["metric"], r["part"]): r["value"] for r in scores.collect()}  # levels x parts x metrics
    have = {m for _, m, _ in found}
    out = table(["", *COLUMNS], [["count", *(str(int(found.get((x, "count", ""), 0))) for x in COLUMNS)]])
    for metric, title in (("exec", "execution accuracy"), ("exact", "exact match")):
        if metric in have:
            out += "\n" + table([title, *COLUMNS], [[metric, *(f"{found.get((x, metric, ''), 0.0):.3f}" for x in COLUMNS)]])
    for metric in ("accuracy", "recall", "f1"):
        if metric in have:
            out += "\n" + table([f"partial match: {metric}", *COLUMNS], [[part, *(f"{found.get((x, metric, part), 0.0):.3f}" for x in COLUMNS)] for part in PARTS])
    return out


def percent(x: float, digits: int = 2) -> str:
    return f"{100 * x:.{digits}f}%"


def linking_table(summary: DataFrame, title: str) -> str:
    r = summary.first()
    return title + "\n" + table(["measure", "value"], [["recall", percent(r["avg_recall"])], ["precision", percent(r["avg_precision"])], ["samples", str(r["n_samples"])]])


def sweep_tables(swept: DataFrame) -> str:
    """The grid ranked by F1, then by F6 with notes: the best point, and those below the recall line."""
    rows, out = sorted(swept.collect(), key=lambda r: (r["top_k_tables"], r["top_k_columns"])), ""  # a row a grid point
    head = ["tables", "columns", "recall", "precision", "score", "recall line", "note"]
    for name in ("f1", "f6"):
        lines = []
        for i, r in enumerate(sorted(rows, key=lambda r: -r[name])):
            note = f"best {name.upper()}" if i == 0 else "" if name == "f1" or r["meets_recall_target"] else "below the line"
            lines.append([str(r["top_k_tables"]), str(r["top_k_columns"]), percent(r["avg_recall"]), percent(r["avg_precision"]), percent(r[name]), "yes" if r["meets_recall_target"] else "no", note])
        out += f"ranked by {name.upper()}\n" + table(head, lines) + "\n"
    best = max(rows, key=lambda r: r["f6"])
    out += f"recommended: top_k_tables={best['top_k_tables']}, top_k_columns={best['top_k_columns']}\n"
    return out if best["meets_recall_target"] else out + "warning: the best point is below the recall line\n"


def ablation_table(rows: DataFrame, alpha: float = 1.0) -> str:
    lines = [
        [r["mode"], str(r["k"]), percent(r["avg_recall"]), percent(r["avg_precision"]), f"{r['avg_token_consumption']:.1f}", f"{r['avg_prompt_tokens']:.1f}", f"{r['avg_output_tokens']:.1f}", str(r["n_samples"])]
        for r in sorted(rows.collect(), key=lambda r: (r["mode"], r["k"]))  # a row a mode and k
    ]
    return f"token consumption = tokens in + {alpha:g} x tokens out\n" + table(["mode", "k", "recall", "precision", "consumption", "in", "out", "samples"], lines)


def comparison_report(row: DataFrame) -> str:
    """The one row that ``comparison`` gives."""
    r = row.first()
    lines = [[name, *(percent(r[f"{side}_{c}"]) for side in ("graph", "base")), f"{100 * r[f'delta_{c}']:+.2f}%"] for name, c in (("schema recall", "avg_recall"), ("schema precision", "avg_precision"))]
    lines.append(["prompt tokens", *(f"{r[f'{side}_avg_prompt_tokens']:.1f}" for side in ("graph", "base")), f"{r['delta_avg_prompt_tokens']:+.1f}"])
    lines += [["nodes", "columns", "tables", ""], ["schema in the prompt", "linked columns", "whole tables", ""], ["linking", "phrases", "whole question", ""]]
    return table(["measure", "column mode", "table mode", "delta"], lines)


def sample_log(idx: Column, db_id: Column, question: Column, gold: Column, pred: Column, recall: Column, precision: Column) -> Column:
    """The log of one sample, five lines and a rule."""
    at = F.format_string("[%d] DB: %s\n  Q      : %s\n  GOLD   : %s\n  PRED   : %s\n  Recall : %.4f  Precision: %.4f", (idx + 1).cast("long"), db_id, question, gold, pred, recall.cast("double"), precision.cast("double"))
    return F.concat(at, F.lit("\n" + "-" * 60))


def pretty(name: Column) -> Column:
    """A flag's name as a label: without 'has_', blanks for underscores, in capitals."""
    return F.upper(F.replace(F.regexp_replace(name, "^has_", ""), F.lit("_"), F.lit(" ")))
