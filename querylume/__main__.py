"""Command lines: ``python -m querylume <command> --data DIR ...``.

The data folder has tables.json, dev.json, train_spider.json, dev_gold.sql (or dev_gold), and user tables as
database/<db_id>/<table>.parquet. Results go to ``--out``, tables to the console.

Models are named as ``--generator module:function``: a function from a DataFrame with a prompt column to one with a
column ``raw`` more. Without one every prediction is 'SELECT 1'.
"""

from __future__ import annotations

import argparse
import importlib
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylume.functions import report_text
from querylume.functions.tokens import best_counter
from querylume.operators import evaluation, execution
from querylume.plans import runs
from querylume.session import build_session
from querylume.sources import catalog, files
from querylume.sources.tables import register_database

DATA_FILES = ("tables.json", "train_spider.json", "dev.json", "dev_gold.sql", "database")


class Data:
    """What lies in a data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def report(self) -> str:
        return report_text.table(["file", "there"], [[name, "yes" if there else "NOT FOUND"] for name, there in files.existing(self.folder, DATA_FILES).items()])

    def catalog(self) -> DataFrame:
        return catalog.read_catalog(self.spark, self.path("tables.json"))

    def questions(self, ratio: float = 1.0) -> DataFrame:
        """q_id, db_id, question, sql; a seeded sample of them in their order."""
        raw = files.read_questions(self.spark, self.path("dev.json"))
        raw = files.sample(raw, ratio) if ratio < 1 else raw
        return raw.select(F.col("idx").alias("q_id"), "db_id", "question", F.col(files.found_column(raw, files.SQL_NAMES)).alias("sql"))

    def examples(self) -> DataFrame | None:
        if not os.path.exists(self.path("train_spider.json")):
            return None
        raw = files.read_questions(self.spark, self.path("train_spider.json"))
        return raw.select(F.col("idx").alias("id"), "db_id", "question", F.col(files.found_column(raw, files.SQL_NAMES)).alias("sql"))

    def scores(self, gold: str, pred: str, etype: str, databases: str | None = None, tables: str | None = None) -> DataFrame:
        """The evaluator over a gold and a prediction file."""
        cat = catalog.read_catalog(self.spark, tables) if tables else self.catalog()
        pairs = evaluation.pair_lines(files.read_lines(self.spark, gold), files.read_lines(self.spark, pred))
        use = lambda db: register_database(self.spark, databases or self.path("database"), db)
        return evaluation.evaluate(pairs, cat, etype, lambda found: execution.match_all(found, evaluation.schemas_in(cat), use))


def config_of(args: argparse.Namespace) -> runs.Config:
    cfg = runs.Config(full_schema=getattr(args, "full_schema", False), count_tokens=best_counter(args.tokenizer))
    if args.generator:
        module, _, name = args.generator.partition(":")
        cfg = replace(cfg, generate=getattr(importlib.import_module(module), name))
    return cfg


def written(result: DataFrame, out: str, name: str, gold: bool = False) -> DataFrame:
    """Predictions, log, scores and prompts of a run; returns the run as it was written."""
    cols = ["q_id", "db_id", "question", *(["sql"] if "sql" in result.columns else []), "recall", "precision", "prompt", "pred_sql", "tokens_in", "tokens_out", "token_consumption"]
    result.select(*cols).write.mode("overwrite").parquet(f"{out}/{name}")  # generated once
    done = result.sparkSession.read.parquet(f"{out}/{name}")
    files.write_lines(done, f"{out}/{name}_predictions", "pred_sql", "q_id")
    log = report_text.sample_log(F.col("q_id"), F.col("db_id"), F.col("question"), F.col("sql"), F.col("pred_sql"), F.col("recall"), F.col("precision"))
    done.select("q_id", log.alias("value")).orderBy("q_id").select("value").coalesce(1).write.mode("overwrite").text(f"{out}/{name}_log")
    files.write_csv(done.select((F.col("q_id") + 1).alias("index"), "db_id", "recall", "precision"), f"{out}/{name}_results", {"recall": 4, "precision": 4}, ["index"])
    files.write_jsonl(done.select((F.col("q_id") + 1).alias("i"), "db_id", "question", "tokens_in", "tokens_out", "token_consumption", "prompt", "pred_sql"), f"{out}/{name}_prompts")
    return done


def show_scores(data: Data, args: argparse.Namespace, name: str) -> None:
    """Both evaluations of a run's predictions, where the gold file covers them."""
    gold = files.gold_path(data.folder)
    if os.path.exists(gold) and args.sample >= 1:
        print(report_text.score_table(data.scores(gold, files.one_file(f"{args.out}/{name}_predictions"), args.etype)))


def swept(data: Data, cfg: runs.Config, ratio: float, out: str) -> runs.Config:
    """The grid over a sample, its tables and file, and the configuration with its best point."""
    found = runs.sweep(data.questions(ratio), data.catalog(), cfg)
    files.write_csv(found, f"{out}/sweep_results", {c: 4 for c in ("avg_recall", "avg_precision", "f1", "f6")}, ["top_k_tables", "top_k_columns"])
    found = data.spark.read.csv(f"{out}/sweep_results", header=True, inferSchema=True)
    print(report_text.sweep_tables(found))
    tables, columns = runs.best_point(found)
    return replace(cfg, top_k_tables=tables, top_k_columns=columns)


def pipeline(data: Data, args: argparse.Namespace) -> None:
    cfg = config_of(args)
    if not args.skip_sweep and not cfg.full_schema:
        cfg = swept(data, cfg, args.sweep_sample, args.out)
    questions, examples, cat = data.questions(args.sample if args.baseline else 1.0), data.examples(), data.catalog()
    done = written(runs.run(questions, examples, cat, cfg), args.out, "graph")
    print(report_text.linking_table(runs.summary(done), "schema linking, column mode"))
    if args.baseline:
        base = written(runs.run(questions, None, cat, replace(cfg, table_mode=True)), args.out, "baseline")
        print(report_text.linking_table(runs.summary(base), "schema linking, table mode"))
        print(report_text.comparison_report(runs.compared(done, base)))
    args.sample = args.sample if args.baseline else 1.0
    for name in ("graph", "baseline")[: 1 + args.baseline]:
        show_scores(data, args, name)


def baseline(data: Data, args: argparse.Namespace) -> None:
    cfg, questions, cat = config_of(args), data.questions(args.sample), data.catalog()
    base = written(runs.run(questions, None, cat, replace(cfg, table_mode=True)), args.out, "baseline")
    print(report_text.linking_table(runs.summary(base), "schema linking, table mode"))
    show_scores(data, args, "baseline")
    if args.compare:
        done = written(runs.run(questions, None, cat, cfg), args.out, "graph")
        print(report_text.comparison_report(runs.compared(done, base)))


def sweep(data: Data, args: argparse.Namespace) -> None:
    swept(data, config_of(args), args.sample, args.out)


def ablation(data: Data, args: argparse.Namespace) -> None:
    cfg = config_of(args)
    if (cfg.top_k_tables, cfg.top_k_columns) == (runs.Config.top_k_tables, runs.Config.top_k_columns):
        print("note: the numbers of tables and columns are the defaults; a sweep may find better ones")
    rows = runs.ablation_rows(data.questions(args.sample), data.examples(), data.catalog(), cfg, tuple(args.k_values), (args.mode == "table",))
    rows.drop("elements", "raw", "ddl").write.mode("overwrite").parquet(f"{args.out}/ablation")
    done = data.spark.read.parquet(f"{args.out}/ablation")
    means = runs.summary(done, "mode", "k").drop("f1", "f6")
    print(report_text.ablation_table(means, cfg.alpha))
    digits = {"avg_recall": 4, "avg_precision": 4, "avg_prompt_tokens": 1, "avg_output_tokens": 1, "avg_token_consumption": 1}
    files.write_csv(means, f"{args.out}/ablation_results", digits, ["mode", "k"])
    for k in args.k_values:
        files.write_lines(done.where(F.col("k") == k), f"{args.out}/ablation_{args.mode}_k{k}_predictions", "pred_sql", "q_id")
        if args.run_eval:
            gold = f"{args.out}/ablation_gold"
            lines = done.where(F.col("k") == k).withColumn("_g", F.concat_ws("\t", F.regexp_replace("sql", r"\s+", " "), "db_id"))
            lines.orderBy("q_id").select(F.col("_g").alias("value")).coalesce(1).write.mode("overwrite").text(gold)
            print(f"mode {args.mode}, k {k}")
            print(report_text.score_table(data.scores(files.one_file(gold), files.one_file(f"{args.out}/ablation_{args.mode}_k{k}_predictions"), "all")))


def evaluate(data: Data, args: argparse.Namespace) -> None:
    print(report_text.score_table(data.scores(args.gold, args.pred, args.etype, args.db, args.table)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--data", default=".", help="folder with tables.json, dev.json and so on")
    shared.add_argument("--out", default="out", help="folder for predictions and tables")
    shared.add_argument("--generator", help="module:function that generates")
    shared.add_argument("--tokenizer", help="tokenizer file for token counts; words are counted without one")
    shared.add_argument("--etype", choices=evaluation.ETYPES, default="all")
    top = argparse.ArgumentParser(prog="querylume", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, f: sub.add_parser(name, parents=[shared]).set_defaults(run=f) or sub.choices[name]
    p = add("pipeline", pipeline)
    p.add_argument("--full-schema", action="store_true", help="all columns instead of linked ones")
    p.add_argument("--skip-sweep", action="store_true", help="the configuration's own numbers of tables and columns")
    p.add_argument("--sweep-sample", type=float, default=0.2)
    p.add_argument("--baseline", action="store_true", help="table mode too, and a comparison")
    p.add_argument("--sample", type=float, default=1.0)
    p = add("baseline", baseline)
    p.add_argument("--sample", type=float, default=0.2)
    p.add_argument("--skip-sweep", action="store_true", help="accepted for compatibility; nothing is swept here")
    p.add_argument("--full-schema", action="store_true")
    p.add_argument("--compare", action="store_true")
    p = add("sweep", sweep)
    p.add_argument("--sample", type=float, default=0.2)
    p = add("ablation", ablation)
    p.add_argument("--mode", choices=("column", "table"), default="column")
    p.add_argument("--sample", type=float, default=0.2)
    p.add_argument("--k-values", type=int, nargs="+", default=list(runs.SHOTS))
    p.add_argument("--run-eval", action="store_true")
    p = add("evaluate", evaluate)
    p.add_argument("--gold", required=True)
    p.add_argument("--pred", required=True)
    p.add_argument("--db", help="folder of databases")
    p.add_argument("--table", help="catalogue file")
    args = top.parse_args(argv)
    data = Data(spark or build_session("querylume"), args.data)
    print(data.report())
    args.run(data, args)


if __name__ == "__main__":
    main()
