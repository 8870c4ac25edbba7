"""End-to-end runs: questions to hits, DDL, prompts, predictions and scores; mode comparison, sweep and ablation.

Models are providers: an embedder is a function from a text column to a vector column, a generator a function from a
DataFrame with a prompt column to one with a ``raw`` column more, a token counter a function from a text column to a
number. The offline defaults need no model. Schemas' paths are computed once and passed in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylume.functions import render
from querylume.functions import text as T
from querylume.functions.vectors import hashed_embedding, top_k
from querylume.operators import graph, linking
from querylume.operators.storage import frozen
from querylume.sources import catalog as cat

GRID_TABLES, GRID_COLUMNS = (1, 2, 3), (1, 3, 5, 7, 10)
SHOTS, MODES = (0, 1, 3, 5), (False, True)
RECALL_LINE = 0.9
NO_GOLD = "(could not parse gold schema)"


@dataclass(frozen=True)
class Config:
    top_k_tables: int = 3
    top_k_columns: int = 5
    threshold: float = linking.THRESHOLD
    max_ngram: int = 3
    few_shot: int = 3
    same_db_first: bool = True
    full_schema: bool = False
    table_mode: bool = False
    alpha: float = 1.0
    embed: Callable[[Column], Column] = field(default=hashed_embedding)
    generate: Callable[[DataFrame], DataFrame] | None = None
    count_tokens: Callable[[Column], Column] = field(default=T.word_count)


def paths_of(catalog: DataFrame, table_mode: bool = False) -> DataFrame:
    """The routes of all schemas, by which shortest paths are found, written once."""
    edges = graph.table_edges(catalog) if table_mode else graph.column_edges(catalog)
    return frozen(graph.routes(edges), "schema-routes")


def _phrases(questions: DataFrame, cfg: Config) -> DataFrame:
    return questions.select("q_id", "db_id", F.explode(T.phrases(F.col("question"), cfg.max_ngram)).alias("phrase")).withColumn("emb", cfg.embed(F.col("phrase")))


def _table_items(nodes: DataFrame, cfg: Config) -> DataFrame:
    return nodes.groupBy("db_id", F.col("table").alias("name")).agg(F.min("ord").alias("ord")).withColumn("emb", cfg.embed(F.col("name")))


def _column_items(nodes: DataFrame, cfg: Config) -> DataFrame:
    return nodes.select("db_id", "table", F.col("column").alias("name"), "ord", cfg.embed(F.concat_ws(".", "table", "column")).alias("emb"))


def link(questions: DataFrame, catalog: DataFrame, cfg: Config, paths: DataFrame | None = None) -> DataFrame:
    """(q_id, db_id, question) to the column nodes of each question's schema context: q_id, db_id, node_id. Nothing found
    means all nodes, and so does ``full_schema``. ``paths`` are those of the configuration's mode."""
    nodes = graph.column_nodes(catalog)
    everything = questions.select("q_id", "db_id").join(nodes.select("db_id", "node_id"), "db_id").select("q_id", "db_id", "node_id")
    if cfg.full_schema:
        return everything
    if paths is None:
        paths = paths_of(catalog, cfg.table_mode)
    if cfg.table_mode:
        named = graph.table_nodes(catalog)
        text = F.concat(F.lit("table "), "table", F.lit(" columns "), F.array_join(F.transform("columns", lambda c: c["name"]), " "))
        order = nodes.groupBy("db_id", "table").agg(F.min("ord").alias("ord"))
        items = named.join(order, ["db_id", "table"]).select("db_id", F.col("table").alias("name"), "ord", cfg.embed(text).alias("emb"))
        asked = questions.select("q_id", "db_id", F.col("question").alias("phrase"), cfg.embed(F.concat(F.lit("query "), "question")).alias("emb"))
        best = linking.candidate_tables(asked, items, cfg.top_k_tables or 3)
        hits = best.select("q_id", "db_id", F.concat_ws(".", "db_id", "name").alias("node_id"), F.col("rank").alias("ord"))
        wide = graph.expand_hits(hits, paths)
        found = wide.select("q_id", "db_id", T.without_database(F.col("node_id")).alias("table")).join(nodes, ["db_id", "table"]).select("q_id", "db_id", "node_id")
    else:
        phrases = _phrases(questions, cfg)
        best = linking.candidate_tables(phrases, _table_items(nodes, cfg), cfg.top_k_tables)
        columns = linking.candidate_columns(phrases, _column_items(nodes, cfg), best, cfg.top_k_columns, cfg.threshold)
        hits = graph.hits_by_name(columns.select("q_id", "db_id", F.col("name").alias("column")), nodes)
        found = graph.expand_hits(hits, paths).select("q_id", "db_id", "node_id")
    return found.union(everything.join(found.select("q_id").distinct(), "q_id", "left_anti"))


def _elements(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """q_id, elements: distinct lower-cased table and column names of the chosen nodes, in one namespace."""
    met = chosen.join(nodes, ["db_id", "node_id"])
    return met.groupBy("q_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.lower("table"), F.lower("column")))))).alias("elements"))


def contexts(questions: DataFrame, catalog: DataFrame, cfg: Config, paths: DataFrame | None = None) -> DataFrame:
    """q_id, ddl, elements of each question's schema context."""
    nodes = graph.column_nodes(catalog)
    chosen = frozen(link(questions, catalog, cfg, paths), "linked-nodes")
    if cfg.table_mode:
        ddl = render.table_ddl(chosen.join(nodes, ["db_id", "node_id"]).select("q_id", "db_id", "table"), catalog, graph.table_edges(catalog))
    else:
        ddl = render.column_ddl(chosen, nodes, graph.column_edges(catalog))
    return ddl.join(_elements(chosen, nodes), "q_id")


def gold_elements(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """q_id, elements: the schema names among the words of the gold query (column ``sql``)."""
    nodes = graph.column_nodes(catalog)
    known = nodes.groupBy("db_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array(F.lower("table"), F.lower("column"))))).alias("known"))
    return questions.join(known, "db_id").select("q_id", F.array_intersect(T.gold_tokens(F.col("sql")), F.col("known")).alias("elements"))


def gold_contexts(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """q_id, gold_ddl: the columns whose table's name or own name the gold query has, as DDL; for display only."""
    nodes = graph.column_nodes(catalog)
    named = questions.select("q_id", "db_id").join(gold_elements(questions, catalog).select("q_id", F.explode("elements").alias("_name")), "q_id")
    by = lambda c: nodes.select("db_id", "node_id", F.lower(c).alias("_name"))
    chosen = named.join(by("table").union(by("column")), ["db_id", "_name"]).select("q_id", "db_id", "node_id").distinct()
    ddl = render.column_ddl(chosen, nodes, graph.column_edges(catalog)).withColumnRenamed("ddl", "gold_ddl")
    return questions.select("q_id").join(ddl, "q_id", "left").select("q_id", F.coalesce("gold_ddl", F.lit(NO_GOLD)).alias("gold_ddl"))


def _pools(questions: DataFrame, examples: DataFrame, cfg: Config, k: int) -> DataFrame:
    """Each question's 4 k most similar examples: q_id, q_grp, id, grp, rank."""
    key = F.xxhash64("db_id").alias("grp")
    train = examples.select("id", key, cfg.embed(F.col("question")).alias("emb"))
    asked = questions.select(F.col("q_id").alias("id"), key, cfg.embed(F.col("question")).alias("emb"))
    # ids of questions and examples are of different tables; examples are numbered below zero, from the last, so that
    # none is left out
    far = F.lit(-(1 << 62)) + F.col("id")
    return top_k(asked, train.withColumn("id", far), 4 * k).withColumn("id", F.col("id") + F.lit(1 << 62))


def _shots(pool: DataFrame, cfg: Config, k: int) -> DataFrame:
    near = pool.where(F.col("rank") <= (4 * k if cfg.same_db_first else k))
    return linking.same_group_first(near, k) if cfg.same_db_first else near.withColumn("place", F.col("rank"))


def prompts(questions: DataFrame, examples: DataFrame | None, catalog: DataFrame, cfg: Config, paths: DataFrame | None = None) -> DataFrame:
    """q_id, db_id, question, ddl, elements, prompt. ``examples`` has (id, db_id, question, sql)."""
    out = questions.join(contexts(questions, catalog, cfg, paths), "q_id")
    if examples is None or cfg.few_shot <= 0:
        return out.withColumn("prompt", render.prompt(F.col("question"), F.col("ddl"), F.lit(None).cast("string")))
    best = _shots(_pools(questions, examples, cfg, cfg.few_shot), cfg, cfg.few_shot).select("q_id", "place", "id")
    block = render.few_shot_block(best.join(examples.select("id", "question", "sql"), "id"))
    return out.join(block, "q_id", "left").withColumn("prompt", render.prompt(F.col("question"), F.col("ddl"), F.col("block"))).drop("block")


def linking_scores(questions: DataFrame, found: DataFrame, catalog: DataFrame, column_mode: bool = True) -> DataFrame:
    """Recall and precision of the context against the gold query's schema words; questions have a column ``sql``."""
    return linking.recall_precision(gold_elements(questions, catalog), found.select("q_id", "elements"), column_mode)


def _generated(made: DataFrame, cfg: Config) -> DataFrame:
    """Adds raw, pred_sql, tokens_in, tokens_out, token_consumption. Where a generator gives null it has failed: the
    prediction is 'SELECT 1', and recall, precision and tokens are 0. Without a generator nothing has failed."""
    made = cfg.generate(made) if cfg.generate else made.withColumn("raw", F.lit(""))
    failed = F.col("raw").isNull()
    tin, tout = cfg.count_tokens(F.col("prompt")), cfg.count_tokens(F.coalesce("raw", F.lit("")))
    zero = lambda c: F.when(failed, F.lit(0)).otherwise(c)
    return made.withColumns({
        "pred_sql": T.clean_sql(F.coalesce("raw", F.lit(""))), "tokens_in": zero(tin), "tokens_out": zero(tout), "token_consumption": zero((tin + cfg.alpha * tout).cast("long")),
        "recall": zero(F.col("recall")), "precision": zero(F.col("precision")),
    })


def run(questions: DataFrame, examples: DataFrame | None, catalog: DataFrame, cfg: Config, paths: DataFrame | None = None) -> DataFrame:
    """All of it for all questions: adds recall, precision, raw, pred_sql, tokens and token_consumption."""
    made = prompts(questions, examples, catalog, cfg, paths)
    return _generated(made.join(linking_scores(questions, made, catalog, not cfg.table_mode), "q_id"), cfg)


_MEANS = {"recall": "avg_recall", "precision": "avg_precision", "tokens_in": "avg_prompt_tokens", "tokens_out": "avg_output_tokens", "token_consumption": "avg_token_consumption"}


def summary(result: DataFrame, *by: str) -> DataFrame:
    """Mean recall, precision and tokens; F1 and F6 of the means; the number of samples."""
    result = result.where("recall >= 0")
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in _MEANS.items()]
    one = result.groupBy(*by).agg(*means, F.count("*").alias("n_samples")) if by else result.agg(*means, F.count("*").alias("n_samples"))
    r, p = F.col("avg_recall"), F.col("avg_precision")
    return one.withColumns({"f1": linking.f1(r, p), "f6": linking.f6(r, p)})


def sweep(questions: DataFrame, catalog: DataFrame, cfg: Config, tables: tuple[int, ...] = GRID_TABLES, columns: tuple[int, ...] = GRID_COLUMNS, paths: DataFrame | None = None) -> DataFrame:
    """Linking scores of every grid point: top_k_tables, top_k_columns, avg_recall, avg_precision, f1, f6,
    meets_recall_target, n_samples. Phrases are scored once; columns are ranked once for each number of tables, and a
    point is a filter on ranks. A question without hits at a point has all nodes there."""
    spark, nodes = questions.sparkSession, graph.column_nodes(catalog)
    if paths is None:
        paths = paths_of(catalog)
    phrases = _phrases(questions, cfg)
    ranks = linking.candidate_tables(phrases, _table_items(nodes, cfg), max(tables))
    kt = F.broadcast(spark.createDataFrame([(k,) for k in tables], "kt int"))
    kc = F.broadcast(spark.createDataFrame([(k,) for k in columns], "kc int"))
    best = linking.nearest(phrases, _column_items(nodes, cfg), max(columns), ranks, tables).select(F.col("cut").alias("kt"), "q_id", "db_id", "name", "rank")
    names = best.groupBy("kt", "q_id", "db_id", "name").agg(F.min("rank").alias("rank")).join(kc, F.col("rank") <= F.col("kc"))
    point = F.concat_ws("|", "q_id", "kt", "kc")
    hits = graph.hits_by_name(names.select(point.alias("q_id"), "db_id", F.col("name").alias("column")), nodes)
    found = frozen(graph.expand_hits(hits, paths).select("q_id", "db_id", "node_id"), "sweep-nodes")
    asked = questions.select("q_id", "db_id", "sql").crossJoin(kt).crossJoin(kc).select(point.alias("_p"), "*")  # the grid's points
    everything = asked.select(F.col("_p").alias("q_id"), "db_id").join(nodes.select("db_id", "node_id"), "db_id").select("q_id", "db_id", "node_id")
    whole = found.union(everything.join(found.select("q_id").distinct(), "q_id", "left_anti"))
    gold = asked.select("_p", "q_id", "kt", "kc").join(gold_elements(questions, catalog), "q_id").select(F.col("_p").alias("q_id"), "kt", "kc", "elements")
    scored = linking.recall_precision(gold, _elements(whole, nodes)).join(gold.select("q_id", "kt", "kc"), "q_id")
    mean = scored.groupBy(F.col("kt").alias("top_k_tables"), F.col("kc").alias("top_k_columns")).agg(F.avg("recall").alias("avg_recall"), F.avg("precision").alias("avg_precision"), F.count("*").alias("n_samples"))
    r, p = F.col("avg_recall"), F.col("avg_precision")
    return mean.select("top_k_tables", "top_k_columns", "avg_recall", "avg_precision", linking.f1(r, p).alias("f1"), linking.f6(r, p).alias("f6"), (r >= RECALL_LINE).alias("meets_recall_target"), "n_samples")


def best_point(swept: DataFrame) -> tuple[int, int]:
    """The point with the highest F6, the first of the grid on ties: (top_k_tables, top_k_columns)."""
    r = swept.orderBy(F.desc("f6"), "top_k_tables", "top_k_columns").first()
    return r["top_k_tables"], r["top_k_columns"]


def ablation_rows(questions: DataFrame, examples: DataFrame, catalog: DataFrame, cfg: Config, ks: tuple[int, ...] = SHOTS, modes: tuple[bool, ...] = MODES) -> DataFrame:
    """What ``run`` gives, for each mode ('column', 'table') and number of examples k, in one plan: contexts are made once
    a mode, examples are ranked once, and the generator sees all prompts at once."""
    spark, made = questions.sparkSession, None
    for mode in modes:
        at = replace(cfg, table_mode=mode, full_schema=False)
        one = questions.join(contexts(questions, catalog, at, paths_of(catalog, mode)), "q_id")
        one = one.join(linking_scores(questions, one, catalog, not mode), "q_id").withColumn("mode", F.lit("table" if mode else "column"))
        made = one if made is None else made.unionByName(one)
    blocks, pool = None, frozen(_pools(questions, examples, cfg, max(*ks, 1)), "example-pools")
    for k in ks:
        if k > 0:
            one = _shots(pool, cfg, k).select("q_id", "place", "id", F.lit(k).alias("k"))
            blocks = one if blocks is None else blocks.union(one)
    made = made.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int")))  # a row for each k
    if blocks is None:
        made = made.withColumn("block", F.lit(None).cast("string"))
    else:
        made = made.join(render.few_shot_block(blocks.join(examples.select("id", "question", "sql"), "id"), ("q_id", "k")), ["q_id", "k"], "left")
    return _generated(made.withColumn("prompt", render.prompt(F.col("question"), F.col("ddl"), F.col("block"))).drop("block"), cfg)


def ablation(questions: DataFrame, examples: DataFrame, catalog: DataFrame, cfg: Config, ks: tuple[int, ...] = SHOTS, modes: tuple[bool, ...] = MODES) -> DataFrame:
    """One summary row for each mode and number of examples, ordered by them."""
    return summary(ablation_rows(questions, examples, catalog, cfg, ks, modes), "mode", "k").drop("f1", "f6").orderBy("mode", "k")


def compared(graph_run: DataFrame, base_run: DataFrame) -> DataFrame:
    """One row: means of both runs, and the differences."""
    names = ["avg_recall", "avg_precision", "avg_prompt_tokens", "n_samples"]
    a, b = summary(graph_run), summary(base_run)
    both = a.select(*[F.col(c).alias(f"graph_{c}") for c in names]).crossJoin(b.select(*[F.col(c).alias(f"base_{c}") for c in names]))  # one row each
    return both.withColumns({f"delta_{c}": F.col(f"graph_{c}") - F.col(f"base_{c}") for c in names[:3]})


def comparison(questions: DataFrame, examples: DataFrame | None, catalog: DataFrame, cfg: Config) -> DataFrame:
    """Column mode with examples beside table mode without, on the same questions, and the differences."""
    return compared(run(questions, examples, catalog, replace(cfg, table_mode=False)), run(questions, None, catalog, replace(cfg, table_mode=True)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question on the star schema: its hits, expanded along join paths, as a prompt."""
    from querylume.plans.questions import star_examples

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("q_id"), F.lit("star").alias("db_id"), F.col("text").alias("question"))
    bench = bench.repartition(spark.sparkContext.defaultParallelism)  # one small file, from which each text makes hundreds of phrases
    return prompts(bench, star_examples(spark), cat.of_tables(spark, sf_dir), Config()).select("q_id", "db_id", "question", "ddl", "prompt")
