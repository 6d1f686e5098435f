"""How each collection was built, and a log of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import Settings


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last by order: a partial aggregate, so a hot key is combined before the shuffle."""
    others = [c for c in rows.columns if c not in (key, *order)]
    last = F.max(F.struct(*order, *others)).alias("_r")
    return rows.groupBy(key).agg(last).select(key, *(F.col(f"_r.{c}").alias(c) for c in (*order, *others)))


def upsert(old: DataFrame, new: DataFrame, key: str = "collection") -> DataFrame:
    """New rows, and the old ones whose key has no new row."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def record(spark: SparkSession, collection: str, chunk_count: int, guides: list[str], settings: Settings) -> DataFrame:
    row = {"collection": collection, "chunk_count": chunk_count, "guides": sorted(guides), **settings.tracked()}
    names = [c.split(" ")[0] for c in schema.REGISTRY.split(", ") if not c.startswith("built_at")]
    kinds = ", ".join(c for c in schema.REGISTRY.split(", ") if not c.startswith("built_at"))
    made = spark.createDataFrame([tuple(row[n] for n in names)], kinds)
    return made.withColumn("built_at", F.date_trunc("second", F.current_timestamp())).select(*(c.split(" ")[0] for c in schema.REGISTRY.split(", ")))


def get(registry: DataFrame, collection: str) -> dict:
    """The row as a dict, {} if there is none."""
    found = registry.filter(F.col("collection") == collection).head(1)
    return found[0].asDict() if found else {}


def check_embedding_model(registry: DataFrame, collection: str, settings: Settings) -> None:
    """Raises if the collection was built with another model; an unknown one passes."""
    known = get(registry, collection).get("embedding_model")
    if known and known != settings.embedding_model:
        raise RuntimeError(f"collection {collection!r} was built with {known!r}, settings say {settings.embedding_model!r}")


def metric_name(name: Column) -> Column:
    return F.replace(name, F.lit("@"), F.lit("_at_"))


def log_run(spark: SparkSession, path: str, run_name: str, kind: str, params: dict, metrics: dict, tags: dict | None = None) -> None:
    """Appends a run; metrics without a value are left out."""
    rename = lambda d: {k.replace("@", "_at_"): float(v) for k, v in d.items() if v is not None}
    text = lambda d: {k: str(v) for k, v in d.items()}
    spark.createDataFrame([(run_name, kind, text(params), rename(metrics), text(tags or {}))], schema.RUN).coalesce(1).write.mode("append").parquet(path)


def log_retrieval(spark, path, registry: DataFrame, collection: str, metrics: dict, tag_metrics: dict, questions: int) -> None:
    build = get(registry, collection)
    params = {k: v for k, v in build.items() if k != "guides"} | {"guide_count": len(build.get("guides") or [])} if build else {"build_config": "unknown"}
    log_run(spark, path, collection, "retrieval", params | {"questions_scored": questions}, metrics | {f"tag_{k}": v for k, v in tag_metrics.items()}, {"collection": collection, "built_at": build.get("built_at", "unknown")})


def log_generation(spark, path, registry: DataFrame, collection: str, settings: Settings, metrics: dict, questions: int) -> None:
    params = {k: v for k, v in get(registry, collection).items() if k != "guides"}
    params |= {"llm_model": settings.llm_model, "judge_model": settings.judge_model, "judge_independent": settings.judge_model != settings.llm_model, "top_k": settings.top_k, "questions_scored": questions}
    log_run(spark, path, f"generation_{collection}", "generation", params, metrics, {"collection": collection})


def log_comparison(spark, path, baseline: str, comparisons: dict[str, tuple[float, float, float]]) -> None:
    metrics = {f"{name}_{what}": x for name, values in comparisons.items() for what, x in zip(("mrr_diff", "t", "p"), values)}
    log_run(spark, path, f"comparison_vs_{baseline}", "significance", {"baseline": baseline}, metrics)


def leaderboard(runs: DataFrame, metric: str = "mrr_at_10") -> DataFrame:
    return runs.withColumn(metric, F.try_element_at("metrics", F.lit(metric))).orderBy(F.desc_nulls_last(metric), "run_name")


#: Size of a time sketch, and the rank error that its quantiles stay within.
SKETCH_K, RANK_ERROR = 800, 0.0165


def time_sketches(times: DataFrame, run: str, seconds: str) -> DataFrame:
    """run_name, n and a mergeable sketch of the seconds of each run: combined in every task before the shuffle."""
    return times.groupBy(F.col(run).cast("string").alias("run_name")).agg(F.count(seconds).alias("n"), F.kll_sketch_agg_double(F.col(seconds).cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def log_times(times: DataFrame, path: str, run: str = "run_name", seconds: str = "seconds") -> None:
    """Appends the sketches of these runs; a run may be logged in several parts."""
    time_sketches(times, run, seconds).write.mode("append").parquet(path)


def time_quantiles(log: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """run_name, n and the named quantiles of each run, and of all runs where run_name is null, from sketches alone."""
    merged = F.kll_merge_agg_double("sketch").alias("sketch")
    per = log.filter("n > 0").groupBy("run_name").agg(F.sum("n").alias("n"), merged)
    over = per.agg(F.sum("n").alias("n"), merged).select(F.lit(None).cast("string").alias("run_name"), "n", "sketch").filter("n IS NOT NULL")
    quantile = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))
    return per.unionByName(over).select("run_name", "n", *(quantile(q).alias(name) for name, q in ranks.items()))
