"""User functions over items: resumable runs, rules before judges, dialogs, metric registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import extract as ex
from scoreloom.functions import fixed
from scoreloom.functions import score as sc
from scoreloom.operators.joins import undone
from scoreloom.operators.ordered import same_keys_join
from scoreloom.sources.tables import scratch_folder


def _call(fn: Callable[[dict], str], row: dict) -> str:
    try:
        return fn(row)
    except Exception as error:  # a failing row is recorded, the run goes on
        return f"{fixed.FAILURE_TEXT}: {error}"


def apply_rows(items: DataFrame, fn: Callable[[dict], str], key: str, output: str = "prediction") -> DataFrame:
    """``fn(row) -> text`` over every row in Arrow batches; exceptions become failure texts."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], output: [_call(fn, r) for r in frame.to_dict("records")]})

    return items.mapInPandas(batches, f"`{key}` {items.schema[key].dataType.simpleString()}, `{output}` string")


def resumable_apply(
    items: DataFrame, results: DataFrame, fn: Callable[[dict], str], key: str, output: str = "prediction", retry_failed: bool = True
) -> DataFrame:
    """Accepted results plus fresh ones for the items that lack one; of repeated results the greatest counts."""
    failed = F.col(output).contains(fixed.FAILURE_TEXT)
    fresh = apply_rows(undone(items, results, key, failed if retry_failed else None), fn, key, output)
    wanted = results.join(items.select(key), key, "left_semi").select(key, output)
    accepted = (wanted.filter(~failed) if retry_failed else wanted).groupBy(key).agg(F.max(output).alias(output))
    return accepted.unionByName(fresh)


def resumable_run(items: DataFrame, path: str, fn: Callable[[dict], str], key: str, output: str = "prediction", retry_failed: bool = True) -> DataFrame:
    """One run against a result table on shared storage: apply to the undone items and append.

    The append is committed as a whole by Spark's writer, lost tasks are retried, and a run that was
    cut off starts again with what is not yet in the table. The last result per item counts.
    """
    spark = items.sparkSession
    schema = f"`{key}` {items.schema[key].dataType.simpleString()}, `{output}` string, attempt bigint"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    table = spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
    latest = lambda t: t.groupBy(key).agg(F.max_by(output, "attempt").alias(output))
    done = latest(table)
    failed = F.col(output).contains(fixed.FAILURE_TEXT) if retry_failed else None
    attempt = (table.agg(F.max("attempt")).first()[0] or 0) + 1
    fresh = apply_rows(undone(items, done, key, failed), fn, key, output)
    fresh.withColumn("attempt", F.lit(attempt).cast("bigint")).write.mode("append").parquet(path)
    return latest(spark.read.schema(schema).parquet(path))


def rule_then_judge(
    df: DataFrame, rule: Column, judge: Callable[[dict, int], str | None], key: str, fallback: str = "Z", retries: int = 3, output: str = "answer"
) -> DataFrame:
    """Rules for all rows, the judge only for those they leave open, a fixed fallback at last.

    The judge gets the attempt number (to raise its temperature) and may return None to be asked again.
    Each row is judged in one place, so a plan never asks twice.
    """
    ruled = df.withColumn(output, rule)

    def ask(row: dict) -> str:
        for attempt in range(retries):
            said = judge(row, attempt)
            if said is not None:
                return said
        return fallback

    columns = [c for c in df.columns]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            answers = table.column(len(columns)).to_pylist()
            by = ["judge" if a is None else "rule" for a in answers]
            for i in [i for i, a in enumerate(answers) if a is None]:
                said = _call(ask, {c: table.column(k)[i].as_py() for k, c in enumerate(columns)})
                answers[i] = fallback if fixed.FAILURE_TEXT in said else said
            yield pa.RecordBatch.from_arrays([*table.columns[: len(columns)], pa.array(answers, pa.string()), pa.array(by, pa.string())], names=[*columns, output, "solved_by"])

    # rules are evaluated once: solved rows pass through
    return ruled.select(*columns, output).mapInArrow(batches, f"{names}, `{output}` string, `solved_by` string")


def judge_groups(
    df: DataFrame, group: str, order: str, key: str, truth: str, rule: Column, judge: Callable[[dict, int], str | None], fallback: str = "Z", retries: int = 3
) -> DataFrame:
    """(group, hit, judged): whether all rows of a group say their ``truth``, and how many of them the judge was asked about.

    A group whose rules already read a wrong answer is lost without a judge. The others are judged in rounds,
    a row of each open group at a time in ``order``; a group leaves at its first failure, so that no row after it
    is asked about. Every round is written to the shared folder, so a lost task never asks a finished round again.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, "judged-groups")

    def kept(found: DataFrame, name: str) -> DataFrame:
        found.write.parquet(f"{folder}/{name}")
        return spark.read.schema(found.schema).parquet(f"{folder}/{name}")

    ruled = df.withColumn("_said", rule)
    wrong = F.col("_said").isNotNull() & ~F.col("_said").eqNullSafe(F.col(truth))
    state = kept(ruled.groupBy(group).agg(F.max(wrong).alias("lost")), "ruled")
    left = same_keys_join(ruled.filter("_said IS NULL").drop("_said"), state.filter("NOT lost").drop("lost"), [group])
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, key))
    left = kept(left.withColumn("_round", place), "open")
    rounds = left.agg(F.max("_round")).first()[0] or 0
    answers = spark.createDataFrame([], ruled.select(group, F.lit(True).alias("right")).schema)
    for n in range(1, rounds + 1):
        lost = answers.filter("NOT right").select(group)
        other = lost.withColumnRenamed(group, "_lost")
        asked = left.filter(F.col("_round") == n).join(other, F.col(group).eqNullSafe(F.col("_lost")), "left_anti").drop("_round")
        said = rule_then_judge(asked, F.lit(None).cast("string"), judge, key, fallback, retries, "_said")
        answers = answers.unionByName(kept(said.select(group, F.col("_said").eqNullSafe(F.col(truth)).alias("right")), f"round-{n}"))
    sums = answers.groupBy(group).agg(F.min("right").alias("right"), F.count(F.lit(1)).alias("judged"))
    both = same_keys_join(state, sums, [group], how="left")
    hit = ~F.col("lost") & F.coalesce("right", F.lit(True))
    return both.select(group, hit.cast("int").alias("hit"), F.coalesce("judged", F.lit(0)).alias("judged"))


def multi_turn_apply(dialogs: DataFrame, fn: Callable[[list[dict], str], str], key: str, questions: str) -> DataFrame:
    """Dialogs stored as one row with an array of questions: each turn sees the earlier ones.

    ``fn(history, question)`` gets the earlier turns as role/content records; a failing turn is
    recorded and the dialog goes on. Returns (key, answers).
    """

    def talk(turns) -> list[str]:
        history, answers = [], []
        for question in turns:
            said = _call(lambda row: fn(row["history"], row["question"]), {"history": list(history), "question": question})
            answers.append(said)
            history += [{"role": "user", "content": question}, {"role": "assistant", "content": said}]
        return answers

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "answers": [talk(t) for t in frame[questions]]})

    return dialogs.select(key, questions).mapInPandas(batches, f"`{key}` {dialogs.schema[key].dataType.simpleString()}, answers array<string>")


def _items(s: Column, mark: str = ",") -> Column:
    """A list written with ``mark`` between its items."""
    return F.transform(F.split(s, mark), lambda x: F.trim(x))


def _map(s: Column) -> Column:
    return F.from_json(s, "map<string,string>")


def _boxed(p: Column, t: Column, score: Callable[[Column, Column], Column]) -> Column:
    """A score of two written boxes; 0 where the prediction has none."""
    return F.when(ex.parse_bbox(t).isNotNull(), F.coalesce(score(ex.parse_bbox(p), ex.parse_bbox(t)).cast("double"), F.lit(0.0)))


# metric name -> builder of the score column from (prediction, truth)
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "exact_str_match": sc.string_exact,
    "exact_str_match_case_insensitive": sc.string_exact_ignore_case,
    "simple_str_match": sc.string_simple,
    "edit_similarity": sc.edit_similarity,
    "near_str_match": sc.near_match,
    "number_rel_diff_ratio": lambda p, t: sc.relative_difference(sc.as_float(p), sc.as_float(t)),
    "positive_int_match": lambda p, t: sc.positive_int_match(p.try_cast("bigint"), t.try_cast("bigint")),
    "set_equality": lambda p, t: sc.set_equal(F.split(p, ","), F.split(t, ",")),
    "jaccard": lambda p, t: sc.jaccard(F.split(p, ","), F.split(t, ",")),
    "set_precision": lambda p, t: sc.set_precision(F.split(p, ","), F.split(t, ",")),
    "sequence_equality": lambda p, t: sc.sequence_equal(F.split(p, ","), F.split(t, ",")),
    "longest_common_list_prefix_ratio": lambda p, t: sc.common_prefix_ratio(F.split(p, ","), F.split(t, ",")),
    "denotation": sc.denotation_match,
    "jaccard_index": lambda p, t: sc.jaccard(_items(p), _items(t)),
    "jaccard_index_case_insensitive": lambda p, t: sc.jaccard(_items(F.lower(p)), _items(F.lower(t))),
    "set_recall": lambda p, t: sc.set_recall(_items(p), _items(t)),
    "set_equality_case_insensitive": lambda p, t: sc.set_equal(_items(p), _items(t), ignore_case=True),
    "str_set_equality_comma": lambda p, t: sc.set_equal(_items(p), _items(t)),
    "str_set_equality_line_break": lambda p, t: sc.set_equal(_items(p, "\n"), _items(t, "\n")),
    "sequence_equality_case_insensitive": lambda p, t: sc.sequence_equal(_items(p), _items(t), ignore_case=True),
    "sequence_accuracy_case_insensitive": lambda p, t: sc.sequence_accuracy(_items(F.lower(p)), _items(F.lower(t))),
    "dict_equality": lambda p, t: sc.map_equal(_map(p), _map(t)),
    "dict_precision": lambda p, t: sc.map_precision(_map(p), _map(t)),
    "dict_recall": lambda p, t: sc.map_recall(_map(p), _map(t)),
    "multi_ref_phrase": lambda p, t: sc.string_any_reference(p, _items(t, r"\|")),
    "nbbox_iou_single": lambda p, t: _boxed(p, t, sc.box_iou),
    "xml_norm_point_in_bbox": lambda p, t: _boxed(p, t, sc.center_in_box),
    "general_single_numerical_match": lambda p, t: sc.numbers_equal(p, t),
}


def metric_scores(df: DataFrame, metric: str, prediction: str, truth: str, extra: Mapping[str, Callable] | None = None) -> DataFrame:
    """``score`` by the metric each row names; unknown names give null."""
    registry = {**METRICS, **(extra or {})}
    chosen = F.coalesce(*[F.when(F.col(metric) == name, fn(F.col(prediction), F.col(truth)).cast("double")) for name, fn in registry.items()])
    return df.withColumn("score", chosen)
