"""Item tables: keys, columns, option handling, expansion and packing."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.operators.ordered import prefix_fold, same_keys_join, with_position

LABELS = list(string.ascii_uppercase)


def item_options(labels: Sequence[str] = "ABCD") -> Column:
    return tx.options_map(list(labels), list(labels))


def drop_missing_payload(df: DataFrame, payload: str = "image") -> DataFrame:
    return df.filter(F.col(payload).isNotNull())


def ensure_index(df: DataFrame, order: str | Sequence[str], tie: Sequence[str] = (), index: str = "index") -> DataFrame:
    """Add a dense index by a stable order when the table has none."""
    return df if index in df.columns else with_position(df, order, index, tie=tie)


def with_index_number(df: DataFrame, index: str = "index") -> DataFrame:
    return df.withColumn(f"{index}_num", F.col(index).try_cast("bigint"))


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case names, option labels A..Z excepted."""
    return df.toDF(*[c if c in LABELS else c.lower() for c in df.columns])


def open_to_choice(df: DataFrame) -> DataFrame:
    """Rows without options become a choice between the answer and everything else."""
    is_open = F.col("A").isNull()
    return df.select(
        *[c for c in df.columns if c not in ("A", "B", "answer")],
        F.when(is_open, F.col("answer")).otherwise(F.col("A")).alias("A"),
        F.when(is_open, "Other Answers").otherwise(F.col("B")).alias("B"),
        F.when(is_open, "A").otherwise(F.col("answer")).alias("answer"),
    )


def split_on_image_tags(
    df: DataFrame, text: str, keys: Sequence[str], turn: str, tag: str = "<image>"
) -> DataFrame:
    """One row per text segment; ``image`` is the running number of the image before it."""
    tagged = df.withColumn("_parts", F.split(text, tag))
    tagged = prefix_fold(tagged, F.size("_parts") - 1, turn, "_base", keys)
    base = F.coalesce(F.col("_base"), F.lit(0).cast("bigint"))
    return tagged.select(*keys, turn, base.alias("_base"), F.posexplode("_parts").alias("segment", "part")).select(
        *keys, turn, "segment", "part",
        F.when(F.col("segment") > 0, F.col("_base") + F.col("segment") - 1).alias("image"),
    )


def of_question_type(df: DataFrame, kind: str, column: str = "question_type") -> DataFrame:
    """Rows of one question type; all rows when the table has no such column."""
    return df.filter(F.col(column) == kind) if column in df.columns else df


def resolve_shared_payload(df: DataFrame, payload: str, index: str = "index", longest: int = 64) -> DataFrame:
    """Short payloads name the row that owns the payload; ``payload_error`` marks broken references.

    Only the referring rows and the owners they name take part in the join; other payloads pass
    through without being shuffled for it.
    """
    refers = F.length(payload) <= longest
    short = df.filter(refers).withColumn("_ref", F.col(payload))
    named = short.select("_ref").distinct()
    owners = df.filter(~refers).select(F.col(index).cast("string").alias("_ref"), F.col(payload).alias("_owned"))
    short = short.join(owners.join(named, "_ref", "left_semi"), "_ref", "left")
    resolved = short.withColumn("payload_error", F.when(F.col("_owned").isNull(), "unknown owner"))
    resolved = resolved.withColumn(payload, F.coalesce("_owned", payload)).drop("_ref", "_owned")
    kept = df.filter(F.coalesce(~refers, F.lit(True))).withColumn("payload_error", F.lit(None).cast("string"))
    return kept.unionByName(resolved)


def payload_fanout(df: DataFrame, payloads: str, path: str, index: str = "index") -> tuple[DataFrame, DataFrame]:
    """(files, items): one row per payload with its path, and the items holding only the paths.

    A single payload keeps the path; several get ``path_0 .. path_n``.
    """
    named = lambda path_, n, i: F.when(n > 1, F.concat(path_, F.lit("_"), i.cast("string"))).otherwise(path_)
    files = df.select(index, path, F.size(payloads).alias("_n"), F.posexplode(payloads).alias("pos", "payload")).select(
        index, "pos", named(F.col(path), F.col("_n"), F.col("pos")).alias("path"), F.unbase64("payload").alias("content"))
    paths = F.transform(F.col(payloads), lambda _, i: named(F.col(path), F.size(payloads), i))
    return files, df.withColumn("paths", paths).drop(payloads)


def submission_export(df: DataFrame, key: str = "index", labels: Sequence[str] = "ABCD") -> DataFrame:
    """Choice rows export the inferred letter, open rows the raw reply."""
    from scoreloom.functions.extract import infer

    inferred = infer(F.col("prediction"), item_options(labels))
    return df.select(key, F.when(F.col("A").isNotNull(), inferred).otherwise(F.col("prediction")).alias("value"))


def submission_rows(df: DataFrame, labels: Sequence[str] = "ABCD", fallback: str = "Z", note: str = "no option found in the reply") -> DataFrame:
    """The prediction rows with the option read from each reply (``opt``) and what was read (``log``): the reply, or ``note`` where no option is in it."""
    from scoreloom.functions.extract import infer

    read = df.withColumn("opt", infer(F.col("prediction"), item_options(labels)))
    return read.withColumns({"opt": F.coalesce("opt", F.lit(fallback)), "log": F.when(F.col("opt").isNull(), note).otherwise(F.col("prediction"))})


def shuffle_two_options(df: DataFrame, first: str, second: str, coin: Column) -> DataFrame:
    """Put two texts in A / B by a coin; ``answer`` is the place of the second one."""
    heads = coin == 1
    return df.withColumns({
        "A": F.when(heads, F.col(first)).otherwise(F.col(second)), "B": F.when(heads, F.col(second)).otherwise(F.col(first)),
        "answer": F.when(heads, "B").otherwise("A")}).drop(first, second)


def organise_tasks(df: DataFrame, task: str, order: str, description: str, query: Column, tie: Sequence[str] = ()) -> DataFrame:
    """Flat rows as the queries of tasks: (task, position, query, description).

    One row per query, so that a task of any size is never gathered in one place; a sink that wants
    nested lists groups them there.
    """
    placed = with_position(df, order, "position", [task], tie).select(task, "position", query.alias("query"))
    described = df.groupBy(task).agg(F.min(description).alias("description"))
    return same_keys_join(placed, described, [task])


PAIR = "array<struct<question:string,answer:string>>"


def expand_qa_pairs(df: DataFrame, question: str = "question") -> tuple[DataFrame, DataFrame]:
    """(pairs, rejected): one row per question-answer pair, and the rows whose list cannot be read."""
    parsed = df.withColumn("_pairs", F.from_json(question, PAIR))
    good = F.col("_pairs").isNotNull() & ~F.exists("_pairs", lambda p: p["question"].isNull())
    keep = [c for c in df.columns if c != question]
    pairs = parsed.filter(good).select(*keep, F.posexplode("_pairs").alias("pair", "_p")).select(
        *keep, "pair", F.col("_p.question").alias(question), F.col("_p.answer").alias("answer"))
    return pairs, parsed.filter(~F.coalesce(good, F.lit(False))).drop("_pairs")


def question_rows(df: DataFrame, video: str, index: str, question: str) -> DataFrame:
    """A video's questions as rows (video, position, key, question), for sinks that stream them."""
    placed = with_position(df.select(video, index, question), index, "position", [video])
    return placed.select(video, "position", F.col(index).cast("string").alias("key"), question)


def pack_questions(df: DataFrame, video: str, index: str, question: str) -> DataFrame:
    """All questions of a video as one JSON map in order of their index: a prompt each video."""
    entry = F.struct(F.col(index).alias("i"), F.col(index).cast("string").alias("key"), F.col(question).alias("value"))
    lists = df.groupBy(video).agg(F.sort_array(F.collect_list(entry)).alias("_l"))
    as_map = F.map_from_entries(F.transform("_l", lambda e: F.struct(e["key"], e["value"])))
    return lists.select(video, F.to_json(as_map).alias("questions"))


def read_answer_map(reply: Column) -> Column:
    """JSON object of a reply; else ``key: value`` lines after its only brace; else null."""
    text = F.trim(reply)
    whole = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "map<string,string>")
    body = F.substring_index(text, "{", -1)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x.contains(": "))
    side = lambda x: F.regexp_replace(F.trim(x), "^[\"',]+|[\"',]+$", "")
    pairs = F.transform(lines, lambda x: F.struct(side(F.split_part(x, F.lit(": "), F.lit(1))).alias("key"), side(F.split_part(x, F.lit(": "), F.lit(2))).alias("value")))
    one_brace = (F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))) == 1
    loose = F.map_from_entries(F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "")))
    return F.coalesce(whole, F.when(one_brace, loose))


def unpack_answers(packs: DataFrame, items: DataFrame, video: str, index: str, reply: str) -> tuple[DataFrame, DataFrame]:
    """(items with ``prediction``, counters): replies opened and looked up per question."""
    failed = tx.is_failure(F.col(reply))
    opened = packs.select(video, failed.alias("_failed"), F.when(~failed, read_answer_map(F.col(reply))).alias("_m"))
    answers = opened.select(video, F.explode("_m").alias("_key", "prediction")).groupBy(video, "_key").agg(F.max("prediction").alias("prediction"))
    joined = same_keys_join(items.withColumn("_key", F.col(index).cast("string")), answers, [video, "_key"], how="left").drop("_key")
    replies = opened.agg(F.count_if("_failed").alias("GEN_FAIL"), F.count_if(~F.col("_failed") & F.col("_m").isNotNull()).alias("PARSE_OK"),
                         F.count_if(~F.col("_failed") & F.col("_m").isNull()).alias("PARSE_FAIL"))
    valid = joined.agg(F.count("prediction").alias("VALIDQ"), F.count_if(F.col("prediction").isNull()).alias("INVALIDQ"))
    counters = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in df.columns])))
    return joined, counters(replies).unionByName(counters(valid))


def scatter_by_benchmark(df: DataFrame, route: Column, scorers: dict[str, Column], score: str = "score") -> DataFrame:
    """One plan for a composite benchmark: each row is scored by the scorer its route names.

    Rows with an unknown route get a null score and the route in ``route_error``.
    """
    known = F.coalesce(*[F.when(route == k, v.cast("double")) for k, v in scorers.items()])
    return df.withColumns({"benchmark": route, score: known, "route_error": F.when(~route.isin(list(scorers)), route)})
