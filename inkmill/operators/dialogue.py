"""Messages of a conversation (conv_id, turn, role, text, tool_calls) as a model gets them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the context.
SUMMARISE_AFTER, KEPT, SUMMARY_CHARS, HISTORY_TURNS, QUOTE = 20, 8, 8000, 6, 240


def bounded_context(messages: DataFrame, after: int = SUMMARISE_AFTER, kept: int = KEPT, most: int = SUMMARY_CHARS) -> DataFrame:
    """What is to be summarised of each conversation: conv_id, summarised (messages) and old (their text, cut).

    A conversation of over `after` messages gives all but its last `kept`; a shorter one nothing.
    """
    by = Window.partitionBy("conv_id")
    rows = messages.withColumn("n", F.count("*").over(by)).withColumn("back", F.row_number().over(by.orderBy(F.desc("turn"))))
    old = (F.col("n") > after) & (F.col("back") > kept)
    line = F.when(old, F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg(F.count_if(old).alias("summarised"), F.substring(joined, 1, most).alias("old"))


def history(messages: DataFrame, turns: int = HISTORY_TURNS) -> DataFrame:
    """The last messages before the current request: a user's, and an assistant's that have a text and call no tool.

    Where no user has spoken, nothing is taken for the request.
    """
    by = Window.partitionBy("conv_id")
    request = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(by)
    answer = (F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) != "") & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0)
    rows = messages.withColumn("request", request).filter(((F.col("role") == "user") | answer) & (F.col("request").isNull() | (F.col("turn") < F.col("request"))))
    return rows.withColumn("back", F.row_number().over(by.orderBy(F.desc("turn")))).filter(F.col("back") <= turns).drop("request", "back")


def last_request(messages: DataFrame) -> DataFrame:
    """conv_id and request, the text of the last message by a user."""
    return messages.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("request"))


def answerable(messages: DataFrame) -> DataFrame:
    """messages without a last one whose tool calls were never run."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    pending = (F.col("turn") == F.col("last")) & (F.coalesce(F.size("tool_calls"), F.lit(0)) > 0)
    return messages.withColumn("last", last).filter(~pending).drop("last")


def collected_hits(hits: DataFrame) -> DataFrame:
    """Hits of tool answers (conv_id, arrival, chunk_id ...), the last of each chunk, without those that name none."""
    rest = [c for c in hits.columns if c not in ("conv_id", "chunk_id")]
    kept = hits.filter(F.coalesce("chunk_id", F.lit("")) != "").groupBy("conv_id", "chunk_id").agg(F.max_by(F.struct(*rest), "arrival").alias("hit"))
    return kept.select("conv_id", "chunk_id", "hit.*")


def citation_records(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations (conv_id, n, chunk_id, document_id, title, page_start, page_end, quote, score) of answers (conv_id, cited: ids in order)."""
    cited = answers.select("conv_id", F.posexplode("cited").alias("pos", "chunk_id"))
    return cited.join(hits, ["conv_id", "chunk_id"]).select("conv_id", (F.col("pos") + 1).alias("n"), "chunk_id", "document_id", F.col("document_title").alias("title"), "page_start", "page_end", F.substring(F.coalesce("text", F.lit("")), 1, QUOTE).alias("quote"), "score")
