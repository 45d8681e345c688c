"""Chat rendering: messages to one training text, by a template of three strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A neutral template: begin, then for each message ``<|role|>`` line, content, end mark."""

    begin: str = ""
    before: str = "<|{role}|>\n"
    after: str = "<|end|>\n"
    prompt: str = "<|assistant|>\n"


def render(messages: Column | str, template: Template | None = None, generation_prompt: bool = False) -> Column:
    t = template or Template()
    head, _, tail = t.before.partition("{role}")
    each = F.transform(messages, lambda m: F.concat(F.lit(head), m["role"], F.lit(tail), F.coalesce(m["content"], F.lit("")), F.lit(t.after)))
    return F.concat(F.lit(t.begin), F.array_join(each, ""), F.lit(t.prompt if generation_prompt else ""))


def with_text(df: DataFrame, template: Template | None = None) -> DataFrame:
    return df.withColumn("text", render("messages", template))


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, messages) of turn rows, in the order of turns."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(F.transform(rows, lambda m: F.struct(m["role"], m["content"])).alias("messages"))
