"""Question-answer pairs: nested records to flat, clean, distinct rows, and on to chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import qa_field
from textloom.operators.ordering import first_occurrence


def flatten_variants(records: DataFrame, obj: str = "obj", order: str = "idx", deduplicate: bool = True) -> DataFrame:
    """question, answer and their place from records of JSON text.

    A record whose pairs are no list, and an element that is no object, fall out alone; values that are not strings
    become their JSON text. Empty sides fall out after cleaning; the first of equal pairs stays.
    """
    rows = records.select(order, F.try_parse_json(obj).alias("v")).filter(F.col("v").isNotNull())
    rows = rows.select(order, F.try_variant_get("v", "$.pairs", "array<variant>").alias("pairs"))
    each = rows.select(order, F.posexplode("pairs").alias("pos", "pair")).filter(F.schema_of_variant("pair").startswith("OBJECT"))
    return clean_pairs(each.select(order, "pos", *(F.try_variant_get("pair", f"$.{k}", "string").alias(k) for k in ("question", "answer"))), [order, "pos"], deduplicate)


def flatten(records: DataFrame, pairs: str = "pairs", order: str = "idx", deduplicate: bool = True) -> DataFrame:
    """The same for a typed array of pairs."""
    each = records.select(order, F.posexplode(pairs).alias("pos", "pair")).select(order, "pos", "pair.question", "pair.answer")
    return clean_pairs(each, [order, "pos"], deduplicate)


def clean_pairs(rows: DataFrame, order: list[str], deduplicate: bool = True) -> DataFrame:
    out = rows.withColumns({k: qa_field(k) for k in ("question", "answer")}).filter((F.col("question") != "") & (F.col("answer") != ""))
    return first_occurrence(out, ["question", "answer"], order) if deduplicate else out


def supported(pairs: DataFrame, text: Column | str = "text", risks: tuple[str, ...] = ("low",)) -> DataFrame:
    """Opt-in: pairs that their annotator calls supported, of low risk, and whose quotes occur in the text."""
    quotes = F.forall("evidence_quotes", lambda q: F.contains(F.col(text) if isinstance(text, str) else text, q))
    return pairs.filter(F.col("answer_fully_supported") & F.col("hallucination_risk").isin(*risks) & quotes)


def messages(qa: DataFrame) -> DataFrame:
    """Adds messages: the question by the user, the answer by the assistant."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return qa.withColumn("messages", F.array(turn("user", "question"), turn("assistant", "answer")))


def pairs_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """question and answer of each user turn that an assistant turn follows."""
    w = Window.partitionBy(conv).orderBy(turn)
    rows = turns.select(conv, turn, "role", F.col("text").alias("question"), F.lead("role").over(w).alias("_role"), F.lead("text").over(w).alias("answer"))
    return rows.filter((F.col("role") == "user") & (F.col("_role") == "assistant")).select(conv, turn, "question", "answer")
