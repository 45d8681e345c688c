"""Row types that pipelines exchange."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

_s = lambda *names: [StructField(n, StringType()) for n in names]

ARTICLE = StructType(_s("source", "title", "published_at", "url", "text"))
PAIR = StructType(
    [*_s("question", "answer", "stance_type", "stance_statement"), StructField("evidence_quotes", ArrayType(StringType())), StructField("answer_fully_supported", BooleanType()), *_s("hallucination_risk")]
)
ANNOTATED = StructType([*_s("title", "source", "published_at", "url", "text"), StructField("pairs", ArrayType(PAIR)), *_s("error", "raw_model_text")])
QA = StructType(_s("question", "answer"))
MESSAGE = StructType(_s("role", "content"))
CHAT = StructType([StructField("messages", ArrayType(MESSAGE))])
