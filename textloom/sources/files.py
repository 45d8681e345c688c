"""File sources and sinks: article CSV, JSON in any framing, JSON Lines, and the counts that go with a write."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.schemas import ARTICLE, CHAT, QA

# the last one is NUL by default, and NULs in quoted fields would go
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "charToEscapeQuoteEscaping": '"'}
AS_IT_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def by_name(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order, by name; those that are missing are null."""
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def read_articles_csv(spark: SparkSession, path: str) -> DataFrame:
    """Articles from CSV with a header in any column order: quoted line feeds, doubled quotes, byte-order marks.

    An empty field is null, one of two quotes an empty string. (Spark reads both as its null value, "" unless told
    otherwise; a random one is equal to no field.)
    """
    return by_name(spark.read.options(**CSV, nullValue=uuid.uuid4().hex, emptyValue="").csv(path), ARTICLE)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def json_objects(text: str | None, strict: bool = True) -> Iterator[str]:
    """Objects of a text as JSON: an array's elements, one object, or objects in a row with or without commas.

    Other values are passed over, arrays among several values too. Trailing garbage is an error, or the end if not strict.
    """
    text = (text or "").removeprefix("﻿").strip()
    if not text:
        return
    try:
        whole = json.loads(text)
        for item in whole if isinstance(whole, list) else [whole]:
            if isinstance(item, dict):
                yield json.dumps(item, ensure_ascii=False)
        return
    except json.JSONDecodeError:
        pass
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text):
            return
        try:
            item, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            if strict:
                raise
            return
        if isinstance(item, dict):
            yield json.dumps(item, ensure_ascii=False)


class JsonObjects:
    """A table function: (idx, obj) of a text in any framing."""

    def eval(self, text: str, strict: bool):
        yield from enumerate(json_objects(text, strict))


def read_json_objects(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, idx, obj) of files in any framing. A file is one row here; use ``read_jsonl`` for large JSON Lines."""
    table = F.udtf(JsonObjects, returnType="idx bigint, obj string")
    spark.udtf.register("textloom_json_objects", table)
    read_whole(spark, path).createOrReplaceTempView("_textloom_whole")
    return spark.sql(f"SELECT path, t.idx, t.obj FROM _textloom_whole, LATERAL textloom_json_objects(value, {str(strict).lower()}) t")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CHAT)


def one_article(spark: SparkSession, **values: str | None) -> DataFrame:
    """An article given by hand."""
    return spark.createDataFrame([tuple(values.get(f.name) for f in ARTICLE.fields)], ARTICLE)


def _one_file(df: DataFrame, one_file: bool) -> DataFrame:
    return df.coalesce(1) if one_file else df


def write_articles_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Replaces the target; minimal quoting, header always. White space at the ends of a field stays."""
    _one_file(by_name(df, ARTICLE), one_file).write.mode("overwrite").options(header=True, escape='"', **AS_IT_IS).csv(path)


def write_qa_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """All fields quoted. Line feeds inside fields and white space at their ends stay as they are."""
    _one_file(by_name(df, QA), one_file).write.mode("overwrite").options(header=True, quoteAll=True, escape='"', **AS_IT_IS).csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False, keep_nulls: bool = False, one_file: bool = False) -> None:
    _one_file(df, one_file).write.mode("append" if append else "overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def not_yet_written(df: DataFrame, path: str, key: str = "url") -> DataFrame:
    """Rows whose key no earlier run wrote: a run that is repeated goes on."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return df
    return df.join(spark.read.schema(f"{key} string").json(path).distinct(), key, "left_anti")


def pretty(df: DataFrame) -> DataFrame:
    """(value): each row as indented JSON."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def counted(df: DataFrame, name: str = "counts", **tests) -> tuple[DataFrame, Observation]:
    """df and an observation of its rows (and of rows that pass tests), known after the write without a second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(t).alias(n) for n, t in tests.items())), seen
