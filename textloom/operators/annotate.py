"""Annotation by an external model: a provider interface, retries, re-asks and error records, one output row an input row."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.text import col
from textloom.schemas import ANNOTATED, PAIR

RETRY_CODES = (429, 503)
AGAIN = "\n\nThe last answer was no valid JSON object. Answer with one complete JSON object only."


class ProviderError(Exception):
    """A failed request. ``code`` is the HTTP status, None for a timeout."""

    def __init__(self, message: str, code: int | None = None, timeout: bool = False):
        super().__init__(message)
        self.code, self.timeout = code, timeout


class FormatError(ValueError):
    def __init__(self, message: str, raw_text: str = ""):
        super().__init__(message)
        self.raw_text = raw_text


class Provider(Protocol):
    """One is made for each partition, on the executor."""

    def generate(self, prompt: str, temperature: float) -> Any: ...


@dataclass
class Response:
    """What a provider may return; ``parsed`` comes first, then ``text``, then the parts of the first candidate that has any."""

    text: str | None = None
    parsed: dict | None = None
    candidates: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class Settings:
    attempts: int = 5
    backoff: float = 2.0
    backoff_most: float = 30.0
    asks: int = 3
    ask_delay: float = 1.0
    temperature: float = 0.0
    pause: float = 0.0


def retryable(e: Exception) -> bool:
    return isinstance(e, TimeoutError) or isinstance(e, ProviderError) and (e.timeout or e.code in RETRY_CODES)


def described(e: Exception) -> str:
    code = getattr(e, "code", None)
    return f"{type(e).__name__}{f' {code}' if code else ''}: {e}"


def with_retries(call: Callable[[], Any], s: Settings, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Up to ``attempts`` calls; delays double from ``backoff`` up to ``backoff_most``; other errors pass at once."""
    for n in range(1, s.attempts + 1):
        try:
            return call()
        except Exception as e:
            if not retryable(e) or n == s.attempts:
                raise
            sleep(min(s.backoff * 2 ** (n - 1), s.backoff_most))
    raise AssertionError


def response_text(r: Response) -> str:
    if r.text:
        return r.text
    for c in r.candidates:
        parts = "".join(p.get("text") or "" for p in c.get("parts", []))
        if parts:
            return parts
    return ""


def finish_reason(r: Response) -> str:
    return ", ".join(str(c["finish_reason"]) for c in r.candidates if c.get("finish_reason"))


def json_object(raw: str) -> Any:
    """The object in a model's text: a Markdown fence goes, then all from the first to the last brace."""
    raw = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", raw.strip()))
    a, b = raw.find("{"), raw.rfind("}")
    return json.loads(raw[a : b + 1] if -1 < a < b else raw)


def payload(r: Response) -> dict:
    if isinstance(r.parsed, dict):
        return r.parsed
    raw = response_text(r)
    try:
        out = json_object(raw) if raw else None
    except json.JSONDecodeError as e:
        raise FormatError(f"no JSON object in the answer: {e}; finish reason: {finish_reason(r) or 'unknown'}", raw) from e
    if not isinstance(out, dict):
        raise FormatError(f"no JSON object in the answer; finish reason: {finish_reason(r) or 'unknown'}", raw)
    return out


def ask(provider: Provider, prompt: str, s: Settings, sleep: Callable[[float], None] = time.sleep) -> dict:
    """An answer; malformed ones are asked again, warmer and with a reminder."""
    for n in range(s.asks):
        again = n > 0
        warm = max(s.temperature, 0.2) if again else s.temperature
        text = prompt + AGAIN if again else prompt
        r = with_retries(lambda text=text, warm=warm: provider.generate(text, warm), s, sleep)
        try:
            return payload(r if isinstance(r, Response) else Response(text=r) if isinstance(r, str) else Response(parsed=r))
        except FormatError:
            if n == s.asks - 1:
                raise
            sleep(s.ask_delay)
    raise AssertionError


def extract_json(raw: Column | str) -> Column:
    """The same object as a column of JSON text."""
    out = F.regexp_replace(F.regexp_replace(T.strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.coalesce(F.nullif(F.regexp_extract(out, r"(?s)\{.*\}", 0), F.lit("")), out)


STANCES = ("neutral",)
RISKS = ("low", "medium", "high")


def violations(pairs: Column | str, stances: Sequence[str] = STANCES, risks: Sequence[str] = RISKS, most_pairs: int = 3) -> Column:
    """What of the output schema an array of pairs breaks, as an array of names."""
    c = col(pairs)
    full = lambda p: F.forall(F.array(*(p[k.name].isNotNull() for k in PAIR.fields)), lambda x: x)
    tests = {
        "pairs_missing": c.isNull(),
        "too_many_pairs": F.size(c) > most_pairs,
        "field_missing": F.exists(c, lambda p: ~full(p)),
        "stance_unknown": F.exists(c, lambda p: ~p["stance_type"].isin(*stances)),
        "risk_unknown": F.exists(c, lambda p: ~p["hallucination_risk"].isin(*risks)),
        "quotes_out_of_range": F.exists(c, lambda p: ~F.size(p["evidence_quotes"]).between(1, 2)),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))


def json_schema(stances: Sequence[str] = STANCES, risks: Sequence[str] = RISKS, most_pairs: int = 3) -> dict:
    """The output contract as a JSON Schema, for providers that enforce one."""
    text = {"type": "string"}
    pair = {
        "question": text,
        "answer": text,
        "stance_type": {"type": "string", "enum": list(stances)},
        "stance_statement": text,
        "evidence_quotes": {"type": "array", "minItems": 1, "maxItems": 2, "items": text},
        "answer_fully_supported": {"type": "boolean"},
        "hallucination_risk": {"type": "string", "enum": list(risks)},
    }
    one = {"type": "object", "properties": pair, "required": list(pair), "additionalProperties": False}
    return {"type": "object", "properties": {"pairs": {"type": "array", "minItems": 0, "maxItems": most_pairs, "items": one}}, "required": ["pairs"], "additionalProperties": False}


def ordered(schema: Any) -> Any:
    """A copy of a JSON Schema in which every object lists its properties' order."""
    if isinstance(schema, list):
        return [ordered(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: {n: ordered(s) for n, s in v.items()} if k == "properties" else ordered(v) for k, v in schema.items()}
    return out | ({"propertyOrdering": list(schema["properties"])} if schema.get("type") == "object" and "properties" in schema else {})


def annotate(prompts: DataFrame, provider: Callable[[], Provider], settings: Settings | None = None) -> DataFrame:
    """ANNOTATED rows of prompts (title, source, published_at, url, text, prompt).

    Each row gives one row: pairs, or an error and the model's raw text. Filter and limit before: a partition's rows are
    asked one after another, with one provider. Run it in small batches and without speculation, as a retried task asks
    again.
    """
    s, names = settings or Settings(), [f.name for f in ANNOTATED.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                row = {k: r.get(k) for k in names[:5]} | {"pairs": [], "error": None, "raw_model_text": None}
                try:
                    pairs = ask(model, r["prompt"], s).get("pairs")
                    row["pairs"] = [{f.name: p.get(f.name) for f in PAIR.fields} for p in pairs or [] if isinstance(p, dict)] if isinstance(pairs, list) or pairs is None else []
                except Exception as e:
                    row["error"], row["raw_model_text"] = described(e) if retryable(e) else str(e), getattr(e, "raw_text", "") or None
                out.append(row)
                if s.pause:
                    time.sleep(s.pause)
            yield pd.DataFrame(out, columns=names)

    return prompts.mapInPandas(run, ANNOTATED)


class OfflineProvider:
    """A deterministic stand-in: one pair of the prompt's title and the first line of its text."""

    def generate(self, prompt: str, temperature: float) -> Response:
        title = re.search(r"^title: (.*)$", prompt, re.M)
        body = prompt.partition('"""\n')[2].split("\n", 1)[0]
        pair = {"question": f"What does {title[1] if title else ''} say?", "answer": body, "stance_type": STANCES[0], "stance_statement": "", "evidence_quotes": [body], "answer_fully_supported": True, "hallucination_risk": "low"}
        return Response(text="```json\n" + json.dumps({"pairs": [pair] if body else []}) + "\n```")
