"""A session with the settings that the engine's semantics rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def load_env(path: str | Path = ".env") -> dict[str, str]:
    """KEY=value lines of a file, for what the environment does not set; nothing is exported and no value reaches a column."""
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, sep, value = line.strip().removeprefix("export ").partition("=")
            if sep and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("'\"")
    return out | dict(os.environ)


def require(name: str, env: dict[str, str] | None = None) -> str:
    """A secret or setting that must be there before any row is read."""
    value = (env or load_env()).get(name, "")
    if not value:
        raise RuntimeError(f"{name} is not set")
    return value


def session(app: str = "textloom", **conf: str) -> SparkSession:
    """Time zone UTC, adaptive execution with skew joins; sizes are left to the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
