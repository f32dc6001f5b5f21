"""Results as JSON, and a rotating log of JSON lines."""

from __future__ import annotations

import json
import logging
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame, name: str = "value") -> DataFrame:
    """A JSON object a row; null fields are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias(name))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"ts": int(record.created * 1000), "level": record.levelname.lower(), "event": record.getMessage(), **getattr(record, "fields", {})}, default=str)


def json_log(path: str, most_bytes: int = 10_000_000, rotations: int = 3) -> logging.Logger:
    """A logger for a file of JSON lines that rotates by size; extra fields go in ``extra={"fields": {...}}``."""
    log = logging.getLogger(f"quarrylight.{path}")
    if not log.handlers:
        handler = RotatingFileHandler(path, maxBytes=most_bytes, backupCount=rotations)
        handler.setFormatter(_JsonLines())
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
    return log
