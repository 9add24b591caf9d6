"""Writers: JSON lines, one folder per category, grouped objects, structured logs."""

from __future__ import annotations

import json
import logging
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_by(df: DataFrame, path: str, by: str = "category", order: tuple[str, ...] = ("district", "name"), files: int = 8) -> None:
    """A folder per value, rows in order within each file. Ranges over (value, order) deal a value of any share to several files,
    so the files of a folder are in order too."""
    df.repartitionByRange(files, by, *order).sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).json(path)


def grouped_object(df: DataFrame, key: str, values: str) -> DataFrame:
    """One JSON line per key: {"key": [values]}, of rows (key, sorted values)."""
    return df.select(F.to_json(F.map_from_arrays(F.array(key), F.array(values))).alias("value"))


def write_grouped(df: DataFrame, path: str, key: str, values: str) -> None:
    grouped_object(df, key, values).write.mode("overwrite").text(path)


class JsonFormatter(logging.Formatter):
    """One JSON object per event; fields passed as ``extra={"fields": {...}}`` are merged in."""

    def format(self, record: logging.LogRecord) -> str:
        event = {"timestamp": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "message": record.getMessage(), "module": record.module, "function": record.funcName, "line": record.lineno}
        return json.dumps(event | getattr(record, "fields", {}), ensure_ascii=False, default=str)


def structured_logger(name: str, path: str, most_bytes: int = 10 * 1024 * 1024, kept: int = 5) -> logging.Logger:
    """A driver-side logger to a rotating JSON-lines file."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.INFO)
    handler = RotatingFileHandler(path, maxBytes=most_bytes, backupCount=kept, encoding="utf-8")
    handler.setFormatter(JsonFormatter())
    logger.addHandler(handler)
    return logger
