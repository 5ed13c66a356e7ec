"""Run configurations as JSON files, read and written through Spark's file systems.

A configuration is kept as the JSON object that it is: the engine asks for the few fields that it uses, and what it does not know is saved again as it came.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import SparkSession

from quern.operators.mixing import override
from quern.sources.tables import Source, known_fields


class Config:
    """Fields by name, with what the engine reads of them."""

    def __init__(self, fields: dict[str, Any]):
        self.fields = dict(fields)

    def get(self, name: str, default: Any = None) -> Any:
        return self.fields.get(name, default)

    def number(self, name: str, default: float) -> float:
        """A number, or the default where there is none; a truth value is no number."""
        found = self.fields.get(name)
        return found if isinstance(found, (int, float)) and not isinstance(found, bool) else default

    def sources(self, name: str = "datasets") -> list[Source]:
        """A list of sources; entries that are none are left out, as are fields that a source does not have."""
        listed = self.fields.get(name)
        return [known_fields(Source, s) for s in listed if isinstance(s, dict) and "name" in s] if isinstance(listed, list) else []

    def changed(self, **fields: Any) -> Config:
        """With other values; lists of sources may be given as such."""
        plain = lambda v: [asdict(x) if isinstance(x, Source) else x for x in v] if isinstance(v, list) else v
        return Config(self.fields | {k: plain(v) for k, v in fields.items()})


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()  # one configuration
    return rows[0].value if rows else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A plain file, not a folder of parts."""
    p = spark._jvm.org.apache.hadoop.fs.Path(str(PurePosixPath(path)) if "://" not in path else path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save(spark: SparkSession, config: Config, path: str) -> None:
    write_text(spark, path, json.dumps(config.fields, ensure_ascii=False, indent=2))


def load(spark: SparkSession, path: str) -> Config:
    """The saved configuration; what is no JSON object fails."""
    given = json.loads(read_text(spark, path))
    if not isinstance(given, dict):
        raise ValueError(f"no configuration: {path}")
    return Config(given)


def load_mix(spark: SparkSession, path: str, defaults: dict[str, int]) -> dict[str, int]:
    """Takes and seeds of a mix over their defaults."""
    given = json.loads(read_text(spark, path))
    if not isinstance(given, dict):
        raise ValueError("a mix must be a JSON object")
    return override(defaults, given)
