"""Settings of a run: a table of keys with defaults, read and checked on the driver.

A file is a nested mapping; its leaves are named by the path to them
(``qa.warn_min_cap``). A value must be of the kind of its default, so a
misspelt number stops a run before any call is paid for. Keys that are not in
the table are passed over: files are shared with other tools.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from glossaflow.functions.text import STYLES

# The names of the settings in a file, and their defaults.
DEFAULTS: dict[str, Any] = {
    "style": "faithful_literal",
    "translate_toc": True,
    "translate_titles": True,
    "segmentation.max_chars_per_segment": 1200,
    "segmentation.max_chars_per_batch": 8000,
    "segmentation.max_segments_per_batch": 20,
    "context.prev_segment_chars": 300,
    "llm.temperature": 0.0,
    "llm.max_retries": 8,
    "llm.retry_backoff_seconds": [2, 4, 8, 16, 32, 60, 60, 60],
    "llm.timeout_seconds": 60,
    "qa.warn_ratio_limit": 0.005,
    "qa.warn_min_cap": 20,
}


def _number(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and value >= 0


_KINDS = {
    bool: ("true or false", lambda v: isinstance(v, bool)),
    int: ("a whole number from 0 on", lambda v: _number(v) and int(v) == v),
    float: ("a number from 0 on", _number),
    list: ("a list of numbers from 0 on", lambda v: isinstance(v, list) and all(map(_number, v))),
    str: ("a text or nothing", lambda v: v is None or isinstance(v, str)),
}


def known_style(name: str | None) -> str:
    """The style of that name in any case; the first style where there is none."""
    return next((s for s in STYLES if name and name.strip().lower() == s), STYLES[0])


def leaves(tree: Mapping, path: str = "") -> Iterator[tuple[str, Any]]:
    for key, value in tree.items():
        name = f"{path}{key}"
        if isinstance(value, Mapping) and name not in DEFAULTS:
            yield from leaves(value, f"{name}.")
        else:
            yield name, value


class Settings(Mapping):
    """Read-only values by name: the defaults, and what ``given`` says instead."""

    def __init__(self, given: Mapping[str, Any] | None = None):
        self._values = dict(DEFAULTS)
        for name, value in leaves(given or {}):
            if name not in DEFAULTS:
                continue
            wanted, fits = _KINDS[type(DEFAULTS[name])]
            if not fits(value):
                raise ValueError(f"setting {name} must be {wanted}, not {value!r}")
            self._values[name] = value
        self._values["style"] = known_style(self._values["style"])

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)


def read_document(spark: SparkSession, path: str) -> Any:
    """A YAML or JSON file of any store that Spark reads; an empty one is an empty mapping."""
    try:
        text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one file of settings or terms
    except AnalysisException as e:
        raise FileNotFoundError(f"no such file: {path}") from e
    if path.lower().endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def read_settings(spark: SparkSession, path: str | None) -> Settings:
    return Settings(read_document(spark, path) if path else None)


def fingerprint(**parts: Any) -> str:
    """Digest of all that a translation depends on; the key of the cache.

    A line for each value, by name, so that no order of keys or files matters.
    """
    lines = sorted(f"{part}/{name}={json.dumps(value, ensure_ascii=False)}" for part, values in parts.items() for name, value in leaves(values))
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
