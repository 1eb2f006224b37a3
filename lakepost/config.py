"""Settings and noise rules from files, and the catalog of a corpus."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from lakepost.operators.rules import NoiseRules
from lakepost.session import path_exists


@dataclass(frozen=True)
class EngineConfig:
    """Settings with their ranges; values out of range raise ValueError."""

    limit: int = 25
    max_candidates: int = 25_000
    embedding_batch: int = 16
    semantic: bool = False
    ocr_dpi: int = 300
    ocr_max_pages: int = 100
    ocr_page_batch: int = 4
    ocr_minimum_score: float = 0.0
    transcription_minutes: int = 120
    fetch_parallelism: int = 4

    # Ranges of the settings.
    RANGES = {
        "limit": (1, 500), "max_candidates": (100, 250_000), "embedding_batch": (1, 64), "ocr_dpi": (72, 600), "ocr_max_pages": (1, 10_000),
        "ocr_page_batch": (1, 16), "ocr_minimum_score": (0.0, 1.0), "transcription_minutes": (1, 1440), "fetch_parallelism": (1, 8),
    }

    def set(self, name: str, value: str) -> "EngineConfig":
        """A copy with one setting read from text."""
        kinds = {f.name: type(f.default) for f in fields(self)}
        if name not in kinds:
            raise ValueError(f"unknown setting: {name}")
        if kinds[name] is bool:
            if value.strip().lower() not in ("true", "false", "on", "off", "1", "0"):
                raise ValueError(f"{name}: true or false")
            return replace(self, **{name: value.strip().lower() in ("true", "on", "1")})
        try:
            v = kinds[name](value)
        except ValueError:
            raise ValueError(f"{name}: not a number: {value}") from None
        lo, hi = self.RANGES[name]
        if not lo <= v <= hi:
            raise ValueError(f"{name}: from {lo} to {hi}")
        return replace(self, **{name: v})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=1)


def load_config(path: str) -> EngineConfig:
    """Settings of a JSON file; a missing or broken file and unknown or wrong values give the defaults."""
    out = EngineConfig()
    try:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
    except (OSError, ValueError):
        return out
    for k, v in told.items() if isinstance(told, dict) else ():
        try:
            out = out.set(k, str(v))
        except ValueError:
            continue
    return out


_RULES: dict[str, tuple[float, NoiseRules]] = {}


def load_rules(path: str) -> NoiseRules:
    """Noise rules of a JSON file, read again when it changes; a missing file is made, a broken one has no rules."""
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"senders": [], "contains": [], "folders": []}, f)
    at = os.stat(path).st_mtime
    if path not in _RULES or _RULES[path][0] != at:
        try:
            with open(path, encoding="utf-8") as f:
                told = json.load(f)
            rules = NoiseRules(*[tuple(str(x) for x in told.get(k) or ()) for k in ("senders", "contains", "folders")])
        except (OSError, ValueError, AttributeError):
            rules = NoiseRules()
        _RULES[path] = (at, rules)
    return _RULES[path][1]


@dataclass(frozen=True)
class Catalog:
    """Tables of a corpus below one root, as versions: readers see a version when it is whole."""

    spark: SparkSession
    root: str

    def versions(self, name: str) -> list[int]:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and path_exists(self.spark, f"{self.root}/{name}/{n}/_SUCCESS"))

    def table(self, name: str) -> DataFrame:
        known = self.versions(name)
        if not known:
            raise FileNotFoundError(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{known[-1]}")

    def write(self, name: str, df: DataFrame, keep: int = 2) -> int:
        """The next version of a table; older ones than the last ``keep`` are removed."""
        known = self.versions(name)
        n = (known[-1] if known else -1) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{n}")
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        for old in known[: max(0, len(known) + 1 - keep)]:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{old}")
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        return n

    def verify(self) -> bool:
        """Whether the corpus can be read: it has a whole version of its mails."""
        return bool(self.versions("mails"))
