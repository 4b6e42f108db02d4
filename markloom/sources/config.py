"""Settings: files, then the environment, then what the caller states; and the instruction bundle."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

ENVIRONMENT = {"MARKLOOM_CONTACT": "contact", "MARKLOOM_MODEL": "model", "MARKLOOM_PROVIDER": "provider"}


@dataclass(frozen=True)
class Config:
    """S09. provider and model of each stage; a stage without its own takes the main one's."""

    provider: str = "local"
    model: str = "echo"
    complex_provider: str | None = None
    complex_model: str | None = None
    review_provider: str | None = None
    review_model: str | None = None
    contact: str | None = None
    user_agent: str | None = None
    chunk_min: int = 1500
    chunk_max: int = 2500
    max_attempts: int = 3
    stale_hours: float = 3.0


def parsed(text: str) -> dict:
    """The flat ``key: value`` lines or the JSON object of a settings file; comments and blank lines are dropped."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out = {}
    for line in text.splitlines():
        key, cut, value = re.sub(r"(^|\s)#.*", "", line).partition(":")
        if cut and key.strip():
            out[key.strip()] = {"true": True, "false": False, "null": None, "": None}.get(value.strip().lower(), value.strip().strip("'\""))
    return out


def config(text: str = "", env: Mapping[str, str] | None = None, **stated) -> Config:
    """S09. File < environment < stated; a stated provider without a model takes none over from below; contact or user agent must be given."""
    found = parsed(text) | {key: env[name] for name, key in ENVIRONMENT.items() if env and env.get(name)}
    stated = {k: v for k, v in stated.items() if v is not None}
    if "provider" in stated:
        for stage in ("complex", "review"):
            if not {f"{stage}_model", f"{stage}_provider"} & stated.keys() and found.get(f"{stage}_model"):
                found |= {f"{stage}_provider": stated["provider"], f"{stage}_model": stated.get("model")}
        if "model" not in stated:
            found.pop("model", None)
    found |= stated
    kinds = {f.name: type(f.default) for f in fields(Config) if f.default is not None}
    unknown = sorted(found.keys() - {f.name for f in fields(Config)})
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = Config(**{k: kinds[k](v) if k in kinds and v is not None else v for k, v in found.items()})
    if not out.user_agent:
        if not out.contact:
            raise ValueError("state a contact or a user_agent")
        out = replace(out, user_agent=f"markloom ({out.contact})")
    return out


def instruction_bundle(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S10. (text, hash): the .md files of the paths in order, without front matter, those of later paths under their folder's name; S11 over the text."""
    parts = None
    for i, path in enumerate(paths):
        files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.lit(i).alias("i"), F.col("_metadata.file_name").alias("name"), "value")
        parts = files if parts is None else parts.unionByName(files)
    body = F.regexp_replace("value", r"\A---\n[\s\S]*?\n---\n", "")
    title = F.when(F.col("i") > 0, F.concat(F.lit("# "), F.element_at(F.array(*map(F.lit, paths)), F.col("i") + 1), F.lit("/"), "name", F.lit("\n"))).otherwise(F.lit(""))
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name", F.concat(title, body).alias("t")))), lambda r: r["t"]), "\n").alias("text"))
    return whole.select("text", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))
