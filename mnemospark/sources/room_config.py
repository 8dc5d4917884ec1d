"""Room configuration of a project: ``wing`` and a list of rooms, YAML or JSON."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from mnemospark.sources.files import read_lines

try:
    import yaml
except ImportError:  # JSON is a subset of YAML and needs no module
    yaml = None


def parse(text: str) -> dict:
    config = yaml.safe_load(text) if yaml else json.loads(text)
    rooms = [
        {"name": r["name"], "description": r.get("description", ""), "keywords": r.get("keywords") or []}
        for r in config.get("rooms", [])
    ]
    return {"wing": config["wing"], "rooms": rooms}


def load(spark: SparkSession, path: str) -> dict:
    lines = read_lines(spark, path)
    if not lines:
        raise FileNotFoundError(path)
    return parse("\n".join(lines))


def dump(wing: str, rooms: list[dict]) -> str:
    config = {"wing": wing, "rooms": rooms}
    return yaml.safe_dump(config, sort_keys=False) if yaml else json.dumps(config, indent=1)
