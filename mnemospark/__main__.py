"""Command line: ``python -m mnemospark --store DIR COMMAND ...``.

Run it with ``spark-submit`` on a cluster; the session comes from there.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from mnemospark.functions.embedding import HashingEmbedder, OnnxEmbedder
from mnemospark.operators import kg
from mnemospark.plans import search, tools
from mnemospark.plans.memory import Memory
from mnemospark.session import SETTINGS
from mnemospark.sources import room_config
from mnemospark.streaming import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mnemospark")
    p.add_argument("--store", required=True, help="folder that every executor reaches")
    p.add_argument("--model", help="folder of an ONNX sentence model; hashing without it")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **flags) -> None:
        c = commands.add_parser(name)
        for n in names:
            c.add_argument(n)
        for flag, options in flags.items():
            c.add_argument("--" + flag.replace("_", "-"), **options)

    place = {"wing": {}, "room": {}, "limit": {"type": int, "default": 5}}
    command("mine", "folder", wing={}, rooms={}, dry_run={"action": "store_true"})
    command("mine-convos", "folder", "wing", general={"action": "store_true"})
    command("sweep", "folder", wing={})
    command("search", "query", rerank={"action": "store_true"}, **place)
    command("wake-up", wing={})
    command("recall", **place)
    command("timeline", entity={})
    command("gain", since={"default": "30d"}, project={}, json={"action": "store_true"})
    command("export", "path")
    command("import", "path")
    command("prune", "days")
    command("watch", "folder", "wing", "checkpoint")
    command("tool", "name", "args")
    for name in ("status", "wings", "repair", "upgrade-embeddings", "backfill-wings"):
        command(name)
    return p


def run(m: Memory, a: argparse.Namespace):
    """Result of one command: text, or a value to print as JSON."""
    if a.command == "mine":
        config = room_config.load(m.spark, a.rooms) if a.rooms else {"wing": None, "rooms": []}
        wing = a.wing or config["wing"] or a.folder.rstrip("/").split("/")[-1].lower()
        return m.mine(a.folder, wing, config["rooms"], a.dry_run)
    if a.command == "mine-convos":
        return m.mine_conversations(a.folder, a.wing, a.general)
    if a.command == "sweep":
        return m.sweep(a.folder, a.wing)
    if a.command == "search":
        stages = search.Stages(preferences=False, rerank=a.rerank)
        return tools.rows(m.search(a.query, a.limit, a.wing, a.room, stages))
    if a.command == "wake-up":
        return m.wake_up(a.wing)
    if a.command == "recall":
        return m.recall(a.wing, a.room, a.limit)
    if a.command == "timeline":
        return tools.rows(kg.timeline(m.store.read("triples"), m.store.read("entities"), a.entity))
    if a.command == "gain":
        report = tools.call(m, "gain", {"since": a.since, "project": a.project})
        return report if a.json or "error" in report else tools.render_gain(report)
    if a.command == "export":
        return m.export(a.path)
    if a.command == "import":
        return m.import_from(a.path)
    if a.command == "prune":
        return tools.call(m, "prune", {"older_than_days": int(a.days)})
    if a.command == "backfill-wings":
        return m.backfill_wings()
    if a.command == "watch":
        stream = watch.watch_folder(m.spark, m.store, a.folder, a.wing, [], a.checkpoint, m.embedder)
        return stream.awaitTermination()
    if a.command == "tool":
        return tools.call(m, a.name, json.loads(a.args))
    names = {"wings": "list_wings", "upgrade-embeddings": "upgrade_embeddings"}
    return tools.call(m, names.get(a.command, a.command))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("mnemospark")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    embedder = OnnxEmbedder(a.model) if a.model else HashingEmbedder()
    out = run(Memory(builder.getOrCreate(), a.store, embedder), a)
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
