"""One handle on a memory store: writes, searches, layers, graph, diary, usage.

Methods that can return many rows return DataFrames.  ``call`` serves the small
JSON tools on top of them.
"""

from __future__ import annotations

import datetime as dt
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import queries as q
from mnemospark.functions import text as t
from mnemospark.functions.embedding import Embedder
from mnemospark.operators import catalog, closets, diary, hybrid, kg, rooms, usage, vectors
from mnemospark.plans import ingest, search
from mnemospark.plans.store import Store, conform
from mnemospark.sources import exchange, files

UTC = dt.timezone.utc
NO_IDENTITY = "## L0 — IDENTITY\nNo identity configured."


class Memory:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        embedder: Embedder,
        label: str = "memory",
        clock=lambda: dt.datetime.now(UTC),
        identity: str | None = None,
    ):
        self.spark, self.store, self.embedder = spark, Store(spark, root), embedder
        self.label, self.clock, self.identity = label.strip() or "memory", clock, identity
        self.session_id = uuid.uuid4().hex
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    # ---------------------------------------------------------------- helpers
    def now(self) -> Column:
        return F.lit(self.clock().astimezone(UTC).replace(tzinfo=None)).cast("timestamp")

    def today(self) -> str:
        return self.clock().astimezone(UTC).strftime("%Y-%m-%d")

    def drawers(self) -> DataFrame:
        return self.store.read("drawers")

    def _index(self):
        return self.store.index() if self.store.exists("doc_stats") else None

    def _one_row(self, **values) -> DataFrame:
        return self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])

    # ----------------------------------------------------------------- writes
    def add_drawers(self, rows: DataFrame) -> int:
        added = self.store.add_drawers(rows, self.embedder)
        self.store.index_new()
        return added

    def add_memory(
        self, wing: str, room: str, content: str, source: str = "",
        importance: float = fv.DEFAULT_IMPORTANCE, added_by: str | None = None,
    ) -> tuple[bool, str]:
        base = self._one_row(wing=wing, room=room, content=content, source_file=source, chunk_index=0)
        row = base.select(
            t.drawer_id("wing", "room", "source_file", "chunk_index").alias("id"), "*",
            F.lit(added_by or self.label).alias("added_by"), self.now().alias("filed_at"),
            F.lit(float(importance)).alias("importance"),
        )
        drawer_id = row.first()["id"]
        return self.add_drawers(row) > 0, drawer_id

    def ingest_turns(self, conversations: DataFrame) -> int:
        return self.add_drawers(ingest.turn_drawers(conversations, self.label, self.now()))

    def mine(
        self, folder: str, wing: str, room_list: list[dict], dry_run: bool = False,
        respect_ignore: bool = True, include: list[str] = (), global_rules: list[str] = (),
    ) -> int:
        """Files new project files; known files are left out before any work on them.

        Ignore rules of all folders hold, and below them the lines in ``global_rules``.
        """
        found = files.whole_texts(self.spark, folder)
        if respect_ignore:
            found = files.not_ignored_below(found, files.ignore_rules(self.spark, folder, global_rules), include)
        if dry_run:
            return ingest.project_drawers(found, wing, room_list, self.label, self.now()).count()
        named = found.withColumn("source_file", F.col("path"))
        fresh = catalog.not_yet_mined(named, self.drawers()).drop("source_file")
        added = self.add_drawers(
            ingest.project_drawers(fresh, wing, room_list, self.label, self.now())
        )
        self.register_wing(wing, "project", "", folder, mined=True)
        return added

    def mine_conversations(self, folder: str, wing: str, general: bool = False) -> int:
        found = files.whole_texts(self.spark, folder).withColumn("source_file", F.col("path"))
        fresh = catalog.not_yet_mined(found, self.drawers()).drop("source_file")
        return self.add_drawers(
            ingest.conversation_drawers(fresh, wing, self.label, self.now(), general)
        )

    def sweep(self, folder: str, wing: str | None = None) -> int:
        found = files.whole_texts(self.spark, folder)
        return self.add_drawers(ingest.message_drawers(found, wing, self.now()))

    def export(self, path: str) -> None:
        exchange.write_export(self.drawers(), path)

    def import_from(self, path: str) -> int:
        rows = exchange.read_export(self.spark, path)
        return self.add_drawers(exchange.import_rows(rows, self.now()))

    # ----------------------------------------------------------------- search
    def search(
        self, query: str, n: int = 5, wing: str | None = None, room: str | None = None,
        stages: search.Stages = search.FACADE,
    ) -> DataFrame:
        text = search.effective_query(query, stages)
        return search.search(
            self.drawers(), text, self.embedder.one(text), n, self.now(), wing, room, stages,
            self._index(),
        )

    def drawer_grep(self, query: str, radius: int = 1) -> DataFrame:
        best = self.search(query, 1)
        near = hybrid.with_source_context(best, self.drawers(), radius)
        return near.orderBy("chunk_index")

    def preference_search(
        self, query: str, n: int = 10, wing: str | None = None, room: str | None = None
    ) -> DataFrame:
        return vectors.preference_top_k(self.drawers(), self.embedder.one(query), n, wing, room)

    def check_duplicate(
        self, content: str, threshold: float = fv.DUPLICATE_THRESHOLD,
        wing: str | None = None, room: str | None = None, limit: int | None = fv.DUPLICATE_POOL,
    ) -> DataFrame:
        return vectors.check_duplicate(
            self.drawers(), self.embedder.one(content), threshold, wing, room, limit
        )

    # ----------------------------------------------------------------- layers
    def wake_up(self, wing: str | None = None) -> str:
        return f"{(self.identity or NO_IDENTITY).strip()}\n\n{self.story(wing)}"

    def story(self, wing: str | None = None) -> str:
        if self.drawers().isEmpty():
            return "## L1 — No memories yet."
        lines, room = ["## L1 — ESSENTIAL STORY"], None
        for row in catalog.story_rows(self.drawers(), wing).orderBy("room", "rank").collect():
            if row["room"] != room:
                room = row["room"]
                lines.append(f"\n[{room}]")
            if not row["fits"]:
                lines.append("  ... (more in L3 search)")
                break
            lines.append(row["line"])
        return "\n".join(lines)

    def recall(self, wing: str | None = None, room: str | None = None, n: int = 10) -> str:
        rows = catalog.list_recent(self.drawers(), n, wing, room).select(
            "room", t.snippet("content", fv.RECALL_SNIPPET).alias("s"),
            t.base_name("source_file").alias("f"),
        ).collect()
        if not rows:
            label = " ".join(f"{k}={v}" for k, v in (("wing", wing), ("room", room)) if v)
            return f"No drawers found for {label}."
        lines = [f"## L2 — ON-DEMAND ({len(rows)} drawers)"]
        lines += [f"  [{r['room']}] {r['s']}" + (f"  ({r['f']})" if r["f"] else "") for r in rows]
        return "\n".join(lines)

    def search_text(self, query: str, n: int = 5, wing: str | None = None, room: str | None = None) -> str:
        found = self.search(query, n, wing, room, search.LAYER)
        rows = found.withColumn("s", t.snippet("content", fv.RECALL_SNIPPET)).collect()
        if not rows:
            return "No results found."
        lines = [f'## L3 — SEARCH RESULTS for "{query}"']
        for i, r in enumerate(rows, 1):
            lines.append(f"  [{i}] {r['wing']}/{r['room']} (sim={r['combined']:.3f})")
            lines.append(f"      {r['s']}")
            if r["source_file"]:
                lines.append(f"      src: {r['source_file']}")
        return "\n".join(lines)

    # --------------------------------------------------------------- registry
    def register_wing(
        self, name: str, kind: str = "topic", description: str = "", path: str | None = None,
        mined: bool = False,
    ) -> None:
        row = self._one_row(name=name, kind=kind, description=description, project_path=path).select(
            "*", (self.now() if mined else F.lit(None).cast("timestamp")).alias("last_mined_at"),
            self.now().alias("created_at"),
        )
        merged = catalog.upsert_wings(self.store.read("wings"), conform(row, "wings"))
        self.store.replace("wings", merged)

    def wings(self) -> DataFrame:
        return catalog.registry(self.store.read("wings"), self.drawers())

    def backfill_wings(self) -> int:
        missing = catalog.backfill_wings(self.store.read("wings"), self.drawers())
        added = missing.withColumn("description", F.lit("")).withColumn("created_at", self.now())
        before = self.store.read("wings").count()
        self.store.append("wings", added)
        return self.store.read("wings").count() - before

    # ------------------------------------------------------------------ graph
    def kg_add(self, facts: DataFrame) -> None:
        """Facts (subject, predicate, object, valid_from, valid_to) by name."""
        rows = kg.with_ids(facts, self.now()).withColumns(
            {"confidence": F.lit(1.0), "extracted_at": self.now()}
        )
        known = self.store.read("entities")
        names = kg.entities_of(facts).withColumns(
            {"type": F.lit("unknown"), "properties": F.lit("{}"), "created_at": self.now()}
        )
        new_names = names.join(known.select("id"), "id", "left_anti")
        fresh = kg.new_triples(self.store.read("triples"), conform(rows, "triples"))
        self.store.append("entities", new_names)
        self.store.append("triples", fresh)

    def kg_query(self, name: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        return kg.query_entity(self.store.read("triples"), self.store.read("entities"), name, as_of, direction)

    def kg_invalidate(self, subject: str, predicate: str, object_: str, ended: str | None = None) -> None:
        rows = kg.ended_rows(
            self.store.read("triples"), subject, predicate, object_, ended or self.today()
        )
        self.store.update("triples", rows)

    def seed_facts(self, facts: list[tuple[str, str, str]]) -> dict:
        """Adds missing facts from today on and counts what was there already."""
        rows = self.spark.createDataFrame(facts, "subject string, predicate string, object string")
        dated = rows.withColumns(
            {"valid_from": F.lit(self.today()), "valid_to": F.lit(None).cast("string")}
        )
        before = self.store.read("triples").count()
        self.kg_add(dated)
        inserted = self.store.read("triples").count() - before
        return {"inserted": inserted, "unchanged": len(facts) - inserted, "invalidated": 0}

    def replace_fact(self, subject: str, predicate: str, old: str, new: str) -> dict:
        """Ends the old fact if it is active and adds the new one if it is not."""
        active = self.kg_query(subject, None, "outgoing").filter(F.col("current"))
        pred = predicate.lower().replace(" ", "_")
        held = {r["object"] for r in active.filter(F.col("predicate") == pred).select("object").collect()}
        ended = old != new and old in held
        if ended:
            self.kg_invalidate(subject, predicate, old)
        return {**self.seed_facts([(subject, predicate, new)]), "invalidated": int(ended)}

    def sightings(self) -> DataFrame:
        """Drawers as the room graph sees them: room, wing, day of filing."""
        return self.drawers().select("room", "wing", F.date_format("filed_at", "yyyy-MM-dd").alias("day"))

    # ------------------------------------------------------------------ diary
    def diary(self) -> DataFrame:
        return diary.entries(self.drawers())

    def diary_write(
        self, agent: str, entry: str, topic: str = "general", session_id: str = "",
        project_path: str = "", tags: list[str] = (),
    ) -> dict:
        wing = fv.DIARY_WING_PREFIX + agent.lower().replace(" ", "_")
        same = self.check_duplicate(entry, fv.DIARY_DUPLICATE_THRESHOLD, wing, fv.DIARY_ROOM)
        matches = [r.asDict() for r in same.select("id", "similarity").collect()]
        if matches:
            return {"success": False, "reason": "duplicate", "matches": matches}
        request = self._one_row(
            agent=agent, content=entry, topic=topic, session_id=session_id, project_path=project_path
        ).withColumns(
            {"tags": F.lit(list(tags)).cast("array<string>"), "filed_at": self.now()}
        )
        rows = diary.entry_rows(request)
        entry_id = rows.first()["id"]
        return {"success": self.add_drawers(rows) > 0, "entry_id": entry_id, "agent": agent, "topic": topic}

    def session_context(self, agent: str, project: str | None = None) -> DataFrame:
        return diary.session_context(self.diary(), agent, self.now(), project)

    # ------------------------------------------------------------------ hooks
    def hook_recall(self, event: dict) -> str | None:
        """Memory worth showing after an investigation tool, or nothing."""
        given = event.get("tool_input") or {}
        keys = ("pattern", "query", "command", "file_path", "path", "file")
        asked = next((given[k] for k in keys if isinstance(given.get(k), str)), "").strip()
        if len(asked.encode()) < 3:
            return None
        hits = self.search(asked, fv.HOOK_RECALL_LIMIT, stages=search.TOOL)
        useful = hits.filter((F.col("combined") >= fv.HOOK_RELEVANCE) & (F.col("content") != ""))
        rows = useful.select("wing", "room", t.compact("content", 240).alias("s")).collect()
        return "\n".join(f"- [{r['wing']}/{r['room']}] {r['s']}" for r in rows) or None

    def hook_stop(self, event: dict, needs_status: bool = False) -> bool:
        """True when memory was read, nothing was saved, and no reminder ran yet."""
        if event.get("stop_hook_active") is True or event.get("loop_count", 0) != 0:
            return False
        if needs_status and event.get("status") != "completed":
            return False
        row = usage.save_status(
            self.store.read("usage_events"), self.now(), fv.SAVE_WINDOW_MINUTES
        ).first()
        return row["engaged"] and not row["saved"]

    def hook_session_start(self, cwd: str) -> str | None:
        """Recent diary of the project and newest drawers of its wing."""
        if not cwd.strip():
            return None
        sections = []
        found = diary.recent(
            self.diary(), self.now(), fv.SESSION_START_DIARY_HOURS, fv.HOOK_RECALL_LIMIT, None, cwd
        ).select(F.date_format("filed_at", "yyyy-MM-dd").alias("d"), "topic", t.compact("content", 220).alias("s"))
        lines = [f"- [{r['d']}] ({r['topic']}) {r['s']}" for r in found.collect()]
        if lines:
            sections.append("\n".join(["Recent diary for this project:", *lines]))
        wing = PurePosixPath(cwd).name.lower().replace(" ", "_").replace("-", "_")
        filed = catalog.list_recent(self.drawers(), fv.HOOK_RECALL_LIMIT, wing).filter(
            F.col("room") != fv.DIARY_ROOM
        ).select("room", t.compact("content", 200).alias("s"))
        lines = [f"- [{r['room']}] {r['s']}" for r in filed.collect()]
        if lines:
            sections.append("\n".join([f"Project knowledge (wing `{wing}`):", *lines]))
        return "\n\n".join(sections) or None
