"""JSON tools over a ``Memory``: ``call(memory, name, args) -> dict``.

Answers are JSON, so each collects its own rows; tools that list without a limit
are for small stores, and the ``Memory`` methods give the same as DataFrames.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions import queries as q
from mnemospark.functions import text as t
from mnemospark.operators import catalog, diary, hybrid, kg, rooms, usage, vectors
from mnemospark.plans import search

TOOLS = {}
#: Reports about usage are no usage.
UNRECORDED = {"gain"}


class MissingArgument(ValueError):
    pass


def tool(fn):
    TOOLS[fn.__name__] = fn
    return fn


def _plain(value):
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def rows(df: DataFrame) -> list[dict]:
    return [{k: _plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


def text_arg(args: dict, key: str, default: str | None = None, required: bool = False) -> str | None:
    value = args.get(key)
    value = value.strip() if isinstance(value, str) else None
    if not value and required:
        raise MissingArgument(f"{key} is required")
    return value or default


def int_arg(args: dict, key: str, default: int) -> int:
    value = args.get(key, default)
    if isinstance(value, str) and value.strip().lstrip("-").isdigit():
        return int(value)
    return int(value) if isinstance(value, (int, float)) else default


def flag_arg(args: dict, key: str) -> bool:
    value = args.get(key, False)
    return value.lower() in ("1", "true", "yes") if isinstance(value, str) else bool(value)


def call(memory, name: str, args: dict | None = None) -> dict:
    """Runs a tool and records the call, so that ``gain`` and the hooks see it."""
    if name not in TOOLS:
        return {"error": f"unknown tool: {name}"}
    began = time.monotonic()
    try:
        result = TOOLS[name](memory, args or {})
    except (MissingArgument, ValueError) as e:
        result = {"error": str(e)}
    if name not in UNRECORDED:
        record_call(memory, name, args or {}, result, int((time.monotonic() - began) * 1000))
    return result


def record_call(m, name: str, args: dict, result: dict, duration_ms: int) -> None:
    """One usage event: outcome and counts from the answer, repeats from the last day."""
    project = text_arg(args, "project") or os.path.basename((text_arg(args, "project_path") or "").rstrip("/")) or m.label
    # The average is only asked for by events that a duplicate saved.
    saves = result.get("is_duplicate") or result.get("reason") == "duplicate"
    average = m.drawers().agg(F.avg(F.octet_length("content") / 4)).first()[0] if saves else None
    raw = m.spark.createDataFrame(
        [((time.time_ns() >> 10 << 10) + uuid.uuid4().int % 1024, m.session_id, project, name, json.dumps(args, default=str), json.dumps(result, default=str), duration_ms)],
        "id long, session_id string, project string, tool string, args string, result string, duration_ms long",
    ).withColumn("ts", m.now())
    event = usage.classify_calls(raw, F.lit(int(average or 0)))
    known = m.store.read("usage_events")
    recent = known.filter(F.col("ts") >= m.now() - F.make_dt_interval(hours=F.lit(fv.REPEAT_WINDOW_HOURS)))
    m.store.append("usage_events", usage.mark_repeats(event, recent).select(*known.columns))


def place(args: dict) -> dict:
    return {"wing": text_arg(args, "wing"), "room": text_arg(args, "room")}


# -------------------------------------------------------------------- overview
@tool
def status(m, args):
    counted = rows(catalog.taxonomy_rollup(m.drawers()))
    last = diary.last_session(m.diary(), m.now())
    return {
        "total_drawers": sum(r["drawers"] for r in counted if r["wing"] is None),
        "wings": {r["wing"]: r["drawers"] for r in counted if r["wing"] and r["room"] is None},
        "rooms": {r["room"]: r["drawers"] for r in rows(catalog.room_counts(m.drawers()))},
        "last_session": rows(last.withColumn("text", t.compact("content", 200)).drop("content")),
    }


@tool
def memory_report(m, args):
    per_room = rows(catalog.taxonomy(m.drawers()))
    only = text_arg(args, "wing")
    wings: dict = {}
    for r in per_room:
        if only in (None, r["wing"]):
            entry = wings.setdefault(r["wing"], {"wing": r["wing"], "drawers": 0, "rooms": []})
            entry["drawers"] += r["drawers"]
            entry["rooms"].append({"room": r["room"], "drawers": r["drawers"]})
    newest = m.diary().orderBy(F.desc("filed_at"), "id").limit(int_arg(args, "limit", 10))
    return {
        "total_drawers": sum(r["drawers"] for r in per_room),
        "wing_count": len(wings),
        "wings": sorted(wings.values(), key=lambda w: (-w["drawers"], w["wing"])),
        "recent_activity": rows(newest.select("topic", "filed_at", t.compact("content", 160).alias("text"))),
    }


@tool
def verify(m, args):
    dim = len(m.embedder.one("x"))
    bad = vectors.corrupted(m.drawers(), dim).count()
    return {
        "ok": bad == 0,
        "drawer_count": m.drawers().count(),
        "unembedded_drawers": vectors.unembedded(m.drawers()).count(),
        "corrupted_embeddings": bad,
        "tools": sorted(TOOLS),
    }


@tool
def gain(m, args):
    events = m.store.read("usage_events")
    if "record" in args:
        given = args["record"]
        row = {k: text_arg(given, k, required=True) for k in ("query_id", "drawer_id", "verdict")}
        if row["verdict"] not in fv.VERDICTS:
            raise ValueError("verdict must be " + ", ".join(fv.VERDICTS))
        one = m._one_row(**row, source="explicit", note=text_arg(given, "note")).withColumn("created_at", m.now())
        known = m.store.read("feedback")
        m.store.replace("feedback", usage.upsert_feedback(known, one.select(*known.columns)))
        return {"success": True, "recorded": row}
    project = text_arg(args, "project")
    if flag_arg(args, "reset"):
        kept = events.filter(F.col("project") != project) if project else events.limit(0)
        deleted = events.count() - kept.count()
        m.store.replace("usage_events", kept)
        return {"success": True, "deleted": deleted, "project": project}
    since = text_arg(args, "since", "30d")
    scoped = usage.in_scope(events, project, since, m.now())
    if flag_arg(args, "history"):
        return {"history": rows(usage.history(scoped, max(int_arg(args, "limit", 20), 0)))}
    explicit = m.store.read("feedback").select("query_id", "drawer_id", "verdict")
    report = rows(usage.kpis(scoped))[0]
    report.update(rows(usage.precision(scoped, explicit))[0])
    report.update({k: v for k, v in rows(usage.overall_latency(scoped))[0].items() if k != "calls"} if report["tool_calls"] else {})
    return {
        "window": usage.window_label(since), "project": project, **report,
        "per_intent_precision": rows(usage.precision_by_intent(scoped, explicit)),
        "per_tool_latency": rows(usage.tool_latency(scoped)),
        "top_wings": rows(usage.top_places(scoped, "wing")),
        "top_rooms": rows(usage.top_places(scoped, "room")),
        "top_reused_queries": rows(usage.top_queries(scoped)),
        "per_project": rows(usage.by_project(scoped)),
    }


def _percent(value: float | None) -> str:
    return "n/a" if value is None else f"{value * 100:.0f}%"


def render_gain(report: dict) -> str:
    """The usage report as text."""
    tools = ", ".join(
        f"{r['tool']}(p50 {r['p50_latency_ms']} ms, p95 {r['p95_latency_ms']} ms)"
        for r in report["per_tool_latency"][:5]
    )
    wings = ", ".join(f"{r['name']}({r['count']})" for r in report["top_wings"])
    projects = ", ".join(
        f"{r['project']}({r['tool_calls']} calls, ~{r['tokens_saved_est']:,} tok)"
        for r in report["per_project"][:5]
    )
    lines = [
        ("Tool calls", f"{report['tool_calls']:,}   (sessions: {report['sessions']})"),
        ("Hit rate", f"{_percent(report['hit_rate'])}   (search hits {report['search_hits']}/{report['search_calls']})"),
        ("Precision@1", _percent(report["precision_at_1"])),
        ("Precision@5", _percent(report["precision_at_5"])),
        ("Tokens saved (est)", f"~{report['tokens_saved_est']:,}"),
        ("Re-index skipped", f"{report['duplicate_skips']}    (duplicate drawers avoided)"),
        ("KG facts recalled", report["kg_facts_recalled"]),
        ("Diary recalls", report["diary_recalls"]),
        ("Repeat Qs avoided", report["repeat_questions_avoided"]),
        ("p95 latency", f"{report.get('p95_latency_ms', 0)} ms"),
        ("Tool latency", tools or "none"),
        ("Top wings", wings or "none"),
        ("Top projects", projects or "none"),
    ]
    head = f"Gain - {report['window']} ({report['project'] or 'all projects'})"
    return "\n".join([head, *[f"  {name:<19}: {value}" for name, value in lines]]) + "\n"


# ---------------------------------------------------------------------- search
@tool
def search_(m, args):
    query = text_arg(args, "query", required=True)
    stages = search.Stages(rerank=flag_arg(args, "rerank"))
    text = search.effective_query(query, stages)
    where = place(args)
    found = m.search(query, int_arg(args, "limit", 5), where["wing"], where["room"], stages)
    hits = rows(found)
    near = rows(hybrid.with_source_context(m.spark.createDataFrame(
        [(h["id"], h["source_file"], h["chunk_index"]) for h in hits],
        "id string, source_file string, chunk_index long"), m.drawers()))
    for h in hits:
        h["text"] = h.pop("content")
        h["similarity"] = h["combined"]
        mine = [n for n in near if n["hit_id"] == h["id"]]
        h["source_context"] = sorted(mine, key=lambda n: n["chunk_index"])
    return {
        "query": query,
        "query_id": search.query_id(text, [h["id"] for h in hits], int(m.clock().timestamp())),
        "sanitized_query": text, "intent": q.classify(text), "rerank_enabled": stages.rerank,
        "filters": where, "results": hits,
    }


TOOLS["search"] = TOOLS.pop("search_")


@tool
def preference_search(m, args):
    query = text_arg(args, "query", required=True)
    found = m.preference_search(query, int_arg(args, "limit", 10), **place(args))
    return {"query": query, "filters": place(args), "results": rows(found)}


@tool
def check_duplicate(m, args):
    same = rows(m.check_duplicate(text_arg(args, "content", required=True), float(args.get("threshold", fv.DUPLICATE_THRESHOLD))))
    return {"is_duplicate": bool(same), "matches": same}


@tool
def recall_check(m, args):
    checks = args.get("checks")
    if not checks:
        return {"ok": False, "error": "checks array is required"}
    whole = [c for c in checks if text_arg(c, "query") and text_arg(c, "expected_source")]
    found = rows(hybrid.recall_check(m.drawers(), whole, max(int_arg(args, "limit", 5), 1), m.now())) if whole else []
    passed = sum(1 for r in found if r["passed"])
    return {"ok": passed == len(checks), "passed": passed, "failed": len(checks) - passed, "checks": found}


# --------------------------------------------------------------------- drawers
@tool
def add_drawer(m, args):
    wing, room, content = (text_arg(args, k, required=True) for k in ("wing", "room", "content"))
    same = rows(m.check_duplicate(content))
    if same:
        return {"success": False, "reason": "duplicate", "matches": same}
    # The text is part of the place, so two texts of one file never collide.
    source = text_arg(args, "source_file", "") or "note:" + search.query_id(content, [], 0)[6:]
    new, drawer_id = m.add_memory(wing, room, content, source, added_by=text_arg(args, "added_by", "mcp"))
    return {"success": new, "drawer_id": drawer_id, "wing": wing, "room": room}


@tool
def remember(m, args):
    text = text_arg(args, "text", required=True)
    wing, room = text_arg(args, "wing", "general"), text_arg(args, "room", "general")
    same = rows(m.check_duplicate(text))
    if same:
        return {"success": True, "inserted": False, "reason": "duplicate", "matches": same}
    source = "remember:" + search.query_id(text, [], 0)[6:]
    new, drawer_id = m.add_memory(wing, room, text, source, fv.REMEMBER_IMPORTANCE, "mcp")
    m.register_wing(wing)
    return {"success": True, "inserted": new, "id": drawer_id, "wing": wing, "room": room}


@tool
def delete_drawer(m, args):
    drawer_id = text_arg(args, "drawer_id", required=True)
    return {"success": m.store.delete_drawers([drawer_id]) > 0, "drawer_id": drawer_id}


@tool
def forget(m, args):
    drawer_id = text_arg(args, "id", required=True)
    gone = m.store.delete_drawers([drawer_id]) > 0
    return {"success": gone, "deleted_id": drawer_id} if gone else {"success": False, "error": "drawer not found", "id": drawer_id}


@tool
def get_drawer(m, args):
    found = rows(catalog.get_drawer(m.drawers(), text_arg(args, "drawer_id", required=True)).drop("embedding", "pref_embedding"))
    return found[0] if found else {"error": "drawer not found"}


@tool
def explain(m, args):
    return get_drawer(m, {"drawer_id": text_arg(args, "id", required=True)})


@tool
def list_drawers(m, args):
    return {"drawers": rows(catalog.list_recent(m.drawers(), int_arg(args, "limit", 50), **place(args)))}


@tool
def update_drawer(m, args):
    drawer_id, content = (text_arg(args, k, required=True) for k in ("drawer_id", "content"))
    return {"success": m.store.update_content(drawer_id, content, m.embedder), "drawer_id": drawer_id}


@tool
def export(m, args):
    path = text_arg(args, "path", required=True)
    m.export(path)
    return {"path": path, "total": m.drawers().count()}


@tool
def import_(m, args):
    return {"inserted": m.import_from(text_arg(args, "path", required=True))}


TOOLS["import"] = TOOLS.pop("import_")


@tool
def upgrade_embeddings(m, args):
    refresh = flag_arg(args, "refresh_preferences")
    return {"reembedded": m.store.embed_all(m.embedder, refresh), "refresh_preferences": refresh}


@tool
def repair(m, args):
    return {"embedded": m.store.embed_missing(m.embedder)}


@tool
def prune(m, args):
    days = int_arg(args, "older_than_days", 0)
    return {"pruned": m.store.prune(days, m.now()), "older_than_days": days}


@tool
def mine(m, args):
    folder = text_arg(args, "project_path", required=True)
    wing = text_arg(args, "wing") or folder.rstrip("/").split("/")[-1].lower().replace(" ", "_").replace("-", "_")
    return {"success": True, "wing": wing, "drawers": m.mine(folder, wing, args.get("rooms", []), flag_arg(args, "dry_run"))}


# -------------------------------------------------------------------- registry
@tool
def list_wings(m, args):
    return {"wings": rows(m.wings())}


@tool
def create_wing(m, args):
    raw = text_arg(args, "name", required=True)
    name = m.spark.range(1).select(t.wing_name(F.lit(raw))).first()[0]
    kind = text_arg(args, "kind", "topic")
    if not name:
        return {"success": False, "error": "name normalizes to an empty wing"}
    if kind not in ("topic", "project"):
        return {"success": False, "error": "kind must be 'topic' or 'project'"}
    m.register_wing(name, kind, text_arg(args, "description", ""), text_arg(args, "project_path"))
    return {"success": True, "wing": rows(m.wings().filter(F.col("name") == name))[0]}


@tool
def project_status(m, args):
    path = text_arg(args, "project_path", required=True)
    wing = text_arg(args, "wing") or path.rstrip("/").split("/")[-1].lower().replace(" ", "_").replace("-", "_")
    known = catalog.wing_state(m.wings()).filter((F.col("project_path") == path) | (F.col("name") == wing))
    found = rows(known.orderBy(F.desc(F.coalesce(F.col("project_path") == path, F.lit(False)))).limit(1))
    return {"project_path": path, **(found[0] if found else {"state": "unknown", "suggested_wing": wing})}


@tool
def list_rooms(m, args):
    return {"rooms": rows(catalog.room_counts(m.drawers(), text_arg(args, "wing")))}


@tool
def get_taxonomy(m, args):
    return {"taxonomy": rows(catalog.taxonomy(m.drawers()))}


# ----------------------------------------------------------------------- graph
def _graph(m):
    return m.store.read("triples"), m.store.read("entities")


@tool
def kg_query(m, args):
    name = text_arg(args, "entity", required=True)
    facts = rows(m.kg_query(name, text_arg(args, "as_of"), text_arg(args, "direction", "both")))
    return {"entity": name, "facts": facts, "count": len(facts)}


@tool
def kg_add(m, args):
    fact = {k: text_arg(args, k, required=True) for k in ("subject", "predicate", "object")}
    fact["valid_from"] = text_arg(args, "valid_from")
    row = m._one_row(**fact).withColumn("valid_to", F.lit(None).cast("string"))
    m.kg_add(row.withColumn("valid_from", F.col("valid_from").cast("string")))
    return {"success": True, "fact": fact}


@tool
def kg_invalidate(m, args):
    s, p, o = (text_arg(args, k, required=True) for k in ("subject", "predicate", "object"))
    m.kg_invalidate(s, p, o, text_arg(args, "ended"))
    return {"success": True}


@tool
def kg_timeline(m, args):
    return {"timeline": rows(kg.timeline(*_graph(m), text_arg(args, "entity")))}


@tool
def kg_stats(m, args):
    return rows(kg.stats(*_graph(m)))[0]


@tool
def conflicts(m, args):
    name = text_arg(args, "entity")
    groups = rows(kg.conflict_groups(*_graph(m), name))
    facts: dict[tuple, list] = {}
    for fact in rows(kg.conflict_facts(*_graph(m), name)):
        facts.setdefault((fact["subject"], fact["predicate"]), []).append(fact)
    conflicts = [{**g, "facts": facts.get((g["subject"], g["predicate"]), [])} for g in groups]
    return {"entity": name, "count": len(groups), "conflicts": conflicts}


@tool
def seed_adoption_facts(m, args):
    return m.seed_facts([tuple(f) for f in args.get("facts", [])])


@tool
def traverse(m, args):
    start = text_arg(args, "start_room", required=True)
    seen = m.sightings()
    walk = rooms.traverse(seen, start, int_arg(args, "max_hops", 2))
    found = rows(walk)
    if not found:
        return {"error": f"Room '{start}' not found", "suggestions": [r["room"] for r in rows(rooms.suggest_rooms(seen, start))]}
    links = rows(rooms.connecting_wings(seen, walk))
    for r in found:
        r["connected_via"] = sorted(x["wing"] for x in links if x["room"] == r["room"])
    return {"rooms": found}


@tool
def find_tunnels(m, args):
    long = rows(rooms.find_tunnels(m.sightings(), text_arg(args, "wing_a"), text_arg(args, "wing_b")))
    grouped: dict = {}
    for r in long:
        entry = grouped.setdefault(r["room"], {"room": r["room"], "count": r["drawers"], "recent": r["recent"], "wings": []})
        entry["wings"].append(r["wing"])
    for entry in grouped.values():
        entry["wings"].sort()
    return {"tunnels": sorted(grouped.values(), key=lambda e: (-e["count"], e["room"]))}


@tool
def graph_stats(m, args):
    seen = m.sightings()
    return {
        **rows(rooms.graph_stats(seen))[0],
        "rooms_per_wing": {r["wing"]: r["rooms"] for r in rows(rooms.rooms_per_wing(seen))},
        "top_tunnels": rows(rooms.top_tunnels(seen)),
    }


@tool
def create_tunnel(m, args):
    wanted = {k: text_arg(args, k, required=True) for k in ("wing_a", "room_a", "wing_b", "room_b")}
    row = rooms.tunnel_rows(m._one_row(**wanted, kind=text_arg(args, "kind", "explicit"))).withColumn("created_at", m.now())
    known = m.store.read("tunnels")
    m.store.append("tunnels", row.join(known.select("id"), "id", "left_anti"))
    return {"success": True, "tunnel_id": row.first()["id"]}


@tool
def list_tunnels(m, args):
    return {"tunnels": rows(rooms.list_tunnels(m.store.read("tunnels"), text_arg(args, "wing"), text_arg(args, "kind")))}


@tool
def delete_tunnel(m, args):
    tunnel_id = text_arg(args, "tunnel_id", required=True)
    known = m.store.read("tunnels")
    hit = not known.filter(F.col("id") == tunnel_id).isEmpty()
    if hit:
        m.store.replace("tunnels", known.filter(F.col("id") != tunnel_id))
    return {"success": hit}


@tool
def follow_tunnels(m, args):
    wing, room = (text_arg(args, k, required=True) for k in ("wing", "room"))
    return {"tunnels": rows(rooms.follow_tunnels(m.store.read("tunnels"), wing, room))}


# ----------------------------------------------------------------------- diary
@tool
def list_agents(m, args):
    return {"agents": sorted(r["agent"] for r in rows(diary.agents(m.diary())))}


@tool
def diary_write(m, args):
    agent, entry = (text_arg(args, k, required=True) for k in ("agent_name", "entry"))
    return m.diary_write(
        agent, entry, text_arg(args, "topic", "general"), text_arg(args, "session_id", ""),
        text_arg(args, "project_path", ""), [x for x in args.get("tags", []) if isinstance(x, str)],
    )


@tool
def diary_read(m, args):
    agent = text_arg(args, "agent_name", required=True)
    mine = m.diary().filter(F.col("wing") == t.diary_wing(F.lit(agent)))
    shown = rows(mine.orderBy(F.desc("filed_at"), "id").limit(int_arg(args, "last_n", 10)))
    return {"agent": agent, "entries": shown, "total": mine.count(), "showing": len(shown)}


@tool
def diary_search(m, args):
    agent, query = (text_arg(args, k, required=True) for k in ("agent_name", "query"))
    limit, project = int_arg(args, "limit", 5), text_arg(args, "project_path")
    wing = None if flag_arg(args, "all_agents") else fv.DIARY_WING_PREFIX + agent.lower().replace(" ", "_")
    found = m.search(query, limit * 4 if project else limit, wing, fv.DIARY_ROOM, search.TOOL)
    hits = rows(found)
    if project:
        # At most four times the limit: looked up by id among the project's entries.
        ids = [h["id"] for h in hits]
        here = m.diary().filter(F.col("id").isin(ids) & (F.col("project_path") == project))
        kept = {r["id"] for r in here.select("id").collect()}
        hits = [h for h in hits if h["id"] in kept]
    return {"agent": agent, "query": query, "results": hits[:limit]}


@tool
def session_context(m, args):
    agent = text_arg(args, "agent_name", required=True)
    found = rows(m.session_context(agent, text_arg(args, "project_path")))
    if not found:
        return {"agent": agent, "has_recent_session": False, "context": None}
    return {
        "agent": agent, "has_recent_session": True, "cross_agent": found[0]["cross_agent"],
        "last_active_project": found[0]["project_path"], "recent_entries": found,
    }
