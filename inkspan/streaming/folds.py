"""Ordered folds over command logs, the same code in batch and in a stream.

In batch a log is partitioned by its key and sorted inside partitions, and the fold walks the
Arrow batches keeping only the state of the key it is on: a key with a third of all rows costs
time in its task but no memory beyond its state.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.session import spread

BLANK_NUDGE = {"scale": 0.0, "dy": 0.0, "dl": 0.0, "dr": 0.0}


def slot_step(state, op, idx, payload):
    """One command on a slot: state = {"ids": [...], "nudges": [...], "active": int}."""
    ids, n = state["ids"], len(state["ids"])
    if op == "add_variant":
        ids.append(payload)
        state["nudges"].append(dict(BLANK_NUDGE))
        state["active"] = n
    elif op == "clear_all":
        state.update(ids=[], nudges=[], active=0)
    elif n == 0 or idx is None:
        pass
    elif op == "set_active":
        state["active"] = min(max(idx, 0), n - 1)
    elif op == "delete_variant":
        if 0 <= idx < n:
            del ids[idx], state["nudges"][idx]
        # the pick is clamped, not shifted, when an earlier one goes
        state["active"] = min(max(state["active"], 0), max(len(ids) - 1, 0))
    elif op == "update_nudge" and 0 <= idx < n:
        state["nudges"][idx].update(json.loads(payload or "{}"))
    elif op == "reset_nudge" and 0 <= idx < n:
        state["nudges"][idx] = dict(BLANK_NUDGE)
    return state


def new_slot():
    return {"ids": [], "nudges": [], "active": 0}


SLOT_SCHEMA = "lib_id string, key string, n int, active int, ids string, nudges string"


def _slot_row(k, s):
    return (*k, len(s["ids"]), s["active"], ",".join(map(str, s["ids"])), json.dumps(s["nudges"], sort_keys=True))


def _fold_sorted(keys, new, step, row, columns):
    """mapInPandas body: batches sorted by key, then order; one output row a key."""

    def run(batches):
        cur, state, out = None, None, []
        for pdf in batches:
            for rec in pdf.itertuples(index=False):
                k = tuple(getattr(rec, c) for c in keys)
                if k != cur:
                    if cur is not None:
                        out.append(row(cur, state))
                    cur, state = k, new()
                state = step(state, rec)
            if len(out) >= 10000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if cur is not None:
            out.append(row(cur, state))
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _idx(v):
    return None if v is None or v != v else int(v)


def library_state(commands: DataFrame) -> DataFrame:
    """Slots after replaying commands(lib_id, key, ts, seq, op, idx, payload) in (ts, seq) order.

    Commands up to a library's last clear_all cannot matter and are dropped before the shuffle.
    """
    clears = commands.where("op = 'clear_all'").groupBy("lib_id").agg(F.max(F.struct("ts", "seq")).alias("cleared"))
    live = (
        commands.where(F.col("op").isin("add_variant", "set_active", "delete_variant", "update_nudge", "reset_nudge"))
        .join(clears, "lib_id", "left")
        .where(F.col("cleared").isNull() | (F.struct("ts", "seq") > F.col("cleared")))
        .select("lib_id", "key", "ts", "seq", "op", "idx", "payload")
    )
    cols = [c.split()[0] for c in SLOT_SCHEMA.split(", ")]
    fold = _fold_sorted(("lib_id", "key"), new_slot, lambda s, r: slot_step(s, r.op, _idx(r.idx), r.payload), _slot_row, cols)
    return spread(live, "lib_id", "key").sortWithinPartitions("lib_id", "key", "ts", "seq").mapInPandas(fold, SLOT_SCHEMA).where("n > 0")


def library_settings(commands: DataFrame, default_name="Untitled") -> DataFrame:
    """Last font name (40 characters at most, blank is the default) and mirror-case flag per library."""
    at = F.struct("ts", "seq")
    named, flag = F.col("op") == "set_font_name", F.col("op") == "set_mirror_case"
    name = F.substring(F.coalesce(F.max_by("payload", F.when(named, at)), F.lit("")), 1, 40)
    g = commands.where(named | flag).groupBy("lib_id").agg(
        name.alias("font_name"), F.coalesce(F.max_by("payload", F.when(flag, at)), F.lit("true")).alias("mirror"))
    return g.select("lib_id", F.when(F.col("font_name") == "", default_name).otherwise(F.col("font_name")).alias("font_name"), (F.col("mirror") == "true").alias("mirror_case"))


def processed_photos(commands: DataFrame) -> DataFrame:
    """(lib_id, photo_id, first): photos marked processed, each once, with the (ts, seq) that marked it first; blanks don't count."""
    marks = commands.where((F.col("op") == "mark_processed") & (F.coalesce("payload", F.lit("")) != ""))
    return marks.groupBy("lib_id", F.col("payload").alias("photo_id")).agg(F.min(F.struct("ts", "seq")).alias("first"))


def patched_settings(commands: DataFrame) -> DataFrame:
    """(lib_id, target, name, value): what JSON patches leave of the tester and design settings.

    Commands update_tester and update_design carry an object; the last value of each name stands, as
    text. A design name patched to null goes; a tester name keeps its null. A setting is one value a
    task before anything moves, however many patches a library has.
    """
    patch = commands.where(F.col("op").isin("update_tester", "update_design")).select("lib_id", F.substring("op", 8, 20).alias("target"), F.struct("ts", "seq").alias("at"), F.explode(F.from_json("payload", "map<string,string>")).alias("name", "value"))
    last = patch.groupBy("lib_id", "target", "name").agg(F.max_by(F.struct("value"), "at").alias("v"))
    return last.select("lib_id", "target", "name", "v.value").where("target <> 'design' or value is not null")


def stream_library_state(commands: DataFrame) -> DataFrame:
    """The same fold as a stream, state kept per (lib_id, key).

    Within a trigger a slot's commands are applied in (ts, seq) order; the log writer addresses
    clear_all to each slot.
    """
    schema = "lib_id string, key string, n int, active int, ids string"

    def advance(key, pdfs, state):
        s = json.loads(state.get[0]) if state.exists else new_slot()
        batch = pd.concat(list(pdfs)).sort_values(["ts", "seq"])
        for r in batch.itertuples(index=False):
            s = slot_step(s, r.op, _idx(r.idx), r.payload)
        state.update((json.dumps(s),))
        yield pd.DataFrame([(*key, len(s["ids"]), s["active"], ",".join(map(str, s["ids"])))], columns=["lib_id", "key", "n", "active", "ids"])

    return commands.groupBy("lib_id", "key").applyInPandasWithState(advance, schema, "s string", "update", "NoTimeout")


# ---- review queue -----------------------------------------------------------


def new_queue():
    return {"items": [], "idx": 0}


def queue_step(q, op, photo, copies, candidates=0):
    """One event on a reviewer's queue: {"items": [{"ids", "n", "cand"}], "idx": the one on stage}.

    Accept and skip move on to the next photo. A photo opened now that still waits is brought to the
    stage as it is, one on the stage is left alone, any other comes in ahead of the rest. Every
    photo keeps its own candidate, and the next one after its last is its first.
    """
    items, at = q["items"], q["idx"]
    ids = [photo, *[c for c in copies if c != photo]] if photo else []
    item = {"ids": ids, "n": int(candidates or 0), "cand": 0}
    if op == "enqueue" and ids:
        if not any(set(it["ids"]) & set(ids) for it in items):
            items.append(item)
    elif op == "open_now" and ids:
        k = next((i for i in range(at, len(items)) if set(items[i]["ids"]) & set(ids)), None)
        items.insert(at, item if k is None else items.pop(k))
    elif op in ("accept", "skip") and at < len(items):
        q["idx"] += 1
    elif op == "next_candidate" and at < len(items) and items[at]["n"]:
        items[at]["cand"] = (items[at]["cand"] + 1) % items[at]["n"]
    return q


def review_queue(events: DataFrame) -> DataFrame:
    """review events(reviewer, ts, seq, op, photo_id, copies, candidates) -> (reviewer, waiting, idx, cand, head).

    ``candidates`` is how many shapes the photo gave; ``waiting`` counts the photo on stage, too.
    """
    def row(k, q):
        now = q["items"][q["idx"]] if q["idx"] < len(q["items"]) else None
        return (*k, len(q["items"]) - q["idx"], q["idx"], now["cand"] if now else 0, now["ids"][0] if now else None)

    def copies(v):
        return [] if v is None else list(v)

    fold = _fold_sorted(("reviewer",), new_queue, lambda q, r: queue_step(q, r.op, r.photo_id, copies(r.copies), _idx(r.candidates)), row,
                        ["reviewer", "waiting", "idx", "cand", "head"])
    return (
        spread(events.select("reviewer", "ts", "seq", "op", "photo_id", "copies", "candidates"), "reviewer").sortWithinPartitions("reviewer", "ts", "seq")
        .mapInPandas(fold, "reviewer string, waiting int, idx int, cand int, head string")
    )
