"""Campaign ledgers as a stream: each event is taken or refused by the state of its campaign, which ends with the campaign or by a timer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

EVENT = "campaign string, seq long, at timestamp, kind string, id string, plan_id string, pair_id string, role string, baseline string, result string, graph_before string, graph_after string, audit_role string, audit_passed boolean"
OUT = "campaign string, seq long, id string, accepted boolean, reason string"
#: What keeps the state of a stream; transformWithState needs it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def refusal(state: dict, event: dict, used: dict) -> str | None:
    """Why an event can't follow, or None. state: seq, status, commit, graph, pending, last, applied; used: sets ids, plans and pairs."""
    if event["seq"] <= state["seq"]:
        return "already recorded"
    if event["seq"] != state["seq"] + 1:
        return "gap"
    if state["status"] != "active":
        return f"campaign is {state['status']}"
    kind, pending, last = event["kind"], state["pending"], state["last"]
    if kind == "plan":
        if pending:
            return "another child awaits application"
        if state["commit"] is not None and event["baseline"] != state["commit"]:
            return "stale baseline"
        if event["id"] in used["ids"]:
            return "duplicate child"
        if event["plan_id"] in used["plans"]:
            return "duplicate plan"
        if last and last["role"] == "preparation":
            if event["role"] != "extraction":
                return "must extract after a preparation"
            return None if event["pair_id"] == last["pair"] else "must share the pair of the preparation"
        if event["role"] != "preparation":
            return "must prepare first"
        return "pair is completed" if event["pair_id"] in used["pairs"] else None
    if kind == "record":
        if not pending:
            return "no child awaits application"
        if event["id"] != pending["id"]:
            return "can't skip the planned child"
        if state["graph"] is not None and event["graph_before"] != state["graph"]:
            return "graph doesn't follow"
        if event["audit_role"] != pending["role"]:
            return "audit of another kind"
        return None if event["audit_passed"] else "audit failed"
    if kind == "complete":
        return "a child awaits application" if pending else None
    return None if kind == "stop" else "unknown kind"


def advanced(state: dict, event: dict, used: dict, most: int | None) -> None:
    """Take an event that nothing refuses. With ``most`` children applied the campaign stops."""
    state["seq"] = event["seq"]
    if event["kind"] == "plan":
        state["pending"] = {"id": event["id"], "role": event["role"], "pair": event["pair_id"]}
        used["ids"].append(event["id"])
        used["plans"].append(event["plan_id"])
        state["commit"] = event["baseline"]
    elif event["kind"] == "record":
        done = state["pending"]
        state.update(commit=event["result"], graph=event["graph_after"], pending=None, last={"role": done["role"], "pair": done["pair"]}, applied=state["applied"] + 1)
        if done["role"] == "extraction":
            used["pairs"].append(done["pair"])
        if most is not None and state["applied"] >= most:
            state["status"] = "stopped"
    else:
        state["status"] = "completed" if event["kind"] == "complete" else "stopped"


class Ledger(StatefulProcessor):
    """State of a campaign: its head as one value, what it has used as maps; an event-time timer clears both after ``ttl_ms`` without an accepted event."""

    def __init__(self, ttl_ms: int, most: int | None = None):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "head string, timer long")
        self.used = handle.getMapState("used", "what string, name string", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        head = self.head.get() if self.head.exists() else None
        state = json.loads(head[0]) if head else {"seq": 0, "status": "active", "commit": None, "graph": None, "pending": None, "last": None, "applied": 0}
        timer, late, out = (head[1] if head else 0), 0, []
        used = {what: _Names(self.used, what) for what in ("ids", "plans", "pairs")}
        for r in pd.concat(list(rows)).sort_values(["seq", "id"], na_position="first").to_dict("records"):
            event = {k: None if pd.isna(v) else v for k, v in r.items()}
            reason = refusal(state, event, used)
            if reason is None:
                advanced(state, event, used, self.most)
                late = max(late, int(event["at"].timestamp() * 1000) + self.ttl_ms)
            out.append((key[0], event["seq"], event["id"], reason is None, reason))
        if late:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(late)
            self.head.update((json.dumps({**state, "seq": int(state["seq"])}), late))
        yield pd.DataFrame(out, columns=["campaign", "seq", "id", "accepted", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq = json.loads(self.head.get()[0])["seq"] if self.head.exists() else None
        self.head.clear()
        self.used.clear()
        yield pd.DataFrame({"campaign": [key[0]], "seq": [seq], "id": pd.Series([None], dtype=object), "accepted": pd.Series([None], dtype=object), "reason": ["expired"]})

    def close(self) -> None:
        pass


class _Names:
    """Names of one sort that a campaign has used, in its map state."""

    def __init__(self, state, what: str):
        self.state, self.what = state, what

    def __contains__(self, name: str) -> bool:
        return name is not None and self.state.containsKey((self.what, name))

    def append(self, name: str) -> None:
        if name is not None:
            self.state.updateValue((self.what, name), (1,))


def checked(events: DataFrame, ttl_ms: int, delay: str = "0 seconds", most: int | None = None) -> DataFrame:
    """events (EVENT), streaming: each accepted, or refused with a reason; and a row with reason ``expired`` for a campaign whose timer ran out.

    Events of a campaign that come together are taken in order of seq; a refused event leaves the state alone, so what follows it is
    refused as a gap until it is sent again. The campaign's state is a head, the names it has used, and goes when the watermark passes its
    last accepted event by ``ttl_ms``. A null campaign is one of its own.
    """
    return events.withWatermark("at", delay).groupBy("campaign").transformWithStateInPandas(Ledger(ttl_ms, most), OUT, "Append", "EventTime")


def written(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The stream's rows as Parquet under ``path``, a folder for each batch: a batch that runs again replaces its own folder. All that is there is read, then it ends."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return query
