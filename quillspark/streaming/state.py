"""Sequential state machines per key: each is one pure step function, run over batches and over streams alike.

``run_batch`` orders a key's rows and folds the step over them (``applyInPandas``); ``run_stream`` keeps the state in
Structured Streaming (``applyInPandasWithState``). A key's rows are read in one task, as its state demands; rows of a key
are folded as they come and never held beyond their Arrow batch in the stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict, dict], tuple[dict, object]]


@dataclass(frozen=True)
class Machine:
    """``start``: the first state (JSON-able); ``step``: (state, row) -> (state, output); ``output``: its DDL type."""

    start: dict
    step: Step
    output: str
    time_column: str = "ts"
    tie_column: str = "event_id"
    columns: tuple[str, ...] = field(default=())


def rate_limiter(most: int = 10, window: float = 60.0) -> Machine:
    """Allowed while fewer than ``most`` accepted requests lie in the window; rejected ones are not recorded."""

    def step(state: dict, row: dict):
        kept = [t for t in state["log"] if t > row["ts"] - window]
        ok = len(kept) < most
        if ok:
            kept.append(row["ts"])
        return {"log": kept}, {"allowed": ok, "remaining": max(0, most - len(kept))}

    return Machine({"log": []}, step, "allowed boolean, remaining int")


def adaptive_context(initial: int = 2048, step_size: int = 2048, window: int = 5, most: int = 131072, retries: int = 10) -> Machine:
    """Rows ``used, truncated``: grows by a step where a request nearly fills the context, shrinks where the last
    ``window`` all fit 80 % of the next smaller one; then the history is forgotten."""

    def step(state: dict, row: dict):
        size, history, tries = state["size"], state["history"], state["tries"]
        near = row["used"] / size >= 0.95 if size else False
        if (row["truncated"] or near) and size < most and tries < retries:
            return {"size": min(size + step_size, most), "history": history, "tries": tries + 1}, {"context": min(size + step_size, most), "action": "grow"}
        history = [*history, row["used"]][-window:]
        smaller = max(size - step_size, initial)
        if len(history) == window and size > initial and smaller < size and max(history) <= smaller * 0.8:
            return {"size": smaller, "history": [], "tries": 0}, {"context": smaller, "action": "shrink"}
        return {"size": size, "history": history, "tries": 0}, {"context": size, "action": "keep"}

    return Machine({"size": initial, "history": [], "tries": 0}, step, "context int, action string", columns=("used", "truncated"))


def circuit_breaker(failures: int = 5, timeout: float = 60.0, successes: int = 2) -> Machine:
    """Rows ``ok``: closed until enough failures (a success takes one off), open for ``timeout`` seconds, half-open until
    enough successes."""

    def step(state: dict, row: dict):
        now, s = row["ts"], dict(state)
        if s["state"] == "open" and s["last"] is not None and now - s["last"] >= timeout:
            s |= {"state": "half_open", "good": 0}
        allowed = s["state"] != "open"
        if allowed and row["ok"]:
            if s["state"] == "half_open":
                s["good"] += 1
                if s["good"] >= successes:
                    s |= {"state": "closed", "bad": 0, "good": 0}
            else:
                s["bad"] = max(0, s["bad"] - 1)
        elif allowed:
            s["bad"] += 1
            s["last"] = now
            if s["bad"] >= failures:
                s |= {"state": "open", "good": 0}
        return s, {"allowed": allowed, "state": s["state"]}

    return Machine({"state": "closed", "bad": 0, "good": 0, "last": None}, step, "allowed boolean, state string", columns=("ok",))


def loop_watch(detect: Callable[[str], bool], least: int = 500, every: int = 500, slack: int = 50) -> Machine:
    """Rows ``token``: the growing text is looked at each time its length passes a multiple of ``every``."""

    def step(state: dict, row: dict):
        text = state["text"] + row["token"]
        looked = len(text) > least and len(text) % every < slack
        aborted = state["aborted"] or (looked and detect(text))
        return {"text": text[-3000 - every :] if len(text) > 4 * every + 3000 else text, "aborted": aborted}, {"aborted": aborted}

    return Machine({"text": "", "aborted": False}, step, "aborted boolean", columns=("token",))


def _names(machine: Machine) -> list[str]:
    return [c.split()[0] for c in machine.output.split(", ")]


def _fold(machine: Machine, state: dict, rows: pd.DataFrame):
    out = []
    for row in rows.to_dict("records"):
        state, made = machine.step(state, row)
        out.append(made)
    return state, out


def _prepared(rows: DataFrame, machine: Machine, key: str) -> DataFrame:
    return rows.select(
        F.col(key).cast("string").alias("key"), F.col(machine.tie_column).cast("long").alias("tie"), F.col(machine.time_column).cast("timestamp").cast("double").alias("ts"), *machine.columns)


def run_batch(rows: DataFrame, machine: Machine, key: str) -> DataFrame:
    """key, tie, and the machine's output for every row, a key's rows in order of time and tie."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "tie"], kind="stable")
        _, out = _fold(machine, json.loads(json.dumps(machine.start)), group)
        return pd.concat([group[["key", "tie"]].reset_index(drop=True), pd.DataFrame(out, columns=_names(machine))], axis=1)

    return _prepared(rows, machine, key).groupBy("key").applyInPandas(run, f"key string, tie long, {machine.output}")


def run_stream(rows: DataFrame, machine: Machine, key: str) -> DataFrame:
    """The same over a stream; within a micro-batch a key's rows are put in order."""

    def run(key_, groups, state):
        now = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(machine.start))
        group = pd.concat(list(groups)).sort_values(["ts", "tie"], kind="stable")
        now, out = _fold(machine, now, group)
        state.update((json.dumps(now),))
        yield pd.concat([group[["key", "tie"]].reset_index(drop=True), pd.DataFrame(out, columns=_names(machine))], axis=1)

    return _prepared(rows, machine, key).groupBy("key").applyInPandasWithState(
        run, f"key string, tie long, {machine.output}", "state string", "append", "NoTimeout")
