"""Exchanges from a stream of turns, one state a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session string, xid bigint, turn_lo int, turn_hi int, q string, a string, body string"
STATE = "at int, xid bigint, roles array<string>, texts array<string>, seqs array<bigint>"


def pop(roles: list[str], texts: list[str]) -> int:
    """How many turns of a buffer the oldest exchange takes: user turns and the turn after them, or one other turn."""
    n = 0
    while n < len(roles) and roles[n] == "user":
        n += 1
    return min(n + 1, len(roles))


def _row(session: str, xid: int, at: int, roles: list[str], texts: list[str]) -> dict:
    q = " ".join(t for r, t in zip(roles, texts, strict=True) if r == "user").strip()
    a = " ".join(t for r, t in zip(roles, texts, strict=True) if r != "user").strip()
    return {"session": session, "xid": xid, "turn_lo": at, "turn_hi": at + len(roles) - 1, "q": q or "context", "a": a, "body": " ".join(texts)}


def offload(turns: DataFrame, window: int = 8, idle: str | None = None, forced: bool = False) -> DataFrame:
    """Exchanges (OUT) of a stream of (session, turn, role, text).

    A session's buffer emits its oldest exchange when it reaches ``window``
    turns; after ``idle`` of processing time without turns (or, with ``forced``,
    at the end of each batch) it is emptied.  Blank turns don't count.  Numbers
    go on across restarts, as the state is checkpointed.
    """
    window = max(2, window)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, xid, roles, texts, seqs = state.get if state.exists else (0, 0, [], [], [])
        roles, texts, seqs = list(roles), list(texts), list(seqs)
        out = []

        def take() -> None:
            nonlocal at, xid
            n = pop(roles, texts)
            xid += 1
            out.append(_row(key[0], xid, at, roles[:n], texts[:n]))
            at += n
            del roles[:n], texts[:n], seqs[:n]

        if state.hasTimedOut:
            while roles:
                take()
        else:
            new = pd.concat(list(batches)) if batches is not None else pd.DataFrame()
            for r in new.sort_values("turn").itertuples():
                if not (r.text or "").strip():
                    continue
                roles.append(r.role)
                texts.append(r.text)
                seqs.append(int(r.turn))
                if len(roles) >= window:
                    take()
            while forced and roles:
                take()
        state.update((at, xid, roles, texts, seqs))
        if idle and roles:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return turns.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", timeout)


def due(new_turns: int, seconds: float, turns_limit: int = 10, seconds_limit: float = 60) -> bool:
    """Whether a debounced flush is due: enough turns or enough time since the last, but never for nothing."""
    return new_turns > 0 and (new_turns >= turns_limit or seconds >= seconds_limit)


def access_counts(log: DataFrame) -> DataFrame:
    """Accesses a record from a stream of recalls (xid), in update mode."""
    return log.groupBy("xid").count().withColumnRenamed("count", "accesses")
