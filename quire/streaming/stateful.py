"""Stateful streams built on ``applyInPandasWithState`` (ST-1, ST-3, ST-4).

Rows of one key are processed in their order column within each micro-batch;
state carries what the next batch needs, in typed columns, and is bounded per
key: a mark that a response has ended (ST-1), a ticker and five summaries
(ST-3), one fingerprint for every ticker of a session (ST-4).  All of them append rows, so any file sink
works.  No timeout by default, so results equal the batch twins.  With
``timeout`` (a duration such as "1 day") a key that is silent so long, in
processing time, loses its state; what comes later begins anew.

``transformWithState`` has lists and timers of its own, but in Python its state
is served over a socket by a process that the library does not start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.functions.hashing import query_hash
from quire.operators.history import HISTORY_BULLET, HISTORY_HEADER, HISTORY_LEN
from quire.operators.ingest import CHANGED, INITIAL, NO_TICKER, SAME
from quire.operators.responses import CANCELLED, COMPLETED, FAILED


def _milliseconds(timeout: str | None) -> int | None:
    if timeout is None:
        return None
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    if ms <= 0:
        raise ValueError("timeout must be positive")
    return ms


def _with_timeout(fn, timeout: str | None):
    """``fn`` with state that ends ``timeout`` after the key's last rows, and the matching setting.

    ``fn`` gets a key's rows and state; a key that timed out has no rows.
    """
    ms = _milliseconds(timeout)
    if ms is None:
        return fn, GroupStateTimeout.NoTimeout

    def timed(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        yield from fn(key, pdfs, state)
        if state.exists:
            state.setTimeoutDuration(ms)
    return timed, GroupStateTimeout.ProcessingTimeTimeout


# ------------------------------------------------------------------ ST-1 responses
def _live_fn(key, pdfs, state):
    """The events of a response as they came, until the batch that ends it."""
    if state.exists:
        return                                  # the answer was final
    ended = False
    for pdf in pdfs:
        ended = ended or bool(pdf["type"].isin([FAILED, CANCELLED, COMPLETED]).any())
        yield pdf
    if ended:
        state.update((True,))


def live_responses(events: DataFrame, timeout: str | None = None) -> DataFrame:
    """ST-1: the live events of streamed responses, as an append-only log of the same columns.

    A response ends with its stopping or completing event: events of later
    micro-batches are ignored.  Within a micro-batch events may come in any
    order.  An event is read and appended once, and the state of a response is
    the mark that it has ended, so the work is linear in its events however
    many batches they span.  ``operators.responses.assemble`` and
    ``plans.answer_report`` give the answers of the log at any time.
    """
    fn, kind = _with_timeout(_live_fn, timeout)
    return events.groupBy("response_id").applyInPandasWithState(fn, events.schema, "ended boolean", "append", kind)


# ------------------------------------------------------------------ ST-3 history
def _history_fn(key, pdfs, state):
    seen, (last, held) = state.exists, state.get if state.exists else (None, [])
    held = list(held)
    rows = pd.concat(list(pdfs), ignore_index=True).sort_values("turn")
    out_turn, out_hist = [], []
    for turn, ticker, summary in zip(rows["turn"], rows["ticker"], rows["summary"]):
        ticker = None if ticker is None or (isinstance(ticker, float) and pd.isna(ticker)) else ticker
        if not seen or ticker != last:
            held = []
        seen, last = True, ticker
        out_turn.append(int(turn))
        out_hist.append(HISTORY_HEADER + "\n".join(HISTORY_BULLET + s for s in held) if held else "")
        if summary is not None and not (isinstance(summary, float) and pd.isna(summary)):
            held = (held + [summary])[-HISTORY_LEN:]
    state.update((last, held))
    yield pd.DataFrame({"session_id": [key[0]] * len(out_turn), "turn": out_turn, "history": out_hist})


def rolling_history(summaries: DataFrame, timeout: str | None = None) -> DataFrame:
    """ST-3: history block visible to each prompt (twin: WIN-5/6 + AGG-10)."""
    fn, kind = _with_timeout(_history_fn, timeout)
    return summaries.select("session_id", "turn", "ticker", "summary").groupBy("session_id").applyInPandasWithState(
        fn, "session_id bigint, turn bigint, history string", "ticker string, held array<string>", "append", kind)


# ------------------------------------------------------------------ ST-4 change detection
def _change_fn(ms: int | None):
    """The reasons of a session's rows; its state lists the last fingerprint of every ticker and when it was seen.

    With ``ms`` a ticker without rows for so long is forgotten, as if it were a key of its own.
    """
    def fn(key, pdfs, state):
        held = {t: (h, seen) for t, h, seen in zip(*state.get, strict=True)} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if ms else 0
        if not state.hasTimedOut:
            parts = list(pdfs)
            rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            tickers, hashes = rows["ticker"].tolist(), rows["query_hash"].tolist()
            reasons = [NO_TICKER] * len(rows)
            for i in np.lexsort((rows["request_id"].to_numpy(), rows["ts"].to_numpy())):
                t, h = tickers[i], hashes[i]
                if t:                              # neither null nor empty
                    reasons[i] = INITIAL if t not in held else (CHANGED if h != held[t][0] else SAME)
                    held[t] = h, now
            rows["reason"] = reasons
            for c in ("request_id", "session_id"):
                if rows[c].dtype != "int64":       # a null makes them floats
                    rows[c] = rows[c].astype("Int64")
            yield rows[["request_id", "session_id", "ticker", "query_hash", "reason"]]
        if ms:
            held = {t: x for t, x in held.items() if x[1] + ms > now}
        if held:
            state.update((list(held), [h for h, _ in held.values()], [seen for _, seen in held.values()]))
            if ms:
                state.setTimeoutDuration(min(seen for _, seen in held.values()) + ms - now)
        elif state.exists:
            state.remove()
    return fn


def detect_change(requests: DataFrame, timeout: str | None = None) -> DataFrame:
    """ST-4: per (session, ticker) fingerprint change reasons (twin: ``ingest.detect_change``).

    Rows and state go by session, as a call of Python for every (session, ticker) took most of the time.
    """
    ms = _milliseconds(timeout)
    has_ticker = F.coalesce(F.col("ticker"), F.lit("")) != ""       # an empty ticker is no ticker, as in the batch twin
    h = F.when(has_ticker, query_hash(F.col("ticker"), F.col("date_from"), F.col("date_to"),
                                                         F.col("types"), F.col("price_sensitive")))
    prepared = requests.select("request_id", "session_id", "ticker", "ts", h.alias("query_hash"))
    return prepared.groupBy("session_id").applyInPandasWithState(
        _change_fn(ms), "request_id bigint, session_id bigint, ticker string, query_hash string, reason string",
        "tickers array<string>, hashes array<string>, seen array<bigint>", "append",
        GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout)
