"""Running counters of sequence numbers: a map of symbols for each connection, which is forgotten when it falls silent."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COUNTED = "last_id long, missing long, regressions long, n_rows long"


def advance(last: int | None, ids: np.ndarray) -> tuple[int, int, int]:
    """(last id, ids skipped, ids not above the one before) of ids in the order of arrival, after the last one before."""
    steps = np.diff(ids if last is None else np.concatenate([[last], ids]))
    return int(ids[-1]), int((steps[steps > 1] - 1).sum()), int((steps <= 0).sum())


def sequence_counters(stream: DataFrame, connection: str, symbol: str, ident: str, t: str, silence_ms: int = 3_600_000, late: str = "1 minute") -> DataFrame:
    """After each micro-batch, for each symbol of it by connection: last id, ids skipped, ids not above the one before, and
    rows, since the connection was opened. One without events for ``silence_ms`` of event time t (a timestamp) is reported
    closed once, and forgotten; so a replay closes it at the same place. Rows later than ``late`` are still counted.

    A connection's state is a map of its symbols, and its rows of one micro-batch are put in order (by t, then identifier)
    and taken by array operations, not one by one."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (connection, symbol)}
    names = [connection, symbol, "last_id", "missing", "regressions", "n_rows", "closed"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], s, *v, True) for s, v in sorted(had.items())], columns=names)
            return
        new, out = pd.concat(list(frames), ignore_index=True).sort_values([t, ident], kind="stable"), []
        for name, part in new.groupby(symbol, sort=True):
            old = had.get(name, (None, 0, 0, 0))
            last, missing, back = advance(old[0], part[ident].to_numpy(np.int64))
            had[name] = (last, old[1] + missing, old[2] + back, old[3] + len(part))
            out.append((key[0], name, *had[name], False))
        state.update((json.dumps(had),))
        newest = int(new[t].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + silence_ms)
        yield pd.DataFrame(out, columns=names)

    schema = f"{connection} {kinds[connection]}, {symbol} {kinds[symbol]}, {COUNTED}, closed boolean"
    rows = stream.select(*dict.fromkeys([connection, symbol, ident, t])).withWatermark(t, late).where(f"{symbol} IS NOT NULL AND {ident} IS NOT NULL")
    return rows.groupBy(connection).applyInPandasWithState(run, schema, "symbols string", "update", GroupStateTimeout.EventTimeTimeout)
