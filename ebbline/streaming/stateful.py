"""A strategy's position as a stateful stream: flat or long by symbol, decided on a bar and filled at the next one's open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILLS = "symbol string, open_time long, side string, price double"
STATE = "position int, pending string, stop double, last_time long"


def fills(features: DataFrame, stop_multiple: float = 2.0) -> DataFrame:
    """features: symbol, open_time, open, close, atr, enters, exits, in order of time within each symbol's batch; earlier bars than the last one are ignored."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        position, pending, stop, last = state.get if state.exists else (0, "", 0.0, -1)
        rows = []
        for bar in pd.concat(list(batches)).sort_values("open_time").itertuples(index=False):
            if bar.open_time <= last:
                continue
            last = bar.open_time
            if pending:
                position = 1 if pending == "buy" else 0
                rows.append((key[0], bar.open_time, pending, bar.open))
                pending = ""
            if not position and bar.enters and bar.atr == bar.atr and bar.atr > 0:
                pending, stop = "buy", bar.close - stop_multiple * bar.atr
            elif position and (bar.exits or bar.close < stop):
                pending = "sell"
        state.update((position, pending, float(stop), int(last)))
        yield pd.DataFrame(rows, columns=["symbol", "open_time", "side", "price"])

    return features.groupBy("symbol").applyInPandasWithState(run, FILLS, STATE, "append", GroupStateTimeout.NoTimeout)
