"""Symbol-by-symbol updates of keyed streams: a machine's states, its output and a model's log probability.

The reference semantics have no event time; symbols are taken in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fsweave.operators.apply import sequential_form
from fsweave.operators.ngram import NgramModel
from fsweave.plans.machine import Machine

OUTPUT = "key string, n long, written string, state int, logprefix double"


class Follow(StatefulProcessor):
    """Per key: the sequential machine's state, the last n-1 symbols, the length and the log prefix probability."""

    def __init__(self, form, model: NgramModel | None):
        self.form, self.model = form, model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "q int, n long, ctx string, logprefix double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        q, n, ctx, lp = self.state.get() if self.state.exists() else (0, 0, "", 0.0)
        context = tuple(ctx.split("\x1f")) if ctx else ()
        steps, _ = self.form
        written = []
        symbols = [s for pdf in rows for s in pdf.sort_values("seq")["symbol"].tolist()]
        for s in symbols:
            if self.model is not None:
                lp += self.model.logp(context, s)
                context = (*context, s)[-(self.model.n - 1) :] if self.model.n > 1 else ()
            hit = steps[q].get(s) if q >= 0 else None
            if hit is None:
                q = -1
            else:
                written.append(hit[0])
                q = hit[1]
            n += 1
        self.state.update((int(q), int(n), "\x1f".join(context), float(lp)))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "written": ["".join(written)], "state": [q], "logprefix": [lp]})

    def close(self) -> None:
        pass


def follow(stream: DataFrame, m: Machine, model: NgramModel | None = None) -> DataFrame:
    """``stream`` (key string, seq long, symbol string) -> what each batch adds to each key's output.

    Needs a state store with column families (``spark.sql.streaming.stateStore.providerClass``
    set to the RocksDB provider).  ``state`` is -1 once a key's input has left the domain.
    """
    form = sequential_form(m)
    if form is None:
        raise ValueError("only machines with a sequential form can be followed symbol by symbol")
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=Follow(form, model), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def follow_batch(df: DataFrame, m: Machine, model: NgramModel | None = None) -> DataFrame:
    """The same over a finished table: the final row of each key."""
    form = sequential_form(m)
    if form is None:
        raise ValueError("only machines with a sequential form can be followed symbol by symbol")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q, lp, context, written = 0, 0.0, (), []
        for s in pdf.sort_values("seq")["symbol"]:
            if model is not None:
                lp += model.logp(context, s)
                context = (*context, s)[-(model.n - 1) :] if model.n > 1 else ()
            hit = form[0][q].get(s) if q >= 0 else None
            if hit is None:
                q = -1
            else:
                written.append(hit[0])
                q = hit[1]
        return pd.DataFrame({"key": [key[0]], "n": [len(pdf)], "written": ["".join(written)], "state": [q], "logprefix": [lp]})

    return df.groupBy("key").applyInPandas(run, OUTPUT)
