"""The context of running chats: of each conversation the last tokens, kept as state from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.bpe_encode import Merges

_OUT = "conv_id long, n_tokens long, context array<int>"


class ContextProcessor(StatefulProcessor):
    """Keeps the last ``keep`` ids of a conversation, and how many there have been since it began."""

    def __init__(self, merges: Sequence[tuple[int, int]], keep: int):
        self.merges, self.keep = list(merges), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("context", "n long, ids array<int>")
        self.table = Merges(self.merges)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        eos = 256 + len(self.merges)
        n, ids = 1, [eos]
        if self.state.exists():
            n, ids = self.state.get()
            ids = list(ids)
        turns = pd.concat(list(rows)).sort_values(["turn", "role", "text"])
        for role, text in zip(turns["role"], turns["text"]):
            if text == "/reset":
                n, ids = 1, [eos]
                continue
            data = np.frombuffer(f"{role}: {text or ''}\n".encode(), np.uint8)
            new, _ = self.table.encode(data, np.array([len(data)]))
            n += len(new)
            ids = (ids + new.tolist())[-self.keep :]
        self.state.update((n, ids))
        yield pd.DataFrame({"conv_id": [key[0]], "n_tokens": [n], "context": [ids]})

    def close(self) -> None:
        pass


def contexts(turns: DataFrame, merges: Sequence[tuple[int, int]], context: int) -> DataFrame:
    """A stream's ``conv_id``, ``n_tokens`` and ``context``: after each batch, the last 2 * ``context`` ids of the
    conversations that have new turns.

    ``turns`` has conv_id, turn, role and text; the turns of a conversation come in order over the batches. A
    conversation begins with an end token, and again after the text ``/reset``. A line is encoded alone, so that no merge
    reaches across. The state of a conversation has a fixed size; it needs a state store that supports
    ``transformWithState``, such as RocksDB.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    return rows.groupBy("conv_id").transformWithStateInPandas(ContextProcessor(merges, 2 * context), _OUT, "update", "none")
