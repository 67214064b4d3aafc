"""The egress gate over a stream: detection is stateless, token numbers are state of their scope.

Numbers grow densely by type within a scope. With a `ttl`, a scope's state expires after so many seconds without
use; such a query runs on without input, so that timeouts can fire.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloakwork.operators.detect import detect
from cloakwork.operators.overlap import rewrite

OUTPUT = "scope string, message_id bigint, text string, entities bigint"


def gate(messages: DataFrame, types: list[str], ttl: int | None = None) -> DataFrame:
    """messages (scope, message_id, text), streaming, to redacted texts; within a batch in order of message_id."""
    wanted = frozenset(types)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = json.loads(state.get[0]) if state.exists else {}
        out = []
        for row in pd.concat(list(frames)).sort_values("message_id").itertuples(index=False):
            found = detect(row.text, wanted)
            new = []
            for s in found:
                of_type = known.setdefault(s.type, {})
                number = of_type.setdefault(s.identity or s.raw, len(of_type) + 1)
                new.append((s.start, s.end, f"[{s.type}_{number:02d}]"))
            out.append((key[0], row.message_id, rewrite(row.text or "", new), len(found)))
        state.update((json.dumps(known, ensure_ascii=False),))
        if ttl:
            state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame(out, columns=["scope", "message_id", "text", "entities"])

    keyed = messages.select("scope", F.col("message_id").cast("bigint").alias("message_id"), "text")
    return keyed.groupBy("scope").applyInPandasWithState(run, OUTPUT, "known string", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)
