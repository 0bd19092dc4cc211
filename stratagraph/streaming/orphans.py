"""The pending-orphan state as a stream: references probe, arriving records resolve, deletions reopen.

Input rows: uid, at, what (``ref``, ``arrive`` or ``delete``), relation_id, endpoint. Output rows: uid, at, what
(``orphan``, ``resolved`` or ``reopened``), relation_id (of an orphan), refs (how many references changed).

State is kept per uid and salt: how many records are live and how many references wait, two numbers whatever the
number of references. References are spread over ``salts`` parts of their uid and every change goes to all parts, so a
uid that a third of all rows refer to is worked on by as many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "uid string, at timestamp, what string, relation_id long, refs long"
STATE = "open long, refs long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    uid = key[0]
    live, refs = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches), ignore_index=True)
    rank = rows.what.map({"arrive": 0, "delete": 1, "ref": 2})  # at one moment records change before references ask
    rows = rows.assign(rank=rank).sort_values(["at", "rank"], kind="stable")
    out: list[tuple[Any, ...]] = []
    for at, what, relation in zip(rows["at"], rows["what"], rows["relation_id"]):
        if what == "ref":
            refs += 1
            if live <= 0:
                out.append((uid, at, "orphan", int(relation), 1))
        elif what == "arrive":
            live += 1
            if live == 1 and refs:
                out.append((uid, at, "resolved", None, refs))
        else:
            live -= 1
            if live == 0 and refs:
                out.append((uid, at, "reopened", None, refs))
    state.update((live, refs))
    yield pd.DataFrame(out, columns=["uid", "at", "what", "relation_id", "refs"]).astype({"relation_id": "Int64", "refs": "Int64"})


def orphan_events(changes: DataFrame, salts: int = 8) -> DataFrame:
    """The stream of orphan events from a stream of changes."""
    own = F.array(F.pmod(F.xxhash64("relation_id"), F.lit(salts)).cast("int"))
    parts = F.when(F.col("what") == "ref", own).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
    rows = changes.select("uid", "at", "what", "relation_id", "endpoint", F.explode(parts).alias("salt"))
    return rows.groupBy("uid", "salt").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
