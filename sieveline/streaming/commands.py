"""The command log as a stream: one small state per evaluation, verdicts as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveline.operators.decisions import Standing

OUTPUT = "evaluation_id string, seq long, command string, accepted boolean, reason string, status_after string, n_active long"
STATE = "status string, decisions array<long>, actions array<string>, befores array<string>, phases array<string>"
#: Verdicts that are handed on at once.
PART = 10_000


def _step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    """The commands of one evaluation that a micro-batch brings, in order of ``seq``."""
    state = Standing()
    if group.exists:
        status, *stack = group.get
        state = Standing(status, [list(d) for d in zip(*stack)])
    # Words are kept as codes, so a command takes a few bytes however many there are.
    words = {"command": [], "refusal": []}
    codes = {c: {} for c in words}
    parts = []
    for batch in batches:
        part = batch[["seq", "no_contact", "target"]].copy()
        for c in words:
            for w in batch[c].unique():
                if w not in codes[c]:
                    codes[c][w] = len(words[c])
                    words[c].append(w if isinstance(w, str) else None)
            part[c] = batch[c].map(codes[c]).astype("int8")
        parts.append(part)
    rows = pd.concat(parts).sort_values("seq")
    for begin in range(0, len(rows), PART):
        part = rows.iloc[begin : begin + PART]
        reasons, statuses, depths = [], [], []
        named = [words["command"][c] for c in part["command"]]
        for seq, command, contact, refusal, target in zip(part["seq"].tolist(), named, part["no_contact"], part["refusal"], part["target"]):
            reasons.append(state.apply(command, seq, None if pd.isna(target) else int(target), bool(contact), words["refusal"][refusal]))
            statuses.append(state.status)
            depths.append(len(state.active))
        yield pd.DataFrame(
            {
                "evaluation_id": key[0], "seq": part["seq"].to_numpy(), "command": named, "accepted": [r is None for r in reasons],
                "reason": reasons, "status_after": statuses, "n_active": depths,
            }
        )
    group.update((state.status, *([d[k] for d in state.active] for k in range(4))))


def fold_stream(commands: DataFrame) -> DataFrame:
    """Commands in order of ``seq`` within a micro-batch; batches in order of arrival.

    A batch holds what arrived since the last one; limit it at the source (maxFilesPerTrigger and the
    like) where an evaluation may send very many commands at once.
    """
    if "target" not in commands.columns:
        commands = commands.withColumn("target", F.lit(None).cast("long"))
    return commands.groupBy("evaluation_id").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
