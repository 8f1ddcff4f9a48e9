"""Hysteresis over a stream: each source's state is kept between micro-batches.

The batch operators need the end of a source for tails and exclusive segments;
this gives the provisional route of each window as it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CompilerPolicy

OUTPUT = "source_id long, idx long, s double, e double, score double, active boolean, route string"


def route_stream(windows: DataFrame, policy: CompilerPolicy = CompilerPolicy()) -> DataFrame:
    """windows (source_id, idx, s, e, score, u), in time order per source, with active and route."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = state.get[0] if state.exists else False
        for pdf in batches:
            pdf = pdf.sort_values(["s", "e", "idx"])
            on, route = [], []
            for score, u in zip(pdf["score"], pdf["u"], strict=True):
                active = score >= policy.enter or (active and score >= policy.exit)
                unsure = policy.exit < score < policy.enter or (policy.uncertainty is not None and pd.notna(u) and u >= policy.uncertainty)
                on.append(active)
                route.append(policy.uncertain_route if unsure else "keep" if active else "discard")
            yield pd.DataFrame({"source_id": key[0], "idx": pdf["idx"].to_numpy(), "s": pdf["s"].to_numpy(), "e": pdf["e"].to_numpy(), "score": pdf["score"].to_numpy(), "active": on, "route": route})
        state.update((active,))

    return windows.groupBy("source_id").applyInPandasWithState(step, OUTPUT, "active boolean", "append", GroupStateTimeout.NoTimeout)
