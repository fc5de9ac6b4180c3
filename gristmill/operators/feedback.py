"""Black-box text generators, and attempts that depend on the outcome of earlier ones."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

GENERATED = "raw string, input_tokens long, output_tokens long, latency_s double, hit_token_limit boolean"


def generate_with(df: DataFrame, generator: Callable[..., tuple[str, int, int]], *, messages: str = "messages", seed: str = "seed", temperature: float = 0.0, max_new_tokens: int = 256) -> DataFrame:
    """Adds the columns GENERATED to each row. generator(messages, seed, temperature, max_new_tokens) gives (text, input tokens, output tokens); its errors end the job."""
    import pandas as pd

    new = T.StructType.fromDDL(GENERATED)
    names = new.names  # parsed here: executors have no session

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = []
            for m, s in zip(p[messages], p[seed], strict=True):
                start = time.perf_counter()
                raw, read, made = generator(m, s, temperature, max_new_tokens)
                got.append((raw, read, made, time.perf_counter() - start, made >= max_new_tokens))
            yield p.assign(**{c: [g[i] for g in got] for i, c in enumerate(names)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *new.fields]))


def with_feedback(attempts: DataFrame, question: str, order: list[str], step: Callable[[dict, list[dict]], dict], outputs: str, *, feeds: Callable[[dict], bool] = lambda row: True, done: str | None = None) -> DataFrame:
    """Attempts with the output columns of `step`, which sees its row and the earlier finished rows of the same question that feed back.

    Questions run side by side, the attempts of one in the given order (a planned few, so a group is small whatever the
    input).  Rows whose `done` column is true already hold their outputs: they are kept as they are, and feed back likewise.
    """
    import pandas as pd

    new = T.StructType.fromDDL(outputs)
    schema = T.StructType([*(f for f in attempts.schema.fields if f.name not in new.names), *new.fields])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        history: list[dict[str, Any]] = []
        out = []
        for row in group.sort_values(order, kind="stable").to_dict("records"):
            if not (done and row[done]):
                row |= step(row, list(history))
            if feeds(row):
                history.append(row)
            out.append([row[c] for c in schema.names])
        return pd.DataFrame(out, columns=schema.names, dtype=object)

    return attempts.groupBy(question).applyInPandas(run, schema)
