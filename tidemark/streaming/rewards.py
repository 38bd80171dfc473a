"""Extension: rewards of a stream of actions, with one row of state per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "key string, seq long, reward double"
STATE = "seq long, predicted double"


def step_rewards(stream: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Rows key, seq, actual, predicted in: each prediction is scored when its key's next row arrives, by
    1/|gap|, infinite where both are the same, if that row's actual value is there. Rows of a key have to arrive in order of seq over batches; within a
    batch they are sorted, those of one seq by ``ties``, those without a seq last.

    Defined results: two NaN, or two infinities of one sign, are the same; one NaN gives NaN; a prediction that is missing
    gives null."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(["untimed", "seq", *ties], kind="stable")
        seq, untimed, predicted, unsure = (rows[c].to_numpy() for c in ("seq", "untimed", "predicted", "unsure"))
        actual, known = rows["actual"].to_numpy(), rows["known"].to_numpy()
        if state.exists:
            held_seq, held = state.get
            seq, untimed = np.append(held_seq or 0, seq), np.append(held_seq is None, untimed)
            predicted, unsure = np.append(np.nan if held is None else held, predicted), np.append(held is None, unsure)
        else:
            actual, known = actual[1:], known[1:]
        state.update((None if untimed[-1] else int(seq[-1]), None if unsure[-1] else float(predicted[-1])))
        seq, untimed, predicted, unsure = (x[:-1] for x in (seq, untimed, predicted, unsure))
        with np.errstate(divide="ignore", invalid="ignore"):
            same = (actual == predicted) | (np.isnan(actual) & np.isnan(predicted))
            reward = np.where(unsure, np.nan, np.where(same, np.inf, 1 / np.abs(actual - predicted)))
        odd = np.isnan(reward) & ~unsure  # a NaN would come out as null
        yield pd.DataFrame({"key": key[0], "seq": seq, "reward": reward, "untimed": untimed, "odd": odd})[known]

    marks = [F.col("seq").isNull().alias("untimed"), F.col("actual").isNotNull().alias("known"), F.col("predicted").isNull().alias("unsure")]
    rows = stream.select("key", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.col("actual").cast("double"), F.col("predicted").cast("double"), *marks, *ties)
    found = rows.groupBy("key").applyInPandasWithState(step, f"{RESULT}, untimed boolean, odd boolean", STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select("key", F.when(~F.col("untimed"), F.col("seq")).alias("seq"), F.when(F.col("odd"), F.lit(float("nan"))).otherwise(F.col("reward")).alias("reward"))
