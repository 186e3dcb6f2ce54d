"""Finite state machines over ordered rows, without one task per key.

A machine with few states turns a block of rows into a small table "state in ->
state out".  Such tables compose, so a key is folded block by block in
parallel: tables per (key, block), a short pass over the tables of a key to
find the state each block starts in, then the rows of each block once more from
its start state.  Inside a block the tables are joined by doubling, without a
loop over rows.  The result equals the row-by-row fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.ordered import Cut, attach, index_rows


def composed(maps: np.ndarray) -> list[np.ndarray]:
    """Levels of a tree over a block: rows' maps "state in -> state out", then those of 2, 4, 8, ... rows in a row.

    Maps are joined pairwise by one gather a level, so a block takes log2(rows) steps.
    """
    levels = [maps]
    while len(levels[-1]) > 1:
        below = levels[-1]
        if len(below) % 2:
            below = levels[-1] = np.vstack([below, np.arange(below.shape[1], dtype=below.dtype)[None]])
        levels.append(below[1::2][np.arange(len(below) // 2)[:, None], below[0::2]])
    return levels


def states_before(levels: list[np.ndarray], start: int) -> np.ndarray:
    """The state before each row, from the top of the tree down: a right half starts where its left half ends."""
    states = np.array([start], np.int32)
    for below in levels[-2::-1]:
        states = states[: len(below) // 2]
        after = below[0::2][np.arange(len(states)), states]
        states = np.column_stack([states, after]).ravel()
    return states


def run_machine(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    symbol: str,
    transition: np.ndarray,
    cell: Cut = None,
    start: int = 0,
    block_rows: int = 50_000,
) -> DataFrame:
    """Adds ``state_before`` for the machine ``transition[symbol, state] -> state``.

    ``symbol`` is an integer input column.  Rows are numbered inside their key
    and cut into blocks of exactly ``block_rows``, so what a Python task holds
    is bounded however hot a key or a moment is.
    """
    keys, order = list(keys), list(order)
    group = [*keys, "_block"]
    table = np.asarray(transition, dtype="uint8" if np.shape(transition)[1] <= 256 else "int32")
    numbered = index_rows(df, keys, order, cell, "_idx")
    rows = numbered.withColumn("_block", F.floor(F.col("_idx") / block_rows))
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        root = composed(table[pdf.sort_values("_idx")[symbol].to_numpy()])[-1][0]
        return pdf[group].iloc[:1].assign(image=[root.tolist()])

    images = rows.select(*group, "_idx", symbol).groupBy(*group).applyInPandas(
        summarise, f"{key_fields}, image array<int>"
    )

    def chain_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per block of the key
        pdf = pdf.sort_values("_block")
        states, current = [], start
        for image in pdf["image"]:
            states.append(current)
            current = int(image[current])
        return pdf[group].assign(_start=np.asarray(states, dtype="int32"))

    starts = images.groupBy(*keys).applyInPandas(chain_blocks, f"{key_fields}, _start int")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        before = states_before(composed(table[pdf[symbol].to_numpy()]), int(pdf["_start"].iloc[0]))[: len(pdf)]
        return pdf.drop(columns=["_block", "_idx", "_start"]).assign(state_before=before)

    out_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return attach(rows, starts, group).groupBy(*group).applyInPandas(replay, f"{out_fields}, state_before int")


def rollback_table(
    sustained: int = config.ROLLBACK["sustained"],
    recovery: int = config.ROLLBACK["recovery"],
    cooldown: int = config.ROLLBACK["cooldown"],
) -> np.ndarray:
    """E14 as a machine.  Inputs: 0 healthy, 1 degraded.

    States: armed with 0..sustained-1 degraded periods in a row, then cooldown
    with cooldown..1 periods left, then disarmed with 0..recovery-1 healthy
    periods in a row.  Firing is the step from the last armed state on input 1.
    """
    armed, cool = 0, sustained
    disarmed = sustained + cooldown
    n = disarmed + recovery
    table = np.zeros((2, n), dtype="int32")
    after_fire = cool if cooldown else disarmed
    for d in range(sustained):
        table[0, armed + d] = armed
        table[1, armed + d] = armed + d + 1 if d + 1 < sustained else after_fire
    for c in range(cooldown):
        table[:, cool + c] = cool + c + 1 if c + 1 < cooldown else disarmed
    for h in range(recovery):
        table[0, disarmed + h] = disarmed + h + 1 if h + 1 < recovery else armed
        table[1, disarmed + h] = disarmed
    return table


def rollback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Cut = None,
    current: str = "current_fitness",
    champion: str = "champion_fitness",
    drop: float = config.ROLLBACK["drop"],
    sustained: int = config.ROLLBACK["sustained"],
    recovery: int = config.ROLLBACK["recovery"],
    cooldown: int = config.ROLLBACK["cooldown"],
) -> DataFrame:
    """Fires on the third degraded period in a row while armed."""
    fall = (F.col(champion) - F.col(current)) / F.col(champion)
    degraded = F.when(F.col(champion) == 0, 0).otherwise((fall > drop).cast("int"))
    flagged = df.withColumn("degraded", F.coalesce(degraded, F.lit(0)))
    states = run_machine(
        flagged, keys, order, "degraded", rollback_table(sustained, recovery, cooldown), cell
    )
    state = F.col("state_before")
    return states.select(
        *flagged.columns,
        ((F.col("degraded") == 1) & (state == sustained - 1)).alias("fired"),
        (state < sustained).alias("armed_before"),
    )


def breaker_table(cooldown: int = config.BREAKER_COOLDOWN) -> np.ndarray:
    """One breaker, checked and then advanced once per bar.  Inputs: 0 fine, 1 breached.

    State 0 is active; state c > 0 means c more blocked bars.
    """
    cooldown = max(cooldown, 1)  # a breach always blocks the next bar too
    table = np.zeros((2, cooldown + 1), dtype="int32")
    table[1, 0] = cooldown
    for c in range(1, cooldown + 1):
        table[:, c] = c - 1
    return table


def breakers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    cell: Cut = None,
    limits: dict[str, tuple[float, bool]] | None = None,
    cooldown: int = config.BREAKER_COOLDOWN,
) -> DataFrame:
    """Four breakers with per-bar values given as columns.

    Four small machines are one machine over the product of their states, so
    the bars are folded once.  A blocked breaker does not look at the value and
    reports as triggered.
    """
    limits = limits or config.BREAKERS
    names = list(limits)
    code = F.lit(0)
    for i, name in enumerate(names):
        bound, upper = limits[name]
        breach = values[name] > bound if upper else values[name] < bound
        code = code + F.coalesce(breach, F.lit(False)).cast("int") * (1 << i)
    single, base = breaker_table(cooldown), max(cooldown, 1) + 1
    n_states = base ** len(names)
    table = np.zeros((1 << len(names), n_states), dtype="int32")
    for s in range(1 << len(names)):
        for state in range(n_states):
            rest, nxt = state, 0
            for i in range(len(names)):
                nxt += int(single[(s >> i) & 1, rest % base]) * base**i
                rest //= base
            table[s, state] = nxt
    run = run_machine(df.withColumn("_code", code), keys, order, "_code", table, cell)
    flags = []
    for i, name in enumerate(names):
        own = F.pmod(F.floor(F.col("state_before") / base**i), F.lit(base))
        hit = (F.col("_code").bitwiseAND(1 << i) > 0) | (own > 0)
        flags.append(hit.alias(f"{name}_triggered"))
    out = run.select(*df.columns, *flags)
    allowed = F.lit(True)
    for name in names:
        allowed = allowed & ~F.col(f"{name}_triggered")
    return out.withColumn("allowed", allowed)
