"""Pipelines of batching steps, written as a chain.

    chain(train).shuffle("id", epoch=2, seed=5).split(64, keep=0.5).where("chunk is not null").batch("pos", "id", 32).table

A step is a function from a DataFrame to a DataFrame; users add theirs by name.  A chain is a plan like any other: nothing runs until its table is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.operators import batching

#: The steps known by name.
STEPS: dict[str, Callable[..., DataFrame]] = {}


def step(name: str, replace: bool = False) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Makes a function(DataFrame, ...) a method of every chain.  A name that is taken, by a step or by DataFrame itself, is refused; replace allows that of a step."""

    def enter(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if not name.isidentifier() or name.startswith("_") or hasattr(DataFrame, name) or name == "table" or name in STEPS and not replace:
            raise ValueError(f"{name!r} cannot name a step: it is taken or no public name")
        STEPS[name] = f
        return f

    return enter


class Chain:
    """A table with the steps as methods, each of which gives a chain; DataFrame's own methods work as well, and those that give a DataFrame continue the chain."""

    def __init__(self, table: DataFrame):
        self.table = table

    def __getattr__(self, name: str):
        if name.startswith("_") or name == "table":  # not there yet while a copy is made
            raise AttributeError(name)
        if name in STEPS:
            return lambda *args, **kw: Chain(self.table.transform(STEPS[name], *map(_plain, args), **{k: _plain(v) for k, v in kw.items()}))
        own = getattr(self.table, name)
        if not callable(own) or isinstance(own, type):
            return own

        def call(*args, **kw):
            out = own(*map(_plain, args), **{k: _plain(v) for k, v in kw.items()})
            return Chain(out) if isinstance(out, DataFrame) else out

        return call

    def __dir__(self) -> list[str]:
        return sorted({*super().__dir__(), *STEPS, *dir(self.table)})

    def __repr__(self) -> str:
        return f"Chain[{', '.join(f'{n}: {t}' for n, t in self.table.dtypes)}]"


def _plain(x):
    return x.table if isinstance(x, Chain) else x


def chain(table: DataFrame) -> Chain:
    return Chain(table)


@step("shuffle")
def _shuffle(df: DataFrame, key: str = "id", epoch: int = 0, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Adds ``pos``, as batching.shuffle does."""
    return batching.shuffle(df, key, epoch, seed, by)


@step("split")
def _split(df: DataFrame, size: int, keep: float = 0.0, pos: str = "pos") -> DataFrame:
    """Adds ``chunk``, null in a tail shorter than size * keep.  The rows are counted by a job of their own."""
    return df.withColumn("chunk", batching.split_chunk(F.col(pos), df.count(), size, keep))


@step("split_evenly")
def _split_evenly(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Adds ``chunk``, of chunks whose sizes differ as little as the even split allows."""
    return df.withColumn("chunk", batching.even_chunk(F.col(pos), df.count(), size))


@step("batch")
def _batch(df: DataFrame, pos: str = "pos", value: str = "id", n: int = 32, drop_last: bool = False) -> DataFrame:
    return batching.batch_rows(df, pos, value, n, drop_last)


@step("zip")
def _zip(df: DataFrame, other: DataFrame, on: str = "pos") -> DataFrame:
    return batching.zip_rows(df, other, on)


for _name, _f in {"unbatch": batching.unbatch, "flat_map": batching.flat_map, "repeats": batching.repeats}.items():
    step(_name)(_f)
