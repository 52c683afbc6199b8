"""What all operators on volumes share: the names of their columns, and values of a whole stack beside its voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.runtime import keep

STACK = "scan_id"
AXES = ("plane", "y", "x")
#: Stacks up to which a row of each is broadcast; they are counted first, beyond that the join shuffles.
FEW_STACKS = 100_000


def stack(df: DataFrame) -> list[str]:
    """The column that names the stack, if there is one."""
    return [STACK] if STACK in df.columns else []


def only(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` whose key is among ``wanted``, which is written and counted first: broadcast if it is small."""
    wanted = keep(wanted.select(*on).distinct())
    return df.join(F.broadcast(wanted), on, "left_semi") if wanted.count() <= FEW_STACKS else df.hint("merge").join(wanted, on, "left_semi")


def with_each(df: DataFrame, of_stack: DataFrame, written: bool = False) -> DataFrame:
    """Adds to every row what ``of_stack`` has, a row a stack; it is written first, unless ``written`` says that it is, and counted."""
    keys = stack(df)
    if not keys:
        return df.join(F.broadcast(of_stack))  # one row
    of_stack = of_stack if written else keep(of_stack)
    return df.join(F.broadcast(of_stack), keys) if of_stack.count() <= FEW_STACKS else df.hint("merge").join(of_stack, keys)
