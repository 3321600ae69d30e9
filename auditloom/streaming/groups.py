"""Many keys of a stream in one state: a call of the worker per group and batch, not one per key."""

from __future__ import annotations

import pickle

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = "key_group"
#: Groups that the keys of a stream are dealt to. A checkpoint holds its state by them, so they stay as they are.
GROUPS = 512
#: The group of rows without a key.
NO_KEY = -1


def group_of(key: str) -> Column:
    """The group of a key. Rows without one have their own, so that no value of a group is null in the column."""
    return F.when(F.col(key).isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int"))


class GroupState:
    """What a group keeps between batches: one value, read and written whole, and one timer."""

    def __init__(self, handle, name: str):
        self.handle = handle
        self.state = handle.getValueState(name, "held binary, timer bigint")
        self.timer = None

    def load(self):
        row = self.state.get()
        held, self.timer = (None, None) if row is None else row
        return None if held is None else pickle.loads(bytes(held))

    def save(self, held, timer: int | None) -> None:
        """Keep `held` and be called at `timer` (milliseconds); with nothing to hold the state goes."""
        if timer != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        if held is None:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(held, 5), timer))

    def expired(self) -> None:
        """The timer has gone off, so there is none to delete."""
        self.timer = None
