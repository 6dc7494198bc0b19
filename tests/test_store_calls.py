from types import SimpleNamespace

import pandas as pd
import pytest

from tarnflow.streaming import store

MINUTE = 60_000_000


def test_an_eviction_reads_the_value_alone():
    """Before, all of a session's data was read for its number."""
    at = 10 * MINUTE
    gone = []
    state = lambda name, **calls: SimpleNamespace(clear=lambda: gone.append(name), **calls)
    whole = lambda: pytest.fail("data is read")
    held = store.Sessions(1000)
    held.head = state("head", exists=lambda: True, get=lambda: (0, at, "G", 2, 1, 3))
    held.turns, held.data = state("turns"), state("data", iterator=whole, keys=whole)
    due = SimpleNamespace(getExpiryTimeInMs=lambda: at // 1000 + 1001)
    (got,) = held.handleExpiredTimer(("s",), None, due)
    assert got.to_dict("records") == [{"session_id": "s", "created_at": pd.Timestamp(0), "last_updated": pd.Timestamp(at, unit="us"), "session_type": "G", "n_turns": 2, "n_data": 3, "status": "evicted", "version": 2}]
    assert sorted(gone) == ["data", "head", "turns"]


def test_keys_of_earlier_batches_are_looked_up_once():
    asked = []
    held = store.Sessions(1000)
    held.data = SimpleNamespace(containsKey=lambda k: asked.append(k) or k == ("old",))
    session = store._Session(0, 0, "G", 0, 1, 1, stored=True)
    for k in ("old", "new", "old", "new"):
        held._put(session, k, "v")
    assert session.n_data == 2 and asked == [("old",), ("new",)] and set(session.changed) == {"old", "new"}
