import threading
import time

import pytest

from slateql.errors import DeadlockError
from slateql.locks import EXCLUSIVE, SHARED, LockManager


def later(f):
    done = threading.Event()
    t = threading.Thread(target=lambda: (f(), done.set()), daemon=True)
    t.start()
    time.sleep(0.05)
    return done


def test_shared_is_shared_and_exclusive_waits():
    m = LockManager()
    m.lock(1, "r", SHARED)
    m.lock(2, "r", SHARED)
    waiting = later(lambda: m.lock(3, "r", EXCLUSIVE))
    assert not waiting.is_set() and m.held("r") == {1: SHARED, 2: SHARED}
    behind = later(lambda: m.lock(4, "r", SHARED))
    assert not behind.is_set()  # a new reader waits behind a waiting writer
    m.unlock_all(1)
    m.unlock_all(2)
    assert waiting.wait(1) and m.held("r") == {3: EXCLUSIVE}
    m.unlock_all(3)
    assert behind.wait(1)


def test_reentrant_and_upgrade():
    m = LockManager()
    m.lock(1, "r", SHARED)
    m.lock(1, "r", SHARED)
    m.lock(1, "r", EXCLUSIVE)
    m.lock(1, "r", SHARED)
    assert m.held("r") == {1: EXCLUSIVE}


def test_leading_readers_are_granted_together():
    m = LockManager()
    m.lock(1, "r", EXCLUSIVE)
    first, second = later(lambda: m.lock(2, "r", SHARED)), later(lambda: m.lock(3, "r", SHARED))
    m.unlock_all(1)
    assert first.wait(1) and second.wait(1)


def test_deadlock_hits_the_requester():
    m = LockManager()
    m.lock(1, "a", EXCLUSIVE)
    m.lock(2, "b", EXCLUSIVE)
    waiting = later(lambda: m.lock(1, "b", EXCLUSIVE))
    with pytest.raises(DeadlockError, match="deadlock detected, rejecting wait request for txn: 2"):
        m.lock(2, "a", EXCLUSIVE)
    m.unlock_all(2)
    assert waiting.wait(1)


def test_three_way_deadlock():
    m = LockManager()
    for t, r in ((1, "a"), (2, "b"), (3, "c")):
        m.lock(t, r, EXCLUSIVE)
    later(lambda: m.lock(1, "b", EXCLUSIVE))
    later(lambda: m.lock(2, "c", EXCLUSIVE))
    with pytest.raises(DeadlockError):
        m.lock(3, "a", SHARED)
    m.unlock_all(3)


def test_unknown_transactions_are_ignored():
    LockManager().unlock_all(99)
