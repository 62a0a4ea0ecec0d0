"""Shared and exclusive locks with queues, upgrades and deadlock detection (L1-L4).

Requests wait in order; a shared request waits behind a waiting exclusive one.
A holder may ask again for what it has; one that asks for more gives up its
shared hold and queues. A request that would close a cycle of waiting
transactions is refused, so the requester is the victim.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Hashable
from dataclasses import dataclass, field

from slateql.errors import DeadlockError

SHARED, EXCLUSIVE = 1, 2


@dataclass
class _Lock:
    holders: dict[int, int] = field(default_factory=dict)
    queue: deque[tuple[int, int]] = field(default_factory=deque)

    def admits(self, mode: int) -> bool:
        return not self.holders or (mode == SHARED and set(self.holders.values()) == {SHARED})

    def grant(self) -> None:
        """Moves what fits from the head of the queue to the holders."""
        while self.queue and self.admits(self.queue[0][1]):
            txn, mode = self.queue.popleft()
            self.holders[txn] = mode


class LockManager:
    def __init__(self):
        self._locks: dict[Hashable, _Lock] = {}
        self._changed = threading.Condition()

    def _waits_for(self, txn: int) -> set[int]:
        """Holders, and exclusive requests ahead, of every lock that a transaction waits for."""
        out: set[int] = set()
        for lock in self._locks.values():
            ahead: set[int] = set(lock.holders)
            for waiter, _ in lock.queue:
                if waiter == txn:
                    out |= ahead - {txn}
                ahead.add(waiter)
        return out

    def _closes_cycle(self, start: int) -> bool:
        seen, open_ = set(), list(self._waits_for(start))
        while open_:
            txn = open_.pop()
            if txn == start:
                return True
            if txn not in seen:
                seen.add(txn)
                open_ += self._waits_for(txn)
        return False

    def lock(self, txn: int, row: Hashable, mode: int, timeout: float | None = None) -> None:
        with self._changed:
            lock = self._locks.setdefault(row, _Lock())
            if lock.holders.get(txn, 0) >= mode:
                return
            lock.holders.pop(txn, None)
            lock.queue.append((txn, mode))
            lock.grant()
            if txn not in lock.holders and self._closes_cycle(txn):
                lock.queue.remove((txn, mode))
                lock.grant()
                self._changed.notify_all()
                raise DeadlockError(f"lock row {row}: deadlock detected, rejecting wait request for txn: {txn}")
            self._changed.notify_all()
            if not self._changed.wait_for(lambda: lock.holders.get(txn, 0) >= mode, timeout):
                lock.queue.remove((txn, mode))
                raise DeadlockError(f"lock row {row}: timed out for txn: {txn}")

    def unlock_all(self, txn: int) -> None:
        with self._changed:
            for row in list(self._locks):
                lock = self._locks[row]
                lock.holders.pop(txn, None)
                lock.queue = deque(x for x in lock.queue if x[0] != txn)
                lock.grant()
                if not lock.holders and not lock.queue:
                    del self._locks[row]
            self._changed.notify_all()

    def held(self, row: Hashable) -> dict[int, int]:
        with self._changed:
            return dict(self._locks[row].holders) if row in self._locks else {}
