"""Calls of a model service from inside a task: several at once, each with a time limit, behind a breaker."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, wait
from dataclasses import dataclass


@dataclass(frozen=True)
class BreakerSettings:
    #: The last so many calls count.
    calls: int = 10
    #: The breaker opens when this share of them has failed.
    failed_share: float = 0.5
    #: For this long no call is made; then one is tried.
    open_seconds: float = 30.0


class Breaker:
    """Tells whether a call may be made, from how the last ones ended."""

    def __init__(self, settings: BreakerSettings, clock: Callable[[], float] = time.monotonic):
        self.settings, self.clock = settings, clock
        self.last: deque[bool] = deque(maxlen=settings.calls)
        self.opened_at: float | None = None
        self.trying = False

    def allows(self) -> bool:
        if self.opened_at is None:
            return True
        if self.trying or self.clock() - self.opened_at < self.settings.open_seconds:
            return False
        self.trying = True
        return True

    def record(self, ok: bool) -> None:
        if self.opened_at is not None:
            if not self.trying:
                return  # a call from before it opened
            self.trying = False
            self.opened_at = None if ok else self.clock()
            self.last.clear()
            return
        self.last.append(ok)
        failed = self.last.count(False)
        if len(self.last) == self.settings.calls and failed >= self.settings.failed_share * len(self.last):
            self.opened_at = self.clock()
            self.last.clear()


def _begin(job: Callable) -> Future:
    """A call in a thread that does not keep the process alive."""
    future: Future = Future()

    def work() -> None:
        try:
            future.set_result(job())
        except BaseException as error:  # noqa: BLE001 - whoever reads the result sees it
            future.set_exception(error)

    threading.Thread(target=work, daemon=True).start()
    return future


def call_all(
    jobs: Iterable[Callable], width: int = 1, timeout_seconds: float | None = None, breaker: Breaker | None = None
) -> list:
    """Results in the order of the jobs; None for a call that raised, took too long, or was not made.

    At most `width` calls are waited for at a time. The time limit of a call
    begins with the call. One that exceeds it is left to itself and its place
    given on; a breaker bounds how many such calls a failing service collects.
    """
    waiting = deque(enumerate(jobs))
    found: list = [None] * len(waiting)
    running: dict[Future, tuple[int, float | None]] = {}
    while waiting or running:
        while waiting and len(running) < width:
            n, job = waiting.popleft()
            if breaker is None or breaker.allows():
                running[_begin(job)] = n, None if timeout_seconds is None else time.monotonic() + timeout_seconds
        if not running:
            continue
        limits = [limit for _, limit in running.values() if limit is not None]
        wait(running, max(0.0, min(limits) - time.monotonic()) if limits else None, FIRST_COMPLETED)
        now = time.monotonic()
        for future, (n, limit) in list(running.items()):
            ended = future.done()
            if not ended and (limit is None or now < limit):
                continue
            del running[future]
            ok = ended and future.exception() is None
            if ok:
                found[n] = future.result()
            if breaker is not None:
                breaker.record(ok)
    return found
