"""Repeating a driver call that may fail for a while; Spark itself repeats tasks."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable


def retry(max_attempts: int = 3, base_delay: float = 1.0, backoff: float = 2.0, exceptions: tuple[type[BaseException], ...] = (Exception,)) -> Callable:
    """A decorator: the call is tried up to max_attempts times, each wait `backoff` times the one before; the last failure is raised."""
    if max_attempts < 1:
        raise ValueError("at least one attempt")

    def around(call: Callable) -> Callable:
        @functools.wraps(call)
        def tried(*args, **kwargs):
            for n in range(max_attempts):
                try:
                    return call(*args, **kwargs)
                except exceptions:
                    if n + 1 == max_attempts:
                        raise
                    time.sleep(base_delay * backoff**n)

        return tried

    return around
