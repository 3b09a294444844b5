"""Another try for what may pass."""

from __future__ import annotations

import time

# Parts of messages that tell a passing error.
TRANSIENT = ("timeout", "timed out", "connect", "connection", "500", "502", "503", "504", "reset", "broken pipe")


def is_transient(error: BaseException) -> bool:
    return any(x in f"{type(error).__name__} {error}".lower() for x in TRANSIENT)


def retried(operation, retries: int = 3, backoff: float = 1.0, sleep=time.sleep):
    """``operation()``, again after a transient error, ``retries`` times at most; the wait before each further try is twice the one before.  Other errors are raised at once."""
    for attempt in range(retries + 1):
        try:
            return operation()
        except Exception as e:
            if attempt == retries or not is_transient(e):
                raise
            sleep(backoff * 2**attempt)
