"""Calls of parsers inside a worker: deadlines, bounded retries of what is transient, and typed failures."""

from __future__ import annotations

import csv
import signal
import threading
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.etree import ElementTree

#: Seconds that one attempt may take.
DEADLINE = 60.0
#: An archive member or stream larger than this, or packed tighter than this, fails its file, which is then flagged.
MOST_MEMBER, MOST_RATIO = 200_000_000, 1_000


class TransientError(Exception):
    """A failure that another attempt may not meet."""


class DeadlineError(Exception):
    """An attempt that took too long."""


#: What a broken file raises: another attempt would raise it again.
PERMANENT = (ValueError, LookupError, ArithmeticError, TypeError, AttributeError, OSError, EOFError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError, csv.Error, NotImplementedError, RecursionError, RuntimeError)


@contextmanager
def deadline(seconds: float) -> Iterator[None]:
    """Raises DeadlineError inside once so much time has passed. It needs the main thread of a process, where workers run UDFs; elsewhere there is none."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def ring(_number: int, _frame: object) -> None:
        raise DeadlineError

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def attempted(call: Callable[[], list[dict]], agent: str, file: str, most: int = 3, seconds: float = DEADLINE, wait: Callable[[float], None] = time.sleep) -> tuple[list[dict], str | None, bool | None, int, int]:
    """(rows, code, is_transient, attempts, elapsed_ms) of a call.

    Transient failures are tried again with growing waits, at most `most` times in all; permanent ones and a
    passed deadline are not. A file without rows is a good one. Kinds are told by the type of the error alone.
    """
    began = time.monotonic()
    code, transient, attempt = f"attachment_parse_failed:{file}", False, 0
    for attempt in range(1, most + 1):
        try:
            with deadline(seconds):
                rows = call()
            return rows, None, None, attempt, int((time.monotonic() - began) * 1000)
        except DeadlineError:
            code, transient = f"agent_timeout:{agent}", True
            break
        except (TransientError, MemoryError):
            transient = True
            if attempt < most:
                wait(0.1 * 2 ** (attempt - 1))
        except PERMANENT:
            transient = False
            break
    return [], code, transient, attempt, int((time.monotonic() - began) * 1000)
