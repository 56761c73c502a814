"""One writer at a time for a store: a lock file beside it."""

from __future__ import annotations

import fcntl
import json
import os
import socket
import time
from contextlib import contextmanager
from datetime import datetime, timezone

STALE_AFTER = 6 * 3600.0


class LockHeld(RuntimeError):
    def __init__(self, holder: dict, path: str):
        super().__init__(f"the store is locked by process {holder.get('pid')} on {holder.get('host')} since {holder.get('acquired')} ({path})")
        self.holder = holder


def _alive(pid: int) -> bool:
    if pid <= 0:
        return False
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


def is_stale(holder: dict | None, stale_after: float = STALE_AFTER) -> bool:
    """Whether a lock may be taken over: unreadable, older than stale_after, or of a dead process of this host."""
    if not isinstance(holder, dict) or not isinstance(holder.get("pid"), int):
        return True
    try:
        age = time.time() - datetime.fromisoformat(holder["acquired"]).timestamp()
    except (KeyError, TypeError, ValueError):
        return True
    here = holder.get("host") in (None, socket.gethostname())
    return age > stale_after or (here and not _alive(holder["pid"]))


class WriterLock:
    """A context manager; entering raises LockHeld at once if a live holder has the lock.

    The file is looked at and replaced under an advisory lock of its own, so two processes can't both take over a stale
    one, and nobody sees a lock file that is still being written.
    """

    def __init__(self, store_path: str, stale_after: float = STALE_AFTER):
        self.path = os.path.abspath(store_path).rstrip("/") + ".lock"
        self.stale_after = stale_after

    @contextmanager
    def _guard(self):
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.path + ".guard", "w") as g:
            fcntl.flock(g, fcntl.LOCK_EX)
            yield

    def holder(self) -> dict | None:
        try:
            with open(self.path, encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return None

    def live_holder(self) -> dict | None:
        holder = self.holder()
        return None if is_stale(holder, self.stale_after) else holder

    def acquire(self) -> WriterLock:
        with self._guard():
            if os.path.exists(self.path) and (holder := self.live_holder()):
                raise LockHeld(holder, self.path)
            mine = {"pid": os.getpid(), "acquired": datetime.now(timezone.utc).isoformat(), "host": socket.gethostname()}
            with open(self.path + ".new", "w", encoding="utf-8") as f:
                json.dump(mine, f)
            os.replace(self.path + ".new", self.path)
        return self

    def release(self) -> None:
        """Remove the lock, if it is still this process's."""
        with self._guard():
            holder = self.holder()
            if holder and holder.get("pid") == os.getpid() and holder.get("host") == socket.gethostname():
                os.unlink(self.path)

    def __enter__(self) -> WriterLock:
        return self.acquire()

    def __exit__(self, *_: object) -> None:
        self.release()
