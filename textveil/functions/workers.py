"""Objects that a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

#: Objects a worker keeps; the one used longest ago goes first.
KEPT = 8


def new_identity() -> str:
    """A name that no other call has, so that no call gets another one's object."""
    return uuid.uuid4().hex


def once_per_worker(identity: str, factory: Callable):
    """Build the object of ``identity`` on first use in this worker process, then reuse it."""
    registry = sys.modules.setdefault("textveil_worker", types.ModuleType("textveil_worker"))
    kept = registry.__dict__.setdefault("kept", {})
    found = kept.pop(identity) if identity in kept else factory()
    kept[identity] = found
    while len(kept) > KEPT:
        kept.pop(next(iter(kept)))
    return found
