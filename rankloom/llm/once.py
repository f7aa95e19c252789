"""What a worker builds once and keeps for the batches and tasks that follow."""

from __future__ import annotations

from collections.abc import Callable

_BUILT: dict[str, object] = {}
#: Things kept at the same time.
KEPT = 4


def once(token: str, build: Callable[[], object]):
    """What build gives, made once in a worker for the same token; the oldest is let go beyond KEPT."""
    if token not in _BUILT:
        while len(_BUILT) >= KEPT:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[token] = build()
    return _BUILT[token]
