"""Models inside Python workers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

_LOADED: dict[str, Any] = {}


def once_per_worker(load: Callable[[], Any]) -> Callable[[], Any]:
    """``load`` so that a Python worker calls it once and keeps the result for its later tasks."""
    key = uuid.uuid4().hex

    def get() -> Any:
        from hitgauge.operators import models

        if key not in models._LOADED:
            models._LOADED[key] = load()
        return models._LOADED[key]

    return get
