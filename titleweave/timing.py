"""How long a step took."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager


def spelt(seconds: float) -> str:
    """Seconds as text, in hours, minutes and seconds as far as there are any."""
    whole = int(seconds)
    parts = [(whole // 3600, "h"), (whole // 60 % 60, "min")]
    return " ".join([f"{n} {unit}" for n, unit in parts if n] + [f"{seconds % 60:.1f} s"])


@contextmanager
def timed(step: str) -> Iterator[None]:
    """Log how long the block takes, also where it fails."""
    began = time.monotonic()
    try:
        yield
    finally:
        logging.getLogger("titleweave").info("%s: %s", step, spelt(time.monotonic() - began))
