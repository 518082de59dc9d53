"""Small writes gathered into batches by size or age, for callers that don't wait for their points."""

from __future__ import annotations

import threading
import time
from collections import defaultdict

from ..engine import Engine, EngineError
from ..functions.time import PRECISION_NS

MAX_LINES = 5_000
MAX_SECONDS = 0.5
MAX_WAITING = 50_000


class Batcher:
    """Writes what it is given once ``lines`` wait or the oldest has waited ``seconds``, whichever comes first.

    ``put`` blocks while ``waiting`` lines are held, so callers are slowed down and nothing is dropped. A
    body is written whole; bodies of one precision share a batch, in the order in which they came. Bad
    lines count as failed, and if a write fails so do all its lines.
    """

    def __init__(self, engine: Engine, lines: int = MAX_LINES, seconds: float = MAX_SECONDS, waiting: int = MAX_WAITING):
        self.engine, self.lines, self.seconds, self.waiting = engine, lines, seconds, waiting
        self.errors: list[str] = []
        self._held: defaultdict[str, list[str]] = defaultdict(list)
        self._depth, self._since, self._stop = 0, 0.0, False
        self._change = threading.Condition()
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    @property
    def depth(self) -> int:
        """Lines that wait."""
        return self._depth

    def put(self, body: str | bytes, precision: str = "ns") -> int:
        """Queue a body; returns its number of lines."""
        if precision not in PRECISION_NS:
            raise EngineError(400, f"precision is one of {', '.join(PRECISION_NS)}")
        text = body.decode(errors="replace") if isinstance(body, bytes) else body
        n = sum(1 for x in text.splitlines() if x.strip())
        if not n:
            raise EngineError(400, "empty body")
        with self._change:
            self._change.wait_for(lambda: self._stop or not self._depth or self._depth + n <= self.waiting)
            if self._stop:
                raise EngineError(503, "closed")
            if not self._depth:
                self._since = time.monotonic()
            self._held[precision].append(text)
            self._depth += n
            self._change.notify_all()
        return n

    def _loop(self) -> None:
        while True:
            with self._change:
                self._change.wait_for(lambda: self._stop or self._depth)
                self._change.wait_for(lambda: self._stop or self._depth >= self.lines, self._since + self.seconds - time.monotonic())
                if self._stop and not self._depth:
                    return
                batch, self._held, self._depth = self._held, defaultdict(list), 0
                self._change.notify_all()
            for precision, bodies in batch.items():
                text = "\n".join(bodies)
                try:
                    self.engine.counters["failed"] += self.engine.write(text, precision).failed
                except Exception as e:  # the next batch may succeed
                    self.engine.counters["failed"] += len(text.splitlines())
                    self.errors.append(str(e))

    def close(self) -> None:
        """Write what waits, and end."""
        with self._change:
            self._stop = True
            self._change.notify_all()
        self._thread.join()
