"""Load over HTTP: ``python -m tidelake.loadgen URL ROWS [SERIES] [BATCH] [THREADS] [--verify]``.

Sends synthetic points in batches from several threads and prints the rate that it measured. With
``--verify`` every batch waits for its write, and the table's keys in both tiers are counted at the end.
"""

from __future__ import annotations

import json
import sys
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

BASE_NS = 1_700_000_000_000_000_000


def bodies(rows: int, series: int, batch: int, measurement: str = "load") -> Iterator[str]:
    """Line protocol of the points of sources.synthetic, a batch at a time."""
    for at in range(0, rows, batch):
        some = range(at, min(rows, at + batch))
        yield "\n".join(f"{measurement},host=h{i % series},region=r{i % series % 8} value={i % 1000 / 10},count={i % 100}i {BASE_NS + i * 1_000_000_000}" for i in some)


def post(url: str, body: str) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body.encode())) as r:
        return r.read()


def run(url: str, rows: int, series: int = 1000, batch: int = 5_000, threads: int = 4, verify: bool = False) -> dict[str, float]:
    """``rows, seconds, rows_per_second``, and with ``verify`` the keys that the server has (``found``)."""
    began = time.perf_counter()
    target = f"{url}/api/v1/write{'?sync=true' if verify else ''}"
    with ThreadPoolExecutor(threads) as pool:
        for _ in pool.map(lambda b: post(target, b), bodies(rows, series, batch)):
            pass
    seconds = time.perf_counter() - began
    out = {"rows": rows, "seconds": round(seconds, 3), "rows_per_second": round(rows / seconds, 1)}
    if verify:
        out["found"] = json.loads(post(f"{url}/api/v1/query?tier=all", json.dumps({"sql": "SELECT count(*) AS n FROM lp.load"})))[0]["n"]
    return out


if __name__ == "__main__":
    plain = [x for x in sys.argv[1:] if x != "--verify"]
    got = run(plain[0], *map(int, plain[1:]), verify="--verify" in sys.argv)
    print(json.dumps(got))
    sys.exit(int(got.get("found", got["rows"]) != got["rows"]))
