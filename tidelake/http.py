"""The engine over HTTP, with the standard library's server: ``python -m tidelake.http ROOT [PORT]``."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.errors import PySparkException

from .engine import Engine, EngineError
from .streaming.batcher import Batcher


def handler(engine: Engine, batcher: Batcher | None = None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _body(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def _json(self) -> dict:
            try:
                got = json.loads(self._body() or b"{}")
            except ValueError as e:
                raise EngineError(400, f"no JSON: {e}") from None
            if not isinstance(got, dict):
                raise EngineError(400, "an object is expected")
            return got

        def _answer(self, status: int, text: str = "") -> None:
            data = text.encode()
            self.send_response(status)
            if status != 204:
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if status != 204:
                self.wfile.write(data)

        def _stream(self, pieces: Iterable[str]) -> None:
            """An answer of any length; it ends with the connection."""
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Connection", "close")
            self.end_headers()
            for p in pieces:
                self.wfile.write(p.encode())
            self.close_connection = True

        def _serve(self) -> None:
            url = urlsplit(self.path)
            q = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            window = {"start": q.get("start"), "end": q.get("end")}
            try:
                match self.command, url.path:
                    case "GET", "/health":
                        self._answer(200, json.dumps(engine.health() | ({"queue_depth": batcher.depth} if batcher else {})))
                    case "POST", "/api/v1/write":
                        sync = q.get("sync", "").lower() in {"1", "true", "yes"}
                        if batcher and not sync:
                            batcher.put(self._body(), q.get("precision", "ns"))
                            return self._answer(204)
                        done = engine.write(self._body(), q.get("precision", "ns"))
                        engine.counters["failed"] += done.failed
                        if done.status == 204 and not sync:
                            self._answer(204)
                        else:
                            self._answer(200, json.dumps({"accepted": done.accepted, "errors": done.errors}))
                    case "POST", "/api/v1/query":
                        b = self._json()
                        self._stream(engine.query_pieces(b.get("sql", ""), b.get("params") or (), q.get("tier", "hot"), **window))
                    case "GET", "/api/v1/query":
                        self._stream(engine.query_pieces(q.get("sql", q.get("q", "")), (), q.get("tier", "hot"), **window))
                    case "POST", "/api/v1/delete":
                        b = self._json()
                        n = engine.delete(b["measurement"], b.get("tags"), b.get("start"), b.get("end"))
                        self._answer(200, json.dumps({"measurement": b["measurement"], "deleted": n}))
                    case "POST", "/api/v1/tier/run":
                        self._answer(200, json.dumps(engine.tier_run(q.get("older_than"), q.get("measurement")), default=str))
                    case "GET", "/api/v1/tier/status":
                        self._answer(200, json.dumps(engine.tier_status(), default=str))
                    case _:
                        self._answer(404, json.dumps({"error": "no such path"}))
            except EngineError as e:
                self._answer(e.status, json.dumps({"error": str(e)}))
            except KeyError as e:
                self._answer(400, json.dumps({"error": f"missing {e}"}))
            except (PySparkException, ValueError) as e:
                self._answer(400, json.dumps({"error": str(e)}))

        do_GET = do_POST = lambda self: self._serve()

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(engine: Engine, port: int = 8000, host: str = "127.0.0.1", batcher: Batcher | None = None) -> ThreadingHTTPServer:
    """With a batcher, writes without ``sync`` are answered at once and written by size or age."""
    return ThreadingHTTPServer((host, port), handler(engine, batcher))


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.getOrCreate(), sys.argv[1])
    serve(engine, int(sys.argv[2]) if len(sys.argv) > 2 else 8000, batcher=Batcher(engine)).serve_forever()
