"""A thin HTTP front for the query tools: loopback only, on a port that the system chooses."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..operators.tools import Toolbox, envelope
from ..plans.graph import CodeGraph

MOST_BYTES = 1 << 20


class Server:
    """POST / with {"tool", "arguments", "session"} answers with the tool's envelope. view_of gives a session's graph,
    or None if it has no worktree."""

    def __init__(self, tools: Toolbox, view_of: Callable[[str | None], CodeGraph | None], host: str = "127.0.0.1", port: int = 0):
        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                try:
                    size = int(self.headers.get("Content-Length") or 0)
                    if not 0 <= size <= MOST_BYTES:
                        raise ValueError("too long")
                    asked = json.loads(self.rfile.read(size) or b"{}")
                    name, arguments, session = asked["tool"], asked.get("arguments") or {}, asked.get("session")
                except (ValueError, KeyError, AttributeError, TypeError) as e:
                    return self._answer(400, {"error": "bad_request", "message": str(e)})
                return self._answer(200, tools.call(name, view_of(session), arguments))

            def _answer(self, status: int, result: dict) -> None:
                body = json.dumps(envelope(result)).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self._http = ThreadingHTTPServer((host, port), Handler)
        self._thread = threading.Thread(target=self._http.serve_forever, daemon=True)

    @property
    def address(self) -> str:
        host, port = self._http.server_address[:2]
        return f"http://{host}:{port}"

    def start(self) -> Server:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._http.shutdown()
        self._http.server_close()
