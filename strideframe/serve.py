"""A small server for the tile archive, static files and the runtime payload."""

from __future__ import annotations

import gzip
import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

BLOCK = 1 << 16


def byte_range(header: str | None, size: int) -> tuple[int, int] | None:
    """First and last byte of ``bytes=a-b`` or ``bytes=a-``; None for no header; raises ValueError for others and starts beyond the end."""
    if header is None:
        return None
    found = re.fullmatch(r"bytes=(\d+)-(\d*)", header.strip())
    if not found or int(found[1]) >= size:
        raise ValueError(header)
    last = min(int(found[2]), size - 1) if found[2] else size - 1
    if last < int(found[1]):
        raise ValueError(header)
    return int(found[1]), last


def make_server(state, archive: Path, static: Path, *, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """``state()`` gives the runtime payload; ValueError is answered by 400, missing things by 404."""
    archive, static = Path(archive), Path(static).resolve()
    for needed in (archive, static / "index.html"):
        if not needed.is_file():
            raise FileNotFoundError(needed)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def do_HEAD(self) -> None:
            if self.path.split("?")[0] == "/tiles/archive.pmtiles":
                self._archive(False)
            else:
                self._send(405, b"")

        def do_GET(self) -> None:
            path = self.path.split("?")[0]
            try:
                if path == "/tiles/archive.pmtiles":
                    self._archive(True)
                elif path == "/api/runtime":
                    self._json(200, state() | {"pmtiles_url": "/tiles/archive.pmtiles"})
                elif path == "/" or path.startswith("/static/"):
                    self._file(static / ("index.html" if path == "/" else path.removeprefix("/static/")))
                else:
                    self._json(404, {"error": "not found"})
            except (BrokenPipeError, ConnectionResetError):
                pass
            except ValueError as e:
                self._json(400, {"error": str(e)})
            except (RuntimeError, FileNotFoundError) as e:
                self._json(404, {"error": str(e)})
            except Exception as e:
                self._json(500, {"error": str(e)})

        def _send(self, status: int, body: bytes, **headers: str) -> None:
            self.send_response(status)
            for name, value in headers.items():
                self.send_header(name.replace("_", "-"), value)
            if "Content_Length" not in headers:
                self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _json(self, status: int, payload: dict) -> None:
            body = json.dumps(payload).encode()
            if "gzip" in self.headers.get("Accept-Encoding", ""):
                self._send(status, gzip.compress(body), Content_Type="application/json", Content_Encoding="gzip")
            else:
                self._send(status, body, Content_Type="application/json")

        def _file(self, path: Path) -> None:
            path = path.resolve()
            if not path.is_relative_to(static) or not path.is_file():
                raise FileNotFoundError(path.name)
            kinds = {".html": "text/html", ".js": "text/javascript", ".css": "text/css", ".json": "application/json"}
            self._send(200, path.read_bytes(), Content_Type=kinds.get(path.suffix, "application/octet-stream"))

        def _archive(self, body: bool) -> None:
            size = archive.stat().st_size
            try:
                span = byte_range(self.headers.get("Range"), size)
            except ValueError:
                self._send(416, b"", Content_Range=f"bytes */{size}")
                return
            first, last = span or (0, size - 1)
            headers = {"Cache_Control": "public, max-age=3600", "Accept_Ranges": "bytes", "Content_Length": str(last - first + 1), "Content_Type": "application/octet-stream"}
            self._send(206 if span else 200, b"", **headers, **({"Content_Range": f"bytes {first}-{last}/{size}"} if span else {}))
            if body:
                with archive.open("rb") as f:
                    f.seek(first)
                    left = last - first + 1
                    while left and (block := f.read(min(BLOCK, left))):
                        self.wfile.write(block)
                        left -= len(block)

    return ThreadingHTTPServer((host, port), Handler)
