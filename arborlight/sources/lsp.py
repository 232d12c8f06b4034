"""Diagnostics of a language server over stdio: the last report of each file counts, and silence ends the session."""

from __future__ import annotations

import json
import os
import queue
import subprocess
import threading
import time
from urllib.parse import quote, unquote

SEVERITY = {1: "error", 2: "warning", 3: "info", 4: "info"}
SETTLE = 1.2
MOST_FILES = 100


def to_uri(path: str) -> str:
    """An absolute path as a file URI, percent-coded."""
    return "file://" + quote(path.replace(os.sep, "/"), safe="/-._~")


def from_uri(uri: str) -> str | None:
    """The path of a file URI; None for other schemes."""
    return unquote(uri[7:]) if uri.startswith("file:///") else None


def default_files(paths: list[str], endings: tuple[str, ...]) -> list[str]:
    """The first files with one of the endings, in order."""
    return sorted(p for p in paths if p.lower().endswith(endings))[:MOST_FILES]


def _frames(stream, out: queue.Queue) -> None:
    while True:
        length = None
        while (line := stream.readline().strip()) or length is None:
            if not line:
                if stream.closed or not stream.peek(1):
                    out.put(None)
                    return
                continue
            name, _, value = line.partition(b":")
            if name.lower() == b"content-length":
                length = int(value)
        body = stream.read(length)
        if len(body) < length:
            out.put(None)
            return
        out.put(json.loads(body))


def collect(command: list[str], root: str, files: dict[str, str], language: str = "plaintext", timeout: float = 60.0) -> list[tuple]:
    """(file, line, col, rule, kind, severity, message, source) of files {path: text}, by a server that is started for it.

    Files are opened, and diagnostics are taken until nothing has come for SETTLE seconds and no work is announced, or the time is
    over; a server that ends before it has answered raises RuntimeError.
    """
    root = os.path.realpath(root)
    server = subprocess.Popen(command, cwd=root, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    inbox: queue.Queue = queue.Queue()
    threading.Thread(target=_frames, args=(server.stdout, inbox), daemon=True).start()

    def send(**message) -> None:
        body = json.dumps({"jsonrpc": "2.0", **message}).encode()
        server.stdin.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
        server.stdin.flush()

    found: dict[str, list] = {}
    name, working, ready, end = os.path.basename(command[0]), set(), False, time.monotonic() + timeout
    try:
        send(id=1, method="initialize", params={"processId": os.getpid(), "rootUri": to_uri(root), "capabilities": {"window": {"workDoneProgress": True}}})
        last = time.monotonic()
        while time.monotonic() < end:
            try:
                m = inbox.get(timeout=max(0.01, min(end - time.monotonic(), SETTLE)))
            except queue.Empty:
                if ready and not working and time.monotonic() - last >= SETTLE:
                    break
                continue
            if m is None:
                if not ready:
                    raise RuntimeError(f"{name} ended before it answered")
                break
            if m.get("id") == 1 and "method" not in m:
                ready = True
                send(method="initialized", params={})
                for path, text in files.items():
                    send(method="textDocument/didOpen", params={"textDocument": {"uri": to_uri(os.path.join(root, path)), "languageId": language, "version": 1, "text": text}})
            elif m.get("method") == "textDocument/publishDiagnostics":
                found[m["params"]["uri"]] = m["params"]["diagnostics"]
            elif m.get("method") == "$/progress":
                token, kind = str(m["params"]["token"]), m["params"]["value"].get("kind")
                (working.add if kind == "begin" else working.discard if kind == "end" else lambda _: None)(token)
            elif m.get("method") == "experimental/serverStatus":
                (working.discard if m["params"].get("quiescent") else working.add)("status")
            elif "id" in m and "method" in m:
                send(id=m["id"], result=[None] * len(m.get("params", {}).get("items", [])) if m["method"] == "workspace/configuration" else None)
            last = time.monotonic()
        if ready and server.poll() is None:
            send(id=2, method="shutdown", params=None)
            send(method="exit", params=None)
    except BrokenPipeError as e:
        raise RuntimeError(f"{name} ended before it answered") from e
    finally:
        server.stdin.close() if server.poll() is not None else None
        try:
            server.wait(timeout=2)
        except subprocess.TimeoutExpired:
            server.kill()
            server.wait()
    rows = []
    for uri, diagnostics in sorted(found.items()):
        path = from_uri(uri)
        inside = path and os.path.commonpath([os.path.realpath(path), root]) == root
        for d in diagnostics if inside else []:
            at = d["range"]["start"]
            rows.append((os.path.relpath(os.path.realpath(path), root).replace(os.sep, "/"), at["line"] + 1, at["character"] + 1, str(d.get("code") or d.get("source") or name), "lsp", SEVERITY.get(d.get("severity", 1), "warning"), d["message"], f"lsp:{name}"))
    return rows
