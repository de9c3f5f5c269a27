"""The chat client against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from logloom.operators import mine, oracle


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            self._send({"data": [{"id": "m1"}]})

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            said = body["messages"][0]["content"]
            if said.startswith("Two log templates"):
                reply = "they differ\nAnswer: yes"
            elif "constant or variable" in said:
                reply = " constant " if "`bob`" in said else "variable"
            elif said.startswith("Log message"):
                reply = "a name"
            else:
                reply = said.replace("bob", "<*>") + "\n"
            self._send({"choices": [{"message": {"content": reply}}]})

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_connect_and_ask(server):
    url, seen = server
    chat = oracle.connect(url)
    assert chat.model == "m1" and seen[0]["temperature"] == 0 and seen[0]["n"] == 1 and seen[0]["max_tokens"] == 512
    both = oracle.Http(chat, chat)
    assert both.extract("user bob left") == "user <*> left"
    assert both.is_constant("user bob left", "bob") and not both.is_constant("user 7 left", "7")
    assert both.same("a", "b")
    miner = mine.Miner(both)
    miner.feed("user bob left", 1)
    assert [c.template for c in miner.clusters.values()] == ["user bob left"]


def test_no_server():
    assert oracle.connect(None) is None
    assert oracle.connect("http://127.0.0.1:9") is None


def test_failed_extraction_falls_back(server):
    url, _ = server
    broken = oracle.Chat("http://127.0.0.1:9", model="x", timeout=1)
    assert oracle.Http(broken, oracle.Chat(url)).extract("took 12 ms") == "took <*> ms"
