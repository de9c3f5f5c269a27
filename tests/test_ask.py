"""Questions from executors to a local server, which counts them."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from logloom.operators import ask, oracle


@pytest.fixture
def server():
    """Counts requests by prompt; fails the first one of prompts with `twice`, and all of those with `never`."""
    seen, lock, now = Counter(), threading.Lock(), [0, 0]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][0]["content"]
            with lock:
                seen[said] += 1
                now[0] += 1
                now[1] = max(now)
                failed = "never" in said or ("twice" in said and seen[said] == 1)
            threading.Event().wait(0.02)
            with lock:
                now[0] -= 1
            reply = "Answer: yes" if said.startswith("Two log") else "constant" if "constant or variable" in said and "`bob`" in said else f"got {said[:20]}"
            data = json.dumps({"choices": [{"message": {"content": reply}}]}).encode()
            self.send_response(500 if failed else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield oracle.Chat(f"http://127.0.0.1:{s.server_port}", model="m"), seen, now
    s.shutdown()


def test_each_prompt_is_asked_once(spark, server, tmp_path):
    chat, seen, now = server
    path = str(tmp_path / "memo")
    first = spark.createDataFrame([(f"p{k % 40}",) for k in range(200)] + [("twice",), ("never",), (None,)], "prompt string").repartition(5)
    got = {r["prompt"]: (r["reply"], r["calls"]) for r in ask.ask(first, chat, path, tasks=3, at_once=2, wait=0.01, round_rows=15).collect()}
    assert len(got) == 42 and got["p7"] == ("got p7", 1) and got["twice"] == ("got twice", 2) and got["never"] == (None, 3)
    assert seen == Counter({f"p{k}": 1 for k in range(40)}) + Counter({"twice": 2, "never": 3}) and now[1] <= 6
    more = spark.createDataFrame([(f"p{k}",) for k in range(30, 50)] + [("never",)], "prompt string")
    got = ask.ask(more, chat, path, wait=0.01)
    assert got.count() == 21 and max(n for p, n in seen.items() if p.startswith("p")) == 1 and seen["never"] == 6
    assert ask.memo(spark, path).agg(F.sum("calls")).first()[0] == seen.total()


def test_templates_and_verdicts(spark, server, tmp_path):
    chat, seen, _ = server
    lines = spark.createDataFrame([("user 7 left",), ("user 7 left",), ("never 12",)], "content string")
    got = {r["content"]: r["template"] for r in ask.templates(lines, chat, str(tmp_path / "a"), wait=0.01).collect()}
    assert got == {"user 7 left": "got user 7 left", "never 12": "never <*>"}
    pairs = spark.createDataFrame([("x <*>", "x 1"), ("never", "y"), (None, "y")], "a string, b string")
    assert [(r["a"], r["same"]) for r in ask.same_event(pairs, chat, str(tmp_path / "b"), wait=0.01).orderBy("a").collect()] == [(None, None), ("never", None), ("x <*>", True)]
    both = oracle.Http(chat, chat)
    tokens = spark.createDataFrame([("user bob left", "bob"), ("user 7 left", "7")], "content string, token string")
    got = {r["token"]: r["constant"] for r in ask.constant_tokens(tokens, chat, str(tmp_path / "c"), wait=0.01).collect()}
    before = seen.total()
    assert got == {"bob": both.is_constant("user bob left", "bob"), "7": both.is_constant("user 7 left", "7")} == {"bob": True, "7": False}
    assert before < seen.total() and all(n > 1 for p, n in seen.items() if p.startswith("Log message"))  # the same prompts


def test_nothing_to_ask(spark, tmp_path):
    none = spark.createDataFrame([], "prompt string")
    assert ask.ask(none, ask.Offline(), str(tmp_path / "m")).count() == 0
