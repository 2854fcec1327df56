"""A model behind HTTP: a stub server on the loopback interface, and the ledger of its replies."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from veilspark.operators import detect

GOOD = '{"entities": [{"original": "Ann", "category": "name"}]}'


class Stub(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = body["messages"][1]["content"].split("---")[1].strip()
        seen = self.server.seen
        with seen["lock"]:
            seen["asked"][text] += 1
            seen["now"] += 1
            seen["most"] = max(seen["most"], seen["now"])
        threading.Event().wait(0.02)
        with seen["lock"]:
            seen["now"] -= 1
        code, answer = 200, {"choices": [{"message": {"content": GOOD}}]}
        if "refused" in text and "response_format" in body:
            code = 400
        elif "refused" in text:
            assert body["messages"][0]["content"].endswith(detect.JSON_ONLY)
        if "broken" in text or "later" in text and not seen["up"]:
            code = 500
        for word, odd in (("empty", {"choices": [{"message": {"content": ""}}]}), ("nothing", {"choices": []}), ("list", [1, 2]), ("word", "x"), ("null", {"choices": [{"message": None}]}), ("number", {"choices": [{"message": {"content": 5}}]})):
            if word in text:
                answer = odd
        self.send_response(code)
        self.end_headers()
        self.wfile.write(b"{not json" if "garbled" in text else json.dumps(answer).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    s.seen = {"asked": Counter(), "lock": threading.Lock(), "now": 0, "most": 0, "up": False}
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "tr" if i % 5 == 4 else "en") for i, t in enumerate(rows)], "id long, text string, lang string")


def test_replies_and_errors(spark, server):
    url = f"http://127.0.0.1:{server.server_port}"
    rows = ["Ann fine", "refused", "broken", "empty", "nothing", "list", "word", "null", "number", "garbled", None]
    got = {r.id: r for r in detect.HttpDetector(url).detect(texts(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        if t in ("Ann fine", "refused", None):
            assert got[i].error is None and [e.original for e in got[i].entities] == ["Ann"]
        else:
            assert got[i].error and got[i].entities is None, t
    assert "500" in got[2].error and got[3].error == "an empty reply" == got[5].error
    assert server.seen["asked"]["refused"] == 2 and server.seen["asked"]["broken"] == 1
    down = detect.HttpDetector("http://127.0.0.1:9", timeout=2).detect(texts(spark, ["x"])).first()
    assert "refused" in down.error.lower() and down.entities is None


def test_a_rerun_asks_for_what_is_missing(spark, server, tmp_path):
    d = detect.HttpDetector(f"http://127.0.0.1:{server.server_port}", at_once=2, ledger=str(tmp_path / "ledger"), rounds=3)
    rows = [f"Ann {k}" for k in range(12)] + ["same"] * 9 + ["later"]
    first = d.replies(texts(spark, rows).coalesce(4)).collect()
    asked = server.seen["asked"]
    # the prompt's language is part of what is asked
    assert len(first) == len(rows) and sum(v for k, v in asked.items() if k == "same") == 2 and all(asked[f"Ann {k}"] == 1 for k in range(12))
    assert [r.request_error is not None for r in first if r.text == "later"] == [True] and server.seen["most"] <= 2
    before = Counter(asked)
    server.seen["up"] = True
    again = {(r.id, r.text): r for r in d.replies(texts(spark, [*rows, "new"])).collect()}
    assert asked - before == Counter({"later": 1, "new": 1}) and all(r.raw_response == GOOD and r.request_error is None for r in again.values())
    assert d.replies(texts(spark, rows).limit(0)).collect() == [] and sum(asked.values()) == sum(before.values()) + 2
