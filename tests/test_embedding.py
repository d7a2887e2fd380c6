"""The embedding connector against services on this machine: shapes of requests and answers, order, retries, texts sent once."""

from __future__ import annotations

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessera.sources import embedding


class Service:
    """A service whose ``answer`` gets (path, body, headers) and gives (status, object)."""

    def __init__(self, answer):
        self.calls, self.busy, self.most, lock = [], 0, 0, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with lock:
                    outer.calls.append((self.path, body))
                    outer.busy += 1
                    outer.most = max(outer.most, outer.busy)
                status, found = answer(self.path, body, self.headers)
                with lock:
                    outer.busy -= 1
                raw = json.dumps(found).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.server.shutdown()
        self.server.server_close()


def vector(text):
    return [float(len(text)), float(ord(text[0]))]


def openai(path, body, headers):
    texts = body["input"] if isinstance(body["input"], list) else [body["input"]]
    return 200, {"data": [{"index": i, "embedding": vector(t)} for i, t in reversed(list(enumerate(texts)))]}


def ollama(path, body, headers):
    if path == "/api/embeddings":
        return 200, {"embedding": vector(body["prompt"])}
    texts = body["input"] if isinstance(body["input"], list) else [body["input"]]
    return 200, {"embeddings": [vector(t) for t in texts]}


def test_ollama_takes_one_prompt_a_request_by_default():
    with Service(ollama) as s:
        assert embedding.HttpEmbedder(s.base, "m", "ollama", batch=8)(["a", "bb"]) == [vector("a"), vector("bb")]
        assert sorted(s.calls, key=str) == [("/api/embeddings", {"model": "m", "prompt": "a"}), ("/api/embeddings", {"model": "m", "prompt": "bb"})]


def test_ollama_takes_batches_at_its_other_endpoint():
    with Service(ollama) as s:
        ask = embedding.HttpEmbedder(f"{s.base}/api/embed", "m", "ollama", batch=2)
        assert ask(["a", "b", "c"]) == [vector(t) for t in "abc"]
        assert sorted(s.calls, key=str) == [("/api/embed", {"model": "m", "input": "c"}), ("/api/embed", {"model": "m", "input": ["a", "b"]})]


def test_openai_answers_are_put_in_order_and_carry_the_key():
    def answer(path, body, headers):
        assert headers["Authorization"] == "Bearer secret"
        return openai(path, body, headers)

    with Service(answer) as s:
        assert embedding.HttpEmbedder(s.base, "m", key="secret")(["x", "yy", "zzz"]) == [vector(t) for t in ("x", "yy", "zzz")]
        assert s.calls[0][0] == "/v1/embeddings" and embedding.HttpEmbedder(s.base, "m", key="secret")([]) == []


def test_requests_in_flight_keep_their_order():
    r = random.Random(1)

    def answer(path, body, headers):
        time.sleep(r.random() / 20 + (0.1 if body["prompt"] == "a0" else 0))
        return ollama(path, body, headers)

    texts = [f"a{i}" for i in range(24)]
    with Service(answer) as s:
        found = embedding.HttpEmbedder(s.base, "m", "ollama", concurrency=4)(texts)
        assert found == [vector(t) for t in texts] and 1 < s.most <= 4 and len(s.calls) == 24


def test_passing_failures_are_tried_again_and_others_are_not():
    left = {"x": 2}

    def answer(path, body, headers):
        if body["input"] == "x" and left["x"]:
            left["x"] -= 1
            return 503, {"error": "busy"}
        return (400, {"error": "too long"}) if body["input"] == "bad" else openai(path, body, headers)

    with Service(answer) as s:
        ask = embedding.HttpEmbedder(s.base, "m", wait=0.01, breaker=embedding.Breaker(failures=2))
        assert ask(["x"]) == [vector("x")] and len(s.calls) == 3
        with pytest.raises(embedding.Refused, match="400.*too long"):
            ask(["bad"])
        assert len(s.calls) == 4
        left["x"] = 99
        with pytest.raises(RuntimeError, match="503"):
            ask(["x"])
        with pytest.raises(RuntimeError, match="circuit"):
            ask(["x"])
        assert len(s.calls) == 7


@pytest.mark.parametrize("found", [{}, [], {"data": [{"index": 0}]}, {"embeddings": [[1.0], [2.0]]}, {"data": []}])
def test_answers_of_another_shape_are_refused(found):
    with pytest.raises(embedding.Refused):
        embedding.vectors_of(found, 1)
    assert embedding.vectors_of({"embedding": [1.0]}, 1) == [[1.0]]


def test_health():
    with Service(ollama) as s:
        assert embedding.HttpEmbedder(s.base, "m", "ollama").health() == (True, "ok dim=2 model=m provider=ollama concurrency=4")
    ok, said = embedding.HttpEmbedder(s.base, "m", "ollama", tries=1, timeout=1).health()
    assert not ok and s.base in said


def test_rows_keep_their_vectors_with_calls_in_flight(spark):
    rows = spark.range(200).selectExpr("id", "repeat('x', int(id % 17) + 1) AS content").repartition(3)

    def slow(texts):
        import time

        time.sleep(0.05 if len(texts[0]) % 2 else 0)
        return [[float(len(t))] for t in texts]

    found = embedding.embed(rows, slow, batch=5, ahead=4).collect()
    assert len(found) == 200 and all(r.embedding == [len(r.content) + 2.0] for r in found)


def test_each_text_is_sent_once(spark, tmp_path):
    kind = "id int, content string"
    log, place = str(tmp_path / "log"), iter(range(9))

    def noting(texts):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t))] for t in texts]

    def aside(rows):
        at = str(tmp_path / f"t{next(place)}")
        rows.write.parquet(at)
        return spark.read.parquet(at)

    known = spark.createDataFrame([], "text_hash string, embedding array<float>")
    rows = spark.createDataFrame([(i, ["one", "two", None, ""][i % 4]) for i in range(400)], kind)
    found, known = embedding.embed_new(rows, known, noting, aside)
    assert {(r.content, r.embedding[0]) for r in found.collect()} == {("one", 5.0), ("two", 5.0), (None, 2.0), ("", 2.0)} and found.count() == 400
    again, known = embedding.embed_new(spark.createDataFrame([(1, "two"), (2, "three")], kind), known, noting, aside)
    assert {(r.id, r.embedding[0]) for r in again.collect()} == {(1, 5.0), (2, 7.0)}
    assert sorted(open(log).read().split("\n")[:-1]) == ["d:", "d:one", "d:three", "d:two"]
