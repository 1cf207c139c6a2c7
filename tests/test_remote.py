"""Pages, embeddings and answers over HTTP, from a server in this process."""

import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lectern.config import Config
from lectern.plans.library import Library
from lectern.sources import remote


class Answers(BaseHTTPRequestHandler):
    def _send(self, status, kind, body):
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        if self.path == "/page":
            self._send(200, "text/html; charset=utf-8", "<title>Café</title><p>served words</p><a href='http://h.example/x'>x</a>".encode())
        else:
            self._send(404, "text/plain", b"no")

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("/embeddings"):
            rows = [{"index": i, "embedding": [float(t.count("a")), 1.0]} for i, t in enumerate(body["input"])]
            out = {"data": rows[::-1]}
        else:
            said = " / ".join(m["role"] + ": " + m["content"] for m in body["messages"])
            out = {"choices": [{"message": {"content": f"{body['model']} {self.headers.get('Authorization')} {said}"}}]}
        self._send(200, "application/json", json.dumps(out).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def place():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages(place):
    text, kind = remote.Get()(place + "/page")
    assert "Café" in text and kind == "text/html; charset=utf-8"
    with pytest.raises(urllib.error.HTTPError):
        remote.Get()(place + "/none")


def test_embeddings_keep_their_order(place):
    assert remote.ServiceEmbedder(place + "/v1/", "m", 2).embed(["aa", "b", "a"]) == [[2, 1], [0, 1], [1, 1]]
    assert remote.ServiceEmbedder(place, "m", 2).embed([]) == []
    with pytest.raises(ValueError):
        remote.ServiceEmbedder(place, "m", 3).embed(["x"])


def test_models(place, monkeypatch):
    assert remote.ServiceModel(place, "m").generate("hi") == "m None user: hi"
    monkeypatch.setenv("SOME_KEY", "k1")
    model = remote.ServiceModel(place, "m", key_variable="SOME_KEY")
    assert model.generate("hi", "be brief") == "m Bearer k1 system: be brief / user: hi" and "k1" not in repr(model) and model.name == "m"


def test_library_over_http(spark, tmp_path, place):
    library = Library(spark, f"file://{tmp_path}/index", Config(mode="vector"), remote.ServiceEmbedder(place, "m", 2), remote.ServiceModel(place, "m"))
    done = library.index([place + "/page", place + "/none"])
    assert (done.documents, done.failed) == (1, 1) and "404" in done.errors[0][1]
    found = library.search("a query", 5).first()
    assert found.document_path == place + "/page" and "served words" in found.content
    assert "served words" in library.ask("what is served?")["answer"]
