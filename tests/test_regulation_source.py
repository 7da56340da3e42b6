"""The regulation format over landed pages and over a server that is busy at first."""

import http.server
import threading

import pytest
from attestra.operators import ingestion
from attestra.sources import regulation_source as source

PAGE = "<html><body>" + "".join(f"<p>Article {i}</p><p>Title {i}</p><p>The controller shall do thing {i}.</p>" for i in range(1, 40)) + "</body></html>"


@pytest.fixture
def read(spark):
    source.register(spark)
    return lambda **options: spark.read.format("regulation").options(**{"least": "1000", "wait": "0.01"} | options).load()


def test_landed_pages(spark, tmp_path, read):
    (tmp_path / "rgpd.html").write_text(PAGE)
    (tmp_path / "nis2.html").write_text("<p>please wait</p>")
    (tmp_path / "dora.html").mkdir()
    (tmp_path / "dora.html" / "part-0").write_text(PAGE)
    (tmp_path / "dora.html" / "_SUCCESS").write_text("x")
    pages = read(at=f"file://{tmp_path}/{{code}}.html", codes="rgpd,nis2,dora,csrd")
    found = {r.code: r for r in pages.collect()}
    assert found["rgpd"].html == found["dora"].html == PAGE and found["rgpd"].celex == "32016R0679"
    assert "only 18 characters" in found["nis2"].problem and found["nis2"].html is None and "FileNotFoundError" in found["csrd"].problem
    articles = ingestion.articles(source.lines(pages))
    assert articles.groupBy("source").count().orderBy("source").collect() == [("dora", 39), ("rgpd", 39)]


class Busy(http.server.BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        self.asked.append(self.path)
        busy = self.asked.count(self.path) < 3 or self.path == "/dora"
        if self.path == "/csrd":
            self.send_error(404)
            return
        self.send_response(202 if busy else 200)
        self.end_headers()
        self.wfile.write(b"wait" if busy else PAGE.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    found = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Busy)
    Busy.asked = []
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}/{{code}}"
    found.shutdown()


def test_a_busy_server_is_asked_again(read, server):
    found = {r.code: r for r in read(at=server, codes="rgpd,dora,csrd").collect()}
    assert found["rgpd"].html == PAGE and found["rgpd"].attempts == 3
    assert found["dora"].html is None and found["dora"].attempts == 4 and found["dora"].problem == "status 202 with 4 characters"
    assert "404" in found["csrd"].problem and found["csrd"].attempts == 1


def test_filters_keep_sources_from_being_asked(read, server):
    assert read(at=server).filter("code = 'rgpd'").count() == 1 and set(Busy.asked) == {"/rgpd"}
    assert read(at=server).filter("code in ('nis2', 'other')").select("code").collect() == [("nis2",)] and set(Busy.asked) == {"/rgpd", "/nis2"}
    assert read(at=server).filter("code = 'other'").count() == 0


def test_unknown_sources_say_so(read):
    assert read(codes="nowhere").collect()[0].problem == "unknown source"
