import json

import pytest

from corpusmill.functions.analyze import analyze, stem
from corpusmill.functions.models import (
    Breaker,
    Cache,
    Guarded,
    HashEmbedder,
    PieceTokenizer,
    WordPieceTokenizer,
    chat_client,
    half_precision,
    hypothetical_answers,
    listwise_order,
    listwise_with,
    model_file,
    model_folder,
    reranker_family,
    rewritten,
)
from corpusmill.functions.query import annotate, register, variants
from corpusmill.settings import Settings, load_settings


def test_annotate():
    assert annotate("drain vrrp before VRRP moves") == "drain vrrp (Virtual Router Redundancy Protocol) before VRRP moves"
    assert annotate("ACL or acl?") == "ACL (Access Control List) or acl?"
    assert annotate("QoS2 tcam-size") == "QoS2 tcam-size"
    assert annotate("cable colours") == "cable colours"
    assert annotate(None) is None


def test_variants():
    assert variants("how can I set up LACP bundles") == [
        "how can I set up LACP bundles", "set up LACP bundles", "LACP bundles",
    ]
    assert variants("show me IP") == ["show me IP"]
    assert variants("VRRP priority") == ["VRRP priority"]
    assert variants("timers (in seconds) of LACP")[1] == "timers of LACP"
    assert variants("") == [""]
    assert variants(None) == []


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("consigned", "consign"), ("consistently", "consist"), ("knackeries", "knackeri"),
        ("generously", "generous"), ("conditional", "condit"), ("hopping", "hop"),
        ("hoped", "hope"), ("happy", "happi"), ("dying", "die"), ("replacement", "replac"),
        ("agreed", "agre"), ("gas", "gas"), ("ties", "tie"), ("cries", "cri"), ("say", "say"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_analyze():
    assert analyze("The Configured ﬁrewalls of Zürich!") == ["configur", "firewal", "zurich"]
    assert analyze(None) == [] and analyze("the of") == []


def test_registered_functions(spark):
    register(spark)
    assert spark.sql("select annotate_query('BGP')").first()[0] == "BGP (Border Gateway Protocol)"
    assert spark.sql("select analyze_text('networks')").first()[0] == ["network"]


def test_models(tmp_path):
    v = HashEmbedder()(["a b", "a b", ""])
    assert (v[0] == v[1]).all() and abs((v * v).sum(1) - 1).max() < 1e-6
    assert abs(half_precision(v) - v).max() < 1e-2
    assert reranker_family(str(tmp_path)) == "missing"
    (tmp_path / "model.onnx").touch()
    assert reranker_family(str(tmp_path)) == "missing"
    (tmp_path / "vocab.txt").touch()
    assert reranker_family(str(tmp_path)) == "bert"
    (tmp_path / "sentencepiece.bpe.model").touch()
    assert reranker_family(str(tmp_path)) == "xlm-r"


def test_listwise_order():
    assert listwise_order("B, A, E, D, C", 5) == [1, 0, 4, 3, 2]
    assert listwise_order("first B then A", 3) == [1, 0]
    assert listwise_order(None, 5) == []


def test_rewriting_never_fails():
    assert rewritten("q", lambda q: "a passage that is long enough") == "a passage that is long enough"
    assert rewritten("q", lambda q: "short") == "q"

    def broken(q):
        raise RuntimeError

    assert rewritten("q", broken) == "q"


def test_breaker_and_cache():
    now = [0.0]
    b = Breaker(2, 10, lambda: now[0])
    b.failure()
    assert not b.open
    b.failure()
    assert b.open
    now[0] = 11
    assert not b.open
    made = []
    c = Cache(4)
    for k in "abcdea":
        c.get(k, lambda k=k: made.append(k))
    assert made == list("abcdea") and len(c.held) == 4


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"pool": 70, "limit": 5, "unknown": 1}))
    got = load_settings(str(path), {"CORPUSMILL_LIMIT": "7"})
    assert (got.pool, got.limit) == (70, 7)
    with pytest.raises(ValueError):
        Settings(min_tokens=600)


def test_piece_ids():
    assert PieceTokenizer.remapped([0, 1, 2, 3, 250]) == [3, 2, 3, 4, 251]
    assert {PieceTokenizer.SPECIAL[t] for t in ("<s>", "<pad>", "</s>", "<unk>")} == {0, 1, 2, 3}


def test_word_pieces(tmp_path):
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "route", "##r", "##s", "the"]
    (tmp_path / "vocab.txt").write_text("\n".join(words))
    tokenizer = WordPieceTokenizer(str(tmp_path))
    assert tokenizer.ids("The routers") == [8, 5, 6, 7] and tokenizer.ids("café") == [1]
    assert tokenizer.token_to_id("[SEP]") == 3


def test_model_files(tmp_path):
    assert model_file(str(tmp_path)) is None
    (tmp_path / "model.onnx").touch()
    assert model_file(str(tmp_path)).endswith("model.onnx")
    (tmp_path / "model_fp16.onnx").touch()
    assert model_file(str(tmp_path)).endswith("_fp16.onnx") and model_file(str(tmp_path), "fp32").endswith("model.onnx")
    assert model_folder("bge", str(tmp_path)) == str(tmp_path)
    assert model_folder("bge", str(tmp_path / "none"), "/m") == model_folder("bge", None, "/m") == "/m/bge"


def test_guarded_calls():
    now, calls = [0.0], []

    def service(text):
        calls.append(text)
        if text == "bad":
            raise OSError("down")
        return f"answer to {text}"

    guarded = Guarded(service, Breaker(2, 10, lambda: now[0]), Cache(4))
    assert guarded("a") == guarded("a") == "answer to a" and calls == ["a"]
    assert guarded("bad") is None and guarded("bad") is None and len(calls) == 3
    assert guarded("b") is None and guarded("a") == "answer to a" and len(calls) == 3  # open, but kept
    now[0] = 11
    assert guarded("b") == "answer to b"


def test_chat_service(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][0]["content"]
            if "broken" in text:
                self.send_error(500)
                return
            said = "C, A" if "Best first" in text else f"A longer passage about {text[-12:]}"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": said}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
    factory = lambda: Guarded(chat_client(url, "m", 5))
    rows = spark.createDataFrame([(1, "vlan limits"), (2, "broken"), (3, None)], "k int, q string")
    from pyspark.sql import functions as F

    got = {r.k: r.t for r in rows.select("k", hypothetical_answers(factory)(F.col("q")).alias("t")).collect()}
    assert got == {1: "A longer passage about vlan limits"[:23] + " vlan limits", 2: "broken", 3: None}
    head = spark.createDataFrame(
        [(q, p, 10 * q + p, "broken" if q == 2 else "x", f"text {p}") for q in (1, 2) for p in (3, 1, 2)],
        "query_id bigint, position int, chunk_id bigint, text string, rerank_text string",
    )
    assert [(r.query_id, r.ids) for r in listwise_with(factory)(head).collect()] == [(1, [13, 11])]
    server.shutdown()
