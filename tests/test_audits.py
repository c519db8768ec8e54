import hashlib
import hmac
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quern.operators import audits as U
from quern.sources import host


def test_keyed_hash_is_hmac(spark):
    for secret in (b"a" * 32, b"b" * 80, b""):
        got = spark.range(1).select(U.keyed_hash(secret, F.lit("q:C0:0")), U.blind_id(secret, F.lit("q:C0:0"))).first()
        want = hmac.new(secret, b"q:C0:0", hashlib.sha256).hexdigest()
        assert got[0] == want and got[1] == "E1-BLIND-" + want[:20].upper()


def test_crc8(spark):
    assert spark.range(1).select(U.crc8(F.array(F.lit(0xBE), F.lit(0xEF)))).first()[0] == 0x92


def test_remapping_needs_one_target(spark):
    df, walk = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, target string")
    with pytest.raises(Exception, match="no single target"):
        U.remapped(df, walk, "k").collect()
    assert U.remapped(df.where("k = 1"), walk, "k").first().target == "a"


def test_review_codes(spark):
    row = spark.range(1).select(U.review_errors(F.lit(False), F.lit(False), F.lit(False), F.lit(True), F.lit(4), F.lit(False))).first()[0]
    assert row == ["y_trigger_not_derived", "severity_4_requires_severe_failure"]


def test_frames_wait_for_line_feeds():
    f = host.LineFramer()
    assert f.feed(b'{"a":') == [] and f.feed(b" 1}\r\n\n{") == [b'{"a": 1}'] and f.feed(b"}\n") == [b"{}"]


def test_host_sample(tmp_path):
    (tmp_path / "sys/class/thermal/thermal_zone0").mkdir(parents=True)
    (tmp_path / "sys/class/thermal/thermal_zone0/temp").write_text("45500\n")
    (tmp_path / "p").write_text("3000")
    s = host.sample(str(tmp_path), ("/p",), 0.001)
    assert s["temperature_c"] == 45.5 and s["power_w"] == 3.0 and s["available_memory_mb"] is None and host.device_info()["logical_cpus"] > 0


def test_generation_server(spark):
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = "" if "empty" in asked["prompt"] else "echo " + asked["prompt"]
            body = json.dumps({"content": text, "timings": {"prompt_n": 2, "predicted_n": 3}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(1, "hi"), (2, "empty")], "query_id int, prompt string")
    got = {r.query_id: r for r in host.generated(df, f"http://127.0.0.1:{server.server_port}/").collect()}
    server.shutdown()
    assert (got[1].text, got[1].prompt_tokens, got[1].generated_tokens) == ("echo hi", 2, 3) and got[2].text is None and "no text" in got[2].error
