"""Calls of remote services: quota, concurrency, rate, poisoned batches."""

import json
import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from marlstone.operators import generation, rerank
from marlstone.operators.remote import Bucket, Limits, Pool, QuotaExceeded, called, is_quota


@pytest.fixture
def service():
    """A service on this host that refuses what goes beyond six calls at once, and every fifth call besides."""
    state = {"now": 0, "most": 0, "calls": 0, "refused": 0}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            said = self.rfile.read(int(self.headers["Content-Length"])).decode()
            with lock:
                state["now"] += 1
                state["calls"] += 1
                state["most"] = max(state["most"], state["now"])
                no = state["now"] > 6 or state["calls"] % 5 == 0
                state["refused"] += no
            time.sleep(0.002)
            with lock:
                state["now"] -= 1
            body = json.dumps({"said": said[::-1]}).encode()
            self.send_response(429 if no else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    class Server(ThreadingHTTPServer):
        request_queue_size = 64

    server = Server(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", state
    server.shutdown()


def asker(url):
    def call(x):
        request = urllib.request.Request(url, (x[0] or "").encode(), method="POST")
        with urllib.request.urlopen(request, timeout=30) as got:
            return json.loads(got.read())["said"]

    return call


def test_no_row_is_lost_to_a_service_with_a_quota(spark, service):
    url, state = service
    rows = spark.range(600).repartition(4).select("id", F.when(F.col("id") % 50 != 0, F.concat(F.lit("row "), "id")).alias("text"), F.lit(1).alias("value"))
    got = called(rows, ["text"], "said", asker(url), Limits(concurrent=3, quota_tries=60, base=0.002, cap=0.05)).collect()
    assert sorted(r.id for r in got) == list(range(600))
    assert all(r.said_error is None and r.said == (r.text or "")[::-1] and r.value == 1 for r in got)
    assert state["refused"] > 100 and state["most"] <= 12  # four tasks of three
    assert sum(r.said_calls for r in got) == state["calls"] == 600 + state["refused"]


def test_errors_stay_with_their_rows(spark):
    rows = spark.range(40).repartition(3).withColumn("x", F.col("id").cast("string"))

    def call(x):
        if int(x[0]) % 10 == 3:
            raise QuotaExceeded("later")
        return 1 / (int(x[0]) % 10) if int(x[0]) % 10 != 7 else "no number"

    got = {r.id: r for r in called(rows, ["x"], "y", call, Limits(tries=2, quota_tries=4, base=0.0001), kind="double").collect()}
    assert len(got) == 40
    assert got[0].y is None and got[0].y_error.startswith("ZeroDivisionError") and got[0].y_calls == 2
    assert got[3].y is None and got[3].y_error.startswith("QuotaExceeded") and got[3].y_calls == 4
    assert got[7].y is None and "Arrow" in got[7].y_error
    assert got[2].y == 0.5 and got[2].y_error is None and got[2].y_calls == 1
    assert called(rows.limit(0), ["x"], "y", call).count() == 0
    with pytest.raises(ValueError):
        called(rows.withColumn("y_calls", F.lit(1)), ["x"], "y", call)


def test_one_bad_input_costs_few_calls():
    calls = []

    def call(xs):
        calls.append(len(xs))
        if 13 in xs:
            raise ValueError("bad")
        return [x * 2 for x in xs] if 40 not in xs else []

    with Pool(Limits(concurrent=1, tries=2)) as pool:
        got = list(pool.blocks(call, list(range(64)), 32))
    assert [a.value for a in got] == [None if x in (13, 40) else x * 2 for x in range(64)]
    assert "bad" in got[13].error and "0 answers" in got[40].error
    assert len(calls) == 2 * (2 * 5 + 2)  # halved five times a block, and the bad one tried twice


def test_the_bucket_keeps_the_rate_and_waits_double():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = Bucket(10, 3, lambda: now[0], sleep)
    for _ in range(13):
        bucket.take()
    assert now[0] == pytest.approx(1.0)  # three at once, ten more in a second
    waits = []
    with Pool(Limits(quota_tries=12, base=1, cap=8), sleep=waits.append) as pool:
        got = pool.one(lambda x: (_ for _ in ()).throw(QuotaExceeded()), 1)
    assert got.calls == 12 and len(waits) == 11
    assert all(w <= min(8, 2**i) for i, w in enumerate(waits)) and len(set(waits)) > 5


def test_what_is_a_quota():
    class ResourceExhausted(Exception):
        pass

    refused = Exception("x")
    refused.code = 429
    assert all(map(is_quota, (QuotaExceeded(), ResourceExhausted(), refused, Exception("Quota exceeded for you")))) and not is_quota(ValueError("x"))


def test_scorers_and_models_go_through_the_pool(spark, service):
    url, _ = service
    ask = asker(url)
    rows = spark.range(80).repartition(2).select("id", F.lit("q").alias("q"), F.col("id").cast("string").alias("t"))
    limits = Limits(concurrent=3, quota_tries=60, base=0.002, cap=0.05)
    got = rows.select(
        "t",
        rerank.guarded(lambda q, t: float(ask((t,))[0]), limits=limits)("q", "t").alias("score"),
        rerank.batched(lambda xs: [float(t) if t != "7" else 1 / 0 for _, t in xs], size=16)("q", "t").alias("batch"),
        generation.structured(lambda p: json.dumps({"a": ask((p,))}), limits=limits)("t").alias("json"),
        generation.spoken(lambda p: list(ask((p,))), limits=limits)("t").alias("said"),
    ).collect()
    assert len(got) == 80
    for r in got:
        assert r.score == float(r.t[-1]) and json.loads(r.json) == {"a": r.t[::-1]} and r.said == r.t[::-1]
        assert r.batch == (None if r.t == "7" else float(r.t))
