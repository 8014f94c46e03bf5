"""Calls of a model service: at once, in time, and behind a breaker."""

import threading
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from riskweave.operators.calls import Breaker, BreakerSettings, call_all
from riskweave.operators.scoring import model_of


def fails():
    raise RuntimeError("no answer")


def test_results_come_in_order_and_failures_are_none():
    assert call_all([]) == []
    jobs = [partial(lambda n: time.sleep(0.02 * (5 - n)) or n, n) for n in range(5)]
    assert call_all([*jobs, fails], width=6) == [0, 1, 2, 3, 4, None]
    assert call_all([*jobs, fails]) == [0, 1, 2, 3, 4, None]


@pytest.mark.parametrize("width", [1, 7])
def test_no_more_calls_than_the_width(width):
    lock, now, most = threading.Lock(), [0], [0]

    def job():
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1

    call_all([job] * 40, width)
    assert most[0] <= width and (width == 1 or most[0] > 1)


def test_a_slow_call_gives_its_place_on():
    done = threading.Event()
    start = time.monotonic()
    assert call_all([done.wait, lambda: 2, done.wait, lambda: 4], 1, timeout_seconds=0.3) == [None, 2, None, 4]
    assert time.monotonic() - start < 5
    done.set()


def test_the_breaker_opens_tries_and_closes():
    clock = [0.0]
    guard = Breaker(BreakerSettings(calls=4, failed_share=0.5, open_seconds=10), lambda: clock[0])
    made = []

    def job(ok):
        made.append(ok)
        return 1 if ok else fails()

    run = lambda *oks: call_all([partial(job, ok) for ok in oks], 1, None, guard)
    assert run(True, True, False, False, True, True) == [1, 1, None, None, None, None]
    assert len(made) == 4
    clock[0] = 10.0
    assert run(False, True) == [None, None] and len(made) == 5
    clock[0] = 19.0
    assert run(True) == [None]
    clock[0] = 20.0
    assert run(True, True, False) == [1, 1, None] and len(made) == 8
    assert run(True) == [1]


def test_slow_models_answer_side_by_side(spark):
    def analyze(redacted, similar):
        time.sleep(0.1)
        return redacted["n"], str(len(similar))

    def down(redacted, similar):
        raise RuntimeError("no answer")

    rows = spark.range(200).coalesce(1).select(
        F.struct(F.col("id").alias("n")).alias("r"), F.array(F.struct(F.lit(1).alias("x"))).alias("s"))

    def answers(model):
        start = time.monotonic()
        got = rows.select(model(F.col("r"), None, None, F.col("s")).alias("a")).select("a.*").collect()
        return [tuple(g) for g in got], time.monotonic() - start

    got, took = answers(model_of(analyze, 10, width=50))
    assert got == [(float(n), "1") for n in range(200)] and took < 200 * 0.1 / 2
    got, _ = answers(model_of(down, 10, 4, BreakerSettings()))
    assert got == [(None, None)] * 200
