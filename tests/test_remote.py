"""Remote calls: deadline, bounded concurrency, breaker."""

import threading
import time

import pytest

from colloquy.operators import generate as G

RULES = {"max_attempts": 3, "retry_sleep": 0.0, "deadline": 0.2, "concurrency": 4, "max_errors": 2}


def ask(fn, prompts, breaker=3, **rules):
    gate = G._Breaker(breaker)
    rules = {**RULES, **rules}
    slots = threading.Semaphore(2 * rules["concurrency"])
    begin = time.monotonic()
    rows = G._ask_all(fn, prompts, rules, gate, slots)
    return rows, time.monotonic() - begin, gate, slots


def test_a_hanging_client_costs_a_bounded_time():
    stop, calls = threading.Event(), []

    def hang(prompts):
        calls.append(prompts)
        stop.wait(30)
        return prompts
    rows, seconds, gate, slots = ask(hang, [f"p{i}" for i in range(200)])
    # (breaker + concurrency) / concurrency rounds of 3 timeouts of 0.2 s
    assert seconds < 2 * 3 * 0.2 + 1 and gate.is_open and len(calls) <= 8
    assert all(r[0] == "" and r[1] for r in rows) and sum(r[2] for r in rows) <= 4 * 3 + 3
    begin = time.monotonic()
    again = G._ask_all(hang, ["x"] * 50, RULES, gate, slots)
    assert time.monotonic() - begin < 0.2 + 0.5 and all(r[0] == "" for r in again)
    stop.set()


def test_a_slow_client_is_asked_in_parallel_and_never_more_than_allowed():
    lock, now, most = threading.Lock(), [0], [0]

    def slow(prompts):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return [p.upper() for p in prompts]
    rows, seconds, _, _ = ask(slow, [f"p{i}" for i in range(40)], deadline=5.0)
    assert [r for r in rows] == [(f"P{i}", None, 1) for i in range(40)]
    assert seconds < 40 * 0.05 * 0.6 and most[0] == 4


def test_a_dead_client_is_not_asked_for_every_prompt():
    calls = []

    def dead(prompts):
        calls.append(1)
        raise ConnectionError("refused")
    rows, seconds, gate, _ = ask(dead, ["x"] * 500, concurrency=1)
    assert len(calls) == 3 * 2 and seconds < 2 and sum("not sent" in r[1] for r in rows) == 497


def test_timeouts_and_other_errors_count_apart():
    def timeout(prompts):
        raise RuntimeError("Request Timeout")
    assert ask(timeout, ["x"], max_attempts=31)[0][0][2] == 31

    def refuse(prompts):
        raise ValueError("bad key")
    assert ask(refuse, ["x"], max_attempts=31)[0][0][2] == 2


def test_the_breaker_closes_when_the_client_is_back():
    gate, slots = G._Breaker(1), threading.Semaphore(8)
    state = {"up": False}

    def client(prompts):
        if not state["up"]:
            raise OSError("down")
        return ["ok"] * len(prompts)
    assert all(r[0] == "" for r in G._ask_all(client, ["a", "b"], RULES, gate, slots)) and gate.is_open
    state["up"] = True
    assert [r[0] for r in G._ask_all(client, ["a", "b", "c"], RULES, gate, slots)] == ["ok"] * 3 and not gate.is_open


def test_single_bad_prompts_do_not_open_it():
    def picky(prompts):
        if prompts[0] == "bad":
            raise ValueError("no")
        return prompts
    rows, _, gate, _ = ask(picky, ["bad", "a", "b", "bad", "c", "d", "bad", "e"], breaker=2, concurrency=1)
    assert [r[0] for r in rows] == ["", "a", "b", "", "c", "d", "", "e"] and not gate.is_open


def test_remote_score_over_partitions(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(30)] + [(99, None)], "id long, prompt string").repartition(3)

    def factory():
        seen = set()

        def client(prompts):
            if prompts[0] not in seen:
                seen.add(prompts[0])
                raise TimeoutError("timeout")
            return [p + "!" for p in prompts]
        return client
    got = {r.id: r for r in G.remote_score(df, "prompt", factory, retry_sleep=0.0).collect()}
    assert all(got[i].judge_reply == f"p{i}!" and got[i].attempts == 2 and got[i].error is None for i in range(30))
    assert got[99].judge_reply is None and got[99].error == "null prompt"
    with pytest.raises(ValueError):
        G.remote_score(df, "prompt", factory, deadline=0)
