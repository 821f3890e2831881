"""Calling a user-supplied generator over prompts, in Arrow batches.

``factory()`` runs once per partition on the executor (load a model or open a
client there) and returns a callable ``list[str] -> list[str]``.  Each Arrow
batch is one call.  Failures are retried up to ``max_attempts`` times; if a
batch still fails, its prompts are tried one by one, and only those that fail
on their own yield a blank response and the error text.
"""

from __future__ import annotations

import queue
import threading
import time
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import constants as C


def batch_generate(df: DataFrame, prompt_col: str, factory: Callable[[], Callable[[list[str]], list[str]]],
                   out: str = "response", max_attempts: int = C.MAX_REMOTE_ATTEMPTS,
                   retry_sleep: float = 0.0) -> DataFrame:
    """Adds ``out`` (string), ``error`` (string or null) and ``attempts`` (int).

    A null prompt is not sent: its response is null and the error says so.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType()),
                                              T.StructField("error", T.StringType()),
                                              T.StructField("attempts", T.IntegerType())])

    def call(fn, prompts: list[str]) -> tuple[list[str] | None, str | None, int]:
        err = None
        for attempt in range(1, max_attempts + 1):
            try:
                result = list(fn(prompts))
                if len(result) != len(prompts):
                    raise ValueError("generator returned a different number of responses")
                return result, None, attempt
            except Exception as e:  # noqa: BLE001 - every error is retried and reported
                err = f"{type(e).__name__}: {e}"
                if retry_sleep:
                    time.sleep(retry_sleep)
        return None, err, max_attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for pdf in batches:
            rows = [(None, "null prompt", 0)] * len(pdf)
            asked = [i for i, p in enumerate(pdf[prompt_col]) if isinstance(p, str)]
            prompts = [pdf[prompt_col].iloc[i] for i in asked]
            result, err, attempts = call(fn, prompts) if asked else ([], None, 0)
            if result is not None:
                for i, r in zip(asked, result):
                    rows[i] = (r, None, attempts)
            elif len(asked) == 1:
                rows[asked[0]] = ("", err, attempts)
            else:
                for i, p in zip(asked, prompts):
                    one, err, more = call(fn, [p])
                    rows[i] = (one[0] if one is not None else "", err, attempts + more)
            pdf = pdf.copy()
            pdf[out], pdf["error"], pdf["attempts"] = ([r[k] for r in rows] for k in range(3))
            yield pdf

    return df.mapInPandas(run, schema)


class CallTimeout(TimeoutError):
    """A call that did not answer before its deadline."""


class _Breaker:
    """Opens after ``limit`` prompts in a row have failed for good; shared by the threads of a task."""

    def __init__(self, limit: int):
        self.limit, self.failed, self.last = limit, 0, None
        self.lock = threading.Lock()

    @property
    def is_open(self) -> bool:
        return self.failed >= self.limit

    def note(self, error: str | None) -> None:
        with self.lock:
            self.failed, self.last = (0, None) if error is None else (self.failed + 1, error)


def call_with_deadline(fn: Callable, argument, deadline: float, slots: threading.Semaphore):
    """``fn(argument)``, or ``CallTimeout`` after ``deadline`` seconds.

    A call that hangs cannot be ended; it is left behind in a daemon thread and
    holds its slot until it returns, so no more calls hang than there are slots.
    """
    end = time.monotonic() + deadline
    if not slots.acquire(timeout=deadline):
        raise CallTimeout("timeout: every slot is held by a call that hangs")
    answer: queue.SimpleQueue = queue.SimpleQueue()

    def run():
        try:
            answer.put((True, fn(argument)))
        except BaseException as e:  # noqa: BLE001 - handed to the caller
            answer.put((False, e))
        finally:
            slots.release()

    threading.Thread(target=run, daemon=True).start()
    try:
        good, value = answer.get(timeout=max(end - time.monotonic(), 0.001))
    except queue.Empty:
        raise CallTimeout(f"timeout after {deadline} s") from None
    if not good:
        raise value
    return value


def _ask(fn, prompt: str, rules: dict, breaker: _Breaker, slots, probe: bool) -> tuple[str, str | None, int]:
    """(reply, error, attempts) of one prompt; a probe has one attempt."""
    timeouts = errors = 0
    while True:
        try:
            replies = list(call_with_deadline(fn, [prompt], rules["deadline"], slots))
            if len(replies) != 1:
                raise ValueError("the client returned a different number of replies")
            breaker.note(None)
            return replies[0], None, timeouts + errors + 1
        except Exception as e:  # noqa: BLE001 - every error is counted and reported
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, TimeoutError) or "timeout" in str(e).lower():
                timeouts += 1
            else:
                errors += 1
        if probe or timeouts >= rules["max_attempts"] or errors >= rules["max_errors"]:
            breaker.note(error)
            return "", error, timeouts + errors
        if breaker.is_open:
            return "", f"gave up: {breaker.last}", timeouts + errors
        time.sleep(rules["retry_sleep"])


def _ask_all(fn, prompts: list[str], rules: dict, breaker: _Breaker, slots) -> list[tuple[str, str | None, int]]:
    """Replies to all prompts of a batch, at most ``concurrency`` calls at a time."""
    rows: list = [None] * len(prompts)
    begin = 0
    if breaker.is_open and prompts:  # one prompt finds out whether the client is back
        rows[0], begin = _ask(fn, prompts[0], rules, breaker, slots, probe=True), 1
    todo: queue.SimpleQueue = queue.SimpleQueue()
    for i in range(begin, len(prompts)):
        todo.put(i)

    def work():
        while True:
            try:
                i = todo.get_nowait()
            except queue.Empty:
                return
            rows[i] = ("", f"not sent: {breaker.last}", 0) if breaker.is_open else \
                _ask(fn, prompts[i], rules, breaker, slots, probe=False)

    threads = [threading.Thread(target=work, daemon=True) for _ in range(min(rules["concurrency"], len(prompts) - begin))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return rows


def remote_score(df: DataFrame, prompt_col: str, client_factory, out: str = "judge_reply",
                 max_attempts: int = C.MAX_REMOTE_ATTEMPTS, retry_sleep: float = 5.0, deadline: float = 60.0,
                 concurrency: int = 8, breaker: int = 3, max_errors: int = 5) -> DataFrame:
    """Asks a remote judge for a reply to every prompt; no network client is shipped.

    Adds ``out``, ``error`` (null if all went well) and ``attempts``.
    ``client_factory()`` runs once a partition and returns a callable
    ``list[str] -> list[str]``, which is called with one prompt at a time from
    ``concurrency`` threads and may not rely on being called in order.

    * A call that takes longer than ``deadline`` seconds counts as a timeout,
      like any error whose message speaks of one.  A prompt is given up after
      ``max_attempts`` timeouts or ``max_errors`` other errors (a wrong key does
      not get right by asking again), with an empty reply and the last error.
    * Once ``breaker`` prompts in a row have been given up, the rest of the
      batch is not sent and calls that wait to be repeated are given up.  The
      first prompt of the next batch is sent once: if it is answered, sending
      goes on, else that batch is not sent either.
    * So a client that hangs for good costs a task at most
      ``(breaker + concurrency) / concurrency * max_attempts * (deadline + retry_sleep)``
      seconds for its first batch, rounded up to whole rounds, and ``deadline``
      for every later one.

    A null prompt is not sent: its reply is null and the error says so.
    """
    if min(max_attempts, concurrency, breaker, max_errors) < 1 or deadline <= 0:
        raise ValueError("max_attempts, concurrency, breaker, max_errors: 1 or more; deadline: above 0")
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType()),
                                              T.StructField("error", T.StringType()),
                                              T.StructField("attempts", T.IntegerType())])
    rules = {"max_attempts": max_attempts, "retry_sleep": retry_sleep, "deadline": deadline, "concurrency": concurrency,
             "max_errors": max_errors}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn, gate, slots = client_factory(), _Breaker(breaker), threading.Semaphore(2 * concurrency)
        for pdf in batches:
            rows = [(None, "null prompt", 0)] * len(pdf)
            asked = [i for i, p in enumerate(pdf[prompt_col]) if isinstance(p, str)]
            for i, row in zip(asked, _ask_all(fn, [pdf[prompt_col].iloc[i] for i in asked], rules, gate, slots)):
                rows[i] = row
            pdf = pdf.copy()
            pdf[out], pdf["error"], pdf["attempts"] = ([r[k] for r in rows] for k in range(3))
            yield pdf

    return df.mapInPandas(run, schema)


def tail_echo_factory(n_chars: int = 16):
    """Deterministic stand-in generator: answers with the last ``n_chars`` of the prompt."""
    def make():
        return lambda prompts: [p[-n_chars:] for p in prompts]
    return make


def letter_by_length_factory():
    """Deterministic stand-in for a choice model: decoded prompt + one letter picked by prompt length."""
    def make():
        return lambda prompts: [p + "ABCD"[len(p) % 4] for p in prompts]
    return make


def echo_reply_factory(n_chars: int = 24, eos: str = C.EOS):
    """Deterministic stand-in for a chat model: decoded prompt + its own last characters + eos + next marker."""
    def make():
        return lambda prompts: [p + p[-n_chars:] + eos + C.PATIENT for p in prompts]
    return make


def length_judge_factory():
    """Deterministic stand-in judge: ``Score: len(prompt) % 11``."""
    def make():
        return lambda prompts: [f"Score: {len(p) % 11}" for p in prompts]
    return make


def tokenize_with(df: DataFrame, text_col: str, factory, out: str = "tokens") -> DataFrame:
    """Pluggable tokenizer hook: ``factory()`` (once per partition) returns ``str -> list[str]``."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = factory()
        for pdf in batches:
            pdf = pdf.copy()
            pdf[out] = [tok(t) if isinstance(t, str) else [] for t in pdf[text_col]]
            yield pdf

    return df.mapInPandas(run, schema)


def regex_tokenizer_factory(pattern: str = C.TOKEN_PATTERN):
    """Python twin of the built-in tokenizer (``regex`` module, same pattern)."""
    def make():
        import regex
        rx = regex.compile(pattern)
        return lambda s: rx.findall(s)
    return make
