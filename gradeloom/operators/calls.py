"""Calls to slow models: a bounded pool in each task, a time limit, retries with growing waits, and a journal.

A task keeps at most `workers` calls going at once and hands rows on in their order. A call that takes longer than `timeout` seconds counts as
failed; its thread can't be stopped, so it is left behind and its place in the pool is filled anew, `left_behind` times in a task at most. A
call that fails is made again, `retries` times, after waits that double each time, unless the client says by `Refused` that it is of no
use. What still fails has an error in place of a reply. A client is shared by the calls of its task, so it must bear several at once.

The journal is a folder that all executors share: each reply is a file there as soon as it is known, named by the call's key, and
written under another name first. A task that is run again, because an executor was lost or a query failed, reads the replies
that are there and asks only for the others; so does another task with the same key. Errors are not journalled.
"""

from __future__ import annotations

import hashlib
import json
import queue
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.sources import store
from gradeloom.sources.documents import place


class Refused(Exception):
    """An error that no further attempt mends."""


@dataclass(frozen=True)
class Policy:
    """How calls are made. The judge's and the verifiers' limits are JUDGE and VERIFIER."""

    timeout: float = 300.0
    retries: int = 2
    wait: float = 1.0
    most_wait: float = 60.0
    workers: int = 4
    left_behind: int = 64


JUDGE, VERIFIER = Policy(300.0, 2), Policy(180.0, 1)


class Journal:
    """Replies by key, a file each."""

    def __init__(self, path: str):
        self.filesystem, self.root = place(path)

    def _file(self, key: str) -> str:
        name = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.root}/{name[:2]}/{name}.json"

    def get(self, key: str) -> str | None:
        path = self._file(key)
        if self.filesystem.get_file_info(path).type != pafs.FileType.File:
            return None
        with self.filesystem.open_input_stream(path) as f:
            told = json.loads(f.read())
        return told["reply"] if told["key"] == key else None

    def put(self, key: str, reply: str) -> None:
        path = self._file(key)
        temporary = f"{path}.{uuid.uuid4().hex}.writing"
        self.filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        with self.filesystem.open_output_stream(temporary) as f:
            f.write(json.dumps({"key": key, "reply": reply}, ensure_ascii=False).encode())
        self.filesystem.move(temporary, path)


class Runners:
    """Threads that are used again: a call then costs no start of a thread."""

    def __init__(self):
        self.idle: deque = deque()

    def start(self, f: Callable[[], object]) -> tuple[queue.SimpleQueue, queue.SimpleQueue]:
        """(a thread's inbox, where (result, error) of f will be)."""
        done: queue.SimpleQueue = queue.SimpleQueue()
        try:
            inbox = self.idle.pop()
        except IndexError:
            inbox = queue.SimpleQueue()
            threading.Thread(target=self._run, args=(inbox,), daemon=True).start()
        inbox.put((f, done))
        return inbox, done

    @staticmethod
    def _run(inbox: queue.SimpleQueue) -> None:
        while (job := inbox.get()) is not None:
            f, done = job
            try:
                found = (f(), None)
            except BaseException as e:
                found = (None, e)
            done.put(found)
            del job, f, done, found

    def back(self, inbox: queue.SimpleQueue) -> None:
        self.idle.append(inbox)

    def close(self) -> None:
        while self.idle:
            self.idle.pop().put(None)


class Pool:
    """Makes calls side by side; `map` gives (reply, error) in the order of the prompts."""

    def __init__(self, generate: Callable[[str], str], policy: Policy, journal: Journal | None = None):
        self.generate, self.policy, self.journal = generate, policy, journal
        self.left, self.runners = 0, Runners()

    def _attempt(self, prompt: str) -> tuple[str | None, str | None, bool]:
        """(reply, error, whether to try again) of one call in a thread of its own, which is left behind when its time is over."""
        runner, said = self.runners.start(lambda: self.generate(prompt))
        try:
            reply, error = said.get(timeout=self.policy.timeout)
            self.runners.back(runner)
        except queue.Empty:
            runner.put(None)  # it ends when its call does
            self.left += 1
            if self.left > self.policy.left_behind:
                raise RuntimeError(f"more than {self.policy.left_behind} calls did not return in time") from None
            return None, f"no reply within {self.policy.timeout} seconds", True
        if error is not None:
            if not isinstance(error, Exception):
                raise error
            return None, str(error) or type(error).__name__, not isinstance(error, Refused)
        return (reply.strip(), None, False) if isinstance(reply, str) else (None, "the reply is no text", True)

    def one(self, key: str | None, prompt: str) -> tuple[str | None, str | None]:
        found = self.journal.get(key) if self.journal and key is not None else None
        if found is not None:
            return found, None
        reply = error = None
        for attempt in range(self.policy.retries + 1):
            if attempt:
                time.sleep(min(self.policy.most_wait, self.policy.wait * 2 ** (attempt - 1)))
            reply, error, again = self._attempt(prompt)
            if error is None and self.journal and key is not None:
                self.journal.put(key, reply)
            if not again:
                break
        return reply, error

    def map(self, asked: Iterable[tuple[str | None, str]]) -> Iterator[tuple[str | None, str | None]]:
        """At most `workers` calls are under way or waiting to be handed on, so a task holds no more replies than that."""
        waiting: deque = deque()

        def start(key, prompt):
            waiting.append(self.runners.start(lambda: self.one(key, prompt)))

        def take():
            runner, done = waiting.popleft()
            found, error = done.get()
            self.runners.back(runner)
            if error is not None:
                raise error
            return found

        for key, prompt in asked:
            if len(waiting) >= self.policy.workers:
                yield take()
            start(key, prompt)
        while waiting:
            yield take()


def call(prompts: DataFrame, factory: Callable[[], object], prompt: str = "prompt", parallelism: int | None = None, policy: Policy | None = None, journal: str | None = None, key: Column | None = None) -> DataFrame:
    """prompts with reply and call_error. A client is made once a task; with a journal, key names each call (else its prompt does)."""
    policy = policy or Policy()
    rows = prompts.repartition(parallelism) if parallelism else prompts
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("call_error", T.StringType())])
    place_ = store.qualified(prompts.sparkSession, journal) if journal else None
    named = rows.withColumn("__key", F.sha2(F.col(prompt), 256) if key is None else key) if journal else rows.withColumn("__key", F.lit(None).cast("string"))

    def step(frames: Iterable[pd.DataFrame]):
        client = factory()
        pool = Pool(client.generate, policy, Journal(place_) if place_ else None)
        try:
            for frame in frames:
                found = list(pool.map(zip(frame["__key"], frame[prompt], strict=True)))
                reply, error = (pd.Series([f[k] for f in found], dtype=object, index=frame.index) for k in (0, 1))
                yield frame.drop(columns="__key").assign(reply=reply, call_error=error)
        finally:
            pool.runners.close()

    return named.mapInPandas(step, schema)
