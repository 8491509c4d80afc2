"""Calls to models start few threads."""

from __future__ import annotations

import threading

from gradeloom.operators import calls


def test_calls_use_their_threads_again():
    seen = set()

    def generate(prompt: str) -> str:
        seen.add(threading.current_thread())
        return prompt.upper()

    pool = calls.Pool(generate, calls.Policy(workers=4))
    asked = [(None, f"p{k}") for k in range(500)]
    assert list(pool.map(asked)) == [(f"P{k}", None) for k in range(500)]
    assert len(seen) <= 8
    pool.runners.close()
