from __future__ import annotations

import random
from collections import defaultdict

import pytest

from weftgraph.llm import chat


def brute(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))] for c, t in held.items()}
    keep = set()
    for c, t in convs.items():
        longer = any(len(u) > len(t) and u[: len(t)] == t for u in convs.values())
        first = min(d for d, u in convs.items() if u == t)
        if not longer and first == c:
            keep.add(c)
    return {(c, i + 1, f"<|im_start|>{r}\n{x}<|im_end|>\n") for c in keep for i, (r, x) in enumerate(convs[c])}


def conversations(seed):
    rng = random.Random(seed)
    rows, c = [], 0
    for _ in range(25):
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "", None])) for _ in range(rng.randint(1, 6))]
        for n in {len(turns), rng.randint(1, len(turns)), rng.randint(1, len(turns))}:
            start = rng.choice([0, 1, 5])
            rows += [(c, start + i, r, t) for i, (r, t) in enumerate(turns[:n])]
            c += 1
    return [*rows, (None, 0, "user", "x"), (900, None, None, None), (901, 2, "user", "a"), (901, 2, "user", "a"), (902, 2, "user", "a")]


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 2), (3, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int").repartition(3)
    found = chat.render_turns(chat.maximal(frame)).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == brute(rows)


def test_main_path_is_native(spark, sf001):
    plan = chat.op2_chat_format(spark, sf001)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert chat.render_turns(chat.maximal(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
