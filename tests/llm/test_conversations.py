"""Conversation repair against a best-first search over edits, whole and in blocks, with nulls, ties and repeats."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverspark.llm import conversations, queries

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows):
    """Audit and repaired rows of least (cost, audit); rows are (role, text, fault)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        expected = "a" if state == 2 else "u"
        name = {"a": "assistant", "u": "user"}[expected]
        heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state][expected], (*out, (name, ""))))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        more = int(fault == "truncated")
        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, NEXT[state][expected], (*out, (name, text))))
        if role[:1] in NEXT[state]:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state][role[:1]], (*out, (role, text))))


def plain(rows):
    """What repair_conversations returns, by conversation, for (conv, turn, role, text)."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        seen, judged = set(), []
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, audit, out = cheapest(judged)
        text = "\n".join(f"{r}:{t}" for r, t in out)
        counts = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def damaged(rows):
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        yield from [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "open end", "", " \n", None, "Wait. \t", "é.", "x\u0000y.", "a" * 5000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "svc"]
    out = [(c, rng.choice([*range(7), None]), rng.choice(roles), rng.choice(texts)) for c in [*range(40), None] for _ in range(rng.randrange(1, 9))]
    out += [(100, t, ("user", "assistant")[t % 2], f"Turn {t % 23}.") for t in range(120)]
    out += [(101, None, "user", "same.")] * 30 + [(102, 3, "assistant", "b."), (102, 3, "assistant", "a.")]
    return out


def by_conv(df):
    return {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in df.collect()}


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.withColumns({c: F.lit("own") for c in ("conv", "known", "code", "key", "rows", "place", "cost", "audit", "_copy", "first")})


def test_repairs_are_the_cheapest_and_least(frame, rows):
    assert by_conv(conversations.repair_conversations(frame)) == plain(rows)


def test_conversations_in_blocks_get_the_same(frame, rows, monkeypatch):
    want = plain(rows)
    assert by_conv(conversations.repair_conversations(frame, most_rows=1)) == want
    monkeypatch.setattr(conversations, "BLOCK", 16)
    assert by_conv(conversations.repair_conversations(frame, most_rows=20)) == want
    assert by_conv(conversations.repair_conversations(frame, most_bytes=4000)) == want


def test_audits_of_random_codes():
    rng = random.Random(1)
    many = [np.array([rng.randrange(16) for _ in range(rng.randrange(9))], dtype=np.int64) for _ in range(500)]
    names = {0: "", 1: "truncated", 2: "blank", 3: "duplicate"}
    for codes, (cost, audit) in zip(many, conversations.audits(many), strict=True):
        want = cheapest([("suax"[c % 4], "", names[c // 4]) for c in codes])
        assert (cost, audit.decode()) == want[:2]
        if len(codes):
            pieces = [codes[i : i + 3] for i in range(0, len(codes), 3)]
            assert conversations.audit_long(pieces, together=2)[:2] == (cost, conversations.audit_long(pieces)[1])
            assert b"".join(conversations.audit_long(pieces, together=2)[1]) == audit


def test_empty_tables_and_damage(spark, frame, rows):
    assert conversations.repair_conversations(frame.filter("false")).count() == 0
    got = sorted(map(tuple, conversations.damage(frame).collect()), key=str)
    assert got == sorted(damaged(rows), key=str)


def test_the_query_returns_every_conversation(spark, sf_dir):
    rows = list(map(tuple, spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows} | plain(list(damaged(rows)))
    df = queries.QUERIES["op11_conversations"](spark, sf_dir)
    assert dict(df.dtypes) == {"conv_id": "bigint", "audit": "string", "repaired_sha256": "string"} | {c: "bigint" for c in FIELDS[:6]}
    assert by_conv(df) == want


def test_a_conversation_without_rows_after_damage(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (None, None, "user", "y.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = by_conv(queries.QUERIES["op11_conversations"](spark, str(tmp_path)))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {gone: empty, None: empty} | plain(list(damaged(rows)))
