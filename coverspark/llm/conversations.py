"""Conversation structure repair: the cheapest edits of each conversation, the least of ties by prefix doubling.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``.  Its rows are kept, given another role or
deleted, and turns without text are put in.  Places between rows times states of that pattern are nodes, edits are arcs.
A cost DP from the end leaves the arcs that cheapest paths use; nodes are then ranked by the least audit (string of edit
initials) of length 1, 2, 4, ... that starts at them, by pairs of ranks over pointers that double; the ranks pick each
node's arc and the doubled pointers read off the least path.  Arcs out of a node have different initials, so one pointer
a node is enough.

Conversations of many rows or bytes are cut into blocks: distances from and to block borders come as 4 x 4 matrices, so
that only one letter a row, as the audit has, is ever brought together; texts are hashed as a stream in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverspark.llm.common import cut, partitions

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
AFTER_INSERT = np.array([2, 2, 3, 2])
AFTER_KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by initial s, u, a, other
#: A row's code is its initial (0 to 3) + 4 x its fault; then the end of a conversation, and padding behind it.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
END, PAD = 16, 17
FAR = 1 << 40
LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)
BLOCK = 4096
SPACES = " \t\n\x0b\f\r"


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state of the arcs end, D, I, K, R by code and state; those that are not allowed cost FAR."""
    cost, to = np.full((5, 18, 4), FAR, dtype=np.int64), np.zeros((5, 18, 4), dtype=np.int64)
    to[:] = np.arange(4)
    to[2:3] = to[4:5] = AFTER_INSERT
    cost[2, :17] = 2
    cost[0, PAD] = 0
    cost[0, END, [0, 3]] = 0
    for code in range(16):
        initial, fault = code % 4, code // 4
        cost[1, code] = 3
        if fault in (FINE, TRUNCATED):
            cost[4, code] = 2 + (fault == TRUNCATED)
            may = AFTER_KEEP[initial] >= 0
            cost[3, code, may] = int(fault == TRUNCATED)
            to[3, code, may] = AFTER_KEEP[initial][may]
    return cost, to


COST, TO = _arcs()


def distances(codes: np.ndarray, ends: np.ndarray, all_places: bool = True) -> np.ndarray:
    """Least cost from each place and state to the end; codes (blocks, length), ends (blocks, 4)."""
    blocks, length = codes.shape
    now = ends
    kept = np.empty((blocks, length + 1 if all_places else 1, 4), dtype=np.int64)
    kept[:, -1] = now
    for at in range(length - 1, -1, -1):
        c = codes[:, at]
        best = np.min([COST[k][c] + np.take_along_axis(now, TO[k][c], 1) for k in (0, 1, 3, 4)], axis=0)
        put = COST[2][c]
        best = np.minimum(best, best[:, AFTER_INSERT] + put)
        now = np.minimum(best, best[:, AFTER_INSERT] + put)  # never are more than two insertions in a row cheapest
        kept[:, at if all_places else 0] = now
    return kept


def least_paths(codes: np.ndarray, dist: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The ASCII-least audits of cheapest paths from (block, first place, state), and the states that they end in."""
    blocks, length = codes.shape
    node = np.arange(blocks * (length + 1) * 4).reshape(blocks, length + 1, 4)
    ok, target = np.zeros((5, *node.shape), dtype=bool), np.repeat(node[None], 5, axis=0)
    for k in range(5):
        state = TO[k][codes]
        ahead = (node[:, :-1] if k == 2 else node[:, 1:])[:, :, :1] + state
        to = np.take_along_axis(dist[:, :-1] if k == 2 else dist[:, 1:], state, 2)
        target[k, :, :-1] = ahead
        ok[k, :, :-1] = (dist[:, :-1] < FAR) & (dist[:, :-1] == COST[k][codes] + to)
    ok, target = ok.reshape(5, -1), target.reshape(5, -1)
    label = np.where(ok.any(axis=0), ok.argmax(axis=0), 0)
    rank, ahead, steps = label, np.take_along_axis(target, label[None], 0)[0], 1
    while True:
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead], return_inverse=True)[1]
        further = ahead[ahead]
        steps *= 2
        if (further == ahead).all():
            break
        ahead = further
    top = int(rank.max()) + 2
    key = np.where(ok, np.arange(5)[:, None] * top + rank[target], 5 * top)
    arc = key.argmin(axis=0)
    label = np.where(ok.any(axis=0), arc, 0)
    ahead = np.where(ok.any(axis=0), np.take_along_axis(target, arc[None], 0)[0], np.arange(ok.shape[1]))
    path = starts[:, None]
    while path.shape[1] < steps:
        path = np.hstack([path, ahead[path]])
        ahead = ahead[ahead]
    return [row.tobytes().rstrip(b"\0") for row in LETTERS[label[path]]], ahead[path[:, -1]] % 4


def audits(many: list[np.ndarray], nodes: int = 1 << 19) -> list[tuple[int, bytes]]:
    """Cost and audit of each conversation of codes; conversations of like length are ranked together."""
    out: list[tuple[int, bytes]] = [(0, b"")] * len(many)
    classes: dict[int, list[int]] = {}
    for i, codes in enumerate(many):
        classes.setdefault(len(codes).bit_length(), []).append(i)
    for bits, members in classes.items():
        length = (1 << bits) + 1
        step = max(1, nodes // (4 * length))
        for some in (members[i : i + step] for i in range(0, len(members), step)):
            codes = np.full((len(some), length), PAD)
            for row, i in enumerate(some):
                codes[row, : len(many[i])] = many[i]
                codes[row, len(many[i])] = END
            dist = distances(codes, np.zeros((len(some), 4), dtype=np.int64))
            found, _ = least_paths(codes, dist, np.arange(len(some)) * (length + 1) * 4)
            for i, cost, audit in zip(some, dist[:, 0, 0].tolist(), found, strict=True):
                out[i] = (cost, audit)
    return out


def audit_long(blocks: list[np.ndarray], together: int = 32) -> tuple[int, list[bytes], list[int]]:
    """Cost, audit pieces and states before them for one conversation in blocks; nodes of few blocks exist at a time."""
    blocks = [*blocks[:-1], np.append(blocks[-1], END)]
    length = max(map(len, blocks))
    codes = np.full((len(blocks), length), PAD)
    for row, b in enumerate(blocks):
        codes[row, : len(b)] = b
    ends = np.zeros((len(blocks), 4), dtype=np.int64)
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    some = range(0, len(blocks), together)
    matrices = np.concatenate([distances(np.repeat(codes[i : i + together], 4, axis=0), np.tile(unit, (len(codes[i : i + together]), 1)), False) for i in some])
    matrices = matrices.reshape(len(blocks), 4, 4)  # block, last state, first state
    for b in range(len(blocks) - 1, 0, -1):
        ends[b - 1] = np.minimum(FAR, (matrices[b] + ends[b][:, None]).min(axis=0))
    pieces, states, state, cost = [], [], 0, 0
    for i in some:
        part = codes[i : i + together]
        dist = distances(part, ends[i : i + together])
        cost = int(dist[0, 0, 0]) if i == 0 else cost
        first = (np.arange(len(part)) * (length + 1) * 4)[:, None] + np.arange(4)
        found, last = least_paths(part, dist, first.ravel())
        for b in range(len(part)):
            states.append(state)
            pieces.append(found[4 * b + state])
            state = int(last[4 * b + state])
    return cost, pieces, states


def _illegal(initials: np.ndarray) -> int:
    a, b = initials[:-1], initials[1:]
    return int(len(a) - np.sum(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))))


def _turns(audit: bytes, initials: list[int]) -> list[int]:
    """The turns after the edits: 4 x row + 0 (kept), 1 (as user), 2 (as assistant), and -1, -2 for those put in."""
    out, state, row = [], 0, 0
    for edit in audit:
        if edit == 73:  # I
            state = int(AFTER_INSERT[state])
            out.append(1 - state)
            continue
        if edit == 75:  # K
            state = int(AFTER_KEEP[initials[row]][state])
            out.append(4 * row)
        elif edit == 82:  # R
            state = int(AFTER_INSERT[state])
            out.append(4 * row + state - 1)
        row += 1
    return out


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
REPAIR = T.StructType([*[T.StructField(n, T.LongType()) for n in COUNTS], T.StructField("audit", T.StringType()), T.StructField("turns", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(REPAIR)
def _repair(codes: pa.Array, keys: pa.Array) -> pa.Array:
    """Codes without duplicates, and keys equal for equal role and text, to counts, cost, audit and turns."""
    many, faults = [], []
    for i in range(len(codes)):
        own = np.array(codes[i].values.to_numpy(zero_copy_only=False), dtype=np.int64)
        seen: set[bytes] = set()
        for row, key in enumerate(keys[i].as_py()):
            if key in seen and own[row] // 4 != BLANK:
                own[row] = own[row] % 4 + 4 * DUPLICATE
            seen.add(key)
        many.append(own)
        faults.append(np.bincount(own // 4, minlength=4).tolist())
    rows = []
    for own, fault, (cost, audit) in zip(many, faults, audits(many), strict=True):
        turns = _turns(audit, (own % 4).tolist())
        rows.append({"blank": fault[BLANK], "duplicate": fault[DUPLICATE], "truncated": fault[TRUNCATED], "illegal": _illegal(own % 4) if len(own) else 0, "cost": cost, "audit": audit.decode(), "turns": turns})
    return pa.array(rows, pa.struct([*[(n, pa.int64()) for n in COUNTS], ("audit", pa.string()), ("turns", pa.list_(pa.int32()))]))


def _gaps(low: Column, high: Column, distinct: Column) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    return F.coalesce((wide(high) - wide(low) + 1 - distinct).try_cast("bigint"), F.lit(0).cast("bigint"))


def _flagged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, known (has a turn), turn, role, text, code without duplicates, and key: equal for equal role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).isNotNull().alias("known"), F.col(turn).cast("bigint").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    key = F.unhex(F.substring(F.sha2(F.concat(F.sha2("role", 256), "text"), 256), 1, 32))
    return rows.withColumns({"code": (kind + 4 * fault).cast("int"), "key": key})


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _short(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("known", "turn", "role", "text", "code", "key"))).alias("rows"))
    found = grouped.select("conv", "rows", _repair(F.col("rows.code"), F.col("rows.key")).alias("r"))
    own = lambda t: F.element_at("rows", F.floor(t / 4).cast("int") + 1)
    role = lambda t: F.when(t % 4 == 1, "user").when(t % 4 == 2, "assistant").otherwise(own(t)["role"])
    line = lambda t: F.when(t == -1, "user:").when(t == -2, "assistant:").otherwise(F.concat(role(t), F.lit(":"), own(t)["text"]))
    turns = F.array_compact(F.col("rows.turn"))
    return found.select(
        "conv",
        _gaps(F.array_min(turns), F.array_max(turns), F.size(F.array_distinct(turns))).alias("gaps"),
        *[F.col("r")[c].alias(c) for c in SUMMARY[1:-1]],
        F.sha2(F.array_join(F.transform(F.col("r.turns"), line), "\n"), 256).alias("repaired_sha256"),
    )


def _solve(table: pa.Table) -> pa.Table:
    """Blocks of one long conversation to audit pieces; what the whole conversation has goes with its first block."""
    table = table.sort_by("place")
    blocks = [np.frombuffer(c.encode(), dtype=np.uint8).astype(np.int64) - 97 for c in table["codes"].to_pylist()]
    cost, pieces, states = audit_long(blocks)
    fault = np.sum([np.bincount(b // 4, minlength=4) for b in blocks], axis=0).tolist()
    low, high = table["low"].to_pylist(), table["high"].to_pylist()
    last, shared = None, 0
    for a, b in zip(low, high, strict=True):
        shared += a is not None and a == last
        last = b if b is not None else last
    known = [x for x in (*low, *high) if x is not None]
    gaps = max(known) - min(known) + 1 - (sum(table["distinct"].to_pylist()) - shared) if known else 0
    whole = {"gaps": gaps, "blank": fault[BLANK], "duplicate": fault[DUPLICATE], "truncated": fault[TRUNCATED], "illegal": _illegal(np.concatenate(blocks) % 4), "cost": cost, "audit": b"".join(pieces).decode()}
    first = lambda v: [v, *[None] * (len(blocks) - 1)]
    columns = {"conv": table["conv"], "place": table["place"], "piece": [p.decode() for p in pieces], "state": pa.array(states, pa.int32())}
    return pa.table(columns | {k: pa.array(first(v), pa.string() if k == "audit" else pa.int64()) for k, v in whole.items()})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, role, text and edits of rows in order to conv and the hash of what is left, holding one hash at a time."""
    begun, conv, state, empty, sha = False, None, 0, True, hashlib.sha256()
    schema = None

    def line(role: str, text: str) -> None:
        nonlocal empty
        sha.update(("" if empty else "\n").encode() + role.encode() + b":" + text.encode())
        empty = False

    for batch in batches:
        schema = pa.schema([batch.schema.field(0), ("repaired_sha256", pa.string())])
        for c, role, text, edits in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if begun and c != conv:
                yield pa.RecordBatch.from_arrays([pa.array([conv], schema.field(0).type), pa.array([sha.hexdigest()])], schema=schema)
                state, empty, sha = 0, True, hashlib.sha256()
            begun, conv = True, c
            for edit in edits:
                if edit == "K":
                    state = int(AFTER_KEEP["sua".find(role[:1])][state])
                    line(role, text)
                elif edit != "D":
                    state = int(AFTER_INSERT[state])
                    line("user" if state == 2 else "assistant", text if edit == "R" else "")
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([conv], schema.field(0).type), pa.array([sha.hexdigest()])], schema=schema)


def _long(rows: DataFrame) -> DataFrame:
    """As ``_short``, with no group of rows in one task: places in order come from a range exchange."""
    order = ["conv", "known", "turn", "role"]
    placed = rows.repartitionByRange(partitions(rows.sparkSession), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    placed = cut(placed.withColumn("place", F.monotonically_increasing_id()))
    firsts = placed.groupBy("conv", "key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    blank = F.floor(F.col("code") / 4) == BLANK
    code = F.when(blank | F.col("first"), F.col("code")).otherwise(F.col("code") % 4 + 4 * DUPLICATE)
    coded = placed.select("conv", "place", "turn", "code").join(firsts, "place", "left").withColumn("code", code.cast("int"))
    block = F.floor(F.col("place") / BLOCK).alias("block")  # places of a partition start at a multiple of it
    letters = F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda r: F.char(97 + r["code"]))
    blocks = coded.groupBy("conv", block).agg(F.min("place").alias("place"), F.array_join(letters, "").alias("codes"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("bigint").alias("distinct"))
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, place bigint, piece string, state int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    solved = cut(blocks.drop("block").groupBy("conv").applyInArrow(_solve, schema))
    edits = solved.select("place", F.posexplode(F.regexp_extract_all("piece", F.lit(r"(I*[DKR](?:I+\z)?)"))).alias("at", "edits")).select((F.col("place") + F.col("at")).alias("place"), "edits")
    text = F.when(F.col("edits").endswith("D"), "").otherwise(F.col("text"))
    texts = placed.select("conv", "place", "role", "text").join(edits, "place").withColumn("text", text)
    ordered = texts.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "role", "text", "edits")
    hashes = ordered.mapInArrow(_hashed, f"conv {kind}, repaired_sha256 string")
    whole = solved.filter("cost is not null").drop("place", "piece", "state")
    return whole.join(hashes, whole["conv"].eqNullSafe(hashes["conv"])).select(whole["conv"], *SUMMARY)


def repair_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_rows: int = 512, most_bytes: int = 1 << 24
) -> DataFrame:
    """A row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Edits: keep costs 0, another role (user, assistant) 2, delete 3 (blank and repeated rows must go), a turn without
    text put in 2; a row that stays and does not end in ``.``, ``!`` or ``?`` adds 1.  Of cheapest audits the ASCII-least
    counts.  Rows are in order of turn, nulls first; rows of one turn by role and text.  A null role or text is one
    space, rows with a null id are one conversation, repeated rows are duplicates, an empty table gives no rows, and
    other columns are not read.  Conversations of more than ``most_rows`` rows or ``most_bytes`` bytes are dealt out by
    blocks, with the same results; the audit's letters, as many as the result's row has, are all that one task holds of
    such a conversation, and its text is hashed as a stream, since a hash of the whole has to follow its order.
    """
    rows = _flagged(df, conv, turn, role, text)
    sizes = df.groupBy(F.col(conv).alias("conv")).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text).cast("string"))).alias("bytes"))
    long = cut(sizes.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select("conv"))
    if long.isEmpty():
        out = _short(rows)
    else:
        same = rows["conv"].eqNullSafe(long["conv"])
        out = _short(rows.join(long, same, "left_anti")).unionByName(_long(rows.join(long, same, "left_semi")))
    return out.withColumnRenamed("conv", conv)


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults by crc32 of ``conv:turn`` modulo 20: 0 dropped, 1 emptied, 2 without ``.!?``, 3 twice, 4 as user.

    Nulls read as one space there and in role and text; other columns go.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    rows = df.select(conv, turn, space(role).alias(role), space(text).alias(text), fault.cast("int").alias("_fault")).filter("_fault <> 0")
    at = F.col("_fault")
    rows = rows.withColumns({text: F.when(at == 1, "").when(at == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)), role: F.when(at == 4, "user").otherwise(F.col(role))})
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(at == 3, 2).otherwise(1)))).drop("_fault", "_copy")
