"""Removal of byte strings that an earlier document holds, by hash-compared suffix sorting.

Every string of ``least`` bytes names one of its 16-byte substrings, that of least hash, as its anchor.  Equal strings
have equal anchors at equal places, so only places whose anchor another document has too need a look:

1. each home (a group of documents) sends the distinct hashes of its anchors, by hash, and learns which are shared;
2. it sends the distinct contexts of the shared ones (all strings with that anchor lie in one short context), with the
   least document that has each, so that a passage of very many documents is sent once a home;
3. where an anchor has several contexts, the suffixes of its contexts that start a string are sorted, save those whose
   hash occurs once.  Two suffixes are compared by their common extension, found by binary search over prefix polynomial
   hashes, within a mergesort whose equal results are verified byte by byte; classes of equal strings give the least
   document that has them.  An anchor with one context leaves nothing to sort;
4. the homes get the answers and drop the bytes of strings which a smaller document has.

An anchor that may have more than ``crowd`` contexts isn't sent as it is: each of its contexts is cut to runs of at most
``RUN`` strings, and a run goes by all the bytes that its strings share.  Two runs of that kind differ in two bytes at most,
so no group of contexts grows with the corpus by more than a row a home and kind, whatever passage is frequent.

Contexts are taken for equal, at home and where they meet, only after their bytes were compared.  Texts move once, to
their homes; that exchange serves all three passes over them.  Homes and buckets hold about ``home_bytes`` of the input.

What homes and buckets send each other goes in parcels.  A sender makes ``FAN`` at most, whatever the number of
receivers: beyond it parcels go to ranges of receivers first, where those of as many senders are opened and dealt on, in
as many hops as it takes.  So parcels are linear in the input, and an opened range holds no more than a home.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverspark.llm.common import partitions, released, text_of

GRAM = 16
RUN = 2
#: So many parcels a task sends at most.
FAN = 2048
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5], dtype=np.uint64)
_CHUNK = 1 << 18
_BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _prefix_hashes(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) times the base to its place, modulo 2**64, before each place."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


_UP = _powers(_BASE, _CHUNK + 4096)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 4096)
LAST = (1 << 63) - 1
WHOLE = np.uint64((1 << 64) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    load = lambda at: np.ndarray(shape=(n,), dtype="<u8", buffer=data, offset=at, strides=(1,))
    h = load(0) * _C[0]
    h ^= h >> np.uint64(29)
    h = (h + load(8)) * _C[1]
    h ^= h >> np.uint64(32)
    h *= _C[2]
    return h ^ (h >> np.uint64(29))


def contexts(data: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of strings with one anchor: its hash, the first string, the last string, the context's hash, the anchor.

    ``data`` holds documents one after another, ``ends`` their ends; strings never cross them.
    """
    width = least - GRAM + 1
    for start in range(0, len(data) - least + 1, _CHUNK):
        part = data[start : start + _CHUNK + least - 1]
        h = gram_hashes(part)
        low = (h >> np.uint64(22) << np.uint64(22)) | np.arange(len(h), dtype=np.uint64)  # ties: the first
        step = 1
        while 2 * step <= width:
            low = np.minimum(low[: len(low) - step], low[step:])
            step *= 2
        if width > step:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        anchor = (low & np.uint64((1 << 22) - 1)).astype(np.int64)
        n = len(anchor)
        inside = np.ones(n + 1, dtype=np.int8)
        for e in ends[np.searchsorted(ends, start, side="right") : np.searchsorted(ends, start + n + least, side="right")]:
            inside[max(0, e - start - least + 1) : max(0, e - start)] = 0  # strings that would cross a document's end
        inside[n] = 0
        opens = np.flatnonzero((inside[:n] == 1) & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[: n - 1] == 0)]))
        if not len(opens):
            continue
        changes = np.append(np.flatnonzero(np.concatenate([anchor[1:] != anchor[:-1], [True]]) | (inside[1:] == 0)), n - 1)
        closes = changes[np.searchsorted(changes, opens)]
        sums = _prefix_hashes(part, _UP)
        whole = (sums[closes + least] - sums[opens]) * _DOWN[opens]
        yield h[anchor[opens]], opens + start, closes + start, whole, anchor[opens] + start


def runs(data: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts cut to runs of ``RUN`` strings by their distance from the anchor.

    For each run: the number of its context, a key of the bytes that all its strings share, its first and last string and
    its hash.  Equal strings have equal anchors at equal distances, so they are in runs of one key.
    """
    low = (anchor - last) // RUN
    count = (anchor - first) // RUN - low + 1
    ctx = np.repeat(np.arange(len(key)), count)
    nth = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count) + low[ctx]
    high = anchor[ctx] - nth * RUN
    a, b = np.maximum(first[ctx], high - RUN + 1), np.minimum(last[ctx], high)
    shared = whole_hashes(data, high, np.full(len(ctx), least - RUN + 1))
    name = ((key[ctx] ^ (shared * _C[0])) + nth.astype(np.uint64) * _C[1]) * _C[2]
    return ctx, name ^ (name >> np.uint64(29)), a, b, whole_hashes(data, a, b - a + least)


def whole_hashes(text: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The contexts' hashes, as ``contexts`` gives them, from their places and lengths."""
    out = np.zeros(len(at), dtype=np.uint64)
    top = len(text) - 1
    for j in range(int(length.max(initial=0))):
        byte = text[np.minimum(at + j, top)].astype(np.uint64) + np.uint64(1)
        out += np.where(j < length, byte * _UP[j], np.uint64(0))
    return out


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes at a and b, so many of them, are equal."""
    out = np.empty(len(a), dtype=bool)
    top = len(text) - 1
    for start in range(0, len(a), 10_000):
        some = slice(start, start + 10_000)
        span = np.arange(int(length[some].max(initial=0)))
        x, y = text[np.minimum(a[some, None] + span, top)], text[np.minimum(b[some, None] + span, top)]
        out[some] = ((x == y) | (span >= length[some, None])).all(axis=1)
    return out


def verified_classes(text: np.ndarray, at: np.ndarray, length: np.ndarray, key: np.ndarray, whole: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the contexts in which equal ones follow each other, by ``last``, and where a class begins.

    Equal hashes propose a class; members whose bytes differ from its first one's get a class of their own.
    """
    version = np.zeros(len(key), dtype=np.int64)
    while True:
        order = np.lexsort((last, version, whole, key))
        k, w, v = key[order], whole[order], version[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1]) | (v[1:] != v[:-1])]) if len(k) else np.zeros(0, bool)
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else order
        other = np.flatnonzero(~new)
        one, two = first[other], order[other]
        differ = (length[one] != length[two]) | ~same_bytes(text, at[one], at[two], length[two])
        if not differ.any():
            return order, new
        version[two[differ]] += 1


class Suffixes:
    """Strings of ``least`` bytes of a text, compared through prefix polynomial hashes."""

    def __init__(self, text: np.ndarray, least: int):
        self.text, self.least = np.concatenate([text, np.zeros(least, np.uint8)]), least
        self.power = _powers(_BASE, len(text) + least + 1)
        self.sums = _prefix_hashes(self.text, self.power)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, at most ``least``; found by binary search on hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.least)
        pa_, pb_, sa, sb = self.power[b], self.power[a], self.sums[a], self.sums[b]
        for _ in range(self.least.bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.sums[a + mid] - sa) * pa_ == (self.sums[b + mid] - sb) * pb_
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1; strings that seem equal, or whose next bytes do, are verified byte by byte."""
        n = self.common(a, b)
        x, y = self.text[a + np.minimum(n, self.least - 1)].astype(np.int16), self.text[b + np.minimum(n, self.least - 1)].astype(np.int16)
        out = np.where(n < self.least, np.sign(x - y), 0).astype(np.int8)
        check = np.flatnonzero(out == 0)
        for some in np.array_split(check, len(check) // 200_000 + 1):
            if len(some):
                span = np.arange(self.least)
                d = self.text[a[some][:, None] + span].astype(np.int16) - self.text[b[some][:, None] + span]
                first = (d != 0).argmax(axis=1)
                out[some] = np.sign(d[np.arange(len(some)), first])
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes ``at`` within the groups (equal values side by side): a mergesort of all groups at once."""
        order = np.arange(len(at))
        opens = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else np.zeros(0, int)
        sizes = np.diff(np.append(opens, len(at)))
        begin, size = np.repeat(opens, sizes), np.repeat(sizes, sizes)
        place = np.arange(len(at)) - begin
        run = 1
        while run < sizes.max(initial=0):
            live = np.flatnonzero(size > run)
            b, p, s = begin[live], place[live], size[live]
            mine = p // run
            other = mine ^ 1
            low, high = np.minimum(other * run, s), np.minimum(other * run + run, s)
            first, left = low.copy(), mine % 2 == 0
            me = at[order[live]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                c = self.compare(at[order[b[open_] + mid]], me[open_])
                before = (c < 0) | ((c == 0) & ~left[open_])  # equal ones of the left run come first
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            target = b + (mine // 2) * 2 * run + p % run + (low - first)
            merged = order.copy()
            merged[target] = order[live]
            order = merged
            run *= 2
        return order


def least_documents(text: np.ndarray, offset: np.ndarray, strings: np.ndarray, key: np.ndarray, lead: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For every string of every context the least document that has it; all arrays but ``text`` are by context.

    A context starts at ``offset`` in the text and has ``strings`` strings; its anchor lies ``lead`` bytes from its start.
    """
    total = int(strings.sum())
    ctx = np.repeat(np.arange(len(strings)), strings)
    nth = np.arange(total) - np.repeat(np.cumsum(strings) - strings, strings)
    best = doc[ctx]
    # equal strings have one anchor at one distance
    distance = lead[ctx] - nth
    order = np.lexsort((distance, key[ctx]))
    k, d = key[ctx][order], distance[order]
    group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (d[1:] != d[:-1]))]) if total else np.zeros(0, int)
    several = np.bincount(group)[group] > 1 if total else np.zeros(0, bool)
    order, group = order[several], group[several]
    if not len(order):
        return best
    suffixes = Suffixes(text, least)
    at = offset[ctx[order]] + nth[order]
    # a string whose hash is the only one of its kind has no equal
    found = (suffixes.sums[at + least] - suffixes.sums[at]) * suffixes.power[len(text) - at]
    alike = np.lexsort((found, group))
    f, g = found[alike], group[alike]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (g[1:] != g[:-1])])
    kind = np.cumsum(new) - 1
    more = np.sort(alike[np.bincount(kind)[kind] > 1])
    order, group, at = order[more], group[more], at[more]
    if not len(order):
        return best
    sorted_ = suffixes.sort(at, group)
    order, at, group = order[sorted_], at[sorted_], group[sorted_]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (suffixes.compare(at[:-1], at[1:]) != 0)])
    found = np.minimum.reduceat(best[order], np.flatnonzero(new))
    best[order] = found[np.cumsum(new) - 1]
    return best


def _table(columns: dict[str, tuple]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _home(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, data, ends and ids of a home's documents; the order is the same in every pass."""
    texts = table["text"].combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    ids = table["id"].to_numpy(zero_copy_only=False).astype(np.int64)
    raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
    order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
    data = np.frombuffer(b"".join([raw[i] for i in order]), dtype=np.uint8)
    ends = np.cumsum([len(raw[i]) for i in order])
    return np.array(order, dtype=np.int64), data, ends, ids[order]


def _join(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The blobs of a column as one array, and each blob's number of values."""
    raw = [b.as_buffer() for b in column.combine_chunks()]
    parts = [np.frombuffer(b, dtype=kind) for b in raw]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], dtype=np.int64)


def _told(values: np.ndarray) -> bytes:
    """Whole numbers as pairs: a value and how many of it follow each other."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return np.stack([values[at], np.diff(np.append(at, len(values)))], axis=1).astype("<u4").tobytes()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers that ``_told`` put down."""
    pairs = _join(column, "<u4")[0].reshape(-1, 2)
    return np.repeat(pairs[:, 0].astype(np.int64), pairs[:, 1])


def hops(n: int, fan: int) -> list[tuple[int, int]]:
    """For each hop between n senders and n receivers, how many receivers a parcel is for and how many senders meet.

    Each hop multiplies the senders that meet by what it divides the receivers by, at most ``fan``, so that what meets
    is never more than one sender's share.
    """
    count, each = 1, n
    while each > fan:
        count += 1
        each = next(f for f in range(2, each + 1) if f**count >= n)
    return [(each ** (count - i - 1), each ** (i + 1)) for i in range(count)]


def parcels(items: dict[str, np.ndarray], dest: np.ndarray, source: np.ndarray, hop: tuple[int, int], strings: tuple | None = None) -> pa.Table:
    """One row for each range of receivers: the items, their receivers and their senders, which meet in one range too.

    ``strings``, if given, are a text and each item's place and length in it.
    """
    width, span = hop
    order = np.argsort(dest, kind="stable")
    to = dest[order] // width
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
    some = [order[a:b] for a, b in zip(at, np.append(at[1:], len(to)), strict=False)]
    columns = {"to": (to[at], pa.int32()), "via": ([source[x[0]] // span for x in some], pa.int32())}
    columns |= {k: ([_told(v[x]) for x in some], pa.binary()) for k, v in (("dests", dest), ("sources", source))}
    columns |= {k: ([v[x].tobytes() for x in some], pa.binary()) for k, v in items.items()}
    if strings:
        text, place, length = strings
        cut = lambda x: b"".join([text[p : p + n] for p, n in zip(place[x].tolist(), length[x].tolist(), strict=True)])
        columns["text"] = ([zlib.compress(cut(x), 1) for x in some], pa.binary())
    return _table(columns)


def _texts(column: pa.ChunkedArray) -> bytes:
    return b"".join([zlib.decompress(b.as_buffer()) for b in column.combine_chunks()])


def _fields(kinds: dict[str, str], text: bool) -> str:
    return "to int, via int, dests binary, sources binary, " + ", ".join(f"{k} binary" for k in [*kinds, *(["text"] if text else [])])


def _dealt_on(sent: DataFrame, kinds: dict[str, str], way: list[tuple[int, int]], parts: int, least: int) -> DataFrame:
    """The parcels of the first hop as those of the last one, by receiver; ``kinds`` are the items' types.

    If items have a text, ``strings`` says by how many bytes it is longer than ``least`` less one.
    """
    text = "text" in sent.columns
    for hop in way[1:]:

        def opened(group: pa.Table, hop: tuple[int, int] = hop) -> pa.Table:
            items = {k: _join(group[k], kind)[0] for k, kind in kinds.items()}
            strings = None
            if text:
                length = items["strings"].astype(np.int64) + least - 1
                strings = (_texts(group["text"]), np.cumsum(length) - length, length)
            return parcels(items, _numbers(group["dests"]), _numbers(group["sources"]), hop, strings)

        sent = sent.repartition(parts, "to", "via").groupBy("to", "via").applyInArrow(_tidy(opened), _fields(kinds, text))
    return sent.repartition(parts, "to")


def _tidy(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run``, with the memory of the group before it given back first."""

    def wrapped(group: pa.Table) -> pa.Table:
        released()
        return run(group)

    return wrapped


def _tidy2(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def wrapped(one: pa.Table, two: pa.Table) -> pa.Table:
        released()
        return run(one, two)

    return wrapped


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, whole_characters: bool = False, home_bytes: int = 12 << 20, crowd: int = 1 << 13, fan: int = FAN
) -> DataFrame:
    """The input's columns plus n_bytes, n_removed, spans (start and end bytes of maximal removed runs) and kept (bytes).

    Anchors with more than about ``crowd`` contexts are split; results don't depend on it, nor on ``home_bytes``
    or ``fan`` (the parcels that a task sends at most).
    A byte goes if a string of ``least`` bytes that covers it also starts in a row with a smaller id; strings are
    judged on the input and never cross texts.  Null texts count as empty.  Rows that share an id don't remove each
    other; a null id counts as larger than all others.  With ``whole_characters`` a character goes if any of its bytes
    does, so that what is kept is text.  The order of rows doesn't matter and an empty table gives no
    rows.  A text is never cut, so a home holds ``home_bytes`` or one longer text.  Input columns that are called
    n_bytes, n_removed, spans or kept are replaced.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    parts = buckets = homes = max(partitions(spark), -(-size // home_bytes))
    added = ("n_bytes", "n_removed", "spans", "kept")
    own = [c for c in docs.columns if c not in added]
    beside = F.struct(*[c for c in own if c != text_col]) if len(own) > 1 else F.struct(F.lit(0).alias("none"))
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    base = docs.select(number.alias("id"), F.col(text_col).cast("binary").alias("text"), beside.alias("row"))
    base = base.withColumn("home", F.pmod(F.xxhash64("id", text_of("text").cast("binary")), F.lit(homes)).cast("int"))
    texts = base.repartition(parts, "home")
    way = hops(homes, fan)

    def hashed(home: pa.Table) -> pa.Table:
        _, data, ends, _ = _home(home)
        keys, owners, hashes = [], [], []
        for key, first, _, whole, _ in contexts(data, ends, least):
            keys.append(key)
            owners.append(np.searchsorted(ends, first, side="right"))
            hashes.append(whole)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        whole = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.lexsort((whole, key))
        key, owner, whole = key[order], owner[order], whole[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        several = (np.maximum.reduceat(owner, at) != np.minimum.reduceat(owner, at)) if len(at) else np.zeros(0, bool)
        kinds = np.add.reduceat((new | np.concatenate([[True], whole[1:] != whole[:-1]])).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        # one byte: whether several documents have the anchor, and the power of two that its contexts reach
        several = 2 * np.frexp(kinds)[1] + several
        key = key[at]
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        return parcels({"keys": key.astype("<u4"), "several": several.astype("u1")}, bucket, np.full(len(key), home["home"][0].as_py()), way[0])

    kinds = {"keys": "<u4", "several": "u1"}
    sent = _dealt_on(texts.groupBy("home").applyInArrow(_tidy(hashed), _fields(kinds, False)), kinds, way, parts, least)

    def shared(group: pa.Table) -> pa.Table:
        keys, several, source = _join(group["keys"], "<u4")[0], _join(group["several"], "u1")[0], _numbers(group["sources"])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        cls = np.cumsum(new) - 1
        hit = (np.bincount(cls) > 1) | (np.bincount(cls, several[order] & 1) > 0) if len(k) else np.zeros(0, bool)
        full = np.bincount(cls, np.ldexp(0.5, several[order] >> 1)) > crowd if len(k) else np.zeros(0, bool)
        chosen, cls = order[hit[cls]], cls[hit[cls]]
        return parcels({"keys": keys[chosen], "crowded": full[cls].astype("u1")}, source[chosen], np.full(len(chosen), group["to"][0].as_py()), way[0])

    kinds = {"keys": "<u4", "crowded": "u1"}
    known = _dealt_on(sent.groupBy("to").applyInArrow(_tidy(shared), _fields(kinds, False)), kinds, way, parts, least)

    contexts_ = {"key": "<u8", "base": "<u8", "at": "<u4", "strings": "u1", "low": "<i8", "high": "<i8"}

    def asked(home: pa.Table, cand: pa.Table) -> pa.Table:
        if not home.num_rows or not cand.num_rows:
            empty = {k: np.zeros(0, kind) for k, kind in contexts_.items()}
            return parcels(empty, np.zeros(0, int), np.zeros(0, int), way[0], (b"", np.zeros(0, int), np.zeros(0, int)))
        _, data, ends, ids = _home(home)
        mark = lambda bucket, low: (bucket.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
        wanted = mark(_numbers(cand["sources"]), _join(cand["keys"], "<u4")[0])
        full = wanted[_join(cand["crowded"], "u1")[0] > 0]
        wanted = np.sort(wanted)
        got = [[], [], [], [], [], []]
        for key, first, last, whole, anchor in contexts(data, ends, least):
            bucket = (key >> np.uint64(32)) % np.uint64(buckets)
            m = mark(bucket, key & np.uint64(0xFFFFFFFF))
            at = np.minimum(np.searchsorted(wanted, m), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == m) if len(wanted) else np.zeros(0, int)
            for store, values in zip(got, (key[hit], first[hit], last[hit], whole[hit], ids[np.searchsorted(ends, first[hit], side="right")], anchor[hit]), strict=True):
                store.append(values)
        key, first, last, whole, doc, anchor = (np.concatenate(g) if g else np.zeros(0, np.int64) for g in got)
        # one of each distinct context, with the least and the greatest document that has it here
        order, new = verified_classes(data, first, last - first + least, key, whole, doc)
        key, first, last, doc, anchor = key[order], first[order], last[order], doc[order], anchor[order]
        at = np.flatnonzero(new)
        high = doc[np.append(at[1:], len(doc)) - 1] if len(at) else doc
        key, first, last, doc, anchor = key[at], first[at], last[at], doc[at], anchor[at]
        base = np.full(len(key), WHOLE)
        packed = np.zeros(len(key), bool)
        if len(full):
            packed = np.isin(mark((key >> np.uint64(32)) % np.uint64(buckets), key & np.uint64(0xFFFFFFFF)), full) & (key != WHOLE)
        if packed.any():
            own, rest = np.flatnonzero(packed), ~packed
            ctx, name, a, b, whole = runs(data, key[own], first[own], last[own], anchor[own], least)
            order, new = verified_classes(data, a, b - a + least, name, whole, doc[own[ctx]])
            ctx, at = own[ctx[order]], np.flatnonzero(new)
            ends_ = np.maximum.reduceat(high[ctx], at)
            base = np.concatenate([base[rest], key[ctx[at]]])
            doc, high = np.concatenate([doc[rest], doc[ctx[at]]]), np.concatenate([high[rest], ends_])
            key, first, last = np.concatenate([key[rest], name[order[at]]]), np.concatenate([first[rest], a[order[at]]]), np.concatenate([last[rest], b[order[at]]])
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        items = {"key": key, "base": base, "at": first.astype("<u4"), "strings": (last - first + 1).astype("u1"), "low": doc, "high": high}
        return parcels(items, bucket, np.full(len(key), home["home"][0].as_py()), way[0], (data.tobytes(), first, last - first + least))

    asking = texts.groupBy("home").cogroup(known.groupBy("to")).applyInArrow(_tidy2(asked), _fields(contexts_, True))
    asking = _dealt_on(asking, contexts_, way, parts, least)

    def answered(group: pa.Table) -> pa.Table:
        key = _join(group["key"], "<u8")[0]
        base, _ = _join(group["base"], "<u8")  # the hash of a run's anchor, WHOLE for whole contexts
        place, _ = _join(group["at"], "<u4")
        strings = _join(group["strings"], "u1")[0].astype(np.int64)
        low, high = _join(group["low"], "<i8")[0], _join(group["high"], "<i8")[0]
        text = np.frombuffer(_texts(group["text"]), dtype=np.uint8)
        source = _numbers(group["sources"])
        length = strings + least - 1
        offset = np.cumsum(length) - length
        # contexts that are equal here and there count once
        order, new = verified_classes(text, offset, length, key, whole_hashes(text, offset, length), low)
        at, cls = np.flatnonzero(new), np.empty(len(order), dtype=np.int64)
        cls[order] = np.cumsum(new) - 1
        one = order[at]
        least_doc = np.minimum.reduceat(low[order], at) if len(at) else low
        # an anchor with one context everywhere needs no sorting: all its strings have that context's documents
        unique = key[one]
        lone = np.concatenate([[True], unique[1:] != unique[:-1]]) & np.concatenate([unique[1:] != unique[:-1], [True]]) if len(one) else np.zeros(0, bool)
        many = np.flatnonzero(~lone)
        some = one[many]
        best = _in_slices(text, offset[some], strings[some], key[some], np.where(base[some] == WHOLE, key[some], base[some]), least_doc[many], least)
        # answers: runs of strings with one least document, for contexts where some document is larger
        begin = np.cumsum(strings[some]) - strings[some]
        ctx = np.repeat(np.arange(len(some)), strings[some])
        cut = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (best[1:] != best[:-1])])) if len(best) else np.zeros(0, int)
        close = np.append(cut[1:], len(best)) if len(best) else cut
        alone = np.flatnonzero(lone)
        owner = np.concatenate([many[ctx[cut]], alone])
        a = np.concatenate([cut - begin[ctx[cut]], np.zeros(len(alone), int)])
        b = np.concatenate([close - begin[ctx[cut]], strings[one[alone]]])
        who = np.concatenate([best[cut], least_doc[alone]])
        order = np.argsort(owner, kind="stable")
        owner, a, b, who = owner[order], a[order], b[order], who[order]
        per = np.bincount(owner, minlength=len(one))
        start = np.cumsum(per) - per
        rep = np.repeat(np.arange(len(key)), per[cls])
        run = np.arange(len(rep)) - np.repeat(np.cumsum(per[cls]) - per[cls], per[cls]) + start[cls[rep]]
        use = who[run] < high[rep]
        rep, run = rep[use], run[use]
        columns = {"key": key[rep], "base": base[rep], "at": place[rep], "strings": strings[rep].astype("u1"), "first": a[run].astype("u1"), "last": b[run].astype("u1"), "doc": who[run]}
        return parcels(columns, source[rep], np.full(len(rep), group["to"][0].as_py()), way[0])

    kinds = {"key": "<u8", "base": "<u8", "at": "<u4", "strings": "u1", "first": "u1", "last": "u1", "doc": "<i8"}
    answers = _dealt_on(asking.groupBy("to").applyInArrow(_tidy(answered), _fields(kinds, False)), kinds, way, parts, least)
    out_fields = T.StructType([base.schema["row"], base.schema["text"], *T.StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")])

    def removed(home: pa.Table, reply: pa.Table) -> pa.Table:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        if not home.num_rows:
            return pa.table({"row": home["row"], "text": home["text"], "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "spans": pa.array([], span), "kept": pa.array([], pa.binary())})
        order, data, ends, ids = _home(home)
        gone = np.zeros(len(data) + 1, dtype=np.int32)
        if reply.num_rows:
            key, place = _join(reply["key"], "<u8")[0], _join(reply["at"], "<u4")[0].astype(np.int64)
            length = _join(reply["strings"], "u1")[0].astype(np.int64) + least - 1
            whole = whole_hashes(data, place, length)
            a, b = _join(reply["first"], "u1")[0].astype(np.int64), _join(reply["last"], "u1")[0].astype(np.int64)
            who = _join(reply["doc"], "<i8")[0]
            mix = lambda k, w: k ^ (w * _C[0])
            name = mix(key, whole)
            full = np.unique(_join(reply["base"], "<u8")[0])
            full = full[full != WHOLE]
            sort = np.argsort(name, kind="stable")
            name, place, length, a, b, who = name[sort], place[sort], length[sort], a[sort], b[sort], who[sort]
            for k, first, last, w, anchor in contexts(data, ends, least):
                cut_up = np.flatnonzero(np.isin(k, full)) if len(full) else []
                if len(cut_up):
                    whole_ones = np.setdiff1d(np.arange(len(k)), cut_up, assume_unique=True)
                    _, *some = runs(data, k[cut_up], first[cut_up], last[cut_up], anchor[cut_up], least)
                    k, first, last, w = (np.concatenate([x[whole_ones], y]) for x, y in zip((k, first, last, w), some, strict=True))
                m = mix(k, w)
                lo, hi = np.searchsorted(name, m, side="left"), np.searchsorted(name, m, side="right")
                n = hi - lo
                rep = np.repeat(np.arange(len(k)), n)
                at = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + lo[rep]
                doc = ids[np.searchsorted(ends, first[rep], side="right")]
                use = (who[at] < doc) & (length[at] == (last - first + least)[rep])
                rep, at = rep[use], at[use]
                use = same_bytes(data, place[at], first[rep], length[at])
                rep, at = rep[use], at[use]
                np.add.at(gone, first[rep] + a[at], 1)
                np.add.at(gone, first[rep] + b[at] - 1 + least, -1)
        mask = np.cumsum(gone[:-1], out=gone[:-1]) > 0
        sizes, spans, kept, counts = [], [], [], []
        for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            m = mask[begin:end]
            if whole_characters and m.any():
                lead = np.flatnonzero((data[begin:end] & 0xC0) != 0x80)
                m = np.repeat(np.logical_or.reduceat(m, lead), np.diff(np.append(lead, len(m))))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            sizes.append(end - begin)
            counts.append(int(m.sum()))
            kept.append(data[begin:end][~m].tobytes())
        taken = home.select(["row", "text"]).take(pa.array(order))
        out = pa.table({"row": taken["row"], "text": taken["text"], "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(counts, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})
        return pa.Table.from_batches(out.to_batches(max_chunksize=256))  # Spark reads batch by batch

    out = texts.groupBy("home").cogroup(answers.groupBy("to")).applyInArrow(_tidy2(removed), out_fields)
    return out.select(*[(F.col("text").cast("string") if c == text_col else F.col("row").getField(c)).alias(c) for c in own], *added)


def _in_slices(text: np.ndarray, offset: np.ndarray, strings: np.ndarray, key: np.ndarray, base: np.ndarray, doc: np.ndarray, least: int, most: int = 400_000) -> np.ndarray:
    """``least_documents`` for contexts in order of their keys, with anchors' hashes ``base``, about ``most`` strings at a time; keys stay whole."""
    if not len(key):
        return doc
    before = np.cumsum(strings) - strings
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    piece = before[opens] // most
    cuts = np.append(opens[np.concatenate([[True], piece[1:] != piece[:-1]])], len(key))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        length = strings[a:b] + least - 1
        start = np.cumsum(length) - length
        own = text[np.repeat(offset[a:b] - start, length) + np.arange(int(length.sum()))]
        lead = _leads(own, start, strings[a:b], base[a:b], least)
        out.append(least_documents(own, start, strings[a:b], key[a:b], lead, doc[a:b], least))
    return np.concatenate(out)


def _leads(text: np.ndarray, offset: np.ndarray, strings: np.ndarray, key: np.ndarray, least: int) -> np.ndarray:
    """Where in its context each anchor lies: the first 16 bytes with the anchor's hash that every string covers."""
    lead = np.full(len(offset), -1, dtype=np.int64)
    if not len(text):
        return lead
    h = gram_hashes(np.concatenate([text, np.zeros(GRAM, np.uint8)]))
    for back in range(least - GRAM, -1, -1):
        # from the last string's start to the first string's end, earlier places win
        at = strings - 1 + (least - GRAM - back)
        ok = (lead < 0) & (at <= least - GRAM)
        same = ok & (h[np.minimum(offset + at, len(h) - 1)] == key)
        lead[same] = at[same]
    return lead

