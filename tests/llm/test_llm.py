"""Each operator against a plain version, on small tables with nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from coverspark.llm import bpe, common, components, exact_dedup, fingerprints, line_dedup, packing, quality, queries, sharding, simhash, suffix_dedup, warc  # noqa: E402

WORDS = "the of and to in that ble tion ing erst ouha thon ané für queso".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "x", "y", "zz"]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    """id and text: nulls, empties, repeats, a null id, near copies, one very long text."""
    rng = random.Random(4)
    base = ["\n".join(sentence(rng, 12) for _ in range(5)) for _ in range(12)]
    near = base[0].replace("the", "thee", 1)
    rows = list(enumerate([*base, base[0], base[0].replace("\n", " \t\n"), near, base[1] + "\n" + base[2], None, "", " \n ", "one", "One two", "É" * 40 + base[3]]))
    long = " ".join(sentence(rng, 10) for _ in range(4000))
    rows += [(100, long), (101, long[: len(long) // 2]), (103, base[5]), (103, base[5]), (None, base[6]), (104, "\u0000a\x1cb\x85c <|endoftext|> 😀")]
    return rows


CLASH = ("row", "home", "key", "kept", "keep_id", "size", "shard", "slot", "score", "fp", "part", "id", "host", "bad", "lines", "n_bytes", "digest", "recipe", "predicted", "n_lines")


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH} | {"source": F.when(F.col("doc_id") % 5 == 0, None).otherwise("s")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_fingerprints(docs, empty, texts, spark):
    got = fingerprints.compare_with_edits(docs).collect()
    order = sorted([(i, t or "") for i, t in texts], key=lambda r: -1 if r[0] is None else r[0])
    assert len(got) == len(order)
    following = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        following.setdefault((i, t), set()).add(t[: len(t) - len(t) // 4] + n[: len(t) // 4])
    for r in got:
        assert r["edited"] in following[r["doc_id"], r["text"]]
        assert (r["tree"]["root"] == r["edited_tree"]["root"]) == (r["text"] == r["edited"])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if r["text"] != r["edited"] and len(r["text"]) > 2000:
            assert r["near_edited"] > 0.5 and r["edited_sections"]
    roots = {}
    for r in fingerprints.fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert roots.setdefault(r["tree"]["root"], r["text"] or "") == (r["text"] or "")
    assert fingerprints.compare_with_edits(empty).count() == 0
    one = spark.createDataFrame([(7, "abcd efgh")], "doc_id long, text string")
    assert fingerprints.compare_with_edits(one).first()["edited"] == "abcd efab"


def plain_simhash(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    import xxhash

    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(nodes, linked):
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if linked(nodes[a], nodes[b]):
                parent[root(a)] = root(b)
    return [root(a) for a in range(len(nodes))]


def test_simhash(docs, empty, texts):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_simhash(t, 3) for _, t in texts]
    roots = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), r in zip(texts, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert got == {(i, f"{fp:016x}", least[r]) for (i, _), fp, r in zip(texts, fps, roots, strict=True)}
    assert simhash.near_duplicates(docs).count() == len(texts)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_find_every_component_also_of_split_groups(spark, radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre.tolist():
        for _ in range(120):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(s, s, None) for s in signed], "node long, fp long, wide binary")
    want = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= radius)
    for block in (2048, 4):
        found = {r["node"]: r["root"] for r in components.components(simhash.links(df, radius, block=block)).collect()}
        mine = [found.get(s, s) for s in signed]
        pairs = {(a, b) for a, b in zip(want, mine, strict=True)}
        assert len(pairs) == len(set(want)) == len(set(mine))


def test_simhash_where_a_third_share_a_cell_but_do_not_link(spark):
    """Swapped neighbours of equal parity leave all changes of distance as they are; finer references part them."""
    rng = random.Random(29)
    swaps = [(4 * b + k, 4 * b + k + 2) for b in range(16) for k in (0, 1)]
    one_of = lambda: sum(1 << rng.choice(pair) for pair in swaps)
    crowd = {one_of() for _ in range(1500)}
    some = sorted(crowd)[:20]
    crowd |= {x ^ (1 << a) ^ (1 << b) for x, (a, b) in zip(some, swaps, strict=False)} | {x ^ 1 for x in some[:5]}
    fps = sorted(crowd | {rng.getrandbits(64) for _ in range(3000)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    table = df.select(F.col("fp").alias("node"), F.struct("fp", simhash.pivots(F.col("fp")).alias("pivots")).alias("load"))
    keyed = table.select("node", F.explode(simhash.cells(F.col("load.pivots"), 2)).alias("grp"), F.lit(1).alias("w"))
    assert keyed.groupBy("grp").count().agg(F.max("count")).first()[0] >= 1500

    compared = spark.sparkContext.accumulator(0)
    near_of = simhash.near_bits(2)

    def counted(load):
        near = near_of(load)

        def run(one, left):
            compared.add(len(left))
            return near(one, left)

        return run

    finer = lambda load: simhash.fine_cells(load["fp"], 2)
    found = simhash.grouped_links(keyed, table, counted, 64, 1000, finer)
    assert compared.value < 4 * len(fps) * math.log2(len(fps))
    got = {r["node"]: r["root"] for r in components.components(found).collect()}
    values = np.array(fps, dtype=np.uint64)
    near = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2) if i < j]
    assert len(near) >= 20
    root = list(range(len(fps)))
    for i, j in near:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    groups: dict = {}
    for i, x in enumerate(fps):
        groups.setdefault(root[i], set()).add(simhash._signed(x))
    mine: dict = {}
    for x in fps:
        mine.setdefault(got.get(simhash._signed(x), simhash._signed(x)), set()).add(simhash._signed(x))
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


def test_near_copies(spark, docs, texts):
    rng = random.Random(1)
    base = [sentence(rng, 150) for _ in range(6)]
    edit = base[0].split()
    edit[70] = "changed"
    df = spark.createDataFrame(list(enumerate([*base, base[1], " ".join(edit)])), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1, 7: 0}
    assert simhash.near_copies(docs).count() == len(texts)
    assert simhash.near_copies(docs.filter("false")).count() == 0


def test_near_copies_equal_brute_force_jaccard(spark):
    rng = random.Random(7)
    rows = []
    for length in (120, 200, 320, 500):
        for lost in range(4, 30, 2):  # one block of words replaced: similarity from 0.6 to 0.97
            words = [f"w{rng.randrange(3000)}" for _ in range(length)]
            at, n = rng.randrange(10, 40), length * lost // 200
            rows += [" ".join(words), " ".join(words[:at] + [f"v{rng.randrange(3000)}" for _ in range(n)] + words[at + n :])]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    likeness = lambda a, b: len(a & b) / len(a | b)
    assert sum(0.7 <= likeness(sets[i], sets[i + 1]) < 0.8 for i in range(0, len(rows), 2)) > 5
    roots = plain_components(sets, lambda a, b: likeness(a, b) >= 0.8)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for sizes in ({}, {"block": 4, "set_block": 900}):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, **sizes).collect()}
        assert [got[i] for i in range(len(rows))] == [roots.index(r) for r in roots]


def test_near_copies_where_one_group_holds_a_third(spark):
    """Copies and near copies of one text, repeats, nulls and empties among others, against all pairs."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [" ".join(base)] * 30
    for _ in range(60):
        words = base[:]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"v{rng.randrange(500)}"
        rows.append(" ".join(words))
    rows += [None, "", " \n", "one two", "One  two", "one two three"] + [" ".join(f"u{rng.randrange(900)}" for _ in range(40)) for _ in range(150)]
    rng.shuffle(rows)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in rows)]
    roots = plain_components(sets, lambda a, b: not a and not b or len(a & b) / len(a | b) >= 0.8)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("node", F.lit("own"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, block=16, set_block=500).collect()}
    assert [got[i] for i in range(len(rows))] == [roots.index(r) for r in roots]


def test_grouped_links_of_sets_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    sets = [np.array([], dtype=np.uint64)]
    for _ in range(20):
        one = rng.integers(0, 2**60, rng.integers(1, 60), dtype=np.uint64)
        for _ in range(8):
            sets.append(np.unique(np.concatenate([one[rng.random(len(one)) < rng.choice([0.8, 0.95, 1])], rng.integers(0, 2**60, rng.integers(0, 4), dtype=np.uint64)])))
    plain = [set(s.tolist()) for s in sets]
    want = plain_components(plain, lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.8)
    loads = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, load binary")
    keyed = spark.createDataFrame([(i % 2 if i < 8 else 7, i, len(s)) for i, s in enumerate(sets)], "grp long, node long, w long").union(spark.createDataFrame([(7, i, len(s)) for i, s in enumerate(sets[:8])], "grp long, node long, w long"))
    for block in (1 << 19, 300):  # one chunk, and many
        found = simhash.grouped_links(keyed, loads, simhash.near_sets(0.8), block, 3)
        roots = {r["node"]: r["root"] for r in components.components(found).collect()}
        got = [roots.get(i, i) for i in range(len(sets))]
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_cells_are_made_of_pivot_distances(spark):
    """Fingerprints with equal rows of the pivot table share all cells; neighbours within the radius share at least one."""
    rng = random.Random(6)
    rows = []
    for i in range(200):
        a = rng.getrandbits(64)
        rows += [(i, "a", a), (i, "b", a ^ sum(1 << b for b in rng.sample(range(64), 2)))]
    df = spark.createDataFrame([(i, k, simhash._signed(x)) for i, k, x in rows], "i int, k string, fp long")
    made = df.withColumn("pivots", simhash.pivots(F.col("fp"))).withColumn("cells", simhash.cells(F.col("pivots"), 2)).collect()
    got = {(r["i"], r["k"]): r for r in made}
    for i, k, x in rows:
        assert got[i, k]["pivots"] == [(x ^ ref).bit_count() for ref in simhash.REFERENCES]
    assert all(set(got[i, "a"]["cells"]) & set(got[i, "b"]["cells"]) for i in range(200))
    assert len(simhash.REFERENCES) == len(set(simhash.REFERENCES)) == 50
    zero = df.select(simhash.cells(F.array(*[F.lit(0)] * 50), 2).alias("c")).distinct()
    assert zero.count() == 1  # the key is a function of the distances alone


def test_components_raise_if_unsettled(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(edges, rounds=1)


def test_components_of_large_stars(spark):
    """A centre with a third of the links, many small components, and a chain between two stars."""
    edges = [(5000, i) for i in range(1000, 2500)] + [(2499 + i, 2500 + i) for i in range(12)]
    edges += [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(1500)] + [(2511, i) for i in range(6000, 6800)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    assert got == {x: (x - x % 2 if x >= 10_000 else 1000) for x in nodes}


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 101), (None, 3), (100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_packing(docs, empty, texts):
    from tokenizers import Tokenizer

    path = common.vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=256, group_tokens=4000).collect()
    whole = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append(r)
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    for i, rows in whole.items():
        ids = [x for r in sorted(rows, key=lambda r: (r["start"], r["sequence_id"])) for x in np.frombuffer(r["ids"], "<u4").tolist()]
        if len(want[i]) == 1:
            assert ids == want[i][0]
            assert all(r["doc_tokens"] == len(ids) for r in rows)
        else:
            assert sorted(ids) == sorted(x for w in want[i] for x in w)
    assert set(whole) == set(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end and n > 0
            end += n
        assert end == 256 or end & (end - 1) == 0
    assert packing.pack(empty, path).count() == 0


def test_packing_balances_cost():
    lengths = np.array([900, 800, 700, 600, 500, 400, 100, 96])
    rows = packing.place(lengths, 2048, 1.0, 0.001)
    cost = {}
    for _, _, n, s, _ in rows:
        cost[s] = cost.get(s, 0) + n + 0.001 * n * n
    assert sum(r[2] for r in rows) == lengths.sum()
    assert max(cost.values()) < 1.15 * min(cost.values())


def plain_repeats(texts, least):
    """(n_bytes, removed mask) of every row."""
    first, out = {}, []
    big = 1 << 63
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            first[w] = min(first.get(w, big), big if i is None else i)
    for i, t in texts:
        b, own = (t or "").encode(), big if i is None else i
        m = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < own:
                m[p : p + least] = True
        out.append((i, b, m))
    return out


def test_suffix_dedup(docs, empty, texts):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"]), tuple(map(tuple, r["spans"]))) for r in suffix_dedup.remove_repeats(docs).collect()), key=str)
    want = []
    for i, b, m in plain_repeats(texts, 50):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(int), [0]])))
        spans = tuple((int(x), int(y)) for x, y in zip(edge[::2], edge[1::2], strict=True))
        want.append((i, len(b), int(m.sum()), bytes(np.frombuffer(b, np.uint8)[~m]), spans))
    assert got == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert all(bytes(r["kept"]).decode() is not None for r in suffix_dedup.remove_repeats(docs, whole_characters=True).collect())


def test_suffix_dedup_on_periodic_texts(spark):
    rows = [(0, "ab" * 200), (1, "ba" * 40 + "c" + "a" * 120), (2, "a" * 90), (3, "x" + "ab" * 60 + "y" + "a" * 60), (4, "abc" * 50), (5, "bca" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {i: bytes(np.frombuffer(b, np.uint8)[~m]) for i, b, m in plain_repeats(rows, 50)}


def test_equal_hashes_do_not_make_contexts_equal():
    """Every key and hash collides; only the bytes tell contexts apart."""
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    at = rng.integers(0, 390, 200)
    length = rng.integers(4, 8, 200)
    doc = rng.integers(0, 50, 200)
    zero = np.zeros(200, dtype=np.uint64)
    order, new = suffix_dedup.verified_classes(text, at, length, zero, zero, doc)
    cls = np.empty(200, dtype=int)
    cls[order] = np.cumsum(new) - 1
    raw = [text[a : a + n].tobytes() for a, n in zip(at, length, strict=True)]
    assert len(set(zip(cls.tolist(), raw, strict=True))) == len(set(raw)) == cls.max() + 1
    assert all(doc[order[k]] <= doc[order[k + 1]] for k in range(199) if not new[k + 1])


def test_context_hashes_can_be_found_again():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    for _, first, last, whole, _ in suffix_dedup.contexts(data, np.array([2000, 2040, 5000]), 50):
        assert (suffix_dedup.whole_hashes(data, first, last - first + 50) == whole).all()


def test_suffix_dedup_with_more_homes_than_partitions(spark):
    rng = random.Random(3)
    passages = [sentence(rng, 14) for _ in range(6)]
    rows = [(i, sentence(rng, 6) + rng.choice(passages) + sentence(rng, 6) + rng.choice(passages)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: int(m.sum()) for i, _, m in plain_repeats(rows, 50)}
    for fan in (2048, 5, 2):  # one hop, two and more
        for crowd in (1 << 13, 2):
            got = suffix_dedup.remove_repeats(df, home_bytes=400, fan=fan, crowd=crowd)
            assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 7, 43, 2048, 2049, 5000, 8_300_000])
@pytest.mark.parametrize("fan", [2, 5, 2048])
def test_parcels_are_linear_in_the_senders(n, fan):
    way = suffix_dedup.hops(n, fan)
    assert way[-1][0] == 1 and way[-1][1] >= n
    meet = 1
    before = n
    for width, span in way:
        ranges = -(-n // width)
        assert -(-before // width) <= fan or n <= fan  # parcels that one sender makes
        assert span == meet * (way[0][1])
        assert ranges * span >= n or width > 1
        meet, before = span, width
    assert len(way) == 1 or n > fan


def test_parcels_reach_their_receivers():
    """Items of several senders, opened and dealt on by hand, with texts."""
    rng = np.random.default_rng(8)
    n, least = 23, 4
    way = suffix_dedup.hops(n, 3)
    assert len(way) == 3
    sent, want = [], []
    for home in range(n):
        dest = rng.integers(0, n, 30)
        value, strings = rng.integers(0, 2**32, 30).astype("<u4"), rng.integers(1, 5, 30).astype("u1")
        length = strings.astype(int) + least - 1
        text = rng.integers(97, 123, int(length.sum())).astype(np.uint8).tobytes()
        place = np.cumsum(length) - length
        want += [(int(d), home, int(v), text[p : p + m]) for d, v, p, m in zip(dest, value, place, length, strict=True)]
        sent.append(suffix_dedup.parcels({"value": value, "strings": strings}, dest, np.full(30, home), way[0], (text, place, length)))
    rows = [r for t in sent for r in t.to_pylist()]
    for hop in way[1:]:
        groups = {}
        for r in rows:
            groups.setdefault((r["to"], r["via"]), []).append(r)
        rows = []
        for rs in groups.values():
            t = pa.Table.from_pylist(rs, schema=sent[0].schema)
            strings = suffix_dedup._join(t["strings"], "u1")[0]
            length = strings.astype(int) + least - 1
            made = suffix_dedup.parcels(
                {"value": suffix_dedup._join(t["value"], "<u4")[0], "strings": strings}, suffix_dedup._numbers(t["dests"]), suffix_dedup._numbers(t["sources"]), hop, (suffix_dedup._texts(t["text"]), np.cumsum(length) - length, length)
            )
            assert made.num_rows <= 3
            rows += made.to_pylist()
    got = []
    for r in rows:
        t = pa.Table.from_pylist([r], schema=sent[0].schema)
        length = suffix_dedup._join(t["strings"], "u1")[0].astype(int) + least - 1
        place = np.cumsum(length) - length
        text = suffix_dedup._texts(t["text"])
        parts = zip(suffix_dedup._numbers(t["dests"]).tolist(), suffix_dedup._numbers(t["sources"]).tolist(), suffix_dedup._join(t["value"], "<u4")[0].tolist(), place.tolist(), length.tolist(), strict=True)
        got += [(d, h, v, text[p : p + m]) for d, h, v, p, m in parts]
        assert {g[0] for g in got[-len(length) :]} == {r["to"]}
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("crowd", [0, 3, 20])
def test_suffix_dedup_splits_crowded_anchors(spark, crowd):
    """Passages of every length around the least one in most documents, each time with other neighbours."""
    rng = random.Random(4)
    line = sentence(rng, 40)
    rows = [(i, sentence(rng, 3) + line[: rng.choice([30, 46, 49, 50, 51, 120])] + sentence(rng, 3) + "ab" * rng.randrange(40)) for i in range(60)]
    rows += [(i, t) for i, t in rows[:5]] + [(60, None), (61, ""), (62, line), (63, "ab" * 90)]
    rows += [(70 + i, sentence(rng, 1) + "\0" * (40 + 5 * i) + sentence(rng, 1)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i or 0, int(m.sum())) for i, _, m in plain_repeats(rows, 50))
    got = suffix_dedup.remove_repeats(df, home_bytes=1500, crowd=crowd).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == want


def test_suffix_sort_equals_sorting():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    s = suffix_dedup.Suffixes(text, 20)
    at, group = rng.permutation(2900)[:500], np.repeat(np.arange(5), 100)
    order = s.sort(at, group)
    raw = text.tobytes()
    assert (group[order] == group).all()
    for g in range(5):
        mine = [raw[x : x + 20] for x in at[order][group == g]]
        assert mine == sorted(mine)


def test_line_dedup(spark, docs, empty, texts):
    rng = random.Random(9)
    rows = [(i, "h1" if i < 40 else "h2", "\n".join([sentence(rng, 5), "Menu", "", sentence(rng, 5)] if i % 2 else [sentence(rng, 4), "Once"])) for i in range(60)]
    rows += [(60, "h1", "Rare\nMenu"), (61, None, "Menu\nalone"), (62, "h1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("lines", F.lit("mine"))
    for more in ({}, {"few": 0}):  # sent whole, and joined
        got = {r["doc_id"]: r for r in line_dedup.drop_site_lines(df, max_ratio=0.3, **more).collect()}
        assert "Menu" not in got[1]["text"] and got[1]["n_dropped"] == 1 and got[1]["n_lines"] == 4 and got[1]["lines"] == "mine"
        assert "\n\n" in got[1]["text"]
        assert got[60]["text"] == "Rare" and got[61]["text"] == "Menu\nalone" and got[62]["text"] is None
        assert line_dedup.drop_site_lines(docs, **more).count() == len(texts)
    assert line_dedup.drop_site_lines(empty).count() == 0


def test_line_dedup_counts_pages(spark):
    """A page of which a third of its host are copies: its lines are boilerplate, unless pages of one text count once."""
    rows = [(i, "h", f"one {i}\ntwo {i}") for i in range(40)] + [(100 + i, "h", "copied\ntext") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_site_lines(df, max_ratio=0.3).collect()}
    assert got[100] == "" and got[1] == "one 1\ntwo 1"
    once = {r["doc_id"]: r["text"] for r in line_dedup.drop_site_lines(df, max_ratio=0.3, distinct_pages=True).collect()}
    assert once == {i: t for i, _, t in rows}


def test_sharding(docs, empty, texts, spark):
    for df, n, shards in ((docs, len(texts), 4), (spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'same', repeat('x', int(id % 97)))").alias("text")), 5000, 24)):
        got = sharding.shard(df, shards).collect()
        assert len(got) == n
        by, size = {}, {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
            size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
            assert r["size"] == len((r["text"] or "").encode()) + 8
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        if shards == 24:
            assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 24 + 300
    assert sharding.shard(empty).count() == 0
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"))
    sizes = [r["count"] for r in sharding.shard(same, 3).groupBy("shard").count().collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 10


def test_sharding_splits_a_text_that_a_third_of_the_rows_share(spark):
    """What lies between two boundaries has a bounded number of rows, copies of one text too."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'same', concat('text', id))").alias("text"))
    keys = docs.select(sharding._key("doc_id", "text").alias("key"), (F.octet_length("text") + 8).cast("long").alias("size"))
    _, bounds = sharding.splitters(keys, 3, most=500)
    counts = [0, *(n for _, n in bounds), 9000]
    assert max(b - a for a, b in zip(counts, counts[1:], strict=False)) <= 500
    got = sharding.shard(docs, 3).collect()
    for k in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    with pytest.raises(RuntimeError):
        sharding.splitters(keys, 3, tolerance=0.0001, probes=1, rounds=1)


def test_exact_dedup(docs, empty, texts):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in texts]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert table(exact_dedup.exact_duplicates(docs), *cols) == sorted(want, key=str)
    # a digest with two values: every chunk collides and only versions tell texts apart
    weak = exact_dedup.exact_duplicates(docs, least=8, most=64, digest=lambda c: F.substring(F.md5(c), 1, 1))
    assert table(weak, *cols) == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(empty).count() == 0

def test_exact_dedup_where_a_third_of_the_rows_are_one_text(spark, monkeypatch):
    rng = random.Random(12)
    hot, long = sentence(rng, 30), sentence(rng, 9000)
    rows = [(i, hot if i % 3 == 0 else long if i % 7 == 0 else sentence(rng, 8)) for i in range(1500)] + [(0, hot), (None, hot), (1, None), (2, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    first, size = {}, {}
    for (i, _), t in zip(rows, norm, strict=True):
        first[t] = min((x for x in (first.get(t), i) if x is not None), default=None)
        size[t] = size.get(t, 0) + 1
    want = sorted(str((i, first[t], size[t], i == first[t])) for (i, _), t in zip(rows, norm, strict=True))
    for sent in (1 << 16, 100, 0):
        monkeypatch.setattr(exact_dedup, "SENT", sent)
        got = exact_dedup.exact_duplicates(df).collect()
        assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in got) == want


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz. ", "abcdef;{}", "ABCDEFGHabcdefghijklmnopqrstuvwxyz0123456789+/", "的一是在不了有和人这中大。", "абвгдежзик"])
def test_an_inserted_character_leaves_later_chunks_alone(spark, letters):
    rng = random.Random(8)
    text = "".join(rng.choice(letters) for _ in range(40_000))
    df = spark.createDataFrame([(0, text), (1, text[:500] + letters[0] + text[500:])], "doc_id long, text string")
    one, two = (r["c"] for r in df.orderBy("doc_id").select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert "".join(one) == text
    assert len(set(one) - set(two)) <= 8 < len(one)


def test_bpe(docs, empty, texts):
    from tokenizers import Tokenizer

    path = common.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = bpe.encode_texts(docs, path).collect()
    want = []
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    mine = bpe.encoder(path)
    rng = random.Random(3)
    for alphabet in ("aeht", "lo's!?1 ", "abcdefghijklmnopqrstuvwxyz", "éßΣσς漢字\n<|endoftext|>"):
        for _ in range(300):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
            ids = tok.encode(t, add_special_tokens=False).ids
            assert mine.encode(t) == (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))
            assert mine.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(empty, path).count() == 0


def test_byte_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = common.vocabulary("byte_bpe_50k.json")
    tok, mine = Tokenizer.from_file(path), packing.byte_tokenizer(path)
    rng = random.Random(5)
    alphabet = "abc ABC  \n\t.,'s \x1c\x85é漢😀<|endoftext|>1²"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    space, lines = " " * 1500, "\n" * 1200
    texts += [space, space + "a", space + "\n a", lines + "b" + space, "x" + space + "<|endoftext|>" + lines + " y", space + "\u3000z", "a" + lines + space + "'s 12" + space, "\x1c" * 1500 + "a"]
    texts += [c * 100_000 + "x" for c in (" ", "\n", "\t ", "a", "é", "漢", "1", "!", "\u0301")]
    for t in texts:
        assert mine.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "a", "!", "\u0301"])
def test_ten_megabytes_of_one_character_are_packed(spark, unit):
    n = 10_000_000 // len(unit.encode())
    path = common.vocabulary("byte_bpe_50k.json")
    got = packing.pack(spark.createDataFrame([(1, unit * n)], "doc_id long, text string"), path).agg(F.sum("length"), F.max("doc_tokens")).first()
    whole = b"".join(packing.byte_tokenizer(path).ranks.decode_single_token_bytes(int(i)) for i in packing.byte_tokenizer(path).encode(unit * n))
    assert whole == (unit * n).encode() and got[0] == got[1] == len(packing.byte_tokenizer(path).encode(unit * n)) + 1


def test_bpe_remembers_a_bounded_number_of_characters():
    mine = bpe.PrefixBpe(public.path("word_bpe_49k.json"), 400)
    rng = random.Random(8)
    for k in range(300):
        piece = "".join(rng.choice("abcdeé漢") for _ in range(10_000 if k % 10 == 0 else rng.randrange(1, 90)))
        assert mine._learn(piece) == mine._learn(piece)
        assert len(mine.known) <= 400 and len(mine.pieces) <= 400
        assert sum(map(len, [*mine.known, *mine.pieces])) <= 64 * 400 // 4 + 64


def test_bpe_knows_the_characters_that_the_library_knows():
    from tokenizers import Tokenizer

    path = common.vocabulary("word_bpe_49k.json")
    tok, mine = Tokenizer.from_file(path), bpe.encoder(path)
    plain = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(plain), 500):
        t = " x".join(chr(c) + "a" for c in plain[at : at + 500])
        assert mine.encode(t)[0] == " ".join(map(str, tok.encode(t, add_special_tokens=False).ids))


def test_warc(spark):
    rows = [(i, f"http://Www.Example.org/{i % 7}?q={i % 3}", ("é" * (i % 4) * 700) + "x" * (i % 5)) for i in range(60)]
    rows += [(100, "not a url\r\nWARC: x", "y\r\n\r\n" * 400), (101, None, None), (102, "http://[bad", "y\r\n\r\n" * 400), (102, "http://[bad", "y\r\n\r\n" * 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    kept = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            kept[b] = max(kept.get(b, -1), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        r = kept.get(b, i)
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "response" if r == i else "revisit", None if r == i else str(r)))
    for limit in (500_000, 0):
        folder = warc.write_archives(df, file_bytes=20_000, broadcast_rows=limit)
        out = warc.histories(warc.read_runs(spark, folder), range_entries=10)
        got = out.orderBy("position").collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
        keys = [(r["urlkey"], r["ts"]) for r in got]
        assert keys == sorted(keys)
        assert [r["position"] for r in got] == list(range(len(rows)))
    assert warc.capture_index(df.filter("false")).count() == 0
    assert warc.url_key("http://www.Example.org:80/A?b=1") == "org,example)/a?b=1"


def test_warc_files_have_a_bound_in_bytes(spark, monkeypatch):
    rows = [(i, f"http://a.example/{i}", "y" * (i % 700)) for i in range(4000)] + [(5000 + i, "http://b.example/" + "u" * 9000, "z" * (400_000 + i)) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).sortWithinPartitions(F.desc(F.length("html")))
    bound = 1 << 18
    folder = warc.write_archives(df, file_bytes=bound).removeprefix("file://")
    files = [open(os.path.join(folder, f), "rb").read() for f in os.listdir(folder) if f.startswith("part-")]  # noqa: SIM115
    counts = [len(list(warc.parse(data))) for data in files]
    assert sum(counts) == len(rows) and all(len(data) <= bound or n == 1 for data, n in zip(files, counts, strict=True))
    assert max(counts) >= 20
    out = {r["page_id"]: r["payload_bytes"] for r in warc.capture_index(df).collect()}
    assert out == {str(i): len(t) for i, _, t in rows}


def test_warc_with_a_large_page(spark):
    rows = [(1, "http://a.example/", "x" * 20_000_000), (2, "http://a.example/", "x" * 20_000_000), (3, None, "y")]
    got = {r["page_id"]: r for r in warc.capture_index(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k]["record_type"] for k in "123"] == ["revisit", "response", "response"]
    assert got["1"]["payload_bytes"] == got["2"]["payload_bytes"] == 20_000_000 and got["1"]["digest"] == hashlib.sha1(b"x" * 20_000_000).hexdigest()


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randint(0, 50), i) for _ in range(rng.randint(0, 20))) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_quality(spark, docs, empty, texts):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 30) if i % 3 else "!! ".join(sentence(rng, 30).upper().split())) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    got = quality.score_quality(df, labels).collect()
    assert len(got) == 600
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.97
    edge = quality.score_quality(docs, labels)
    assert edge.count() == len(texts) and "own key" in {r["key"] for r in edge.collect()}
    spread = lambda kept, **more: quality.score_quality(docs, labels.filter(kept), **more).agg(F.min("score"), F.max("score")).first()
    assert tuple(spread("false")) == pytest.approx((0.5, 0.5)) and min(spread("false", prior=1.0)) > 0.99
    assert max(spread("quality = 0")) < 0.1 and min(spread("quality = 1")) > 0.9  # few of these texts are labelled
    assert quality.score_quality(empty, labels).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


def read(spark, sf_dir, name):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select("doc_id", "text").collect()}


def test_op2_equals_brute_force(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, sf_dir).collect()}
    ids = sorted(docs)
    fps = [plain_simhash(docs[i], 3) for i in ids]
    roots = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least.setdefault(r, i)
    assert got == {i: (f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, roots, strict=True)}


def test_op3_holds_every_id_once(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    docs = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in read(spark, sf_dir, "documents").items()}
    rows = sorted(queries.op3_packing(spark, sf_dir).collect(), key=lambda r: (r["doc_id"], r["start"]))
    at, room = dict.fromkeys(docs, 0), {}
    for r in rows:
        ids = docs[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in docs.items()}
    for parts in room.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)


def test_op4_equals_brute_force(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_suffix_dedup(spark, sf_dir).collect()}
    for i, b, m in plain_repeats(sorted(docs.items()), 50):
        edges = np.abs(np.diff(np.concatenate([[0], m.astype(int), [0]]))).sum()
        assert got[i] == (len(b), int(m.sum()), int(edges) // 2, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest())


def test_op6_shards_are_near_equal(spark, sf_dir):
    docs, rows = read(spark, sf_dir, "documents"), queries.op6_sharding(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    held = {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        held.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert set(held) <= set(range(24)) and all(sorted(x for x, _ in v) == list(range(len(v))) for v in held.values())
    most = max(len(t.encode()) + 8 for t in docs.values())
    sums = [sum(x for _, x in v) for v in held.values()]
    assert max(sums) - min(sums) <= 2 * most


def test_op8_equals_the_tokenizers_library(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.vocabulary("word_bpe_49k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, t in read(spark, sf_dir, "documents").items():
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op8_bpe(spark, sf_dir).collect()} == want


def test_op10_predicts_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("the test tables are not here")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, sf_dir).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert len(held) > 50 and sum(r["predicted"] == marks[r["doc_id"]] for r in held) / len(held) > 0.9
