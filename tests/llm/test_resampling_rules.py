"""Importance resampling and quality rules against plain versions, with nulls, empties, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from coverspark.llm import divergence, queries, resampling

BITS = "the of and to in that ble tion ing erst ouha thon ané für queso 7 x9".split()


def prose(rng, n):
    return " ".join(rng.choice(BITS) + rng.choice(["", "", "ed", "ly", ","]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randrange(1, 90)), ("en", "fr", None)[i % 3]) for i in range(150)]
    out += [(i, out[i % 7][1], "en") for i in range(200, 230)]
    out += [(300, None, "en"), (301, "", None), (302, " \n\t", "fr"), (303, "one", "en"), (304, "É" * 4000 + " " + prose(rng, 30), "fr"), (305, prose(rng, 60_000), "en")]
    out += [(306, "a b C-D\u0000e 😀", "de"), (307, prose(rng, 80).upper().replace(" ", "!! "), "en"), (308, "same line here now\n" * 12, "en"), (None, prose(rng, 50), "en"), (310, "The#of&& " * 200, "en")]
    return [*out, out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    return df.withColumns({c: F.lit("own") for c in ("id", "n_words", "score", "rank", "place", "able", "weight", "kept", "item", "share")})


def weighed(rows, target, runs):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    features = lambda t: [" ".join(w[i : i + k]) for w in [words_of(t)] for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t, _ in rows for f in features(t))
    t = Counter(bucket(f) for x in target for f in features(x))
    size, aim = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * size / ((s[b] + 1) * aim))) for b in s}
    out = []
    for i, text, _ in rows:
        found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append((i, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [r[0] for r in able[: 10 * len(able) // 100]]
    return sorted(out, key=str), ranks


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_resampling(spark, docs, rows, runs):
    target = [prose(random.Random(k), 30) for k in range(20)] + [None, ""]
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), runs).collect()
    want, ranks = weighed(rows, target, runs)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(ranks) + 1)) and [r["doc_id"] for r in drawn] == ranks


def test_the_head_changes_no_result(docs):
    words = resampling.words_of(prose(random.Random(2), 300).encode())
    none = ({}, {})
    head = resampling.head_vocabulary(docs, 2, size=400)
    assert 0 < len(head[0]) <= 400 and 0 < len(head[1]) <= 400
    for runs in (1, 2, 3):
        assert resampling.features_of(words, runs, 1000, head) == resampling.features_of(words, runs, 1000, none)


def test_resampling_without_rows_or_target(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.filter("false"), none).count() == 0
    got = resampling.resample(docs.filter("doc_id in (301, 303)"), none).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in got) == [(301, 0, None), (303, 1, None)]
    ranks = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, rank long")
    assert [r["doc_id"] for r in resampling.draw(docs, ranks).collect()] == [1]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside), failed


def shares_of(text, common):
    data = text.encode()
    kinds = {9: 0} | {k: 0 for k in range(9)}
    for b in data:
        kinds[int(divergence.CLASS_OF[b])] += 1
    total = sum(kinds[k] for k in range(9))
    words = [w.strip(divergence.MARKS).lower() for w in data.split()]
    place = Counter(w if w in common else None for w in words)
    return [kinds[k] / total for k in range(9)], [place[w] / len(words) for w in [*sorted(common), None]]


def far(p, q):
    js = sum((a * math.log2(a / ((a + b) / 2)) if a else 0) + (b * math.log2(b / ((a + b) / 2)) if b else 0) for a, b in zip(p, q, strict=True)) / 2
    return max(0.0, js) ** 0.5


def judged(rows, least_docs):
    """Distances and verdicts; languages are all frequent enough to be taken by themselves but for null."""
    out = []
    by = {}
    for row in rows:
        by.setdefault(row[2] or "", []).append(row)
    for own in by.values():
        words = Counter(w.strip(divergence.MARKS).lower() for _, t, _ in own for w in (t or "").encode().split())
        common = {w for w, n in words.items() if n * 1000 >= sum(words.values()) and len(w) <= 64}
        long = [t for _, t, _ in own if len((t or "").encode().split()) >= divergence.LEAST_WORDS]
        every = [shares_of(t, common) for t in long]
        mean = [[sum(x[k][i] for x in every) / len(every) for i in range(len(every[0][k]))] for k in range(2)] if len(long) >= least_docs else None
        for i, t, _ in own:
            counts = base(t)
            d = None, None
            if mean and counts[0] >= divergence.LEAST_WORDS:
                d = tuple(far(a, b) for a, b in zip(shares_of(t, common), mean, strict=True))
            limits = [a + b / max(1, counts[0]) ** 0.5 for a, b in (divergence.CLASS_LIMIT, divergence.WORD_LIMIT)]
            kept = not counts[5] and not (d[0] is not None and (d[0] > limits[0] or d[1] > limits[1]))
            out.append(((i, *counts, kept), d))
    return sorted(out, key=lambda r: str(r[0]))


def test_quality_rules(docs, rows):
    got = sorted(((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), (r["class_distance"], r["word_distance"])) for r in divergence.quality_rules(docs, least_docs=10).collect()), key=lambda r: str(r[0]))
    want = judged(rows, 10)
    assert [g[0] for g in got] == [w[0] for w in want]
    for (key, g), (_, w) in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=1e-5) if w[0] is not None else g == w, key
    kept = {g[0][0]: g[0][-1] for g in got}
    assert not kept[307] and not kept[308] and not kept[310] and kept[305]


def test_quality_rules_without_reference_or_rows(spark, docs):
    assert divergence.quality_rules(docs.filter("false")).count() == 0
    got = divergence.quality_rules(docs.filter("doc_id = 305").withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r["class_distance"], r["kept"]) for r in got] == [(None, True)]


def test_references_do_not_depend_on_partitions(docs):
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    one, many = (divergence.references(texts.repartition(n), 10) for n in (1, 7))
    assert one.keys() == many.keys()
    for lang in one:
        assert one[lang][1] == many[lang][1] and (one[lang][0] == many[lang][0]).all() and (one[lang][2] == many[lang][2]).all()


def test_the_queries_read_all_documents(spark, sf_dir, same_rows):
    same_rows(queries.QUERIES["op12_resampling"], queries.ORACLES["op12_resampling"])
    same_rows(queries.QUERIES["op13_quality_rules"], queries.ORACLES["op13_quality_rules"])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in queries.QUERIES["op13_quality_rules"](spark, sf_dir).collect()}
    assert got == {r["doc_id"]: base(r["text"]) for r in docs}
