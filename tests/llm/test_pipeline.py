"""Every stage of the pipeline against a plain version, and the whole run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return dict(out)


def test_stages_keep_the_columns_of_documents(steps):
    for name, df in steps.items():
        if name != "packing":
            assert df.columns == list(pipeline.COLUMNS)


def test_quality_keeps_good_and_drops_bad(spark, sf_dir, steps):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r[0] for r in steps["quality"].select("doc_id").collect()}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = [i for i, q in marked.items() if q == 1], [i for i, q in marked.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_near_dedup_keeps_one_of_each_group(steps):
    """The least id of every component of texts with a Jaccard similarity of 0.8, by comparing all pairs."""
    rows = sorted((r["doc_id"], r["text"] or "") for r in steps["line_dedup"].select("doc_id", "text").collect())
    words = [t.encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    want = {rows[i][0] for i in range(len(rows)) if top(i) == i}
    assert {r[0] for r in steps["near_dedup"].select("doc_id").collect()} == want and len(want) < len(rows)


def test_no_document_is_lost_by_line_and_passage_stages(steps):
    ids = lambda n: sorted(r[0] for r in steps[n].select("doc_id").collect())
    assert ids("quality") == ids("line_dedup")
    assert ids("near_dedup") == ids("suffix_dedup")


def test_no_passage_starts_in_two_documents(steps):
    seen = {}
    for i, t in sorted(tuple(r) for r in steps["near_dedup"].select("doc_id", "text").collect()):
        b = t.encode()
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)
    kept = {r["doc_id"]: r["text"] for r in steps["suffix_dedup"].collect()}
    shorter = 0
    for i, t in ((r["doc_id"], r["text"]) for r in steps["near_dedup"].collect()):
        b = t.encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                m[p : p + 50] = True
        ends = np.cumsum([len(c.encode()) for c in t])
        left = "".join(c for c, e in zip(t, ends, strict=True) if not m[e - len(c.encode()) : e].any())
        assert kept[i] == left
        shorter += left != t
    assert shorter


def test_stages_take_nulls_empties_repeats_and_more_columns(spark, sf_dir):
    text = "A passage of words that is long enough to be found again in another row of this table, twice even.\nLine"
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, text, "en", "s"), (3, text, "en", "s"), (4, "Other words. " + text, "en", None), (None, text, None, "s"), (5, " \n ", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    more = df.withColumns({c: F.lit("own") for c in ("row", "size", "kept", "host", "score", "node", "id")})
    for name, stage in pipeline.STAGES:
        out = stage(spark, more, sf_dir)
        assert stage(spark, more.filter("false"), sf_dir).count() == 0
        if name != "packing":
            assert out.columns == list(pipeline.COLUMNS)
        kept = out.collect()
        if name in ("line_dedup", "suffix_dedup"):
            assert len(kept) == len(rows) and [r["text"] for r in kept if r["doc_id"] == 1] == [None]
        if name == "near_dedup":  # 2 and 5 have no words, like 1; 4 is a near copy of 3, whose rows stay, and so does the one without an id
            assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "3", "None"]
        if name == "packing":
            assert {r["doc_id"] for r in kept} == {1, 2, 3, 4, 5, None}


def test_packing_holds_every_token(steps):
    from tokenizers import Tokenizer

    from coverspark.llm.common import vocabulary

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokens = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in steps["suffix_dedup"].collect()}
    packed = steps["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == tokens


def test_run(spark, sf_dir, steps):
    assert pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == steps["suffix_dedup"].count()
