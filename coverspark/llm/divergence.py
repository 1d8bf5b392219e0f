"""Quality rules: counts of a text, and its distance from what is usual in its language.

Each language has a reference: the mean share of character classes and of common words over its documents, so that
neither long documents nor rare words weigh more than others.  A document's own shares are compared to it by the
Jensen-Shannon distance (base 2, so 0 to 1); one beyond a limit fails.  Short texts scatter more, by about the inverse
square root of their length, so limits fall with it and texts below a length are not judged at all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverspark.llm.common import cut, text_of, tidy

#: Limits are A + B / sqrt(words), for texts of LEAST_WORDS words or more.
CLASS_LIMIT, WORD_LIMIT, LEAST_WORDS = (0.13, 1.4), (0.33, 1.35), 40
#: Common words have one in SHARE of a language's words or more; languages with under one in LANGUAGES documents are taken together.
SHARE, LANGUAGES, LONGEST = 1000, 500, 64
#: Of a language with fewer documents of LEAST_WORDS words no reference is made, and its texts are not judged by one.
LEAST_DOCS = 50
SCALE = 1 << 30
MARKS, SYMBOLS = b".,;:!?'\"()-", b"#*$%&|<>"
CLASSES = 9


def _classes() -> np.ndarray:
    """The class of each byte: a-z, A-Z, 0-9, space, marks, other ASCII, and first bytes of 2, 3 and 4; 9 for the rest."""
    out = np.full(256, 5)
    for k, (low, high) in enumerate(((97, 122), (65, 90), (48, 57))):
        out[low : high + 1] = k
    out[[32, *range(9, 14)]] = 3
    out[list(MARKS)] = 4
    out[128:192], out[192:224], out[224:240], out[240:] = 9, 6, 7, 8
    return out


CLASS_OF = _classes()
_SPACES_AND_TAILS = bytes([32, *range(9, 14), *range(128, 192)])


def class_shares(text: bytes) -> np.ndarray:
    counts = np.bincount(CLASS_OF, weights=np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256), minlength=CLASSES + 1)[:CLASSES]
    return counts / max(1.0, counts.sum())


def plain_words(words: list[bytes]) -> list[bytes]:
    """Words in lower case without marks around them."""
    return [w.strip(MARKS).lower() for w in words]


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """How many words lie in windows found twice or more.  Windows are numbered by ranks of pairs, so equal numbers mean equal windows."""
    if len(words) < window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    now = ids[: len(ids) - window + 1]
    for k in range(1, window):
        now = np.unique(now * len(numbers) + ids[k : len(ids) - window + 1 + k], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(now)[now] > 1)
    ends = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + window, minlength=len(words) + 1)[: len(words) + 1]
    return int(np.count_nonzero(np.cumsum(ends)[: len(words)]))


def counted(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars, rest = len(text.translate(None, _SPACES_AND_TAILS)), len(text.translate(None, SYMBOLS))
    return len(words), chars, len(text) - rest, len(lines) - len(set(lines)), repeated_words(words)


def distance(shares: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two distributions."""
    middle = (shares + reference) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / middle[x > 0])))
    return max(0.0, (part(shares) + part(reference)) / 2) ** 0.5


def _languages(docs: DataFrame, lang_col: str) -> list[str]:
    """Languages of at least one in LANGUAGES documents, so no more than that many."""
    counts = docs.groupBy(F.col(lang_col).cast("string").alias("lang")).count()
    total = docs.count()
    return sorted(r["lang"] for r in counts.filter((F.col("count") * LANGUAGES >= total) & (F.octet_length("lang") <= LONGEST)).collect())


def _summed(rows: dict[tuple[str, str, bytes], list[int]]) -> pa.RecordBatch:
    keys = list(rows)
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array([rows[k][i] for k in keys], pa.int64()) for i in range(2)]], ["lang", "kind", "item", "n", "share"])


def references(texts: DataFrame, least_docs: int = LEAST_DOCS) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """By language: mean class shares, common words with their places, and mean word shares (the last: all other words).

    texts: lang, text.  Two passes, both over all rows: the first reports words of a quarter of the share that is asked
    for in runs of each task, so that of a common word three quarters at least are reported; the second counts such words
    exactly.  Sums are whole numbers, so they are
    the same for any order and partitioning of the rows.
    """

    @tidy
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        seen: Counter = Counter()

        def reported(lang: str) -> pa.RecordBatch:
            """What came since the last report: its number of words, and those with one in 4 x SHARE or more."""
            n = seen.pop(lang)
            often = {(lang, "word", w): [k, 0] for w, k in counts.pop(lang).items() if k * 4 * SHARE >= n}
            return _summed(often | {(lang, "words", b""): [n, 0]})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = plain_words(text.as_buffer().to_pybytes().split())
                seen[lang] += len(words)
                own = counts.setdefault(lang, Counter())
                own.update(w for w in words if len(w) <= LONGEST)
                if len(own) > 1 << 18:
                    yield reported(lang)
        for lang in list(counts):
            yield reported(lang)

    schema = "lang string, kind string, item binary, n bigint, share bigint"
    found = cut(texts.mapInArrow(likely, schema).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    total = {r["lang"]: r["n"] for r in found.filter("kind = 'words'").collect()}
    words = found.filter("kind = 'word'").join(F.broadcast(found.filter("kind = 'words'").select("lang", F.col("n").alias("of"))), "lang")
    candidates: dict[str, set[bytes]] = {}
    for r in words.filter(F.col("n") * (2 * SHARE) >= F.col("of")).select("lang", "item").collect():  # 2 x SHARE a language at most
        candidates.setdefault(r["lang"], set()).add(bytes(r["item"]))
    shared = texts.sparkSession.sparkContext.broadcast(candidates)

    @tidy
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, bytes], list[int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                words = plain_words(data.split())
                enough = len(words) >= LEAST_WORDS
                known = shared.value.get(lang, ())
                for w, n in Counter(words).items():
                    if w in known:
                        into = sums.setdefault((lang, "word", w), [0, 0])
                        into[0] += n
                        into[1] += round(SCALE * n / len(words)) if enough else 0
                if enough:
                    sums.setdefault((lang, "docs", b""), [0, 0])[0] += 1
                    for k, share in enumerate(class_shares(data)):
                        sums.setdefault((lang, "class", bytes([k])), [0, 0])[1] += round(SCALE * float(share))
        yield _summed(sums)

    rows = texts.mapInArrow(exact, schema).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"), F.sum("share").alias("share")).collect()
    out = {}
    for lang in total:
        own = [r for r in rows if r["lang"] == lang]
        docs = sum(r["n"] for r in own if r["kind"] == "docs")
        if docs < least_docs:
            continue
        classes = np.zeros(CLASSES)
        for r in own:
            if r["kind"] == "class":
                classes[r["item"][0]] = r["share"]
        common = sorted((bytes(r["item"]), r["share"]) for r in own if r["kind"] == "word" and r["n"] * SHARE >= total[lang])
        shares = np.array([s for _, s in common] + [max(0, docs * SCALE - sum(s for _, s in common))], dtype=np.float64)
        out[lang] = (classes / classes.sum(), {w: i for i, (w, _) in enumerate(common)}, shares / shares.sum())
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_docs: int = LEAST_DOCS) -> DataFrame:
    """A row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance and kept.

    base_failed: fewer than ten words, or over a fifth of them in repeated windows of five.  kept: not base_failed, and
    neither distance beyond its limit.  Distances are null where nothing is judged: texts under LEAST_WORDS words, and
    languages with under ``least_docs`` documents of that length.  Null texts are empty; a null language is one with all
    rare ones; repeated rows are rows each and very long texts are read whole; an empty table gives no rows.  Other
    columns are not read.
    """
    listed = _languages(docs, lang_col)
    lang = F.when(F.col(lang_col).cast("string").isin(listed), F.col(lang_col).cast("string")).otherwise("") if listed else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(lang, F.lit("")).alias("lang"), text_of(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(references(rows.select("lang", "text"), least_docs))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for of, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                words = data.split()
                counts = counted(data, words)
                failed = len(words) < 10 or 100 * counts[-1] > 20 * len(words)
                far: tuple[float | None, float | None] = (None, None)
                if len(words) >= LEAST_WORDS and of in shared.value:
                    classes, place, shares = shared.value[of]
                    own = np.bincount([place.get(w, len(place)) for w in plain_words(words)], minlength=len(place) + 1)
                    far = distance(class_shares(data), classes), distance(own / len(words), shares)
                root = max(1, len(words)) ** -0.5
                beyond = far[0] is not None and (far[0] > CLASS_LIMIT[0] + CLASS_LIMIT[1] * root or far[1] > WORD_LIMIT[0] + WORD_LIMIT[1] * root)
                found.append((*counts, failed, *far, not failed and not beyond))
            columns = list(zip(*found, strict=True)) if found else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["id", *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in NAMES.items()))
    return out.withColumnRenamed("id", id_col)


NAMES = {c: "bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": "boolean", "class_distance": "double", "word_distance": "double", "kept": "boolean"}
