"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverspark.llm.bpe import encode_texts
from coverspark.llm.common import table, text_of, vocabulary
from coverspark.llm.conversations import damage, repair_conversations
from coverspark.llm.divergence import quality_rules
from coverspark.llm.exact_dedup import exact_duplicates
from coverspark.llm.fingerprints import compare_with_edits
from coverspark.llm.line_dedup import drop_site_lines
from coverspark.llm.packing import pack
from coverspark.llm.quality import score_quality
from coverspark.llm.resampling import resample
from coverspark.llm.sharding import shard
from coverspark.llm.simhash import near_duplicates
from coverspark.llm.suffix_dedup import remove_repeats
from coverspark.llm.warc import capture_index


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_with_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("edited_tree.sections").cast("long").alias("n_sections"),
        F.array_join(F.transform("edited_sections", lambda i: i.cast("string")), ",").alias("edited_sections"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_site_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(text_of("text"), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "size",
        F.crc32(text_of("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = capture_index(table(spark, sf_dir, "pages"))
    number = lambda c: F.col(c).cast("long")
    return out.select(number("page_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "urlkey", "ts", "position")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids, out = convs.select("conv_id").distinct(), repair_conversations(damage(convs))
    number = lambda c: F.coalesce(out[c], F.lit(0).cast("bigint")).alias(c)
    return ids.join(out, ids["conv_id"].eqNullSafe(out["conv_id"]), "left").select(
        ids["conv_id"],
        *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    far = lambda c: F.round(c, 6).alias(c)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", far("class_distance"), far("word_distance"), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_conversations": op11_conversations,
    "op12_resampling": op12_resampling,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES: dict[str, str] = {
    "op13_quality_rules": r"""
        WITH langs AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) * 500 >= (SELECT count(*) FROM documents) AND strlen(lang) <= 64),
        e AS (SELECT doc_id, CASE WHEN lang IN (SELECT lang FROM langs) THEN lang ELSE '' END AS lang, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM e WHERE len(w) >= 5)),
        again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
        inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
        base AS (SELECT e.doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
            FROM e LEFT JOIN inside USING (doc_id)),
        plain AS (SELECT doc_id, lang, len(w) AS n, unnest(list_transform(w, lambda x: translate(trim(x, '.,;:!?''"()-'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS word FROM e),
        held AS (SELECT doc_id, lang, n, word, count(*) AS k FROM plain GROUP BY ALL),
        totals AS (SELECT lang, sum(k) AS words FROM held GROUP BY lang),
        sums AS (SELECT lang, word, sum(k) AS k, sum(CASE WHEN n >= 40 THEN CAST(round_even(1073741824.0::DOUBLE * k / n, 0) AS BIGINT) ELSE 0 END) AS s FROM held WHERE strlen(word) <= 64 GROUP BY lang, word),
        judged AS (SELECT lang, count(*) AS m FROM e WHERE len(w) >= 40 GROUP BY lang HAVING count(*) >= 50),
        common AS (SELECT lang, word, s / (m * 1073741824.0::DOUBLE) AS r FROM sums JOIN totals USING (lang) JOIN judged USING (lang) WHERE k * 1000 >= words),
        others AS (SELECT lang, 1 - sum(r) AS r FROM common GROUP BY lang),
        long AS (SELECT doc_id, lang, t, len(w) AS n FROM e JOIN judged USING (lang) WHERE len(w) >= 40),
        present AS (SELECT doc_id, k / n AS x, r FROM held JOIN common USING (lang, word) WHERE n >= 40),
        pairs AS (SELECT * FROM present UNION ALL SELECT l.doc_id, 1 - coalesce(sum(x), 0), any_value(o.r) FROM long l JOIN others o USING (lang) LEFT JOIN present p ON p.doc_id = l.doc_id GROUP BY l.doc_id),
        far_words AS (SELECT doc_id, sqrt(greatest(0, (sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + r)) ELSE 0 END) + sum(CASE WHEN r > 0 THEN r * log2(2 * r / (x + r)) ELSE 0 END) + 1 - sum(r)) / 2)) AS d FROM pairs GROUP BY doc_id),
        kinds AS (SELECT doc_id, lang, length(t) AS size, unnest(range(9)) AS kind, unnest(list_transform(
            ['[^a-z]+', '[^A-Z]+', '[^0-9]+', '[^\x20\x09-\x0D]+', '[^.,;:!?''"()-]+', '[a-zA-Z0-9\x20\x09-\x0D.,;:!?''"()\-\x{80}-\x{10FFFF}]+', '[^\x{80}-\x{7FF}]+', '[^\x{800}-\x{FFFF}]+', '[^\x{10000}-\x{10FFFF}]+'],
            lambda p: length(regexp_replace(t, p, '', 'g')))) / length(t) AS x FROM long),
        usual AS (SELECT lang, kind, s / sum(s) OVER (PARTITION BY lang) AS r FROM (SELECT lang, kind, sum(CAST(round_even(1073741824.0::DOUBLE * x, 0) AS BIGINT))::DOUBLE AS s FROM kinds GROUP BY lang, kind)),
        far_kinds AS (SELECT doc_id, sqrt(greatest(0, (sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + r)) ELSE 0 END) + sum(CASE WHEN r > 0 THEN r * log2(2 * r / (x + r)) ELSE 0 END)) / 2)) AS d FROM kinds JOIN usual USING (lang, kind) GROUP BY doc_id),
        failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
        SELECT f.doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
            round(c.d, 6) AS class_distance, round(v.d, 6) AS word_distance,
            NOT base_failed AND coalesce(c.d <= 0.13 + 1.4 / sqrt(n_words) AND v.d <= 0.33 + 1.35 / sqrt(n_words), true) AS kept
        FROM failed f LEFT JOIN far_kinds c USING (doc_id) LEFT JOIN far_words v ON v.doc_id = f.doc_id""",
    "op12_resampling": r"""
        WITH RECURSIVE nibble AS (SELECT i, i AS c, 0 AS k FROM range(16) r(i)
            UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM nibble WHERE k < 4),
        steps AS (SELECT list(c ORDER BY i) AS t FROM nibble WHERE k = 4),
        texts AS (SELECT 0 AS target, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
            UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
        split AS (SELECT target, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
        occurs AS (SELECT target, id, unnest(words) AS word FROM split),
        counts AS (SELECT target, id, word, count(*) AS n FROM occurs GROUP BY ALL),
        hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counts)),
        crcs AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(h), 2),
                lambda i: [strpos('0123456789ABCDEF', h[i + 1]) - 1, strpos('0123456789ABCDEF', h[i]) - 1]))),
                lambda c, x: xor(c >> 4, t[xor(c & 15, x) + 1]))) % 10000 AS bucket FROM hexed, steps),
        sums AS (SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target = 1), 0)::DOUBLE AS t
            FROM counts JOIN crcs USING (word) GROUP BY bucket),
        whole AS (SELECT coalesce(sum(s), 0) AS sa, coalesce(sum(t), 0) AS ta FROM sums),
        gain AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sa + 10000)) / ((s + 1) * (ta + 10000)))) AS BIGINT) AS gain FROM sums, whole),
        weights AS (SELECT id, CAST(sum(n * gain) AS BIGINT) AS weight FROM counts JOIN crcs USING (word) JOIN gain USING (bucket) WHERE target = 0 GROUP BY id),
        scored AS (SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM split LEFT JOIN weights USING (id) WHERE target = 0),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
        SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM placed) THEN rank END AS rank
        FROM scored s LEFT JOIN placed USING (doc_id)""",
    "op9_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        u AS (SELECT page_id, lower(trim(coalesce(url, '-'))) AS url FROM pages),
        v AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '') AS host,
                  regexp_replace(regexp_replace(url, '^[a-z][a-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS rest FROM u),
        w AS (SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), ',') || ')'
                  || coalesce(nullif(regexp_extract(rest, '^[^?]*', 0), ''), '/') || regexp_extract(rest, '\?.+$', 0) AS urlkey,
                  strftime(make_timestamp((946684800 + page_id) * 1000000), '%Y%m%d%H%M%S') AS ts FROM v),
        k AS (SELECT *, row_number() OVER (ORDER BY urlkey, ts, page_id) - 1 AS position FROM w),
        g AS (SELECT html, max(page_id) AS response FROM p WHERE strlen(html) >= 1000 GROUP BY html)
        SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
            CASE WHEN g.response <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN g.response <> p.page_id THEN g.response END AS refers_to, k.urlkey, k.ts, k.position
        FROM p JOIN k ON p.page_id = k.page_id LEFT JOIN g ON p.html = g.html""",
    "op5_line_dedup": """
        WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        totals AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
        held AS (SELECT source, unnest(list_distinct(lines)) AS line FROM d),
        counts AS (SELECT source, line, count(*) AS n FROM held WHERE trim(line) <> '' GROUP BY source, line HAVING count(*) >= 2),
        bad AS (SELECT c.source, list(c.line) AS bad FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
                WHERE c.n / t.pages > 0.02 GROUP BY c.source)
        SELECT d.doc_id, d.source, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) END AS BIGINT) AS n_lines,
            CAST(len(list_filter(d.lines, lambda x: trim(x) <> '' AND list_contains(coalesce(b.bad, []), x))) AS BIGINT) AS n_dropped,
            sha256(array_to_string(list_filter(d.lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(b.bad, []), x)), chr(10))) AS kept_sha256
        FROM d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op1_fingerprints": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        s AS (SELECT doc_id, text, length(text) AS n, length(text) // 4 AS k,
                  coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM d),
        e AS (SELECT doc_id, n, nxt, text, substr(text, 1, n - k) || substr(nxt, 1, k) AS edited FROM s),
        p AS (SELECT doc_id, n, edited,
                  regexp_extract_all(text, '(?:[^.!?\n]{1,256}[.!?]{0,8}|[.!?]{1,8}) ?\n?|\n') AS a,
                  regexp_extract_all(edited, '(?:[^.!?\n]{1,256}[.!?]{0,8}|[.!?]{1,8}) ?\n?|\n') AS b,
                  list_distinct(regexp_extract_all(nxt, '(?:[^.!?\n]{1,256}[.!?]{0,8}|[.!?]{1,8}) ?\n?|\n')) AS c FROM e),
        q AS (SELECT doc_id, n, edited, list_distinct(a) AS la, list_distinct(b) AS lb, c,
                  list_transform(string_split(array_to_string(list_transform(a, lambda x: substr(sha256(x), 1, 32) || CASE WHEN ends_with(x, chr(10)) THEN ';' ELSE ',' END), ''), ';'), lambda x: substr(sha256(x), 1, 32)) AS pa,
                  list_transform(string_split(array_to_string(list_transform(b, lambda x: substr(sha256(x), 1, 32) || CASE WHEN ends_with(x, chr(10)) THEN ';' ELSE ',' END), ''), ';'), lambda x: substr(sha256(x), 1, 32)) AS pb FROM p),
        r AS (SELECT doc_id, n, edited, la, lb, c,
                  list_transform(string_split(array_to_string(list_transform(pa, lambda h: h || CASE WHEN h < '2' THEN ';' ELSE ',' END), ''), ';'), lambda x: substr(sha256(x), 1, 32)) AS sa,
                  list_transform(string_split(array_to_string(list_transform(pb, lambda h: h || CASE WHEN h < '2' THEN ';' ELSE ',' END), ''), ';'), lambda x: substr(sha256(x), 1, 32)) AS sb FROM q)
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
            sha256(array_to_string(sa, ',')) AS fingerprint, sha256(array_to_string(sb, ',')) AS edited_fingerprint,
            CASE WHEN len(la) + len(lb) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(la, lb)) / (len(la) + len(lb)) END AS near_edited,
            CASE WHEN len(la) + len(c) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(la, c)) / (len(la) + len(c)) END AS near_next,
            CAST(len(sb) AS BIGINT) AS n_sections,
            array_to_string(list_filter(range(len(sb)), lambda i: NOT list_contains(sa, sb[i + 1])), ',') AS edited_sections
        FROM r""",
}
