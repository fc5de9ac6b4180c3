"""The thin `opN_<name>` queries, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.arrays import let
from gristmill.llm import ctw, decontam, html_text, jaccard, licenses, line_dedup, quality, resample, runs, sentencepiece_codec, token_output, topk, url_filter

#: Where the public tokenizers' files are; a parameter of every operator that reads one.
PIECES = os.environ.get("GRISTMILL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_output.materialise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return token_output.sequences(shards).select(F.col("doc").alias("doc_id"), "seq", "slot", "shard", "n_tokens", F.sha2("record", 256).alias("record_sha256"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.fit(docs))
    return found.select("doc_id", "n_paragraphs", F.size("at").cast("long").alias("n_licensed"), F.concat_ws(",", F.array_sort(F.array_distinct("families"))).alias("families"), "chance")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.remainder("doc_id", 5) == 0, F.lit(False))
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_frame(spark)).drop("url")


OP4_SQL = r"""
WITH urls AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM urls
), rules(v, rule, h, p) AS (
    VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), fitting AS (
    SELECT page_id, host, path, v, rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS r
    FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fitting WHERE r = 1
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return out.select("doc_id", "n_ids", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("exact"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), repeated AS (
    SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT keyed.*, keep IS NOT NULL AND doc_id < keep AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)), F.lit(0))
    return ctw.weighted(ctw.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), rest != 2, rest == 2))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP8_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(64 * CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM (SELECT DISTINCT * FROM whole WHERE vec_id % 20 = 0) q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit, names = F.size("hits").cast("long"), F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.size("near").cast("long").alias("n_near"),
    )


OP9_SQL = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), grams AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
    SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
), places AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs
), rare AS (
    SELECT item_id, word FROM (
        SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), word) AS r
        FROM (SELECT DISTINCT item_id, unnest(w) AS word FROM items) LEFT JOIN (SELECT word, count(*) AS n FROM places GROUP BY word) USING (word)
    ) WHERE r <= 3
), seen AS (
    SELECT item_id, doc_id, word, p FROM rare JOIN places USING (word)
), close AS (
    SELECT a.doc_id, a.item_id FROM seen a JOIN seen b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p AND a.p + 25
    GROUP BY a.doc_id, a.item_id, a.p HAVING count(DISTINCT b.word) = (SELECT count(*) FROM rare r WHERE r.item_id = a.item_id)
), near AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))

def looped(text: Column, doc_id: Column) -> Column:
    """A text of which the words from a = g % n on repeat with period 1 + (n - a) div (3 + g % 8), if the id's CRC-32 ends in 0 (g: its tenth); other texts, wordless ones too, as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        def from_(a: Column) -> Column:
            return let(1 + F.floor((F.size(words) - a) / (3 + g % 8)), lambda p: F.transform(words, lambda w, i: F.when(i >= a, F.element_at(words, (a + (i - a) % p + 1).cast("int"))).otherwise(w)))

        return F.when(F.size(words) > 0, F.array_join(let(g % F.size(words), from_), " ")).otherwise("")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, repeat)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.find_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    found = found.withColumns({"best": best, "period": -best["period"]})
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), "period", F.expr("1000 * best.length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The CRC-32 of the words in a list column `b` of byte values, as a CTE `crcs` from a CTE `bytes(word, b)`.
_CRC_SQL = """tab AS (
    SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))
), crcs AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS crc FROM bytes, tab
)"""

OP11_SQL = rf"""
WITH bytes AS (
    SELECT DISTINCT doc_id AS word, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM documents
), {_CRC_SQL}, plain AS (
    SELECT doc_id, crc AS h, crc // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents JOIN crcs ON doc_id = word
), planned AS (
    SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM plain
), shaped AS (
    SELECT doc_id, len(w) AS n, CASE WHEN a IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN i > a THEN w[a + (i - 1 - a) % p + 1] ELSE x END) END AS w
    FROM (SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM planned)
), words AS (
    SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM shaped
), met AS (
    SELECT a.doc_id, a.i, b.i - a.i AS p FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i WHERE 4 * (b.i - a.i) <= a.n
), stretches AS (
    SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS same FROM met) GROUP BY doc_id, p, same
), runs AS (
    SELECT doc_id, start, length, min(p) AS period FROM stretches WHERE length >= greatest(6, 4 * p) GROUP BY doc_id, start, length
), listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
           min(struct_pack(l := -length, s := start, p := period)) AS best FROM runs GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words w
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period, 1000 * -best.l // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM plain LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = rf"""
WITH texts AS (
    SELECT doc_id, text, false AS aim FROM documents UNION ALL SELECT NULL, text, true FROM benchmark
), words AS (
    SELECT doc_id, aim, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), counted AS (
    SELECT doc_id, aim, word, count(*) AS n FROM words GROUP BY ALL
), bytes AS (
    SELECT word, list_transform(range(length(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT word, hex(encode(word)) AS x FROM counted)
), {_CRC_SQL}, hashed AS (
    SELECT doc_id, aim, n, crc % 10000 AS bucket FROM counted JOIN crcs USING (word)
), sums AS (
    SELECT CAST(coalesce(sum(n) FILTER (WHERE NOT aim), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE aim), 0) AS DOUBLE) AS t FROM hashed
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(sum(n) FILTER (WHERE aim), 0) + 1) * (any_value(s) + 10000) / ((coalesce(sum(n) FILTER (WHERE NOT aim), 0) + 1) * (any_value(t) + 10000)))) AS BIGINT) AS gain
    FROM hashed, sums GROUP BY bucket
), weights AS (
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM hashed JOIN gains USING (bucket) WHERE NOT aim GROUP BY doc_id
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM documents LEFT JOIN weights USING (doc_id)
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_quality": op2_quality,
        "op3_licenses": op3_licenses,
        "op4_url_filter": op4_url_filter,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_line_dedup": op6_line_dedup,
        "op7_ctw": op7_ctw,
        "op8_top_k": op8_top_k,
        "op9_decontamination": op9_decontamination,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_html_extraction": op12_html_extraction,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op6_line_dedup": OP6_SQL, "op8_top_k": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op13_importance_resampling": OP13_SQL}
