"""One query per operator, with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from accessloom.llm import common, decontaminate, exact_dedup, langid, manifest, mixing, ngram_join, packing, pii, secrets, spelling, token_output, toxicity, warc
from accessloom.session import prepare


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(prepare(spark), sf_dir, "documents")


def _fold(folds: int, held: int) -> Column:
    """Whether a document is held out; one without id is not, and is not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialise(_docs(spark, sf_dir)).drop("path")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_docs(spark, sf_dir), links=True).drop("row_key", "class_key")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _docs(spark, sf_dir), _fold(5, 0)
    net = toxicity.train(docs, common.table(spark, sf_dir, "labels"), ~held)
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _docs(spark, sf_dir), _fold(3, 1)
    samples = langid.train(docs.where(~held))
    return docs.select("doc_id", held.alias("held_out"), langid.predict(F.col("text"), samples).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_docs(spark, sf_dir), common.table(spark, sf_dir, "benchmark")).drop("doc_key")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    detector = pii.train(docs)
    return docs.select("doc_id", pii.detect(F.col("text"), detector).alias("p")).select("doc_id", "p.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir)).withColumnsRenamed({"_copy": "copy", "_rate": "rate", "_order": "order_key"})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(prepare(spark), sf_dir, "pages")).drop("payload", "url")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir), digest_all=True)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_scan(_docs(spark, sf_dir)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_docs(spark, sf_dir), slip=97).select("word", "form", "root", "n", "n_near", "form_n")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(changed, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    tampered = manifest.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    rows = manifest.manifest(docs, other_leaf=tampered).withColumn("folded_root", manifest.folded("other_leaf", "siblings", "sides"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "siblings"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_docs(spark, sf_dir))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {f.__name__: f for f in (
    op1_token_output, op2_ngram_join, op3_toxicity, op4_langid, op5_decontaminate, op6_pii, op7_mix_sources, op8_warc,
    op9_exact_dedup, op10_secret_scan, op11_spelling_variants, op12_manifest, op13_packing)}

_UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE"
_CRC_TABLE = """crc_table AS MATERIALIZED (
            SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k) ORDER BY k) AS t
            FROM range(256) r(k))"""


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned checksum of a text's UTF-8 bytes, by the table ``t``."""
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex({text}), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"

_STEP = """sha256(CASE WHEN s.digest IS NULL THEN folded WHEN w.i % 2 = 1 THEN s.digest || folded ELSE folded || s.digest END)"""
_CHECKSUM_7 = _crc32("doc_id::VARCHAR") + " % 7 = 0"



def _span_sql() -> str:
    """DuckDB SQL for all matches that count, of each kind of ``secrets``: id, kind, start, end."""
    def literal(pattern: str) -> str:
        # Either case is written out, as the flag would also fold letters beyond ASCII here.
        flagged = re.sub(r"\(\?i:([^()]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern)
        return "'" + flagged.replace("'", "''") + "'"

    def of(number: int, name: str, pattern: str, group: int, least: int) -> str:
        mixed = "".join(f" AND regexp_matches(hit, '{c}')" for c in ("[a-z]", "[A-Z]", "[0-9]")) if name == "weak" else ""
        return f"""
            SELECT id, {number} AS kind, stop - length(hit) AS start, stop AS end FROM (
                SELECT id, hit, bound, sum(length(gap) + length(hit)) OVER (PARTITION BY id ORDER BY i) AS stop FROM (
                    SELECT id, unnest(hits) AS hit, unnest(bounds) AS bound, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM (
                        SELECT id, regexp_extract_all(text, {literal(pattern)}, 0) AS hits, regexp_extract_all(text, {literal(pattern)}, {group}) AS bounds,
                               regexp_split_to_array(text, {literal(pattern)}) AS gaps FROM texts)))
            WHERE length(bound) >= {least}{mixed}"""

    return " UNION ALL ".join(of(i, *kind) for i, kind in enumerate(secrets.BASE + secrets.WEAK))


_NAMED = f"{list(secrets.KINDS)}[kind + 1] || ':' || start || ':' || \"end\""

ORACLES = {
    "op10_secret_scan": f"""
        WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
        found AS MATERIALIZED ({_span_sql()}),
        free AS MATERIALIZED (
            SELECT * FROM found s WHERE kind IN (0, 2, 5) AND NOT EXISTS (
                FROM found h WHERE h.id = s.id AND h.kind IN (3, 4) AND h.start < s.end AND s.start < h.end)),
        shown AS (
            SELECT * FROM found WHERE kind < 3
            UNION ALL
            SELECT * FROM found h WHERE kind IN (3, 4) AND EXISTS (
                FROM free s WHERE s.id = h.id AND (s.start >= h.end OR h.start >= s.end) AND s.start - h.end <= 300 AND h.start - s.end <= 300)
            UNION ALL
            SELECT * FROM free s WHERE kind = 5 AND EXISTS (
                FROM found h WHERE h.id = s.id AND h.kind IN (1, 3, 4) AND (s.start >= h.end OR h.start >= s.end) AND s.start - h.end <= 300
                AND h.start - s.end <= 300))
        SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               count(*) FILTER (kind > 2) AS n_linked,
               sha256(coalesce(string_agg({_NAMED}, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
               coalesce(string_agg({_NAMED}, ',' ORDER BY start, kind), '') AS spans
        FROM texts LEFT JOIN shown USING (id) GROUP BY texts.id, doc_id""",
    "op5_decontaminate": r"""
        WITH w AS (
            SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
            UNION ALL
            SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
        s AS (
            SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5
                THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS shingle
            FROM w),
        items AS (SELECT id, shingle, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE side = 'i')
        SELECT d.id AS doc_id, i.id AS item_id, any_value(n_item)::INTEGER AS n_item, count(*)::INTEGER AS n_shared,
               count(*)::DOUBLE / any_value(n_item) AS containment
        FROM s d JOIN items i ON d.side = 'd' AND d.shingle = i.shingle
        GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n_item)""",
    "op7_mix_sources": f"""
        WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source),
        whole AS (SELECT sum(weight) AS weights, sum(n)::DOUBLE AS total FROM sizes),
        rates AS (SELECT source, round(weight / weights * total * 1.0::DOUBLE / n, 9) AS rate FROM sizes, whole),
        parts AS (SELECT source, rate, greatest(1, ceil(rate / 256.0::DOUBLE))::INTEGER AS draws, rate / draws AS mean FROM rates),
        steps AS (
            SELECT source, rate, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS below FROM parts
            UNION ALL
            SELECT source, rate, mean, k + 1, term * mean / (k + 1), below + term * mean / (k + 1) FROM steps
            WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
        drawn AS (SELECT doc_id, source, draws, unnest(generate_series(1, draws)) AS part FROM documents JOIN parts USING (source)),
        draws AS (
            SELECT doc_id, source, CASE WHEN draws = 1 THEN {_UNIT.format("'17|' || doc_id::VARCHAR")}
                ELSE {_UNIT.format("'17|' || doc_id::VARCHAR || '|draw|' || part::VARCHAR")} END AS draw FROM drawn),
        counts AS (
            SELECT doc_id, any_value(rate) AS rate, count(*) FILTER (below <= draw) AS n FROM draws JOIN steps USING (source) GROUP BY doc_id)
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INTEGER AS copy, rate,
               {_UNIT.format("'18|' || d.doc_id::VARCHAR || '|' || c.copy::VARCHAR")} AS order_key
        FROM documents d JOIN (SELECT doc_id, rate, unnest(generate_series(1, n)) AS copy FROM counts) c USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)""",
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op11_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
            FROM documents),
        counted AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM runs GROUP BY doc_id, run),
        summed AS MATERIALIZED (SELECT *, {_crc32("named")} AS h FROM counted, crc_table),
        words AS MATERIALIZED (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
            FROM summed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
        gaps AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM words),
        replaced AS MATERIALIZED (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS k FROM gaps WHERE i < length(word)),
        inserted AS MATERIALIZED (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 1) AS k FROM gaps),
        near AS MATERIALIZED (
            SELECT a.word, b.word AS other, b.n AS other_n, a.n FROM replaced a JOIN replaced b USING (k) WHERE a.word <> b.word
            UNION SELECT a.word, b.word, b.n, a.n FROM replaced a JOIN inserted b USING (k)
            UNION SELECT b.word, a.word, a.n, b.n FROM replaced a JOIN inserted b USING (k)),
        best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
        formed AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
                   CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1),
        walk AS (
            SELECT word, word AS root FROM formed
            UNION ALL
            SELECT walk.word, form FROM walk JOIN formed ON formed.word = walk.root WHERE form IS NOT NULL)
        SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
        FROM formed f JOIN walk USING (word) JOIN formed e ON e.word = walk.root AND e.form IS NULL""",
    "op12_manifest": f"""
        WITH RECURSIVE {_CRC_TABLE},
        hashed AS MATERIALIZED (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
                   {_leaf(f"CASE WHEN {_CHECKSUM_7} THEN n_chars + 1 ELSE n_chars END")} AS tampered
            FROM documents, crc_table),
        leaves AS MATERIALIZED (
            SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id,
                   row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
            FROM hashed),
        nodes AS (
            SELECT tree, 0 AS level, i, leaf AS digest, n FROM leaves
            UNION ALL
            SELECT tree, level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2),
        groups AS MATERIALIZED (
            SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS level, place AS i, subroot AS digest, n FROM groups
            UNION ALL
            SELECT level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2),
        walk AS (
            SELECT id, tree, 0 AS level, i, tampered AS folded, '' AS proof FROM leaves
            UNION ALL
            SELECT id, w.tree, w.level + 1, w.i // 2, {_STEP}, proof || coalesce(s.digest, '')
            FROM walk w JOIN groups g ON g.tree = w.tree LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1)
            WHERE w.level < g.height),
        upper AS (
            SELECT id, 0 AS level, place AS i, folded, proof FROM walk w JOIN groups g ON g.tree = w.tree AND w.level = g.height
            UNION ALL
            SELECT id, w.level + 1, w.i // 2, {_STEP}, proof || coalesce(s.digest, '')
            FROM upper w LEFT JOIN tops s ON s.level = w.level AND s.i = xor(w.i, 1) WHERE w.level < (SELECT max(level) FROM tops))
        SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
        FROM upper u JOIN leaves USING (id) JOIN groups USING (tree) JOIN tops t ON t.n = 1 AND t.level = u.level""",
}
