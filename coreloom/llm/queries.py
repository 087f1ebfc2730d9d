"""The queries opN_<name> and pipeline, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, fim, lattice, linededup, mixing, packing, pii, quality, sigtree, simhash, toxicity, warc
from .common import Scratch, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archive")
    warc.archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.describe(warc.restore(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.apply(table(spark, sf_dir, "documents"), min_chars=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size")
    mixed = mixing.mix(Scratch(spark, "sizes").put("sizes", docs), max_epochs=3)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("repeats")).alias("taken"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents"), unit="line", rate=100, spm=50, seed=7)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "audit")
    return audit.audit(audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch), scratch)


def op13_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.join(table(spark, sf_dir, "documents"), shingle=4, percent=85)


QUERIES = {"op1_simhash": op1_simhash, "op2_warc": op2_warc, "op3_quality_rules": op3_quality_rules, "op4_line_dedup": op4_line_dedup, "op5_hilbert_ann": op5_hilbert_ann, "op6_subword_lattice": op6_subword_lattice, "op7_toxicity": op7_toxicity, "op8_mixing": op8_mixing, "op9_packing": op9_packing, "op10_pii": op10_pii, "op11_fim": op11_fim, "op12_filter_audit": op12_filter_audit, "op13_signature_tree": op13_signature_tree}

SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
BASE32_SQL = " || ".join(f"substr('{warc.BASE32}', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0))
UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {BASE32_SQL} AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM p JOIN b USING (h)""",
    "op3_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {SQL_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
        r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
        f AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                     (len(list_filter(l, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
                     coalesce(n, 0)::BIGINT AS n_repeat_words,
                     array_to_string(list_filter(l, lambda y: NOT (
                        length(regexp_replace(y, '[^!#*$%&|<>{{}}=_~^\\]+', '', 'g')) * 100 > length(y) * {quality.MARK_PERCENT}
                        OR len(regexp_extract_all(y, '[\x20\t][|>/•·»][\x20\t]')) >= {quality.SEPARATOR_COUNT}
                        OR regexp_matches(y, '(?i){quality.PHRASES.replace("'", "''")}')
                        OR len(list_filter(regexp_extract_all(y, '[^\x20\x09-\x0D]+'), lambda v, i: i > 1 AND v = regexp_extract_all(y, '[^\x20\x09-\x0D]+')[i - 1])) * 2 > len(regexp_extract_all(y, '[^\x20\x09-\x0D]+'))
                        OR (len(regexp_extract_all(y, '[^\x20\x09-\x0D]+')) BETWEEN 1 AND {quality.SHORT - 1} AND NOT regexp_matches(y, '{quality.ENDS.replace("'", "''")}')))), chr(10)) AS clean
              FROM d LEFT JOIN c USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (length(t) - length(clean)) * 100 <= length(t) * {quality.LOST_PERCENT} AS kept
        FROM f""",
    "op4_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {UPPER_LOWER}) AS key FROM l),
        f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
        m AS (SELECT doc_id, pos, line, coalesce(first < doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op8_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || len({SQL_WORDS})), 1, 4))::INT AS bin FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS most, sum(source_size) OVER () AS total FROM s),
        a AS (SELECT *, most / weight AS ratio, (total - coalesce(sum(most) OVER (ORDER BY most / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                     / sum(weight) OVER (ORDER BY most / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        v AS (SELECT arg_min(level, ratio) FILTER (level <= ratio) AS level FROM a),
        t AS (SELECT source, source_size, least(weight * v.level, most::DOUBLE) AS target FROM w, v),
        g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
        h AS (SELECT source, bin, sum(size)::BIGINT AS words FROM d GROUP BY source, bin),
        u AS (SELECT h.source, bin, words, target - whole * source_size AS rest, sum(words) OVER (PARTITION BY h.source ORDER BY bin) AS upto FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source),
        c AS (SELECT source, max(bin) AS cut FROM u WHERE words > 0 AND rest > 0 AND upto - words / 2 <= rest GROUP BY source)
        SELECT doc_id, size, source_size, round(target, 6) AS target, size * (whole + CASE WHEN bin <= coalesce(cut, -1) THEN 1 ELSE 0 END)::BIGINT AS taken
        FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source""",
    "op11_fim": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        e AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
                          WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        f AS (SELECT *, array_to_string(u[:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM e),
        g AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM f)
        SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
               sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM g""",
    "op12_filter_audit": rf"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {SQL_WORDS} AS w FROM documents),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                     || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                     || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails
              FROM d LEFT JOIN l USING (doc_id)),
        g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        s AS (SELECT part, o AS filter_order, k::INT AS step, substr(o, k, 1) AS letter,
                     sum(n) FILTER (translate(fails, left(o, k), '') = fails) AS kept,
                     sum(n) FILTER (contains(fails, substr(o, k, 1)) AND translate(fails, left(o, k - 1), '') = fails) AS removed,
                     sum(n) FILTER (contains(fails, substr(o, k, 1)) AND translate(fails, left(o, k - 1), '') <> fails) AS redundant,
                     sum(n) FILTER (fails = substr(o, k, 1)) AS unique_fails,
                     sum(good) FILTER (contains(fails, substr(o, k, 1)) AND translate(fails, left(o, k - 1), '') = fails) AS good_lost,
                     sum(toxic) FILTER (contains(fails, substr(o, k, 1)) AND translate(fails, left(o, k - 1), '') = fails) AS toxic_lost
              FROM g, o, (SELECT unnest(range(1, 6)) AS k) GROUP BY part, o, k)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM s""",
}
