"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    chat, collocations, decontam, hostrules, lexical, licenses, neardup, packing, quality, sharding, substrings, topk,
    toxicity)
from larder.llm.common import read_table, written


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards near equal in bytes."""
    return sharding.shard(read_table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text licence and line notices of every document."""
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by words, in sequences of 512 to 4096."""
    return packing.pack(packing.word_lengths(read_table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item it leaks."""
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 0.8 on 4-word shingles."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that 20-word repeats cover, per document."""
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"), window=20).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the verdict of document and host."""
    return hostrules.host_quality(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes control strings, read back from
    the emitted prefix trees."""
    quoted = spark.sql("select -7L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text "
                       "from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(quoted)
    convs = written(chat.conversation_turns(rows), "turns")
    out = chat.read_back(written(chat.prefix_trees(convs), "trees"))
    return convs.select("conv_id", "leaf").join(out, "leaf").drop("leaf")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every 50th one."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_license_scan, op3_packing, op4_decontamination, op5_near_duplicates, op6_toxicity,
    op7_substring_dedup, op8_host_rules, op9_quality, op10_chat_format, op11_collocations, op12_top_k,
    op13_lexical_search)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, '{licenses.COPYRIGHT_LINE}', '', 'g')"
    out = f"regexp_replace({out}, '{licenses.ITEM_NUMBER}', '', 'g')"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"regexp_replace({out}, '{licenses.NOT_WORD}', ' ', 'g')"


def _digest_sql(lines: str) -> str:
    return f"sha256(trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'), ' '))"


def _known_sql(texts) -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in texts)
    return (f"(SELECT {_digest_sql('c')} AS digest, min(i) AS license_id FROM (SELECT i, {_canonical_sql('t')} AS c "
            f"FROM (VALUES {values}) AS v(i, t)) GROUP BY 1)")


def _escaped_length(column: str) -> str:
    marks = " + ".join(f"length({column}) - length(replace({column}, '{c}', ''))" for c in "\\<[")
    return f"(length({column}) + {marks})"


def _marks_sql() -> str:
    cases = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in chat.MARKS.items())
    return f"CASE role {cases} ELSE {sum(map(len, chat.OTHER))} + {_escaped_length('role')} END"


ORACLE = {
    "op2_license_scan": f"""
WITH canonical AS (SELECT doc_id, {_canonical_sql('text')} AS lines FROM documents),
whole AS (SELECT doc_id, {_digest_sql('lines')} AS digest FROM canonical),
line AS (SELECT doc_id, {_digest_sql('line')} AS digest
           FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM canonical) WHERE trim(line) <> ''),
named AS (SELECT doc_id, list_sort(list(DISTINCT license_id)) AS notices
            FROM line JOIN {_known_sql(licenses.NOTICES)} USING (digest) GROUP BY 1)
SELECT w.doc_id, w.digest, k.license_id, coalesce(n.notices, []::VARCHAR[]) AS notices
  FROM whole w LEFT JOIN {_known_sql(licenses.LICENSES)} k USING (digest) LEFT JOIN named n ON n.doc_id = w.doc_id""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM win)
           WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
           FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
  FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op8_host_rules": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines, sum(n) AS n_lines FROM (
          SELECT doc_id, l, count(*) AS n FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY 1),
win AS (SELECT doc_id, s, w[s:s + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
          FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p FROM twice) GROUP BY 1),
base AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
                CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
                CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
           FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
judged AS (SELECT *, n_words < {hostrules.MIN_WORDS}
                  OR 100 * n_repeat_words > {hostrules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
                  base_failed OR 100 * n_symbols > {hostrules.MAX_SYMBOL_PERCENT} * n_words
                  OR 100 * n_dup_lines > {hostrules.MAX_DUP_LINE_PERCENT} * n_lines AS failed FROM base),
host AS (SELECT source, count(*) AS n, sum(CAST(failed AS INT)) AS f FROM judged WHERE source IS NOT NULL GROUP BY 1),
prior AS (SELECT avg(f / n) AS m, CASE WHEN coalesce(var_samp(f / n), 0) <= 1e-12 THEN 1e6 ELSE
                 greatest(1.0, least(1e6, avg(f / n) * (1 - avg(f / n)) / var_samp(f / n) - 1)) END AS s FROM host),
rate AS (SELECT source, r - {hostrules.CAUTION} * sqrt(r * (1 - r) / (n + s + 1)) AS r
           FROM (SELECT source, n, s, (f + m * s) / (n + s) AS r FROM host, prior))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(r, 0) <= {hostrules.MAX_RATE} AS kept
  FROM judged LEFT JOIN rate ON rate.source = judged.source""",
    "op10_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST({len(chat.BEGIN)} + sum({_marks_sql()} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id""",
    "op11_collocations": rf"""
WITH piece AS (SELECT lang, row_number() OVER () AS p, w FROM (
         SELECT lang, regexp_extract_all(unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)) WHERE len(w) > 0),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY 1),
gram AS MATERIALIZED (SELECT lang, k, g AS phrase, count(*) AS f FROM (
         SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
           SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM piece, range(1, 6) AS r(k) WHERE len(w) >= k))
         GROUP BY ALL HAVING count(*) >= 100),
longer AS (SELECT lang, array_to_string(string_split(phrase, ' ')[a:a + n - 1], ' ') AS phrase, max(f) AS f FROM (
             SELECT lang, phrase, f, k, n, unnest(range(1, k - n + 2)) AS a FROM gram, range(2, 5) AS r(n) WHERE n < k)
            GROUP BY 1, 2),
cand AS (SELECT lang, phrase, k, g.f AS a FROM gram g LEFT JOIN longer x USING (lang, phrase)
          WHERE k >= 2 AND (x.f IS NULL OR 100 * x.f < 100 * g.f)),
cut AS (SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS x,
               array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS y FROM cand, range(1, 5) AS r(j) WHERE j < k),
scored AS (SELECT c.lang, c.phrase, a, j, l.f AS l, r.f AS r, n,
                  CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
             FROM cut c JOIN gram l ON l.lang = c.lang AND l.phrase = x JOIN gram r ON r.lang = c.lang AND r.phrase = y
             JOIN total ON total.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank,
       phrase, a, l, r, n, score
  FROM weakest QUALIFY rank <= 2000""",
    "op12_top_k": """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
             FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
             FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
  FROM scored QUALIFY rank <= 5""",
    "op13_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents),
whole AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY ALL),
m AS (SELECT row, doc_id, 25 + (75 * len(t) * n_docs) // n_terms AS m FROM d, whole WHERE len(t) > 0),
item AS (SELECT key, item_id, term, count(*) AS n FROM (
           SELECT row_number() OVER () AS key, item_id, {_TERMS} AS t FROM benchmark), unnest(t) AS u(term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
        FROM tf, whole WHERE term IN (SELECT term FROM item) GROUP BY 1),
scored AS (SELECT key, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, row,
                  CAST(sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
             FROM item JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY key, row)
SELECT item_id, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
  FROM scored WHERE score > 0 QUALIFY rank <= 10""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
