"""The registered queries of the operators, their SQL where SQL can express them, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnotes.llm import bpe, decontaminate, fill_middle, hmm, html_text, jaccard, license_scan, multi_index, phrases, quality, quotes, rule_ledger, secret_scan

#: The vocabulary's file name and where it is found.
VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "source", "lang", "evidence", "host_mean", "path_mean", "posterior", "keep")


def op3_quotes(spark: SparkSession, folder: str) -> DataFrame:
    linked = quotes.link(_table(spark, folder, "conversations"))
    return linked.select("conv_id", "turn", "role", "thread", "depth", "reply_to", "n_quotes", "n_linked", "own", "formatted")


def op4_hmm(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score(_table(spark, folder, "documents"))


def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link(_table(spark, folder, "documents"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, folder, "documents").select("doc_id", "text"), *vocabulary())
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.link(_table(spark, folder, "embeddings"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, folder, "documents"), "source")
    return found.select("doc_id", "nth", "start", "n_chars", "kind", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_report(_table(spark, folder, "documents")).drop("detections")


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    done = fill_middle.transform(_table(spark, folder, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = rule_ledger.ledger(_table(spark, folder, "documents").select("doc_id", "text"))
    verdicts = [(~rule_ledger.passes("base")).alias("base_failed"), rule_ledger.passes().alias("kept")]
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", *verdicts)


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_quality": op2_quality,
    "op3_quotes": op3_quotes,
    "op4_hmm": op4_hmm,
    "op5_jaccard": op5_jaccard,
    "op6_bpe": op6_bpe,
    "op7_multi_index": op7_multi_index,
    "op8_decontaminate": op8_decontaminate,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
    "op11_fill_middle": op11_fill_middle,
    "op12_rule_ledger": op12_rule_ledger,
    "op13_phrases": op13_phrases,
    "pipeline": pipeline,
}

#: Exact shingle containment of every item in every document, over whole tables.
_DECONTAMINATE = """
WITH shingles AS (
    SELECT id, kind, unnest(list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4))) AS s FROM (
        SELECT doc_id AS id, 0 AS kind, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        UNION ALL
        SELECT item_id, 1, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark
    )
), items AS (SELECT DISTINCT id AS item_id, s FROM shingles WHERE kind = 1),
sizes AS (SELECT item_id, count(*) AS size FROM items GROUP BY item_id),
hits AS (
    SELECT d.id AS doc_id, i.item_id, count(DISTINCT i.s) AS matched
    FROM (SELECT id, s FROM shingles WHERE kind = 0) d JOIN items i ON d.s = i.s GROUP BY d.id, i.item_id
)
SELECT doc_id, item_id, matched, size, matched / size AS containment FROM hits JOIN sizes USING (item_id) WHERE matched * 100 >= size * 75
"""

#: Units of every text as a list, cut and joined again; the parts of the output are taken apart by their lengths.
_FILL_MIDDLE = """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents
), numbers AS (
    SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
    FROM units
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), pieces AS (
    SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
), made AS (
    SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM pieces
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(o) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN o
        WHEN 'psm' THEN substr(o, 4, length(p)) || substr(o, 10 + length(p) + length(s)) || substr(o, 7 + length(p), length(s))
        ELSE substr(o, 7 + length(s), length(p)) || substr(o, 10 + length(p) + length(s)) || substr(o, 4, length(s)) END) AS restored_sha256
FROM made
"""

#: The measurements that rules look at, from lists of words and lines; windows are counted by grouping.
_RULE_LEDGER = """
WITH texts AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS seen FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM texts)
), repeats AS (
    SELECT k, count(DISTINCT i + j) AS n FROM (SELECT k, i, unnest([0, 1, 2]) AS j FROM windows WHERE seen > 1) GROUP BY k
), measures AS (
    SELECT doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(t, '\\P{Lu}', '', 'g')) AS capitals,
        len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS dots, len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•·‣▪]'))) AS bullets,
        length(t) - length(replace(t, '\ufffd', '')) AS broken
    FROM texts LEFT JOIN repeats r USING (k)
), bits AS (
    SELECT *, coalesce(chars, 0) AS word_chars,
        (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_words > 100000)::BIGINT
        + 8 * (coalesce(chars, 0) < 2 * n_words)::BIGINT + 16 * (coalesce(chars, 0) > 20 * n_words)::BIGINT + 32 * (100 * n_symbols > 10 * n_words)::BIGINT
        + 64 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 128 * (100 * capitals > 50 * coalesce(chars, 0))::BIGINT
        + 256 * (100 * dots > 30 * n_lines)::BIGINT + 512 * (100 * bullets > 90 * n_lines)::BIGINT + 1024 * (broken > 0)::BIGINT AS failed
    FROM measures
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(failed AS BIGINT) AS failed, failed & 3 <> 0 AS base_failed, failed & 1019 = 0 AS kept
FROM bits
"""

#: Phrases of every piece counted by grouping; a candidate inside a longer one that is as frequent goes.
_PHRASES = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS size FROM words)
), counts AS (
    SELECT lang, size, phrase, count(*) AS f FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM places) GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM counts WHERE size > 1 AND f >= 100
), stay AS (
    SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.size > c.size AND 100 * o.f >= 100 * c.f AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
    SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM stay)
), scored AS (
    SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(h.f AS HUGEINT) * t.f) AS score
    FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.rest JOIN totals o ON o.lang = c.lang
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

#: Shared shingles of all pairs of documents that have one, and what links reach.
_JACCARD = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), shingles AS (
    SELECT doc_id, unnest(s) AS x FROM sets
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS id, doc_id AS r FROM sets UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a
)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(r) AS component_id FROM sets JOIN reach ON id = doc_id GROUP BY doc_id
"""

#: Cosines of all pairs of sound vectors, and what links reach.
_MULTI_INDEX = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_aggregate(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x), 'sum') AS size FROM embeddings
), sound AS (
    SELECT vec_id, v FROM vectors WHERE size > 0 AND isfinite(size) AND len(list_filter(v, lambda x: x IS NULL)) = 0
), edges AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
    SELECT vec_id AS id, vec_id AS r FROM vectors UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a
), many AS (
    SELECT a, count(*) AS n FROM edges GROUP BY a
)
SELECT vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM vectors JOIN reach ON id = vec_id LEFT JOIN many ON a = vec_id GROUP BY vec_id
"""

ORACLES: dict[str, str] = {"op5_jaccard": _JACCARD, "op7_multi_index": _MULTI_INDEX, "op8_decontaminate": _DECONTAMINATE, "op11_fill_middle": _FILL_MIDDLE, "op12_rule_ledger": _RULE_LEDGER, "op13_phrases": _PHRASES}
