"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostelry.functions.storage import table
from hostelry.llm import best_fit_packing as op13
from hostelry.llm import bm25_search as op7
from hostelry.llm import byte_bpe as op10
from hostelry.llm import jaccard_join as op5
from hostelry.llm import chat_tree as op3
from hostelry.llm import collocations as op11
from hostelry.llm import merkle_audit as op4
from hostelry.llm import ngram_trie as op9
from hostelry.llm import quality_rules as op8
from hostelry.llm import secret_scan as op2
from hostelry.llm import source_mix as op6
from hostelry.llm import token_alignment as op12
from hostelry.llm import token_counts as op1


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op2.secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in op2.RULES]
    spans = op2.digest(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


OP2_KINDS = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}


def _op2_sql() -> str:
    parts = []
    for place, (kind, (pattern, group, least)) in enumerate(OP2_KINDS.items()):
        parts.append(f"""
            SELECT doc_id, {place} AS place, '{kind}' AS kind,
                   list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
                   length(hits[i]) AS size
            FROM (
                SELECT *, unnest(range(1, len(hits) + 1)) AS i
                FROM (
                    SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits,
                           regexp_extract_all(t, '{pattern}', {group}) AS vals
                    FROM texts WHERE regexp_matches(t, '{pattern}')
                )
            )
            WHERE length(vals[i]) >= {least}""")
    return f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        spans AS ({" UNION ALL ".join(parts)}),
        listed AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, place) AS spans
            FROM spans GROUP BY doc_id
        )
        SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM texts t LEFT JOIN listed USING (doc_id)"""


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return op3.read_back(*op3.pack(turns))


def _replica(pages: DataFrame) -> DataFrame:
    """The second replica: every 97th page has a changed byte, every 389th has lost its end."""
    html = (
        F.when(F.col("page_id") % 389 == 11, F.expr("left(html, length(html) - 3)"))
        .when(F.col("page_id") % 97 == 5, F.concat(F.lit("~"), F.expr("substring(html, 2)")))
        .otherwise(F.col("html"))
    )
    return pages.withColumn("html", html)


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return op4.audit(op4.records(pages), op4.records(_replica(pages)))


_OP4_SQL = f"""
    WITH two AS (
        SELECT page_id, url, CASE WHEN page_id % 389 = 11 THEN left(html, length(html) - 3)
               WHEN page_id % 97 = 5 THEN '~' || substring(html, 2) ELSE html END AS html FROM pages
    ),
    both_replicas AS (
        SELECT 'a' AS side, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
        UNION ALL SELECT 'b', page_id, coalesce(url, ''), coalesce(html, '') FROM two
    ),
    raw AS (
        SELECT side, page_id, coalesce(page_id // {op4.FILE_RECORDS}, -1) AS file,
               'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
               || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
               || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
        FROM both_replicas
    ),
    sized AS (SELECT side, page_id, file, sha256(record) AS content, CAST(strlen(record) AS BIGINT) AS size FROM raw),
    placed AS (
        SELECT *, row_number() OVER w - 1 AS record,
               CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM sized WINDOW w AS (PARTITION BY side, file ORDER BY page_id, content)
    ),
    hashed AS (SELECT *, sha256(start || ':' || size || ':' || content) AS hash FROM placed)
    SELECT coalesce(a.file, b.file) AS file, coalesce(a.record, b.record) AS record, a.page_id AS page_id_a, a.start AS start_a,
           a.size AS size_a, a.hash AS hash_a, b.page_id AS page_id_b, b.start AS start_b, b.size AS size_b, b.hash AS hash_b
    FROM (SELECT * FROM hashed WHERE side = 'a') a FULL JOIN (SELECT * FROM hashed WHERE side = 'b') b
      ON a.file = b.file AND a.record = b.record
    WHERE a.hash IS DISTINCT FROM b.hash"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.classes(table(spark, sf_dir, "documents"))


_OP5_SQL = f"""
    WITH RECURSIVE lists AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    sets AS (
        SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {op5.WORDS} THEN list_transform(range(1, len(w) - {op5.WORDS} + 2), lambda i: array_to_string(w[i:i + {op5.WORDS} - 1], ' '))
                                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM lists
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY ALL),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {op5.WHOLE} * k >= {op5.PART} * (x.n + y.n - k)
    ),
    reached AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id
    FROM lists LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reached GROUP BY ALL) USING (doc_id)"""


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = op6.draws(table(spark, sf_dir, "documents"))
    rows = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), "draws"
    )


def op7_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = op7.search(docs, docs.where("doc_id % 100 = 0"), k=10)
    return found.select(F.col("query").alias("query_id"), "rank", "doc_id", F.round("score", 6).alias("score"))


_OP7_SQL = f"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x20\x09-\x0D]+')) AS term FROM documents
    ),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    lengths AS (SELECT doc_id, sum(tf) AS size FROM counts GROUP BY ALL),
    whole AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(size) FROM lengths) / (SELECT count(*) FROM documents) AS mean),
    terms AS (SELECT term, count(*) AS df FROM counts GROUP BY ALL),
    scored AS (
        SELECT q.doc_id AS query_id, d.doc_id,
               round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * {op7.K1 + 1}
                         / (d.tf + {op7.K1} * ({1 - op7.B} + {op7.B} * size / mean))), 6) AS score
        FROM counts q JOIN terms USING (term) JOIN counts d USING (term) JOIN lengths ON lengths.doc_id = d.doc_id, whole
        WHERE q.doc_id % 100 = 0 GROUP BY ALL
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scored QUALIFY rank <= 10"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op8.quality(table(spark, sf_dir, "documents"), ["doc_id"])
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept p_good"
    return judged.select(*columns.split())


def op9_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.scores(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = op10.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return op10.decode(encoded, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.collocations(table(spark, sf_dir, "documents"))


_OP11_SQL = f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY ALL),
    sizes AS (SELECT unnest(range(1, {op11.WORDS + 1})) AS k),
    grams AS (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, sizes WHERE len(w) >= k)
    ),
    counts AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {op11.LEAST}),
    cuts AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
    scores AS (
        SELECT x.lang, x.phrase, x.a, c, l.a AS l, r.a AS r, n,
               CAST(CAST(1000 AS HUGEINT) * x.a * n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
        FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:c], ' ')
        JOIN counts r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[c + 1:x.k], ' ') JOIN totals t ON t.lang = x.lang
    ),
    least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    spans AS (SELECT lang, a, w, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT lang, k, a, w, unnest(range(2, k)) AS s FROM (SELECT DISTINCT lang, k, a, w FROM cuts))),
    longer AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM spans GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM least LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR most < a
    QUALIFY rank <= {op11.TOP}"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op12.aligned(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    )
    digest = F.when(F.size("links") > 0, F.sha2("groups", 256)).otherwise("")
    counted = op12.alignment(found.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = op13.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    packed = op13.pack(cut_up.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_tree": op3_chat_tree,
    "op4_merkle_audit": op4_merkle_audit,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_source_mix": op6_source_mix,
    "op7_bm25_search": op7_bm25_search,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_trie": op9_ngram_trie,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_collocations": op11_collocations,
    "op12_token_alignment": op12_token_alignment,
    "op13_best_fit_packing": op13_best_fit_packing,
}
ORACLE_SQL: dict[str, str] = {"op2_secret_scan": _op2_sql(), "op4_merkle_audit": _OP4_SQL, "op5_jaccard_join": _OP5_SQL, "op7_bm25_search": _OP7_SQL, "op11_collocations": _OP11_SQL}
