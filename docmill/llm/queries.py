"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import encoding, leakage, neardup, offence, pagenoise, pairs, splitting, truncation
from docmill.session import spread
from docmill.session import table as whole_table


QUESTION_TABLES = ("single_shot_questions", "multi_hop_questions", "cross_document_questions")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; dealt out over the cores where it is so small that it is read as one split."""
    return spread(whole_table(spark, sf_dir, name))


def question_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The wanted columns of the three question tables together."""
    first, *rest = (table(spark, sf_dir, name).select(*columns) for name in QUESTION_TABLES)
    for part in rest:
        first = first.unionByName(part)
    return first


def _truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = question_rows(spark, sf_dir, "question_id", "generating_model", "raw_response").select(
        F.lit("raw_response").alias("field"),
        F.col("question_id").cast("string").alias("record_id"),
        F.lower("generating_model").alias("source"),
        F.col("raw_response").alias("text"),
    )
    summaries = table(spark, sf_dir, "chunked").select(
        F.lit("document_summary").alias("field"),
        F.col("document_id").alias("record_id"),
        F.lower("summarization_model").alias("source"),
        F.col("document_summary").alias("text"),
    )
    return truncation.verdicts(responses.unionByName(summaries))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that lost their end."""
    return _truncation(spark, sf_dir).where("cut").select("field", "record_id")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of values that lost their end, per field and model."""
    return truncation.rates(_truncation(spark, sf_dir))


def p1_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at which a model's values pile up, with the values that end there."""
    return truncation.limits(_truncation(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs with the name of each defect."""
    return pairs.defects(question_rows(spark, sf_dir, *pairs.COLUMNS), table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized items: those the splitter cuts."""
    items = splitting.chunked_items(table(spark, sf_dir, "chunked"))
    return splitting.split(items, with_text=False).where("piece = 0").select("field", "item_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pieces of every oversized item."""
    return splitting.split(splitting.chunked_items(table(spark, sf_dir, "chunked")))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized item put together again from its pieces, with the bounds that these keep."""
    whole = splitting.restored(p3_pieces(spark, sf_dir))
    limit = F.when(F.col("field") == "document_text", splitting.DOCUMENT_LIMIT).otherwise(splitting.CHUNK_LIMIT)
    least, most = splitting.OVERLAP
    return whole.select("field", "item_id", "text_hash", (F.col("longest") <= limit).alias("fits"), ((F.col("least_overlap") >= least) & (F.col("most_overlap") <= most)).alias("overlaps"))


def _page_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagenoise.repaired(table(spark, sf_dir, "chunked").select("document_id", F.col("document_text").alias("text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of page noise of each scanned document."""
    return pagenoise.kinds_found(_page_noise(spark, sf_dir))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned documents with their noise and repaired text."""
    return _page_noise(spark, sf_dir).dropDuplicates(["document_id"])


def _near_duplicates(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(question_rows(spark, sf_dir, "question_id", "question", "self_answer"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose common words are at least 0.7 of all their words."""
    return _near_duplicates(spark, sf_dir).pairs()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a partner: class of same words, group of linked classes, number of links."""
    return _near_duplicates(spark, sf_dir).groups()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encoding.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k")


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text from its ids, and where the last id ends."""
    spans = encoding.encode_with_offsets(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k")
    end = F.coalesce(F.array_max("ends"), F.lit(0)).cast("long")
    return spans.select("doc_id", F.md5(encoding.decode_ids(F.col("ids"), "byte_bpe_50k")).alias("text_hash"), end.alias("characters"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items they contain."""
    return leakage.leaked_documents(_leaks(spark, sf_dir))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked evaluation items with their number of documents."""
    return leakage.leaked_items(_leaks(spark, sf_dir)).select("item_id", "documents")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain no evaluation item, with the hash of their text."""
    clean = leakage.without_leaks(table(spark, sf_dir, "documents"), _leaks(spark, sf_dir))
    return clean.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))


def _offence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offence.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an offending statement."""
    return offence.named(_offence(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, with the statement that made it."""
    return offence.once(_offence(spark, sf_dir)).select("doc_id", "score", "statement")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of offending documents per source."""
    return offence.rates(_offence(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The registered queries by name."""
    registered = (
        p1_found, p1_rates, p1_limits, p2_found, p3_found, p3_pieces, p3_restored, p4_found, p4_repaired, p5_found,
        p5_groups, p6_ids, p6_text, p7_found, p7_items, p7_clean, p8_found, p8_scores, p8_rates,
    )
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {
        "p3_found": """
            SELECT DISTINCT 'document_text' AS field, document_id AS item_id FROM chunked WHERE length(document_text) > 4000
            UNION
            SELECT DISTINCT 'chunk_text', c.chunk_id FROM (SELECT unnest(chunks) AS c FROM chunked) WHERE length(c.chunk_text) > 1200
        """,
        "p3_restored": """
            SELECT DISTINCT 'document_text' AS field, document_id AS item_id, md5(document_text) AS text_hash, true AS fits, true AS overlaps FROM chunked WHERE length(document_text) > 4000
            UNION
            SELECT DISTINCT 'chunk_text', c.chunk_id, md5(c.chunk_text), true, true FROM (SELECT unnest(chunks) AS c FROM chunked) WHERE length(c.chunk_text) > 1200
        """,
        "p6_text": "SELECT doc_id, md5(coalesce(text, '')) AS text_hash, length(coalesce(text, '')) AS characters FROM documents",
        "p7_items": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT item_id, regexp_extract_all(lower(unnest([passage, question])), '[\p{L}\p{N}]+') AS w FROM eval_items),
            g AS (SELECT item_id, unnest(generate_series(1, len(w) - 17)) AS s, w FROM i),
            dg AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 17], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 17)) AS s FROM d)),
            hit AS (SELECT DISTINCT doc_id, item_id FROM g JOIN dg ON dg.g = array_to_string(g.w[g.s : g.s + 17], ' '))
            SELECT item_id, count(DISTINCT doc_id) AS documents FROM hit GROUP BY item_id
        """,
        "p7_clean": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT regexp_extract_all(lower(unnest([passage, question])), '[\p{L}\p{N}]+') AS w FROM eval_items),
            dg AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 17], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 17)) AS s FROM d)),
            ig AS (SELECT DISTINCT array_to_string(w[s : s + 17], ' ') AS g FROM (SELECT w, unnest(generate_series(1, len(w) - 17)) AS s FROM i))
            SELECT doc_id, md5(coalesce(text, '')) AS text_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dg JOIN ig USING (g))
        """,
        "p7_found": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT item_id, regexp_extract_all(lower(unnest([passage, question])), '[\p{L}\p{N}]+') AS w FROM eval_items),
            dg AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 17], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 17)) AS s FROM d)),
            ig AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 17], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 17)) AS s FROM i))
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
        """,
        "p5_found": """
            WITH r AS (
                SELECT question_id AS id, question, self_answer FROM single_shot_questions
                UNION SELECT question_id, question, self_answer FROM multi_hop_questions
                UNION SELECT question_id, question, self_answer FROM cross_document_questions),
            w AS (
                SELECT DISTINCT id, unnest(regexp_extract_all(lower(question || ' ' || coalesce(self_answer, '')), '[\\p{L}\\p{N}]+')) AS w
                FROM r WHERE regexp_matches(question, '[^\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{3000}]')),
            n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
            c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
            SELECT a AS question_id_a, b AS question_id_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b
            WHERE 10 * c >= 7 * (x.n + y.n - c)
        """,
    }
