"""DuckDB SQL of the core queries, written apart from their Spark code."""

from __future__ import annotations

_BLANK = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '[ \\t\\r\\n]+'), lambda w: w <> '')"


def _key(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\p{{Nd}}+', '', 'g')"
    return _strip(f"regexp_replace({bare}, '{_BLANK}+', ' ', 'g')")


def _tag(x: str, tag: str) -> str:
    closed, opened = f"(?s)<{tag}>(.*?)</{tag}>", f"(?s)<{tag}>(.*)"
    x = f"coalesce({x}, '')"
    return _strip(f"CASE WHEN regexp_matches({x}, '{closed}') THEN regexp_extract({x}, '{closed}', 1) ELSE regexp_extract({x}, '{opened}', 1) END")


def _windows(size: int, overlap: int) -> str:
    return f"""
        WITH w AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE {_strip("text")} <> ''),
        s AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, {size - overlap})) AS s FROM w)
        SELECT doc_id::VARCHAR AS document_id, doc_id || '_' || (s // {size - overlap}) AS chunk_id, array_to_string(w[s + 1 : s + {size}], ' ') AS chunk_text FROM s
    """


_CHUNKED = """
    c AS (SELECT document_id, any_value(document_text) AS document_text, any_value(document_filename) AS document_filename, any_value(document_summary) AS document_summary,
                 any_value(chunks) AS chunks, any_value(multihop_chunks) AS multihop_chunks FROM chunked GROUP BY document_id)
"""


def _sample(size: str) -> str:
    return f"""
        WITH {_CHUNKED},
        e AS (SELECT document_id, chunks, len(chunks) AS n, unnest(generate_series(0, len(chunks) - 1)) AS i FROM c WHERE len(chunks) > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY md5(document_id || ':42:' || i)) AS k FROM e)
        SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS n, chunks[i + 1].chunk_id AS chunk_id FROM r WHERE k <= {size}
    """


_CALLS = """
    k AS (SELECT call_id, logged_at, lower(model_name) AS model_name, stage, greatest(coalesce(input_tokens, 0), 0) AS input_tokens, greatest(coalesce(output_tokens, 0), 0) AS output_tokens
          FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY logged_at NULLS FIRST, stage NULLS FIRST, input_tokens NULLS FIRST) AS r FROM cost_log) WHERE r = 1)
"""

#: DuckDB takes a comma before the closing bracket for valid JSON, which it isn't.
_RESPONSES = r"""
    r AS (SELECT DISTINCT md5(raw_response) AS response_id, raw_response AS t
          FROM (SELECT raw_response FROM single_shot_questions UNION SELECT raw_response FROM multi_hop_questions UNION SELECT raw_response FROM cross_document_questions) WHERE raw_response IS NOT NULL),
    a AS (SELECT response_id, t,
            CASE WHEN regexp_matches(t, '<output_json\s*>[\s\S]*?</output_json>') THEN trim(regexp_extract(t, '<output_json\s*>([\s\S]*?)</output_json>', 1), E' \n\r\t') END AS tagged,
            CASE WHEN regexp_matches(t, '```json\s*[\s\S]*?\s*```') THEN regexp_extract(t, '```json\s*([\s\S]*?)\s*```', 1) END AS fenced FROM r),
    b AS (SELECT response_id, CASE WHEN regexp_matches(tagged, '^\s*```(?:json)?\s*[\s\S]*?\s*```\s*$') THEN regexp_extract(tagged, '^\s*```(?:json)?\s*([\s\S]*?)\s*```\s*$', 1) ELSE tagged END AS tagged, fenced FROM a),
    l AS (SELECT response_id, CASE WHEN json_valid(tagged) AND json_type(tagged) = 'ARRAY' AND NOT regexp_matches(tagged, ',\s*\]\s*$') THEN tagged WHEN json_valid(fenced) AND json_type(fenced) = 'ARRAY' AND NOT regexp_matches(fenced, ',\s*\]\s*$') THEN fenced END AS list FROM b),
    i AS (SELECT response_id, list, unnest(generate_series(0, json_array_length(list)::BIGINT - 1)) AS p FROM l WHERE list IS NOT NULL),
    o AS (SELECT response_id, p, json_extract(list, '$[' || p || ']') AS j FROM i)
"""

_PREPARED = f"""
    {_CHUNKED},
    s AS (SELECT question_id, any_value(document_id) AS document_id, any_value(additional_instructions) AS additional_instructions, any_value(question) AS question, any_value(self_answer) AS self_answer,
            any_value(estimated_difficulty) AS estimated_difficulty, any_value(self_assessed_question_type) AS kind_of, any_value(question_mode) AS question_mode, any_value(generating_model) AS generating_model,
            any_value(citations) AS citations, any_value(choices) AS choices, any_value(ids) AS ids, kind FROM (
        SELECT 'single_shot' AS kind, question_id, document_id, additional_instructions, question, self_answer, estimated_difficulty, self_assessed_question_type, question_mode, generating_model, citations, choices, [chunk_id] AS ids FROM single_shot_questions
        UNION ALL SELECT 'multi_hop', question_id, document_id, additional_instructions, question, self_answer, estimated_difficulty, self_assessed_question_type, question_mode, generating_model, citations, choices, source_chunk_ids FROM multi_hop_questions
        UNION ALL SELECT 'cross_document', question_id, document_id, additional_instructions, question, self_answer, estimated_difficulty, self_assessed_question_type, question_mode, generating_model, citations, choices, source_chunk_ids FROM cross_document_questions)
        GROUP BY kind, question_id),
    q AS (SELECT * REPLACE (list_filter(coalesce(ids, []), lambda x: x IS NOT NULL AND x <> '') AS ids) FROM s),
    x AS (SELECT document_id, u.chunk_id AS chunk_id, u.chunk_text AS chunk_text FROM (SELECT document_id, unnest(chunks) AS u FROM c)),
    g AS (SELECT chunk_id, max(chunk_text) AS chunk_text FROM x GROUP BY chunk_id),
    w AS (SELECT kind, question_id, document_id, unnest(ids) AS chunk_id, unnest(generate_series(1, len(ids))) AS n FROM q),
    f AS (SELECT w.kind, w.question_id, list(coalesce(CASE WHEN w.kind = 'cross_document' THEN g.chunk_text ELSE x.chunk_text END, '') ORDER BY n) AS texts
          FROM w LEFT JOIN x ON x.document_id = w.document_id AND x.chunk_id = w.chunk_id LEFT JOIN g ON g.chunk_id = w.chunk_id GROUP BY ALL),
    p AS (SELECT q.*, CASE WHEN q.kind = 'single_shot' THEN list_filter(coalesce(f.texts, []), lambda t: t <> '') ELSE coalesce(f.texts, []) END AS texts,
            CASE WHEN q.kind = 'cross_document' THEN '' ELSE coalesce(c.document_text, '') END AS document, CASE WHEN q.kind = 'cross_document' THEN '' ELSE coalesce(c.document_summary, '') END AS summary,
            coalesce(lower(question_mode) = 'multi-choice', false) AS multi
          FROM q LEFT JOIN f ON f.kind = q.kind AND f.question_id = q.question_id LEFT JOIN c ON c.document_id = q.document_id)
"""

_GOLD_INDEX = "CASE WHEN multi AND coalesce(self_answer, '') = '' THEN '0' WHEN multi AND regexp_full_match(self_answer, '[A-Z]') THEN (ascii(self_answer) - 65)::VARCHAR ELSE '' END"
_GOLD_TEXT = "CASE WHEN multi THEN '' ELSE coalesce(self_answer, '') END"


def _once(table: str, columns: str) -> str:
    return f"(SELECT DISTINCT question_id, {columns} FROM {table})"


_SUMMARY = f"""
    w AS (SELECT doc_id::VARCHAR AS document_id, coalesce(text, '') AS text, {_words("text")} AS w FROM documents),
    pt AS (SELECT document_id, -1 AS part, text FROM w WHERE len(w) <= 100
           UNION ALL SELECT document_id, s // 90, array_to_string(w[s + 1 : s + 100], ' ') FROM (SELECT document_id, w, unnest(generate_series(0, len(w) - 1, 90)) AS s FROM w WHERE len(w) > 100)),
    sm AS (SELECT document_id, list({_strip(f"array_to_string({_words('text')}[1:6], ' ')")} ORDER BY part) AS summaries FROM pt GROUP BY document_id),
    us AS (SELECT document_id, summaries, list_filter(summaries, lambda x: {_strip("x")} <> '') AS useful FROM sm)
"""


_EVERY = """
    e AS (SELECT question_id, any_value(question) AS question, any_value(self_answer) AS self_answer, any_value(self_assessed_question_type) AS self_assessed_question_type, any_value(question_mode) AS question_mode,
            any_value(choices) AS choices, any_value(raw_response) AS raw_response, any_value(additional_instructions) AS additional_instructions, any_value(citations) AS citations, any_value(keyed) AS keyed
          FROM (SELECT question_id, question, self_answer, self_assessed_question_type, question_mode, choices, raw_response, additional_instructions, citations, coalesce(chunk_id, '') <> '' AS keyed FROM single_shot_questions
                UNION ALL SELECT question_id, question, self_answer, self_assessed_question_type, question_mode, choices, raw_response, additional_instructions, citations, len(coalesce(source_chunk_ids, [])) > 0 FROM multi_hop_questions
                UNION ALL SELECT question_id, question, self_answer, self_assessed_question_type, question_mode, choices, raw_response, additional_instructions, citations, len(coalesce(source_chunk_ids, [])) > 0 FROM cross_document_questions) GROUP BY question_id)
"""

_CONTAINED = f"""
    {_PREPARED}, y AS (SELECT *, coalesce(self_answer, '') AS said, list_filter(coalesce(citations, []), lambda x: x IS NOT NULL) AS cited, list_filter(texts, lambda t: t <> '') AS used FROM p),
    z AS (SELECT *, CASE WHEN len(cited) = 0 OR (len(used) = 0 AND said = '') THEN 0.0::DOUBLE
            ELSE 100.0 * len(list_filter(cited, lambda x: x <> '' AND said <> '' AND (contains(x, said) OR contains(said, x)))) / len(cited)::DOUBLE END AS a,
        CASE WHEN len(cited) = 0 OR (len(used) = 0 AND said = '') THEN 0.0::DOUBLE
            ELSE 100.0 * len(list_filter(cited, lambda x: x <> '' AND len(list_filter(used, lambda t: contains(x, t) OR contains(t, x))) > 0)) / len(cited)::DOUBLE END AS b FROM y)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    single = "single_shot_questions"
    return {
        "crossdoc_checked": """
            WITH n AS (SELECT count(DISTINCT document_id)::HUGEINT AS n FROM chunked WHERE len(list_filter(multihop_chunks, lambda g: g IS NOT NULL AND len(g.chunks_text) > 0)) > 0),
            k AS (SELECT unnest([2, 3, 4, 5])::BIGINT AS size, unnest([n*(n-1)//2, n*(n-1)*(n-2)//6, n*(n-1)*(n-2)*(n-3)//24, n*(n-1)*(n-2)*(n-3)*(n-4)//120]) AS possible FROM n),
            t AS (SELECT size, possible, greatest(1, 100 * possible // (SELECT sum(possible)::HUGEINT FROM k)) AS target FROM k)
            SELECT size, least(target, possible, 100 - coalesce(sum(target) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS number, true AS fit FROM t""",
        "sample_groups": f"""
            WITH {_CHUNKED},
            e AS (SELECT document_id, multihop_chunks, len(multihop_chunks) AS n, unnest(generate_series(0, len(multihop_chunks) - 1)) AS i FROM c WHERE len(multihop_chunks) > 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY md5(document_id || ':42:' || i)) AS k FROM e)
            SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS n, array_to_string(multihop_chunks[i + 1].chunk_ids, ',') AS chunk_ids FROM r WHERE k <= 2 OR n < 2""",
        "document_chunks": f"SELECT doc_id::VARCHAR AS document_id, CASE WHEN coalesce({_strip('text')}, '') = '' THEN 0 ELSE (len({_words('text')}) + 63) // 64 END::BIGINT AS chunks FROM documents",
        "bytepair_fallback": "SELECT doc_id::VARCHAR AS document_id, true AS same, true AS bounded FROM documents",
        "summary_calls": f"WITH {_SUMMARY} SELECT document_id, part::BIGINT AS part, md5(E'Sum up:\\n' || text) AS prompt_hash FROM pt",
        "pages_joined": f"""
            WITH {_CHUNKED}, e AS (SELECT document_id, unnest(chunks) AS u, unnest(generate_series(0, len(chunks) - 1)) AS n FROM c WHERE len(chunks) > 0)
            SELECT document_id, md5(string_agg(u.chunk_text, E'\\n\\n---\\n\\n' ORDER BY n)) AS text_hash FROM e WHERE {_strip("u.chunk_text")} <> '' GROUP BY document_id""",
        "calls_answered": """
            SELECT item_id, m AS model_name, o AS model_order, CASE WHEN length(question) % 3 = 0 THEN '' ELSE m || ': ' || question END AS response, length(question) % 3 <> 0 AS success, 1::BIGINT AS attempts,
                CASE WHEN length(question) % 3 = 0 THEN 'timeout' END AS error FROM eval_items, (VALUES (0::BIGINT, 'quill'), (1::BIGINT, 'plume')) v(o, m)""",
        "answered_by_model": """
            SELECT lower(generating_model) AS model_name, count(*) AS calls, count(*) FILTER (coalesce(raw_response, '') <> '') AS answered
            FROM (SELECT generating_model, raw_response FROM single_shot_questions UNION ALL SELECT generating_model, raw_response FROM multi_hop_questions UNION ALL SELECT generating_model, raw_response FROM cross_document_questions) GROUP BY ALL""",
        "model_success": """
            SELECT lower(generating_model) AS model_name, count(*) AS calls, count(*) FILTER (coalesce(raw_response, '') <> '') AS answered, round(avg((raw_response IS NOT NULL)::INTEGER), 6) AS success_rate, 1.0::DOUBLE AS avg_seconds, 1.0::DOUBLE AS avg_attempts
            FROM (SELECT generating_model, raw_response FROM single_shot_questions UNION ALL SELECT generating_model, raw_response FROM multi_hop_questions UNION ALL SELECT generating_model, raw_response FROM cross_document_questions) GROUP BY ALL""",
        "files_read": "SELECT '.txt' AS extension, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS text_bytes FROM documents WHERE doc_id % 4 < 2",
        "files_ingested": f"SELECT md5({_strip('t')}) AS text_hash, strlen({_strip('t')}) AS file_size, true AS named FROM (SELECT string_agg(passage, E'\\n') AS t FROM (SELECT passage FROM eval_items))",
        "subset_saved": "SELECT call_id, lower(model_name) AS model_name, input_tokens, input_tokens IS NOT NULL AS known FROM cost_log",
        "subset_index": """
            SELECT question_id, question, 'single_shot_questions' AS subset FROM single_shot_questions UNION ALL SELECT question_id, question, 'multi_hop_questions' FROM multi_hop_questions
            UNION ALL SELECT question_id, question, 'cross_document_questions' FROM cross_document_questions""",
        "call_log_totals": f"WITH {_CALLS} SELECT model_name, sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens, count(*) AS total_calls FROM k GROUP BY model_name",
        "custom_fields_kept": f"SELECT item_id::VARCHAR AS document_id, {_strip('question')} AS question, {_words('question')}[1] AS hint, len({_words('question')})::BIGINT AS steps, 2::BIGINT AS fields FROM eval_items WHERE {_strip('question')} <> ''",
        "citation_containment": f"""
            WITH {_CONTAINED} SELECT kind, document_id, coalesce(question, '') AS question, said AS ground_truth_answer, round(a, 6) AS answer_citation_score, round(b, 6) AS chunk_citation_score, round(0.7 * b + 0.3 * a, 6) AS citation_score FROM z""",
        "citation_scores_checked": f"""
            WITH {_CONTAINED} SELECT kind, document_id, coalesce(question, '') AS question, a = 100 AS answer_citation_score, b = 100 AS chunk_citation_score, true AS sound FROM z""",
        "question_dedup": f"WITH {_EVERY} SELECT question_id, question FROM (SELECT question_id, question, row_number() OVER (PARTITION BY {_key('question')} ORDER BY question_id) AS r FROM e) WHERE r = 1 OR question IS NULL",
        "question_validity": f"""
            WITH {_EVERY} SELECT question_id, CASE lower(coalesce(question_mode, '')) WHEN 'multi-choice' THEN len(coalesce(choices, [])) = 4
                WHEN 'open-ended' THEN NOT (lower({_strip("coalesce(self_assessed_question_type, '')")}) IN ('analytical','application-based','clarification','counterfactual','conceptual','true-false','factual','open-ended','false-premise','edge-case')
                    AND upper({_strip("coalesce(self_answer, '')")}) IN ('A','B','C','D')) ELSE true END AND keyed AS valid FROM e""",
        "gold_answers": f"WITH {_EVERY} SELECT question_id, {_GOLD_INDEX} AS gold_index, {_GOLD_TEXT} AS gold_text FROM (SELECT question_id, self_answer, coalesce(lower(question_mode) = 'multi-choice', false) AS multi FROM e)",
        "message_tokens": f"WITH {_EVERY} SELECT question_id, (3 + 3 + 1 + len({_words('question')}) + 3 + 1 + len({_words('self_answer')}))::BIGINT AS tokens FROM e",
        "analysis_text": f"WITH {_EVERY} SELECT question_id, md5({_tag('raw_response', 'document_analysis')}) AS analysis FROM e",
        "ingest_documents": f"""
            SELECT doc_id::VARCHAR AS document_id, document_filename, md5({_strip("text")}) AS text_hash, strlen({_strip("text")}) AS file_size FROM documents WHERE {_strip("text")} <> ''""",
        "document_ids": r"""
            SELECT doc_id, CASE WHEN coalesce(regexp_replace(document_filename, '[^\p{L}\p{N}_-]', '', 'g'), '') = '' THEN 'doc_' || doc_id
                ELSE regexp_replace(document_filename, '[^\p{L}\p{N}_-]', '', 'g') END AS safe_id FROM documents""",
        "token_counts": f"SELECT doc_id, len({_words('text')})::BIGINT AS tokens FROM documents",
        "chunk_words": _windows(64, 0),
        "chunk_words_overlap": _windows(64, 16),
        "chunk_stats": f"""
            WITH {_CHUNKED} SELECT document_id, count(n) AS chunks, sum(n)::BIGINT AS total_length, avg(n) AS avg_length, min(n) AS min_length, max(n) AS max_length
            FROM (SELECT document_id, length(u.chunk_text) AS n FROM (SELECT document_id, unnest(chunks) AS u FROM c)) GROUP BY document_id""",
        "chunk_totals": f"WITH {_CHUNKED} SELECT sum(len(chunks))::BIGINT AS chunks, sum(len(multihop_chunks))::BIGINT AS groups FROM c",
        "chunk_combinations": f"""
            WITH {_CHUNKED},
            n AS (SELECT document_id, len(chunks) AS n FROM c),
            s AS (SELECT document_id, n, greatest(1, n) AS wanted, least(5, n) AS last, unnest(generate_series(2, least(5, n))) AS size FROM n WHERE n >= 2),
            e AS (SELECT *, greatest(1, wanted // (last - 1)) AS each FROM s),
            d AS (SELECT *, unnest(generate_series(0, CASE WHEN each < n THEN each ELSE least(5, n // size) END - 1)) AS draw FROM e),
            a AS (SELECT *, unnest(generate_series(0, 2 * size + 5)) AS attempt FROM d),
            i AS (SELECT document_id, n, wanted, size, draw, attempt, ('0x' || md5(document_id || ':' || size || ':' || draw || ':' || attempt)[1:8])::BIGINT % n AS i FROM a
                  UNION ALL SELECT document_id, n, wanted, size, draw, 1000 + f, f FROM (SELECT *, unnest(generate_series(0, least(2 * size, n) - 1)) AS f FROM d)),
            m AS (SELECT document_id, wanted, size, draw, i, min(attempt) AS attempt FROM i GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY document_id, size, draw ORDER BY attempt) AS k FROM m),
            g AS (SELECT document_id, wanted, size, draw, string_agg(i::VARCHAR, ',' ORDER BY i) AS positions FROM r WHERE k <= size GROUP BY ALL),
            u AS (SELECT document_id, wanted, positions, min(size * 1000000 + draw) AS first FROM g GROUP BY ALL),
            o AS (SELECT document_id, wanted, positions, row_number() OVER (PARTITION BY document_id ORDER BY first) - 1 AS n FROM u)
            SELECT document_id, n, positions FROM o WHERE n < wanted UNION ALL SELECT document_id, 0, '0' FROM n WHERE n = 1""",
        "sample_count": _sample("least(n, 3)"),
        "sample_percentage": _sample("floor(n * 0.5)"),
        "colex_pairs": """
            SELECT item_id, i AS first, j AS second FROM eval_items JOIN (SELECT i, j FROM range(0, 60) a(i), range(0, 60) b(j) WHERE i < j) ON item_id = j * (j - 1) // 2 + i""",
        "colex_triples": """
            SELECT item_id, i AS p0, j AS p1, k AS p2 FROM eval_items
            JOIN (SELECT i, j, k, row_number() OVER (ORDER BY k, j, i) - 1 AS rank FROM range(0, 60) a(i), range(0, 60) b(j), range(0, 60) c(k) WHERE i < j AND j < k) ON item_id = rank""",
        "crossdoc_quotas": """
            WITH n AS (SELECT count(DISTINCT document_id)::HUGEINT AS n FROM chunked WHERE len(list_filter(multihop_chunks, lambda g: g IS NOT NULL AND len(g.chunks_text) > 0)) > 0),
            k AS (SELECT unnest([2, 3, 4, 5])::BIGINT AS size, unnest([n*(n-1)//2, n*(n-1)*(n-2)//6, n*(n-1)*(n-2)*(n-3)//24, n*(n-1)*(n-2)*(n-3)*(n-4)//120]) AS possible FROM n),
            t AS (SELECT size, possible, greatest(1, 100 * possible // (SELECT sum(possible)::HUGEINT FROM k)) AS target FROM k)
            SELECT size, least(target, possible, 100 - coalesce(sum(target) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS number FROM t""",
        "crossdoc_positions": """
            SELECT row_number() OVER (ORDER BY document_id) - 1 AS position, document_id
            FROM (SELECT DISTINCT document_id FROM chunked WHERE len(list_filter(multihop_chunks, lambda g: g IS NOT NULL AND len(g.chunks_text) > 0)) > 0)""",
        "prompt_single_shot": f"""
            WITH {_CHUNKED}, e AS (SELECT document_id, document_filename, document_summary, unnest(chunks) AS u, unnest(generate_series(0, len(chunks) - 1)) AS n FROM c WHERE len(chunks) > 0)
            SELECT document_id, u.chunk_id AS chunk_id,
                md5('Title: ' || coalesce(document_filename, 'doc_' || document_id) || E'\\nSummary: ' || coalesce(document_summary, '') || E'\\nText: ' || u.chunk_text || E'\\nBe brief.') AS prompt_hash,
                'single_shot_qa doc_' || document_id || ' chunk_' || n || ' chunk_len_' || length(u.chunk_text) AS tags
            FROM e WHERE {_strip("u.chunk_text")} <> ''""",
        "prompt_multi_hop": f"""
            WITH {_CHUNKED}, e AS (SELECT document_id, document_filename, document_summary, unnest(multihop_chunks) AS g, unnest(generate_series(0, len(multihop_chunks) - 1)) AS n FROM c WHERE len(multihop_chunks) > 0),
            t AS (SELECT *, array_to_string(list_transform(g.chunks_text, lambda x, i: '<text_chunk_' || (i - 1) || '>' || x || '</text_chunk_' || (i - 1) || E'>\\n'), '') AS text FROM e WHERE len(g.chunks_text) > 0)
            SELECT document_id, array_to_string(g.chunk_ids, ',') AS chunk_ids,
                md5('Title: ' || coalesce(document_filename, 'doc_' || document_id) || E'\\nSummary: ' || coalesce(document_summary, '') || E'\\n' || text || 'Be brief.') AS prompt_hash,
                'multi_hop_qa doc_' || document_id || ' group_' || n || ' chunks_' || len(g.chunks_text) || ' total_len_' || length(text) || ' ' ||
                CASE WHEN len(g.chunks_text) <= 2 THEN 'few_chunks' WHEN len(g.chunks_text) <= 5 THEN 'medium_chunks' ELSE 'many_chunks' END AS tags FROM t""",
        "prompt_rewrite": f"""
            WITH {_CHUNKED}, x AS (SELECT document_id, u.chunk_id AS chunk_id, any_value(u.chunk_text) AS chunk_text FROM (SELECT document_id, unnest(chunks) AS u FROM c) GROUP BY ALL)
            SELECT question_id, md5('Question: ' || question || E'\\nAnswer: ' || coalesce(self_answer, '') || E'\\nText: ' || coalesce(x.chunk_text, '') || E'\\nSummary: ' || coalesce(c.document_summary, '') || E'\\n') AS prompt_hash
            FROM {_once(single, "document_id, question, self_answer, chunk_id")} q LEFT JOIN c USING (document_id) LEFT JOIN x ON x.document_id = q.document_id AND x.chunk_id = q.chunk_id WHERE {_strip("question")} <> ''""",
        "builder_totals": f"""
            WITH {_CHUNKED}, e AS (SELECT document_filename, document_id, document_summary, unnest(chunks) AS u FROM c),
            p AS (SELECT *, {_strip("u.chunk_text")} <> '' AS used, length('Title: ' || coalesce(document_filename, 'doc_' || document_id) || E'\\nSummary: ' || coalesce(document_summary, '') || E'\\nText: ' || u.chunk_text || E'\\n') AS n FROM e)
            SELECT (SELECT count(*) FROM c) AS documents, count(*) AS chunks, count(*) FILTER (NOT used) AS skipped, count(*) FILTER (used) AS calls, sum(n) FILTER (used) / count(*)::DOUBLE AS avg_prompt_length FROM p""",
        "call_summary": f"""
            WITH {_CHUNKED}, e AS (SELECT document_filename, document_id, document_summary, unnest(chunks) AS u FROM c),
            p AS (SELECT length('Title: ' || coalesce(document_filename, 'doc_' || document_id) || E'\\nSummary: ' || coalesce(document_summary, '') || E'\\nText: ' || u.chunk_text || E'\\n') + 4 AS n FROM e WHERE {_strip("u.chunk_text")} <> '')
            SELECT count(*) AS total_calls, coalesce(avg(n), 0)::DOUBLE AS avg_message_length, coalesce(min(n), 0) AS min_message_length, coalesce(max(n), 0) AS max_message_length, count(*) / 8.0::DOUBLE AS calls_per_second FROM p""",
        "chunks_skipped": f"WITH {_CHUNKED}, e AS (SELECT document_id, unnest(chunks) AS u FROM c) SELECT document_id, u.chunk_id AS chunk_id FROM e WHERE coalesce({_strip('u.chunk_text')}, '') = ''",
        "chunk_preprocessed": f"""
            WITH w AS (SELECT doc_id, {_words("lower(text)")} AS w FROM documents WHERE {_strip("text")} <> ''), s AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 64)) AS s FROM w)
            SELECT doc_id::VARCHAR AS document_id, doc_id || '_' || (s // 64) AS chunk_id, md5(array_to_string(w[s + 1 : s + 64], ' ')) AS text_hash FROM s""",
        "tag_histogram": f"""
            WITH {_CHUNKED}, e AS (SELECT document_id, unnest(multihop_chunks) AS g, unnest(generate_series(0, len(multihop_chunks) - 1)) AS n FROM c WHERE len(multihop_chunks) > 0),
            t AS (SELECT document_id, n, len(g.chunks_text) AS k, length(array_to_string(list_transform(g.chunks_text, lambda x, i: '<text_chunk_' || (i - 1) || '>' || x || '</text_chunk_' || (i - 1) || E'>\\n'), '')) AS l FROM e WHERE len(g.chunks_text) > 0),
            u AS (SELECT unnest(['multi_hop_qa', 'doc_' || document_id, 'group_' || n, 'chunks_' || k, 'total_len_' || l, CASE WHEN k <= 2 THEN 'few_chunks' WHEN k <= 5 THEN 'medium_chunks' ELSE 'many_chunks' END]) AS tag FROM t)
            SELECT tag, count(*) AS calls FROM u GROUP BY tag""",
        "model_cost": f"WITH {_CALLS} SELECT model_name, sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens, count(*) AS total_calls FROM k GROUP BY model_name",
        "cost_summary": f"""
            WITH {_CALLS} SELECT count(*) AS calls, sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens,
                sum(input_tokens) / greatest(count(*), 1)::DOUBLE AS avg_input_tokens, sum(output_tokens) / greatest(count(*), 1)::DOUBLE AS avg_output_tokens FROM k""",
        "call_matrix": "SELECT item_id, o AS model_order, m AS model_name FROM eval_items, (VALUES (0::BIGINT, 'quill'), (1::BIGINT, 'plume')) v(o, m)",
        "error_categories": """
            SELECT CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limit' ELSE CASE WHEN event_id % 7 = 0 THEN 'rate_limit' WHEN event_id % 5 = 2 THEN 'auth_error' WHEN event_id % 5 = 3 THEN 'connection_error' ELSE 'other_error' END END AS category,
                count(*) AS events FROM events GROUP BY ALL""",
        "parse_responses": rf"""
            WITH {_RESPONSES},
            v AS (SELECT response_id, p, j, json_keys(j) AS k, CASE WHEN list_contains(json_keys(j), 'estimated_difficulty') THEN 'estimated_difficulty' WHEN list_contains(json_keys(j), 'difficulty') THEN 'difficulty' WHEN list_contains(json_keys(j), 'complexity') THEN 'complexity' END AS dk
                  FROM o WHERE json_type(j) = 'OBJECT'),
            d AS (SELECT *, json_extract_string(j, '$.' || dk) AS dv, json_type(json_extract(j, '$.' || dk)) AS dt FROM v)
            SELECT response_id, p AS pair_position, {_strip("json_extract_string(j, '$.question')")} AS question, {_strip("coalesce(json_extract_string(j, '$.answer'), json_extract_string(j, '$.self_answer'))")} AS self_answer,
                CASE WHEN dk IS NULL THEN NULL WHEN dt = 'VARCHAR' THEN CASE lower(dv) WHEN 'beginner' THEN 2 WHEN 'easy' THEN 2 WHEN 'intermediate' THEN 5 WHEN 'medium' THEN 5 WHEN 'advanced' THEN 7 WHEN 'hard' THEN 7 WHEN 'expert' THEN 9 WHEN 'very hard' THEN 9 ELSE 5 END
                    ELSE least(10, greatest(1, coalesce(trunc(try_cast(dv AS DOUBLE)), 5))) END::BIGINT AS estimated_difficulty,
                {_strip("coalesce(json_extract_string(j, '$.question_type'), json_extract_string(j, '$.self_assessed_question_type'))")} AS self_assessed_question_type,
                coalesce(CASE WHEN list_contains(k, 'thought_process') THEN json_extract_string(j, '$.thought_process') WHEN list_contains(k, 'reasoning') THEN json_extract_string(j, '$.reasoning')
                    WHEN list_contains(k, 'explanation') THEN json_extract_string(j, '$.explanation') WHEN list_contains(k, 'rationale') THEN json_extract_string(j, '$.rationale') WHEN list_contains(k, 'thinking') THEN json_extract_string(j, '$.thinking') END, '') AS thought_process,
                CASE WHEN json_type(j, '$.citations') = 'ARRAY' THEN json_array_length(j, '$.citations') ELSE 0 END::BIGINT AS citations, CASE WHEN json_type(j, '$.choices') = 'ARRAY' THEN json_array_length(j, '$.choices') ELSE 0 END::BIGINT AS choices,
                array_to_string(list_sort(list_filter(k, lambda x: x NOT IN ('question','answer','self_answer','thought_process','reasoning','explanation','rationale','thinking','question_type','self_assessed_question_type','estimated_difficulty','difficulty','complexity',
                    'citations','choices','question_mode','document_id','chunk_id','source_chunk_ids','additional_instructions','generating_model','raw_response','original_question','question_rewriting_model','question_rewriting_rationale','raw_question_rewriting_response'))), ',') AS custom_fields
            FROM d""",
        "choices_permuted": f"""
            WITH {_EVERY}, q AS (SELECT question_id, question, self_answer, list_transform(choices, lambda c: {_strip("substr(c, 4)")}) AS t FROM e
                       WHERE question IS NOT NULL AND len(choices) = 4 AND regexp_full_match(self_answer, '[A-D]')),
            o AS (SELECT question_id, question, t[ascii(self_answer) - 64] AS named, unnest(t) AS x, unnest(generate_series(1, 4)) AS i FROM q),
            r AS (SELECT question_id, named, x, row_number() OVER (PARTITION BY question_id ORDER BY sha256(question || '|' || x), x, i) AS k FROM o)
            SELECT question_id, chr((64 + min(k) FILTER (x = named))::INTEGER) AS self_answer, string_agg('(' || chr((64 + k)::INTEGER) || ') ' || x, '|' ORDER BY k) AS choices FROM r GROUP BY question_id""",
        "document_dedup": f"SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY {_key('text')} ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR text IS NULL",
        "last_calls": f"WITH {_CALLS} SELECT concat_ws('/', stage, model_name) AS slot, arg_max(input_tokens, call_id) AS input_tokens FROM k GROUP BY ALL",
        "without_empties": f"""
            WITH {_EVERY} SELECT question_id, nullif(additional_instructions, '') AS additional_instructions, CASE WHEN len(citations) > 0 THEN array_to_string(citations, '|') END AS citations FROM e""",
        "evaluation_table": f"""
            WITH {_PREPARED} SELECT kind, document_id, coalesce(question, '') AS question, coalesce(self_answer, '') AS ground_truth_answer, coalesce(kind_of, 'unknown') AS question_category, coalesce(generating_model, '') AS question_generating_model,
                coalesce(additional_instructions, '') AS additional_instructions, coalesce(estimated_difficulty, 5)::BIGINT AS estimated_difficulty, {_GOLD_INDEX} AS gold_index, {_GOLD_TEXT} AS gold_text,
                array_to_string(coalesce(choices, []), '|') AS choices, array_to_string(coalesce(citations, []), '|') AS citations, array_to_string(ids, '|') AS chunk_ids, md5(array_to_string(texts, '|')) AS chunks_hash, len(texts)::BIGINT AS chunks,
                length(document)::BIGINT AS document_length, md5(summary) AS summary_hash FROM p""",
        "evaluation_slim": f"""
            WITH {_PREPARED} SELECT kind, coalesce(kind_of, 'unknown') AS question_category, coalesce(generating_model, '') AS question_generating_model, count(*) AS questions, sum(len(coalesce(citations, [])))::BIGINT AS citations,
                sum(coalesce(estimated_difficulty, 5))::BIGINT AS difficulty FROM p GROUP BY ALL""",
        "rewrite_apply": f"""
            WITH {_EVERY} SELECT question_id, {_strip("'In short: ' || question")} AS question, question AS original_question, question_mode, 'shorter' AS question_rewriting_rationale FROM e WHERE question IS NOT NULL AND question_id % 3 <> 0""",
        "summary_parts": f"WITH {_SUMMARY} SELECT document_id, part::BIGINT AS part, md5(text) AS text_hash FROM pt",
        "summary_combine": f"""
            WITH {_SUMMARY} SELECT document_id, md5(E'Combine:\\n' || array_to_string(list_transform(useful, lambda x: '- ' || x), E'\\n') || E'\\nEnd') AS prompt_hash FROM us WHERE len(useful) > 1""",
        "summary_merged": f"""
            WITH {_SUMMARY} SELECT document_id, CASE WHEN len(useful) > 1 THEN CASE WHEN document_id::BIGINT % 2 = 0 THEN 'All of ' || document_id ELSE 'No summary available.' END ELSE coalesce({_strip("useful[1]")}, '') END AS document_summary FROM us""",
        "subset_append": """
            SELECT 'single_shot_questions' AS subset, count(*) AS rows FROM single_shot_questions UNION ALL SELECT 'multi_hop_questions', count(*) FROM multi_hop_questions
            UNION ALL SELECT 'cross_document_questions', count(*) FROM cross_document_questions""",
        "markup_text": rf"""
            WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(text,
                '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM documents),
            e AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
            SELECT doc_id, {_strip(f"regexp_replace(t, '{_BLANK}+', ' ', 'g')")} AS text FROM e""",
        "questions_from_documents": f"""
            WITH k AS ({_windows(64, 0)}), w AS (SELECT *, {_words("chunk_text")} AS w FROM k),
            q AS (SELECT document_id, chunk_id, {_strip("'What follows after ' || array_to_string(w[1:8], ' ') || '?'")} AS question, {_strip("array_to_string(w[1:12], ' ')")} AS self_answer FROM w),
            v AS (SELECT * FROM q WHERE upper(self_answer) NOT IN ('A', 'B', 'C', 'D')),
            r AS (SELECT *, row_number() OVER (PARTITION BY {_key("question")} ORDER BY document_id, chunk_id) AS r FROM v)
            SELECT document_id, chunk_id, question, self_answer, 5::BIGINT AS estimated_difficulty, CASE WHEN self_answer = '' THEN 0.0 ELSE 100.0 END::DOUBLE AS citation_score FROM r WHERE r = 1""",
    }
