import itertools
import random
from math import comb

import pytest
from pyspark.sql import functions as F

from docmill import schemas
from docmill.operators import assemble, chunking, crossdoc, dedup, inference, metrics, parsing, prompts, rewriting, sampling, scoring, summarize

EXTRA = "x string, h string, n int"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_windows_with_and_without_overlap(spark):
    df = frame(spark, [("a b c d e",), ("",), (None,), ("  ",)], "t string")
    got = [r[0] for r in df.select(chunking.token_windows("t", 2)).collect()]
    assert got == [["a b", "c d", "e"], [], [], []]
    assert df.select(chunking.token_windows("t", 3, 1)).first()[0] == ["a b c", "c d e", "e"]
    for size, overlap in ((2, 2), (0, 0), (2, -1)):
        with pytest.raises(ValueError):
            chunking.token_windows("t", size, overlap)


def test_chunk_ids_and_blank_documents(spark):
    df = frame(spark, [("d", "a b c"), ("e", " ")], "i string, t string")
    got = [r[0] for r in df.select(chunking.chunks("i", "t", 2)).collect()]
    assert [tuple(c) for c in got[0]] == [("d_0", "a b"), ("d_1", "c")] and got[1] == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 10, 30])
def test_combinations(spark, n):
    groups = frame(spark, [("d", n)], "i string, n int").select(chunking.combinations("i", F.col("n"))).first()[0]
    if n < 2:
        assert groups == ([[0]] if n == 1 else [])
        return
    sizes = range(2, min(5, n) + 1)
    each = max(1, n // len(sizes))
    assert 1 <= len(groups) <= min(n, sum(each if each < n else min(5, n // k) for k in sizes))
    assert len({tuple(g) for g in groups}) == len(groups)
    assert all(g == sorted(set(g)) and 2 <= len(g) <= 5 and max(g) < n for g in groups)


def test_sampling(spark):
    df = frame(spark, [("d", list("abcdef")), ("e", []), ("f", None)], "i string, a array<string>")
    take = lambda s: [r[0] for r in df.select(sampling.sample_array(F.col("i"), F.col("a"), s)).collect()]
    some = take(sampling.Sampling("count", 3))
    assert len(some[0]) == 3 and some[0] == sorted(some[0]) and some[1] == [] and some[2] is None
    assert len(take(sampling.Sampling("percentage", 0.34))[0]) == 2
    assert take(sampling.Sampling())[0] == list("abcdef")
    with pytest.raises(ValueError):
        sampling.Sampling("odd")


def test_unranking_is_colexicographic():
    for n in range(15):
        for k in range(n + 1):
            colex = sorted(itertools.combinations(range(n), k), key=lambda c: c[::-1])
            assert [tuple(c) for c in crossdoc.combinations_at(range(comb(n, k)), n, k)] == colex
    for n, k in ((10**6, 5), (3000, 9), (200, 200)):
        ranks = [0, comb(n, k) - 1, comb(n, k) // 3, comb(n, k) // 2]
        for rank, found in zip(ranks, crossdoc.combinations_at(ranks, n, k).tolist()):
            assert found == sorted(set(found)) and found[-1] < n and sum(comb(p, i + 1) for i, p in enumerate(found)) == rank
    for n, k, rank in ((4, 5, 0), (5, 2, -1), (5, 2, 10)):
        with pytest.raises(ValueError):
            crossdoc.combinations_at([rank], n, k)


def test_cross_document_passages_follow_the_ids_of_their_row(spark):
    chunked = frame(spark, [([("d_0", "zero"), ("d_1", "one")],)], "chunks array<struct<chunk_id: string, chunk_text: string>>")
    rows = [("x", "q", ids) for ids in (["d_0"], ["d_1"], ["d_1", "gone", "", None, "d_0"], [], None, ["d_0"])]
    schema = "document_id string, question string, source_chunk_ids array<string>, additional_instructions string, self_answer string, question_mode string, choices array<string>, self_assessed_question_type string, estimated_difficulty int, citations array<string>, generating_model string"
    got = assemble.across_documents(frame(spark, [(*r, *[None] * 8) for r in rows], schema), chunked).select("chunk_ids", "chunks").collect()
    expected = [(["d_0"], ["zero"])] * 2 + [(["d_1"], ["one"]), (["d_1", "gone", "d_0"], ["one", "", "zero"]), ([], []), ([], [])]
    assert sorted((r.chunk_ids, r.chunks) for r in got) == sorted(expected)


def test_ranks_and_quotas():
    assert crossdoc.sample_ranks(10, 10, 1) == list(range(10))
    assert len(set(crossdoc.sample_ranks(1 << 80, 50, 1))) == 50
    assert crossdoc.quotas(10, 2, 5, 100) == [(2, 7), (3, 19), (4, 33), (5, 40)]
    assert crossdoc.quotas(2, 2, 5, 100) == [(2, 1)] and crossdoc.quotas(1) == []


def test_cross_documents(spark):
    group = lambda i: [{"chunk_ids": [f"d{i}_0"], "chunks_text": [f"t{i}"]}]
    rows = [(f"d{i}", None if i == 3 else f"s{i}", group(i) if i != 5 else []) for i in range(6)] + [("d0", "s0", group(0))]
    chunked = frame(spark, rows, "document_id string, document_summary string, multihop_chunks " + schemas.GROUPS.simpleString())
    got = crossdoc.cross_documents(chunked, 2, 3, 8).collect()
    assert len(got) == len({r.document_id for r in got}) == sum(n for _, n in crossdoc.quotas(5, 2, 3, 8))
    for r in got:
        made = r.cross_document_metadata
        assert made.num_source_docs == len(made.source_documents) == len(r.multihop_chunks[0].chunk_ids)
        assert "d5" not in made.source_documents and made.source_indices == sorted(made.source_indices)
        assert (r.document_summary == "") == (made.source_documents == ["d3"])
    assert crossdoc.cross_documents(chunked.where("false")).count() == 0


def test_prompts(spark):
    rows = [("d", None, "sum {x}", [("d_0", "one"), ("d_1", " ")], [(["d_0", "d_1"], ["one", "two"]), ([], [])])]
    schema = f"document_id string, document_filename string, document_summary string, chunks {schemas.CHUNKS.simpleString()}, multihop_chunks {schemas.GROUPS.simpleString()}"
    chunked = frame(spark, rows, schema)
    single = prompts.single_shot_calls(chunked, "{title}|{document_summary}|{text_chunk}|{additional_instructions}", "sys", "go").collect()
    assert [r.prompt for r in single] == ["doc_d|sum {x}|one|go"]
    assert [m.role for m in single[0].messages] == ["system", "user"] and single[0].tags[-1] == "chunk_len_3"
    multi = prompts.multi_hop_calls(chunked, "{chunks}{title}{document_summary}{additional_instructions}").collect()
    assert multi[0].prompt.startswith("<text_chunk_0>one</text_chunk_0>\n<text_chunk_1>two</text_chunk_1>\n") and multi[0].tags[-1] == "few_chunks" and len(multi) == 1
    calls = prompts.single_shot_calls(chunked, "{text_chunk}")
    assert tuple(prompts.builder_totals(chunked, calls).first()) == (1, 2, 1, 1, 1.5)
    assert {r.tag: r.calls for r in prompts.tag_histogram(calls).collect()}["single_shot_qa"] == 1


def responses(spark, *lists):
    rows = [(f"d{i}", f"d{i}_0", "m", f"<output_json>{x}</output_json>") for i, x in enumerate(lists)]
    return frame(spark, rows, "document_id string, chunk_id string, generating_model string, response string")


def test_open_ended_questions(spark):
    asked = responses(
        spark,
        '[{"question": " Q1 ", "answer": "yes", "question_type": "factual", "choices": []}, 5, {"question": "Q4", "answer": "none of these", "choices": ["(A) a"]}, {"question": "Q2", "answer": "b", "question_type": "factual"}]',
        '[{"question": "Q3", "answer": "B", "question_type": "made-up"}]',
        "no json",
    )
    got = parsing.questions(asked, "chunk_id", "open-ended")
    assert sorted(r.question for r in got.collect()) == ["Q1", "Q3"] and all(r.choices == [] for r in got.collect())
    assert sorted(r.question for r in parsing.rejected(asked, "chunk_id", "open-ended").collect()) == ["Q2", "Q4"]


def test_multi_choice_questions_keep_the_right_answer(spark):
    four = '["(A) red", "(B) blue", "(C) grey", "(D) blue"]'
    asked = responses(spark, f'[{{"question": "Q", "answer": "c", "question_type": "factual", "choices": {four}}}]', '[{"question": "R", "answer": "A", "choices": ["(A) x"]}]', f'[{{"question": "S", "answer": "AB", "choices": {four}}}]')
    got = parsing.questions(asked, "chunk_id", "multi-choice").collect()
    assert [r.question for r in got] == ["Q"]
    assert sorted(c[4:] for c in got[0].choices) == ["blue", "blue", "grey", "red"] and got[0].choices[ord(got[0].self_answer) - 65].endswith("grey")


def test_records_need_exactly_one_key(spark):
    df = frame(spark, [("c", None), (None, ["a"]), ("c", ["a"]), (None, None), ("", [])], "c string, s array<string>")
    assert [r[0] for r in df.select(parsing.record_valid(F.col("c"), F.col("s"))).collect()] == [True, True, False, False, False]


def test_first_question_of_each_key_stays(spark):
    rows = [(3, "What is X?"), (1, "what is x 22"), (2, None), (4, None), (5, ""), (6, "!!")]
    got = dedup.distinct_questions(frame(spark, rows, "question_id long, question string"), ["question_id"])
    assert sorted(r.question_id for r in got.collect()) == [1, 2, 4, 5]
    last = dedup.keep_last(frame(spark, [("a", 1, "x"), ("a", 2, "y")], "k string, o int, v string"), "k", "o")
    assert [tuple(r) for r in last.select("k", "v").collect()] == [("a", "y")]


def chunked_rows(spark):
    rows = [("d", "whole text", [("d_0", "zero"), ("d_1", "one")], "sum")]
    return frame(spark, rows, f"document_id string, document_text string, chunks {schemas.CHUNKS.simpleString()}, document_summary string")


def question_frame(spark, key, rows):
    kind = "string" if key == "chunk_id" else "array<string>"
    names = "document_id string, question string, self_answer string, question_mode string, choices array<string>, citations array<string>, estimated_difficulty int"
    full = [(*r[:-1], None, r[-1]) for r in rows]
    return frame(spark, full, f"{names}, self_assessed_question_type string, {key} {kind}").withColumns({c: F.lit(None).cast("string") for c in ("additional_instructions", "generating_model", "raw_response")})


def test_evaluation_table(spark):
    chunked = chunked_rows(spark)
    known = assemble.with_summaries(assemble.documents_once(chunked.unionByName(chunked)), chunked)
    single = question_frame(spark, "chunk_id", [("d", "q", "B", "Multi-Choice", list("abcd"), ["zero"], 3, "d_1"), ("lost", "q2", None, "open-ended", None, None, None, "d_0")])
    multi = question_frame(spark, "source_chunk_ids", [("d", "q3", "AB", "multi-choice", list("abcd"), [], 3, ["d_1", "", "gone", "d_0"])])
    rows = {r.question: r for r in assemble.evaluation_table(known, single, multi, None).collect()}
    assert (rows["q"].gold_index, rows["q"].gold_text, rows["q"].chunks, rows["q"].document) == ([1], [], ["one"], "whole text")
    assert (rows["q2"].gold_text, rows["q2"].chunks, rows["q2"].document, rows["q2"].estimated_difficulty, rows["q2"].question_category) == ([""], [], "", 5, "unknown")
    assert (rows["q3"].chunks, rows["q3"].chunk_ids, rows["q3"].gold_index) == (["one", "", "zero"], ["d_1", "gone", "d_0"], [])
    cross = question_frame(spark, "source_chunk_ids", [("cross_x", "q4", "a", "open-ended", None, [], 1, ["d_1", "gone"])])
    assert assemble.across_documents(cross, chunked).first().chunks == ["one", ""]
    empty = assemble.evaluation_table(known, None, None, None)
    assert empty.schema == schemas.PREPARED and empty.count() == 0


def test_scores_have_their_invariants(spark):
    assert scoring.partial_ratio("abc", "xxabcxx") == 100 == scoring.partial_ratio("xxabcxx", "abc")
    assert scoring.partial_ratio("", "a") == scoring.partial_ratio(None, "a") == 0
    assert 60 < scoring.partial_ratio("the quick brown fox", "a quick brown dog ran") < 100
    assert scoring.citation_scores([], ["c"], "a") == scoring.citation_scores(["c"], [], "") == (0.0, 0.0, 0.0)
    assert scoring.citation_scores(["abc"], ["zzabczz", "q"], "abc") == (100.0, 100.0, 100.0)
    rows = [(["zero", None], ["a zero b"], "zero"), (None, None, None)]
    df = frame(spark, rows, "citations array<string>, chunks array<string>, ground_truth_answer string")
    assert [tuple(r) for r in scoring.scored(df).select(*scoring.SCORES.names).collect()] == [(100.0, 100.0, 100.0), (0.0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        scoring.scored(df, alpha=2)


def test_scores_are_the_best_over_all_windows():
    def brute(a, b):
        short, long = sorted((a, b), key=len)
        row = lambda w: [0] * (len(w) + 1)
        best = 0
        for s in range(len(long) - len(short) + 1):
            window, last = long[s : s + len(short)], row(short)
            for x in window:
                now = row(short)
                for j, y in enumerate(short):
                    now[j + 1] = last[j] + 1 if x == y else max(last[j + 1], now[j])
                last = now
            best = max(best, last[-1])
        return 100 if short in long else min(99, round(100 * best / len(short)))

    rng = random.Random(8)
    for _ in range(150):
        a, b = ("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(*size))) for size in ((1, 40), (40, 160)))
        assert scoring.partial_ratio(a, b) == scoring.partial_ratio(b, a) == brute(a, b)


def test_rewriting_keeps_the_record(spark):
    questions = frame(spark, [(1, "old", "multi-choice", ["a"]), (2, "b", "open-ended", None)], "question_id long, question string, question_mode string, choices array<string>")
    answers = frame(spark, [(1, "m", "<rewritten_question>new</rewritten_question>"), (2, "m", "nothing")], "question_id long, rewriting_model string, response string")
    got = rewriting.rewritten(questions, answers).collect()
    assert [(r.question, r.original_question, r.question_mode, r.choices) for r in got] == [("new", "old", "multi-choice", ["a"])]


def test_summaries(spark):
    documents = frame(spark, [("a", "one two"), ("b", " ".join(map(str, range(25)))), ("c", None)], "document_id string, document_text string")
    parts = summarize.parts(documents, 10, 2)
    assert sorted((r.document_id, r.part) for r in parts.collect()) == [("a", -1), ("b", 0), ("b", 1), ("b", 2), ("b", 3), ("c", -1)]
    answered = parts.withColumn("response", F.when(F.col("part") == 1, "<chunk_summary>late</chunk_summary>").when(F.col("part") == 3, "<final_summary>last").otherwise(""))
    summaries = summarize.by_document(answered)
    assert {r.document_id: r.summaries for r in summaries.collect()}["b"] == ["", "late", "", "last"]
    calls = summarize.combine_calls(summaries, "{chunk_summaries}").collect()
    assert [(r.document_id, r.prompt) for r in calls] == [("b", "- late\n- last")]
    combined = frame(spark, [("b", "no tags")], "document_id string, response string")
    assert {r.document_id: r.document_summary for r in summarize.merged(summaries, combined).collect()} == {"a": "", "b": summarize.NO_SUMMARY, "c": ""}
    assert {r.document_id: r.document_summary for r in summarize.merged(summaries, combined.where("false")).collect()}["b"] == "late"


def test_calls_answers_and_errors(spark):
    models = [inference.Model("m1"), inference.Model("m2")]
    assert [m.name for m in inference.chosen_models(models, ["m2", "zz"])] == ["m2"] and inference.chosen_models(models, None) == models[:1]
    calls = frame(spark, [(1, "ok"), (2, "bad")], "id int, prompt string")

    def provider(model, prompt):
        if prompt == "bad":
            raise TimeoutError("too slow")
        return f"{model.name}:{prompt}"

    got = inference.answers(calls, models, provider, attempts=1).collect()
    assert len(got) == 4 and {r.response for r in got if r.success} == {"m1:ok", "m2:ok"} and {r.error_type for r in got if not r.success} == {"TimeoutError"}
    pauses = []
    assert inference.ask(provider, models[0], "bad", 3, pauses.append)[1:3] == (False, 3) and pauses == [4.0, 8.0]
    kinds = frame(spark, [("Read timeout", "E"), ("", "RateLimitError"), ("bad authentication", ""), (None, "ConnectionError"), ("x", None)], "m string, k string")
    assert [r[0] for r in kinds.select(inference.error_category("m", "k")).collect()] == ["timeout", "rate_limit", "auth_error", "connection_error", "other_error"]
    assert inference.call_matrix(calls, []).count() == 0


def test_costs_count_each_call_once(spark, tmp_path):
    rows = [(1, "2024-01-01", "M", "s", 5, -1), (1, "2024-01-02", "m", "s", 5, -1), (2, "2024-01-01", "m", "s", None, 2)]
    log = frame(spark, rows, "call_id long, t string, model_name string, stage string, input_tokens long, output_tokens long").withColumn("logged_at", F.to_timestamp("t")).withColumn("encoding_used", F.lit(None).cast("string"))
    calls = metrics.calls_once(log)
    assert [tuple(r) for r in metrics.totals_by_model(calls).collect()] == [("m", 5, 2, 2)]
    assert tuple(metrics.overall_summary(calls.where("false")).first()) == (0, 0, 0, 0.0, 0.0)
    metrics.write_totals(calls, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 1


def test_empties_become_null(spark):
    df = frame(spark, [("", "", "", [], None)], "document_id string, question string, note string, citations array<string>, extra string")
    assert tuple(parsing.without_empties(df).first()) == ("", "", None, None, None)
