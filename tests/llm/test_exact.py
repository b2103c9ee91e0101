"""Operators whose results are defined exactly: splitting, near-duplicates, encoding, leakage."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.llm import encoding, leakage, neardup, queries, splitting
from docmill.llm.words import words

TOKENIZER = encoding.vocabulary_path("byte_bpe_50k")
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files here")


def check_spans(text, limit):
    found = splitting.spans(text, limit)
    if len(text) <= limit:
        assert found == []
        return found
    assert "".join(text[own:end] for _, own, end in found) == text
    assert all(end - start <= limit for start, _, end in found)
    assert found[0][0] == 0 and all(100 <= own - start <= 200 for start, own, _ in found[1:])
    return found


def prose(n, seed=1):
    rng = random.Random(seed)
    sentences = (" ".join(rng.choice("one two three four five six".split()) for _ in range(rng.randint(4, 12))).capitalize() + "." for _ in range(n))
    return "".join(s + ("\n\n" if rng.random() < 0.1 else " ") for s in sentences)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n。é👩‍🏽́\r"), min_size=1201, max_size=5000))
def test_pieces_give_the_text_back(text):
    check_spans(text, 1200)


def test_pieces_end_at_boundaries_and_survive_edits():
    text = prose(400)
    cuts = [e for _, _, e in check_spans(text, 1200)]
    assert all(text[:e].rstrip().endswith(".") for e in cuts)
    edited = text[:5000] + "some inserted words " + text[5000:]
    shifted = {e - 20 if e > 5000 else e for _, _, e in check_spans(edited, 1200)}
    assert len(shifted & set(cuts)) >= len(cuts) - 3
    for solid in ("x" * 9000, "語" * 9000, "👩‍🏽" * 3000, "á" * 4000):
        for _, _, end in check_spans(solid, 4000)[:-1]:
            assert solid[end] not in "‍🏽́"
    check_spans(prose(20000), 4000)
    with pytest.raises(ValueError):
        splitting.spans("x" * 500, 300)


def test_splitting_frames(spark):
    rows = [("a", None, None, 1), ("b", "", [], 1), ("c", "y " * 3000, [("c_0", "z " * 700), ("c_1", None), None], 1)]
    chunked = spark.createDataFrame(rows + rows[2:], "document_id string, document_text string, chunks array<struct<chunk_id:string,chunk_text:string>>, piece int")
    got = splitting.split(splitting.chunked_items(chunked)).collect()
    assert {(r.field, r.item_id) for r in got} == {("document_text", "c"), ("chunk_text", "c_0")}
    assert len(got) == len({(r.field, r.item_id, r.piece) for r in got})
    assert splitting.split(splitting.chunked_items(chunked.where("false"))).count() == 0


def brute_pairs(rows):
    sets = {i: set(words(f"{q} {a or ''}")) for i, q, a in rows if q and q.strip()}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


def records(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "question_id long, question string, self_answer string, words string")


def noisy_records(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 14))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        found = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            found[rng.randrange(len(found))] = rng.choice(vocabulary)
        rng.shuffle(found)
        rows.append((i, " ".join(found), rng.choice([None, "", "B", "yes"])))
    return rows


@pytest.mark.parametrize("tile", [4096, 40])
def test_pairs_match_brute_force_also_in_cut_blocks(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE_ROWS", tile)
    rows = noisy_records(400, 3) + [(9001, None, "a"), (9002, " 　", "a"), (9003, "?!", None), (9004, "w1 w2", None), (9004, "w1 w2", None)]
    made = neardup.NearDuplicates(records(spark, rows))
    got = [tuple(r) for r in made.pairs().collect()]
    expected = brute_pairs(dict((r[0], r) for r in rows).values())
    assert len(got) == len(set(got)) and set(got) == expected
    groups = {r.question_id: r for r in made.groups().collect()}
    links = {i: sum(i in p for p in expected) for i in {x for p in expected for x in p}}
    assert {i: g.links for i, g in groups.items()} == links
    root = {i: i for i in links}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in expected:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert all((groups[a].group_id == groups[b].group_id) == (find(a) == find(b)) for a in links for b in links)


def test_many_copies_form_one_class(spark):
    rows = [(i, "the very same question", "here") for i in range(60)] + [(100, "the very same question", "here too")]
    made = neardup.NearDuplicates(records(spark, rows))
    assert made.links.count() == 1 and made.pairs().count() == 61 * 60 // 2
    assert {r.group_id for r in made.groups().collect()} == {0}
    empty = neardup.NearDuplicates(records(spark, rows).where("false"))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_a_hot_word_gives_tiles_of_bounded_size_within_the_radius_only(spark):
    n, size = 200_000, 12 + 8 * (F.col("id") % 3)
    words = F.concat(F.array(F.lit(7).cast("long")), F.transform(F.sequence(F.lit(1), size.cast("int") - 1), lambda i: F.xxhash64("id", i)))
    sized = spark.range(n).select("id", size.cast("int").alias("n"), F.xxhash64("id").alias("high"), F.xxhash64("id", F.lit(1)).alias("low"), words.alias("words"), F.lit(0).alias("alone"), size.cast("int").alias("common"))
    per = neardup.blocks(sized).where("token = 7").groupBy("first", "second").count().collect()
    most, written = max(r["count"] for r in per), sum(r["count"] for r in per)
    tiles = -(-n // neardup.TILE_ROWS)
    assert most <= 2.2 * neardup.TILE_ROWS and len(per) < 0.75 * tiles * (tiles + 1) / 2
    assert written <= n + 2.2 * neardup.TILE_ROWS * len(per)
    assert {r["first"] for r in per if r["first"] == r["second"]} == set(range(tiles))


def test_copies_beyond_a_tile_give_every_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_ROWS", 7)
    text = lambda i: "one and the same question " + ("again" if i % 3 else "")
    made = neardup.NearDuplicates(records(spark, [(i, text(i), None) for i in range(40)]))
    pairs = [tuple(r) for r in made.pairs().collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i in range(40) for j in range(i + 1, 40)}


def test_tiles_lose_nothing_that_is_within_the_radius():
    rng = np.random.default_rng(5)
    n = 700
    sizes, side = rng.integers(1, 30, n).astype(np.int32), np.full(n, -1)
    high = rng.integers(0, 1 << 6, n).astype(np.uint64)
    low = rng.integers(0, 1 << 6, n).astype(np.uint64)
    got = {tuple(sorted(p)) for p in zip(*neardup._tiles(sizes, high, low, side, 64))}
    hamming = np.bitwise_count(high[:, None] ^ high).astype(np.int64) + np.bitwise_count(low[:, None] ^ low)
    close = neardup._close(sizes[:, None], sizes[None], hamming)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if close[i, j]}


def test_chains_end_in_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 101)], "a long, b long")
    roots = {r.id: r.root for r in neardup.components(links).collect()}
    assert {roots[i] for i in range(1, 41)} == {1} and roots[101] == 100 and len(roots) == 42


@needs_tokenizer
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" '\n\ttsre09éßяの👍‍<|>"))))
def test_ids_are_the_library_s_and_decode_back(text):
    encoder = encoding.encoder(TOKENIZER)
    ids = encoder.encode([text])[0]
    assert ids == encoder._library([text])[0] if text else ids == []
    assert encoder.decode(ids) == text
    spans = encoder.offsets(text, ids)
    assert len(spans) == len(ids) and all(a < b for a, b in spans) and (not spans or (spans[0][0] == 0 and spans[-1][1] == len(text)))


@needs_tokenizer
def test_encoding_frames(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a <|endoftext|> b", 0), (4, "x " * 200_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(docs, "doc_id", "text", "byte_bpe_50k").collect()}
    assert got[1] == got[2] == [] and 50256 not in got[3] and len(got[4]) >= 200_000
    back = encoding.encode_corpus(docs, "doc_id", "text", "byte_bpe_50k").select("doc_id", encoding.decode_ids(F.col("ids"), "byte_bpe_50k").alias("t"))
    assert {r.doc_id: r.t for r in back.collect()}[3] == "a <|endoftext|> b"
    spans = encoding.encode_with_offsets(docs.where("doc_id = 3"), "doc_id", "text", "byte_bpe_50k").first()
    assert spans.starts[0] == 0 and spans.ends[-1] == len("a <|endoftext|> b")


def brute_leaks(docs, items, n):
    grams = lambda t: {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}
    return {(d, i) for d, t in docs for i, p, q in items if grams(t) & (grams(p) | grams(q))}


@pytest.mark.parametrize("block_chars", [10_000, 60])
def test_leaks_match_brute_force(spark, monkeypatch, block_chars):
    monkeypatch.setattr(leakage, "SHARD_WORDS", 100)
    monkeypatch.setattr(leakage, "PAIRS_TOGETHER", 13)
    rng = random.Random(2)
    text = lambda k: " ".join(rng.choice("aa bb cc dd").capitalize() for _ in range(k))
    items = [(i, text(12), text(3)) for i in range(6)] + [(7, None, "")]
    docs = [(i, text(rng.randint(0, 60)) + ", " + (items[i % 6][1] if i % 3 == 0 else "")) for i in range(40)] + [(50, None), (51, ""), (0, None)]
    doc_frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    item_frame = spark.createDataFrame(items, "item_id long, passage string, question string")
    matches = leakage.leaks(doc_frame, item_frame, 5, block_chars).cache()
    assert {tuple(r) for r in leakage.leaked_documents(matches).collect()} == brute_leaks(docs, items, 5)
    assert matches.where("match_words < 5").count() == 0
    leaked = {r.doc_id for r in matches.collect()}
    assert {r.doc_id for r in leakage.without_leaks(doc_frame, matches).collect()} == {d for d, _ in docs} - leaked
    assert leakage.leaks(doc_frame.where("false"), item_frame, 5).count() == 0 and leakage.leaks(doc_frame, item_frame.where("false"), 5).count() == 0


def test_the_documents_without_leaks_are_a_query(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, "before " + item), (2, item[:60]), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item, "q")], "item_id long, passage string, question string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert {r.doc_id for r in queries.queries()["p7_clean"](spark, str(tmp_path)).collect()} == {2, 3}


def test_a_match_is_grown_to_its_full_length(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, item[:60])], "doc_id long, text string")
    items = spark.createDataFrame([(9, item, "q")], "item_id long, passage string, question string")
    found = leakage.leaks(docs, items).collect()
    assert [(r.doc_id, r.match_words, r.doc_word, r.item_word) for r in found] == [(1, 30, 1, 0)]
    assert tuple(leakage.leaked_items(leakage.leaks(docs, items)).first()) == (9, 1, 30)
