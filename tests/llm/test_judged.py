"""Operators that judge: truncation, pair defects, page noise, offence."""

import random
import time

import numpy as np
import pytest

from docmill.llm import offence, pagenoise, pairs, truncation

WHOLE = [
    '<output_json>\n[{"question": "a ] b", "answer": "x"}]\n</output_json>',
    '```json\n[{"q": "he said \\"x\\" and left"}]\n```',
    '[{"q": 1},]',
    '<document_analysis>It is short.</document_analysis>\n[{"q": [1, 2]}]\n\nLet me know if more questions are needed',
    '[{"q": "an "inner" quote", "a": "b"}]',
    "I have nothing to ask about this text.",
    "[]",
]
CUT = [
    '<output_json>\n[{"question": "a ] b", "answer": "x',
    '<output_json>\n[{"question": "a", "answer": "x\n</output_json>',
    '[{"q": 1}, {"q": "two"}\n```',
    "<document_analysis>\nThe text begins with",
    "<document_analysis>All of it.</document_analysis>\n\n<output_js",
    '[{"q": "some words…',
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole_responses(text):
    assert truncation.response_state(text)[0] == "whole"


@pytest.mark.parametrize("text", CUT)
def test_cut_responses(text):
    assert truncation.response_state(text)[0] == "cut"


def summaries(n=300, seed=4):
    rng = random.Random(seed)
    ends = ["left the harbour before noon", "counted every crate in the barn", "found the old map under the bridge"]
    line = lambda: f"The {rng.choice(['baker', 'keeper', 'clerk'])} {rng.choice(ends)}."
    return [" ".join(line() for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_truncation_finds_cut_summaries_only(spark):
    texts = summaries()
    rows = [("document_summary", f"d{i}", "m", t) for i, t in enumerate(texts)]
    cut = {"c1": texts[0] + " The keeper found the old", "c2": texts[1] + " The clerk counted every cra", "c3": texts[2] + " The baker left the […]", "c4": "- one, A\n- two, B\n- thr"}
    sound = {"s1": texts[0][:-1], "s2": texts[1] + " (Editor, 2020)", "s3": "No summary available.", "s4": "", "s5": None, "s6": "- one, Alpha\n- two, Beta"}
    rows += [("document_summary", k, "n", t) for k, t in {**cut, **sound}.items()]
    values = spark.createDataFrame([(*r, 1) for r in rows + rows[:20]], "field string, record_id string, source string, text string, chars int")
    judged = truncation.verdicts(values)
    assert {r.record_id for r in judged.where("cut").collect()} == set(cut)
    assert {r.source: r.truncated for r in truncation.rates(judged).collect()} == {"m": 0, "n": 4}
    assert truncation.verdicts(values.where("false")).count() == 0


def test_limits_decide_where_there_are_any(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(("oak", "birch", "alder", "rowan")) for _ in range(n // 3))[: n - 1]
    rows = [("document_summary", f"w{i}", "m", text(rng.randint(200, 800)) + ".") for i in range(300)]
    rows += [("document_summary", f"c{i}", "m", text(400) + "x") for i in range(25)] + [("document_summary", f"s{i}", "m", text(400) + ".") for i in range(5)]
    judged = truncation.verdicts(spark.createDataFrame(rows, "field string, record_id string, source string, text string")).cache()
    by = {r.record_id: r.evidence for r in judged.where("cut").collect()}
    assert by == {f"c{i}": "limit" for i in range(25)}
    assert {(r.unit, r.length, r.records >= 30, r.truncated) for r in truncation.limits(judged).collect()} == {(u, 400, True, 25) for u in ("chars", "bytes")}
    assert [(r.truncated, r.by_limit, r.by_ending) for r in truncation.rates(judged).collect()] == [(25, 25, 0)]


def test_spikes_stand_out(spark):
    lengths = [*range(300, 500), *[400] * 30]
    rows = [("f", str(i), "m", n, n, "whole", [], None) for i, n in enumerate(lengths)]
    found = truncation.spikes(spark.createDataFrame(rows, truncation.INSPECTED)).collect()
    assert {(r.unit, r.length) for r in found} == {("chars", 400), ("bytes", 400)}


@pytest.mark.parametrize("text", [None, "", " ​\n", "...", "N/A", "null", "<answer></answer>", "Answer:", "[]", "--", "TBD"])
def test_placeholders_are_nothing(text):
    assert pairs.nothing(text)


@pytest.mark.parametrize("text", ["A", "(b)", "No.", "0", "None of them", "はい"])
def test_short_answers_are_something(text):
    assert not pairs.nothing(text)


def test_copies():
    q = "How many crates did the clerk count before noon in the barn?"
    for copy in (q, q.lower(), "Answer: " + q, f"{q} {q}", q[:-1] + ".", q.replace("crates", "crtaes")):
        assert pairs.copies(q, copy)
    for sound in (q + " Seventeen.", "The clerk", "before noon", q[:-1] + ": 17", ""):
        assert not pairs.copies(q, sound)
    assert not pairs.copies(None, q)


SAYINGS = {
    "en": "the clerk counted every crate before noon and then went to the harbour because nobody had seen the old map",
    "de": "der alte wirt hat jede kiste gezählt und ging dann zum hafen weil niemand die karte gesehen hat",
    "fr": "le vieux meunier comptait chaque caisse avant midi puis allait au port parce que personne ne trouvait la carte",
    "ru": "старый мельник считал каждый ящик до полудня и потом пошёл в порт потому что никто не видел карту",
    "ja": "古い地図を見た人がいなかったので、係員は昼前に箱を数えてから港へ行った",
}


def labelled_documents(spark, copies=40):
    rng = random.Random(2)
    mixed = lambda t: " ".join(rng.sample(t.split(), len(t.split())))
    rows = [(mixed(t), rng.choice([lang, lang.upper(), f"{lang}-XX"])) for lang, t in SAYINGS.items() for _ in range(copies)]
    return spark.createDataFrame(rows + [("odd slip", "zz"), (None, "en"), ("no label", None), ("none", "und")], "text string, lang string")


def test_languages_are_learned_and_names_tell_nothing(spark):
    known = pairs.Languages.of(labelled_documents(spark))
    assert known.names == sorted(SAYINGS)
    for a, x in SAYINGS.items():
        for b, y in SAYINGS.items():
            assert known.differ(f"Rovpelkinlane: {x}?", f"Jorvapirdigg, {y}") == (a != b)
    assert known.differ(SAYINGS["en"], SAYINGS["de"].upper())
    for answer in ("Le Havre", "17", "Zürich (Kreis 4)", ""):
        assert not known.differ(SAYINGS["en"], answer)
    assert not pairs.Languages({}).differ("a b c", "d e f")


def brute_clusters(openings):
    root = {o: o for o in openings}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shingles = {o: pairs._shingles(o) for o in openings}
    for a in openings:
        for b in openings:
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                root[find(a)] = find(b)
    return {o: find(o) for o in openings}


@pytest.mark.parametrize("rows", [4096, 3])
def test_opening_clusters_recall_the_links_of_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(pairs, "BUCKET_ROWS", rows)
    rng = random.Random(7)
    bases = [[f"w{rng.randint(0, 300)}" for _ in range(16)] for _ in range(12)]
    openings = {" ".join(b[: rng.randint(13, 16)]) for b in bases for _ in range(8)} | {" ".join([f"x{i}", *b[1:]]) for i, b in enumerate(bases)}
    clusters = {r.opening: r.cluster for r in pairs.opening_clusters(spark.createDataFrame([(o,) for o in sorted(openings)], "opening string")).collect()}
    expected = brute_clusters(sorted(openings))
    together = [(a, b) for a in openings for b in openings if a < b and expected[a] == expected[b]]
    assert sum(clusters[a] == clusters[b] for a, b in together) >= 0.98 * len(together)
    assert all(expected[a] == expected[b] for a in openings for b in openings if clusters[a] == clusters[b])


def test_openings_mask_names_and_numbers_and_take_short_sentences_together():
    assert pairs.opening("I'm sorry. I can't help with that. Bye.")[0] == "i m sorry i can t help with that"
    assert pairs.opening("I can not help with Rovpel or Dorn in 17", "Dorn in 17?") == ("i can not help with N or N in #", False, ["rovpel"])
    assert pairs.opening("It moved 17 tonnes of Salt", "Salt in 18?") == ("it moved # tonnes of N", True, [])
    assert pairs.opening("No.")[0] is None and pairs.opening("17 18 19 20")[0] is None


def test_pair_defects(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        what, where = f"crate{rng.randint(1, 900)}", f"Barn{rng.choice('abcdefgh')}{i}"
        de = i % 4 == 0
        q = f"Was hat der Müller in {where} mit der Kiste {what} gemacht?" if de else f"What did the clerk in {where} do with the {what}?"
        a = f"Der Müller hat die Kiste {what} in {where} mit dem Seil gezählt." if de else f"The clerk counted the {what} in {where} before the frost."
        rows.append((i, f"d{i}", q, a, [a], 1))
    bad = {
        1: ("empty_answer", "nan"), 2: ("copied_question", rows[2][2]), 5: ("wrong_language", rows[8][3]), 6: ("truncated_answer", "The clerk counted the crate1 in Barna6 before the fr"),
        **{k: ("refusal", "I would rather not answer this one.") for k in (9, 10, 11, 13)},
    }
    for k, (_, answer) in bad.items():
        rows[k] = (*rows[k][:3], answer, *rows[k][4:])
    rows[14] = (*rows[14][:4], ["", None, "N/A"], 1)
    rows[15] = (15, "d15", None, "B", None, 1)
    documents = spark.createDataFrame([(f"{q} {a}", "de" if i % 4 == 0 else "en") for i, _, q, a, *_ in rows[100:]], "text string, lang string")
    frame = spark.createDataFrame(rows + rows[:30], "question_id long, document_id string, question string, self_answer string, citations array<string>, defect int")
    got = {(r.question_id, r.defect) for r in pairs.defects(frame, documents).collect()}
    assert got == {(k, d) for k, (d, _) in bad.items()} | {(14, "no_citation"), (15, "no_citation")}
    assert pairs.defects(frame.where("false"), documents.where("false")).count() == 0


def test_openings_cluster_by_verified_similarity(spark):
    base = "i am very sorry but i can not help you with that request at all today"
    rows = [(base,), (base + " friend",), ("because nobody had signed the old maintenance sheet",), (base,)]
    clusters = {r.opening: r.cluster for r in pairs.opening_clusters(spark.createDataFrame(rows, "opening string")).collect()}
    assert clusters[base] == clusters[base + " friend"] and len(set(clusters.values())) == 2


def brute_within(words, word, most):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    return {w for w in words if distance(word, w) <= most}


def brute_with_shapes(a, b):
    """Fewest edits between two words, a shape taken for a letter (or a letter for a shape) being one."""
    best = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [best[i, j]] if (i, j) in best else []
            ways += [best[i - 1, j - 1] + (a[i - 1] != b[j - 1])] if i and j else []
            ways += [best[i - 1, j] + 1] if i else []
            ways += [best[i, j - 1] + 1] if j else []
            for shape, letter in pagenoise.SHAPES:
                ways += [best[i - 2, j - 1] + 1] if a[:i].endswith(shape) and b[:j].endswith(letter) else []
                ways += [best[i - 1, j - 2] + 1] if a[:i].endswith(letter) and b[:j].endswith(shape) else []
            best[i, j] = min(ways)
    return best[len(a), len(b)]


def test_trie_and_automaton_find_every_candidate():
    rng = random.Random(1)
    for length in range(1, 8):
        vocabulary = {"".join(rng.choice("abrnmcil") for _ in range(length)) for _ in range(80)}
        questions = ["".join(rng.choice("abrnmcil") for _ in range(max(1, length + rng.randint(-3, 3)))) for _ in range(300)]
        most = [rng.choice((1, 2)) for _ in questions]
        trie = pagenoise.Trie(list(vocabulary))
        got = {(int(q), trie.words[w]): int(d) for q, w, d in zip(*trie.within(questions, most))}
        distances = {(i, w): brute_with_shapes(q, w) for i, q in enumerate(questions) for w in vocabulary}
        assert got == {k: d for k, d in distances.items() if d <= most[k[0]]}
        assert all((i, w) in got for i, q in enumerate(questions) for w in brute_within(vocabulary, q, most[i]))
    assert [len(x) for x in pagenoise.Trie([]).within(["a"], [1])] == [0, 0, 0]


def test_candidates_of_shards_and_blocks_are_those_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(pagenoise, "SHARD_WORDS", 7)
    monkeypatch.setattr(pagenoise, "BLOCK_WORDS", 5)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abrnm") for _ in range(rng.randint(2, 7)))
    vocabulary, questions = {word() for _ in range(150)}, {word() for _ in range(60)}
    asked = spark.createDataFrame([(q, 1 + len(q) % 2) for q in questions], "plain string, most int")
    found = pagenoise.candidates(asked, spark.createDataFrame([(w,) for w in vocabulary], "meant string")).collect()
    assert len(found) == len({(r.plain, r.meant) for r in found})
    assert {(r.plain, r.meant): r.distance for r in found} == {(q, w): d for q in questions for w in vocabulary if (d := brute_with_shapes(q, w)) <= 1 + len(q) % 2}


PAGE = """Notes

In the morning the keeper counted every crate in the har-
bour, and the clerk wrote tbe numbers in the b0ok be-
Page 12 / 90
Alder and Birch – Annual Notes
fore the tide came in. The rnorning was cold and
the keeper closed the gate early.

The next day the clerk found a letter in the
Page 13 / 90
Alder and Birch – Annual Notes
old book, and nobody knew who had written it.
"""
CLEAN = "In the morning the keeper counted every crate in the harbour, and the clerk wrote the numbers in the book before the tide came in. The morning was cold and the keeper closed the gate early. The next day the clerk found a letter in the old book, and nobody knew who had written it."


def test_page_noise_is_found_and_repaired(spark):
    wrapped = CLEAN.replace(" the ", "\nthe ")
    numbers = CLEAN + "\n\n" + "\n".join(map(str, (40, 7, 300, 22))) + "\n" + CLEAN
    rows = [("scan", PAGE), ("scan", PAGE), ("wrapped", wrapped), ("numbers", numbers), ("null", None), ("empty", "")] + [(f"c{i}", CLEAN) for i in range(5)]
    documents = spark.createDataFrame([(*r, "x") for r in rows], "document_id string, text string, noise string")
    fixed = pagenoise.repaired(documents)
    assert {(r.document_id, r.noise) for r in pagenoise.kinds_found(fixed).collect()} == {("scan", k) for k in pagenoise.KINDS}
    text = fixed.where("document_id = 'scan'").first().text
    assert text == "Notes\n\n" + CLEAN.replace(" The next day", "\n\nThe next day")
    assert pagenoise.repaired(documents.where("false")).count() == 0


def repaired_texts(spark, pages, intact):
    """Repaired text of each page, between lines of its own that make it a page with noise; ``intact`` has (text, copies)."""
    rows = [(f"p{i}", f"Wild geese crossed the har-\nbour.\n\n{x}") for i, x in enumerate(pages)]
    rows += [(f"i{i}_{k}", x) for i, (x, n) in enumerate([*intact, ("wild geese crossed the harbour", 4)]) for k in range(n)]
    fixed = {r.document_id: r.text for r in pagenoise.repaired(spark.createDataFrame(rows, "document_id string, text string")).collect()}
    return [fixed[f"p{i}"].split("\n\n", 1)[1] for i in range(len(pages))]


def test_misread_capitalised_and_final_words_are_repaired_and_names_kept(spark):
    intact = [("according after the keeper came to gate in september with müller and brücke closed out st they. According After The September Müller Brücke St", 4)]
    cases = {
        "Accorcling to the Müllcr in Septernber.": "According to the Müller in September.",
        "Aftcr the keeper came to the gatc.": "After the keeper came to the gate.",
        "closed the Brückc": "closed the Brücke",
        "The keeper Ost came with Mollar and Aster, Aster": "The keeper Ost came with Mollar and Aster, Aster",
        "closed the gat": "closed the gat",
        "Septernber came, Septernber": "September came, September",
        "the gat€ and the ga+e, af+er": "the gate and the gate, after",
        "they came af@ and wi+h": "they came af@ and with",
    }
    assert repaired_texts(spark, cases, intact) == list(cases.values())


def test_rare_words_survive_and_context_ranks_over_distance(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioubdgkmpst") for _ in range(7))
    vocabulary = [word() for _ in range(1500)]
    copies = [max(1, 400 // (rank + 1)) for rank in range(len(vocabulary))]  # a tail of words that stand in one document each
    near = vocabulary[0][:3] + "x" + vocabulary[0][4:]  # a rare word beside a frequent one
    texts = [" ".join(w for w, n in zip([near, *vocabulary], [1, *copies]) if n > k) + "." for k in range(400)]
    page = "\n".join(" ".join(vocabulary[i : i + 9]) for i in range(700, 1500, 9))
    contexts = [("the keeper locked the garden gate", 30), ("one warden came", 9)]
    got = repaired_texts(spark, [f"{near}\n{page}\nand {near} then", "the keeper locked the gxrdxn gate"], [(t, 1) for t in texts] + contexts)
    assert got[0].split() == f"{near} {page} and {near} then".split()
    assert got[1] == "the keeper locked the garden gate"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_pages_with_any_line_end_and_few_broken_lines(spark, end):
    rows = [("a", PAGE.replace("\n", end)), ("b", "The clerk wrote it in the har-\nbour book.".replace("\n", end))] + [(f"c{i}", CLEAN) for i in range(5)]
    found = pagenoise.kinds_found(pagenoise.repaired(spark.createDataFrame(rows, "document_id string, text string"))).collect()
    assert {(r.document_id, r.noise) for r in found} == {("a", k) for k in pagenoise.KINDS} | {("b", "hyphenation")}


def test_very_long_pages_take_time_in_proportion(spark):
    began = time.monotonic()
    rows = [("chain", "quo-\n" * 20_000 + "bar"), ("lines", "the old\nkeeper came " * 20_000), ("blank", "\n" * 200_000), ("run", "q" * 500_000 + "\nfoo"), ("code", "a-" * 100_000), ("null", None)]
    rows += [(f"c{i}", CLEAN) for i in range(3)]
    found = {(r.document_id, r.noise) for r in pagenoise.kinds_found(pagenoise.repaired(spark.createDataFrame(rows, "document_id string, text string"))).collect()}
    assert found == {("chain", "hyphenation")} and time.monotonic() - began < 120


def test_repair_gives_back_what_the_page_had(spark):
    """Words of intact texts, then noise on them, as a page would have it: nearly all come back."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(("ba", "ke", "lo", "mi", "nu", "ra", "so", "te", "vi", "du")) for _ in range(rng.randint(2, 4)))
    vocabulary = sorted({word() for _ in range(400)})
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(12)) + "."
    truth = [" ".join(sentence() for _ in range(12)) for _ in range(12)]
    slips = {"e": "c", "o": "0", "l": "1", "s": "5", "t": "+", "m": "rn", "d": "cl", "h": "b"}
    noisy, wrong = [], 0
    for text in truth:
        words = text.split(" ")
        for i in rng.sample(range(len(words)), 20):
            at = [k for k, c in enumerate(words[i][:-1]) if c in slips and k]
            if at:
                k = rng.choice(at)
                words[i] = words[i][:k] + slips[words[i][k]] + words[i][k + 1 :]
                wrong += 1
        noisy.append("\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8)))
    got = repaired_texts(spark, noisy, [(" ".join(vocabulary[i::4]), 3) for i in range(4)])
    same = sum(a == b for x, y in zip(got, truth) for a, b in zip(x.split(), y.split()))
    total = sum(len(y.split()) for y in truth)
    assert wrong > 200 and all(len(x.split()) == len(y.split()) for x, y in zip(got, truth))
    assert same >= total - 0.05 * wrong


def test_running_lines_count_as_repeated_in_texts_of_any_length():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdegkmopt") for _ in range(6))
    for pages in (20, 150):
        lines, breaks, headers = [], set(), set()
        for p in range(pages):
            lines += [f"{word()} {word()} {word()} {word()}." for _ in range(4)]
            at = p % 20
            headers.add(len(lines))
            breaks.add(len(lines))
            head = "alder and oak gazette of the year"
            lines.append(head[:at] + "wxyzvjqs"[p // 20] + head[at + 1 :])
        assert {k for k, v in pagenoise.furniture(lines, breaks).items() if v == "header"} == headers
    lines = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 24))) for _ in range(900)}
    assert pagenoise._alike(lines) == {f: {g for g in lines if pagenoise._similar(f, g)} for f in lines}


def offence_corpus(n, seed):
    rng = random.Random(seed)
    benign = ["The clerk counted {} crates before noon.", "A letter about the {} bridge was found.", "To kill the stuck process, send signal {} twice.", "The idiot box, as the {} term goes, is a television.", "We met at {} and drank tea."]
    rude = ["You are a stupid moron and everyone knows it {}.", "Shut up, you filthy idiot number {}.", "I will find your house and kill you {}.", "Go drown yourself, you pathetic moron {}."]
    docs = []
    for _ in range(n):
        lines = [rng.choice(benign).format(rng.randint(1, 99)) for _ in range(rng.randint(2, 6))]
        bad = rng.random() < 0.35
        if bad:
            lines.insert(rng.randint(0, len(lines)), rng.choice(rude).format(rng.randint(1, 99)))
        docs.append((" ".join(lines), int(bad)))
    return docs


def test_offence_on_held_out_documents():
    train, test = offence_corpus(400, 1), offence_corpus(300, 2)
    rng = random.Random(3)
    noisy = [1 - y if rng.random() < 0.06 else y for _, y in train]
    scorer = offence.Scorer(*offence.fit([t for t, _ in train], noisy))
    guess = np.array([scorer.score(t)[0] > offence.THRESHOLD for t, _ in test])
    truth = np.array([y == 1 for _, y in test])
    assert (guess & truth).sum() / truth.sum() > 0.95 and (guess & truth).sum() / guess.sum() > 0.95
    for disguised in ("You are a stuuupid m o r o n and everyone knows it.", "You are a st​upid m0ron and everyone knows it."):
        assert scorer.score(disguised)[0] > offence.THRESHOLD
    assert scorer.score(None) == scorer.score("") == (0.0, None)


def test_offence_frames(spark):
    docs = [(i, t, f"s{i % 2}", y) for i, (t, y) in enumerate(offence_corpus(200, 5))] + [(900, None, None, 0), (901, "", "s0", 0)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, abusive int")
    labels = spark.createDataFrame([(d, "a", y) for d, _, _, y in docs[:120]] + [(900, "a", None), (1, "b", None), (2, "b", 1 - docs[2][3])], "doc_id long, annotator string, abusive int")
    scores = offence.scored(documents, labels).cache()
    assert scores.count() == len(docs)
    found = {r.doc_id for r in offence.named(scores).collect()}
    truth = {d for d, _, _, y in docs if y}
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 0.1 * len(truth)
    assert sum(r.documents for r in offence.rates(scores).collect()) == len(docs)
    nothing = offence.scored(documents, labels.where("abusive = 0"))
    assert nothing.where("score > 0.5").count() == 0
    assert offence.scored(documents.where("false"), labels).count() == 0
