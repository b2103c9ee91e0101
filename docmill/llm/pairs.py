"""Problem 2: broken prompt and response pairs.

Each record gets the names of its defects. Refusals come from clusters of response openings:
openings are joined by MinHash over five-word shingles, each join verified (similarity 0.8 or
more), and a cluster whose wording recurs across unrelated documents while saying nothing of its
own prompts and citations is a refusal template. The remaining defects come from checks of the
copy (no word of the answer's own), the language (statistics of the letters of words, learned from
all documents that name their language) and the termination (see ``truncation``: do sentences end
on these words?).

Edge cases: a null, blank or placeholder answer is an empty answer and has no other answer defect;
a null question has no copy or language defect, nor has a record in a language that no document
names; null and empty citation lists are no citation; a
redelivered record counts once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.neardup import components
from docmill.llm.truncation import _BITS, _STEP, count_ends, end_counts, prose_state, units, word_hashes
from docmill.llm.words import WORD, words
from docmill.session import cut_lineage

#: Answers and citations that stand for nothing (fixed values).
PLACEHOLDERS = set(
    "nan null none nil na n/a tbd tba todo undefined missing unknown placeholder answer antwort réponse reponse respuesta ответ 回答 答え".split()
) | {"no answer", "not available", "not applicable", "no answer available", "no citation", "no citations", "to be determined", "to do"}

#: Openings by which a speaker declines (fixed patterns); they only help where a template recurs too rarely to be seen.
DECLINING = re.compile(
    r"\b(?:i(?:'|’| a)?m (?:sorry|afraid|unable|not able|not in a position)|i (?:can(?:'|’)?t|cannot|can not|won(?:'|’)t|will not|must decline|do not feel)"
    r"|not possible for me|(?:must|have to) decline|against my guidelines|no response can|request denied|language model|content policy|rather not"
    r"|je suis désolée?|je ne (?:peux|suis)|m'est impossible|je dois (?:décliner|refuser)"
    r"|tut mir leid|leider (?:kann|muss|darf)|kann ich nicht|darf ich nicht|muss ich (?:hier )?ablehnen|nicht möglich"
    r"|lo siento|no puedo|no me es posible|debo rechazar|извините|не могу|申し訳|お答えできません|できません)",
    re.I,
)

#: A template recurs across at least so many documents, shares at most this part of its words with its prompts, and in at most this part of
#: its answers gives a number that the question doesn't have; such names are different ones in less than this part (who declines tells nothing).
TEMPLATE_DOCUMENTS, TEMPLATE_GROUNDING, TEMPLATE_NUMBERS, TEMPLATE_NAMES, TEMPLATE_WORDS = 3, 0.25, 0.2, 0.5, 4

#: Words of an opening, of a shingle, and the similarity that joins two openings.
OPENING_WORDS, SHINGLE, SIMILAR = 16, 5, 0.8

#: MinHash bands and rows.
BANDS, ROWS = 16, 4

#: Share of sentence ends below which an unterminated answer broke off.
ANSWER_END_SHARE = 0.25

#: Documents that must name a language before it is known (so that slips of the label aren't languages).
LANGUAGE_DOCUMENTS = 20

#: Buckets of the language statistics, letters of a feature, and the longest word that is a feature as a whole.
BUCKETS, LETTERS, SHORT = 1 << 14, 3, 4

#: Features that a text must have, and log-odds by which a question's language must be the likeliest, and an answer's likelier than that.
LANGUAGE_FEATURES, QUESTION_MARGIN, ANSWER_MARGIN = 3, 6.0, 20.0

#: Rows of a MinHash bucket that are compared in one task.
BUCKET_ROWS = 4096

_LETTERS = re.compile(r"[^\W\d_]+")
_SILENT = re.compile(r"[\s\u200b-\u200f\u2060\ufeff\u00ad]+")
_STOP = re.compile(r"(?<=[.!?。！？])(?:\s|(?<=[。！？]))|\n")
_WIDE = re.compile("[\u3040-ヿ一-鿿]")
_TAG = re.compile(r"</?\w+\s*/?>")
_LABEL = re.compile(r"^\s*(?:answer|antwort|réponse|respuesta|ответ|a)\s*[:：]\s*", re.I)


def nothing(text: str | None) -> bool:
    """Whether a text is null, blank or only a placeholder."""
    if text is None:
        return True
    bare = _TAG.sub(" ", text)
    if not WORD.search(bare):
        return True
    plain = _SILENT.sub(" ", bare).strip(" .:;,!?()[]{}<>\"'“”*_-–—").lower()
    return plain in PLACEHOLDERS


def language_words(text: str) -> list[str]:
    """The words that tell a language: those in small letters, in capitals throughout, or of scripts without case; names aren't."""
    return [w.lower() for w in _LETTERS.findall(text) if w.islower() or (w.isupper() and len(w) > 1) or w.lower() == w.upper()]


def features(word: str) -> list[int]:
    """Buckets of a word: its runs of letters, and the word if it is short."""
    marked = f" {word} "
    crc = zlib.crc32
    out = [crc(marked[i : i + LETTERS].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(marked) - LETTERS + 1)]
    return out + [crc(word.encode("utf-8", "surrogatepass"), 1) % BUCKETS] * (len(word) <= SHORT)


def language_counts(documents: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all documents that name their language; bucket -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def add(seen: dict[str, Counter]) -> None:
            for lang, words_ in seen.items():
                own = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for word, n in words_.items():
                    for bucket in features(word):
                        own[bucket] += n

        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                seen.setdefault(lang, Counter()).update(language_words(text))
                totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += 1
            if sum(map(len, seen.values())) > 300_000:
                add(seen)
                seen = {}
        add(seen)
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])

    named = documents.select("text", F.lower(F.regexp_extract("lang", "^[A-Za-z]+", 0)).alias("lang")).where("text IS NOT NULL AND lang NOT IN ('', 'und')")
    return named.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Languages:
    """Log-probability of each bucket in each language."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.names = sorted(lang for lang, own in counts.items() if own.get(-1, 0) >= LANGUAGE_DOCUMENTS)
        table = np.full((BUCKETS, len(self.names)), 0.5)
        for k, lang in enumerate(self.names):
            for bucket, n in counts[lang].items():
                if bucket >= 0:
                    table[bucket, k] += n
        self.log = np.log(table / table.sum(axis=0)).astype(np.float32)
        self.words: dict[str, tuple[np.ndarray, int]] = {}

    @classmethod
    def of(cls, documents: DataFrame) -> Languages:
        counts: dict[str, dict[int, int]] = {}
        kept = language_counts(documents)
        known = kept.where((F.col("bucket") == -1) & (F.col("n") >= LANGUAGE_DOCUMENTS)).select("lang")
        rows = kept.join(known, "lang", "left_semi").toArrow()  # at most BUCKETS rows a language
        for lang, bucket, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "bucket", "n"))):
            counts.setdefault(lang, {})[bucket] = n
        return cls(counts)

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        """Log-likelihood of a text in each language, and its number of features."""
        if len(self.words) > 300_000:
            self.words.clear()
        total, n = np.zeros(len(self.names), np.float32), 0
        for w in language_words(text):
            known = self.words.get(w)
            if known is None:
                own = features(w)
                known = self.words[w] = (self.log[own].sum(axis=0), len(own))
            total += known[0]
            n += known[1]
        return total, n

    def differ(self, question: str, answer: str) -> bool:
        """Whether an answer as a whole is in another language than its question."""
        if len(self.names) < 2:
            return False
        said, n = self.scores(answer)
        if n < LANGUAGE_FEATURES:
            return False
        asked, n = self.scores(question)
        own = int(asked.argmax())
        if n < LANGUAGE_FEATURES or asked[own] - np.partition(asked, -2)[-2] <= QUESTION_MARGIN:
            return False
        return bool(said.max() - said[own] > ANSWER_MARGIN)


def _alike(a: str, b: str) -> bool:
    """Whether two words differ by one slip of the pen."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    if len(a) == len(b) and sorted(a) == sorted(b):
        return True
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head + tail >= max(len(a), len(b)) - 1


def copies(question: str | None, answer: str) -> bool:
    """Whether the answer only gives the question back: much of it, and no word of its own."""
    asked, said = words(question), words(_LABEL.sub("", answer))
    if len(said) < 4 or not asked:
        return False
    known = set(asked)
    novel = {w for w in said if w not in known}
    if len(novel) > 3 or len(known.intersection(said)) < 0.5 * len(known):
        return False
    return all(any(_alike(w, v) for v in known) for w in novel)


def grounding(answer: str, question: str | None, citations: list[str | None] | None) -> float:
    """Share of the answer's words that its question or citations have too."""
    said = words(answer)
    around = set(words(question))
    for c in citations or ():
        around.update(words(c))
    return sum(w in around for w in said) / len(said) if said else 1.0


def opening(answer: str, question: str | None = None) -> tuple[str | None, bool, list[str]]:
    """The first words of an answer's first sentences, names and numbers masked; whether they give a number, and which names, that the question doesn't have.

    None where there are too few words for a template.
    """
    found: list[str] = []
    given: set[str] = set()
    named: set[str] = set()
    for sentence in _STOP.split(re.sub(r"\([^)]*\)", " ", answer).strip()):
        own = WORD.findall(sentence)
        if _WIDE.search(sentence) and not re.search(r"[A-Za-z0-9]", sentence):
            own = list("".join(own))
        given.update(w for w in own if w[0].isdigit())
        loud = sentence.isupper()
        named.update(w.lower() for w in own[1:] if not loud and w[0].isupper() and len(w) > 1)
        found += ["#" if w[0].isdigit() else "N" if k and not loud and w[0].isupper() and len(w) > 1 else w.lower() for k, w in enumerate(own)]
        if len(found) >= TEMPLATE_WORDS:
            break
    found = found[:OPENING_WORDS]
    asked = set(words(question))
    template = " ".join(found) if len(found) >= TEMPLATE_WORDS and any(w not in ("#", "N") for w in found) else None
    return template, not given <= asked, sorted(named - asked)


INSPECTED = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("defects", T.ArrayType(T.StringType())),
        T.StructField("opening", T.StringType()),
        T.StructField("grounding", T.DoubleType()),
        T.StructField("tells", T.BooleanType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("declining", T.BooleanType()),
        T.StructField("state", T.StringType()),
        T.StructField("stopped", T.BooleanType()),
        T.StructField("contexts", T.ArrayType(T.LongType())),
        T.StructField("tail", T.LongType()),
        T.StructField("whole", T.LongType()),
        T.StructField("pair", T.LongType()),
        T.StructField("brief", T.BooleanType()),
    ]
)
#: States of an end that other texts decide.
OPEN = ("cut", "open", "short", "item", "word", "caseless", "name")
COLUMNS = ("question_id", "document_id", "question", "self_answer", "citations")


#: Units of an answer that is short enough to be compared as a whole.
WHOLE_UNITS = 7


_NUMBER, _NAME, _WHOLE = (word_hashes(w)[0] for w in ("#", "N", "^"))


def _whole_keys(found: list[str]) -> list[int]:
    """Keys of an answer's beginnings, names and numbers masked."""
    out, so_far = [], _WHOLE
    for w in found[:WHOLE_UNITS]:
        so_far = (so_far * _STEP + (_NUMBER if w[0].isdigit() else _NAME if w[0].isupper() else word_hashes(w)[0])) & _BITS
        out.append(so_far)
    return out


def count_answer(answer: str, ends: Counter, total: Counter) -> None:
    """The counts of :func:`count_ends`, and how often answers begin in each masked way, and how often that is their first sentence as a whole."""
    count_ends(answer, ends, total)
    found = units(re.split(r"(?<=[.!?。])\s", answer.strip(), maxsplit=1)[0])
    keys = _whole_keys(found)
    total.update(keys)
    if keys and len(found) <= WHOLE_UNITS:
        ends[keys[-1]] += 1


def answer_end(answer: str) -> tuple[str, list[int], int | None]:
    """State of an answer's end, with the contexts that decide where it is open."""
    state, keys, tail = prose_state(answer)
    if answer.rstrip()[-1:] in set(",;:([{–—-"):
        return "cut", [], None
    if state in ("open", "short", "item", "number"):
        if answer.isupper():
            return "caseless", prose_state(answer.lower())[1], None
        if answer.islower():
            return "caseless", keys, None
        last = units(answer)[-1:]
        if last and last[0].islower():
            return "word", keys, None
    return state, keys, tail


def inspect(records: DataFrame, languages: Languages) -> DataFrame:
    """INSPECTED of every record: the defects seen in it alone, and what the others need."""
    sent = records.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            out: list[list] = [[] for _ in INSPECTED]
            for qid, doc, question, answer, citations in zip(*(c.to_pylist() for c in batch.columns)):
                defects = []
                if not citations or all(nothing(c) for c in citations):
                    defects.append("no_citation")
                first, ground, tells, names, declining, state, keys, tail = None, 1.0, False, [], False, "whole", [], None
                whole, pair, brief = None, None, False
                if nothing(answer):
                    defects.append("empty_answer")
                else:
                    question = question if question and question.strip() else None
                    if copies(question, answer):
                        defects.append("copied_question")
                    else:
                        first, tells, names = opening(answer, question)
                        ground = grounding(answer, question, citations)
                        declining = not tells and not names and DECLINING.search(answer) is not None
                        if question and known.differ(question, answer):
                            defects.append("wrong_language")
                        if len(answer.strip()) > 4:
                            state, keys, tail = answer_end(answer)
                        if state not in ("whole", "blank"):
                            found = units(answer)
                            if len(found) <= 3 and state != "cut" and (ground == 1.0 or len(found) < 3 or all(not w[0].islower() for w in found)):
                                state = "name"  # so short that only a broken word tells
                            elif len(found) <= WHOLE_UNITS:
                                whole = _whole_keys(found)[-1] if found else None
                            pair = keys[-2] if len(keys) > 1 else None
                            brief = bool(found) and found[-1].isalpha() and len(found[-1]) <= 3
                row = (qid, doc, defects, first, ground, tells, names, declining, state, state not in OPEN, keys, tail, whole, pair, brief)
                for column, value in zip(out, row):
                    column.append(value)
            texts, longs = pa.list_(pa.string()), pa.list_(pa.int64())
            types = [pa.int64(), pa.string(), texts, pa.string(), pa.float64(), pa.bool_(), texts, pa.bool_(), pa.string(), pa.bool_(), longs, *[pa.int64()] * 3, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], INSPECTED.names)

    return records.select(*COLUMNS).mapInArrow(run, INSPECTED)


def _shingles(text: str) -> set[str]:
    found = text.split(" ")
    return {" ".join(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))}


def _bands(text: str) -> list[int]:
    """MinHash band keys of an opening."""
    base = np.array([xxhash.xxh64_intdigest(s) for s in _shingles(text)], np.uint64)
    seeds = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (base[:, None] ^ seeds) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    least = mixed.min(axis=0).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) >> 1 for i, row in enumerate(least)]


def _alike_openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by bucket, and the openings that no former one of their bucket is like, as (id, null, opening, band).

    An opening is compared with the one before it and with those that stand for the others.
    """
    bucket, heads, last = None, [], None
    for batch in batches:
        out: list[tuple] = []
        for i, text, band, salt in zip(*(c.to_pylist() for c in batch.columns)):
            own = _shingles(text)
            if (band, salt) != bucket:
                bucket, heads, last = (band, salt), [], None
            near = [j for j, other in ([last] if last else []) + heads if len(own & other) >= SIMILAR * len(own | other)]
            out += [(min(i, j), max(i, j), None, None) for j in dict.fromkeys(near)]
            if not any(j in near for j, _ in heads):
                heads.append((i, own))
                out.append((i, None, text, band))
            last = (i, own)
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["a", "b", "opening", "band"])


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster): openings joined by verified MinHash.

    A bucket is gone through in parts of about ``BUCKET_ROWS`` rows, then the openings that stand for
    their part are compared over the whole bucket; the links' components are the clusters. An
    opening without partner is its own cluster.
    """

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, o, b) for i, o in zip(*(c.to_pylist() for c in batch.columns)) for b in _bands(o)]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["id", "opening", "band"])

    schema = "a long, b long, opening string, band long"
    named = openings.select(F.xxhash64("opening").alias("id"), "opening").distinct()
    buckets = named.mapInArrow(banded, "id long, opening string, band long")
    several = buckets.groupBy("band").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1")
    parts = buckets.join(several, "band").select("id", "opening", "band", F.pmod(F.xxhash64("id", "band"), F.col("parts")).alias("salt"))

    def gone_through(rows: DataFrame) -> DataFrame:
        return rows.repartition("band", "salt").sortWithinPartitions("band", "salt", "id").mapInArrow(_alike_openings, schema)

    first = cut_lineage(gone_through(parts))
    heads = first.where("b IS NULL").select(F.col("a").alias("id"), "opening", "band", F.lit(0).alias("salt"))
    links = first.unionByName(gone_through(heads)).where("b IS NOT NULL").select("a", "b").distinct()
    roots = components(links)
    return named.join(roots, "id", "left").select("opening", F.coalesce("root", "id").alias("cluster"))


def refusal_openings(inspected: DataFrame) -> DataFrame:
    """Openings of the clusters that are refusal templates, with the cluster's counts.

    An answer in another language shares no words with its prompt, so it doesn't count for its template.
    """
    telling = inspected.where("opening IS NOT NULL AND NOT array_contains(defects, 'wrong_language')")
    names = F.when(F.size("names") > 0, F.xxhash64("names")).alias("names")
    seen = telling.groupBy("opening", "document_id", names).agg(F.count("*").alias("n"), F.sum("grounding").alias("g"), F.count_if("tells").alias("t"))
    seen = cut_lineage(seen)
    clusters = cut_lineage(opening_clusters(seen.select("opening").distinct()))
    share = lambda c, name: (c / F.sum("n")).alias(name)
    shares = [share(F.sum("g"), "grounding"), share(F.sum("t"), "numbers"), share(F.countDistinct("names"), "names")]
    templates = (
        seen.join(clusters, "opening")
        .groupBy("cluster")
        .agg(F.countDistinct("document_id").alias("documents"), F.sum("n").alias("records"), *shares)
        .where((F.col("documents") >= TEMPLATE_DOCUMENTS) & (F.col("grounding") <= TEMPLATE_GROUNDING) & (F.col("numbers") <= TEMPLATE_NUMBERS) & (F.col("names") < TEMPLATE_NAMES))
    )
    return clusters.join(templates, "cluster")


def _broken_off(inspected: DataFrame, records: DataFrame) -> DataFrame:
    """Ids of the records whose answer breaks off: sentences don't end on its last words.

    Counts come from all answers; an end without a full stop counts neither as an end nor against one.
    """
    unsure = inspected.where("NOT stopped AND NOT array_contains(defects, 'copied_question')")
    about = ("question_id", "state", "brief")
    single = lambda name, rank: unsure.where(F.col(name).isNotNull()).select(*about, F.lit(rank).alias("rank"), F.col(name).alias("key"))
    keyed = unsure.select(*about, F.posexplode_outer("contexts").alias("rank", "key"))
    keyed = keyed.unionByName(single("tail", -1)).unionByName(single("pair", -2))
    answers = records.where(F.length("self_answer") > 4).select("self_answer")
    counts = cut_lineage(end_counts(answers, count_answer))
    joined = keyed.join(counts, "key", "left")
    share = F.col("ends") / F.col("total")
    at = lambda rank, value: F.max(F.when(F.col("rank") == rank, F.coalesce(value, F.lit(0.0))))
    telling = (F.col("rank") >= 0) & (F.col("total") >= 3)
    per = joined.groupBy(*about).agg(
        F.min_by(F.when(telling, share), F.when(telling, F.col("rank"))).alias("ended"),
        F.max_by(F.when(F.col("rank") >= 0, F.coalesce("total", F.lit(0))), F.when(F.col("rank") >= 0, F.col("rank"))).alias("seen"),
        at(-1, share).alias("named"),
        at(-2, F.col("total")).alias("pairs"),
    )
    usual = (
        single("whole", 0).join(counts, "key").where((F.col("total") > 3) & ((F.col("ends") - 1) / (F.col("total") - 1) >= 0.5)).select("question_id", F.lit(True).alias("usual"))
    )
    per = per.join(usual, "question_id", "left")
    unfinished = (F.col("state") != "name") & F.coalesce(F.col("ended") < ANSWER_END_SHARE, F.lit(False))
    half_word = (F.col("state") == "word") & ((F.col("seen") == 0) | (F.col("brief") & (F.col("pairs") == 0)))
    half_name = F.coalesce(F.col("named") < 0.15, F.lit(False)) & (F.col("seen") < 3)
    sound = F.coalesce("usual", F.lit(False)) & (F.coalesce("pairs", F.lit(1.0)) > 0)
    broken = (F.col("state") == "cut") | ((unfinished | half_word | half_name) & ~sound)
    return per.where(broken).select("question_id", F.lit("truncated_answer").alias("defect"))


def defects(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, defect): every defect of every record, once; ``documents`` has texts with their languages."""
    records = records.select(*COLUMNS)
    inspected = cut_lineage(inspect(records, Languages.of(documents)).dropDuplicates(["question_id"]))
    alone = inspected.select("question_id", F.explode("defects").alias("defect"))
    templates = refusal_openings(inspected).select("opening", F.lit(True).alias("template"))
    refusing = (
        inspected.where("NOT array_contains(defects, 'empty_answer') AND NOT array_contains(defects, 'copied_question')")
        .join(templates, "opening", "left")
        .where(F.coalesce("template", F.lit(False)) | (F.col("declining") & (F.col("grounding") <= TEMPLATE_GROUNDING)))
    )
    refusals = cut_lineage(refusing.select("question_id").distinct())
    broken = _broken_off(inspected, records).join(refusals, "question_id", "left_anti")
    alone = alone.join(refusals.withColumn("r", F.lit(True)), "question_id", "left").where("r IS NULL OR defect = 'no_citation'").select("question_id", "defect")
    return alone.unionByName(refusals.select("question_id", F.lit("refusal").alias("defect"))).unionByName(broken).distinct()
