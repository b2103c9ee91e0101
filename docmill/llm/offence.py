"""Problem 8: abusive, hateful or sexual content.

Every document is scored by its worst statement. A statement is a bag of subwords: its words, their
character n-grams and its word pairs, hashed to buckets whose embeddings are averaged into a
linear softmax; embeddings and softmax are trained together in numpy, so that a misspelling shares
the vectors of the n-grams it kept. Labels are given for documents, by annotators who err, so the
training repeats: positive documents teach by the statements that the model of the other half of
the documents finds worst, and documents whose label nothing in them bears out are left out.

Training takes at most ``MAX_LABELLED`` labelled documents (in the order of a hash of their id);
everything else covers all documents.

Edge cases: null and empty texts score 0; a tie between annotators, or only null verdicts, gives no
label; without labels of both kinds every score is 0; texts of any length are scored whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that take part in the training, at most.
MAX_LABELLED = 2000

#: Hash buckets, dimensions of their embeddings, and lengths of the character n-grams.
BITS, DIMENSIONS, NGRAMS = 18, 4, (3, 4)
BUCKETS = 1 << BITS

#: Rounds of cross-training, steps of each training, and the step size.
ROUNDS, STEPS, RATE = 2, 30, 0.06

#: Features that every statement is taken to have besides its own, which add nothing: a lone word decides little.
SHRINK = 60

#: Words of a statement at most; a longer one is scored in parts.
STATEMENT_WORDS = 40

#: Score from which a document is named.
THRESHOLD = 0.9

#: Letters of other alphabets that look like Latin ones (fixed values).
LOOKALIKE = str.maketrans("аеорсхуікмтвнԁѕјһӏԛԝ", "aeopcxyikmtbhdsjhlqw")

#: Signs written for letters (fixed values).
FOR_LETTER = str.maketrans({"@": "a", "!": "i", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "€": "e"})

_U64 = np.uint64
_STATEMENT = re.compile(r"[.!?][\"'”’»)」]*\s+|。[」』]?|[\r\n\u0085\u2028\u2029\f]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:[@!$*#'’]+[^\W_]+)*[*#]*|[@#*$]+[^\W_]+(?:[@!$*#]+[^\W_]*)*")
_SIGN = re.compile(r"[a-z][@!$*#0-9][a-z@$*#0-9]|[@#*$0-9][a-z]|[a-z][*#]")
_HIDDEN = re.compile("[\u00ad\u034f\u061cᅟᅠ\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff\u0300-\u036f]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_·]{1,2}){2,}[^\W\d_](?![^\W_])")
_LONG = re.compile(r"([a-zа-я])\1\1+")
_WIDE = re.compile("[\u3040-ヿ㐀-鿿]")
_MIXED = re.compile(r"(?=\S*[a-z])(?=\S*[а-џԁ-ԝ])\S+")
_CYRILLIC = re.compile("[а-џԁ-ԝ]")


def plain(text: str) -> str:
    """Text in lower case with disguises undone: hidden characters, look-alikes, spaced and repeated letters."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text)).lower()
        if _CYRILLIC.search(text):
            text = _MIXED.sub(lambda m: m[0].translate(LOOKALIKE), text)
    else:
        text = text.lower()
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m[0]), text)
    return _LONG.sub(r"\1", text)


def tokens(statement: str, signs: bool = True) -> list[str]:
    """Words of a plain statement; of scripts without blanks, each two neighbouring characters.

    Without ``signs`` the statement is known to have no signs within words.
    """
    if not signs or not _SIGN.search(statement):
        found = _WORD.findall(statement)
        if statement.isascii():
            return found
    else:
        found = []
        for w in _TOKEN.findall(statement):
            sound = w.isalpha() or w.isdigit() or not _SIGN.search(w)
            found.append(w if sound else re.sub(r"[#*]+", "*", w.translate(FOR_LETTER)))
    if not _WIDE.search(statement):
        return found
    return [x for w in found for x in ([w[i : i + 2] for i in range(max(1, len(w) - 1))] if _WIDE.search(w) else [w])]


def statements(text: str | None) -> list[str]:
    """The sentences and lines of a text, plain."""
    return [s for s in _STATEMENT.split(plain(text)) if s and not s.isspace()] if text else []


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each word, one word's after another's, and how many each has: the word and its character n-grams. Numbers are all alike.

    All words are hashed at once: an n-gram by a polynomial of its code points, a word by one of its own.
    """
    marked = [f"<{'0' if w.isdigit() else w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(sizes)
    starts, owner = ends - sizes, np.repeat(np.arange(len(words)), sizes)
    place = (np.arange(len(codes)) - starts[owner]).astype(np.uint64)
    whole = np.add.reduceat(codes * (place * place * _U64(0x9E3779B97F4A7C15) + place * _U64(0xC2B2AE3D27D4EB4F) + _U64(0xD6E8FEB86659FD93)), starts) if len(words) else np.empty(0, np.uint64)
    hashes, of = [whole * _U64(0xFF51AFD7ED558CCD)], [np.arange(len(words))]
    for n in NGRAMS:
        first = np.flatnonzero(np.arange(len(codes)) + n <= ends[owner]) if len(codes) else np.empty(0, np.int64)
        h = np.full(len(first), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[first + k]) * _U64(0xBF58476D1CE4E5B9)
            h ^= h >> _U64(29)
        hashes.append(h * _U64(0x94D049BB133111EB))
        of.append(owner[first])
    word = np.concatenate(of)
    order = np.argsort(word, kind="stable")
    buckets = (np.concatenate(hashes) >> _U64(64 - BITS)).astype(np.int64)
    return buckets[order], np.bincount(word, minlength=len(words))


def pair_bucket(a: str, b: str) -> int:
    """Bucket of two neighbouring words."""
    return zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass"), 2) % BUCKETS


def word_pairs(words: list[str]) -> list[tuple[str, str]]:
    """Neighbouring words, without numbers."""
    return [p for p in zip(words, words[1:]) if not (p[0].isdigit() or p[1].isdigit())]


def parts(words: list[str]) -> list[list[str]]:
    """A statement's words in runs of bounded length."""
    return [words[i : i + STATEMENT_WORDS] for i in range(0, len(words), STATEMENT_WORDS)]


class _Sparse:
    """A sparse matrix of counts with products from either side; dense factors have their rows last."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        order = np.argsort(rows, kind="stable")
        self.by_row = (columns[order], *self._starts(rows[order]))
        order = np.argsort(columns, kind="stable")
        self.by_column = (rows[order], *self._starts(columns[order]))

    @staticmethod
    def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return starts, keys[starts] if len(keys) else keys

    @staticmethod
    def _product(index: tuple, dense: np.ndarray, size: int) -> np.ndarray:
        other, starts, keys = index
        out = np.zeros((len(dense), size), np.float32)
        if len(other):
            for row, values in zip(out, dense):
                row[keys] = np.add.reduceat(values[other], starts)
        return out

    def times(self, dense: np.ndarray) -> np.ndarray:
        return self._product(self.by_row, dense, self.shape[0])

    def transposed_times(self, dense: np.ndarray) -> np.ndarray:
        return self._product(self.by_column, dense, self.shape[1])


class Bags:
    """Statements of the labelled documents as bags: statement to unit (word or pair), unit to bucket."""

    def __init__(self, texts: list[str]):
        units: dict = {}
        rows, columns, document = [], [], []
        for d, text in enumerate(texts):
            for statement in statements(text):
                for words in parts(tokens(statement)):
                    s = len(document)
                    document.append(d)
                    for unit in (*words, *word_pairs(words)):
                        rows.append(s)
                        columns.append(units.setdefault(unit, len(units)))
        as_int = lambda x: np.array(x, np.int64)
        self.pairs = [u for u in units if isinstance(u, tuple)]
        lone = [u for u in units if not isinstance(u, tuple)]
        found, many = word_buckets(lone)
        unit_rows = np.concatenate([np.repeat(as_int([units[w] for w in lone]), many), as_int([units[p] for p in self.pairs])])
        self.bucket, unit_columns = np.unique(np.concatenate([found, as_int([pair_bucket(*p) for p in self.pairs])]), return_inverse=True)
        self.document = as_int(document)
        self.statements = _Sparse(as_int(rows), as_int(columns), (len(document), len(units)))
        self.units = _Sparse(unit_rows, unit_columns, (len(units), len(self.bucket)))
        per_unit = np.bincount(unit_rows, minlength=len(units)).astype(np.float32)[None]
        self.size = self.statements.times(per_unit)[0] + SHRINK


class SubwordSoftmax:
    """Embeddings of subword buckets, averaged into a softmax over two classes."""

    def __init__(self, buckets: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embeddings = rng.normal(0, 0.1, (DIMENSIONS, buckets)).astype(np.float32)
        self.weights = rng.normal(0, 0.7, (2, DIMENSIONS)).astype(np.float32)
        self.bias = np.zeros((2, 1), np.float32)
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.embeddings, self.weights, self.bias)]
        self.step = 0

    def logits(self, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        mean = bags.statements.times(bags.units.times(self.embeddings)) / bags.size
        return 10 * self.weights @ mean + self.bias, mean

    def probability(self, bags: Bags) -> np.ndarray:
        logits, _ = self.logits(bags)
        return 1 / (1 + np.exp(np.clip(logits[0] - logits[1], -30, 30)))

    def train(self, bags: Bags, label: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> SubwordSoftmax:
        weight = (weight / weight.sum()).astype(np.float32)
        for _ in range(steps):
            logits, mean = self.logits(bags)
            p = np.exp(logits - logits.max(axis=0))
            p /= p.sum(axis=0)
            p[label, np.arange(len(label))] -= 1
            p = (p * weight).astype(np.float32)
            back = bags.units.transposed_times(bags.statements.transposed_times(10 * self.weights.T @ p / bags.size))
            self._update([back, 10 * p @ mean.T, p.sum(axis=1, keepdims=True)])
        return self

    def _update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, (m, v) in zip((self.embeddings, self.weights, self.bias), gradients, self.moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)

    def learned(self, bags: Bags) -> Learned:
        """What scoring needs: the logit each bucket adds (none if never trained), that of each trained pair, the bias."""
        scores = np.zeros(BUCKETS, np.float32)
        scores[bags.bucket] = 10 * (self.weights[1] - self.weights[0]) @ self.embeddings
        pairs = {p: float(scores[pair_bucket(*p)]) for p in bags.pairs}
        return scores, pairs, float(self.bias[1, 0] - self.bias[0, 0])


Learned = tuple[np.ndarray, dict[tuple[str, str], float], float]
NOTHING: Learned = (np.zeros(BUCKETS, np.float32), {}, -20.0)


def fit(texts: list[str], verdicts: list[int]) -> Learned:
    """What documents and their noisy labels teach."""
    verdict = np.array(verdicts)
    bags = Bags(texts)
    if not (verdict == 1).any() or not (verdict == 0).any() or not len(bags.document):
        return NOTHING
    positive = verdict[bags.document] == 1
    score = _first_guess(bags, positive)
    fold = bags.document % 2
    for _ in range(ROUNDS):
        label, weight = _targets(bags, positive, score)
        across = np.zeros(len(score))
        for half in (0, 1):
            model = SubwordSoftmax(len(bags.bucket)).train(bags, label, np.where(fold == half, weight, 0) + 1e-9)
            across[fold != half] = model.probability(bags)[fold != half]
        score = across
    label, weight = _targets(bags, positive, score)
    model = SubwordSoftmax(len(bags.bucket)).train(bags, label, weight)
    return model.learned(bags)


def _targets(bags: Bags, positive: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and weight of each statement, given how offensive it looks to a model that hasn't seen it."""
    worst = np.zeros(bags.document.max() + 1)
    np.maximum.at(worst, bags.document, score)
    top = score >= worst[bags.document]
    label = positive & ((score > 0.5) | (top & (score > 0.15)))
    unsure = (positive & top & ~label) | (~positive & (score > 0.8)) | (positive & ~label & (score > 0.3))
    weight = np.where(unsure, 0.0, 1.0)
    share = max(weight[label].sum(), 1e-9) / max(weight[~label].sum(), 1e-9)
    return label.astype(np.int64), np.where(label, weight / max(np.sqrt(share), 1e-3), weight)


def _first_guess(bags: Bags, positive: np.ndarray) -> np.ndarray:
    """How much more often a statement's units occur in the other positive documents than in the negative ones."""
    units, starts, rows = bags.statements.by_row
    size = np.diff(np.concatenate([starts, [len(units)]]))
    statement = np.repeat(rows, size)
    pairs = np.unique(np.stack([units, bags.document[statement]]), axis=1)
    is_positive = np.zeros(bags.document.max() + 1, bool)
    is_positive[bags.document[positive]] = True
    yes = np.bincount(pairs[0], is_positive[pairs[1]], minlength=bags.statements.shape[1])
    no = np.bincount(pairs[0], ~is_positive[pairs[1]], minlength=bags.statements.shape[1])
    own = positive[statement]
    prior = np.log((is_positive.sum() + 1) / ((~is_positive).sum() + 1))
    odds = np.log((yes[units] - own + 0.5) / (no[units] - ~own + 0.5)) - prior
    odds = np.where(yes[units] + no[units] > 2, np.maximum(odds, 0), 0)
    out = np.zeros(len(bags.document))
    np.add.at(out, statement, odds)
    many = np.bincount(statement, minlength=len(out))
    return 1 / (1 + np.exp(-(4 * out / np.maximum(many, 1) - 3)))


class Scorer:
    """One worker's scorer, with what it has already looked up; the texts of a batch are scored together."""

    def __init__(self, scores: np.ndarray, pairs: dict[tuple[str, str], float], bias: float):
        self.scores, self.bias = scores.astype(np.float64), bias
        self.learned = list(dict.fromkeys(w for p in pairs for w in p))
        self.known: dict[str, float] = {}
        self._begin()
        number = self.number
        keys = np.array([number[a] << 32 | number[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_values = keys[order], np.array(list(pairs.values()), np.float64)[order]

    def _begin(self) -> None:
        """Forget all words but those of the learned pairs."""
        self.number: dict[str, int] = {}
        self.value, self.size = np.empty(0), np.empty(0)
        self._learn(self.learned)

    def _learn(self, words: list[str]) -> None:
        """Number words, with what each adds and its number of features with that of its pair."""
        if not words:
            return
        buckets, many = word_buckets(words)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.value = np.concatenate([self.value, np.add.reduceat(self.scores[buckets], np.cumsum(many) - many)])
        self.size = np.concatenate([self.size, many + 1.0])

    def _logits(self, statements_: list[str], signs: list[bool]) -> list[float]:
        """The worst logit of each statement's parts."""
        flat: list[str] = []
        starts, owner = [], []
        for k, (statement, own) in enumerate(zip(statements_, signs)):
            for words in parts(tokens(statement, own)):
                starts.append(len(flat))
                owner.append(k)
                flat += words
        out = np.full(len(statements_), -30.0)
        if not flat:
            return out.tolist()
        number = self.number
        self._learn([w for w in dict.fromkeys(flat) if w not in number])
        ids = np.array([*map(number.__getitem__, flat)], np.int64)
        begin = np.array(starts)
        total = np.add.reduceat(self.value[ids], begin)
        if len(self.pair_keys):
            same = np.ones(len(ids) - 1, bool)
            same[begin[1:] - 1] = False
            at = np.flatnonzero(same & (ids[:-1] < len(self.learned)) & (ids[1:] < len(self.learned)))
            keys = ids[at] << 32 | ids[at + 1]
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            hit = self.pair_keys[place] == keys
            np.add.at(total, np.searchsorted(begin, at[hit], "right") - 1, self.pair_values[place[hit]])
        np.maximum.at(out, np.array(owner), total / (np.add.reduceat(self.size[ids], begin) + SHRINK) + self.bias)
        return out.tolist()

    def batch(self, texts: list[str | None]) -> list[tuple[float, str | None]]:
        """Probability of each text's worst statement, and that statement."""
        if len(self.number) > 500_000 + len(self.learned):
            self._begin()
        if len(self.known) > 300_000:
            self.known.clear()
        known, cut, fresh = self.known, [], {}
        for text in texts:
            whole = plain(text) if text else ""
            own = [s for s in _STATEMENT.split(whole) if s and not s.isspace()]
            cut.append(own)
            new = [s for s in own if s not in known]
            if new:
                fresh.update(dict.fromkeys(new, _SIGN.search(whole) is not None))
        known.update(zip(fresh, self._logits(list(fresh), list(fresh.values()))))
        out = []
        for own in cut:
            worst = max(own, key=known.__getitem__, default=None)
            out.append((0.0, None) if worst is None else (1 / (1 + math.exp(-known[worst])), worst))
        return out

    def score(self, text: str | None) -> tuple[float, str | None]:
        """:meth:`batch` of one text."""
        return self.batch([text])[0]


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, verdict) of documents on which most annotators agree, the bounded training sample."""
    verdict = labels.where("abusive IS NOT NULL").groupBy("doc_id").agg(F.avg("abusive").alias("share")).where("share <> 0.5")
    sample = verdict.select("doc_id", F.round("share").cast("int").alias("verdict")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(sample, "doc_id")


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("statement", T.StringType())])


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its source, its score and its worst statement."""
    rows = sorted(((r.doc_id, r.text, r.verdict) for r in labelled(documents, labels).collect()), key=lambda r: r[0])
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        gc.disable()  # nothing here forms cycles, and the collector would walk the scorer's memory again and again
        try:
            for batch in batches:
                found = scorer.batch(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array([s for s, _ in found], pa.float64()), pa.array([w if s > THRESHOLD else None for s, w in found], pa.string())], SCHEMA.names
                )
        finally:
            gc.enable()

    return documents.select("doc_id", "source", "text").mapInArrow(run, SCHEMA)


def named(scores: DataFrame) -> DataFrame:
    """The offending documents."""
    return scores.where(F.col("score") > THRESHOLD).select("doc_id").distinct()


def once(scores: DataFrame) -> DataFrame:
    """The scores with one row per document; rows of a redelivered document are equal."""
    return scores.dropDuplicates(["doc_id"])


def rates(scores: DataFrame) -> DataFrame:
    """Number and share of offending documents per source."""
    bad = F.count_if(F.col("score") > THRESHOLD)
    per = once(scores.select("doc_id", "source", "score")).groupBy("source")
    return per.agg(F.count("*").alias("documents"), bad.alias("offending"), (bad / F.count("*")).alias("share"))
