"""Problem 4: noise in text from scanned pages.

A page leaves running headers and page numbers between the lines, words hyphenated over line ends,
and misrecognised characters. Headers and page numbers are found by their place (they interrupt
the text), their form and their repetition. A word that the vocabulary lacks is looked up by
intersecting a Levenshtein automaton (with the shape confusions of type as single steps) with the
vocabulary's trie, which gives every candidate within the distance; a candidate is ranked by its
distance, its frequency and its counts with the words beside it. Then page furniture is removed
and the lines are put together into paragraphs again.

The vocabulary and its contexts come from all documents without broken lines. Both stay tables of
any size: a word seen in one such document is known, one seen in ``CANDIDATE_DOCUMENTS`` can be
meant, at every size of the corpus. Pages are read first, which gives the doubtful words with the
words beside them; each different one is resolved once, against shards of the vocabulary of at
most ``SHARD_WORDS`` words, and the answers go back to their pages. Workers hold one shard and one
block of questions at a time, and the ``FREQUENT`` commonest words, which need no asking.

Edge cases: null and empty texts, and texts without broken lines, give no row; a redelivered
document gives its rows once; very long texts are treated whole; an empty table gives an empty
result; extra columns are ignored; line ends of any kind count. Line breaks alone, headings,
lists, tables and codes are kept. A word of a page that stands in no intact document and has no
candidate within the distance stays as it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.session import cut_lineage

KINDS = ("hyphenation", "misread", "header", "page_number")

#: Misread words that make a document's recognition doubtful.
SEVERAL = 2

#: Intact documents that must have a word before it can be meant by another, or a pair of words before it tells anything.
CANDIDATE_DOCUMENTS = 3

#: Commonest words that every worker holds (about 5 MB); all others are looked up in the vocabulary's table.
FREQUENT = 1 << 16

#: Words of one shard of the vocabulary, and questions of one block, that meet in a task.
SHARD_WORDS, BLOCK_WORDS = 1 << 16, 1 << 12

#: Likelihood of a wrong step, and weight of a pair of words against a lone one.
STEP_LIKELIHOOD, PAIR_WEIGHT = 0.01, 50

#: Characters that recognition puts for a letter (fixed values).
FOR_LETTER = str.maketrans({"@": "a", "!": "i", "+": "t", "0": "o", "1": "l", "5": "s", "9": "g", "|": "l", "$": "s", "6": "b", "3": "e", "€": "e"})

#: Shapes that recognition takes for each other (fixed values).
SHAPES = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("li", "h"), ("nn", "m"), ("in", "m")]

_HYPHEN = "-‐‑\u00ad¬"
_WORD = re.compile(r"[^\W_]+(?:[@!+|$€][^\W_]+)*(?:[@+|$€](?![^\W_]))?")
_ODD = re.compile(r"[a-zà-ÿа-я][@!+|$€0-9](?=[a-zà-ÿа-я])|^[@+][a-zà-ÿ]{3}|[a-zà-ÿ]{3}[0159](?=$)|^[0159][a-zà-ÿ]{3}|^[A-ZÀ-Þ][01@!+](?=[a-zà-ÿ]{2})")
_TERMINAL = tuple(".!?。！？:;")
_NUMBER = re.compile(r"(?P<bare>\d{1,4}|[ivxlcdm]{1,8}|[IVXLCDM]{1,8})$")
_FORM = re.compile(
    r"(?:[—–\-=~*·•\[(<]+\s*\d{1,4}\s*[—–\-=~*·•\])>]+"
    r"|(?:page|pag|pg|p|seite|s|página|pagina|página|стр|c|folio|blatt)\b\.?\s*[\dOolI]{1,4}(?:\s*(?:/|of|von|de|sur|из)\s*\d{1,4})?"
    r"|\d{1,4}\s*(?:/|of|von|de|sur|из)\s*\d{1,4}|\d{1,4}\s*\|\s*(?:page|seite))$",
    re.I,
)
_OWN = re.compile(r"\s*(?:#|[-*•·–]\s|\d+[.)]\s|\||```|>|    |\t)")


#: A line end inside a sentence, with up to three lines of furniture in it, in the syntax that Java shares.
_BROKEN = r"[\p{L}\p{N}][,;\-‐\u00ad¬]?[ ]?\n+(?:[^\n]*\n+){0,3}?[a-zà-ÿа-я]"
_broken_line = re.compile(_BROKEN.replace(r"[\p{L}\p{N}]", r"[^\W_]"))

#: Line ends that aren't line feeds.
_LINE_END = "\r\n?|[\x85\u2028\u2029\v]"


def laid_out(text: str) -> bool:
    """Whether a text is laid out in lines: one ends inside a sentence. Line ends are line feeds."""
    return _broken_line.search(text) is not None


#: Largest number of edits of a search, and a cost beyond every search.
MOST_EDITS, FAR = 2, 9

#: Questions searched together.
TOGETHER = 256


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words, a row each, zeros behind."""
    return np.array(words, f"U{max(width, 1)}").view(np.uint32).reshape(len(words), max(width, 1)).astype(np.int64)


class Trie:
    """The trie of a vocabulary's words of one length, level by level: the children of a node lie together."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.depth = len(self.words[0]) if self.words else 0
        if any(len(w) != self.depth for w in self.words):
            raise ValueError("a trie has words of one length")
        codes = _codes(self.words, self.depth)
        new = np.ones(codes.shape, bool)
        new[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
        self.levels: list[tuple[np.ndarray, ...]] = []
        above, parents = np.zeros(len(codes), np.int64), 1
        before = np.zeros(len(codes), np.int64)
        for d in range(self.depth):
            at = np.flatnonzero(new[:, d])
            letters, parent = codes[at, d], above[at]
            first = np.searchsorted(parent, np.arange(parents + 1))
            single = np.full(len(at), -1, np.int64)
            begun = np.full((2, len(at)), -1, np.int64)
            for shape, letter in SHAPES:
                single[(before[at] == ord(shape[0])) & (letters == ord(shape[1]))] = ord(letter)
                begins = letters == ord(shape[0])
                begun[1, begins & (begun[0] >= 0)] = ord(letter)
                begun[0, begins & (begun[0] < 0)] = ord(letter)
            self.levels.append((letters, first, single, begun))
            above, parents, before = np.cumsum(new[:, d]) - 1, len(at), codes[:, d]

    def within(self, questions: list[str], most: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, word, distance) of every word within ``most`` edits of each question.

        Runs the Levenshtein automata of the questions along the trie, all of them at once: a state
        holds, for a node, the fewest edits to each position of the question near the node's depth.
        A state ends when none of its positions can reach both ends within the edits. A shape taken
        for a letter, or the other way round, is one step.
        """
        found = [self._within(questions[i : i + TOGETHER], np.array(most[i : i + TOGETHER])) for i in range(0, len(questions) if self.words else 0, TOGETHER)]
        base = [i * TOGETHER for i in range(len(found))]
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate([f[k] + (b if k == 0 else 0) for f, b in zip(found, base)]) for k in range(3))

    def _within(self, questions: list[str], most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = MOST_EDITS
        size = np.array([len(q) for q in questions])
        width = max(int(size.max()), self.depth) + k + 1
        letters = np.zeros((len(questions), k + width), np.int64)  # position i of a question stands at k + i
        letters[:, k:] = _codes(questions, width)
        merged = np.full(letters.shape, -1, np.int64)  # the letter for which the shape that ends at a position is taken
        for shape, letter in SHAPES:
            merged[:, 1:][(letters[:, :-1] == ord(shape[0])) & (letters[:, 1:] == ord(shape[1]))] = ord(letter)
        offsets = np.arange(-k, k + 1)
        goal = size - self.depth
        start = np.abs(goal) <= np.minimum(most, k)
        question = np.flatnonzero(start)
        node = np.zeros(len(question), np.int64)
        costs = np.tile(np.where(offsets < 0, FAR, offsets), (len(question), 1)).astype(np.int8)
        former = np.full(costs.shape, FAR, np.int8)
        for d, (letter, first, single, begun) in enumerate(self.levels):
            many = first[node + 1] - first[node]
            parent = np.repeat(np.arange(len(node)), many)
            node = first[node][parent] + np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
            question, old, older = question[parent], costs[parent], former[parent]
            near = letters[:, d : d + 2 * k + 1][question]
            own, shape = letter[node][:, None], single[node][:, None]
            new = old + (near != own)
            new[:, :-1] = np.minimum(new[:, :-1], old[:, 1:] + 1)
            new[:, :-1] = np.minimum(new[:, :-1], np.where(near[:, :-1] == shape, older[:, 1:] + 1, FAR))
            new[:, 1:] = np.minimum(new[:, 1:], np.where(merged[:, d : d + 2 * k + 1][question][:, 1:] == own, old[:, :-1] + 1, FAR))
            for o in range(1, 2 * k + 1):
                new[:, o] = np.minimum(new[:, o], new[:, o - 1] + 1)
            new = np.minimum(new, FAR).astype(np.int8)
            left = np.abs(offsets - goal[question][:, None])
            limit = most[question][:, None]
            alive = (new + left <= limit).any(axis=1)
            pending = (near == begun[0, node][:, None]) | (near == begun[1, node][:, None])
            alive |= (pending & (old + 1 <= limit)).any(axis=1)
            question, node, costs, former = question[alive], node[alive], new[alive], old[alive]
        cost = costs[np.arange(len(question)), goal[question] + k]
        fit = cost <= most[question]
        return question[fit], node[fit], cost[fit].astype(np.int64)


#: Marks of a question: only letters taken for others count; the word is capitalised; it recurs in its document; signs stand in it; it is only to be known; a sign ends it.
SLIP, CAPITAL, RECURS, ODD, KNOWN, ENDED = 1, 2, 4, 8, 16, 32

#: A doubtful word: as it stands in lower case, with its marks and the words beside it.
Ask = tuple[str, int, str, str]


def taken_for(word: str, candidate: str) -> bool:
    """Whether two words differ by letters taken for others: one letter (not the first of a short word) or one shape."""
    if len(word) == len(candidate) and len(word) > 3:
        at = [i for i, (a, b) in enumerate(zip(word, candidate)) if a != b]
        if len(at) == 1 and at[0] >= (len(word) < 6):
            return True
    for x, y in (*SHAPES, *((y, x) for x, y in SHAPES)):
        if len(word) - len(x) + len(y) == len(candidate):
            if any(word.startswith(x, i) and word[:i] + y + word[i + len(x) :] == candidate for i in range(len(word))):
                return True
    return False


def _folded(line: str) -> str:
    """A line as recognition would read it at its worst, so that copies of a header look alike."""
    x = re.sub(r"\s+", " ", line).strip().lower().translate(FOR_LETTER)
    for a, b in (*SHAPES[:3], ("c", "e"), ("h", "b"), ("u", "n"), ("i", "l"), ("f", "t"), ("q", "g")):
        x = x.replace(a, b)
    return re.sub(r"\d+", "#", x)


def _similar(a: str, b: str) -> bool:
    """Whether two folded lines of the same length differ in few places."""
    return a == b or (abs(len(a) - len(b)) <= 2 and len(a) > 8 and sum(x != y for x, y in zip(a, b)) <= max(1, len(a) // 10))


def _alike(lines: Iterable[str]) -> dict[str, set[str]]:
    """The similar ones of distinct folded lines by line, itself among them.

    A line differs in at most k places, so of k + 1 segments one is the same at the same place;
    only lines that share a segment are compared.
    """
    by_length: dict[int, list[str]] = {}
    for x in lines:
        by_length.setdefault(len(x), []).append(x)
    near: dict[str, set[str]] = {}
    for length, own in by_length.items():
        if length <= 8:
            near |= {f: {f} for f in own}
            continue
        pieces = max(1, length // 10) + 1
        cuts = [i * (length - 2) // pieces for i in range(pieces + 1)]
        keys = lambda x, cuts=cuts: [(a, x[a:b]) for a, b in zip(cuts, cuts[1:])]
        index: dict[tuple[int, str], list[str]] = {}
        for n in range(length - 2, length + 3):
            for g in by_length.get(n, ()):
                for key in keys(g):
                    index.setdefault(key, []).append(g)
        for f in own:
            near[f] = {g for g in {g for key in keys(f) for g in index[key]} if _similar(f, g)}
    return near


def furniture(lines: list[str], breaks: set[int]) -> dict[int, str]:
    """Kind of page furniture by line number; ``breaks`` are the lines that follow a form feed."""
    texts = [k for k, x in enumerate(lines) if x.strip()]
    widths = sorted(len(lines[k]) for k in texts)
    width = widths[int(0.85 * (len(widths) - 1))] if widths else 0
    place = {k: i for i, k in enumerate(texts)}
    kinds: dict[int, str] = {}
    bare: list[tuple[int, str]] = []
    for k in texts:
        x = lines[k].strip()
        if _FORM.match(x):
            kinds[k] = "page_number"
        elif _NUMBER.match(x):
            bare.append((k, x))

    def beside(k: int, step: int, over: bool = True) -> int | None:
        i = place[k] + step
        while 0 <= i < len(texts):
            if not over or texts[i] not in kinds:
                return texts[i]
            i += step
        return None

    def interrupts(k: int) -> bool:
        p, n = beside(k, -1), beside(k, 1)
        if p is None or n is None:
            return False
        unfinished = not lines[p].rstrip().endswith(_TERMINAL) and not _OWN.match(lines[p])
        goes_on = lines[n].lstrip()[:1].islower()
        return (unfinished and goes_on) or lines[p].rstrip()[-1:] in _HYPHEN

    numbers = {k for k, _ in bare}
    lone = [k for k, _ in bare if beside(k, -1, False) not in numbers and beside(k, 1, False) not in numbers]
    rising = {a for i, a in enumerate(lone) for b in lone[i + 1 : i + 2] if _follows(lines[a], lines[b]) for a in (a, b)}
    for k in lone:
        if 0 < place[k] and (k in rising or interrupts(k) or k in breaks):
            kinds[k] = "page_number"
    folded = {k: _folded(lines[k]) for k in texts if k not in kinds and 3 < len(lines[k].strip()) and not _OWN.match(lines[k])}
    counts = Counter(folded.values())

    def titled(k: int) -> bool:
        """Whether a line is set like a title: its longer words begin with capitals."""
        longer = [w for w in re.findall(r"[^\W\d_][^\W_]*", lines[k]) if len(w) > 3]
        return lines[k].strip()[:1].isupper() and all(w[0].isupper() for w in longer)

    def fills(k: int) -> bool:
        n = beside(k, 1)
        first = lines[n].split()[0] if n is not None and lines[n].split() else ""
        return len(lines[k].strip()) + 1 + len(first) > width

    def at_page(k: int) -> bool:
        around = {beside(k, -1, False), beside(k, 1, False)}
        return k in breaks or any(a is not None and kinds.get(a) == "page_number" for a in around)

    near = _alike(counts)
    alike = {f: sum(counts[g] for g in near[f]) for f in counts}
    for k, f in folded.items():
        x = lines[k].strip()
        if x.endswith((".", ",", ";", "!", "?")) or place[k] == 0 or len(x) <= 5:
            continue
        often = alike[f] > 1 if titled(k) else alike[f] > 2 and at_page(k)
        if often and (interrupts(k) or at_page(k)):
            kinds[k] = "header"
    headers = {folded[k] for k, v in kinds.items() if v == "header"}
    for k, f in folded.items():
        x = lines[k].strip()
        if k in kinds or not titled(k) or x.endswith((".", ",", ";", "!", "?")) or place[k] == 0:
            continue
        if near[f] & headers and alike[f] > 1:
            kinds[k] = "header"
        elif not fills(k) and (interrupts(k) or (at_page(k) and len(x.split()) > 1)) and len(x.split()) > 1:
            kinds[k] = "header"
    return kinds


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _value(x: str) -> int:
    x = x.strip().lower()
    if x.isdigit():
        return int(x)
    digits = [_ROMAN.get(c, 0) for c in x]
    return sum(-d if i + 1 < len(digits) and d < digits[i + 1] else d for i, d in enumerate(digits))


def _follows(a: str, b: str) -> bool:
    return a.strip().isdigit() == b.strip().isdigit() and 1 <= _value(b) - _value(a) <= 2


def page_lines(text: str | None) -> tuple[list[str | None], set[str]] | None:
    """The lines of a scanned page, furniture as none, and the kinds of furniture; none where the text is no page."""
    raw = re.sub(_LINE_END, "\n", text) if text else ""
    if not laid_out(raw):
        return None
    lines: list[str] = []
    breaks: set[int] = set()
    for i, piece in enumerate(raw.split("\f")):
        own = piece.split("\n")
        if i:
            first = next((k for k, x in enumerate(own) if x.strip()), None)
            if first is not None:
                breaks.add(len(lines) + first)
        lines += own
    kinds = furniture(lines, breaks)
    return [None if k in kinds else x for k, x in enumerate(lines)], set(kinds.values())


def _reflow(lines: list[str | None], joins: Callable[[str, str], bool]) -> tuple[list[str], int]:
    """The lines as paragraphs, furniture (none) left out, and the number of words put together.

    ``joins`` tells whether the halves of a word divided by a plain hyphen belong together.
    """
    paragraphs: list[str] = []
    parts: list[str] = []  # of the paragraph that is being put together
    first = tail = ""  # what its last line began with, and the last line of the page in it
    hyphenated, blank, gap, fenced = 0, True, False, False

    def begin(x: str) -> None:
        nonlocal parts
        if parts:
            paragraphs.append("".join(parts))
        parts = [x]

    for line in lines:
        if line is None:
            gap = True
            continue
        x = line.strip()
        if not x:
            blank = True
            continue
        if x.startswith("```"):
            fenced = not fenced
        goes_on = bool(parts) and x[:1].islower() and not tail.endswith(_TERMINAL)
        if parts and tail[-1] in _HYPHEN and x[:1].isalpha() and tail[-2:-1].isalpha():
            head = re.search(r"[^\W\d_]+$", tail[:-1])[0]
            rest = re.match(r"[^\W\d_]+", x)[0]
            if tail[-1] != "-" or (x[:1].islower() and joins(head, rest)):
                parts[-1] = parts[-1][:-1]
                parts.append(x)
                tail = x
                hyphenated += 1
                blank = gap = False
                continue
        if fenced or _OWN.match(line) or x.startswith("```"):
            begin(x) if blank or not parts else parts.extend(("\n", x))
            first = x
        elif not parts or (blank and not (goes_on and gap)):
            begin(x)
            first = x
        elif _OWN.match(first) and not goes_on:
            parts += ["\n", x]
            first = x
        else:
            parts += [" ", x]
        tail = x
        blank = gap = False
    begin("")
    return paragraphs, hyphenated


def _doubts(paragraphs: list[str], frequent: set[str]) -> Iterator[tuple[int, re.Match, Ask]]:
    """Paragraph number, place and question of each word that may be misread."""
    capitals: Counter | None = None
    for number, paragraph in enumerate(paragraphs):
        if re.match(r"\s*(?:```|\|)", paragraph):
            continue
        words = list(_WORD.finditer(paragraph))
        for i, m in enumerate(words):
            word = m[0]
            low = word.lower()
            plain = word.isalpha()
            if len(word) < 3 or (plain and low in frequent):
                continue
            if sum(c.isalpha() for c in word) * 4 < len(word) * 3 or word[1:] != low[1:]:
                continue
            ended = not word[-1].isalnum()
            odd = not plain and not ended and bool(_ODD.search(word)) and sum(not c.isalpha() for c in word) <= 2
            if not odd and not plain and not ended:
                continue
            capital = word[0].isupper()
            marks = CAPITAL * capital + ODD * odd + ENDED * ended
            if plain and (capital or (i + 1 == len(words) and not paragraph[m.end() :].strip().startswith(_TERMINAL))):
                marks += SLIP
            if capitals is None:
                capitals = Counter(x[0] for p in paragraphs for x in _WORD.finditer(p))
            marks += RECURS * (capitals[word] > 1)
            before = words[i - 1][0].lower() if i else ""
            after = words[i + 1][0].lower() if i + 1 < len(words) else ""
            yield number, m, (low, marks, before, after)


def asked(lines: list[str | None], frequent: set[str]) -> set[Ask]:
    """Every question that :func:`clean` may put, whichever divided words turn out to be one."""
    halves: set[str] = set()

    def together(head: str, rest: str) -> bool:
        halves.update(w.lower() for w in (head + rest, head, rest))
        return True

    joined, hyphenated = _reflow(lines, together)
    asks = {ask for _, _, ask in _doubts(joined, frequent)}
    if hyphenated:
        asks |= {ask for _, _, ask in _doubts(_reflow(lines, lambda head, rest: False)[0], frequent)}
    return asks | {(w, KNOWN, "", "") for w in halves if w not in frequent}


def clean(lines: list[str | None], kinds: set[str], answers: dict[Ask, str], frequent: set[str]) -> tuple[list[str], str | None]:
    """The kinds of noise of a page, and its text repaired; none where it has no noise."""
    found = set(kinds)
    known = lambda w: w.lower() in frequent or (w.lower(), KNOWN, "", "") in answers
    paragraphs, hyphenated = _reflow(lines, lambda head, rest: known(head + rest) or not (known(head) and known(rest)))
    if hyphenated:
        found.add("hyphenation")
    out: list[list[str]] = [[] for _ in paragraphs]
    at = [0] * len(paragraphs)
    misread = 0
    for number, m, ask in _doubts(paragraphs, frequent):
        meant = answers.get(ask)
        if meant is None:
            if not ask[1] & ODD:
                continue
            meant = m[0].translate(FOR_LETTER)
        elif ask[1] & CAPITAL:
            meant = meant[0].upper() + meant[1:]
        out[number] += [paragraphs[number][at[number] : m.start()], meant]
        at[number] = m.end()
        misread += 1
    if misread >= SEVERAL:
        found.add("misread")
    if not found:
        return [], None
    repaired = ["".join(o) + p[a:] for o, p, a in zip(out, paragraphs, at)]
    return [k for k in KINDS if k in found], "\n\n".join(repaired)


#: A word, a compound with hyphens, or a code, address or formula as a whole; and what tells these from words.
_INTACT_TOKEN, _NO_WORD = r"[\p{L}\p{N}_/+=@]+(?:-[\p{L}\p{N}_/+=@]+)*+", r"[\p{N}_/+=@]"


def vocabulary(documents: DataFrame) -> DataFrame:
    """(key, n): document counts of the words, of the capitalised ones as such, and of the pairs of lower-case words, of the texts without broken lines.

    Words keep their row at any count; capitalised forms and pairs from ``CANDIDATE_DOCUMENTS`` on.
    """
    feeds = F.regexp_replace("text", _LINE_END, "\n")
    intact = documents.where(F.col("text").isNotNull() & ~feeds.rlike(_BROKEN))
    whole = F.filter(F.regexp_extract_all("text", F.lit(_INTACT_TOKEN), 0), lambda t: ~t.rlike(_NO_WORD))
    tokens = intact.select(F.split(F.array_join(whole, " "), "[ -]").alias("w"))
    pairs = F.expr("zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> concat(a, ' ', b))")
    words = F.transform("w", lambda x: F.lower(x))
    keys = tokens.select(F.explode(F.array_distinct(F.concat(words, pairs, "w"))).alias("key")).where(F.col("key").rlike(r"^(?:\p{Ll}+(?: \p{Ll}+)?|\p{Lu}\p{Ll}+)$"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= CANDIDATE_DOCUMENTS) | F.col("key").rlike(r"^\p{Ll}+$"))


QUESTIONS = "word string, marks int, before string, after string"
READ = f"document_id string, kinds array<string>, lines array<string>, asks array<struct<{QUESTIONS.replace(' ', ': ').replace(',:', ',')}>>"
FOUND = "plain string, meant string, distance int, taken boolean"


def read(documents: DataFrame, frequent: set[str]) -> DataFrame:
    """READ of every scanned page: its lines, its furniture, and its questions."""
    sent = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for document, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (page := page_lines(text)) is None:
                    continue
                asks = [dict(zip(("word", "marks", "before", "after"), a)) for a in sorted(asked(page[0], sent.value))]
                for column, value in zip(out, (document, sorted(page[1]), page[0], asks)):
                    column.append(value)
            ask = pa.struct([("word", pa.string()), ("marks", pa.int32()), ("before", pa.string()), ("after", pa.string())])
            types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(ask)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["document_id", "kinds", "lines", "asks"])

    broken = documents.select("document_id", "text").where(F.col("text").rlike("[\n\r\x85\u2028\u2029\v]"))
    return broken.mapInArrow(run, READ)


def _search(questions: pa.Table, words: pa.Table) -> pa.Table:
    """FOUND of one block of questions in one shard of the vocabulary: its trie, run by the questions' automata."""
    trie = Trie(words.column("meant").to_pylist())
    plain = questions.column("plain").to_pylist()
    at, word, distance = trie.within(plain, questions.column("most").to_pylist())
    asked, meant = [plain[i] for i in at], [trie.words[i] for i in word]
    columns = [asked, meant, distance, [d == 1 and taken_for(a, m) for a, m, d in zip(asked, meant, distance)]]
    types = [pa.string(), pa.string(), pa.int32(), pa.bool_()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["plain", "meant", "distance", "taken"])


def candidates(plain: DataFrame, words: DataFrame) -> DataFrame:
    """FOUND: all words within ``most`` edits of each ``plain``; ``words`` has the words that can be meant, as ``meant``.

    Words meet by length, which an edit or a shape changes by one at most; the words of a length
    are cut into shards and the questions into blocks, and every block meets every shard.
    """
    questions = plain.select("plain", "most", F.explode(F.sequence(F.length("plain") - F.col("most"), F.length("plain") + F.col("most"))).alias("length"))
    targets = words.select("meant", F.length("meant").alias("length"))
    pieces = lambda size, name: F.ceil(F.count("*") / size).cast("int").alias(name)
    sizes = questions.groupBy("length").agg(pieces(BLOCK_WORDS, "blocks")).join(targets.groupBy("length").agg(pieces(SHARD_WORDS, "shards")), "length")
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = questions.join(sizes, "length").withColumn("block", part("plain", "blocks")).select("plain", "most", "length", "block", every("shards").alias("shard"))
    own = targets.join(sizes, "length").withColumn("shard", part("meant", "shards")).select("meant", "length", "shard", every("blocks").alias("block"))
    keys = ("length", "shard", "block")
    return asks.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(_search, FOUND)


@F.pandas_udf(T.StringType())
def folded(words: pd.Series) -> pd.Series:
    """:func:`_folded` as a column."""
    return words.map(_folded)


@F.pandas_udf(T.StringType())
def plainly(words: pd.Series) -> pd.Series:
    """Words with letters for the signs put for them."""
    return words.map(lambda w: w.translate(FOR_LETTER))


def resolve(asks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, marks, before, after, meant) of the questions that have an answer."""
    has = lambda bit: F.col("marks").bitwiseAND(bit) > 0
    words = vocabulary.where(~F.col("key").contains(" ") & (F.lower("key") == F.col("key"))).select(F.col("key").alias("meant"), "n")
    capitals = vocabulary.where(~F.col("key").contains(" ") & (F.lower("key") != F.col("key"))).select(F.lower("key").alias("meant"), F.lit(True).alias("capital"))
    meant = words.where((F.col("n") >= CANDIDATE_DOCUMENTS) & (F.length("meant") > 1)).join(capitals, "meant", "left")
    pairs = vocabulary.where(F.col("key").contains(" ")).withColumnRenamed("n", "p")
    seen = asks.join(words.select(F.col("meant").alias("word"), F.col("n").alias("known")), "word", "left")
    known = seen.where(has(KNOWN) & F.col("known").isNotNull()).select("word", "marks", "before", "after", F.col("word").alias("meant"))
    open_ = cut_lineage(seen.where(~has(KNOWN) & (has(ODD) | F.col("known").isNull())).select("word", "marks", "before", "after", plainly("word").alias("plain")))
    by_sign = open_.where("plain <> word").join(meant.select(F.col("meant").alias("plain"), F.lit(0).alias("level")), "plain")
    rest = open_.where(~has(ENDED)).join(by_sign.select("word").distinct(), "word", "left_anti")
    most = F.when((F.length("plain") > 5) & ~has(SLIP), MOST_EDITS).otherwise(1)
    plain = cut_lineage(rest.groupBy("plain").agg(F.max(most).alias("most")))
    near = candidates(plain, meant)
    shape = plain.select("plain", folded("plain").alias("f")).join(meant.select("meant", folded("meant").alias("f")), "f").where("plain <> meant").select("plain", "meant", F.lit(True).alias("alike"))
    found = near.join(shape, ["plain", "meant"], "full").join(meant, "meant").withColumn("alike", F.coalesce("alike", F.lit(False)))
    slip_level = F.when(F.col("taken"), 1).when(F.col("alike"), 2)
    level = F.when(has(SLIP), F.when(F.coalesce("capital", F.lit(False)) | ~has(CAPITAL), slip_level)).otherwise(F.col("distance"))
    level = F.when(has(RECURS) & has(SLIP) & ~F.col("alike"), None).otherwise(level)
    options = rest.join(found, "plain").withColumn("level", level).where("level IS NOT NULL")
    beside = lambda a, b, name: (F.concat(F.col(a), F.lit(" "), F.col(b)).alias(name))
    options = options.select("word", "marks", "before", "after", "meant", "n", "level", beside("before", "meant", "first"), beside("meant", "after", "second"))
    for key in ("first", "second"):
        options = options.join(pairs.select(F.col("key").alias(key), F.col("p").alias(f"{key}_n")), key, "left")
    context = F.coalesce("first_n", F.lit(0)) + F.coalesce("second_n", F.lit(0))
    score = (1 + F.col("n") + PAIR_WEIGHT * context) * F.pow(F.lit(STEP_LIKELIHOOD), F.col("level"))
    best = options.groupBy("word", "marks", "before", "after").agg(F.max(F.struct(score.alias("s"), "meant")).alias("b"))
    chosen = best.select("word", "marks", "before", "after", "b.meant")
    return chosen.unionByName(by_sign.select("word", "marks", "before", "after", F.col("plain").alias("meant"))).unionByName(known)


SCHEMA = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("noise", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])


def repaired(documents: DataFrame) -> DataFrame:
    """Scanned documents with the kinds of noise found and their text repaired; ``documents`` has document_id and text."""
    spark = documents.sparkSession
    known = cut_lineage(vocabulary(documents))
    common = known.where(F.col("key").rlike(r"^\p{Ll}+$")).orderBy(F.desc("n"), "key").limit(FREQUENT)
    frequent = set(common.select("key").toArrow().column("key").to_pylist())
    pages = cut_lineage(read(documents, frequent))
    own = pages.select("document_id", F.explode("asks").alias("a")).select("document_id", "a.*")
    asks = cut_lineage(own.select("word", "marks", "before", "after").distinct())
    answers = own.join(resolve(asks, known), ["word", "marks", "before", "after"])
    by_page = answers.groupBy("document_id").agg(F.collect_set(F.struct("word", "marks", "before", "after", "meant")).alias("answers"))
    sent = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for document, kinds, lines, found in zip(*(c.to_pylist() for c in batch.columns)):
                told = {(a["word"], a["marks"], a["before"], a["after"]): a["meant"] for a in found or ()}
                noise, fixed = clean(lines, set(kinds), told, sent.value)
                if noise:
                    for column, value in zip(out, (document, noise, fixed)):
                        column.append(value)
            types = [pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], SCHEMA.names)

    return pages.join(by_page, "document_id", "left").select("document_id", "kinds", "lines", "answers").mapInArrow(run, SCHEMA)


def kinds_found(fixed: DataFrame) -> DataFrame:
    """One row for each kind of noise of each document."""
    return fixed.select("document_id", F.explode("noise").alias("noise")).distinct()
