"""Problem 1: text cut off by field limits.

Per field and source, histograms of the lengths in characters and in bytes are tested for spikes;
a value at a spike's length without terminal punctuation is flagged. A limit isn't the only way
to lose an end (transfers break anywhere, some writers add a mark), so the end itself is examined
too: a response by whether its JSON list closes, other text by its last sentence, list item or
remark. Where an end has no full stop, counts over all the texts tell whether its last words are
ones that sentences end with, and whether its last letters are ones that names end with.

Edge cases: null, empty, blank and placeholder values are no cases; a redelivered row counts once;
a null source is a source of its own; texts are read whole; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docmill.session import cut_lineage

#: A length is a spike if it has at least so many values and so many standard deviations more than its surroundings lead to expect.
SPIKE_LEAST, SPIKE_DEVIATIONS, SPIKE_REACH = 5, 6.0, 25

#: A context decides when it occurred so often; a sentence ends there when it did so in this share of cases.
CONTEXT_LEAST, END_SHARE = 3, 0.5

#: Values that stand for a missing text (fixed values).
PLACEHOLDERS = {"no summary available", "n/a", "na", "none", "null", "nan", "tbd", "-", "--", "...", "…", "?", "[]", "{}", '""'}

_DECODER = json.JSONDecoder(strict=False)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"(?=\s*[,:\]}])|"(?:[^\\]|\\.)*?"(?=\s*[,:\]}])|"|[\[\]{}]', re.S)
_ANALYSIS = re.compile(r"<document_analysis>(?:(?!</document_analysis>).)*(</document_analysis>)?", re.S)
_TERMINAL = ".!?。！？"
_CLOSING = "\"'”’»›)）」』】*_ "
_MARK = re.compile(
    r"(?:\s*(?:</?[\w ]+>|<[\w ]+>|\[[\w .…-]*\]?|\((?:[a-z .…]*)\)?|\{[\w .…]*\}?|```\w*|…|\.{2,}|[–—\-:;,~>⟩/|\\]+|[\ufffd\x00]+)\s*)+$"
)
_REMARK = re.compile(r"\s*[(\[（][^()\[\]（）\n]{1,120}[)\]）]\s*$")
_WORDS = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»)\]]*\s+|(?<=[。！？])|[\r\n]+")
_ITEM = re.compile(r"\s*(?:[-*•·–]|\d+[.)])\s+")
_WIDE = re.compile(r"[\u3040-ヿ㐀-鿿豈-\ufaff가-힣]")

INSPECTED = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("chars", T.IntegerType()),
        T.StructField("bytes", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.LongType())),
        T.StructField("tail", T.LongType()),
    ]
)


def closes(text: str, start: int) -> bool:
    """Whether the JSON value at ``start`` closes, flawless or not."""
    try:
        _DECODER.raw_decode(text, start)
        return True
    except ValueError:
        pass
    depth = 0
    for m in _TOKEN.finditer(text, start):
        c = m[0]
        if c == '"':
            return False
        if c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth <= 0:
                return True
    return False


def _key(*parts: str) -> int:
    x = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
    return x - 2**64 if x >= 2**63 else x


def _masked(word: str) -> str:
    if word[0].isdigit():
        return re.sub(r"\d", "#", word[:6])
    return "N" if word[0].isupper() else word


def units(text: str) -> list[str]:
    """The words of a text; of scripts without blanks, its characters."""
    return list(text.replace(" ", "")) if len(_WIDE.findall(text)) * 3 > len(text) else _WORDS.findall(text)


def last_words(found: list[str], end: int | None = None) -> list[str]:
    """The last four of a sentence's words up to ``end``, with a mark before its first."""
    end = len(found) if end is None else end
    return found[end - 4 : end] if end >= 4 else ["^", *found[:end]]


_WORD_HASHES: dict[str, tuple[int, int]] = {}
_STEP, _BITS = 0x9E3779B97F4A7C15, (1 << 63) - 1


def word_hashes(word: str) -> tuple[int, int]:
    """Hashes of a word and of its masked form, kept by the worker."""
    known = _WORD_HASHES.get(word)
    if known is None:
        if len(_WORD_HASHES) > 400_000:
            _WORD_HASHES.clear()
        known = _WORD_HASHES[word] = (_key("w", word) & _BITS, _key("m", _masked(word)) & _BITS)
    return known


def contexts(last: list[str]) -> list[int]:
    """Keys of the last words, from the most to the least telling: each as it is and masked, a lone word as it is."""
    exact = masked = 0
    out: list[int] = []
    for w in reversed(last):
        a, b = word_hashes(w)
        exact, masked = (exact * _STEP + a) & _BITS, (masked * _STEP + b) & _BITS
        out += (masked, exact) if out else (exact,)
    out.reverse()
    return out


def tail_key(word: str) -> int:
    """Key of a word's last letters; of a short one, of the word."""
    return contexts([word])[0] if len(word) < 5 else _key("t", word[-3:].lower())


def _named(state: str, last: list[str]) -> tuple[str, list[int], int | None]:
    """State of an end whose last word may be a name broken off."""
    word = last[-1]
    if not word[0].isupper() or word.isupper():
        return state, contexts(last), None
    return ("short" if len(word) < 5 else state), contexts(last), tail_key(word)


def prose_state(text: str) -> tuple[str, list[int], int | None]:
    """State of a prose's end: whole, cut, or open with the contexts that decide."""
    body = re.sub(r"(?:\s*</?\w+>)+$|```$", "", text.rstrip()).rstrip()
    marked = False
    if not body or body[-1] not in _TERMINAL or body.endswith(".."):
        stripped = _MARK.sub("", body).rstrip()
        marked, body = stripped != body and bool(stripped), stripped or body
    bare = body.rstrip(_CLOSING)
    if (m := _REMARK.search(body)) and m.start() and body[: m.start()].rstrip().rstrip(_CLOSING)[-1:] in _TERMINAL:
        return "whole", [], None
    if not bare:
        return "blank", [], None
    lines = [x for x in body.splitlines() if x.strip()]
    items = [x for x in lines if _ITEM.match(x)]
    found = units(_SENTENCE.split(lines[-1].rstrip(_CLOSING + _TERMINAL))[-1]) if lines else []
    last = last_words(found)
    if bare[-1] in _TERMINAL:
        if bare[-1] == "." and bare[-2:-1].isdigit():
            return "number", contexts(last), None
        return "whole", [], None
    if not found:
        return "cut", [], None
    if marked and not items:
        return _named("open", last)
    if items and _ITEM.match(lines[-1]):
        siblings = items[:-1]
        if "," not in lines[-1] and siblings and all("," in x for x in siblings):
            return "cut", [], None
        return "item", contexts(last), tail_key(last[-1])
    return _named("open", last)


def response_state(text: str) -> tuple[str, list[int], int | None]:
    """State of a model's response: by its JSON list, or as prose if it was never to have one."""
    begin = 0
    if m := _ANALYSIS.match(text, len(text) - len(text.lstrip())):
        if not m[1]:
            return "cut", [], None
        begin = m.end()
    tag = text.find("<output_json>", begin)
    start = re.compile(r"\[\s*(?=[{\]\"])").search(text, max(begin, tag))
    if start:
        return ("whole" if closes(text, start.start()) else "cut"), [], None
    if begin or tag >= 0 or re.search(r"```json|\[\s*$|<[\w/]*$", text):
        brace = text.find("{", max(begin, tag))
        return ("whole" if brace >= 0 and closes(text, brace) else "cut"), [], None
    return prose_state(text)


def _blank(text: str | None) -> bool:
    return text is None or not text.strip("\u200b\ufeff \t\r\n\xa0") or text.strip().strip(".").lower() in PLACEHOLDERS


def inspect(values: DataFrame) -> DataFrame:
    """INSPECTED of every value that has content; ``values`` has field, record_id, source, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in INSPECTED]
            for field, record, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if _blank(text):
                    continue
                state, keys, tail = (response_state if field == "raw_response" else prose_state)(text)
                row = (field, record, source, len(text), len(text.encode("utf-8", "surrogatepass")), state, keys, tail)
                for column, value in zip(out, row):
                    column.append(value)
            types = [*[pa.string()] * 3, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], INSPECTED.names)

    return values.select("field", "record_id", "source", "text").mapInArrow(run, INSPECTED)


COUNTS = "key long, ends long, total long"


def count_ends(text: str, ends: Counter, total: Counter) -> None:
    """Add to the counts how often each context, and each ending of a word, is in a text and ends a sentence (or word) there."""
    sentences = [s for s in _SENTENCE.split(text) if s and s.strip()]
    for k, sentence in enumerate(sentences):
        stopped = sentence.rstrip(_CLOSING)[-1:] in _TERMINAL or bool(_ITEM.match(sentence) and k + 1 < len(sentences))
        found = units(sentence)
        for i in range(1, len(found) + stopped):
            keys = contexts(last_words(found, i))
            total.update(keys)
            if i == len(found):
                ends.update(keys)
        for word in found[: len(found) if stopped else -1]:
            if len(word) > 4 and word[0].isupper():
                low = word.lower()
                total.update(_key("t", low[j : j + 3]) for j in range(1, len(low) - 2))
                ends[_key("t", low[-3:])] += 1


def end_counts(texts: DataFrame, count: Callable[[str, Counter, Counter], None] = count_ends) -> DataFrame:
    """(key, ends, total) of all texts, by ``count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: Counter = Counter()
            total: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if not _blank(text):
                    count(text, ends, total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), pa.array([ends[k] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())],
                ["key", "ends", "total"],
            )

    return texts.mapInArrow(run, COUNTS).groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total"))


def spikes(inspected: DataFrame) -> DataFrame:
    """(field, source, unit, length) at which a source has far more values than around it."""
    lengths = inspected.select("field", "source", F.expr("stack(2, 'chars', chars, 'bytes', bytes) AS (unit, length)"))
    counts = lengths.groupBy("field", "source", "unit", "length").count()
    near = Window.partitionBy("field", "source", "unit").orderBy("length").rangeBetween(-SPIKE_REACH, SPIKE_REACH)
    expected = (F.sum("count").over(near) - F.col("count")) / (2 * SPIKE_REACH)
    high = F.col("count") >= F.greatest(F.lit(SPIKE_LEAST), F.col("expected") + SPIKE_DEVIATIONS * F.sqrt("expected") + 1)
    return counts.withColumn("expected", expected).where(high).select("field", "source", "unit", "length", "count")


def _decided(state: Column, spike: Column, ended: Column, named: Column) -> Column:
    """Whether a value is cut, by its state, a spike at its length, the share of ends in its context, and of its last letters."""
    unfinished = F.coalesce(ended < END_SHARE, F.lit(True))
    half_name = F.coalesce(named < 0.2, F.lit(False))
    return (
        F.when(state == "cut", True)
        .when(state == "number", F.coalesce(ended < F.when(spike, 0.5).otherwise(0.05), F.lit(False)))
        .when(state == "item", spike | half_name)
        .when(state == "short", spike | unfinished | (F.coalesce(named, F.lit(0.0)) < 0.2))
        .when(state == "open", spike | unfinished | half_name)
        .otherwise(False)
    )


def verdicts(values: DataFrame) -> DataFrame:
    """Each value with content, whether it is cut, and by what evidence: field, record_id, source, chars, bytes, cut, evidence, and whether it ends at a spike.

    A value without terminal punctuation (or a closed list) at the length of a spike is cut, whatever
    else its end looks like; only where no limit tells do its structure and its last words decide.
    """
    inspected = cut_lineage(inspect(values).dropDuplicates(["field", "record_id"]))
    at = cut_lineage(spikes(inspected))
    same = lambda unit: (at.where(F.col("unit") == unit).select("field", "source", F.col("length").alias(unit), F.lit(True).alias(f"at_{unit}")))
    unsure = inspected.where(F.col("state").isin("open", "short", "item", "number"))
    keyed = unsure.select("field", "record_id", F.posexplode("contexts").alias("rank", "key")).unionByName(
        unsure.where("tail IS NOT NULL").select("field", "record_id", F.lit(-1).alias("rank"), F.col("tail").alias("key"))
    )
    counts = end_counts(values.where("field <> 'raw_response'").select("text"))
    share = F.col("ends") / F.col("total")
    known = keyed.join(counts, "key").where(F.col("total") >= CONTEXT_LEAST)
    evidence = known.groupBy("field", "record_id").agg(
        F.min_by(F.when(F.col("rank") >= 0, share), F.when(F.col("rank") >= 0, F.col("rank"))).alias("ended"),
        F.max(F.when(F.col("rank") < 0, share)).alias("named"),
    )
    joined = inspected.select("field", "record_id", "source", "chars", "bytes", "state").join(evidence, ["field", "record_id"], "left")
    for unit in ("chars", "bytes"):
        other = same(unit)
        on = (joined["field"] == other["field"]) & joined["source"].eqNullSafe(other["source"]) & (joined[unit] == other[unit])
        joined = joined.join(other, on, "left").select(joined["*"], other[f"at_{unit}"])
    spike = F.coalesce("at_chars", "at_bytes", F.lit(False))
    return joined.withColumn("cut", _decided(F.col("state"), spike, F.col("ended"), F.col("named"))).withColumn("evidence", _evidence(F.col("cut"), spike, F.col("state")))


def _evidence(cut: Column, spike: Column, state: Column) -> Column:
    """What decided that a value is cut: the limit at which it ends, else the structure left open, else how sentences end; none of a whole one."""
    return F.when(~cut, None).when(spike, "limit").when(state == "cut", "structure").otherwise("ending")


def rates(judged: DataFrame) -> DataFrame:
    """Number and share of cut values per field and source, and how many of them each evidence decided."""
    cut = F.count_if(F.col("cut"))
    evidence = [F.count_if(F.col("evidence") == e).alias(f"by_{e}") for e in ("limit", "structure", "ending")]
    return judged.groupBy("field", "source").agg(F.count("*").alias("records"), cut.alias("truncated"), (cut / F.count("*")).alias("share"), *evidence)


def limits(judged: DataFrame) -> DataFrame:
    """The spikes of each field and source: the limit in characters or bytes, how many values end at it, and how many of them lack their end."""
    at = F.expr("stack(2, 'chars', chars, at_chars, 'bytes', bytes, at_bytes) AS (unit, length, at)")
    ends = judged.select("field", "source", "cut", at).where("at").groupBy("field", "source", "unit", "length")
    return ends.agg(F.count("*").alias("records"), F.count_if("cut").alias("truncated"))
