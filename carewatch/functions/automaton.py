"""Detection by lexicons of any size in one pass over each text: an Aho-Corasick automaton in an Arrow function."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import FLAT, described, let, match_by_join, without_overlaps
from .lexicon import NEGATIONS

#: Terms up to which a lexicon is collected and sent to every worker; larger ones go through detect.match_by_join.
MOST_TERMS = 1_000_000


class Folded(dict):
    """Code points by the one they are compared as; a letter whose other case is several characters is its own."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        lower = (upper if len(upper) == 1 else chr(code)).lower()
        self[code] = ord(lower) if len(lower) == 1 else code
        return self[code]


class WordSigns(dict):
    """Characters by whether they belong to words: letters, marks, decimal digits, letter numbers, connectors, joiners."""

    def __missing__(self, sign: str) -> bool:
        kind = unicodedata.category(sign)
        self[sign] = kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or sign in "‌‍"
        return self[sign]


FOLDED, WORD_SIGNS = Folded(), WordSigns()


def folded(text: str) -> str:
    """text in one case, character by character, so that offsets stay."""
    return text.lower() if text.isascii() else text.translate(FOLDED)


class Matcher:
    """The terms of all categories as one automaton; categories are (rank, name, weight) in order."""

    def __init__(self, terms: list[tuple[int, str, float, str]]):
        self.categories = sorted({t[:3] for t in terms})
        number = {c: k for k, c in enumerate(self.categories)}
        of: dict[str, set[int]] = {}
        for rank, category, weight, term in terms:
            of.setdefault(folded(term), set()).add(number[rank, category, weight])
        self.automaton = ahocorasick.Automaton()
        for term, some in of.items():
            if term:
                self.automaton.add_word(term, (len(term), tuple(some)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[list[dict]]:
        """For each category its whole words in order: the leftmost, of those the longest, then on from its end."""
        found: list[list[tuple[int, int]]] = [[] for _ in self.categories]
        if text and len(self.automaton):
            low, n, word = folded(text), len(text), WORD_SIGNS
            for last, (size, some) in self.automaton.iter(low):
                start, end = last + 1 - size, last + 1
                if (start == 0 or not word[text[start - 1]]) and (end == n or not word[text[end]]):
                    for k in some:
                        found[k].append((start, -end))
        out = []
        for (_, category, weight), spans in zip(self.categories, found):
            kept, at = [], 0
            for start, end in sorted(spans):
                if start >= at:
                    at = -end
                    kept.append({"start": start, "end": at, "term": text[start:at], "category": category, "weight": weight})
            out.append(kept)
        return out


_MADE: dict[str, Matcher] = {}


def matcher_of(shared, name: str) -> Matcher:
    """The matcher of a broadcast lexicon, made once by each worker."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Matcher(shared.value)
    return _MADE[name]


def matched(docs: DataFrame, lexicon: DataFrame, text: str = "text", most_terms: int = MOST_TERMS, out: str = "spans") -> DataFrame:
    """docs with spans(start, end, term, category, weight) of the terms of lexicon(category, category_rank, weight, term), in order of position.

    Up to most_terms terms, counted before they are collected and sent to every worker,
    where they make one automaton; its time for a text grows with the text and its hits,
    not with the terms. Python finds each category's spans, overlaps are removed by
    expressions. Null and empty texts and an empty lexicon give no spans; terms that repeat
    count once in a category, empty ones never.
    """
    rows = lexicon.where("term is not null").select(F.col("category_rank").cast("int"), "category", F.col("weight").cast("double"), "term").distinct()
    terms = [tuple(r) for r in rows.limit(most_terms + 1).collect()]
    if len(terms) > most_terms:
        raise ValueError(f"more than {most_terms} terms: use detect.match_by_join")
    shared, name = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex
    kind = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("category", pa.string()), ("weight", pa.float64())])))

    @F.arrow_udf(f"array<array<{FLAT}>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = matcher_of(shared, name)
        for texts in batches:
            yield pa.array([matcher.spans(t) for t in texts.to_pylist()], kind)

    return docs.withColumn(out, spans(F.col(text))).withColumn(out, without_overlaps(F.col(out)))


def word_hits(docs: DataFrame, key: str, lexicon: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """(key, category, term) of every hit of a lexicon of single words in the column text.

    Up to most_terms terms make one automaton; more go through detect.match_by_join, so
    none is left out. Single words don't overlap, hence both ways give the same hits.
    """
    if lexicon.limit(most_terms + 1).count() > most_terms:
        return match_by_join(docs, key, lexicon).select(key, "category", "term")
    return matched(docs, lexicon, most_terms=most_terms).select(key, F.explode("spans").alias("h")).select(key, "h.category", "h.term")


def detected(docs: DataFrame, lexicon: DataFrame, cues: list[str] = NEGATIONS, window: int = 120, text: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """docs with detections, as rules.detected() gives, of the spans of matched(); negation, context and sentences are expressions."""
    whole = F.coalesce(F.col(text), F.lit(""))
    raw = matched(docs, lexicon, text, most_terms, "_spans")
    return raw.withColumn("detections", let(F.col("_spans"), lambda kept: described(whole, kept, cues, window, False))).drop("_spans")
