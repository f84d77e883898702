"""Detection of weighted terms in text, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import NEGATIONS, Term

FLAT = "struct<start:int,end:int,term:string,category:string,weight:double>"
DETECTION = "struct<term:string,category:string,weight:double,start:int,end:int,negated:boolean,context:string,sentence:string>"
#: Elements of an array that are summed up at a time; code points of a block of text.
CHUNK, BLOCK = 128, 256
#: Most characters of a sentence: one without a closing sign would be repeated whole for each of its hits.
SENTENCE = 4096


def quoted(word: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}-])", r"\\\1", word)


def whole_words(terms: list[str]) -> str:
    """Java pattern for whole terms in any case, the longest first."""
    longest = sorted(set(terms), key=lambda t: (-len(t), t))
    return r"(?iU)(?<!\w)(?:" + "|".join(map(quoted, longest)) + r")(?!\w)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: inside a function of an array every mention of an expression is."""
    return F.element_at(F.transform(F.array(value), use), 1)


def totals(numbers: Column) -> Column:
    """Running sums of an array<int>, chunk by chunk: an array can only grow by a copy."""

    def within(chunk: Column, before: Column) -> Column:
        return F.slice(F.aggregate(chunk, F.array(before), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), 2, F.size(chunk))

    def over(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, n: a + n))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(before, 1, F.size(chunks)), within))

    last = lambda a: F.greatest(F.lit(0), F.ceil(F.size(a) / CHUNK).cast("int") - 1)
    chunks = lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda k: F.slice(a, k * CHUNK + 1, CHUNK))
    return let(numbers, lambda a: F.when(F.size(a) <= CHUNK, within(a, F.lit(0))).otherwise(let(chunks(a), over)))


def place_of(value: Column, ordered: Column, key: Callable[[Column], Column]) -> Column:
    """How many elements of an array in order of key are at or below a value, by bisection."""
    steps = F.transform(F.sequence(F.ceil(F.log2(F.size(ordered) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(key(F.try_element_at(ordered, at + s)) <= value, s).otherwise(0))


def spans(text: Column, groups: list[tuple[str, float, str]]) -> Column:
    """For each (category, weight, pattern) its matches in order, with offsets (code points, end exclusive): an array of arrays.

    Matches interleave with the pieces between them, whose lengths add up to the offsets.
    """
    none = F.array().cast(f"array<{FLAT}>")

    def cut(pattern: str, category: str, weight: float) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(hits, lambda h: F.struct(h.alias("hits"), F.when(F.size(h) > 0, F.split(text, pattern, -1)).alias("gaps"), F.lit(category).alias("category"), F.lit(weight).alias("weight")))

    def placed(of: Column) -> Column:
        ends = totals(F.zip_with(F.slice(of["gaps"], 1, F.size(of["hits"])), of["hits"], lambda g, h: F.length(g) + F.length(h)))
        whole = lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("term"), of["category"].alias("category"), of["weight"].alias("weight"))
        return F.when(F.size(of["hits"]) == 0, none).otherwise(F.zip_with(of["hits"], ends, whole))

    return F.transform(F.array(*(cut(p, c, w) for c, w, p in groups)), placed)


def without_overlaps(lists: Column) -> Column:
    """Spans of several lists without those that overlap one of an earlier list, in order of their starts.

    Spans of one list don't overlap each other and stand in order. So what is kept never
    overlaps, and of all kept only the last that begins at or before a span and the next
    can overlap it: two places that bisection finds.
    """

    def free(kept: Column, s: Column) -> Column:
        def apart(at: Column) -> Column:
            before, after = F.try_element_at(kept, at), F.try_element_at(kept, at + 1)
            return F.coalesce(F.when(at > 0, before["end"] <= s["start"]), F.lit(True)) & F.coalesce(after["start"] >= s["end"], F.lit(True))

        return let(place_of(s["start"], kept, lambda k: k["start"]), apart)

    def more(kept: Column, some: Column) -> Column:
        added = lambda k: F.when(F.size(some) == 0, k).when(F.size(k) == 0, some).otherwise(F.sort_array(F.concat(k, F.filter(some, lambda s: free(k, s)))))
        return let(kept, added)

    return F.aggregate(lists, F.array().cast(f"array<{FLAT}>"), more)


def negation_pattern(cues: list[str]) -> str:
    """A cue with at most 100 characters of the same sentence after it; a blank in a cue is any white space."""
    longest = sorted(cues, key=lambda c: (-len(c), c))
    return r"(?diU)\b(?:" + "|".join(quoted(c).replace(" ", r"\s+") for c in longest) + r")\b[^.!?]{0,100}$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def before(text: Column, start: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.lit(1), start - n + 1), F.least(start, F.lit(n)))


def context(text: Column, start: Column, end: Column, window: int = 120) -> Column:
    first = F.greatest(F.lit(0), start - window)
    return trimmed(F.substring(text, first + 1, end + window - first))


def blocks_of(text: Column) -> Column:
    """text in blocks of BLOCK code points: a part of a long text is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.greatest(F.lit(0), F.floor((end - 1) / BLOCK).cast("int") - first + 1))
    return F.substring(F.array_join(some, ""), start - first * BLOCK + 1, F.greatest(F.lit(0), end - start))


def borders_of(text: Column) -> Column:
    """Offsets after each sign that closes a sentence, in order."""
    return let(F.split(text, r"[.!?\n]", -1), lambda pieces: totals(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p) + 1)))


def sentence(blocks: Column, borders: Column, length: Column, start: Column, end: Column, compat: bool = False) -> Column:
    """The sentence around a hit of a text in blocks, up to its closing sign. compat keeps the sign that closed the one before.

    Both ends are found among the borders by bisection. Of a longer sentence the first
    SENTENCE characters are kept; 500 are stored, see exploded().
    """
    after = lambda x: place_of(x, borders, lambda b: b)

    def around(at: Column) -> Column:
        left = F.when(at > 0, F.try_element_at(borders, at) - int(compat)).otherwise(0)
        near = F.coalesce(F.try_element_at(borders, at + 1), length)
        right = F.when(near > end, near).otherwise(F.coalesce(F.try_element_at(borders, after(end) + 1), length))  # a sign within the hit
        return trimmed(part(blocks, left, F.least(right, left + SENTENCE)))

    return let(after(start), around)


def detections(text: Column, lexicon: list[Term], cues: list[str] = NEGATIONS, window: int = 120, compat: bool = False) -> Column:
    """array<struct<term, category, weight, start, end, negated, context, sentence>>, heaviest first, then by position.

    Earlier categories win overlaps, within a category the leftmost longest term. A text
    without any term costs one test. Null text gives an empty array.
    """
    text = F.coalesce(text, F.lit(""))
    if not lexicon:
        return F.array().cast(f"array<{DETECTION}>")
    groups: dict = {}
    for t in sorted(lexicon, key=lambda t: t.rank):
        groups.setdefault((t.rank, t.category, t.weight), []).append(t.term)
    found = without_overlaps(spans(text, [(c, w, whole_words(terms)) for (_, c, w), terms in groups.items()]))
    any_term = text.rlike(whole_words([t.term for t in lexicon]))
    return let(F.when(any_term, found).otherwise(F.array().cast(f"array<{FLAT}>")), lambda kept: described(text, kept, cues, window, compat))


def described(text: Column, kept: Column, cues: list[str], window: int, compat: bool) -> Column:
    """Spans in order of position with negation, context and sentence, heaviest first.

    A text is cut into blocks and its borders are found once, so the work grows with the
    text and its hits, not with their product.
    """
    negated = negation_pattern(cues) if cues else r"(?!)"
    names = ("term", "category", "weight", "start", "end", "negated", "context", "sentence")

    def full(blocks: Column, borders: Column, length: Column, s: Column) -> Column:
        start, end = s["start"], s["end"]
        near = part(blocks, F.greatest(F.lit(0), start - window), F.least(length, end + window))
        return F.struct(
            (-s["weight"]).alias("order"), start.alias("start"), s["term"].alias("term"), s["category"].alias("category"), s["weight"].alias("weight"), end.alias("end"),
            part(blocks, F.greatest(F.lit(0), start - 120), start).rlike(negated).alias("negated"), trimmed(near).alias("context"), sentence(blocks, borders, length, start, end, compat).alias("sentence"),
        )

    once = F.struct(blocks_of(text).alias("blocks"), borders_of(text).alias("borders"), F.length(text).alias("length"))
    rows = let(once, lambda t: F.transform(kept, lambda s: full(t["blocks"], t["borders"], t["length"], s)))
    ordered = F.transform(F.sort_array(rows), lambda s: F.struct(*(s[n].alias(n) for n in names)))
    return F.when(F.size(kept) == 0, F.array().cast(f"array<{DETECTION}>")).otherwise(ordered)


def score(found: Column, include_negated: bool = False) -> Column:
    """Sum of the weights of hits that aren't negated, 3 decimals; decimals make the sum exact."""
    kept = found if include_negated else F.filter(found, lambda s: ~s["negated"])
    total = F.aggregate(kept, F.lit(0).cast("decimal(20,3)"), lambda a, s: (a + s["weight"].cast("decimal(10,3)")).cast("decimal(20,3)"))
    return F.coalesce(total, F.lit(0)).cast("double")


def exploded(docs: DataFrame, keys: list[str], found: str = "detections") -> DataFrame:
    """One row per hit; context and sentence cut to 300 and 500 characters for storage."""
    rows = docs.select(*keys, F.explode(found).alias("d"))
    cut = {"context": 300, "sentence": 500}
    return rows.select(*keys, *((F.left(f"d.{n}", F.lit(cut[n])) if n in cut else F.col(f"d.{n}")).alias(n) for n in ("term", "category", "weight", "start", "end", "negated", "context", "sentence")))


#: Terms up to which a lexicon is sent to every task of match_by_join.
BROADCAST_TERMS = 200_000


def match_by_join(docs: DataFrame, key: str, lexicon: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(key, position, term, category, weight) for lexicons too large for a pattern: lower-cased word n-grams meet terms in an equi-join.

    Positions count words. Terms are matched by their words, so separators don't matter.
    The n are the numbers of words that terms of the lexicon have; a term without a word
    matches nothing. The n-grams are made within the row. A lexicon of at most
    broadcast_terms terms, which is counted first, is broadcast; a larger one is shuffled.
    """
    parts = F.regexp_extract_all(F.lower("term"), F.lit(r"(?U)\w+"), F.lit(0))
    terms = lexicon.withColumn("gram", F.array_join(parts, " ")).where(F.size(parts) > 0).select("gram", "term", "category", "weight", F.size(parts).alias("n"))
    sizes = {r["n"]: r["count"] for r in terms.groupBy("n").count().collect()}
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    rows, few = docs.select(F.col(key), words.alias("words")), sum(sizes.values()) <= broadcast_terms

    def matched(n: int) -> DataFrame:
        some = terms.where(F.col("n") == n).select("gram", "term", "category", "weight")
        last = F.size("words") - n + 1
        grams = F.col("words") if n == 1 else F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("words", i, n), " ")))
        grams = rows.select(key, F.posexplode(grams).alias("position", "gram"))
        return grams.join(F.broadcast(some) if few else some, "gram").select(key, (F.col("position") + 1).alias("position"), "term", "category", "weight")

    return reduce(DataFrame.union, map(matched, sorted(sizes) or [1]))


def highlighted(text: Column, found: Column) -> Column:
    """HTML-escaped text with marked spans in order; spans that overlap an earlier one are left out, negated ones are struck through."""
    esc = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.coalesce(text, F.lit(""))
    ordered = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), s["term"].alias("term"), s["negated"].alias("negated"))))

    def add(acc, s):
        label = F.when(s["negated"], F.lit('<mark style="text-decoration:line-through" title="Negado: ')).otherwise(F.concat(F.lit('<mark title="'), esc(s["category"]), F.lit(": ")))
        mark = F.concat(label, esc(s["term"]), F.lit('">'), esc(F.substring(text, s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>"))
        gap = esc(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["html"], gap, mark).alias("html")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))
    return F.aggregate(F.coalesce(ordered, F.array().cast("array<struct<start:int,end:int,category:string,term:string,negated:boolean>>")), start, add, lambda acc: F.concat(acc["html"], esc(F.substr(text, acc["at"] + 1))))


# Contexts that raise the weight of a hit, and stems that a strict negation must precede.
INTENSIFYING = [
    r"\b(?:sempre|todo\s*dia|constantemente|frequentemente|diariamente|rotineiramente)\b.{0,50}\b(?:agred|bat|violent|maltrat)\w*",
    r"\b(?:na\s*frente|presença|vista)\b.{0,30}\b(?:crianças?|filhos?|menores?)\b.{0,50}\b(?:agred|bat|violent)\w*",
    r"\b(?:grávida|gestante|gestação)\b.{0,50}\b(?:agred|bat|chut|violent|espanc)\w*",
    r"\b(?:com|usando|ameaçou\s*com|empunhando)\b.{0,30}\b(?:faca|revólver|pistola|arma|martelo)\b",
]
MEDICAL = [
    r"\b(?:fratura|sangramento|hemorragia|trauma)\b.{0,30}\b(?:agred|bat|violent)\w*",
    r"\b(?:cirurgia|sutura|pontos)\b.{0,50}\b(?:agred|bat|violent)\w*",
]
STEMS = r"(?:viol|agred|espanc|machuc|bat|surr|ameaç|mal.?trat)"


def contextual_intensity(text: Column, start: Column, end: Column) -> Column:
    """1 plus 0.5 per intensifying and 0.7 per medical context within 200 characters, in [0.1, 5]."""
    first = F.greatest(F.lit(0), start - 200)
    near = F.lower(F.substring(text, first + 1, end + 200 - first))
    total = F.lit(1.0)
    for patterns, more in ((INTENSIFYING, 0.5), (MEDICAL, 0.7)):
        for p in patterns:
            total = total + F.when(near.rlike("(?diU)" + p), F.lit(more)).otherwise(F.lit(0.0))
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(5.0), total)), 1)


def negated_strictly(text: Column, start: Column, end: Column, cues: list[str] = NEGATIONS) -> Column:
    """A cue followed within 80 word or space characters by a stem of violence, from 150 characters before the hit to its end."""
    first = F.greatest(F.lit(0), start - 150)
    part = F.substring(text, first + 1, end - first)
    return part.rlike(r"(?iU)\b(?:" + "|".join(map(quoted, cues)) + r")\b[\s\w]{0,80}\b" + STEMS + r"\w*")
