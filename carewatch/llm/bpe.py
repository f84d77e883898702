"""Byte-level BPE as a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: States, pairs of tokens and pieces of text that a worker remembers before it starts afresh; what it gives doesn't depend on them.
MOST, PAIRS, PIECES = 300_000, 1_000_000, 600_000
#: Longest piece whose ids are remembered, in characters.
WORD_CHARS = 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def spelled(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each token."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        out[rank] = word
    return out


class Transducer:
    """Reads bytes, writes token ids.

    A sequence of tokens is the encoding of its bytes exactly if the merges of every two
    neighbours alone give these two. So the undetermined machine reads tokens along a trie
    and goes from a token only to tokens that may follow it; of all ways to read a prefix
    one at most ends with a whole token. A state of the determined machine is the set of
    live ways: (token before, trie node, tokens not yet written). What all ways share is
    written at once; ways differ by less than the longest token, which bounds the lookahead.
    States and moves are made when first needed: `sets` has each state's ways as packed
    numbers, `moves` the next state by state and byte, `writes` what a move writes, if anything.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = MOST):
        self.ranks, self.most = ranks, most
        self.bytes_of = spelled(ranks)
        self.kids: dict[int, int] = {}  # node << 8 | byte -> node
        self.token, self.inner = array("i", [-1]), bytearray(1)
        for word, rank in ranks.items():
            node = 0
            for b in word:
                child = self.kids.get(node << 8 | b)
                if child is None:
                    child = self.kids[node << 8 | b] = len(self.token)
                    self.inner[node] = 1
                    self.token.append(-1)
                    self.inner.append(0)
                node = child
            self.token[node] = rank
        self.follows: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.restart()

    def restart(self) -> None:
        """Forget all states but the start."""
        start = array("i", (-1, 0, 0)).tobytes()
        self.sets, self.states = [start], {start: 0}
        self.moves: dict[int, int] = {}
        self.writes: dict[int, tuple[int, ...]] = {}

    def ways(self, state: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        flat, k = memoryview(self.sets[state]).cast("i").tolist(), 0
        while k < len(flat):
            end = k + 3 + flat[k + 2]
            yield flat[k], flat[k + 1], tuple(flat[k + 3 : end])
            k = end

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The merges of ranks under `below` by definition, for a few bytes: the pair of lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's left (0) or right (1) edge while it is built, latest first, each with the rank of the merge that ends it."""
        got = self.spines[side].get(token)
        if got is None:
            got, end, t = [], 1 << 60, token
            while True:
                got.append((self.bytes_of[t], end))
                if len(self.bytes_of[t]) == 1:
                    break
                parts = self.merged(self.bytes_of[t], t)
                if len(parts) != 2 or max(parts) >= t:
                    raise ValueError("the ranks aren't in order of merges")
                end, t = t, parts[-side]
            self.spines[side][token] = got
        return got

    def crossed(self, before: int, token: int) -> bool:
        rank, left = self.ranks.get, self.spine(token, 0)
        for a, end_a in self.spine(before, 1):
            for b, end_b in left:
                k = rank(a + b)
                if k is not None and k < end_a and k <= end_b:
                    return True
        return False

    def may_follow(self, before: int, token: int) -> bool:
        """Whether no merge crosses the border of the two: none is due while both of its sides stand there."""
        key = before << 32 | token
        ok = self.follows.get(key)
        if ok is None:
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            self.spine(token, 0)  # checks that merges make this token
            ok = True
            if before >= 0:
                ok = not self.crossed(before, token)
            self.follows[key] = ok
        return ok

    def move(self, state: int, byte: int) -> int:
        """The next state; what the move writes is noted in `writes`."""
        ways = []
        kids, token_of, inner, follows = self.kids, self.token, self.inner, self.follows
        for before, node, pending in self.ways(state):
            child = kids.get(node << 8 | byte)
            if child is None:
                continue
            if inner[child]:
                ways.append((before, child, pending))
            token = token_of[child]
            if token >= 0:
                ok = follows.get(before << 32 | token)
                if ok or ok is None and self.may_follow(before, token):
                    ways.append((token, 0, (*pending, token)))
        if not ways:
            raise ValueError("the ranks don't hold every byte")
        shared, first = 0, ways[0][2]
        least = min([len(w[2]) for w in ways])
        while shared < least and all([w[2][shared] == first[shared] for w in ways]):
            shared += 1
        ways.sort()
        flat = array("i")
        for a, n, p in ways:
            flat.extend((a, n, len(p) - shared, *p[shared:]))
        new = flat.tobytes()
        to = self.states.get(new)
        if to is None:
            to = self.states[new] = len(self.sets)
            self.sets.append(new)
        at = state << 8 | byte
        self.moves[at] = to
        if shared:
            self.writes[at] = first[:shared]
        return to

    def last(self, state: int, byte: int) -> tuple[int, ...]:
        """What is written when the input ends with this byte: the one way that ends with a whole token. No state is made."""
        for before, node, pending in self.ways(state):
            child = self.kids.get(node << 8 | byte)
            if child is not None and (token := self.token[child]) >= 0 and self.may_follow(before, token):
                return (*pending, token)
        raise ValueError("the ranks don't hold every byte")

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece of text, read to its end."""
        if len(self.sets) > self.most:
            self.restart()
        state, out, end = 0, [], len(data) - 1
        for k in range(0, end, 1 << 16):
            moves, writes = self.moves.get, self.writes.get
            for b in data[k : min(end, k + (1 << 16))]:
                at = state << 8 | b
                state = moves(at)
                if state is None:
                    state = self.move(at >> 8, b)
                if wrote := writes(at):
                    out += wrote
            if len(self.sets) > self.most:  # a huge piece: the state it is in goes on without the others
                here = self.sets[state]
                self.restart()
                state = self.states.setdefault(here, len(self.sets))
                if state:
                    self.sets.append(here)
        if data:
            out += self.last(state, data[end])
        return out


class Words(dict):
    """Ids of pieces, as packed bytes; the transducer reads those that aren't remembered."""

    def __init__(self, machine: Transducer, most: int = PIECES):
        super().__init__()
        self.machine, self.most = machine, most

    def __missing__(self, piece: str) -> bytes:
        got = array("I", self.machine.encode(piece.encode()))
        packed = got.tobytes()
        if len(piece) <= WORD_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


#: Letters, numbers and white space under U+0250, where Python's own regular expressions match them much faster.
LETTERS, NUMBERS, SPACES, REST = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0", re.compile("[^\x00-\u024f]")


def narrowed(pattern: str) -> re.Pattern | None:
    """The pattern for texts under U+0250; None if it uses more than the classes L, N and white space."""
    out, inside, k = "", False, 0
    known = {r"\p{L}": LETTERS, r"\p{N}": NUMBERS, r"\s": SPACES}
    while k < len(pattern):
        name = next((x for x in (*known, r"\S") if pattern.startswith(x, k)), None)
        if name:
            if name == r"\S" and inside:
                return None
            out += f"[^{SPACES}]" if name == r"\S" else known[name] if inside else f"[{known[name]}]"
            k += len(name)
            continue
        if pattern[k] == "\\" or pattern.startswith("(?i", k):
            return None
        inside = pattern[k] == "[" or inside and pattern[k] != "]"
        out += pattern[k]
        k += 1
    return re.compile(out)


class Splitter:
    """Pieces of a text; those of a long text come a few at a time."""

    def __init__(self, pattern: str):
        self.full, self.fast = regex.compile(pattern), narrowed(pattern)

    def __call__(self, text: str):
        p = self.fast if self.fast and (text.isascii() or not REST.search(text)) else self.full
        if len(text) < 1 << 18:
            yield p.findall(text)
            return
        pieces = p.finditer(text)
        while part := [m[0] for m in islice(pieces, 1 << 15)]:
            yield part


def encode_text(text: str, splitter: Splitter, words: Words) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join(b"".join(map(words.__getitem__, part)) for part in splitter(text))


class Utf8Stream:
    """Decodes bytes that come in parts: a sign cut by a part's end waits for its other bytes."""

    def __init__(self):
        self.held = b""

    def push(self, part: bytes) -> str:
        data = self.held + part
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a lead byte: does it want more than follows?
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    cut -= back
                break
            if b < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Spelling:
    """The bytes of tokens laid end to end, so that many ids are spelled out at once."""

    def __init__(self, bytes_of: list[bytes]):
        self.size = np.array([len(x) for x in bytes_of], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[ids] - ends + size, size)
        return self.flat[shift + np.arange(len(shift))].tobytes()


def decode_ids(packed: bytes, spelling: Spelling, step: int = 1 << 15) -> str:
    """The text of ids; unknown ids fail, bytes that aren't UTF-8 become U+FFFD."""
    stream, ids, out = Utf8Stream(), np.frombuffer(packed, dtype="<u4"), []
    for k in range(0, len(ids), step):
        out.append(stream.push(spelling(ids[k : k + step])))
    return "".join([*out, stream.close()])


#: What a worker has made of the broadcast ranks; tasks that run in one worker share it.
MADE: dict = {}


def made(kind: str, ranks: dict[bytes, int], pattern: str):
    """The encoder's words and splitter, or the decoder's spelling; those of other ranks are forgotten."""
    of = pattern, hash(tuple(ranks.items()))
    if MADE.get("of") != of:
        MADE.clear()
        MADE["of"] = of
        gc.set_threshold(200_000, 50, 50)  # a machine is many small objects that stay
    if kind not in MADE:
        MADE[kind] = Spelling(spelled(ranks)) if kind == "decoder" else (Words(Transducer(ranks)), Splitter(pattern))
    return MADE[kind]


class Tokenizer:
    """encode() and decode() as column functions for one rank file.

    The ranks are read by the driver and broadcast; their size is that of the vocabulary
    file. Null text gives no ids; every text is encoded whole, special tokens are ordinary
    text. Ids are a binary column of little-endian unsigned 32-bit integers.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = spark.sparkContext.broadcast(load_ranks(path))

        @F.pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words, splitter = made("encoder", ranks.value, pattern)
            for texts in batches:
                yield pd.Series([encode_text(t, splitter, words) if t else b"" for t in texts], dtype="object")

        @F.pandas_udf("string")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            spelling = made("decoder", ranks.value, pattern)
            for ids in batches:
                yield pd.Series([decode_ids(x, spelling) if x else "" for x in ids], dtype="object")

        @F.pandas_udf("ids binary, text string")
        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            (words, splitter), spelling = made("encoder", ranks.value, pattern), made("decoder", ranks.value, pattern)
            for texts in batches:
                ids = [encode_text(t, splitter, words) if t else b"" for t in texts]
                yield pd.DataFrame({"ids": ids, "text": [decode_ids(x, spelling) if x else "" for x in ids]}, dtype="object")

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)

    def round_trip(self, text: Column) -> Column:
        """struct<ids, text>: the ids, and the text decoded from them in the same worker."""
        return self._both(text)


def default_tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def encoded(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """docs with ids and n_tokens, whatever their columns; columns of these names are replaced."""
    return docs.withColumn("ids", tokenizer.encode(F.col("text"))).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def op6_bpe(spark: SparkSession, docs: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no ids, the digests of nothing. Very long texts are encoded
    whole, some pieces at a time; repeated rows come back as often as they came; an empty
    table gives an empty result. Other columns are ignored.
    """
    tokenizer, scratch = tokenizer or default_tokenizer(spark), Scratch(spark)
    rows = docs.select("doc_id", tokenizer.round_trip(F.col("text")).alias("b"))
    count = (F.octet_length("b.ids") / 4).cast("long").alias("n_tokens")
    rows = rows.select("doc_id", count, F.sha2("b.ids", 256).alias("ids_sha256"), F.sha2("b.text", 256).alias("decoded_sha256"))
    with scratch.small_batches():
        return scratch.stored(rows, "tokens")
