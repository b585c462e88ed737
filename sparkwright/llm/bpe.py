"""Byte-level BPE as a finite-state transducer, and streaming decoding.

Encoding reads a piece byte by byte. After any prefix, BPE's result for that prefix has exactly one last token, and a
token sequence is BPE's result if and only if each neighbouring pair is BPE's result for the pair's own bytes. So the
last token at a prefix's end is the one vocabulary entry that ends there and is compatible with the last token where it
begins.

Any end may be the start of a next entry, so the machine that reads entries is non-deterministic: it stands at one node
of the vocabulary's trie for each end that is still open. It is determinised lazily. A set of such nodes is a state, and
as each of them spells a suffix of what the deepest one spells, the deepest node names the set: there are no more states
than trie nodes, whatever is read. A state's transition on a byte, and the entries that end where it is entered (the
longest first), are found when a text first needs them and kept. Which of these entries is the token depends on the last
tokens at the ends where they begin, all within the longest entry's length, and on a table of compatible pairs. Tokens
before the point where the paths of all open ends meet are settled, and are emitted while the piece is still read: the
lookahead is bounded.

Memory is bounded: nodes by the vocabulary; kept transitions, pairs and pieces by numbers (see Transducer and Encoder).

Cases: null and empty texts have no tokens; a text may be of any length (a piece costs time in proportion to its bytes);
repeated rows are encoded alike; an empty table gives an empty table; other columns are kept, save one that has the name
of a result, which gives way to it.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.shared import add_columns


#: A state as the transitions hold it: its node << 8, and the entries that end where it is entered, as (token, bytes), the longest first.
State = tuple[int, tuple[tuple[int, int], ...]]


class _Steps(dict):
    """The determinised transitions: of node << 8 | byte, the next state, made when first asked for; `most` are kept.

    A state, once made, is one object.
    """

    def __init__(self, trie: dict[int, int], fail: array, entry: array, depth: array, most: int):
        super().__init__()
        self.trie, self.fail, self.entry, self.depth, self.most = trie, fail, entry, depth, most
        self.states: dict[int, State] = {}

    def __missing__(self, key: int) -> State:
        at, byte = key >> 8, key & 255
        while (to := self.trie.get(at << 8 | byte)) is None and at:
            at = self.fail[at]
        if len(self) >= self.most:
            self.clear()
            self.states.clear()
        if (state := self.states.get(to or 0)) is None:
            state = self.states[to or 0] = (to or 0, self._ends((to or 0) >> 8))
        self[key] = state
        return state

    def _ends(self, at: int) -> tuple[tuple[int, int], ...]:
        out = []
        while at:
            if self.entry[at] >= 0:
                out.append((self.entry[at], self.depth[at]))
            at = self.fail[at]
        return tuple(out)


class _Pairs(dict):
    """Of left << 32 | right, whether BPE leaves these two neighbours as they are; at most `most` are kept."""

    def __init__(self, compatible: Callable[[int, int], bool], most: int):
        super().__init__()
        self.compatible, self.most = compatible, most

    def __missing__(self, key: int) -> bool:
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.compatible(key >> 32, key & 0xFFFFFFFF)
        return out


class Transducer:
    """BPE for one vocabulary of ranks. max_steps and max_pairs bound what is kept: beyond, it is dropped and made anew as needed."""

    #: Bytes after which a long piece's settled tokens are emitted.
    STRIDE = 4096

    def __init__(self, ranks: dict[bytes, int], max_steps: int = 100_000, max_pairs: int = 300_000):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        trie: dict[int, int] = {}
        self.entry, self.depth = array("i", [-1]), array("i", [0])  # of each node, the token that it spells and its depth
        self.first: dict[int, int] = {}  # of each entry of more than a byte, the tokens that it is joined from
        self.second: dict[int, int] = {}
        for piece, rank in ranks.items():
            if len(piece) > 1:
                # an entry that merging does not build from its own bytes is never BPE's result for a prefix
                if (two := self.halves(piece)) is None:
                    continue
                self.first[rank], self.second[rank] = ranks[two[0]], ranks[two[1]]
            at = 0
            for byte in piece:
                if (to := trie.get(at | byte)) is None:
                    to = trie[at | byte] = len(self.entry) << 8
                    self.entry.append(-1)
                    self.depth.append(self.depth[at >> 8] + 1)
                at = to
            self.entry[at >> 8] = rank
        self.fail = self._fail(trie)
        self.step = _Steps(trie, self.fail, self.entry, self.depth, max_steps)
        self.pair = _Pairs(self.compatible, max_pairs)

    def _fail(self, trie: dict[int, int]) -> array:
        """Of each node, that of the longest proper suffix which the trie has."""
        fail = array("i", bytes(4 * len(self.entry)))
        for key, to in sorted(trie.items(), key=lambda x: self.depth[x[1] >> 8]):
            if at := key >> 8:
                at = fail[at]
                while (back := trie.get(at << 8 | key & 255)) is None and at:
                    at = fail[at]
                fail[to >> 8] = (back or 0) >> 8
        return fail

    def halves(self, piece: bytes) -> tuple[bytes, bytes] | None:
        """The last two parts of a piece as merging joins it: the pair of lowest rank first, the leftmost of equals. None if it does not become one."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two neighbours as they are.

        Undoing the merges on both sides of the border, the later one first, gives every pair that ever met there. A pair
        that makes an entry of a rank below that of the merge that parted it would have been joined; at equal rank the
        one further left goes first.
        """
        x, y, before, ranks, bytes_of = left, right, 1 << 60, self.ranks, self.bytes_of
        while True:
            if ranks.get(bytes_of[x] + bytes_of[y], 1 << 60) < before:
                return False
            a, b = self.second.get(x), self.first.get(y)
            if a is not None and (b is None or x > y):
                x, before = a, x
            elif b is not None:
                y, before = b, y + 1
            else:
                return True

    def _read(self, data: bytes, node: int, tokens: list[int]) -> int:
        """Reads on from a state's node, adds the last token at each end to tokens, and returns the node reached. The last of a state's entries, a byte, needs no test."""
        step, pair, n = self.step, self.pair, len(tokens)
        for byte in data:
            node, ends = step[node | byte]
            n += 1
            for token, size in ends:
                if size == n or size == 1 or pair[tokens[n - size - 1] << 32 | token]:
                    break
            tokens.append(token)
        return node

    def _settled(self, tokens: list[int], node: int) -> int:
        """How many bytes of those read lie before the point where the paths of all open ends meet."""
        ends, at = {len(tokens)}, node >> 8
        while at:
            ends.add(len(tokens) - self.depth[at])
            at = self.fail[at]
        while len(ends) > 1:
            ends.remove(last := max(ends))
            ends.add(last - self.size[tokens[last - 1]])
        return ends.pop()

    def _path(self, tokens: list[int], end: int) -> list[int]:
        out, size = [], self.size
        while end:
            out.append(t := tokens[end - 1])
            end -= size[t]
        return out[::-1]

    def pieces(self, piece: bytes) -> Iterator[list[int]]:
        """The tokens of one piece, in runs: each as soon as it is settled, looked at once in STRIDE bytes."""
        node, tokens = 0, []
        for i in range(0, len(piece), self.STRIDE):
            node = self._read(piece[i : i + self.STRIDE], node, tokens)
            if at := self._settled(tokens, node):
                yield self._path(tokens, at)
                del tokens[:at]
        yield self._path(tokens, len(tokens))

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece. A piece that is an entry is that entry, as in the public library."""
        if (r := self.ranks.get(piece)) is not None:
            return (r,)
        if len(piece) > self.STRIDE:
            return tuple(t for run in self.pieces(piece) for t in run)
        self._read(piece, 0, tokens := [])
        return tuple(self._path(tokens, len(tokens)))


class _Pieces(dict):
    """The tokens of pieces already met, in two generations of `most` pieces at most.

    When the young one is full, the old one is dropped and the young one becomes the old; a piece found there is young
    again, so frequent pieces stay. Long pieces are not kept.
    """

    def __init__(self, fst: Transducer, most: int):
        super().__init__()
        self.fst, self.most, self.old = fst, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.old.get(piece)
        if out is None:
            out = self.fst.encode_piece(piece.encode("utf-8", "replace"))
            if len(piece) > 64:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class Encoder:
    """Splits texts by a pattern and encodes each piece. max_pieces bounds the memory of pieces already met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = 240_000):
        self.find, self.fst = regex.compile(pattern).findall, Transducer(ranks)
        self.pieces = _Pieces(self.fst, max_pieces)
        self.whole = StreamDecoder.whole_tokens(self.fst.bytes_of)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text or ""))))


class StreamDecoder:
    """Turns tokens into text as they come. Bytes of a character that is not complete wait; bytes that can't be UTF-8 become U+FFFD.

    The automaton works on whole tokens: its state is the unfinished character's bytes (three at most), and a
    transition, found from the byte automaton when first needed, gives the text to emit and the bytes that wait.
    """

    def __init__(self, bytes_of: dict[int, bytes], whole: dict[int, str] | None = None):
        self.bytes_of, self.steps, self.wait = bytes_of, {}, b""
        self.whole = self.whole_tokens(bytes_of) if whole is None else whole

    @staticmethod
    def whole_tokens(bytes_of: dict[int, bytes]) -> dict[int, str]:
        """The transitions from the state in which nothing waits back to itself: tokens of whole characters."""
        out = {}
        for t, b in bytes_of.items():
            try:
                out[t] = b.decode()
            except UnicodeDecodeError:
                pass
        return out

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that may yet be completed."""
        for n in range(1, min(3, len(data)) + 1):
            lead, second = data[-n], data[len(data) - n + 1] if n > 1 else None
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            return n if n < need and (second is None or low <= second <= high) else 0
        return 0

    def feed(self, token: int) -> str:
        if (t := self.steps.get((self.wait, token))) is None:
            data = self.wait + self.bytes_of[token]
            n = self.unfinished(data)
            t = self.steps[self.wait, token] = data[: len(data) - n].decode("utf-8", "replace"), data[len(data) - n :]
        self.wait = t[1]
        return t[0]

    def end(self) -> str:
        out, self.wait = self.wait.decode("utf-8", "replace"), b""
        return out

    def decode(self, tokens: Iterable[int]) -> str:
        """All tokens' text. While nothing waits, tokens of whole characters, which all have the transition back to that state, are taken as a run."""
        out, rest = [], iter(tokens)
        while True:
            for t in rest if self.wait else ():
                out.append(self.feed(t))
                if not self.wait:
                    break
            try:
                out.extend(map(self.whole.__getitem__, rest))
            except KeyError as e:  # the first token that leaves the state
                out.append(self.feed(e.args[0]))
            else:
                return "".join([*out, self.end()])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def _encoder(vocabulary: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(vocabulary), pattern)


def encoder(vocabulary: str, pattern: str) -> Encoder:
    """The process's encoder for a rank file, which every node must have at that path."""
    return _encoder(vocabulary, pattern)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df and a column of the token ids of each whole text."""
    return add_columns(df, text, [(ids, T.ArrayType(T.IntegerType()))], lambda values: ((encoder(vocabulary, pattern).encode(x),) for x in values))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df and a column of the text that the ids stand for; bytes that are not UTF-8 become U+FFFD, a null becomes empty."""

    def work(values: list) -> Iterator[tuple]:
        e = encoder(vocabulary, pattern)
        d = StreamDecoder(e.fst.bytes_of, e.whole)
        return ((d.decode(x or ()),) for x in values)

    return add_columns(df, ids, [(text, T.StringType())], work)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", drop: bool = False) -> DataFrame:
    """encode() and decode() in one crossing to Python; with drop, without the text."""

    def work(values: list) -> Iterator[tuple]:
        e = encoder(vocabulary, pattern)
        d = StreamDecoder(e.fst.bytes_of, e.whole)
        for x in values:
            yield (t := e.encode(x)), d.decode(t)

    return add_columns(df, text, [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType())], work, drop)


def digests(df: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, the number of tokens, and digests of the ids and of what they decode to."""
    both = round_trip(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), vocabulary, pattern, drop=True)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
