"""Secrets in texts: three kinds by their form, and random strings by how badly a tokenizer compresses them.

A vocabulary made from text has long tokens for what people write. A random string falls apart into tokens of one or two
characters, so its characters per token are few. Strings of known form that look random and are no secrets, such as
digests, UUIDs, numbers and names made of words, are put aside first.

What the token test looks at: runs of letters, digits and + / _ = - that hold a letter and have `shortest` characters or
more (8 by default, a parameter; runs of digits and signs alone are numbers), and, where dots join several of which none
is random by itself, all of them together. Few characters tell less than many, so the limit rises smoothly with the length
n, as 1 - 1.6 / n. A name is a run whose parts between signs are each a word in small letters or camel case, or in capitals,
with up to four digits after it; as short words of any language look alike, its letters are held against a limit that rises
as 1 - 25 / n^2: of 8 letters in one case none count as random, of 16 most. All tests take time in proportion to a run's
length.

Cases: null and empty texts have no spans; whole texts of any length are read; positions count code points and the end
is exclusive; spans of one kind never overlap; repeated rows give equal results; an empty table gives an empty table;
other columns are kept, and one named as a result gives way to it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.bpe import Encoder, encoder
from sparkwright.llm.shared import add_columns, check_columns, fresh

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Runs that the test looks at, and those of them that are set aside: digests by length, UUIDs, and names of plain or joined words and short numbers, if their words compress.
SIGN = r"[A-Za-z0-9+/_=.-]"
PARTS = re.compile(r"[^.]+")
LETTER = re.compile(r"[A-Za-z]")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
SIGNS = re.compile(r"[+/_=.-]+")
WORD = re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)?[0-9]{0,4}")
RUNS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the kinds known by form, leftmost first and without overlap within a kind; matches too short are dropped."""
    out, small = [], text.lower()
    if any(w in small for w in _WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _named(s: str) -> bool:
    """Whether each part between signs is a word, a short number or both."""
    return all(map(WORD.fullmatch, SIGNS.split(s)))


def _plain(name: str, enc: Encoder, limit: float) -> bool:
    """Whether a name's letters compress. Words in capitals have few tokens of their own and are tried in small letters: short ones count so if that is one token."""
    runs, tokens = RUNS.findall(name), 0
    for r in runs:
        n = len(enc.encode(r))
        if n > 1 and len(r) > 2 and r.isupper() and ((small := len(enc.encode(r.lower()))) == 1 or len(r) > 5):
            n = min(n, small)
        tokens += n
    letters = sum(map(len, runs))
    return letters < 6 or letters >= limit * tokens


@functools.cache
def strings(shortest: int) -> re.Pattern:
    """Whole runs of at least so many signs."""
    return re.compile(f"(?<!{SIGN}){SIGN}{{{shortest},}}")


class Judge(dict):
    """Whether strings are random: have so few characters per token that they are no writing. Of short strings, some 50,000 verdicts are kept."""

    def __init__(self, enc: Encoder, most: float, known: frozenset[str]):
        self.enc, self.most, self.known = enc, most, known

    def __missing__(self, s: str) -> bool:
        n = len(s)
        out = n < self.most * (1 - 1.6 / n) * len(self.enc.encode(s)) and self._counts(s)
        if n <= 40:
            if len(self) >= 50_000:
                self.clear()
            self[s] = out
        return out

    def _counts(self, s: str) -> bool:
        """Not so for strings without letters, known ones, digests and ids, and what is shaped as a name, if its letters are few or compress."""
        if not LETTER.search(s) or s in self.known or DIGEST.fullmatch(s) or UUID.fullmatch(s):
            return False
        return not (_named(s) and _plain(s, self.enc, self.most * (1 - 25 / len(s) ** 2)))


def random_spans(text: str, judge: Judge, shortest: int = 8) -> list[tuple[str, int, int]]:
    """Random strings. Of parts joined by dots those that are, or else the whole if that is."""
    out = []
    for m in strings(shortest).finditer(text):
        s = m[0]
        if "." not in s:
            if judge[s]:
                out.append(("random", *m.span()))
            continue
        at = m.start()
        parts = [p.span() for p in PARTS.finditer(s)]
        found = [(a, b) for a, b in parts if b - a >= shortest and judge[s[a:b]]]
        if not found and len(parts) > 1:
            a, b = parts[0][0], parts[-1][1]
            found = [(a, b)] if b - a >= shortest and judge[s[a:b]] else []
        out += [("random", a + at, b + at) for a, b in found]
    return out


def spans(text: str | None, judge: Judge, shortest: int = 8) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind. A random string that meets a span known by form is left to that."""
    if not text:
        return []
    out = base_spans(text)
    taken, k = sorted((a, b) for _, a, b in out), 0
    reach = list(accumulate((b for _, b in taken), max))  # how far the spans up to each one reach
    for s in random_spans(text, judge, shortest):  # by start and without overlap, so k only grows
        while k < len(taken) and taken[k][0] < s[2]:
            k += 1
        if not k or reach[k - 1] <= s[1]:
            out.append(s)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@functools.lru_cache(2)
def _judge(vocabulary: str, pattern: str, most: float, known: frozenset[str]) -> Judge:
    """The process's, as a Python worker judges many slices."""
    return Judge(encoder(vocabulary, pattern), most, known)


def scan(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", found: str = "secrets", most: float = 2.0, known: Iterable[str] = (), shortest: int = 8, drop: bool = False) -> DataFrame:
    """df and a column of the spans of each whole text: array of (kind, start, end).

    most: strings with fewer characters per token than this count as random. known: strings, few, that are no secrets.
    shortest: strings of fewer characters are not put to the token test. drop: without the text.
    """
    known = frozenset(known)

    def work(values: list):
        judge = _judge(vocabulary, pattern, most, known)
        return (([{"kind": k, "start": a, "end": b} for k, a, b in spans(x, judge, shortest)],) for x in values)

    return add_columns(df, text, [(found, SPANS)], work, drop)


def redact(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", mark: str = "[SECRET]", most: float = 2.0, known: Iterable[str] = (), shortest: int = 8) -> DataFrame:
    """df with each span of its texts, overlapping ones joined, replaced by the mark. Other texts, and nulls, stay as they are."""
    known = frozenset(known)

    def work(values: list):
        judge = _judge(vocabulary, pattern, most, known)
        for x in values:
            found, out, at = spans(x, judge, shortest), [], 0
            for _, a, b in found:
                if a >= at:
                    out += [x[at:a], mark]
                at = max(at, b)
            yield ("".join([*out, x[at:]]) if found else x,)

    check_columns(df, [text])
    name = fresh(df, "redacted")
    new = add_columns(df, text, [(name, T.StringType())], work, drop=True)
    return new.select(*(new[name].alias(c) if c.lower() == text.lower() else new[c] for c in df.columns))


def report(df: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, counts of the kinds known by form, a digest of their spans, and all spans as a string."""
    found = scan(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), vocabulary, pattern, drop=True)
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    line = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(line(of(*KINDS[:3])), 256).alias("base_sha256"),
        line(F.col("secrets")).alias("spans"),
    )
