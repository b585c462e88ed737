import hashlib
import re

import public_tokenizers as P
import pytest

from sparkwright.llm import bpe, secrets

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ARGS = (PATH, P.PATTERN)


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(*ARGS)


def found(text, enc):
    return secrets.spans(text, secrets.Judge(enc, 2.0, frozenset()))


def test_base_kinds():
    key, digest = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2
    for text, want in [
        ("password=short", []),
        ("password = 'longenough1'", [("assign", 0, 23)]),
        ('PassWD": "abcdefgh" x', [("assign", 0, 18)]),
        ("Api_Key:abcdefgh apikey=ABCDEFGH1", [("assign", 0, 16), ("assign", 17, 33)]),
        (f"x {key} y", [("access", 2, 22)]),
        ("AKIA12345678901", []),
        (f"é {digest}", [("hex", 2, 34)]),
        (digest[:31], []),
        (f"token={digest}", [("assign", 0, 38), ("hex", 6, 38)]),
        ("ſecret=abcdefgh", []),
    ]:
        assert secrets.base_spans(text) == want, text


def test_random_strings(enc):
    assert found("see zQ3xV9kLp0RtW7bN2mYc here", enc) == [("random", 4, 24)]
    for clean in ("d41d8cd98f00b204e9800998ecf8427e".upper(), "123e4567-e89b-12d3-a456-426614174000", "chapter_12-of-the-long-story", "internationalization2024", "the longest of ordinary words", "12345678901234567890123"):
        assert found(clean, enc) == [], clean
    assert secrets.spans("zQ3xV9kLp0RtW7bN2mYc", secrets.Judge(enc, 2.0, frozenset(["zQ3xV9kLp0RtW7bN2mYc"]))) == []


def test_against_plain_scan(spark, small, enc):
    assign = re.compile(secrets.ASSIGN.pattern, re.I | re.A)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in secrets.report(docs, *ARGS).collect():
        t = texts[r.doc_id]
        base = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        base.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in secrets.KINDS[:3]]
        assert {x for x in line.split(",") if x} <= set(r.spans.split(","))


def test_cases(spark, enc):
    long = "word " * 300_000 + "password=abcdefgh1 tail"
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, long, 1), (3, long, 1), (None, "token: abcdefghij", 1)], "doc_id long, text string, secrets int")
    out = {(r.doc_id, r.n_assign, r.spans) for r in secrets.report(df, *ARGS).collect()}
    assert out == {(1, 0, ""), (2, 0, ""), (3, 1, "assign:1500000:1500018"), (None, 1, "assign:0:17")}
    red = secrets.redact(df, *ARGS)
    assert red.columns == df.columns
    texts = [r.text for r in red.orderBy("doc_id").collect()]
    assert texts[0] == "[SECRET]" and texts[1] is None and texts[2] == "" and texts[3].endswith("word [SECRET] tail")
    assert secrets.report(df.filter("false"), *ARGS).count() == 0


def test_misses_and_false_alarms(enc):
    """Random strings of letters, short ones and licence keys are found; names of ordinary words are not."""
    import random
    import string

    r = random.Random(4)
    pick = lambda a, n: "".join(r.choice(a) for _ in range(n))
    lower, upper, both, digits = string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.digits
    kinds = [
        (lambda: pick(lower, r.randrange(17, 38)) + pick(digits, 3), 0.04),
        (lambda: "-".join(pick(upper, 4) for _ in range(3)) + "-" + pick(digits, 4), 0.02),
        (lambda: pick(both, r.randrange(20, 41)), 0.01),
        (lambda: pick(both + digits, 16), 0.01),
        (lambda: pick(lower, 16), 0.12),
    ]
    for make, most in kinds:
        assert sum(not found(make(), enc) for _ in range(1000)) <= most * 1000
    words = "account address balance channel customer document element failure handler internal language message network operation password parameter position request response service session station transfer version window".split()
    shapes = [lambda w: "".join(w), lambda w: "".join(x.title() for x in w), lambda w: "_".join(w) + "_2024", lambda w: "_".join(w).upper(), lambda w: "/".join(w)]
    for shape in shapes:
        assert not any(found(shape(r.sample(words, 3)), enc) for _ in range(300))


def test_by_length(enc, small, spark):
    """Misses of random strings, by length from 8 characters up; strings in dots; false alarms among the words of whole documents."""
    import random
    import string

    r = random.Random(6)
    pick = lambda a, n: "".join(r.choice(a) for _ in range(n))
    both = string.ascii_letters + string.digits
    for n, most in ((8, 0.12), (9, 0.05), (10, 0.02), (12, 0.02), (14, 0.02), (15, 0.02), (16, 0.01), (24, 0.01)):
        assert sum(not found(pick(both, n), enc) for _ in range(1000)) <= most * 1000, n
    for size in (4, 5, 7, 15):
        assert sum(not found(".".join(pick(both, size) for _ in range(3)), enc) for _ in range(500)) <= 10, size
    assert found("www.example.com/index.html, version 2.14.0-beta1, and so on...then.More", enc) == []
    texts = [x.text for x in spark.read.parquet(f"{small}/documents.parquet").collect() if x.text]
    spans = [(x, s) for x in texts for s in secrets.random_spans(x, secrets.Judge(enc, 2.0, frozenset()))]
    assert sum(x[a:b].isalpha() for x, (_, a, b) in spans) <= 5


@pytest.mark.parametrize("sign", ["=", "-", "_", "+/", "aB", "a1", "A-", "1"])
def test_rulers_take_linear_time(enc, sign):
    import time

    began = time.time()
    for n in (23, 80, 10_000):
        text = f"text {sign * n}a12345 text and {sign * n}"
        assert found(text, enc) == plain_random(text)
    assert time.time() - began < 5


def test_many_spans_take_linear_time(enc):
    import time

    text = " ".join(f"{k:032x} zQ3xV9kLp0RtW7bN2mYc{k}" for k in range(20_000))
    began = time.time()
    assert len(found(text, enc)) == 40_000
    assert time.time() - began < 20


def plain_random(text):
    """The random spans, and those of hex digits, by going through the text sign by sign, with the public library's tokens."""
    import tiktoken

    global _library
    if "_library" not in globals():
        _library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    count = lambda s: len(_library.encode_ordinary(s))
    letters = "abcdefghijklmnopqrstuvwxyz"

    def random_(s):
        hexed = s.lower().strip("0123456789abcdef") == "" and len(s) in (32, 40, 56, 64, 96, 128)
        uuid = [len(x) for x in s.split("-")] == [8, 4, 4, 4, 12] and s.lower().replace("-", "").strip("0123456789abcdef") == ""
        if len(s) < 8 or hexed or uuid or not any(c.isalpha() for c in s):
            return False
        name = plain_name(s) and plain_letters(s, count, 2.0 * (1 - 25 / len(s) ** 2))
        return len(s) < 2.0 * (1 - 1.6 / len(s)) * count(s) and not name

    base = [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    out, at = list(base), 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in letters + letters.upper() + "0123456789+/_=-.":
            end += 1
        pieces, k = [], at
        for piece in text[at:end].split("."):
            if piece:
                pieces.append((k, k + len(piece)))
            k += len(piece) + 1
        found = [(a, b) for a, b in pieces if random_(text[a:b])]
        if not found and len(pieces) > 1 and random_(text[pieces[0][0] : pieces[-1][1]]):
            found = [(pieces[0][0], pieces[-1][1])]
        out += [("random", a, b) for a, b in found if not any(x < b and a < y for _, x, y in base)]
        at = max(end, at + 1)
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def parts(s, keep):
    """The longest stretches of s of which each sign is in keep."""
    return "".join(c if c in keep else " " for c in s).split()


def plain_name(s):
    letters = "abcdefghijklmnopqrstuvwxyz"
    for part in parts(s, letters + letters.upper() + "0123456789"):
        word = part.rstrip("0123456789")
        if len(part) - len(word) > 4 or not all(c.isalpha() for c in word):
            return False
        camel = word and word[-1].islower() and not any(a.isupper() and b.isupper() for a, b in zip(word, word[1:], strict=False))
        if not (word == "" or word.isupper() or camel):
            return False
    return True


def plain_letters(s, count, limit):
    runs, now = [], ""
    for c in s + " ":
        join = now and c.isalpha() and (c.isupper() == now[-1].isupper() or (len(now) == 1 and now.isupper()))
        if join or (not now and c.isalpha()):
            now += c
        else:
            if now:
                runs.append(now)
            now = c if c.isalpha() else ""
    tokens = 0
    for r in runs:
        n = count(r)
        if n > 1 and len(r) > 2 and r.isupper() and (count(r.lower()) == 1 or len(r) > 5):
            n = min(n, count(r.lower()))
        tokens += n
    return sum(map(len, runs)) < 6 or sum(map(len, runs)) >= limit * tokens


def test_random_spans_like_plain(small, spark, enc):
    import random
    import string

    r = random.Random(8)
    signs = string.ascii_letters * 2 + string.digits + "+/_=-."
    made = ["".join(r.choice(signs[:k]) for _ in range(r.randrange(6, 40))) for k in (26, 52, 114, 120) for _ in range(300)]
    made += ["_".join(r.choice(("order", "Total", "SUM", "x1", "a2b", "2024", "")) for _ in range(6)) for _ in range(300)]
    texts = [" . ".join(made), *made, *(x.text for x in spark.read.parquet(f"{small}/documents.parquet").collect() if x.text)]
    for t in texts:
        got = found(t, enc)
        if not {"assign", "access"} & {s[0] for s in got}:  # the plain version knows of no others
            assert got == plain_random(t)
