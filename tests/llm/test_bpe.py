import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from sparkwright.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    e = bpe.encoder(PATH, P.PATTERN)
    return e, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.fst.ranks, special_tokens={})


def test_like_the_public_library(both):
    e, t = both
    r = random.Random(1)
    letters = [chr(r.randrange(1, 0x3000)) for _ in range(300)] + list("aeiou thern.  \n'sdl1234\t😀") * 12
    for _ in range(4000):
        s = "".join(r.choices(letters, k=r.randrange(0, 80)))
        assert e.encode(s) == t.encode_ordinary(s), s


def test_pieces_of_any_bytes(both):
    e, t = both
    r, entries = random.Random(2), list(e.fst.ranks)
    for _ in range(4000):
        p = b"".join(r.choices(entries, k=r.randrange(1, 7)))
        if p not in e.fst.ranks:
            assert list(e.fst.encode_piece(p)) == t._encode_single_piece(p)


def test_long_piece_is_emitted_in_runs(both):
    e, t = both
    s = "".join(random.Random(3).choices("abcdefgh", k=30_000))
    runs = list(e.fst.pieces(s.encode()))
    assert len(runs) > 3 and [x for r in runs for x in r] == t.encode_ordinary(s)
    assert all(len(r) < 3000 for r in runs)


def test_what_is_kept_is_bounded(both):
    fst = bpe.Transducer(both[0].fst.ranks, max_steps=50, max_pairs=50)
    r = random.Random(4)
    for s in ("thnttionble", "ononononandthe", "z" * 9000, "ünïcödé", *("".join(r.choices("etaoinsrhld", k=12)) for _ in range(500))):
        assert list(fst.encode_piece(s.encode())) == both[1]._encode_single_piece(s.encode())
    assert len(fst.step) <= 50 and len(fst.step.states) <= 50 and len(fst.pair) <= 50


def test_no_more_states_than_trie_nodes(both):
    """And each is the set of all ends that are open: the deepest node's suffixes in the trie."""
    fst = both[0].fst
    spelled = {0: b""}
    for key, to in sorted(fst.step.trie.items(), key=lambda x: fst.depth[x[1] >> 8]):
        spelled[to >> 8] = spelled[key >> 8] + bytes([key & 255])
    by = {v: k for k, v in spelled.items()}
    r, node, text = random.Random(5), 0, b""
    for byte in "".join(r.choices("etaoinsrhld ", k=3000)).encode():
        node, ends = fst.step[node | byte]
        text = (text + bytes([byte]))[-200:]
        suffixes = [text[k:] for k in range(len(text)) if text[k:] in by]
        assert spelled[node >> 8] == suffixes[0]
        assert [t for t, _ in ends] == [fst.entry[by[s]] for s in suffixes if fst.entry[by[s]] >= 0]
    assert len(fst.step.states) <= len(fst.entry)


def test_stream_decoder(both):
    e, _ = both
    d = bpe.StreamDecoder(e.fst.bytes_of)
    text = "né 😀 中文 end"
    one = {b: i for i, b in e.fst.bytes_of.items() if len(b) == 1}
    out = [d.feed(one[bytes((b,))]) for b in text.encode()]
    assert all("\ufffd" not in x for x in out) and "".join(out) + d.end() == text
    for raw in (b"ab\xff\xe2\x82\xaccd", b"\xe2\x82\xac\xe2ok", b"\xff", b"\xe2\x82", b"\xed\xa0\x80", b"a\xc3", b"\xf0\x9f\x98", b"\xc0\xaf"):
        assert d.decode([one[bytes((b,))] for b in raw]) == raw.decode("utf-8", "replace")


def test_frame(spark, both):
    e, t = both
    long = "palabra la de " * 40_000
    rows = [(1, "one text", "x"), (2, None, None), (3, "", "y"), (1, "one text", "x"), (4, long, "z"), (None, "no id", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing name
    out = bpe.digests(df, PATH, P.PATTERN).collect()
    assert len(out) == 6
    for r in out:
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        ids = t.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = bpe.encode(df, PATH, P.PATTERN)
    assert kept.columns == ["doc_id", "text", "ids"]
    back = bpe.decode(kept, PATH, P.PATTERN).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.digests(df.filter("false"), PATH, P.PATTERN).count() == 0


def test_missing_column(spark):
    with pytest.raises(ValueError, match="text"):
        bpe.encode(spark.range(1), PATH, P.PATTERN)


def test_many_pieces_are_kept():
    """200,000 different pieces, read twice, are made once."""
    e = bpe.Encoder({bytes([i]): i for i in range(256)}, r"\S+")
    made, old = [0], e.fst.encode_piece

    def count(piece):
        made[0] += 1
        return old(piece)

    e.fst.encode_piece = count
    text = " ".join(map(str, range(200_000)))
    assert e.encode(text) == e.encode(text) and made[0] == 200_000
