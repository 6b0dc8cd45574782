"""Byte-level BPE against a plain restatement: split by the pattern, then merge the pair of least rank."""

import hashlib

import public_tokenizers as P
import pytest
import regex
from hypothesis import given, settings, strategies as st

from logspark.llm.bpe import SAFE, chunks, decode, encode, encode_text, encoding
from logspark.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n  x", "don't we'll I'M 's", "a  b\t\tc \n", "naïve 漢字 🤷🏽 é", "tab\tend ", " 　 x", "x" * 5000, "12345678 " * 500,
       " " * 999 + "a", "<|endoftext|> stays text", "\x1c\x1d x\x85y", "word " * 20_000, "!?" * 3000, "\r\n" * 700 + "z"]


@pytest.fixture(scope="module")
def enc():
    return encoding(PATH, P.PATTERN)


def merged(ranks, piece):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def plain(enc, text):
    return [i for m in regex.findall(P.PATTERN, text or "") for i in merged(enc._mergeable_ranks, m.encode())]


def test_ids_equal_a_plain_restatement_and_decode_to_the_text(sp, texts, enc):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, "no id")]
    out = decode(encode(texts(rows, extra=True), PATH, P.PATTERN), PATH, P.PATTERN)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "id", "n", "marks", "_found", "rid", "words", "ids", "decoded"]
    for r in got:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        if len(r["text"] or "") < 6000 and "\x1c" not in (r["text"] or ""):
            assert r["ids"] == plain(enc, r["text"])
        assert r["ids"] == enc.encode_ordinary(r["text"] or "")


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t\r'sltv abZ09.!  \x1c\x85é漢")) | st.characters(exclude_categories=["Cs"]), max_size=120))
def test_cuts_never_change_ids(text):
    enc = encoding(PATH, P.PATTERN)
    for size in (1, 3, 10):
        assert "".join(chunks(text, size)) == text
        assert encode_text(enc, text, size) == enc.encode_ordinary(text)


def test_chunks_of_long_texts_are_bounded(enc):
    text = "ab cd, efg\n" * 200_000
    sizes = [len(c) for c in chunks(text, 1000)]
    assert max(sizes) < 1010 and sum(sizes) == len(text)
    assert len(list(chunks("y" * 5000, 100))) == 1 and SAFE.search("a b")


def test_ids_without_bytes_and_empty_tables(sp, texts):
    bad = sp.createDataFrame([(1, [0, 60_000]), (2, None), (3, []), (4, [None]), (5, [72, -1])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in decode(bad, PATH, P.PATTERN).collect()} == {1: None, 2: None, 3: b"", 4: None, 5: None}
    assert encode(texts([]), PATH, P.PATTERN).collect() == []


def test_op11_digests(sp, enc, tmp_path):
    sp.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op11_byte_bpe"](sp, str(tmp_path)).collect()}
    for i, t in enumerate(ODD):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
