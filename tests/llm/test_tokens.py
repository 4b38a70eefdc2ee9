import io
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lonewood.llm import tokenfile, tokens
from lonewood.llm.packing import best_fit, pack, pack_documents
from lonewood.llm.tokenfile import TokenFile, Writer, read_tokens, write_tokens
from lonewood.llm.tokens import Encoder
from llm_cases import DOCS, ODD, make_docs  # noqa: F401

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TRICKY = ["", " ", "  a  b\n\n c ", "it's we'll I'D 'S ''s !!'s", "x²½ ªº 12a3", "tab\there\r\n\x0b\x0c x", "İstanbul ß", "<|endoftext|> hi<|startoftext|>", "é é", "a\xa0b\x85c", "'s", "a_b__c", "x 's 't"]


def library(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_ids_equal_the_library(name, texts):
    texts = texts + random.Random(len(texts)).sample(TRICKY, 3)
    ids, counts = Encoder(public_tokenizers.path(name), cache=50).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library(name, texts)


def test_places_of_cuts_equal_the_pattern():
    """Pieces cut by the kinds of characters are those that the pattern matches."""
    find, rng = re.compile(tokens._PATTERNS["spaces"]).findall, random.Random(1)
    letters = "  \n\t sstmdrevlRa1é²,.×ſß"
    for _ in range(5000):
        texts = ["".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(3)]
        text, ends = "".join(texts), np.cumsum([0, *map(len, texts)])
        points = np.array([ord(c) for c in text], np.uint16)
        at = tokens.cuts(points, ends[ends > 0]).tolist() if text else [0]
        assert [text[a:b] for a, b in zip(at, at[1:])] == [p for t in texts for p in find(t)], texts


def test_a_piece_is_looked_up_once_a_group():
    e, asked = Encoder(public_tokenizers.path("byte_bpe_50k.json")), []

    class Counting(type(e.known)):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    e.known = Counting()
    ids, counts = e.encode(["the cat and the dog and the cat", "", " the cat"])
    assert sorted(asked) == [" and", " cat", " dog", " the", "the"]
    assert counts.tolist() == [8, 0, 2] and ids[-2:].tolist() == ids[6:8].tolist()


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library_unchanged(spark, make_docs, name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = TRICKY + [f"{a}{t.content.upper() if k else t.content}{a}b c" for t in plain.get_added_tokens_decoder().values() for a in ("", " ", "a", "é", "日 ") for k in (0, 1)]
    texts += ["a <|endoftext|> b", "<|endoftext|", "endoftext <| endoftext |>", "a <|endoftext|><|endoftext|>\n", "some words"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = Encoder(path, cache=50, special=True).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    packed = pack_documents(make_docs(texts), path, keep=["doc_id"], ids=True).collect()
    assert {r.doc_id: r.ids[:-1] for r in packed} == dict(enumerate(want))
    stored = read_tokens(write_tokens(make_docs(texts), path), ids=True).collect()
    assert {r.doc_id: r.ids[:-1] for r in stored} == dict(enumerate(want))


def slow_best_fit(lengths, limit):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            g = min(fits)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(limit - n)
    return sorted(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_runs_pack_like_best_fit_decreasing(lengths):
    plan = best_fit({n: lengths.count(n) for n in set(lengths)}, 30)
    fill = {}
    for n, length, first, each, offset in plan.tolist():
        for i in range(n):
            fill.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert sorted(x for s in fill.values() for _, x in s) == sorted(lengths)
    for s in fill.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 30
    assert sorted(30 - sum(n for _, n in s) for s in fill.values()) == slow_best_fit(lengths, 30)


def test_packed_documents(spark, make_docs):
    texts = ODD + ["some words " * k for k in range(40)]
    rows = pack_documents(make_docs(texts), public_tokenizers.path(FILES[0]), keep=["doc_id", "lang"], limit=100, ids=True).collect()
    want = {i: [*x, 0] for i, x in enumerate(library(FILES[0], texts))}
    pieces = {}
    for r in rows:
        assert r.ids == want[r.doc_id][r.start:r.start + r.length] and r.start == 100 * r.piece and r.lang == "en"
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(n for s in pieces.values() for _, n in s) == sum(map(len, want.values()))
    for s in pieces.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)]])[:-1].tolist() and sum(n for _, n in s) <= 100
    lengths = [n for s in pieces.values() for _, n in s]
    assert len(pieces) == len(slow_best_fit(lengths, 100))


def test_pack_edge_cases(spark):
    assert pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0
    same = pack(spark.createDataFrame([(1, 700)] * 300, "doc_id long, length long")).collect()
    assert len({(r.sequence_id, r.offset) for r in same}) == 300 and len({r.sequence_id for r in same}) == 150
    for bad in (0, None, 2049):
        with pytest.raises(ValueError):
            pack(spark.createDataFrame([(1, bad)], "doc_id long, length long"))
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 1)], "offset long, length long"))
    assert pack_documents(spark.createDataFrame([], DOCS), public_tokenizers.path(FILES[0])).count() == 0


def test_token_files_round_trip(spark, make_docs, tmp_path):
    texts = ODD + ["some words " * k for k in range(50)]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(None, "no id"), (500, "twice"), (500, "twice")]
    files = write_tokens(make_docs(rows).repartition(3), public_tokenizers.path(FILES[1]), folder=str(tmp_path / "t"), file_ids=2000)
    assert files.count() > 3
    got = sorted(read_tokens(files, ids=True).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, _), ids in zip(got, order, library(FILES[1], [t for _, t in order]), strict=True):
        assert (r.doc_id, r.start, r.ids) == (i, at, [*ids, 2])
        assert (r.n_tokens, r.ids_crc32) == (len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += r.n_tokens
    assert read_tokens(write_tokens(spark.createDataFrame([], DOCS), public_tokenizers.path(FILES[1]))).count() == 0


def test_frames_are_independent_and_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_IDS", 10)
    path = str(tmp_path / "x.zst")
    w = Writer(path)
    docs = [np.arange(n, dtype=np.uint32) + n for n in (0, 5, 10, 37)]
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    f = TokenFile(path)
    assert [f.document(k).tolist() for k in (3, 0, 2, 1)] == [docs[k].tolist() for k in (3, 0, 2, 1)]
    data = open(path, "rb").read()
    # any zstd reader sees one stream: skippable frames are skipped
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u4").tolist() == np.concatenate(docs).tolist()
    assert struct.unpack("<IBI", data[-9:]) == (len(f.entries), 0x80, 0x8F92EAB1)
    entries = f.entries.copy()
    entries[2, 2] ^= 1
    f.entries = entries
    f.document(1)
    with pytest.raises(ValueError):
        f.document(2)
    open(path, "wb").write(data[:-1])
    with pytest.raises(ValueError):
        TokenFile(path)
