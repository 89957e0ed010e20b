import zlib

import numpy as np
import pytest
from cases import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import dac, packing, tokens
from tessera.llm.queries import BYTE_BPE, WORD_BPE
from tessera.llm.tokens import Encoder, forget, slices

PIECES = ["a", "the", "Bridge", "naïve", " ", "  ", "\n", "\t", ",", "...", "!!", "'s", "don't", "~", "12", " ", "\x1c", "\x01", "é", "é", "Σ", "ΑΣ", "İ", "ß", "<|endoftext|>", "<|startoftext|>", "漢字", "🙂"]
ENCODERS = {}


def plain(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=12))
def test_cached_pieces_give_the_library_ids(path, texts):
    of = ENCODERS.setdefault(path, Encoder(path))
    assert [np.frombuffer(x, "<u4").tolist() for x in of.ids(texts)] == plain(path, texts)


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_long_texts_are_cut_safely(path, monkeypatch):
    text = " ".join(t for _, t, *_ in rows() if t and "<|" not in t) + "  \n"
    text = (text + " ") * 20
    assert "".join(slices(text, 1000)) == text
    want = plain(path, [text, "", "short"])
    for size in (1000, 10**7):
        monkeypatch.setattr(tokens, "SLICE", size)
        assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).ids([text, None, "short"])] == want
    forget(path)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(0, 10))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip_and_give_any_id(ids, shift):
    ids = [i >> (3 * shift) for i in ids]
    codes = dac.Codes.from_bytes(dac.Codes.of(np.array(ids, "<u4")).to_bytes())
    assert codes.all().tolist() == ids
    assert [codes[i] for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_segments():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 700)]
    keys, sizes, codes = dac.read_segment(dac.segment([5, None, -1], ids))
    assert keys == [5, None, -1] and sizes.tolist() == [3, 0, 700] and codes[702] == 699
    with pytest.raises(ValueError):
        dac.read_segment(b"else" + bytes(20))


@pytest.mark.parametrize("segment_ids", [50, dac.SEGMENT])
def test_token_files(spark, segment_ids):
    out = [tuple(r) for r in dac.read_digests(dac.write_segments(documents(spark), BYTE_BPE, segment_ids=segment_ids)).collect()]
    docs = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [x + [0] for x in plain(BYTE_BPE, [r[1] for r in docs])]
    want = sorted((str(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, *_), x in zip(docs, ids))
    assert sorted((str(d), n, c) for d, _, n, c in out) == want
    out.sort(key=lambda r: r[1])
    assert [r[1] for r in out] == np.cumsum([0, *[r[2] for r in out]])[:-1].tolist()
    assert [r[0] for r in out] == [r[0] for r in docs]
    assert dac.token_file_digest(empty(spark), BYTE_BPE).collect() == []


def brute_best_fit(lengths, window):
    rooms, out = [], []
    for n in lengths:
        fit = [(r, -i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            r, i = min(fit)
            rooms[-i] -= n
            out.append(window - r)
        else:
            rooms.append(window - n)
            out.append(0)
    return len(rooms), sorted(rooms), out


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=100, deadline=None)
def test_best_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    at, offsets = packing.best_fit_decreasing(np.array(lengths, int), 64)
    used = {}
    for a, o, n in zip(at.tolist(), offsets.tolist(), lengths):
        assert used.get(a, 0) == o
        used[a] = o + n
    count, rooms, _ = brute_best_fit(lengths, 64)
    assert len(used) == count and sorted(64 - u for u in used.values()) == rooms


@pytest.mark.parametrize("bucket_pieces", [5, packing.BUCKET_PIECES])
def test_packing(spark, bucket_pieces):
    window = 128
    found = packing.pieces(documents(spark), WORD_BPE, window=window, with_ids=True)
    out = packing.pack(found, window, bucket_pieces)
    got = [r.asDict() for r in out.collect()]
    ids = [x + [2] for x in plain(WORD_BPE, [r[1] for r in rows()])]
    want = sorted((str(r[0]), s, x[s : s + window]) for r, x in zip(rows(), ids) for s in range(0, len(x), window))
    assert sorted((str(r["doc_id"]), r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= window
    windows = packing.packed_windows(out, window).collect()
    assert len(windows) == len(by) and all(len(w.ids) == 4 * window for w in windows)
    assert packing.pack_documents(empty(spark), WORD_BPE).collect() == []
