from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import id_coder, queries, token_file
from weftline.llm.tokens import PieceTokenizer


def _phrases(*runs):
    return np.array([i for r in runs for i in r], np.uint32), np.array([len(r) for r in runs], np.int64)


def _coded(numbers, phrases, block):
    data, sizes = id_coder.encode(numbers, block, phrases)
    steps = id_coder._Table.read(data[: len(data) - int(sizes.sum())])[1]
    ids = id_coder.expand(numbers, phrases)
    assert (id_coder.decode(data, sizes, len(ids), block) == ids).all()
    return steps, len(ids)


def test_phrases_are_one_symbol_and_come_back_as_ids(monkeypatch):
    r = np.random.default_rng(2)
    phrases = _phrases([1, 2, 3], [65535, 0], [7] * 300, [5, 5, 5, 5], [9], [])
    numbers = r.choice([3, 5, *range(id_coder.IDS, id_coder.IDS + 6)], 5_000)
    steps, ids = _coded(numbers, phrases, 128)
    assert steps < 5_000 + 300 * (numbers == id_coder.IDS + 2).sum() < ids  # 300 ids are too long for a phrase
    assert _coded(np.array([id_coder.IDS, id_coder.IDS + 1, 4]), phrases, 8) == (6, 6)  # met too seldom
    often = np.concatenate([np.repeat(id_coder.IDS, 50), np.repeat(id_coder.IDS + 3, 10)])
    assert _coded(often, phrases, 16) == (60, 190)
    monkeypatch.setattr(id_coder, "_PHRASES", 1)
    assert _coded(often, phrases, 16) == (90, 190)  # the phrase that saves most
    with pytest.raises(ValueError):
        id_coder.encode(np.array([id_coder.IDS + 6]), 16, phrases)
    with pytest.raises(ValueError):
        id_coder.encode(np.array([1]), 16, _phrases([70_000]))


def test_files_of_several_batches_hold_pieces_as_symbols():
    tok = PieceTokenizer(queries.vocabulary("byte_bpe_50k.json"))
    texts = ["zorblat quixel " * 40, "", "中文 zorblat", "quixel <|endoftext|> zorblat\n\n quixel", "x\x00 zorblat quixel"]
    batches = [pa.array([*texts, None]), pa.array(texts[::-1])]
    got = [tok.pieces(b) for b in batches]
    want = [tok.encode(b) for b in batches]
    for (_, pieces, counts, _), (_, n) in zip(got, want, strict=True):
        assert counts.tolist() == n.tolist() and (pieces <= counts).all()
    numbers, phrases = token_file._merged([g[0] for g in got], [g[3] for g in got])
    ids = np.concatenate([w[0] for w in want])
    assert (id_coder.expand(numbers, phrases) == ids).all()
    runs = [tuple(x) for x in np.split(phrases[0], np.cumsum(phrases[1])[:-1])]
    assert len(set(runs)) == len(runs) and len(numbers) < 0.6 * len(ids)
    counts = np.concatenate([w[1] for w in want])
    whole = token_file.pack_file(np.arange(len(counts)), np.ones(len(counts)), counts, numbers, 64, phrases)
    assert (token_file.unpack_file(whole)[3] == ids).all() and zlib.crc32(token_file.unpack_file(whole)[3]) == zlib.crc32(ids.astype("<u4"))
    for k in range(0, len(whole), 7):  # damage anywhere is noticed before blocks are decoded, as is a file that is cut
        with pytest.raises(ValueError):
            token_file.unpack_file(whole[:k] + bytes([whole[k] ^ 16]) + whole[k + 1 :])
    with pytest.raises(ValueError):
        token_file.unpack_file(whole[:-4])
