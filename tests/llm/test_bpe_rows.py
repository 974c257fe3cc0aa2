"""Pieces merged in step against pieces merged one by one."""

import hashlib
import random

import pyarrow as pa

from lumenvec.llm import bpe


def pieces():
    rnd = random.Random(5)
    some = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(1, 40))) for _ in range(3000)]
    return some + ["a" * n for n in range(1, 70)] + ["ñandú", "日本語", "é", "!!!", "ab" * 16, "ab" * 17]


def test_pieces_merge_as_alone():
    own = bpe.load(bpe.default_path())
    ids, at = own.merge_all([p.encode() for p in pieces()])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.merge(p) for p in pieces()]
    assert own.merge_all([])[0].tolist() == []


def test_new_words_of_a_slice_are_merged_together(monkeypatch):
    path = bpe.default_path()
    own = bpe.load(path)
    texts = [" ".join(pieces()), "", "it's 12, don't", None]
    want = [own.encode_strings(t or "") for t in texts]
    bpe._pool(path).clear()

    def alone(piece):
        assert len(piece.encode()) > bpe.PIECE_BYTES[-1], "a short piece was merged by itself"
        return type(own).merge(own, piece)

    monkeypatch.setattr(own, "merge", alone)
    n, ids, decoded = bpe.digest_batch(pa.array(texts), path)
    sha = [[hashlib.sha256(x.encode()).hexdigest() for x in part] for part in zip(*want)]
    assert [ids, decoded] == sha and n == [len(w[0].split()) for w in want]
