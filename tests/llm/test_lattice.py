"""The lattice of operator 2 holds no lengths that none of its words' pieces has, and pieces are found by their codes."""

import numpy as np

from fieldframe.llm import common, sampling


def _words(*words):
    words = sorted(words, key=len, reverse=True)
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.array([len(w) for w in words])


def test_lengths_without_pieces_take_no_room():
    v = sampling.vocabulary(sampling.MODEL, 1.0)
    data, size = _words(b" the", b" theand", b"q" * 40, b"\xff" * 7, b"a")
    off, lengths, piece, chance = sampling._forward(data, size, v)
    assert lengths[-1] == 1 and (np.diff(lengths) < 0).all() and {4, 3} <= set(lengths.tolist())
    assert piece.shape == chance.shape == (len(lengths), off[-1])
    assert (piece != v.none).any(axis=1).all()
    assert (chance[-1, off[1] :] == 1 << 24).all() and (np.diff(chance, axis=0) >= 0).all()


def test_pieces_are_found_by_code():
    v = sampling.vocabulary(sampling.MODEL, 1.0)
    assert v.shared > 1  # some codes have the same top bits
    known = dict(zip(v.codes.tolist(), v.ids.tolist(), strict=True))
    near = np.concatenate([v.codes, v.codes + np.uint64(1), v.codes ^ np.uint64(1 << 20), common.mix(np.arange(50_000, dtype=np.uint64))])
    some, ids = v.find(near)
    assert dict(zip(some.tolist(), ids.tolist(), strict=True)) == {i: known[c] for i, c in enumerate(near.tolist()) if c in known}
    assert len(v.find(near[:0])[0]) == 0
