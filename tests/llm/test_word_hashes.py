"""Word hashes over bytes against plain splitting."""

import random

import pyarrow as pa
import pytest

from hybridlake.llm import texts as tx


@pytest.mark.parametrize("step", [7, 64, 1 << 20])
def test_equal_words_have_equal_hashes_and_others_not(monkeypatch, step):
    monkeypatch.setattr(tx, "HASHED_BYTES", step)
    rng = random.Random(step)
    alphabet = ["a", "b", " ", "\n", "\x0b", "é", "漢", "\x00", "\x85", "  "]
    bodies = [None, "", " ", "a", " a", "a ", "x" * 63, "x" * 64, "x" * 65, "y" * 200 + " z", "x" * 65 + "y", "ab ba a b"]
    bodies += ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]
    array = pa.array(["skipped", *bodies, "too"], pa.string()).slice(1, len(bodies))
    seen: dict[int, bytes] = {}
    found = list(tx.hashed_words(array))
    assert len(found) == len(bodies)
    for body, hashes in zip(bodies, found):
        words = tx.ascii_words(body)
        assert len(words) == len(hashes)
        for word, h in zip(words, hashes.tolist()):
            assert seen.setdefault(h, word) == word
        if words:
            assert tx.spaced(body, len(words)) == b" ".join(words).decode()
    assert len(set(seen.values())) == len(seen)


def test_no_texts():
    assert list(tx.hashed_words(pa.array([], pa.string()))) == []
    assert [len(h) for h in tx.hashed_words(pa.array([None, None], pa.string()))] == [0, 0]
