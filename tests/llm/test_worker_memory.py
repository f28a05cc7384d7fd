"""What a Python worker keeps between tasks, and what it holds while ids are put together."""

import tracemalloc

import numpy as np

from cofilter.llm import common, pieces


def test_powers_do_not_stay():
    data = np.frombuffer(b"one two three " * 50_000, np.uint8)
    start, first = common.word_hashes(data)
    common.hand_back()
    assert sum(x.nbytes for x in common._POW.values()) <= 16
    again, second = common.word_hashes(data)
    assert start.tolist() == again.tolist() and first.tolist() == second.tolist()
    common.hand_back()


def test_ids_put_together_in_turns(monkeypatch):
    pool = np.array([7, 8, 9, 5, 6, 4], np.int32)
    size, begin = np.array([3, 2, 0, 1], np.int32), np.array([0, 3, 5, 5])
    codes, counts = np.array([1, 0, 2, 3, 1], np.int32), np.array([2, 0, 3])
    for turn in (1, 2, 100):
        monkeypatch.setattr(pieces, "IN_TURN", turn)
        ids, offsets = pieces._joined(codes, counts, size, begin, pool)
        assert ids.tolist() == [5, 6, 7, 8, 9, 4, 5, 6] and offsets.tolist() == [0, 5, 5, 8]
    ids, offsets = pieces._joined(codes[:0], np.zeros(2, np.int64), size, begin, pool)
    assert ids.tolist() == [] and offsets.tolist() == [0, 0, 0]


def test_ids_put_together_hold_little():
    codes = np.tile(np.arange(4, dtype=np.int32), 500_000)
    size, begin, pool = np.full(4, 2, np.int32), np.arange(0, 8, 2), np.arange(8, dtype=np.int32)
    tracemalloc.start()
    try:
        ids, _ = pieces._joined(codes, np.array([len(codes)]), size, begin, pool)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(ids) == 2 * len(codes) and most < 3 * ids.nbytes
