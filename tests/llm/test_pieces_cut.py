"""Encoding cuts a text once for its units and once for its ids."""

import pyarrow as pa

from cofilter.llm import pieces


def test_units_coded_in_one_cut():
    cut = []

    class Counting:
        def units(self, text):
            cut.append(text)
            return [" " + w for w in text.split()]

    texts = [["a b a", None, ""], [], ["b c", "a b a"]]
    parts = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], names=["t"]) for t in texts]
    place, coded = pieces._coded(parts, Counting())
    assert cut == ["a b a", "b c", "a b a"] and place == {" a": 0, " b": 1, " c": 2}
    assert [(a.tolist(), b.tolist()) for a, b in coded] == [([0, 1, 0], [3, 0, 0]), ([], []), ([1, 2, 0, 1, 0], [2, 3])]
    assert sorted(u for us in pieces._by_bucket(place, 2).values() for u in us) == [" a", " b", " c"]
