import re

import numpy as np
import pyarrow as pa
import pytest

from fleetloom.llm import text as T

from .helpers import corpus


@pytest.mark.parametrize("seed", range(3))
def test_words_and_hashes(seed):
    texts = [None if t is None else t.encode() for _, t in corpus(seed)]
    array = pa.array([b"skipped", *texts], pa.binary()).slice(1)
    spans = T.words(array, T.white_space())
    found = [bytes(spans.data[s : s + n]) for s, n in zip(spans.starts, spans.lengths, strict=True)]
    wanted = [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0d]+", t or b"")]
    assert list(zip(spans.text.tolist(), found, strict=True)) == wanted
    for which in (0, 1):
        numbers = T.hashes(spans, which)
        assert len(set(numbers.tolist())) == len({w for _, w in wanted})
        assert len({(w, n) for (_, w), n in zip(wanted, numbers.tolist(), strict=True)}) == len({w for _, w in wanted})


def test_runs_tell_order_apart():
    values = np.array([1, 2, 3, 1, 2, 3, 3, 2, 1], np.uint64)
    found = T.runs(values, 3, 0).tolist()
    assert found[0] == found[3] and found[0] != found[6] and len(found) == 7
    assert len(T.runs(values[:2], 3, 0)) == 0


def test_pieces_cover_everything():
    batch = pa.RecordBatch.from_arrays([pa.array([b"a" * n for n in (0, 5, 9, 1, 0, 30, 2)])], ["body"])
    rows = [r for p in T.pieces(batch, "body", 8) for r in p.column("body").to_pylist()]
    assert rows == batch.column("body").to_pylist()
    assert list(T.pieces(batch.slice(0, 0), "body", 8)) == []
