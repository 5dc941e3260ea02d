"""Properties that hold for any input."""

import numpy as np
import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from stratalyn.llm import jpeg, quality_knn, shards, simhash, warc  # noqa: E402

few = settings(max_examples=40, deadline=None)


@few
@given(st.binary(max_size=700))
def test_any_bytes_survive_a_picture(raw):
    padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    assert jpeg.payload_of(jpeg.read(jpeg.store(padded))) == padded


@few
@given(st.integers(1, 3000), st.integers(0, 1 << 62))
def test_any_key_permutes(n, key):
    assert len(np.unique(shards.permute(np.arange(n), n, key))) == n


@few
@given(st.lists(st.binary(max_size=300), max_size=8), st.integers(1, 64))
def test_any_records_come_out_of_the_stream(payloads, step):
    raw = [warc.record("response", i, "u", p, warc.payload_digest(p), len(p)) for i, p in enumerate(payloads)]
    data = warc.gzip_member(b"".join(raw))
    got = list(warc.records(iter([data[i : i + step] for i in range(0, len(data), step)])))
    assert got == raw and [warc.parse(x)[1] for x in got] == payloads


@few
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60), st.integers(0, 63))
def test_roots_are_smallest_and_linked(values, bit):
    fps = np.unique(np.array([*values, values[0] ^ (1 << bit)], np.uint64))
    root = simhash.link_shard(fps, len(fps))
    assert (root <= np.arange(len(fps))).all() and (root[root] == root).all()
    a, b = (int(np.flatnonzero(fps == np.uint64(x))[0]) for x in (values[0], values[0] ^ (1 << bit)))
    assert root[a] == root[b]


@few
@given(st.binary(max_size=2000), st.integers(1, 500))
def test_counts_do_not_depend_on_pieces(raw, piece):
    whole, old = quality_knn.counts(raw), quality_knn.PIECE
    try:
        quality_knn.PIECE = piece
        assert (quality_knn.counts(raw) == whole).all()
    finally:
        quality_knn.PIECE = old
