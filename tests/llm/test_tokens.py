import zlib
from itertools import product

import numpy as np
import pytest

from postwright.llm import packing, token_files
from postwright.llm.tokenize import default_path, encoder

HARD = ["It's OK, don't!! I'LL ẞ İstanbul ΣΑΣ ǅ ½²", "a\x1cb", "<|endoftext|> x <|startoftext|>", "é é ̀a ​\xa0b ñ一二三 👍🏽 ٣٤", "", None, "ﬁ Å K ſt", "'s''d'LL 're", "x" * 500, "ÀÉ.,;", "١ a1b2"]


def library_ids(text):
    return encoder(default_path()).lib.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_ids_are_the_library_s(text):
    e = encoder(default_path())
    assert e.encode(text).tolist() == library_ids(text)
    assert e.encode(text).tolist() == library_ids(text)  # from the memo


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 20, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_bits_round_trip(bits, n):
    x = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
    raw = token_files.pack_bits(x, bits)
    assert len(raw) == -(-n * bits // 8) and (token_files.unpack_bits(raw, bits, n) == x).all()


@pytest.mark.parametrize(("bits", "block"), [(16, 64), (11, 64), (13, 7), (17, 5)])
def test_random_access(tmp_path, bits, block):
    from pyarrow import fs

    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 1, 5, 64, 200, 0, 3)]
    w = token_files.ShardWriter(bits, block)
    for d in docs:
        w.add(d)
    w.write(fs.LocalFileSystem(), f"{tmp_path}/a.tok")
    r = token_files.ShardReader(f"{tmp_path}/a.tok")
    whole = np.concatenate(docs)
    assert r.n_docs == len(docs) and all((r.document(k) == d).all() for k, d in enumerate(docs))
    assert all((a == b).all() for a, b in zip(r.documents(at_once=50), docs, strict=True))
    for a, b in product((0, 1, 63, 64, 65, 150), (0, 64, 66, 151, 999)):
        assert (r.ids(a, b) == whole[a:b]).all()


def test_files_round_trip(spark, odd_docs, no_docs):
    rows = token_files.token_files(odd_docs).collect()
    docs = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd_docs.collect()))
    want, at = [], 0
    for some, i, _, text in docs:
        ids = np.array([*library_ids(text), 1], "<u4")
        want.append((i if some else None, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.start, r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in rows) == sorted((s, i or -1, n, c) for i, s, n, c in want)
    assert token_files.token_files(no_docs).count() == 0


def test_several_shards(spark, odd_docs, tmp_path):
    m = token_files.write_token_files(odd_docs, f"{tmp_path}/t", shard_ids=8)
    assert m.count() > 4
    rows = token_files.read_token_files(m).collect()
    assert len(rows) == odd_docs.count()
    ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def fewest_bins(lengths, capacity):
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                bins[i] += lengths[k]
                place(k + 1, bins)
                bins[i] -= lengths[k]
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_bounds_never_exceed_the_optimum(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 30))
    lengths = np.sort(rng.integers(1, capacity + 1, int(rng.integers(1, 8))))[::-1]
    bins = packing.best_fit_decreasing(lengths, capacity)
    assert np.bincount(bins, lengths).max() <= capacity
    assert packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity) <= fewest_bins(lengths.tolist(), capacity) <= bins.max() + 1


def test_packing_fills_sequences(spark, odd_docs, no_docs):
    rows = packing.packed_pieces(odd_docs).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in odd_docs.collect():
        if d.doc_id != 8:
            ids = np.array([*library_ids(d.text), 0], "<u4")
            own = sorted(by[d.doc_id], key=lambda r: r.piece)
            assert [(r.piece, r.start, r.ids_crc32) for r in own] == [(k, a, zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert packing.packed_pieces(no_docs).count() == 0


def test_exchange_saves_bins(spark):
    lengths = np.random.default_rng(3).integers(1, 2048, 3000)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "uid long, length long")
    got = packing.pack(df, partition_pieces=300).toPandas()
    assert sorted(got.uid) == list(range(3000))
    whole = packing.best_fit_decreasing(lengths, 2048).max() + 1
    alone = packing.pack(df, partition_pieces=300, exchanges=0).toPandas().sequence_id.nunique()
    assert got.sequence_id.nunique() <= alone and got.sequence_id.nunique() <= whole * 1.02


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "again")], "doc_id long, text string")
    p = packing.packed_pieces(docs, keep_ids=True)
    s = packing.sequences(p).collect()
    assert sum(r.n_tokens for r in s) == sum(len(library_ids(t)) + 1 for t in ("hello world", "again")) and all(len(r.ids) == 4 * r.n_tokens for r in s)
