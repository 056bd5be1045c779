"""BPE coder, token counts and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gravelake.llm import bpe_codec, hilbert_packing, token_counts

from .conftest import odd_rows


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def wanted(library):
    return {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in odd_rows()}


def test_encode_and_digests(odd, wanted, library):
    got = {r.doc_id: r.ids for r in bpe_codec.encode(odd).collect()}
    assert got == wanted
    for r in bpe_codec.encode_digests(odd).collect():
        ids = wanted[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decode_round_trip(odd):
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    assert {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(odd)).collect()} == texts


def test_small_tables_give_the_same(library):
    from gravelake.llm._bpe import ChunkTable, vocabulary
    from gravelake.llm._words import as_binary, buffer_of, slices
    import pyarrow as pa

    texts = [r[1] for r in odd_rows()]
    for limit in (2, 64, 1 << 16):
        table = ChunkTable(vocabulary(token_counts.read_vocabulary(None)), limit=limit)
        for at, part in slices(as_binary(pa.array(texts)), 5000):
            ids, offs = table.ids(*buffer_of(part))
            for i in range(len(part)):
                assert ids[offs[i] : offs[i + 1]].tolist() == library.encode(texts[at + i] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [0, 5, 65536])
def test_counts(odd, wanted, hot):
    texts = {r[0]: (r[1] or "").encode() for r in odd_rows()}
    rows = token_counts.token_counts(odd, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {i: (len(texts[i]), len(wanted[i])) for i in texts}


def check_pieces(rows, wanted, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert 0 < r.length and 0 <= r.offset and r.offset + r.length <= capacity
    assert set(by_doc) == set(wanted)
    for doc, pieces in by_doc.items():
        ids = np.array([*wanted[doc], 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == zlib.crc32(bytes(r.ids))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0  # full, or a power of two: no padding


def test_packing(odd, wanted):
    check_pieces(hilbert_packing.pack_documents(odd).collect(), wanted)


def test_pieces_follow_the_curve(spark, odd, wanted):
    """Sequences in order hold documents in the order of (Hilbert key, id), whatever the partitions."""
    rows = sorted(hilbert_packing.pack_documents(odd).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in rows))
    ids = {d: np.array([*wanted[d], 1], np.uint32) for d in wanted}
    keys = {d: int(hilbert_packing.document_keys(x, np.array([0, len(x)]))[0]) for d, x in ids.items()}
    assert order == sorted(wanted, key=lambda d: (keys[d], d))
    for d in (0, 5, 20):  # a key by hand: signed sums of hashed ids, cut and scaled
        signs = np.random.default_rng(7).choice([-1, 1], (hilbert_packing.DIMS, hilbert_packing.BUCKETS))
        mean = [np.mean([signs[k][(int(i) * 2654435761 >> 7) % hilbert_packing.BUCKETS] for i in ids[d]]) for k in range(hilbert_packing.DIMS)]
        cell = [min(max(int((m + 0.25) / 0.5 * 4096), 0), 4095) for m in mean]
        assert keys[d] == hilbert_packing.hilbert_keys(np.array([cell]), 12)[0]


def test_neighbours_on_the_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_packing.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_empty_and_repeats(nothing, with_repeats):
    for op in (bpe_codec.encode, bpe_codec.encode_digests, token_counts.token_counts, hilbert_packing.pack_documents):
        assert op(nothing).count() == 0
    n = with_repeats.count()
    assert bpe_codec.encode(with_repeats).count() == n
    assert token_counts.token_counts(with_repeats).count() == n
    assert hilbert_packing.pack_documents(with_repeats).filter("start = 0").count() == n
