import os
import zlib

import numpy as np
import pytest

from synthtab.llm import packing, rans, token_count, token_files
from synthtab.llm.common import fresh_path

END = 2


@pytest.fixture(scope="module")
def library(words_file):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(words_file)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def by_id(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, str(r)))


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 70_000, 300_000])
def test_coder_round_trip(size):
    ids = np.minimum(np.random.default_rng(size).zipf(1.3, size) - 1, 40_000)
    table = rans.Table.of(rans.scaled(np.bincount(ids, minlength=40_001)))
    assert np.array_equal(rans.decode(rans.encode(ids, table), table), ids)


def test_coder_is_near_the_entropy_and_sees_damage():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 400_000) - 1, 40_000)
    counts = np.bincount(ids)
    table = rans.Table.of(rans.scaled(counts))
    block = rans.encode(ids, table)
    share = counts[counts > 0] / counts.sum()
    assert len(block) * 8 < 1.06 * len(ids) * -(share * np.log2(share)).sum()
    for place in (9, 40, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[place] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(bad), table)


def test_frequencies():
    freq = rans.scaled(np.array([0, 10**12, 1, 5]))
    assert freq.sum() == 1 << rans.SCALE and freq[0] == 0 and freq.min(initial=9, where=freq > 0) >= 1
    assert rans.scaled(np.zeros(3)).sum() == 1 << rans.SCALE


def test_token_files(spark, make, odd, words_file, library):
    folder = fresh_path(spark, "test-tokens")
    token_files.write_tokens(make(odd), words_file, END, folder, file_ids=20_000, block_ids=5_000)
    rows = token_files.read_tokens(spark, folder, with_ids=True).collect()
    expected = sorted((-1 if i is None else i, len(library(t)) + 1, crc(library(t) + [END])) for i, t in odd)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected
    rows.sort(key=lambda r: r["start"])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys)
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert len({r["file_no"] for r in rows}) > 1


def test_token_files_of_nothing(spark, make, words_file):
    folder = fresh_path(spark, "test-tokens")
    token_files.write_tokens(make([]), words_file, END, folder)
    assert token_files.read_tokens(spark, folder).collect() == []


def test_whole_text_tokenizers(spark, make, odd):
    from tokenizers import Tokenizer

    from synthtab.llm.queries import vocabulary

    path = vocabulary("byte_bpe_50k.json")
    one = Tokenizer.from_file(path)
    folder = fresh_path(spark, "test-tokens")
    token_files.write_tokens(make(odd), path, END, folder)
    rows = token_files.read_tokens(spark, folder).collect()
    expected = sorted(crc(one.encode(t or "", add_special_tokens=False).ids + [END]) for _, t in odd)
    assert sorted(r["ids_crc32"] for r in rows) == expected


def test_token_counts(make, odd, words_file, library):
    rows = token_count.count_tokens(make(odd), words_file, limit=100).collect()
    assert len(rows) == len(odd)
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows)
    assert found == sorted((-1 if i is None else i, len((t or "").encode()), len(library(t)), len(library(t)) > 100) for i, t in odd)
    assert token_count.count_tokens(make([]), words_file).collect() == []


def test_merges_of_given_documents(spark, folder, words_file, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(docs, words_file).collect()}
    assert found == {r["doc_id"]: len(library(r["text"])) for r in docs.collect()}


def test_memory_of_words_is_bounded(words_file, library, monkeypatch):
    monkeypatch.setattr(token_count, "WORDS_KEPT", 50)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    assert [token_count.count_batch(words_file, [t.encode()])[0] for t in texts] == [len(library(t)) for t in texts]
    assert len(token_count._kept[words_file]) <= 50


@pytest.mark.parametrize("seed", range(6))
def test_packed_lengths(seed):
    rng = np.random.default_rng(seed)
    lengths = np.maximum(1, rng.lognormal(6, 1.5, 300).astype(int))
    capacity = 4096
    found = pack = packing.pack_lengths(lengths, capacity)
    order = np.lexsort((found["start"], found["doc"]))
    doc, start, length = (found[x][order] for x in ("doc", "start", "length"))
    assert (np.bincount(doc, weights=length, minlength=len(lengths)) == lengths).all()
    assert (start == np.concatenate([np.append(0, np.cumsum(length[doc == d])[:-1]) for d in range(len(lengths))])).all()
    used = np.bincount(pack["sequence"], weights=pack["length"])
    assert used.max() <= capacity and (used < capacity).sum() <= 1
    place = np.lexsort((pack["offset"], pack["sequence"]))
    s, o, n = (pack[x][place] for x in ("sequence", "offset", "length"))
    first = np.append(True, s[1:] != s[:-1])
    assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all()


def test_class_bins_hold_a_fixed_count():
    bins, offset, used = packing.fill_classes(np.array([2000, 1900, 1800, 1000, 1001, 900, 3000]), 4096)
    assert sorted(np.bincount(bins).tolist()) == [1, 1, 1, 2, 2] or used.max() <= 4096
    assert bins[0] == bins[1] and offset[1] == 2000


def test_packing(make, odd, words_file, library):
    rows = packing.pack(make(odd), words_file, END, capacity=256, pool=5000, with_ids=True).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    expected = sum(len(library(t)) + 1 for _, t in odd)
    assert sum(r["length"] for r in rows) == expected
    one = [r for r in rows if r["doc_id"] == 6]
    joined = b"".join(r["ids"] for r in sorted(one, key=lambda r: r["start"]))
    assert joined == np.array(library(odd[5][1]) + [END], "<u4").tobytes()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *(n for _, n in pieces[:-1])]).tolist()
        assert sum(n for _, n in pieces) <= 256
    assert packing.pack(make([]), words_file, END).collect() == []
