"""Shortest-pack-first packing: exact round trips, full sequences, and the plan against packing pack by pack."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import pattern_packing as pp


def texts():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "Été", "naïve", "x1", "日本語", "don't", "\n\n", "  ", "<|endoftext|>", "😀", *(f"w{i}" for i in range(200))]
    out = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 60)))) for _ in range(80)]
    return [*out, None, "", "  \n ", "one", " ".join(rng.choice(vocabulary, 9000)), "a" * 3000, " " * 300_000 + "x", out[0], out[0]]


def check(rows, docs, size, end_id=0):
    """rows of the operator over docs [(doc_id, text)] with distinct ids: every id once, sums right, sequences full."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pp.tokenizer_path())
    of, packs = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        packs[r.sequence_id].append((r.offset, r.length))
    assert set(of) == {i for i, _ in docs}
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        at = 0
        for r in sorted(of[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    fills = []
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        fills.append(at)
    short = [x for x in fills if x != size]
    assert all(x < size and x & (x - 1) == 0 for x in short) and len(set(short)) == len(short)


@pytest.mark.parametrize("size", [1024, 64])
def test_every_id_once_and_no_padding(spark, size):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, length string").repartition(5)
    got = pp.pack_patterns(docs, size)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    check(got.collect(), rows, size)


def test_ids_equal_the_tokenizers(spark):
    e = pp.encoder(pp.tokenizer_path())
    for t in [x or "" for x in texts()] + ["'s 'T'll  \t\n x y z 1²٣", "à́ ñ"]:
        assert e.encode(t).tolist() == e.full.encode(t, add_special_tokens=False).ids


def one_by_one(counts, size):
    """(length, taken) of every placement when each piece goes to the pack with most room by itself."""
    total = sum(k * n for k, n in counts.items())
    room = [size] * (total // size) + [1 << b for b in range((total % size).bit_length()) if total % size >> b & 1]
    left, out = Counter(counts), Counter()
    for length in range(size, 0, -1):
        for _ in range(left[length]):
            most = max(room)
            taken = min(most, length)
            room[room.index(most)] -= taken
            out[length, taken] += 1
            if taken < length:
                left[length - taken] += 1
    assert not any(room)
    return out


def test_plan_equals_packing_one_by_one():
    rng = np.random.default_rng(9)
    for size in (16, 64):
        for n in (1, 5, 40, 300):
            counts = Counter(rng.integers(1, size + 1, n).tolist())
            steps = pp.plan(counts, size)
            got = Counter()
            for length, _, _, packs, _, taken, _ in steps.tolist():
                got[length, taken] += packs
            assert got == one_by_one(counts, size)


def test_plan_has_as_many_steps_whatever_the_counts():
    rng = np.random.default_rng(4)
    shape = {int(k): int(rng.integers(1, 50)) for k in range(1, 1025)}
    few, many = pp.plan(shape, 1024), pp.plan({k: n * 1_000_003 + 7 for k, n in shape.items()}, 1024)
    assert len(many) < 3 * len(few) < 60_000
    assert len(few) - len(shape) < 4 * len({k for k in shape})


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert pp.pack_patterns(spark.createDataFrame([], schema)).collect() == []
    got = pp.pack_patterns(spark.createDataFrame([(None, None)] * 3 + [(5, "")], schema)).collect()
    assert Counter(r.doc_id for r in got) == {None: 3, 5: 1}
    assert all(r.length == 1 and r.doc_tokens == 1 and r.ids_crc32 == zlib.crc32(b"\0\0\0\0") for r in got)
    assert Counter(r.sequence_id for r in got).most_common()[0][1] == 4


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(pp.op12_pattern_packing(spark, d).collect(), docs, 1024)
