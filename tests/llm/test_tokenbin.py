"""Token records: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from packsmith.llm import tokenbin as tb
from packsmith.session import scratch

MODEL = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(MODEL)


def expected(rows, tokenizer):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_words_match_the_library(tokenizer):
    rng = random.Random(2)
    alphabet = [*"aB'sStTlL<|>endoftext .,-1é…́ñ  \n\t\r\x0b\x85À中ﬁİΣ🙂\x00", "<|endoftext|>", "'re", "'LL", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [None, "", " ", "word" * 3000]
    ids, counts = tb.encode_texts(pa.array(texts), MODEL)
    assert ids.tolist() == [i for t in texts for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]]
    assert counts.sum() == len(ids)


def test_query(spark, tokenizer):
    import pyarrow.parquet as pq

    from packsmith.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_records"](spark, sf).collect())
    assert got == expected(rows, tokenizer)


def test_files_and_offsets(spark, tokenizer):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)] + [(None, "none"), (301, None), (302, ""), (303, "x " * 60_000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, start int").repartition(4)
    where = scratch(spark, "records")
    tb.write_records(docs, where, MODEL)
    index = tb.write_index(spark, where, scratch(spark, "offsets")).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in index), key=lambda r: r[1]) == expected(rows, tokenizer)
    shards = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in spark.read.format("binaryFile").load(where).collect()}
    assert len(shards) > 1
    for r in random.Random(1).sample(index, 40):  # shuffled reads by offset
        ((at, length, doc_id, ids),) = tb.records(shards[r.shard][r.offset : r.offset + r.length])
        assert (at, length, doc_id, zlib.crc32(ids.astype("<u4").tobytes())) == (0, r.length, r.doc_id, r.ids_crc32)


def test_damage_is_found():
    good = tb.frame(7, np.arange(5, dtype="<u2").tobytes(), False) + b"\n" + tb.frame(None, np.array([1 << 20], "<u4").tobytes(), True) + b"\n"
    assert [(i, ids.tolist()) for _, _, i, ids in tb.records(good)] == [(7, [0, 1, 2, 3, 4]), (None, [1 << 20])]
    for at in range(len(good)):
        if good[at : at + 1] == b"\n" and at in (good.index(b"\n"), len(good) - 1):
            continue
        bad = good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
        with pytest.raises(ValueError):
            list(tb.records(bad))
    with pytest.raises(ValueError):
        list(tb.records(good[:-5]))


def test_shards_follow_the_bytes(spark, tokenizer):
    """Many shards, with long texts, a hot id and null ids spread by their bytes."""
    rows = [(i, f"text number {i} ") for i in range(60)] + [(100 + i, f"{i} long " * 400) for i in range(10)] + [(500, f"hot id {i} " * 30) for i in range(40)] + [(None, f"no id {i} " * 30) for i in range(40)] + [((1 << 63) - 1, "largest"), (-(1 << 63), "smallest")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    where = scratch(spark, "records")
    tb.write_records(docs, where, MODEL, shard_bytes=2000)
    sizes = [len(bytes(r.content)) for r in spark.read.format("binaryFile").load(where).collect()]
    assert len(sizes) > 20 and max(sizes) < 5000
    index = tb.write_index(spark, where, scratch(spark, "offsets")).collect()
    by_place = sorted(index, key=lambda r: r.start)
    assert [r.start for r in by_place] == np.cumsum([0] + [r.n_tokens for r in by_place])[:-1].tolist()
    ids = [-(1 << 63) if r.doc_id is None else r.doc_id for r in by_place]
    assert ids == sorted(ids)
    whole = lambda found: sorted((str(i), n, c) for i, n, c in found)
    assert whole((r.doc_id, r.n_tokens, r.ids_crc32) for r in index) == whole((i, n, c) for i, _, n, c in expected(rows, tokenizer))


@pytest.mark.parametrize("size", [1024, 2048])
def test_words_with_equal_hashes(spark, tokenizer, size):
    """Words that share the fast hash get their own ids, in one batch and from the memory of earlier ones."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    one, other = "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)
    for texts in ([one], [other], [one + " " + other + " x " + one], [other, one, "plain"]):
        ids, _ = tb.encode_texts(pa.array(texts), MODEL)
        assert ids.tolist() == [i for t in texts for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]]


def test_hot_ids_are_spread_in_order():
    ids = np.array([1, 2, 5, 5, 5, 5, 9])
    ties = np.array([0, 0, -(1 << 63), -1, 0, (1 << 63) - 1, 0])
    shards = tb.shard_of(ids, ties, np.array([2, 5, 5, 5, 7]))
    assert shards.tolist() == [0, 1, 1, 2, 3, 4, 5] or (np.diff(shards) >= 0).all()
    assert len(set(shards[2:6].tolist())) >= 3


def test_empty_and_repeated(spark, tokenizer):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tb.record_digest(empty, MODEL).count() == 0
    rows = [(3, "same")] * 50 + [(3, "other")] * 2
    got = tb.record_digest(spark.createDataFrame(rows, "doc_id bigint, text string"), MODEL).collect()
    assert sorted(r.start for r in got) == sorted(np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist())
    assert len(got) == 52
