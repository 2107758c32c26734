"""SentencePiece encoding against the library, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from packsmith.llm import pieces

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts(library):
    rng = random.Random(4)
    alphabet = [*"aBtheing  .,-1é…́ñ\n\tÀ中\x00🙂aaaabababcab", "   ", "▁", "the", "  the", "<s>", "<0x0A>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["ab" * 500 + "the" * 300, " " * 700, "中文" * 400, "", " ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 60]
    for size in (1024, 2048):  # words that share the fast hash
        bits = [bin(k).count("1") % 2 for k in range(size)]
        one, other = "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)
        texts += [one, other, f"{other} {one}"]
    model = pieces.Model(MODEL)
    model.encode(pa.array(texts[-2:]))
    ids, counts, _, _ = model.encode(pa.array(texts))
    want = library.encode(texts)
    assert ids.tolist() == [i for x in want for i in x]
    assert counts.tolist() == [len(x) for x in want]
    back, at = model.decode(ids, counts)
    raw = back.tobytes()
    assert [raw[a + 1 : b].decode() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.replace("▁", " ") for t in texts]


def test_edges_are_all_occurrences():
    model = pieces.Model(MODEL)
    data = np.frombuffer(b" the theory of\xff another thing\xff" + "é中".encode() + b"\xff", np.uint8)
    at, piece = model.edges(data)
    raw, known = data.tobytes(), {model.bytes_of[i]: k for k, i in enumerate(model.ids.tolist())}
    want = sorted(((a << model.shift) + n, known[raw[a : a + n]]) for a in range(len(raw)) for n in range(1, model.depth + 1) if a + n <= len(raw) and raw[a : a + n] in known)
    assert list(zip(at.tolist(), piece.tolist(), strict=True)) == want


def test_query(spark, library):
    import pyarrow.parquet as pq

    from packsmith.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = []
    for r in rows:
        ids = library.encode(r["text"])
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(r["text"].encode()).hexdigest(), True))
    assert sorted(map(tuple, QUERIES["op3_sentencepiece"](spark, sf).collect())) == sorted(want)


def test_edge_cases(spark, library):
    long = "word " * 40_000
    rows = [(1, None, 3), (2, "", 3), (None, "null id", 3), (4, "same", 3), (4, "same", 3), (5, "a▁b", 3), (6, long, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = pieces.encode_documents(docs, MODEL).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted((str(i), library.encode(t or ""), (t or "").replace("▁", " ")) for i, t, _ in rows)
    assert all(r.n_tokens == len(r.ids) for r in got)
    exact = [(r.doc_id, r.exact) for r in pieces.encoding_digest(docs, MODEL).collect()]
    assert [i for i, ok in exact if not ok] == [5]
    assert pieces.encode_documents(docs.limit(0), MODEL).count() == 0
