"""Alignment of two tokenizers against a plain version that walks over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from marquee.llm import alignment
from marquee.llm.queries import QUERIES, vocabulary

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(vocabulary()[0])
    a.encode_special_tokens = True
    names = alignment.byte_symbols()
    table = {i: bytes(names[c] for c in entry) if all(c in names for c in entry) else entry.encode() for entry, i in a.get_vocab().items()}
    return a, table, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain_tokens(text, libraries):
    a, table, b = libraries
    whole = b" " + (text or "").encode()
    ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    ids_b = b.encode(text) if text else []
    bytes_a = [table[i] for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], []
    spans = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, out = 0, []
        for i, part in zip(ids, parts, strict=True):
            out.append((i, at, at + len(part)))
            at += len(part)
        spans.append(out)
    return spans


def plain(texts, libraries):
    rows, holds = [], Counter()
    for text in texts:
        a, b = plain_tokens(text, libraries)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, links, i, j = [], [], 0, 0
        for end in ends:
            x, y = [], []
            while i < len(a) and a[i][2] <= end:
                x.append(a[i])
                i += 1
            while j < len(b) and b[j][2] <= end:
                y.append(b[j])
                j += 1
            groups.append(f"{','.join(str(t[0]) for t in x)}|{','.join(str(t[0]) for t in y)}")
            links += [(s[0], t[0]) for s in x for t in y if s[1] < t[2] and t[1] < s[2]]
        holds.update(set(links))
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    return [(n_a, n_b, n, len(links), sum(holds[x] == best[x[0]] for x in links), sum(holds[x] for x in links), sha) for n_a, n_b, n, links, sha in rows]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def expected(rows, libraries):
    return sorted(((k, *x) for (k, _), x in zip(rows, plain([t for _, t in rows], libraries), strict=True)), key=str)


def odd_texts(n):
    random.seed(8)
    parts = ["the", "Naïve", "été", "漢字", "don't", "12345", "<|endoftext|>", "<s>", "</s>", "<0x41>", "aaaaaaa", "  ", "\n", "\t", " ", "…", "x▁y", "▁", "é", "😀😀", "\x00", " ", "Ж", "http://a.b/c?d=e", "ﬁ", "​", "ÿ", "-", "'", "İ"]
    return ["".join(random.choice(["", " ", " "]) + random.choice(parts) for _ in range(random.randrange(1, 25))) for _ in range(n)]


def test_query_equals_plain_version(spark, sf_dir, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op12_identity_alignment"](spark, sf_dir)) == expected(rows, libraries)


def test_awkward_and_odd_texts(spark, awkward, nothing, libraries):
    run = lambda df, **kw: alignment.align_documents(df, *vocabulary(), MODEL, **kw)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(run(awkward)) == expected(rows, libraries)
    assert run(nothing).collect() == []
    rows = list(enumerate(odd_texts(400)))
    want = expected(rows, libraries)
    assert any(r[1] == 0 for r in want) and any(r[3] < min(r[1], r[2]) for r in want)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(run(df)) == want
    for bound in (0, 20, 200):  # rare pairs are joined
        assert found(run(df, broadcast_pairs=bound)) == want


def test_without_ranks_and_in_small_slices(spark, libraries, monkeypatch):
    rows = list(enumerate(odd_texts(60)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found(alignment.align_documents(df, vocabulary()[0], None, MODEL)) == expected(rows, libraries)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 100)
    monkeypatch.setattr(alignment, "FLUSH_PAIRS", 50)
    monkeypatch.setattr(alignment, "SEGMENT", 1000)
    monkeypatch.setattr(alignment, "FAN_IN", 1)
    assert found(alignment.align_documents(df, *vocabulary(), MODEL)) == expected(rows, libraries)


def test_identity_map_joins_equal_bytes():
    tok = alignment.Tokenizers(*vocabulary(), MODEL)
    mapped = [i for i, j in enumerate(tok.identity) if j >= 0]
    assert len(mapped) > 20_000
    text = lambda pool, i: pool.body[pool.at[i] : pool.at[i] + pool.size[i]].tobytes()
    assert all(text(tok.pool_a, i) == text(tok.pool_b, int(tok.identity[i])) for i in mapped)


def test_pieces_join_to_the_texts():
    texts = odd_texts(100)
    coded, row = alignment.cut(pa.array([*texts, "", None]))
    out = [b""] * (len(texts) + 2)
    for piece, r in zip(coded.to_pylist(), row.tolist(), strict=True):
        out[r] += piece
    assert out == [b" " + t.encode() for t in texts] + [b"", b""]
