import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkweave.llm import alignment as A

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def decoded(name):
    """A's printable characters back to bytes: the usual table of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    table = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    return bytes(table[c] for c in name)


@pytest.fixture(scope="module")
def cut():
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True

    def tokens(text):
        """[(start, end, id)] of A and B, one token at a time."""
        raw, out = b" " + text.encode(), []
        ids = a.encode(raw.decode(), add_special_tokens=False).ids
        left = [(i, decoded(a.id_to_token(i))) for i in ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        for side in (left, right):
            at, spans = 0, []
            for i, x in side:
                spans.append((at, at + len(x), i))
                at += len(x)
            out.append(spans)
            if not text or b"".join(x for _, x in side) != raw:
                return [], []
        return out
    return tokens


def brute(rows, cut):
    out, holders = [], Counter()
    for i, text in rows:
        a, b = cut(text or "")
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [([x for s, e, x in a if lo <= s < hi], [x for s, e, x in b if lo <= s < hi]) for lo, hi in zip([0, *ends], ends)]
        links = [(x, y) for s, e, x in a for t, u, y in b if s < u and t < e]
        holders.update(set(links))
        out.append((i, len(a), len(b), len(groups), links, ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)))
    best = {}
    for (x, _), n in holders.items():
        best[x] = max(best.get(x, 0), n)
    return [(i, na, nb, ng, len(links), sum(holders[k] == best[k[0]] for k in links), sum(holders[k] for k in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for i, na, nb, ng, links, g in out]


ROWS = ["Hello world", "hello  world", "Hello world", None, "", " ", "\n", "tokenization of naïve café, 東京 и Москва 🙂🙂", "<|endoftext|> and </s> <unk>", "a▁b", "x\u0000y\tz\r\n",
        "don't stop 12345 67,8.90", "é   ﬁ", "x" * 3000, "aaa bbb " * 400, "▁", "word"]


def test_equals_brute_force(documents, rng, prose, cut, monkeypatch):
    monkeypatch.setattr(A, "SLAB", 4)
    rows = [*enumerate(ROWS + [prose(rng.randrange(1, 90)) for _ in range(60)]), (None, "Hello"), (0, "Hello world")]
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256))
    got = A.count_links(A.align_tokens(documents(rows), BYTE, PIECE).withColumn("sha", digest).drop("groups"))
    got = [tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(brute(rows, cut), key=key)
    assert any(r[1] == 0 and rows[r[0]][1] for r in got if r[0] is not None)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\r'sdtveml1a.,éÀɏ<>|_"), st.characters(max_codepoint=0x30ff, exclude_categories=["Cs"])), max_size=40))
def test_plain_text_equals_the_libraries(text):
    """The faster library gives plain text the same ids."""
    tokenizer, processor = A._byte_level(BYTE)[0], A._pieces(PIECE)[0]
    (left,), (right,) = A.encoded([text], BYTE, PIECE)
    if left:
        assert left == tokenizer.encode(" " + text, add_special_tokens=False).ids and right == processor.encode(text)
    else:
        assert not text or b"".join(A._pieces(PIECE)[1][i] for i in processor.encode(text)) != b" " + text.encode()


def test_real_texts_equal_the_libraries(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    left, right = A.encoded(texts, BYTE, PIECE)
    whole = A._byte_level(BYTE)[0].encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    assert left == [e.ids for e in whole] and right == A._pieces(PIECE)[0].encode(texts)


def test_empty_table(documents):
    assert A.align_tokens(documents([]), BYTE, PIECE).collect() == []
    assert A.count_links(A.align_tokens(documents([]), BYTE, PIECE)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_groups_and_overlaps_of_intervals(left, right):
    left[-1] += max(0, sum(right) - sum(left))
    right[-1] += max(0, sum(left) - sum(right))
    a, b = (np.array(x) for x in (left, right))
    span = a.cumsum() - a, a.cumsum(), b.cumsum() - b, b.cumsum()
    ga, gb = A.coalesced(*span)
    ends = np.intersect1d(span[1], span[3])
    assert (ga == np.searchsorted(ends, span[0], "right")).all() and (gb == np.searchsorted(ends, span[2], "right")).all()
    i, j = A.overlaps(*span)
    assert list(zip(i, j)) == [(x, y) for x in range(len(a)) for y in range(len(b)) if span[0][x] < span[3][y] and span[2][y] < span[1][x]]
