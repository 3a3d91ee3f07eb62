import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talkweave.llm.tokens import Counter, count_tokens, read_vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "<|endoftext|>a<|startoftext|>", "it's DON'T ΣΑΣ İstanbul éa \x1c x\x85y 日本語 12345 aaaa\taa\r\n!!!??", "a" * 3001, "ab" * 999 + "́" * 50,
       "̈ ̈x\n̈y", "<|endoftext|", "<|<|endoftext|>|>", "x" * 70 + " " + "x" * 70]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    rng = random.Random(1)
    alphabet = "abz'sdtSDT'\" \n\t0129éÉßÜñ́̈ΣςİıǅⅧ²½日本​ \xa0\x1c\x1f　😀👍🏽<|>endoftext"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Counter(read_vocabulary(PATH)).count(texts) == want


def test_table(spark, documents, library):
    texts = [*ODD, None, "word " * 5000, ODD[3]]
    got = count_tokens(documents(list(enumerate(texts)) + [(3, ODD[3]), (None, "x")]), PATH, 2048).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    want += [want[3], (None, 1, 1)]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert count_tokens(documents([]), PATH).collect() == []
