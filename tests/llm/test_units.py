import random

import cases
import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from motifel.llm.units import Bpe, Memory

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", "a", "don't", "IT'S", "we'll've", "x'", "''s", "İstanbul", "ǅ", "straße", "ﬁn", "é", "Σίσυφος ΟΔΟΣ", "日本", "½²ª", "a\xa0b", "a b", "\x1f", "﻿x", "<|endoftext|>", "x<|startoftext|>y", "!!!", "..,", "3.14", "____", "a_b", "ŒUVRE", "Ŀ", "ŉ", "naïve—café", "🙂🙂", "​", "ÿ", "\xad"]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_library(name, data_dir):
    path = public_tokenizers.path(name)
    bpe, lib = Bpe(path), Tokenizer.from_file(path)
    assert bpe.core is not None
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{data_dir}/documents.parquet'").fetchall()]
    words = list({w for t in texts for w in t.split()})
    rng = random.Random(1)
    signs = "abcXYZéÉßñøŁ019'.,!?#$-_<|>½\xad "
    words += ODD + [" " + w for w in words[:2000]] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    words += [w for r in cases.hard_rows() if r[1] for w in r[1].split(" ")]
    for w in words:
        assert bpe(w) == lib.encode(w, add_special_tokens=False).ids, repr(w)


def test_memory_is_bounded():
    m = Memory(public_tokenizers.path(FILES[0]), str, len, 50)
    for i in range(0, 1000, 10):
        keys = {f"w{j}" for j in range(i, i + 10)}
        m.learn(keys)
        assert keys <= set(m.known) and len(m.known) <= 60
