import random
from functools import lru_cache

import cases
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from motifel.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def library():
    return Tokenizer.from_file(PATH)


def brute(parts, split):
    """One call of the tokenizer for the whole document, each token by hand."""
    ends, sizes, at = [], [], 0
    for i, p in enumerate(parts):
        own = tc.sentence_ends(p) if split[i] else [len(p)]
        ends += [at + e for e in own]
        sizes.append(len(own))
        at += len(p) + 1
        if i + 1 < len(parts):
            ends[-1] += 1
    counts, crossing = [0] * len(ends), 0
    e = library().encode("\n".join(parts), add_special_tokens=False)
    low = 0  # sections that end before a token begins are passed by, as offsets rise
    for a, b in e.offsets:
        b = max(b, a + 1)
        while ends[low] <= a:
            low += 1
        share, start, k = [], ends[low - 1] if low else 0, low
        while k < len(ends) and start < b:
            share.append(max(0, min(b, ends[k]) - max(a, start)))
            start, k = ends[k], k + 1
        crossing += sum(x > 0 for x in share) > 1
        counts[low + share.index(max(share))] += 1
    return len(e.ids), crossing, sizes, counts


@pytest.mark.parametrize("fields", [("text",), ("source", "text"), ("text", "lang", "source")])
def test_against_one_call_for_each_document(spark, fields):
    rows = cases.hard_rows()
    names = [x.split()[0] for x in cases.SCHEMA.split(", ")]
    got = tc.token_counts(cases.table(spark, rows), PATH, fields).collect()
    want = [(r[0], *brute([r[names.index(f)] or "" for f in fields], [f == "text" for f in fields])) for r in rows]
    assert cases.norm(got) == cases.norm(want)
    assert all(sum(r.section_tokens) == r.n_tokens for r in got)


def test_empty_table(spark):
    assert tc.token_counts(cases.table(spark, []), PATH).collect() == []


def test_white_space_beside_added_tokens(spark):
    """Added tokens are taken out first, so white space before them ends a text of its own."""
    rng = random.Random(5)
    signs = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u3000", "x", "y.", "it's", "é", "日本", "12", "!?"]
    texts = ["x\n\n<|endoftext|>\n y", " <|endoftext|>", "<|endoftext|><|endoftext|> \n", "a  <|endoftext|>  b"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r) for r in tc.token_counts(cases.table(spark, rows), PATH).collect()}
    assert got == {i: (i, *brute([t], [True])) for i, t in enumerate(texts)}


def test_whole_table(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = tc.token_counts(docs, PATH, ("source", "text")).collect()
    assert cases.norm(got) == cases.norm((r.doc_id, *brute([r.source or "", r.text or ""], [False, True])) for r in docs.collect())
