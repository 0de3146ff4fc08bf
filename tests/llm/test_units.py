import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sparkloom.llm import repair
from sparkloom.llm.repair import compress, expand
from sparkloom.llm.units import UnitEncoder, gathered

TEXTS = ["", " ", "x ", "a  b", "\n\nb c", "word " * 500, " x<|endoftext|>y z", "<|endoftext|> <|endoftext|>", "é " * 50, "naïve_id=3 *** par.***", "w" * 5000, "a  b 　c", "tab\t here"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_equal_whole_texts_also_when_the_memo_is_cleared(name):
    coder = UnitEncoder(public_tokenizers.path(name), memo_units=3)
    for texts in (TEXTS, TEXTS[::-1], ["b c", *TEXTS]):
        ids, sizes = coder.encode(texts)
        ends = np.cumsum(sizes)
        for text, size, end in zip(texts, sizes, ends, strict=True):
            assert ids[end - size : end].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.counts(texts).tolist() == sizes.tolist()


def test_gathered_keeps_rows_in_order_over_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(t, pa.string())], ["k", "t"]) for k, t in (([1, None], ["aa", None]), ([3], ["b" * 9]), ([4, 5], ["c", "d"]))]
    lists = list(gathered(iter(batches), most_chars=4))
    assert lists == [([1, None], ["aa", ""]), ([3], ["b" * 9]), ([4, 5], ["c", "d"])]
    assert list(gathered(iter([]))) == []


@pytest.mark.parametrize("vocabulary", [5, 65_530, 70_000])
def test_grammar_gives_back_each_document(vocabulary):
    draw = np.random.default_rng(7)
    for _ in range(60):
        sizes = draw.integers(0, 40, draw.integers(0, 9))
        ids = draw.integers(0, int(draw.integers(1, 5)), sizes.sum()).astype(np.uint32)
        symbols, own, rules = compress(ids, sizes, vocabulary, least=2)
        assert own.sum() == len(symbols)
        for a, b, c, d in zip(np.cumsum(own) - own, np.cumsum(own), np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            assert (expand(symbols[a:b], rules, vocabulary) == ids[c:d]).all()


def test_grammar_goes_on_until_no_pair_repeats():
    symbols, _, rules = compress(np.zeros(1 << 16, np.uint32), np.array([1 << 16]), 5)
    assert len(symbols) == 8 and len(rules) == 13  # halved until fewer than 8 pairs are left


def test_rows_of_one_id_stand_in_the_order_of_their_texts(spark):
    from sparkloom.llm.repair import token_files

    texts = ["b b b", None, "a", "c " * 300, "a"]
    docs = spark.createDataFrame([(7, x) for x in texts] + [(None, "n"), (1, "x")], "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_files(docs, path).orderBy("start").collect()
    coder = UnitEncoder(path)
    want = [coder.tokenizer.encode(x, add_special_tokens=False).ids + [0] for x in ["n", "x", "", "a", "a", "b b b", "c " * 300]]
    assert [r.doc_id for r in rows] == [None, 1, 7, 7, 7, 7, 7]
    assert [r.n_tokens for r in rows] == [len(x) for x in want]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def test_a_block_expands_each_rule_once(monkeypatch):
    rng = np.random.default_rng(5)
    ids = np.tile(rng.integers(0, 300, 400), 50).astype(np.uint32)
    block = repair.Block(repair.write_block(np.arange(100), ids, np.full(100, 200), 300))
    sizes = []
    plain = repair.expand
    monkeypatch.setattr(repair, "expand", lambda symbols, *rest: sizes.append(len(symbols)) or plain(symbols, *rest))
    assert len(block.rules) and (block.all() == ids).all()
    assert sizes == [len(block.rules)]


class Counted:
    """A tokenizer that counts the texts of its batches and keeps them."""

    def __init__(self, inner):
        self.inner, self.texts = inner, []

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **how):
        self.texts += texts
        return self.inner.encode_batch_fast(texts, **how)


def test_units_of_byte_vocabularies_need_no_marks():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counted = Counted(plain)
    coder = UnitEncoder("", tokenizer=counted)
    words = [f"w{k}'s" for k in range(600)] + ["\u0120x", "d\u00e9j\u00e0", "a\nb", "a\x1cb", "'ll", "9,9", "\u3000", "x\u00a0y", "<|endoftext|>z"]
    texts = [" ".join(words), "a b\n", "a b ", " a b", "a  b c", "", "x \t y z", "b " + "\u2003", "p\n q r", " ".join(w for w in reversed(words) if not w.isspace())]
    ids, sizes = coder.encode(texts)
    want = [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [y for x in want for y in x]
    # hundreds of words go as one text, without a mark between
    assert len(counted.texts) < 20 and max(map(len, counted.texts)) > 1000
    assert UnitEncoder(public_tokenizers.path("word_bpe_49k.json")).leads is None


def test_words_are_encoded_once_whatever_follows_them():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counted = Counted(plain)
    coder = UnitEncoder("", tokenizer=counted)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    joined = [f"{a}.\n{b}{end}" for a, b, end in zip(words, reversed(words), [".", ",", "", "\n"] * 100, strict=True)]
    odd = ["9.", "9,\n8.", "é.", "中.", "b.\n\n", "\nb.", "b'.\nc", "'s,", "b.,", ".\n,", "b.\nc.\n　", "<|endoftext|>.\nb,", "b,<|endoftext|>."]
    texts = ["a " + " ".join(words), "a " + " ".join(x + "," for x in words), "a " + " ".join(joined), *(f"a {x} b" for x in odd), *(f"a {x}" for x in odd)]
    for some in (texts, texts[::-1], odd):
        ids, sizes = coder.encode(some)
        want = [plain.encode(x, add_special_tokens=False).ids for x in some]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [y for x in want for y in x]
    # each word once with a space before it and once after a line end
    given = " ".join(counted.texts)
    assert all(given.count(x) <= 3 for x in words)


def test_units_know_the_white_space_of_python():
    import sys

    import pyarrow.compute as pc

    from sparkloom.llm.units import _ADJACENT

    chars = [chr(k) for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000]
    found = pc.match_substring_regex(pa.array([x + x for x in chars]), _ADJACENT).to_pylist()
    assert [x for x, own in zip(chars, found, strict=True) if own != x.isspace()] == []


def test_few_pairs_are_searched_for(monkeypatch):
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 200_000), 50_000).astype(np.uint32)
    asked = []
    plain = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **how: asked.append(len(v)) or plain(a, v, *rest, **how))
    symbols, _, rules = compress(ids, np.array([200_000]), 50_257)
    assert (expand(symbols, rules, 50_257) == ids).all() and len(rules) > 1000
    assert sum(asked) < 20_000
