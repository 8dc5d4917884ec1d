"""Token files: distinct stretches are encoded once a batch, blocks go side by side, the format stays."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import token_files
from mnemospark.llm.common import tokenizer_file

#: Of the code words of the blocks below, by the coder before blocks went side by side in even groups.
CRC = 2831490417
TEXTS = ["one two\none", None, "", "  two   one ", "Don't x\ty z İstanbul <|endoftext|>a"]


@pytest.mark.parametrize("first", range(3))
def test_each_stretch_is_encoded_once_a_batch(first):
    from tokenizers import Tokenizer

    whole, tokens, asked = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), token_files.Tokens(tokenizer_file("word_bpe_49k.json")), []
    encode = tokens.encode
    tokens.encode = lambda words, **kw: asked.extend(words) or encode(words, **kw)
    texts = [*TEXTS, *["two one"] * 50]
    found = tokens.of(pa.array(texts)[first:], 2)
    assert len(asked) == len(set(asked))
    assert [f.tolist() for f in found] == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts[first:]]
    assert tokens.of(pa.array([], pa.string()), 2) == []


def test_code_words_are_those_of_older_files():
    rng = np.random.default_rng(4)
    blocks = [np.minimum(rng.zipf(1.3, 400 + k), 65535) for k in range(20)]
    assert zlib.crc32(b"".join(w.tobytes() for w in token_files.encode(blocks))) == CRC


def test_blocks_are_dealt_evenly():
    groups = list(token_files._side_by_side([3] * token_files.LANES + [5] * 10))
    assert sorted(sum(groups, [])) == list(range(token_files.LANES + 10))
    assert [len(g) for g in groups] == [(token_files.LANES + 10) // 2] * 2  # the second one had 10
