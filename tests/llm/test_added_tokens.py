"""Ids of texts that hold added tokens of the vocabulary's file."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import packing

TEXTS = [
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "x  <|endoftext|>\n\n y", "<|endoftext", "<|ENDOFTEXT|>",
    "é<|endoftext|>é \n", "plain words", "",
]


@pytest.fixture(scope="module")
def contract():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids(contract, text):
    assert packing.encoder()(text) == packing.slow_encoder()(text) == contract(text)


def test_pieces(spark, contract):
    found = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")).collect()
    assert contract(TEXTS[0]) == [64, 220, 50256, 275] and len(found) == len(TEXTS)
    for r in found:
        ids = np.array([*contract(TEXTS[r["doc_id"]]), packing.SEPARATOR])
        assert (r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) == (0, len(ids), len(ids), packing.checksum(ids))
