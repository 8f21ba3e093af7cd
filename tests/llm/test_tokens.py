"""Ids of words against the tokenizers library."""

import json

import numpy as np
import pytest

from paneltide.llm.tokens import WordEncoder, default_tokenizer

TEXTS = [
    "a <|ENDOFTEXT|> b", "A<|EndOfText|>B Hello", "x <|endoftext|>Y", "<|startoftext|>", "<|STARTOFTEXT|>\n<|endoftext|>, End.",
    "Plain Text, With Case!", "CafÉ ÁB <|ENDofTEXT|>", "",
]


@pytest.mark.parametrize("cased", [False, True])
def test_added_tokens_and_case(tmp_path, cased):
    from tokenizers import Tokenizer

    path = default_tokenizer()
    if cased:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
        path = str(tmp_path / "cased.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec, f)
    library, ours = Tokenizer.from_file(path), WordEncoder(path)
    for text in TEXTS * 2:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
