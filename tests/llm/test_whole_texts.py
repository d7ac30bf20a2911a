"""A tokenizer that is not plain byte-level gets long texts whole."""

import json

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import packing


def test_normalising_tokenizer_gets_whole_texts(monkeypatch, tmp_path):
    settings = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    settings["normalizer"] = {"type": "Strip", "strip_left": True, "strip_right": True}
    path = tmp_path / "strip.json"
    path.write_text(json.dumps(settings))
    monkeypatch.setattr(packing, "PART", 50)
    text = "The quick brown fox  jumps, over 12 lazy dogs. " * 40
    assert np.frombuffer(packing.Ids(str(path))(text), "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
