"""Tokenizers of other kinds than the default, against the library."""

import json
import zlib
from pathlib import Path

import numpy as np
import pytest

from kilnflow.llm import token_files
from kilnflow.llm.tokenizer_path import default_tokenizer

TEXTS = ["Some words, and others'll do.\n  Then 12 more é! ", "", "ＦＵＬＬ width ﬁ and 2024, twice  spaced", "<|endoftext|> within <|endoftext|>.", "UPPER lower " * 400, " leading", None]


def other(spec, kind):
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if kind == "white space":
        spec["pre_tokenizer"] = {"type": "Whitespace"}
    elif kind == "lower case and prefix space":
        spec["normalizer"], spec["pre_tokenizer"] = {"type": "Lowercase"}, byte_level | {"add_prefix_space": True}
    elif kind == "NFKC and digits":
        spec["normalizer"], spec["pre_tokenizer"] = {"type": "NFKC"}, {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, byte_level]}
    elif kind == "truncated and padded":
        spec["truncation"] = {"direction": "Right", "max_length": 8, "strategy": "LongestFirst", "stride": 0}
        spec["padding"] = {"strategy": {"Fixed": 16}, "direction": "Right", "pad_to_multiple_of": None, "pad_id": 0, "pad_type_id": 0, "pad_token": "<|endoftext|>"}
    return spec


KINDS = ["as it is", "white space", "lower case and prefix space", "NFKC and digits", "truncated and padded", "words"]


def file_of(kind, folder):
    path = Path(default_tokenizer())
    if kind == "words":
        return str(path.with_name("word_bpe_49k.json"))
    (folder / "t.json").write_text(json.dumps(other(json.loads(path.read_text()), kind)))
    return str(folder / "t.json")


@pytest.mark.parametrize("kind", KINDS)
def test_ids_equal_the_library(kind, tmp_path):
    from tokenizers import Tokenizer

    path = file_of(kind, tmp_path)
    plain = Tokenizer.from_file(path)
    plain.no_truncation()
    plain.no_padding()
    encoder = token_files.Encoder(path)
    texts = [t or "" for t in TEXTS]
    for _ in range(2):  # the second time words are remembered
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.plain == (kind in ("as it is", "truncated and padded"))


@pytest.mark.parametrize("kind", ["NFKC and digits", "words"])
def test_files_of_another_tokenizer(spark, kind, tmp_path):
    from tokenizers import Tokenizer

    path = file_of(kind, tmp_path)
    plain = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    token_files.write_blocks(docs, path, str(tmp_path / "out"), end_id=7)
    rows = token_files.read_documents(spark, str(tmp_path / "out"), with_ids=True).orderBy("doc_id").collect()
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 7] for t in TEXTS]
    assert [r.ids for r in rows] == want and [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    with pytest.raises(ValueError, match="no id"):
        token_files.write_blocks(docs, path, str(tmp_path / "no"), end_id=10**6)
