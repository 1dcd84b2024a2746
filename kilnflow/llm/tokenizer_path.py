"""Where the public tokenizer's vocabulary file lies; a parameter of the operators, this is its default."""

from __future__ import annotations


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
