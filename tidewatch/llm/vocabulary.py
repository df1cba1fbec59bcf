"""The production tokenizer: rank file and pre-token pattern, from the installed package of public vocabularies."""

from __future__ import annotations

NAME = "byte_bpe_multi_50k.tiktoken"


def production_vocabulary(name: str = NAME) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
