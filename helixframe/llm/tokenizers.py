"""Where the vocabulary files of public tokenizers are."""

from __future__ import annotations

import os


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The path of a vocabulary file: in folder, else where the public_tokenizers package keeps it."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
