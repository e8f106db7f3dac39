"""Ids of a byte-level BPE file, for whole documents, at a rate that a corpus allows.

The file is that of the ``tokenizers`` library. Its vocabulary's ids are its merge ranks, so
``tiktoken`` gives the same ids from it several times as fast (tests hold both against each
other). Texts that hold a special token's string go through ``tokenizers`` itself, and so does any
text on which the fast path gives up (its pattern overflows a stack on a run of about a million
blanks), so no text is too long.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .tokens import byte_level_pieces

#: The published split pattern of this family of vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class DocumentTokenizer:
    def __init__(self, tokenizer_json: str):
        import tiktoken

        model = json.loads(tokenizer_json)
        pieces = byte_level_pieces(tokenizer_json)
        special = [t["content"] for t in model.get("added_tokens", [])]
        ranks = {piece: k for piece, k in zip(pieces, (v for t, v in model["model"]["vocab"].items() if t not in special))}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.json, self.whole = tokenizer_json, None

    def ids(self, text: str) -> np.ndarray:
        """Ids as int32, as ``encode(text, add_special_tokens=False)`` gives them."""
        if self.special.search(text):
            return self._by_library(text)
        try:
            return np.array(self.fast.encode_ordinary(text), np.int32)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # the fast path's only own exception; it derives from BaseException
                raise
            return self._by_library(text)

    def _by_library(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.json)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)
