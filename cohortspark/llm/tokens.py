"""Token ids of whole texts by a byte-level BPE file."""

from __future__ import annotations

import json
import os
import re
import struct

import tiktoken
from tokenizers import Tokenizer

# Fixed value: how a byte-level vocabulary splits a text into words before merging.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Byte-level vocabularies write a byte as the Latin-1 character of its value if that is visible, and the others, in order,
#: as the characters from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
_BYTES = {chr(b): b for b in range(256) if b not in _HIDDEN} | {chr(256 + i): b for i, b in enumerate(_HIDDEN)}

#: Characters of blocks that have long been settled; the two libraries may follow different versions of Unicode in others.
_UNSETTLED = re.compile("[^\t\n\r -~\xa1-ɏ]")


class WordTokens:
    """``encode`` gives little-endian 32-bit ids, equal to those of the tokenizer on the whole text.

    Where the file's merges are numbered in the order in which they apply, as rank tables have it, a faster encoder of the
    same merges is used.  Texts that hold a special token or characters outside the settled blocks, and those whose white
    space is too long for that encoder, go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path)

    def _ranked(self, path: str) -> tiktoken.Encoding | None:
        """The same vocabulary as a table of ranks, if it is one."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, split = whole["model"], whole.get("pre_tokenizer") or {}
        plain = split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or not plain or whole.get("normalizer") or any(model.get(o) for o in options):
            return None
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        numbers = [ids.get(a + b, -1) for a, b in merges]
        ranks = {bytes(_BYTES[c] for c in word): i for word, i in ids.items() if word not in self.special}
        letters = [ranks.get(bytes([b]), 1 << 40) for b in range(256)]
        if len(ranks) != 256 + len(merges) or any(a >= b for a, b in zip([max(letters), *numbers], numbers)):
            return None
        return tiktoken.Encoding("file", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._encode(text) for text in texts]

    def _encode(self, text: str) -> bytes:
        if self.ranked is not None and not _UNSETTLED.search(text) and not any(s in text for s in self.special):
            try:
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # a run of some hundred thousand blanks, which its splitter cannot hold
                pass
        return self._whole(text)


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The encoder of a vocabulary file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]
