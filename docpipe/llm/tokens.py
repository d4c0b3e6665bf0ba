"""Token ids of whole texts: the ids of the tokenizers library.

Texts of usual characters go through a faster library that is given the same vocabulary; all others through the
library whose ids are wanted. tests/llm/test_tokens.py compares both on texts of all kinds.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import tiktoken

#: Characters whose class, case and composition no version of Unicode changed: ASCII and Latin letters, less the white
#: space outside ASCII and the zero byte. Texts of these are encoded by the faster library with the same vocabulary.
_UNUSUAL = re.compile(r"[^\x01-\x1b\x20-\x84\x86-\x9f\xa1-\u024f]")
_END_OF_WORD = "\0"


def load(path: str):
    """A tokenizer of the library without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _usual(kind: str) -> str:
    """The usual characters of a class (L: letters, N: numbers), for a set in a pattern."""
    return "".join(c for c in map(chr, range(1, 0x250)) if unicodedata.category(c)[0] == kind)


def _byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> tuple[dict[bytes, int], dict[str, int], dict]:
    """Ranks by the bytes of a token (a zero byte ends a word), special tokens, and the file's content."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters, ending = _byte_letters(), content["model"]["end_of_word_suffix"] or ""
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    ranks = {}
    for token, number in content["model"]["vocab"].items():
        if token not in special:
            ends = bool(ending) and token.endswith(ending) and token != ending
            ranks[bytes(letters[c] for c in token[: len(token) - len(ending) * ends]) + b"\0" * ends] = number
    return ranks, special, content


class SpaceEncoder:
    """For vocabularies that join a space with the word after it: whole texts to ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        ranks, special, _ = _ranks(path)
        self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if _UNUSUAL.search(t):
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
            else:
                ids = self.fast.encode(t, allowed_special="all")
            out.append(array("I", ids).tobytes())
        return out


class WordEncoder:
    """For vocabularies that drop white space and mark ends of words: UTF-8 to (ids as bytes, decoded text as UTF-8)."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        ranks, self.special, content = _ranks(path)
        # Every piece is given a mark at its end, which joins with its last byte first: those pairs have the lowest ranks.
        self.fast = tiktoken.Encoding("fast", pat_str=rf"[^{_END_OF_WORD}]+{_END_OF_WORD}", mergeable_ranks=ranks, special_tokens={})
        pattern = content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for kind in "LN":
            pattern = pattern.replace(rf"[\p{{{kind}}}]", f"[{_usual(kind)}]").replace(rf"\p{{{kind}}}", _usual(kind))
        self.cut = re.compile(pattern)
        # Without a decoder the library joins the tokens with spaces.
        self.names = None
        if self.tokenizer.decoder is None:
            self.names = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]

    def _ids(self, text: str) -> list[int]:
        if _UNUSUAL.search(text) or any(x in text for x in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        pieces = self.cut.findall(text.lower())
        return self.fast.encode_ordinary(_END_OF_WORD.join(pieces) + _END_OF_WORD) if pieces else []

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.names is None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()
        names = self.names
        return b" ".join([names[i] for i in numbers])

    def ids(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", self._ids(t.decode())).tobytes() for t in texts]

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        return [(ids, self.decode(ids)) for ids in self.ids(texts)]
