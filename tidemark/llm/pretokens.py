"""Pre-tokens of whole texts for word-level byte-pair vocabularies."""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import regex

# White space and letters whose lower case does not depend on their neighbours, up to the spacing modifiers.
PLAIN = regex.compile(r"[\t\n\v\f\r -~\x85\xa0¡-¬®-įĲ-˿]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a fixed, published rule)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PreTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        parts = self.spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split"))
        self.specials = [t["content"] for t in self.spec["added_tokens"]]

    def cut(self, text: str) -> list[str] | None:
        """Pre-tokens of a text that needs no care: plain letters, composed, without special strings; else None."""
        if not PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return None
        return None if any(s in text for s in self.specials) else self.pattern.findall(text.lower())


@lru_cache(maxsize=2)
def pretokens(path: str) -> PreTokens:
    return PreTokens(path)
