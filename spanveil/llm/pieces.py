"""Pre-tokens of a tokenizer's file, their pieces, and token ids of a document from those of its words."""

from __future__ import annotations

import json
import re
from array import array

# The byte alphabet of byte-level tokenizers, and the normaliser and splitter
# for which a word of letters and marks can be encoded part by part.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Letters, then marks: both are pre-tokens of their own, and case and form need no tables.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!#$%&()*+,\-./:;=?@|]*)")
#: Longer words are encoded each time.
LONGEST = 200
#: What a tokenizer is tried on, to see whether white space parts its texts for good.
_TRIED = ("it's", "Don't,", "(x)", "...", "42", "日本", "été!", "a-b", "'s", "x_y", "[", "#")


class PreTokens:
    """The tokenizer of a file, and what it cuts texts into before it looks for pieces.

    by_words: the ids of a text are those of its words (cut at ASCII white space), one
    after the other. So it is for tokenizers that drop white space, which is told from the
    file's added tokens and by trial. Words are then pre-tokens. For others, pre-tokens are
    what the file's own normaliser and splitter make of the text between special strings.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = told.get("added_tokens") or []
        self.simple = told.get("normalizer") == _NORMALIZER and told.get("pre_tokenizer") == _SPLITTER
        alone = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["content"].split() != [x["content"]] for x in added)
        self.by_words = alone and all(self.ids(a + s + b) == self.ids(a) + self.ids(b) for a in _TRIED for b in _TRIED for s in " \n\t")
        # without words, special strings are cut out here; those that are matched in another way leave the text whole
        self.whole = any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added)
        self.special = {x["content"].encode() for x in added}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def split(self, text: bytes) -> list[bytes]:
        if self.by_words:
            return text.split()
        if self.whole:
            return [text] if text else []
        out: list[bytes] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                plain = part.decode("utf-8", "replace")
                plain = self.tokenizer.normalizer.normalize_str(plain) if self.tokenizer.normalizer else plain
                out += [x.encode() for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)] if self.tokenizer.pre_tokenizer else [plain.encode()]
        return out

    def parts(self, word: str) -> list[str] | None:
        """What a word of letters and marks is cut into, for the one splitter that this knows."""
        simple = _SIMPLE.fullmatch(word) if self.simple and len(word) <= LONGEST else None
        if simple is None:
            return None
        letters, marks = simple.groups()
        letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_ALPHABET)
        return [x for x in (letters, marks) if x]

    def pieces(self, word: bytes) -> int:
        """The number of pieces of a pre-token that `split` gives."""
        text = word.decode("utf-8", "replace")
        if not self.by_words and not self.whole:
            return 1 if word in self.special else len(self.model.tokenize(text))
        parts = self.parts(text)
        return len(self.ids(text)) if parts is None else sum(len(self.model.tokenize(x)) for x in parts)

    def encoded(self, word: str) -> list[int]:
        parts = self.parts(word)
        return self.ids(word) if parts is None else [x.id for part in parts for x in self.model.tokenize(part)]


class WordIds(dict):
    """Little-endian unsigned 32-bit ids by word, both as bytes; a worker keeps those of a fixed number of words."""

    def __init__(self, path: str, room: int = 400_000):
        super().__init__()
        self.cutter, self.room = pre_tokens(path), room

    def __missing__(self, word: bytes) -> bytes:
        ids = array("I", self.cutter.encoded(word.decode("utf-8", "replace"))).tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        if not self.cutter.by_words:
            return array("I", self.cutter.ids(text.decode("utf-8", "replace"))).tobytes()
        if len(self) > self.room:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


_cutters: dict[str, PreTokens] = {}
_kept: dict[str, WordIds] = {}


def pre_tokens(path: str) -> PreTokens:
    """This worker's tokenizer, made once."""
    if path not in _cutters:
        _cutters[path] = PreTokens(path)
    return _cutters[path]


def word_ids(path: str) -> WordIds:
    """This worker's table; tasks that follow in the same worker find it filled."""
    if path not in _kept:
        _kept[path] = WordIds(path)
    return _kept[path]
