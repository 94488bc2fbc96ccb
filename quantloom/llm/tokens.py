"""Token ids of whole texts, with a bounded cache of words in each Python worker."""

from __future__ import annotations

import json
import os
import re
from array import array

#: Entries of a worker's cache of words and of its smaller one of other pieces. A full cache stays, as frequent words come early, until
#: 16 times as many look-ups have missed it; then it starts anew.
CACHE_WORDS, CACHE_PIECES = 550_000, 100_000


class Cache(dict):
    def __init__(self, most: int) -> None:
        self.most, self.missed = most, 0

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self) < self.most:
            self[key] = value
        else:
            self.missed += 1
            if self.missed > 16 * self.most:
                self.clear()
                self.missed = 0
        return value
#: Words of printable ASCII and the accented letters of Latin-1, and how the vocabulary's own rules split them in lower case.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Byte-level vocabularies write a byte as itself if it is printable Latin-1, else as one of the characters from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_CHAR = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: White space to str.split() but not to the vocabulary's rules.
_ODD = re.compile("[\x1c-\x1f]")
_BLANK = re.compile("[ \t-\r\x85\xa0  -     　]+")
#: The rules under which words can be encoded one by one, and Latin ones be cut by _PIECES: fixed values, as such vocabulary files have them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_coders: dict[str, "WordCoder"] = {}


def splits_at_blanks(rules: dict) -> bool:
    """Whether a vocabulary file's rules, as JSON, are those above, with special tokens that are neither stripped nor hold blanks."""
    tokens = rules.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) and not re.search(r"\s", t["content"]) and t["content"].startswith("<|") for t in tokens)
    return plain and rules.get("normalizer") == NORMALIZER and rules.get("pre_tokenizer") == SPLITTER and rules["model"].get("type") == "BPE"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    """Encodes a text as little-endian unsigned 32-bit ids, equal to the library's own for the whole text.

    For a vocabulary that drops white space and never looks across it, a text's ids are its
    words' ids in a row, so each word is encoded once and kept. Latin words are cut into
    pieces here and the pieces go to the library's model; any other word goes through its
    normalizer and splitter first, one with a special token through the whole library. Vocabularies with other rules
    (splits_at_blanks) are encoded text by text, whatever their names.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.model = self.coder.model
        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_blanks(json.load(f))
        self.specials = tuple(t.content for t in self.coder.get_added_tokens_decoder().values())
        self.words, self.pieces = Cache(CACHE_WORDS), Cache(CACHE_PIECES)

    def _whole(self, text: str) -> bytes:
        ids = self.coder.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _latin(self, piece: str) -> bytes:
        if (out := self.words.get(piece)) is None:
            out = self.words.keep(piece, self._ids(piece.encode().decode("latin-1").translate(_AS_CHAR)))
        return out

    def _piece(self, piece: str) -> bytes:
        if (out := self.pieces.get(piece)) is None:
            out = self.pieces.keep(piece, self._ids(piece))
        return out

    def _word(self, word: str) -> bytes:
        # A piece is a word with the same ids, so both share a cache.
        if _LATIN.fullmatch(word) and "<|" not in word:
            low = word.lower()
            return self._latin(low) if low.isalpha() else b"".join([self._latin(p) for p in _PIECES.findall(low)])
        if any(s in word for s in self.specials):
            return self._whole(word)
        return b"".join([self._piece(p) for p, _ in self.coder.pre_tokenizer.pre_tokenize_str(self.coder.normalizer.normalize_str(word))])

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        split = _BLANK.split(text) if _ODD.search(text) else text.split()
        words = self.words
        try:
            return b"".join([words[w] for w in split])
        except KeyError:
            pass
        out = []
        for w in split:
            if (ids := words.get(w)) is None:
                ids = words.keep(w, self._word(w))
            out.append(ids)
        return b"".join(out)


def coder(path: str) -> WordCoder:
    """The worker's coder for a vocabulary file, made once."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
