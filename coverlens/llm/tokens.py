"""Token ids of whole texts, with the tokenizers library.

A byte-level tokenizer with the usual split pattern starts a new piece before every space that a visible character
follows, around a lone line break, and between a letter or number and a mark like a full stop. So a text's ids are the ids of such
pieces one after another, and each worker encodes a piece once and looks it up from then on. A piece of letters only is one
word to the split pattern, so it goes to the tokenizer's model directly. Other tokenizers get whole texts.
"""
import json
import os
import re
import struct

import numpy as np

#: Pieces that one worker remembers for good, and further ones that it remembers for a while.
REMEMBERED = 600_000
RECENT = 150_000

_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")
#: Marks that a worker cuts off the letters or numbers before them.
_MARKS = r".,;:!?*#$%&()\""
_INNER = re.compile(rf"(?<=[^\W_])(?=[{_MARKS}])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def tokenizer_path(name="byte_bpe_50k.json"):
    """The file of a public tokenizer; any other path can be given to the operators instead."""
    import public_tokenizers
    return public_tokenizers.path(name)


def id_width(vocabulary_size):
    """Bytes that hold any id."""
    return 2 if vocabulary_size <= 1 << 16 else 4


class _Remember(dict):
    """What `encode` gives for a key: kept for good until `limit`, then for a while."""

    def __init__(self, encode, limit, recent):
        super().__init__()
        self.encode, self.limit, self.most, self.recent = encode, limit, recent, {}

    def __missing__(self, key):
        ids = self.recent.get(key)
        if ids is None:
            ids = self.encode(key)
            if len(self) < self.limit:
                self[key] = ids
            else:
                if len(self.recent) >= self.most:
                    self.recent.clear()
                self.recent[key] = ids
        return ids


def _splits_at_spaces(path):
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") and re.fullmatch(rf"[^\s{_MARKS}]+", t["content"])
                for t in spec.get("added_tokens", []))
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not spec.get("truncation") and plain)


def _written_bytes():
    """How a byte-level model writes bytes as characters: visible ones as themselves, the others from 256 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}


_WRITTEN = _written_bytes()
_SPACE = chr(_WRITTEN[0x20])


def _letters(word):
    """Letters only, all of scripts that have been settled for long in every version of Unicode."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0530")


def _words_are_whole(path):
    """No added token consists of letters, and the model gives one result per word."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    return (model.get("type") == "BPE" and not model.get("dropout")
            and not any(t["content"].isalpha() for t in spec.get("added_tokens", [])))


class Encoder:
    """text -> little-endian ids as bytes, `width` bytes each; without special tokens added."""

    def __init__(self, path, remembered=REMEMBERED, recent=RECENT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self.width = id_width(self._tok.get_vocab_size())
        self._by_piece = _splits_at_spaces(path)
        self._model = self._tok.model if self._by_piece and _words_are_whole(path) else None
        self._letter = "H" if self.width == 2 else "I"
        self._spaced = _Remember(self._encode_spaced, remembered, recent)
        self._bare = _Remember(self._encode_bare, remembered // 6, recent // 6)

    def _ids(self, text):
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def _word(self, word, space=""):
        """Ids of letters, with or without a space before them."""
        written = word if word.isascii() else word.encode().decode("latin-1").translate(_WRITTEN)
        found = self._model.tokenize(space + written)
        return struct.pack(f"<{len(found)}{self._letter}", *[t.id for t in found])

    def _encode_spaced(self, word):
        if self._model is not None and _letters(word):
            return self._word(word, _SPACE)
        parts = _INNER.split(" " + word)
        if len(parts) == 1:
            return self._ids(parts[0])
        return self._spaced[parts[0][1:]] + b"".join([self._bare[p] for p in parts[1:]])

    def _encode_bare(self, word):
        if self._model is not None and _letters(word):
            return self._word(word)
        parts = _INNER.split(word)
        return self._ids(word) if len(parts) == 1 else b"".join([self._bare[p] for p in parts])

    def __call__(self, text):
        if not text:
            return b""
        if not self._by_piece:
            return self._ids(text)
        parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        return self._bare[parts[0]] + b"".join(map(self._spaced.__getitem__, parts[1:]))


def encoder(path):
    """The encoder of this worker process: kept between tasks, so that they share what it remembers."""
    import tokenizers
    kept = vars(tokenizers).setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def ids_of(data, width):
    return np.frombuffer(data, f"<u{width}")


def crc32_of(ids):
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib
    return zlib.crc32(ids.astype("<u4").tobytes())
