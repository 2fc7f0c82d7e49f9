"""Token ids of whole texts by the tokenizers library, one encoding per distinct piece of text.

Byte-level BPE first cuts a text into pieces by a fixed pattern and then encodes every piece by
itself. Pieces repeat far more often than they are new, so their ids are kept in a bounded table. New ones are
merged many at once by the library's rules (``merges``), long ones by its model. Texts with characters whose class may differ between Unicode versions, or with the
name of a special token, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

from veilspan.llm.merges import LONGEST, Merges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the cutting pattern of the byte-level vocabulary, as published with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts without characters of ``_RARE``: letters, digits and spaces spelled out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_CUT = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_RARE = re.compile("[^\u0000-\u024f\u2010-\u2027\u20ac]")
_HELD = 1 << 17  # pieces looked up at a time: those that are new among them are merged together
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class _Spelling(dict):
    """Characters to their bytes' letters, filled as they are met (for ``str.translate``)."""

    def __init__(self):
        super().__init__()
        self.letters = _byte_letters()

    def __missing__(self, code: int) -> str:
        self[code] = "".join(self.letters[b] for b in chr(code).encode())
        return self[code]


def _merges(tokenizer) -> Merges | None:
    """The library's byte-pair model, where it is a plain one."""
    model = json.loads(tokenizer.to_str())["model"]
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    letters = [model.get("vocab", {}).get(c) for c in _byte_letters()]
    if model.get("type") != "BPE" or any(model.get(k) for k in odd) or None in letters or max(model["vocab"].values()) >= 0xFFFF:
        return None
    pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
    return Merges(letters, [(model["vocab"][x], model["vocab"][y], model["vocab"][x + y]) for x, y in pairs])


class _Known:
    """Pieces to ids; emptied when it holds too many characters."""

    def __init__(self, tokenizer, max_chars: int):
        self.ids: dict[str, bytes] = {}
        self.model, self.merges = tokenizer.model, _merges(tokenizer)
        self.room, self.max_chars = max_chars, max_chars
        self.spelling = _Spelling()

    def learn(self, pieces: set[str]) -> list[str]:
        """Make all ``pieces`` known; gives those too long to be kept."""
        new = list(pieces.difference(self.ids))
        if not new:
            return []
        room = self.room - sum(map(len, new)) - 24 * len(new)
        if room < 0 and self.ids:
            self.ids.clear()
            self.room = self.max_chars
            return self.learn(pieces)
        self.room = room
        sizes = np.fromiter(map(len, new if "".join(new).isascii() else map(str.encode, new)), np.int64, len(new))
        short = sizes <= LONGEST if self.merges else np.zeros(len(new), dtype=bool)
        for k in np.flatnonzero(~short).tolist():
            self.ids[new[k]] = array("H", [t.id for t in self.model.tokenize(new[k].translate(self.spelling))]).tobytes()
        large = [p for p in new if len(p) >= self.max_chars >> 8] if not short.all() else []
        if short.any():
            new = new if short.all() else [new[k] for k in np.flatnonzero(short).tolist()]
            order, ids = self.merges("".join(new).encode(), sizes[short])
            self.ids.update(zip(map(new.__getitem__, order), ids, strict=True))
        return large


class Encoder:
    """Texts to ids (unsigned 16-bit, little-endian bytes), as ``Tokenizer.encode`` gives them without added special
    tokens: the name of a special token within a text is that token."""

    def __init__(self, path: str, max_chars: int = 24_000_000):
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise ValueError("little-endian machines only")
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(self.tokenizer, max_chars)

    def _whole(self, text: str) -> bool:
        return not text.isascii() and _RARE.search(text) is not None or any(s in text for s in self.special)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        known, out, cut, held = self.known, [], [], 0
        ids = known.ids.__getitem__

        def settle() -> None:
            large = known.learn(set().union(*(pieces for _, pieces in cut)))
            for place, pieces in cut:
                out[place] = b"".join(map(ids, pieces))
            for piece in large:
                known.room += len(piece) + 24
                del known.ids[piece]
            cut.clear()

        for text in texts:
            if not text:
                out.append(b"")
            elif self._whole(text):
                out.append(array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                cut.append((len(out), _CUT.findall(text)))
                out.append(b"")
                held += len(cut[-1][1])
                if held > _HELD:
                    settle()
                    held = 0
        settle()
        return out


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
