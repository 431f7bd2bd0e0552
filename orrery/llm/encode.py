"""Token ids of whole texts with public tokenizers, each distinct word encoded once a worker."""

from __future__ import annotations

import array
import json
import os
import re

import numpy as np

from orrery.llm.common import SPACE

# White space beyond ASCII, or that libraries see differently: such texts are encoded in one piece.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
# A word with the space before it, or white space up to the last character before a word.
BYTE_CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_CHUNKS = re.compile(f"[^{SPACE}]+")
# Characters whose classes are the same in every library, and of these the letters and numbers.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u024f]*")
L, N = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
# How the two tokenizer files cut a text into pieces for their merges.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_SPLIT = CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same cuts in plain characters.
BYTE_PIECES = re.compile(rf"{CONTRACTIONS}| ?[{L}]+| ?[{N}]+| ?[^{SPACE}{L}{N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PIECES = re.compile(rf"{CONTRACTIONS}|[{L}]+|[{N}]|[^{SPACE}{L}{N}]+")
CACHE, LONG = 400_000, 64


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself if it can be printed, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known(dict):
    """Ids of chunks as bytes; a missing one is encoded and kept, and all are dropped when too many are."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """encode(text) gives the ids of Tokenizer.encode(text, add_special_tokens=False).

    A text of plain characters is cut into the tokenizer's pieces here, and its model encodes each
    distinct piece once. Other texts are cut at white space, where the tokenizer never joins
    characters across it, and each distinct chunk goes through the whole tokenizer; for any other
    tokenizer the whole text does, and so does a text that holds the string of an added token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = before.get("pretokenizers") or [before]
        self.chunks, self.odd, self.pieces = None, None, None
        if steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space") and not norm:
            self.chunks, self.odd, self.pieces = BYTE_CHUNKS, ODD_SPACE, BYTE_PIECES
        elif steps[0].get("type") == "Split" and (steps[0].get("pattern") or {}).get("Regex") == WORD_SPLIT and steps[1].get("type") == "ByteLevel":
            self.chunks, self.pieces = WORD_CHUNKS, WORD_PIECES
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self.code = (np.dtype("=u2"), "H") if small else (np.dtype("=u4"), "I")
        self.letters = byte_letters()
        self.space = chr(self.letters[32])
        self.model, self.lower = self.tokenizer.model, self.pieces is WORD_PIECES
        self.piece_ids, self.chunk_ids = Known(self._piece), Known(self._whole)

    def _whole(self, text: str) -> bytes:
        safe = text.encode("utf-8", "replace").decode()
        return array.array(self.code, self.tokenizer.encode(safe, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self.space)
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array.array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def cut(self, text: str) -> tuple[Known, list[str]] | None:
        """The parts of a text that can be encoded alone and the map of their ids; None where only the whole text can."""
        if any(s in text for s in self.added):
            return None
        if self.pieces and PLAIN.fullmatch(text):
            return self.piece_ids, self.pieces.findall(text.lower() if self.lower else text)
        if self.chunks and not (self.odd and self.odd.search(text)):
            return self.chunk_ids, self.chunks.findall(text)
        return None

    def encode(self, text: str) -> np.ndarray:
        parts = self.cut(text)
        ids = b"".join(map(parts[0].__getitem__, parts[1])) if parts else self._whole(text)
        return np.frombuffer(ids, self.dtype)

    def with_end(self, text: str, end: int) -> np.ndarray:
        ids = self.encode(text)
        return np.append(ids, np.array(end, self.dtype)) if end <= np.iinfo(self.dtype).max else np.append(ids.astype("<u4"), end)
