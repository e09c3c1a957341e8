"""Encoding of whole texts with a public tokenizer, which is asked once for each distinct word.

Splitting a text at a space is exact for two kinds of tokenizer files, because no token of theirs spans such a place:

* ``drop``: the tokenizer drops white space, so pieces between spaces are independent.
* ``lead``: a token may begin with one space, so every piece but the first is encoded with the space before it.
  Where white space precedes a space (runs), the pieces depend on each other and the whole text is encoded directly.

The kind is read from the file; any other tokenizer is ``whole``: each text goes through it in one piece. So does a
text that holds the string of a special token, which the tokenizer makes into that token's id.
"""

from __future__ import annotations

import gc
import json
import re
from itertools import chain

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tessera.llm.common import remembered

#: A space after any white space: there a piece depends on the one before.
RUN = re.compile(rf"[\s{chr(0x180E)}] ")
#: Letters that stay one unit through normalisation and pre-splitting, and what follows from the first ASCII punctuation on,
#: where the tokenizer's own pre-splitting cuts too, in both kinds.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~].*)?", re.DOTALL)
#: Pieces, and endings of pieces, remembered by one Python worker. Of pieces a full memory is kept until the next one is
#: full, and what is used again moves on; nothing of this changes more than time.
REMEMBERED, ENDINGS = 400_000, 100_000
#: Text bytes that are encoded at a time; the pieces of a text need many times its bytes.
ENCODED_BYTES = 2 << 20
#: Words that are handed to the tokenizer as one string.
TOGETHER = 16_000


def kind_of(path: str) -> str:
    """How texts may be split for the tokenizer of a file, by its normaliser, its pre-tokenizer and its model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, before, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if model.get("type") != "BPE" or spec.get("post_processor") or any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
        return "whole"
    if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "lead"
    steps = [x.get("type") for x in (normal or {}).get("normalizers", [])]
    first, *rest = before.get("pretokenizers", [{}])
    splits = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", "")
    if steps == ["NFC", "Replace", "Lowercase"] and splits and [(x.get("type"), x.get("use_regex")) for x in rest] == [("ByteLevel", False)] and model.get("end_of_word_suffix"):
        return "drop"
    return "whole"


class Encoder:
    def __init__(self, path: str, kind: str | None = None, special: bool = True):
        """``special``: strings of special tokens inside a text become their ids; else they are ordinary text."""
        self.kind = kind or kind_of(path)
        if self.kind not in ("drop", "lead", "whole"):
            raise ValueError(f"unknown kind {kind!r}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added if special or not t.special]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # for words of plain letters in lower case neither normaliser nor pattern has anything to do
        self.plain = Tokenizer.from_file(path) if self.kind == "drop" else self.tokenizer
        if self.kind == "drop":
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # the tokens with which words end (drop) or begin (lead)
        self.edge = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.endswith(suffix) if self.kind == "drop" and suffix else token.startswith("Ġ")
        self.before: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.endings: dict[str, bytes] = {}

    def _one_by_one(self, memory: dict[str, bytes], units: list[str], lead: str) -> None:
        for i in range(0, len(units), TOGETHER):
            part = units[i : i + TOGETHER]
            for unit, e in zip(part, self.tokenizer.encode_batch_fast([lead + x for x in part], add_special_tokens=False), strict=True):
                memory[unit] = np.array(e.ids, self.dtype).tobytes()

    def _together(self, memory: dict[str, bytes], words: list[str]) -> None:
        """Words of plain letters as one string; the ids show where each of them begins or ends."""
        width = self.dtype.itemsize
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            joined = " " + " ".join(part)
            ids = np.array(self.plain.encode_batch_fast([joined.lower() if self.kind == "drop" else joined], add_special_tokens=False)[0].ids, self.dtype)
            raw, at = ids.tobytes(), np.flatnonzero(self.edge[ids]) * width
            cuts = [0, *(at + width).tolist()] if self.kind == "drop" else [*at.tolist(), len(raw)]
            memory.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def _ask(self, memory: dict[str, bytes], new: set[str], lead: str, together: bool) -> None:
        """Remember new pieces, some at a time."""
        ordered, endings = list(new), self.endings
        for i in range(0, len(ordered), 3 * TOGETHER):
            part = ordered[i : i + 3 * TOGETHER]
            found = [WORD.fullmatch(x) for x in part]
            words = list({m[1] for m in found if m}.difference(memory))
            if together:
                self._together(memory, words)
            else:
                self._one_by_one(memory, words, lead)
            self._one_by_one(endings, list({m[2] for m in found if m and m[2]}.difference(endings)), "")
            self._one_by_one(memory, [x for x, m in zip(part, found, strict=True) if not m], lead)
            memory.update([(m[0], memory[m[1]] + endings[m[2]]) for m in found if m and m[2]])

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """For each text its ids and the end id, as little-endian bytes of ``dtype``."""
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects, and no cycles among them
        try:
            return self._encode(texts, end)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str], end: int) -> list[bytes]:
        tail = np.array([end], self.dtype).tobytes()
        whole, lead = self.kind == "whole", self.kind == "lead"
        direct = {i for i, x in enumerate(texts) if whole or (lead and RUN.search(x)) or any(t in x for t in self.special)}
        # where white space is dropped, the end of a line is as good a place as a space
        split = [[] if i in direct else (x if lead else x.replace("\n", " ")).split(" ") for i, x in enumerate(texts)]
        out: list[bytes] = [tail] * len(texts)
        if len(self.later) > REMEMBERED:
            self.before, self.later = self.later, {}
        if len(self.first) > ENDINGS:
            self.first = {}
        if len(self.endings) > ENDINGS:
            self.endings = {}
        first, later = self.first, self.later
        if lead:
            self._ask(first, {x[0] for x in split if x}.difference(first), "", False)
        pieces = list(chain.from_iterable(x[1:] for x in split) if lead else chain.from_iterable(split))
        found = list(map(later.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        new, before = {pieces[i] for i in missing}, self.before
        again = [x for x in new if x in before]
        later.update(zip(again, map(before.__getitem__, again), strict=True))
        self._ask(later, new.difference(again), " " if lead else "", True)
        for i in missing:
            found[i] = later[pieces[i]]
        at = 0
        for i, x in enumerate(split):
            if x:
                upto = at + len(x) - lead
                out[i] = b"".join([first[x[0]], *found[at:upto], tail] if lead else [*found[at:upto], tail])
                at = upto
        for i in direct:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.dtype).tobytes() + tail
        return out


def encoder(path: str, kind: str | None = None, special: bool = True) -> Encoder:
    """One encoder for each Python worker, file and stage."""
    return remembered(f"encoder {kind} {special} {path}", lambda: Encoder(path, kind, special))


def id_width(path: str) -> np.dtype:
    return np.dtype("<u2") if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else np.dtype("<u4")
