"""Token ids and token counts of whole texts, with the library's own results.

A text is cut at spaces where every pre-tokenizer match must end, so the cost of a
repeated piece is paid once per worker: each distinct piece goes through the library and
its result is remembered.  The memory is emptied when it is full, never grown.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

# Distinct pieces remembered by one Python worker.
REMEMBERED = 400_000

# Letters without unusual case or composition rules, and ASCII marks that belong to no
# contraction and no special token: such runs are always separate matches.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ſ"
_MARKS = "!\"#$%&()*+,./:;=?@\\[\\]^_`{}~|-"
_WORD = re.compile(f"([{_LETTERS}]*)([{_MARKS}]*)")
_LINES = re.compile(f"([{_LETTERS}]*)([{_MARKS}]*)(\n(?=[^\\s]))?([{_LETTERS}]*)([{_MARKS}]*)")
_CUT = re.compile(r" (?=\S)")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of a vocabulary that lower-cases and drops white space, as uint32 bytes."""

    def __init__(self, path: str):
        self.library = library(path)
        self.model = self.library.model
        self.alphabet = byte_alphabet()
        self.pieces: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _encode(self, piece: str) -> bytes:
        ids = self.library.encode(piece, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """One run of letters or marks, already a whole match of the pre-tokenizer."""
        found = self.runs.get(run)
        if found is None:
            shown = run.encode().decode("latin-1").translate(self.alphabet)
            found = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.runs) >= REMEMBERED:
                self.runs.clear()
            self.runs[run] = found
        return found

    def _piece(self, piece: str) -> bytes:
        match = _WORD.fullmatch(piece)
        if match is None:
            return self._encode(piece)
        word, marks = match.groups()
        word = unicodedata.normalize("NFC", word).lower()
        return (self._run(word) if word else b"") + (self._run(marks) if marks else b"")

    def __call__(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").split(" ")
        try:
            return b"".join([self.pieces[p] for p in pieces])
        except KeyError:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            known = self.pieces
            out = []
            for p in pieces:
                found = known.get(p)
                if found is None:
                    found = known[p] = self._piece(p)
                out.append(found)
            return b"".join(out)


class SpacedCounts:
    """Token counts of a byte-level vocabulary whose matches may start with one space.

    A space before a non-space character always starts a match, so counts of the pieces
    between such spaces add up.  Special strings split a text before anything else.
    """

    def __init__(self, path: str):
        self.library = library(path)
        self.model = self.library.model
        self.alphabet = byte_alphabet()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces: dict[str, int] = {}
        self.runs: dict[str, int] = {}

    def _run(self, run: str) -> int:
        found = self.runs.get(run)
        if found is None:
            shown = run.encode().decode("latin-1").translate(self.alphabet)
            found = len(self.model.tokenize(shown))
            if len(self.runs) >= REMEMBERED:
                self.runs.clear()
            self.runs[run] = found
        return found

    def _encoded(self, piece: str) -> int:
        return len(self.library.encode(piece, add_special_tokens=False))

    def _piece(self, piece: str) -> int:
        """Count of the piece with its leading space."""
        match = _LINES.fullmatch(piece)
        if match is None or not piece:
            return self._encoded(" " + piece)
        word, marks, line, next_word, next_marks = match.groups()
        if word:
            runs = [" " + word, marks, line, next_word, next_marks]
        elif marks:
            runs = [" " + marks, line, next_word, next_marks]
        else:
            return self._encoded(" " + piece)
        return sum(self._run(r) for r in runs if r)

    def _segment(self, text: str) -> int:
        first, *pieces = _CUT.split(text)
        known = self.pieces
        try:
            count = sum([known[p] for p in pieces])
        except KeyError:
            if len(known) >= REMEMBERED:
                known.clear()
            count = 0
            for p in pieces:
                found = known.get(p)
                if found is None:
                    found = known[p] = self._piece(p)
                count += found
        return count + (self._encoded(first) if first else 0)

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._segment(text)
        segments = self.special.split(text)
        return sum(map(self._segment, segments)) + len(segments) - 1


class PieceCounts:
    """Token counts of a sentencepiece model; special strings stay ordinary text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)

    def __call__(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))


class WholeCounts:
    """Token counts of any other vocabulary file, text by text."""

    def __init__(self, path: str):
        self.library = library(path)

    def __call__(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))


_loaded: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One encoder per worker and file."""
    key = (kind, path)
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


def counter_kind(path: str) -> type:
    """The way of counting that fits the file."""
    if path.endswith(".model"):
        return PieceCounts
    import json

    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    before = rules.get("pre_tokenizer") or {}
    spaced = (
        rules.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex")
        and not before.get("add_prefix_space")
        and rules["model"].get("type") == "BPE"
        and all(not t["lstrip"] and not t["rstrip"] for t in rules.get("added_tokens", []))
    )
    return SpacedCounts if spaced else WholeCounts
