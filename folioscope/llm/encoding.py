"""Token ids of whole texts by the tokenizers library, each distinct piece of a word encoded once.

Both vocabularies cut a text into pieces before merging, and no piece reaches across white space:
one drops white space, the other hangs a space on the following word. So a text is the sequence of
its words. Arrow cuts the texts of a call into words and finds the distinct ones; words made of plain
Latin letters and simple punctuation are cut into these two, go to the model piece by piece, and the
ids of the pieces are remembered. All other words, and whole texts with unusual white space or
anything like a special token, go through the full tokenizer.
"""

from __future__ import annotations

import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces of words, and words that cannot be cut, remembered before the memory is emptied: about 100 MB.
MAX_REMEMBERED = 700_000
# The same for their ids, which few huge words may fill: 32 MB.
MAX_IDS = 8_000_000
# Letters that NFC leaves alone, and marks that both vocabularies cut off as one piece.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r".,;:!?&$#%*()\"+=/\-"
_PLAIN = re.compile(f"([ \n]?)([{_LETTERS}]+)([{_MARKS}]*)")
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
# The same and all else that only the full tokenizer will do with, for Arrow.
_ODD_TEXT = _ODD_SPACE.pattern + r"|\x00|<\||  | \n|\n |\n\n|^[ \n]|[ \n]$|^$"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: itself where it prints, else the next free code from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for code, b in enumerate((b for b in range(256) if b not in table), start=256):
        table[b] = chr(code)
    return table


class Encoder:
    """ids of texts; `drops_space` tells the vocabulary that drops white space from the one that keeps it.

    At most `pieces` pieces of words (default: `MAX_REMEMBERED`) are remembered from call to call; the ids
    do not depend on it.
    """

    def __init__(self, path: str, drops_space: bool, pieces: int | None = None):
        from tokenizers import Tokenizer

        self.max_pieces = pieces
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.drops_space = drops_space
        self.letters = byte_letters()
        first = "" if drops_space else r"[\x00\n]?"
        self.parts = f"^(?P<head>{first}[{_LETTERS}]+)(?P<tail>[{_MARKS}]*)$"
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.flat = array("I")
        # Where the ids of every number begin, in bytes, and the end of the last.
        self.cuts = array("q", [0])

    def learn(self, keys: list[str]) -> None:
        """Remember the ids of new keys of `numbered`, which get the next numbers."""
        self.index.update(zip(keys, range(len(self.index), len(self.index) + len(keys))))
        flat, cuts, tokenize, newline = self.flat, self.cuts, self.model.tokenize, array("I", self.piece("\n"))
        space = "" if self.drops_space else self.letters[ord(" ")]
        for key in keys:
            if key.startswith(" \0"):
                flat.frombytes(self.whole(key[2:] if self.drops_space else self.chunk(key[2:])))
            else:
                first = key[0]
                text = key[1:] if first in " \0\n" else key
                # ASCII letters and marks stand for themselves.
                if not text.isascii():
                    text = text.encode("utf-8").decode("latin-1").translate(self.letters)
                if first == "\n":
                    flat.extend(newline)
                elif first not in " \0":
                    text = space + text
                flat.extend([token.id for token in tokenize(text)])
            cuts.append(4 * len(flat))

    def remembered(self) -> pa.Array:
        """The ids of every number, as bytes."""
        buffers = [None, pa.py_buffer(self.cuts), pa.py_buffer(self.flat)]
        return pa.Array.from_buffers(pa.large_binary(), len(self.cuts) - 1, buffers)

    @staticmethod
    def chunk(key: str) -> str:
        """A key stands for itself after a space; a leading line break or NUL says otherwise."""
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def whole(self, text: str) -> bytes:
        """Ids (32 bits each) by the full tokenizer."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            if self.max_pieces and len(self.pieces) >= self.max_pieces:
                self.pieces.clear()
            mapped = text.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = self.pieces[text] = array("I", [token.id for token in self.model.tokenize(mapped)]).tobytes()
        return ids

    def ids_of(self, text: str) -> bytes:
        plain = _PLAIN.fullmatch(text)
        if not plain:
            return self.whole(text)
        space, letters, marks = plain.groups()
        if self.drops_space:
            head = self.piece(letters.lower())
        elif space == "\n":
            head = self.piece("\n") + self.piece(letters)
        else:
            head = self.piece(space + letters)
        return head + self.piece(marks) if marks else head

    def odd(self, texts: pa.Array) -> pa.Array:
        """Whether only the full tokenizer will do."""
        return pc.match_substring(texts, "<|") if self.drops_space else pc.match_substring_regex(texts, _ODD_TEXT)

    def words(self, texts: pa.Array) -> pa.Array:
        """Words of texts that are not odd, each after a space or with the line break it follows; NUL begins the first."""
        if self.drops_space:
            return pc.split_pattern(pc.replace_substring_regex(texts, r"[\t-\r]", " "), " ")
        first = pc.binary_join_element_wise(pa.scalar("\0", texts.type), texts, pa.scalar("", texts.type))
        return pc.split_pattern(pc.replace_substring(first, "\n", " \n"), " ")

    def numbered(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(numbers of the first piece of every word, of the second or NULL): letters and marks, where the keys
        of marks have a space in front, or a word that cannot be cut, after a space and a NUL."""
        def after(prefix: str, texts: pa.Array) -> pa.Array:
            return pc.binary_join_element_wise(pa.scalar(prefix, texts.type), texts, pa.scalar("", texts.type))

        parts = pc.extract_regex(words, self.parts)
        head, tail = (pc.struct_field(parts, [name]) for name in ("head", "tail"))
        if self.drops_space:
            head = pc.utf8_lower(head)
        marked = pc.fill_null(pc.greater(pc.binary_length(tail), 0), False)
        first = pc.coalesce(head, after(" \0", words))
        keys = pa.concat_arrays([first, after(" ", tail.filter(marked))]).dictionary_encode()
        names = keys.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.index.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(known < 0)
        known[new] = len(self.index) + np.arange(len(new))
        self.learn([names[at] for at in new])
        number = known[keys.indices.to_numpy()]
        marked = marked.to_numpy(zero_copy_only=False)
        second = np.zeros(len(words), dtype=np.int64)
        second[marked] = number[len(words):]
        return number[:len(words)], pa.array(second, mask=~marked)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if len(self.index) > min(MAX_REMEMBERED, self.max_pieces or MAX_REMEMBERED) or len(self.flat) > MAX_IDS:
            self.forget()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        odd = self.odd(texts)
        is_odd = odd.to_numpy(zero_copy_only=False)
        words = self.words(texts.filter(pc.invert(odd)))
        found = words.flatten().dictionary_encode()
        first, second = self.numbered(found.dictionary)
        table, none = self.remembered(), pa.scalar(b"", pa.large_binary())
        distinct = pc.binary_join_element_wise(table.take(pa.array(first)), pc.fill_null(table.take(second), none), none)
        # Odd texts count as one word each, held for this call only.
        whole = pa.array([self.whole(text.as_py()) for text in texts.filter(odd)], pa.large_binary())
        counts = np.ones(len(texts), dtype=np.int64)
        counts[~is_odd] = pc.list_value_length(words).to_numpy()
        bounds = np.concatenate(([0], np.cumsum(counts)))
        number = np.full(bounds[-1], -1)
        number[bounds[:-1][is_odd]] = len(distinct) + np.arange(len(whole))
        number[number < 0] = found.indices.to_numpy()
        ids = pa.concat_arrays([distinct, whole]).take(pa.array(number))
        _, cuts, data = ids.buffers()
        cuts = np.frombuffer(cuts, dtype=np.int64)[:len(ids) + 1] // 4
        return np.frombuffer(data or b"", dtype=np.uint32)[:cuts[-1]], np.diff(cuts[bounds])


def shared_encoder(path: str, drops_space: bool, pieces: int | None = None) -> Encoder:
    """The encoder of this worker process, made on first use: what it remembers outlives the task."""
    import sys
    import types

    held = vars(sys.modules.setdefault("folioscope_encoders", types.ModuleType("folioscope_encoders")))
    key = path, drops_space, pieces
    if key not in held:
        held[key] = Encoder(path, drops_space, pieces)
    return held[key]


def text_groups(texts: list | pa.Array, size: int = 1 << 20):
    """Slices with about `size` characters (of an Arrow array: bytes) each; a longer text is alone."""
    lengths = pc.binary_length(texts).to_pylist() if isinstance(texts, pa.Array) else map(len, texts)
    begin, total = 0, 0
    for end, length in enumerate(lengths, start=1):
        total += length
        if total >= size:
            yield slice(begin, end)
            begin, total = end, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
