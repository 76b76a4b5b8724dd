"""Whole texts to token ids by a public tokenizer, each distinct unit of a block encoded once.

A byte-pair tokenizer first cuts a text into pieces that it encodes one by one, so the
ids of a text are the ids of its units, as long as units end where pieces end. A space or line feed
between two characters that are no white space is such a place in both vocabularies used
here; so is the edge between a Latin letter and punctuation after it. Units are cut on the bytes of a whole block
and numbered by Arrow; a text with any other white space is one unit. A unit of Latin letters is one piece, which
the tokenizer's model encodes without the steps before it; all other units take the whole tokenizer.
The ids of a unit are kept per process, up to `CACHED` of them.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa

from docketry.functions.process import per_process
from docketry.llm.blocks import Block, blocks, class_table, ranges

# Units that a process keeps, about 45 MB, and the longest unit kept.
CACHED = 200_000
LONGEST = 48
# Bytes of text that are cut and numbered at once.
UNIT_BYTES = 8 << 20

_PLAIN_SPACE = class_table(lambda b: b in (10, 32))
_ODD_SPACE = class_table(lambda b: b in (9, 11, 12, 13, 28, 29, 30, 31))
_LETTER = class_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
_TAIL = class_table(lambda b: b in b".,!?;:#$%&*")
# First bytes of characters among which there is white space, and of the Latin letters from U+00C0.
_MAY_BE_SPACE = class_table(lambda b: b in (0xC2, 0xE1, 0xE2, 0xE3))
_LATIN_LEAD = 0xC3
_LATIN_SIGNS = (0x97, 0xB7)  # times and divided by

# Letters that lower-casing and composing treat one by one, in whatever order.
_PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    A byte whose own character is visible stands for itself; the others take the characters from 256 on, in order.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def unit_starts(block: Block) -> np.ndarray:
    """Where units start, in ascending order; the first of each text that is not empty is among them."""
    data, n = block.data, len(block.data)
    space = _PLAIN_SPACE[data]
    # A single space or line feed with a word on both sides; at the border of a text one side may be any, as
    # white space alone at the start or the end of a text is a piece of its own.
    lone = np.zeros(n, bool)
    lone[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
    new = lone.copy()
    feed = lone & (data == 10)
    new[1:] |= feed[:-1]
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == _LATIN_LEAD) & (data[1:] != _LATIN_SIGNS[0]) & (data[1:] != _LATIN_SIGNS[1])
    new[1:] |= letter[:-1] & _TAIL[data[1:]]
    starts = block.offsets[:-1][np.diff(block.offsets) > 0]
    # Texts with other white space, or with characters that may be some and then are, stay whole.
    text_of = lambda at: np.searchsorted(block.offsets, at, "right") - 1
    odd = np.unique(text_of(np.flatnonzero(_ODD_SPACE[data])))
    doubtful = np.unique(text_of(np.flatnonzero(_MAY_BE_SPACE[data])))
    odd = [*odd, *(i for i in doubtful if any(c.isspace() and not c.isascii() for c in set(text_at(block, i))))]
    for i in odd:
        new[block.offsets[i]:block.offsets[i + 1]] = False
    new[starts] = True
    return np.flatnonzero(new)


def text_at(block: Block, i: int) -> str:
    return block.data[block.offsets[i]:block.offsets[i + 1]].tobytes().decode("utf-8", "replace")


class Encoder:
    """Ids of whole texts by one vocabulary file."""

    def __init__(self, path: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        if sys.byteorder != "little":
            raise ValueError("ids are kept in the machine's byte order, which must be little-endian")
        self.model, self.letters, self.lower = self.tokenizer.model, byte_letters(), lower
        self.known: dict[bytes, bytes] = {}

    def unit(self, raw: bytes) -> bytes:
        """Ids of a unit that is not kept yet."""
        text = raw.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if plain:
            piece = plain[2].lower() if self.lower else text
            ids = [token.id for token in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        packed = array("H", ids).tobytes()
        if len(raw) <= LONGEST:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[raw] = packed
        return packed

    def block_ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, one after another, and how many each has."""
        starts = unit_starts(block)
        if not len(starts):
            return np.empty(0, np.uint16), np.zeros(len(block), np.int64)
        offsets = pa.py_buffer(np.append(starts, len(block.data)).astype(np.int64))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(block.data)])
        coded = units.dictionary_encode()
        known, number = self.known, coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        ids = [known.get(raw) for raw in distinct]
        ids = [self.unit(raw) if found is None else found for raw, found in zip(distinct, ids)]
        lengths = np.array([len(i) for i in ids], np.int64) // 2
        flat, begins = np.frombuffer(b"".join(ids), np.uint16), np.cumsum(lengths) - lengths
        per_unit = lengths[number]
        sums = np.concatenate([[0], np.cumsum(per_unit)])
        bounds = np.searchsorted(starts, block.offsets)
        return flat[ranges(begins[number], per_unit)], np.diff(sums[bounds])

    def column_ids(self, column: pa.Array):
        """Block by block: the rows' first number, all ids, and the ids of each row."""
        for block in blocks(column, UNIT_BYTES):
            yield block.first_row, *self.block_ids(block)

    def ids(self, text: str) -> list[int]:
        return [i for _, flat, _ in self.column_ids(pa.array([text])) for i in flat.tolist()]


def encoder(path: str, lower: bool) -> Encoder:
    """The process's encoder for a vocabulary file; `lower` if the vocabulary is of lower-cased words."""
    return per_process(("encoder", path), lambda: Encoder(path, lower))


def ended(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id put behind each text's, and the borders between texts."""
    return np.insert(flat, np.cumsum(counts), end_id), np.concatenate([[0], np.cumsum(counts + 1)])
