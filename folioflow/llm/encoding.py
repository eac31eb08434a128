"""Token ids of whole texts with a public tokenizer, one batch of texts at a time.

A BPE tokenizer treats the words of a text independently, so the ids of a text are the ids of
its pieces put together, where a text is cut only at places that the tokenizer's own word
pattern always cuts: before blanks, around line ends, and before a point or comma that follows
a letter. Pieces recur, so Arrow lists the distinct ones of many texts, each worker keeps the
ids of those it has seen, and only new pieces go to the tokenizer, many at a time. Texts with
unusual white space or with strings that look like special tokens go to the tokenizer whole.
`tests/llm` compares the ids with those of whole texts.
"""

from __future__ import annotations

import os
import sys
from codecs import charmap_decode
from types import ModuleType
from unicodedata import is_normalized

# Pieces that a worker keeps; when full, it starts afresh. About 170 bytes each.
KEPT_PIECES = 1_200_000
# Bytes of texts that are cut into pieces at a time.
BLOCK_BYTES = 4 << 20
# New pieces that the tokenizer gets as one text; many more take longer for each.
TOGETHER = 200

# White space besides blanks and line ends, characters that only some engines take for white
# space, and the mark used below.
_OTHER_SPACE = (
    "\t\r\x0b\x0c\x01\x1c\x1d\x1e\x1f"
    "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Texts that go to the tokenizer whole; the second for tokenizers that keep white space.
_UNUSUAL = rf"<\||[{_OTHER_SPACE}]"
_UNUSUAL_OR_SPACED = rf"{_UNUSUAL}|  | \n|\n |\n\n|\A[ \n]|[ \n]\z"

# Byte-level tokenizers write a byte as a letter: visible Latin-1 characters stand for
# themselves, the other bytes, in order, for the characters from U+0100 on. Line ends, which
# stand between words here, stay.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [byte for byte in range(256) if byte not in _VISIBLE]
_LETTERS = "".join(
    chr(byte if byte in _VISIBLE or byte == 0x0A else 0x100 + _HIDDEN.index(byte))
    for byte in range(256)
)
_BLANK = _LETTERS[0x20]


def _held() -> dict:
    """Loaded tokenizers and known pieces, for the life of a worker process."""
    name = "_tokenizers_of_this_worker"
    if name not in sys.modules:
        sys.modules[name] = ModuleType(name)
    return sys.modules[name].__dict__


def blocks(batch, column: int):
    """Slices of an Arrow batch whose texts in a column take `BLOCK_BYTES`, or a row with more."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(), dtype=np.int64)
    begin, done = 0, 0
    while begin < len(ends):
        stop = max(begin + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
        yield batch.slice(begin, stop - begin)
        begin, done = stop, int(ends[stop - 1])


def values(found):
    """The ids in an array that `encode_column` gives, one text after the other, and where each
    text begins and the last ends."""
    import numpy as np

    _, offsets, data = found.buffers()
    bounds = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    return raw.view("<u4"), (bounds - bounds[0]) // 4


class Encoder:
    """Little-endian unsigned 32-bit ids of texts.

    `word_level`: the tokenizer drops white space; else a blank belongs to the word after it.
    Strings of special tokens in a text are encoded as the tokenizer file says, like any
    `encode` call of the library with `add_special_tokens=False`.
    """

    def __init__(self, path: str, word_level: bool, kept: int = KEPT_PIECES):
        self.path, self.word_level, self.kept = path, word_level, kept
        held = _held()
        if path not in held:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer, pre_tokenizers

            tokenizer = Tokenizer.from_file(path)
            # The same model, for words that are cut already.
            model = Tokenizer(tokenizer.model)
            model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            held[path] = (tokenizer, model, self._edges(tokenizer), {})
        self.tokenizer, self.model, self.edges, self.known = held[path]
        self.mark = "\x01" if word_level else "\n"
        self.mark_ids = self.whole(self.mark)

    def _edges(self, tokenizer):
        """Whether an id is one that only stands at a word's end, or at its beginning with the
        blank before it if words keep that."""
        import numpy as np

        vocab = tokenizer.get_vocab()
        edges = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, at in vocab.items():
            edges[at] = token.endswith("</w>") if self.word_level else token[0] == _BLANK
        return edges

    def _ids(self, tokenizer, text: str):
        import numpy as np

        encoded = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(encoded.ids, dtype="<u4")

    def whole(self, text: str) -> bytes:
        return self._ids(self.tokenizer, text).tobytes()

    def _pieces(self, texts):
        """The distinct pieces of all texts, where each piece stands among them, and the number
        of pieces before each text and the end."""
        import numpy as np
        import pyarrow as pa

        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(bounds[0]), int(bounds[-1])
        text = np.frombuffer(data, np.uint8)[low:high]
        line_end = text == 0x0A
        begins = line_end | (text == 0x20)
        begins[1:] |= line_end[:-1]
        letter = (text[:-1] | 0x20) - 0x61 < 26
        begins[1:] |= letter & ((text[1:] == 0x2E) | (text[1:] == 0x2C))
        starts = bounds - low
        begins[starts[starts < high - low]] = True
        cuts = np.flatnonzero(begins)
        before = np.searchsorted(cuts, starts)
        places = pa.py_buffer(np.append(cuts, high - low) + low)
        pieces = pa.LargeStringArray.from_buffers(len(cuts), places, data).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        return distinct, pieces.indices, before

    def _is_word(self, piece: str) -> bool:
        """Whether the tokenizer's word pattern takes a piece as one word: letters, with the
        blank before them if it keeps blanks. Letters that lower differently by what stands
        around them, or into a mark, don't count."""
        body = piece[1:] if piece[0] == " " else piece
        if not body.isalpha() or (body is piece and not self.word_level):
            return False
        if body.isascii():
            return True
        return is_normalized("NFC", body) and not (self.word_level and ("Σ" in body or "İ" in body))

    def _learn(self, pieces: list[str]) -> None:
        known, words, others = self.known, [], []
        for piece in pieces:
            if self._is_word(piece):
                words.append(piece)
            elif piece == " " or piece == "\n":
                known[piece] = b"" if self.word_level else self.mark_ids
            else:
                others.append(piece)
        for learn, found in ((self._words, words), (self._marked, others)):
            for at in range(0, len(found), TOGETHER):
                some = found[at : at + TOGETHER]
                known.update(zip(some, learn(some)))

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Encode words by the model; they are told apart by ids that stand at an edge only."""
        import numpy as np

        lines = "\n".join(pieces)
        if self.word_level:
            lines = lines.replace(" ", "").lower()
        ids = self._ids(self.model, charmap_decode(lines.encode(), "strict", _LETTERS)[0])
        edges = np.flatnonzero(self.edges[ids])
        if len(edges) != len(pieces):
            raise ValueError(f"{self.path}: words can't be told apart by their edges")
        if self.word_level:
            cuts = [0, *((edges + 1) * 4).tolist()]
        else:
            cuts = [*(edges * 4).tolist(), len(ids) * 4]
        raw = ids.tobytes()
        return [raw[begin:end] for begin, end in zip(cuts, cuts[1:])]

    def _marked(self, pieces: list[str]) -> list[bytes]:
        """Encode pieces as one text, with a mark between them that has an id of its own."""
        import numpy as np

        ids = self._ids(self.tokenizer, (" \x01 " if self.word_level else "\n").join(pieces))
        cuts = np.flatnonzero(ids == np.frombuffer(self.mark_ids, "<u4")[0])
        if len(cuts) != len(pieces) - 1 or len(self.mark_ids) != 4:
            raise ValueError(f"{self.path}: words can't be told apart by {self.mark!r}")
        begins = [0, *((cuts + 1) * 4).tolist()]
        ends = [*(cuts * 4).tolist(), len(ids) * 4]
        raw = ids.tobytes()
        return [raw[begin:end] for begin, end in zip(begins, ends)]

    def _by_pieces(self, texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not pc.max(pc.binary_length(texts)).as_py():
            return pa.array([b""] * len(texts), pa.large_binary())
        pieces, indices, before = self._pieces(texts)
        known = self.known
        found = list(map(known.get, pieces))
        new = [piece for piece, ids in zip(pieces, found) if ids is None]
        if new:
            if len(known) + len(new) > self.kept:
                known.clear()
            self._learn(new)
            found = [known[piece] if ids is None else ids for piece, ids in zip(pieces, found)]
        ids = pa.array(found, pa.large_binary()).take(indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(ids) + 1][before]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(ends), data]
        )

    def encode_column(self, texts):
        """Ids of an Arrow array of texts, as an array of large_binary."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string())
        unusual = pc.match_substring_regex(
            texts, _UNUSUAL if self.word_level else _UNUSUAL_OR_SPACED
        )
        if not pc.any(unusual).as_py():
            return self._by_pieces(texts)
        usual = self._by_pieces(texts.filter(pc.invert(unusual)))
        others = [self.whole(text) for text in texts.filter(unusual).to_pylist()]
        both = pa.concat_arrays([usual, pa.array(others, pa.large_binary())])
        # The usual rows come first in `both`; a stable sort undone gives each row its place.
        return both.take(pc.sort_indices(pc.sort_indices(unusual.cast(pa.int8()))))

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa

        return self.encode_column(pa.array(texts, pa.large_string())).to_pylist()
