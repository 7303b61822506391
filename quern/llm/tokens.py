"""Token ids of whole texts by a public vocabulary.

The vocabulary drops white space and never joins across it, so the ids of a
text are the ids of its blank-separated pieces in turn. Letters and the symbols
of `CLOSING` are never in one token either, so pieces are cut between these
too. Pieces recur, so a worker asks the tokenizers library once a piece and
keeps the answer as packed little-endian bytes; a text is then a join of such
answers. Many texts are cut at once, and their pieces are held, compared and
joined as Arrow columns, never one by one. Only the blank, newline, tab and
carriage return are cut at: anything stranger stays inside a piece and is left
to the library.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT = 300_000
#: Characters cut into pieces at once, about.
BATCH = 4 << 20
BLANKS = b" \n\t\r"
#: Symbols that are cut from letters; none of them can join one, as an apostrophe could.
CLOSING = b".,;:!?#$%&*|()-"
#: Of each byte: 4 blank, 2 closing, 1 letter. Letters and closing symbols alone differ by 3.
KINDS = np.zeros(256, np.uint8)
KINDS[list(BLANKS)], KINDS[list(CLOSING)] = 4, 2
KINDS[[b for b in range(128) if chr(b).isalpha()]] = 1
#: For words of these letters the normalizer does nothing, and blanks alone cut.
PLAIN = "^[a-zß-öø-ÿ]+$"
_open: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def folded(text: str) -> bytes:
    """The text in lower case, where that is sure to change no token.

    Latin-1 letters have one lower case each and compose with nothing there. A
    special token is known by its case.
    """
    return (text.lower() if "<|" not in text and is_latin(text) else text).encode()


def pieces_of(texts: list[str | None]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The pieces of all texts, and the first piece of each text (and their number, at last)."""
    parts = [folded(t or "") for t in texts]
    at = np.cumsum([0, *(len(p) + 1 for p in parts)])
    joined = b"\n".join([*parts, b""])
    raw = np.frombuffer(joined, np.uint8)
    kinds = KINDS[raw]
    if not joined.isascii():  # the second byte of a Latin-1 letter, but for the signs of times and division
        second = np.flatnonzero(raw == 0xC3) + 1
        kinds[second[(raw[second] & 0xDF) != 0x97]] = 1
    starts = np.ones(len(raw), bool)
    np.equal(kinds[:-1] ^ kinds[1:], 3, out=starts[1:])
    for k, p in enumerate(parts):
        if b"<|" in p:  # special tokens are of letters and symbols
            starts[at[k] + 1 : at[k + 1]] = False
    blank = kinds == 4
    starts[1:] |= blank[:-1]
    starts &= ~blank
    body = joined.translate(None, BLANKS)
    offsets = np.append(np.flatnonzero(starts[~blank]), len(body))
    pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(body))
    return pieces, np.searchsorted(np.flatnonzero(starts), at)


def packed_column(ids: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of ids that end there, each as bytes."""
    offsets = np.concatenate(([0], 4 * ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.seen = pa.array([], pa.large_string())
        self.answers = pa.array([], pa.large_binary())  # of the pieces in `seen`
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain.model._resize_cache(0)  # it is asked for each word once
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.ends_word = np.array([(n or "").endswith("</w>") for n in names])

    def _ask_each(self, pieces: list[str]) -> pa.LargeBinaryArray:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return packed_column(np.array([i for some in ids for i in some], "<u4"), np.cumsum([len(some) for some in ids], dtype=np.int64))

    def _ask_words(self, pieces: list[str]) -> list[pa.LargeBinaryArray]:
        """Plain words, many to one call; a token that ends a word says so."""
        out = []
        for lo in range(0, len(pieces), 1000):
            some = pieces[lo : lo + 1000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            sure = len(ends) == len(some) and ends[-1] == len(ids)
            out.append(packed_column(ids, ends) if sure else self._ask_each(some))
        return out

    def _places(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """Where distinct pieces are in `seen`; those that were not there are asked for and added."""
        places = pc.index_in(pieces, value_set=self.seen)
        if len(self.seen) > KEPT:  # what this batch needs stays
            stay = places.drop_null()
            self.seen, self.answers = self.seen.take(stay), self.answers.take(stay)
            places = pc.index_in(pieces, value_set=self.seen)
        new = np.flatnonzero(places.is_null())
        places = places.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            plain = pc.match_substring_regex(pieces.take(pa.array(new)), PLAIN).to_numpy(zero_copy_only=False)
            words, others = pieces.take(pa.array(new[plain])), pieces.take(pa.array(new[~plain]))
            places[np.concatenate((new[plain], new[~plain]))] = len(self.seen) + np.arange(len(new))
            self.answers = pa.concat_arrays([self.answers, *self._ask_words(words.to_pylist()), self._ask_each(others.to_pylist())])
            self.seen = pa.concat_arrays([self.seen, words, others])
        return places

    def packed_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < BATCH:
                size += len(texts[hi] or "")
                hi += 1
            pieces, first = pieces_of(texts[lo:hi])
            lo = hi
            pieces = pieces.dictionary_encode()
            places = self._places(pieces.dictionary)[pieces.indices.to_numpy()]
            answers = self.answers.take(pa.array(places))
            if not len(answers):
                out += [b""] * (len(first) - 1)
                continue
            _, offsets, packed = answers.buffers()
            at = np.frombuffer(offsets, np.int64)[first].tolist()
            packed = memoryview(packed)
            out += [bytes(packed[i:j]) for i, j in zip(at[:-1], at[1:])]
        return out

    def packed(self, text: str | None) -> bytes:
        return self.packed_all([text])[0]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
