"""Token ids of whole texts through a table of already encoded words.

Texts repeat most of their words, so each word is encoded once per worker and
its ids are gathered by word hash for every later use. The table is emptied when
it reaches MAX_WORDS, which bounds a worker's memory and changes no result.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pricewell.llm.words import Words, mix, word_ends, words

#: Words a worker remembers; about 25 bytes each.
MAX_WORDS = 1_500_000

#: GPT-2's splitting pattern in possessive form; it splits alike and backtracks less.
BYTE_BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

# The byte-level vocabulary's special token and its id. Texts that spell it out get the id, as the vocabulary's JSON form says.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class WordTable:
    """key (uint64) -> run of ids; encode turns keys' words into ids when they are new."""

    def __init__(self) -> None:
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.flat = np.zeros(0, np.uint16)

    def look_up(self, keys: np.ndarray, encode) -> np.ndarray:
        """Entries of the keys. encode(positions) -> ids of the words at these positions, as (flat uint16, lengths)."""
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > MAX_WORDS:
            self._empty()
        where = np.searchsorted(self.keys, unique)
        found = where < len(self.keys)
        found[found] = self.keys[where[found]] == unique[found]
        if not found.all():
            new = ~found
            flat, lengths = encode(first[new])
            base = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint16)])
            self.keys = np.insert(self.keys, where[new], unique[new])
            self.at = np.insert(self.at, where[new], base + np.arange(int(new.sum())))
            where = np.searchsorted(self.keys, unique)
        return self.at[where][back]

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' ids in a row, and how many each has."""
        lengths = self.lengths[entries]
        total = int(lengths.sum())
        shift = self.starts[entries] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(total)], lengths


@functools.lru_cache(2)
def byte_bpe(path: str):
    """A tiktoken encoding from a file of ranks, with the one special token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


@functools.lru_cache(2)
def piece_bpe(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def forget() -> None:
    """Lets go of the vocabularies: a worker that waits for its next task need not hold them."""
    byte_bpe.cache_clear()
    piece_bpe.cache_clear()


def _odd_space(raw: np.ndarray) -> np.ndarray:
    """Byte offsets where white space starts that isn't in [\\x20\\x09-\\x0D]."""
    hit = (raw >= 0x1C) & (raw <= 0x1F)
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    lead = lead[lead < len(raw) - 1]
    b0, b1 = raw[lead], raw[lead + 1]
    b2 = raw[np.minimum(lead + 2, len(raw) - 1)]
    general = (b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | ((b2 >= 0xA8) & (b2 <= 0xAF)))
    odd = ((b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b0 == 0xE1) & (b1 == 0x9A)) | general | ((b0 == 0xE2) & (b1 == 0x81)) | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80))
    hit[lead[odd]] = True
    return np.flatnonzero(hit)


class ByteBpe:
    """Ids of whole texts, equal to encoding each text in one piece.

    The splitting pattern never joins a word to what follows its end, and takes
    from the white space before it at most one blank. So a word with the white
    space before it can be encoded alone. Texts with white space beyond ASCII's
    or with the special token are encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.encoding = byte_bpe(path)
        self.newline = self.encoding.encode_ordinary("\n")
        assert len(self.newline) == 1
        self.table = WordTable()

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of consecutive texts, their bounds in the ids)."""
        for w in words(column, fold=False):
            yield (w.first, *self._encode(w))

    def _encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        raw, encoding = w.raw, self.encoding
        data = raw.tobytes()
        text = lambda a, b: data[a:b].decode("utf-8", "replace")
        n_texts, ends = len(w), word_ends(w)
        of = np.repeat(np.arange(n_texts), np.diff(w.offsets))
        before = np.zeros(len(ends), np.int64)  # where the white space before a word begins
        before[1:] = ends[:-1]
        np.maximum(before, w.bounds[:-1][of], out=before)
        gap = w.starts - before
        one = raw[np.maximum(w.starts - 1, 0)] if len(raw) else raw
        kind = np.where(gap == 0, 1, np.where((gap == 1) & (one == 0x20), 2, np.where((gap == 1) & (one == 0x0A), 3, 0)))
        tail_from = w.bounds[:-1].copy()  # white space after a text's last word
        some = np.flatnonzero(np.diff(w.offsets))
        tail_from[some] = ends[w.offsets[some + 1] - 1]
        whole = np.zeros(n_texts, bool)
        odd = np.concatenate([_odd_space(raw), np.array([m.start() for m in re.finditer(re.escape(SPECIAL.encode()), data)], np.int64)])
        whole[np.searchsorted(w.bounds, odd, "right") - 1] = True

        parts: list[np.ndarray] = []
        keep = ~whole[of]
        plain = keep & (kind > 0)
        keys = mix(w.hashes[plain] + kind[plain].astype(np.uint64))
        at = np.flatnonzero(plain)

        def encode(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = at[positions]
            spaced = kind[own] == 2
            joined = "\n".join([text(s - sp, e) for s, e, sp in zip(w.starts[own].tolist(), ends[own].tolist(), spaced.astype(int).tolist(), strict=True)])
            ids = np.array(encoding.encode_ordinary(joined), np.uint16)
            cut = np.flatnonzero(ids == self.newline[0])
            assert len(cut) == len(own) - 1, "a word holds a line break"
            bounds = np.concatenate([[-1], cut, [len(ids)]])
            lengths = np.diff(bounds) - 1
            after_line = kind[own] == 3
            lead = np.zeros(len(ids) + 1, bool)  # the line break before a word is its own id here too
            lead[bounds[:-1][after_line]] = True
            body = np.ones(len(ids) + 1, bool)
            body[cut] = lead[cut]
            body[-1] = lead[-1]
            all_ids = np.concatenate([ids, [self.newline[0]]])
            # position -1 stands for the line break before the first word
            if lead[-1]:
                order = np.concatenate([[len(ids)], np.arange(len(ids))])
                return all_ids[order][body[order]], lengths + after_line
            return ids[body[:-1]], lengths + after_line

        entries = self.table.look_up(keys, encode) if len(keys) else np.zeros(0, np.int64)
        flat, lengths = self.table.gather(entries) if len(keys) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        count = np.zeros(len(w.hashes), np.int64)
        count[plain] = lengths
        rare = np.flatnonzero(keep & (kind == 0))
        tails = np.flatnonzero((tail_from < w.bounds[1:]) & ~whole)
        wholes = np.flatnonzero(whole)
        per_text = np.bincount(of, weights=count, minlength=n_texts).astype(np.int64)
        if not len(rare) and not len(tails) and not len(wholes):
            return flat, np.concatenate([[0], np.cumsum(per_text)])
        own = np.concatenate([[0], np.cumsum(per_text)])
        by_word = np.concatenate([[0], np.cumsum(count)])
        odd_words: dict[int, list[int]] = {}
        for i in rare.tolist():
            odd_words.setdefault(int(of[i]), []).append(i)
        tail_of, whole_of, touched = set(tails.tolist()), set(wholes.tolist()), {*odd_words, *tails.tolist(), *wholes.tolist()}
        sizes = np.diff(own)
        for t in range(n_texts):
            if t not in touched:
                parts.append(flat[own[t] : own[t + 1]])
                continue
            if t in whole_of:
                mine = np.array(encoding.encode(text(w.bounds[t], w.bounds[t + 1]), allowed_special={SPECIAL}), np.uint16)
            else:
                pieces, last = [], int(by_word[w.offsets[t]])
                for i in odd_words.get(t, ()):
                    pieces.append(flat[last : by_word[i]])
                    pieces.append(np.array(encoding.encode_ordinary(text(before[i], ends[i])), np.uint16))
                    last = int(by_word[i])
                pieces.append(flat[last : own[t + 1]])
                if t in tail_of:
                    pieces.append(np.array(encoding.encode_ordinary(text(tail_from[t], w.bounds[t + 1])), np.uint16))
                mine = np.concatenate(pieces)
            parts.append(mine)
            sizes[t] = len(mine)
        return np.concatenate(parts) if parts else flat, np.concatenate([[0], np.cumsum(sizes)])


class PieceBpe:
    """Ids of each word on its own, as sentencepiece makes them for a text of that word."""

    def __init__(self, path: str) -> None:
        self.pieces = piece_bpe(path)
        self.table = WordTable()

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words of the run, number of ids of each word)."""
        if not len(w.hashes):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        ends, data = word_ends(w), w.raw.tobytes()

        def encode(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[positions].tolist(), ends[positions].tolist(), strict=True)]
            ids = self.pieces.encode(texts, num_threads=1)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(itertools.chain.from_iterable(ids), np.uint16, int(lengths.sum())), lengths

        return self.table.gather(self.table.look_up(w.hashes, encode))
