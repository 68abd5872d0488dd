"""Operator 8: quality rules from tokeniser fertility, with a base of plain counts.

A public vocabulary cuts each word into pieces. Text of a kind the vocabulary
was made for has a usual number of characters a piece; shouting, symbol noise,
broken encodings and other scripts leave the usual range, fall back to single
bytes, or repeat few pieces. Each script has its own bands, and languages with
labelled texts have narrower ones. One pass over the input split, nothing is
shuffled, and memory holds one run of texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.shared import trimmed
from pricewell.llm.tokens import PieceBpe, forget
from pricewell.llm.words import Words, inside, line_hashes, mix, ngrams, word_ends, words


class Band(NamedTuple):
    """What a kept text may have: characters a token, share of byte tokens, bits of entropy a token, tokens a word.

    A longer text has more kinds of tokens: ENTROPY_GROWTH times the binary
    logarithm of its tokens (4,096 at most) is added to least_entropy.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    most_tokens: float = float("inf")


# Bands by script, and by language where labelled texts gave narrower ones. The entropy bound holds from ENTROPY_TOKENS tokens on.
BANDS = {
    "latin": Band(1.6, 7.0, 0.05, 3.75),
    "greek": Band(0.9, 4.0, 0.10, 3.0),
    "cyrillic": Band(1.0, 5.0, 0.10, 3.0),
    "semitic": Band(0.7, 4.0, 0.15, 3.0),
    "indic": Band(0.4, 3.0, 0.60, 2.5),
    "cjk": Band(0.3, 2.0, 0.60, 3.0),
    "none": Band(0.3, 6.0, 0.60, 2.5),
}
LANGUAGES = {
    "en": Band(1.6, 7.0, 0.05, 3.95, 3.3),
    "de": Band(1.6, 7.0, 0.05, 3.95, 3.3),
    "es": Band(1.6, 7.0, 0.05, 3.85, 3.3),
    "fr": Band(1.6, 7.0, 0.05, 3.9, 3.6),
}
ENTROPY_TOKENS = 50
ENTROPY_GROWTH = 0.22

# The script that a first byte of a UTF-8 character belongs to, as an index into SCRIPTS.
SCRIPTS = ["none", "latin", "greek", "cyrillic", "semitic", "indic", "cjk"]
_SCRIPT = np.zeros(256, np.uint8)
_SCRIPT[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xC9)]] = 1
_SCRIPT[[0xCE, 0xCF]] = 2
_SCRIPT[range(0xD0, 0xD4)] = 3
_SCRIPT[range(0xD7, 0xDC)] = 4
_SCRIPT[0xE0] = 5
_SCRIPT[range(0xE3, 0xEE)] = 6

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,
    script string, n_tokens long, tokens_per_word double, chars_per_token double, byte_share double, token_entropy double, kept boolean"""


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of true flags between bounds."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), bounds))


def _owner(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def repeated_windows(w: Words, n: int = 3) -> np.ndarray:
    """Per word, whether an n-word window of its text that holds it is found twice or more there."""
    covered = np.zeros(len(w.hashes), bool)
    grams = ngrams(w.hashes, n)
    if not len(grams):
        return covered
    at = np.flatnonzero(inside(w.offsets, len(w.hashes), n))
    keys = grams[at] ^ mix(_owner(w.offsets)[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = at[twice]
    for i in range(n):
        covered[hit + i] = True
    return covered


def duplicate_lines(w: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    starts, hashes = line_hashes(w.raw, w.bounds)
    n_texts = len(w)
    if not len(starts) or not len(w.starts):
        return np.zeros(n_texts, np.int64)
    line_of_word = np.unique(np.searchsorted(starts, w.starts, "right") - 1)
    text = np.searchsorted(w.bounds, starts[line_of_word], "right") - 1
    keys = hashes[line_of_word] ^ mix(text.astype(np.uint64) + np.uint64(1))
    first = np.unique(keys, return_index=True)[1]
    return np.bincount(text, minlength=n_texts) - np.bincount(text[first], minlength=n_texts)


def _entropy(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits a token of each text's own distribution of tokens."""
    n_texts = len(bounds) - 1
    counts = np.diff(bounds)
    keys = np.sort((_owner(bounds).astype(np.int64) << 16) | ids)
    if not len(keys):
        return np.zeros(n_texts)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    run, text = np.diff(edge), keys[edge[:-1]] >> 16
    part = np.bincount(text, weights=run * np.log2(run), minlength=n_texts)
    safe = np.maximum(counts, 1)
    return np.where(counts > 0, np.log2(safe) - part / safe, 0.0)


def _measure(doc_ids: pa.Array, languages: list[str | None], w: Words, tokens: PieceBpe, is_byte: np.ndarray, bands: np.ndarray, own: dict[str, Band]) -> pa.RecordBatch:
    n_words = np.diff(w.offsets)
    ends = word_ends(w)
    word_bytes = np.concatenate([[0], np.cumsum(ends - w.starts)])[w.offsets]
    word_chars = np.diff(word_bytes) - _sums((w.raw & 0xC0) == 0x80, w.bounds)
    repeats = _sums(repeated_windows(w), w.offsets)
    base_failed = (n_words < 50) | (100 * repeats > 50 * n_words)

    ids, lengths = tokens.encode(w)
    token_bounds = np.concatenate([[0], np.cumsum(lengths)])[w.offsets]
    n_tokens = np.diff(token_bounds)
    safe = np.maximum(n_tokens, 1)
    per_token = word_chars / safe
    per_word = n_tokens / np.maximum(n_words, 1)
    byte_share = _sums(is_byte[ids], token_bounds) / safe
    entropy = _entropy(ids, token_bounds)
    kinds = np.bincount(_owner(w.bounds) * len(SCRIPTS) + _SCRIPT[w.raw], minlength=len(w) * len(SCRIPTS)).reshape(len(w), -1)
    kinds[:, 0] = 0
    script = kinds.argmax(axis=1)
    band = bands[script]
    for i, lang in enumerate(languages):
        if lang in own and SCRIPTS[script[i]] == "latin":
            band[i] = own[lang]
    least_entropy = band[:, 3] + ENTROPY_GROWTH * np.log2(np.clip(n_tokens, 1, 4096))
    good = (per_token >= band[:, 0]) & (per_token <= band[:, 1]) & (byte_share <= band[:, 2]) & (per_word <= band[:, 4]) & ((entropy >= least_entropy) | (n_tokens < ENTROPY_TOKENS))
    columns = [doc_ids, *map(pa.array, (n_words, word_chars, _sums(_SYMBOL[w.raw], w.bounds), duplicate_lines(w), repeats, base_failed, np.array(SCRIPTS, object)[script], n_tokens, per_word, per_token, byte_share, entropy, ~base_failed & good))]
    return pa.record_batch(columns, names=[x.split()[0] for x in SCHEMA.split(",")])


def quality(docs: DataFrame, vocabulary: str, bands: dict[str, Band] | None = None, languages: dict[str, Band] | None = None) -> DataFrame:
    """Counts, fertility measures and verdict of every text: one row a row of docs.

    docs: doc_id, text, and lang if there is one; other columns are ignored.
    vocabulary: a sentencepiece model. A null text is an empty one: all counts 0, rejected. A null doc_id
    stays null, equal rows are measured each, an empty table gives no rows.
    ``kept`` is false where base_failed is true or a measure leaves the band of
    the text's most frequent script; a text mostly of Latin letters whose lang
    has a band is held to that one. A null or unknown lang has none.
    """
    table = np.array([(bands or BANDS)[s] for s in SCRIPTS])
    own = LANGUAGES if languages is None else languages
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    @trimmed
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PieceBpe(vocabulary)
        is_byte = np.array([tokens.pieces.is_byte(i) for i in range(tokens.pieces.vocab_size())])
        for batch in batches:
            for w in words(batch.column(1), fold=False):
                yield _measure(batch.column(0).slice(w.first, len(w)), batch.column(2).slice(w.first, len(w)).to_pylist(), w, tokens, is_byte, table, own)
        forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lang.alias("lang")).mapInArrow(task, SCHEMA)
