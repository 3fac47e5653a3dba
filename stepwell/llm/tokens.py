"""Token ids of the ``tokenizers`` library, column by column, with a bounded vocabulary of known chunks.

Byte-level BPE splits a text into words before it merges bytes. A single space or line feed
between two characters that aren't white space always bounds a word, and so does a letter
before signs that end at one; a text is cut there. Arrow splits a column of texts into such chunks and looks them
up among those known; only new ones are encoded: plain words by the library's BPE model, all
else by ``Tokenizer.encode``. The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``;
tests hold them against it.

Known chunks are two Arrow arrays, bounded in number and bytes; chunks of over ``LONG`` bytes are never kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

#: White space other than single spaces and line feeds between other characters, and the mark used below: such texts are cut by ``_CUT``.
_ODD = r"  | \n|\n |\n\n|^[ \n]|[ \n]$|[\t\x02\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = re.compile(r"(?<![\s\x1c-\x1f\x85]) (?![\s\x1c-\x1f\x85]|\Z)")
#: A letter in all versions of Unicode tables, and signs, which are neither letters nor numbers nor white space.
_LETTER, _SIGN = "[A-Za-zÀ-ÖØ-öø-ʯ]", r"[!-/:-@\[-`{-~]"
#: Stands before a chunk that no space precedes.
_MARK = "\x02"
#: Most known chunks, their bytes, and the bytes of the longest one kept.
CHUNKS, BYTES, LONG = 400_000, 16 << 20, 64


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable character for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


class ColumnEncoder:
    """Ids of ``dtype`` (16 bits where the vocabulary allows, else 32)."""

    def __init__(self, path: str, chunks: int = CHUNKS, size: int = BYTES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        #: Chunks are sound only for plain byte-level splitting; any other tokenizer gets whole texts.
        self.by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.by_word = self.by_word and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s|^\w+.?$", x["content"]) for x in added)
        #: A text that holds an added token is encoded whole: a cut could lie inside.
        self.added = "|".join(re.escape(x["content"]) for x in added if x["content"])
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.letters = self.tokenizer.model, str.maketrans(_byte_letters())
        self.most, self.size = chunks, size
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends, self.hits = np.empty(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def chunk(self, chunk: str) -> list[int]:
        bare = chunk.removeprefix(_MARK)
        word = bare if len(bare) < len(chunk) or chunk == "\n" else " " + bare
        if bare.isalpha():
            if bare.isascii():
                return [t.id for t in self.model.tokenize(word.replace(" ", "Ġ"))]
            raw = word.encode()
            if max(raw) < 0xCA:  # Latin letters, which all versions of Unicode tables call letters
                return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]
        return self.whole(word) if word else []

    def _cut(self, text: str) -> list[str]:
        """Chunks of a text with odd white space; one with the mark or an added token is one chunk."""
        if _MARK in text or not self.by_word or self.added and re.search(self.added, text):
            return [_MARK + text]
        first, *rest = _CUT.split(text)
        return [_MARK + first, *rest]

    def _split(self, texts: pa.Array) -> pa.Array:
        """Chunks of each text: one or more."""
        texts = pc.replace_substring_regex(texts, rf"({_LETTER})({_SIGN}+)([ \n]|$)", rf"\1 {_MARK}\2\3")
        texts = pc.replace_substring(texts, "\n", f" \n {_MARK}")
        return pc.split_pattern(pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (_MARK, texts, "")]), " ")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has. Nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        if self.by_word and self.added:
            odd |= pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode(self._split(texts))
        order = np.argsort(odd, kind="stable")
        plain, other = order[: len(odd) - odd.sum()], order[len(odd) - odd.sum() :]
        kind = pa.list_(pa.large_string())
        parts = [pa.array([self._cut(t) for t in texts.take(pa.array(other)).to_pylist()], kind)]
        if len(plain):
            parts.insert(0, self._split(texts.take(pa.array(plain))).cast(kind))
        ids, n = self._encode(pa.concat_arrays(parts))
        back = pa.array(np.argsort(order))
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), pa.array(ids))
        return lists.take(back).flatten().to_numpy(), n[back.to_numpy()]

    def _encode(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds, flat = lists.offsets.to_numpy(), lists.flatten()
        found = pc.index_in(flat, value_set=self.known)
        place = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            new = flat.filter(found.is_null()).dictionary_encode()
            place[place < 0] = len(self.known) + new.indices.to_numpy()
            made = [self.chunk(c) for c in new.dictionary.to_pylist()]
            self.known = pa.concat_arrays([self.known, new.dictionary])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))])
            self.ids = np.concatenate([self.ids, np.fromiter((i for m in made for i in m), self.dtype)])
        table = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.ids))
        ids, n = table.take(pa.array(place)).flatten().to_numpy(), np.add.reduceat(self.ends[place + 1] - self.ends[place], bounds[:-1])
        hits = np.bincount(place, minlength=len(self.known))
        hits[: len(self.hits)] += self.hits
        self.hits = hits
        if len(self.known) > self.most or self.known.nbytes > self.size:
            self._forget()
        return ids, n

    def _forget(self) -> None:
        """Keep the more used half, without long chunks."""
        rank = np.argsort(-np.where(pc.binary_length(self.known).to_numpy() <= LONG, self.hits, 0), kind="stable")[: self.most // 2]
        keep = np.sort(rank[self.hits[rank] > 0])
        keep = keep[pc.binary_length(self.known).to_numpy()[keep] <= LONG]
        self.hits = self.hits[keep] // 2 + 1
        table = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.ids)).take(pa.array(keep))
        self.known, self.ids = self.known.take(pa.array(keep)), table.flatten().to_numpy()
        self.ends = np.concatenate([[0], np.cumsum((self.ends[1:] - self.ends[:-1])[keep])])


def encoder(path: str) -> ColumnEncoder:
    """The encoder of this worker."""
    return worker_state(f"tokens {path}", lambda: ColumnEncoder(path))


def encoded(batches: Iterator[pa.RecordBatch], path: str, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of bounded bytes, with the ids of their texts and how many each text has."""
    from .common import byte_slices

    for b in byte_slices(batches, column):
        yield (b, *encoder(path).encode(b.column(column)))
