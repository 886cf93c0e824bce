"""Token ids of whole texts by a public vocabulary, counted or listed, a column at a time.

A byte-level BPE cuts a text into pre-tokens before it merges, and no pre-token reaches into a run
of white space but by its last character. So a text is the concatenation of the ids of its chunks: a
run of white space but its last character (all of it at the text's end), and what lies between runs with
that last character before it. Special strings are tokens of their own and part texts like an end. Each
distinct chunk is encoded once while it is remembered. Where no two white spaces adjoin, chunks are
what single spaces part, cut a column at a time. Files of other kinds are encoded by their library.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.llm.common import release

#: Two adjoining white spaces of any kind (a superset of what the pre-tokenizer calls white space).
ADJOINING = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]{2}"
#: White space as the pre-tokenizer has it; characters about which libraries differ.
SPACE = "\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f"[{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]+\\Z|[{SPACE}]?[^{SPACE}]+")
DOUBTFUL = re.compile("[\\x1c-\\x1f\u180e]")
#: The pre-tokenizer's pattern for byte-level vocabularies of this family.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encodings of chunks a worker remembers before it starts anew.
REMEMBERED = 100_000


#: Marks that are a pre-token of their own behind a word (an apostrophe isn't).
TAILS = frozenset(".,;:!?")


def _one_word(word: str) -> bool:
    """Letters only, of the Latin blocks whose classes no version of Unicode disputes: one pre-token, with its space."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """A byte-level BPE file of the tokenizers library.

    single: byte strings proved to encode alone as one token: those in the vocabulary for
    which merging their own bytes ends in that one token. The proof is run once a worker
    over all vocabulary strings, none of the texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        kind = spec["pre_tokenizer"] or {}
        letters = byte_letters()
        special = set(self.special)
        ids = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # The fast merger orders merges by id: that must be the file's own order.
        in_order = [spec["model"]["vocab"]["".join(m)] for m in merges]
        self.plain = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not spec["normalizer"] and in_order == sorted(in_order) and len(set(in_order)) == len(in_order)
        self.merger = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ids, special_tokens={}) if self.plain else None
        self.single = {b: i for b, i in ids.items() if self.plain and self.merger._encode_single_piece(b) == [i]}
        loose = [t for t in spec.get("added_tokens", ()) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        self.special_ids = {} if loose else {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        parts = sorted(self.special_ids, key=len, reverse=True)
        self.part = re.compile("(" + "|".join(map(re.escape, parts)) + ")") if parts else None
        self.whole = bool(loose)  # special strings that take their surroundings along: texts go to the library
        self.bad = "|".join([ADJOINING, *(f"\\Q{s}\\E" for s in self.special)])

    @cached_property
    def library(self):
        """The file's own library, opened for the first text that only it knows: workers that need it not are smaller by its tables."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids_of_chunk(self, chunk: str) -> list[int] | tuple[int, ...]:
        """Ids of a chunk: at most one space, and that leading. Whole-token shortcut first, merges for the rest."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if _one_word(word):
            return self._piece(chunk.encode())
        if word[-1:] in TAILS and _one_word(word[:-1]):  # the word and its mark are two pre-tokens
            return [*self._piece(chunk[:-1].encode()), *self._piece(word[-1].encode())]
        return self.merger._core_bpe.encode_ordinary(chunk)

    def _piece(self, piece: bytes) -> list[int] | tuple[int, ...]:
        one = self.single.get(piece)
        return (one,) if one is not None else self.merger._core_bpe.encode_single_piece(piece)

    def chunks(self, text: str) -> list[str] | None:
        """Chunks and special strings of any text; None where only the library knows."""
        if not self.plain or self.whole or DOUBTFUL.search(text):
            return None
        return [c for i, part in enumerate(self.part.split(text) if self.part else [text]) for c in ([part] if i % 2 else CHUNKS.findall(part))]

    def ids_of(self, chunk: str) -> list[int] | tuple[int, ...]:
        own = self.special_ids.get(chunk)
        return (own,) if own is not None else self.ids_of_chunk(chunk)

    def ids_of_text(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


class Encoder:
    """Encodes columns of texts; remembers chunks up to a bound."""

    def __init__(self, path: str):
        self.v = ByteVocabulary(path)
        self.ids: dict[str, int] = {}  # a chunk's place: its ids are pool[ends[place - 1] : ends[place]]
        self.pool, self.ends = [np.zeros(0, np.uint32)], [0]
        self.counts: dict[str, int] = {}
        self.chunks: dict[str, list[int] | tuple[int, ...]] = {}

    def _odd(self, text: str) -> list[int]:
        """Ids of a text in which white spaces adjoin or a special string stands."""
        chunks = self.v.chunks(text)
        if chunks is None:
            return self.v.ids_of_text(text)
        known, out = self.chunks, []
        if len(known) > REMEMBERED:
            known.clear()
        for c in chunks:
            ids = known.get(c)
            if ids is None:
                ids = known[c] = self.v.ids_of(c)
            out.extend(ids)
        return out

    def forget(self) -> None:
        """Let go of what is remembered, so that an idle worker holds the vocabulary only."""
        self.ids, self.counts, self.chunks, self.pool, self.ends = {}, {}, {}, [np.zeros(0, np.uint32)], [0]

    def _parts(self, texts: pa.Array):
        """Which texts are chunked, their chunk codes, first-chunk flags, offsets and the distinct chunks."""
        odd = pc.match_substring_regex(texts, self.v.bad).to_numpy(zero_copy_only=False).astype(bool) if self.v.plain else np.ones(len(texts), bool)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        offsets -= offsets[0]
        coded = flat.dictionary_encode()
        return odd, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary.to_pylist()

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text (nulls count as empty)."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.int64)
        odd, codes, offsets, chunks = self._parts(texts)
        known = self.counts
        if len(known) > REMEMBERED:
            known.clear()
        each = np.zeros(len(chunks) + 1, np.int64)
        for i, c in enumerate(chunks):
            n = known.get(c)
            if n is None:
                n = known[c] = len(self.v.ids_of_chunk(" " + c))
            each[i] = n
        per = each[codes]
        first = offsets[:-1]
        for i in np.flatnonzero(offsets[1:] > first):  # a text's first chunk has no space before it
            c = chunks[codes[first[i]]]
            per[first[i]] = len(self.v.ids_of_chunk(c)) if c else 0
        total = np.concatenate([[0], np.cumsum(per)])
        out = total[offsets[1:]] - total[offsets[:-1]]
        for i in np.flatnonzero(odd):
            out[i] = len(self._odd(texts[int(i)].as_py()))
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers (nulls count as empty)."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not len(texts):
            return []
        odd, codes, offsets, chunks = self._parts(texts)
        if len(self.ids) > REMEMBERED:
            self.forget()
        known, at, fresh, ends = self.ids, [], [], self.ends
        get, ids_of = known.get, self.v.ids_of_chunk
        top = ends[-1]
        for c in chunks:
            i = get(c)
            if i is None:
                i = known[c] = len(ends)
                x = ids_of(" " + c)
                fresh.extend(x)
                top += len(x)
                ends.append(top)
            at.append(i)
        self.pool.append(np.array(fresh, np.uint32))
        flat = np.concatenate(self.pool)
        self.pool = [flat]
        all_ends, at = np.array(ends), np.array(at)
        start = all_ends[at - 1]
        size = all_ends[at] - start
        out = []
        n, s = size[codes], start[codes]
        for i in range(len(texts)):
            a, b = offsets[i], offsets[i + 1]
            if odd[i]:
                out.append(np.array(self._odd(texts[i].as_py()), np.uint32))
                continue
            c = chunks[codes[a]] if b > a else ""
            head = np.array(self.v.ids_of_chunk(c), np.uint32) if c else np.zeros(0, np.uint32)
            k = n[a + 1 : b]
            ends = np.cumsum(k)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(s[a + 1 : b] - ends + k, k)
            out.append(np.concatenate([head, flat[at]]))
        return out


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file: opened once."""
    if path not in _open:
        _open[path] = Encoder(path)
        release()  # what reading the file took
    return _open[path]
