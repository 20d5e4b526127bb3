"""Token ids of a public tokenizer, computed once per distinct word.

The tokenizer drops white space and never joins characters across it, so the ids of a text are
those of its white-space separated words in order. A word of plain Latin letters followed by marks
has the ids of its lower-cased letters, then those of the marks: the tokenizer lower-cases, and cuts
between letters and marks. Each worker keeps the ids of the words it has met.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from groundline.llm.batches import words

SLICE_BYTES = 6 << 20
# Words a worker keeps; its table is emptied when full. Longer words are not kept.
KNOWN_WORDS = 1_000_000
KNOWN_LENGTH = 64
_LETTERS = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?#*$%&|]*)$"
_TOGETHER = 200


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a special token between words keeps their ids apart
        self.mark, self.mark_id = "<|endoftext|>", self.tokenizer.token_to_id("<|endoftext|>")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.ids, self.used = np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0
        self.starts = np.zeros(0, np.int64)

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row and the number of ids of each."""
        plain = [w for w in new if self.mark not in w]
        if len(plain) < len(new):
            found = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in new]
            return np.concatenate(found), np.array([len(f) for f in found], np.int64)
        ids, sizes = [], []
        for start in range(0, len(new), 256 * _TOGETHER):
            groups = [self.mark.join(new[k : k + _TOGETHER]) for k in range(start, min(len(new), start + 256 * _TOGETHER), _TOGETHER)]
            for encoded in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False):
                found = np.array(encoded.ids, np.uint32)
                marks = np.flatnonzero(found == self.mark_id)
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1)
                ids.append(np.delete(found, marks))
        return np.concatenate(ids), np.concatenate(sizes)

    def lookup(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start in ``self.ids`` and number of ids of each word."""
        if len(self.known) + len(distinct) > KNOWN_WORDS:
            self.forget()
        find = self.known.get
        at = np.array([find(w, -1) for w in distinct], np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            ids, sizes = self._encode(new)
            need = self.used + len(ids)
            if need > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(need, 2 * len(self.ids)) - len(self.ids), np.uint32)])
            self.ids[self.used : need] = ids
            first = len(self.starts)
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used = need
            at[missing] = first + np.arange(len(new))
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        return self.starts[at], self.sizes[at]

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the bounds of the texts in them."""
        split = words(texts)
        cut = pc.extract_regex(split.known, _LETTERS)
        whole = pc.is_null(cut)
        core = pc.if_else(whole, split.known, pc.utf8_lower(pc.struct_field(cut, "core")))
        tail = pc.fill_null(pc.struct_field(cut, "tail"), "")
        units = pa.concat_arrays([core, tail]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        starts, sizes = self.lookup(distinct)
        code = units.indices.to_numpy().reshape(2, -1)[:, split.codes].T.ravel()
        each = sizes[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat(starts[code] - ends[:-1], each) + np.arange(ends[-1])
        out, bounds = self.ids[place], ends[2 * split.bounds]
        if any(len(w) > KNOWN_LENGTH for w in distinct):
            self.drop_long(distinct)
        return out, bounds

    def drop_long(self, distinct: list[str]) -> None:
        """Forget words too long to be worth keeping; their ids go when the table is emptied."""
        for w in distinct:
            if len(w) > KNOWN_LENGTH:
                self.known.pop(w, None)
        if self.used > 16 * KNOWN_WORDS:
            self.forget()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
