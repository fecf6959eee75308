"""Token ids of whole texts with a public tokenizer, for use inside Arrow tasks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from helioframe.llm import kernel

END_ID = 1
#: Words whose ids a worker keeps; others are encoded once a call.
KEPT_WORDS = 500_000
#: Bytes of text encoded in one call.
BATCH = 1 << 20


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters that the tokenizer keeps together and lower-cases one by one, then one run of marks.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|<>()]*)")


class _Words(dict):
    """Ids of words as little-endian 32-bit integers; holds the frequent ones for good."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers import pre_tokenizers as pre

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case words and marks that are already apart: the same model, no further rules.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> dict[str, bytes]:
        split = {w: (m[1].lower(), m[2]) for w in words if (m := _SIMPLE.fullmatch(w))}
        parts = list({p for pair in split.values() for p in pair if p})
        ids = _ids(self.plain, " ".join(parts))
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(parts):  # a vocabulary without word ends
            split, ends, parts = {}, ends[:0], []
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        known = {p: raw[a:b] for p, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True)}
        known[""] = b""
        out = {w: known[a] + known[b] for w, (a, b) in split.items()}
        return out | {w: _ids(self.tokenizer, w).tobytes() for w in words - out.keys()}


def _ids(tokenizer, text: str) -> np.ndarray:
    return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], dtype="<u4")


_encoders: dict[str, _Words] = {}
kernel.HELD.append(_encoders)


class Encoder:
    """Encodes texts word by word.

    White space always ends a token of this kind of vocabulary and is itself dropped,
    so the ids of a text are the ids of its words in a row.  Words are encoded once a
    call, and those that a worker holds not again.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        if path not in _encoders:
            _encoders[path] = _Words(path)
        self.words, self.end = _encoders[path], np.array([end_id], dtype="<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, closed by the end id; a null text is empty."""
        # A lone surrogate has no UTF-8 form; it is read as the replacement character.
        split = [(t or "").encode("utf-8", "replace").decode().replace("\n", " ").split(" ") for t in texts]
        learned = self.words.learn(set().union(*split) - self.words.keys())
        self.words.update(learned)
        out = [b"".join(map(self.words.__getitem__, parts)) + self.end for parts in split]
        for w in list(learned)[max(0, KEPT_WORDS - len(self.words) + len(learned)) :]:
            del self.words[w]
        return out


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
