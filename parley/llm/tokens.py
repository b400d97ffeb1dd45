"""Token ids of the public byte-level vocabulary."""

from __future__ import annotations

import base64
import functools

import numpy as np

VOCABULARY = "byte_bpe_50k"
_PROBES = ["", " ", "It's 12 o'clock,\n\n  isn't it?\t", "Größe déjà ñandú 東京 🙂 \x00\x85", "a" * 300 + "  \n b"]


class Encoder:
    """Ids of whole texts: those of `tokenizers` with the vocabulary's JSON file, without special tokens put around them.

    A special token's string in a text is that token, as the library has it. The same vocabulary as ranks gives the ids
    several times faster; it is used if it agrees on probes, and never for texts that hold a special token's string or long
    runs of white space, where its patterns are slow.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(json_path)
        self._special = [t.content for t in self._exact.get_added_tokens_decoder().values()]
        self._fast = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            if all(fast.encode_ordinary(p) == self._exact.encode(p, add_special_tokens=False).ids for p in _PROBES):
                self._fast = fast

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self._fast is None or any(s in text for s in self._special) or " " * 2000 in text or "\n" * 2000 in text or len(text) > 10_000 and max(map(len, text.split(None, -1)), default=0) > 5000:
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self._fast.encode_to_numpy(text, disallowed_special=()) if hasattr(self._fast, "encode_to_numpy") else np.array(self._fast.encode_ordinary(text), dtype=np.uint32)


@functools.lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY) -> Encoder:
    """One encoder for each process. `name`: a vocabulary that `public_tokenizers` has, or the path of a JSON file."""
    if "/" in name:
        return Encoder(name)
    import public_tokenizers as vocabularies

    ranks = vocabularies.path(f"{name}.tiktoken") if name == VOCABULARY else None
    return Encoder(vocabularies.path(f"{name}.json"), ranks, vocabularies.PATTERN if ranks else None)
