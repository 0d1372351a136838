"""Token ids of whole texts with a public tokenizer file, with a cache of space-separated chunks.

The tokenizer at hand never joins characters across white space, so the ids of a text are the ids of its chunks one after
the other. Chunks seen before come from a bounded cache; new ones are cut by the tokenizer's own pattern and encoded by its
own model in one call. Chunks outside plain Latin text, and tokenizers of another make, go through the library as they are.
"""
from __future__ import annotations

import json
import re
import unicodedata
from itertools import islice
from os.path import commonprefix

import numpy as np

from foresift.llm.common import trim_memory

CACHE_CHUNKS = 600_000
# new chunks that the library sees at once, and calls after which free memory goes back
LEARN_CHUNKS = 4096
TRIM_CALLS = 16
# the pattern and steps that the fast path is made for, as they stand in the tokenizer file
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = ["NFC", "Replace", "Lowercase"]

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_loaded: dict[str, "TextEncoder"] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "TextEncoder":
    """One encoder for each worker process."""
    if path not in _loaded:
        _loaded[path] = TextEncoder(path)
    return _loaded[path]


class TextEncoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        suffix = spec["model"].get("end_of_word_suffix")
        # a chunk without the common start of all special tokens holds none
        self.mark = commonprefix([t["content"] for t in spec.get("added_tokens", [])])
        self.fast = bool(self.mark and steps == STEPS and cuts[0].get("pattern", {}).get("Regex") == PATTERN and suffix
                         and not spec["model"].get("dropout"))
        self.chunks: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.calls = 0
        if self.fast:
            self.latin = regex.compile(PATTERN)
            self.words = Tokenizer(self.full.model)
            self.words.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.full.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            for token, i in vocab.items():
                self.ends[i] = token.endswith(suffix)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        self.calls += 1
        if self.calls % TRIM_CALLS == 1:
            trim_memory()
        if not self.fast:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in
                    self.full.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t else [] for t in texts]
        if len(self.chunks) > CACHE_CHUNKS:
            # frequent chunks came early: the first half stays
            self.chunks = dict(islice(self.chunks.items(), CACHE_CHUNKS // 2))
            self.pieces = dict(islice(self.pieces.items(), CACHE_CHUNKS // 4))
        known = self.chunks
        new = list({w for words in cut for w in words if w not in known})
        for at in range(0, len(new), LEARN_CHUNKS):
            self._learn(new[at:at + LEARN_CHUNKS])
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def _learn(self, new: list[str]) -> None:
        cut: dict[str, list[str]] = {}
        for chunk in new:
            plain = chunk.isprintable() and self.mark not in chunk
            if plain and chunk.isascii():
                cut[chunk] = [low] if (low := chunk.lower()).isalpha() else _ASCII.findall(low)
            elif plain and max(chunk) < "ɐ" and unicodedata.is_normalized("NFC", chunk):
                low = chunk.lower()
                cut[chunk] = self.latin.findall(low) if unicodedata.is_normalized("NFC", low) else [""]
            else:
                cut[chunk] = [""]
            if "" in cut[chunk] or chunk != chunk.strip():
                cut.pop(chunk)
                self.chunks[chunk] = np.array(self.full.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        fresh = list({p for pieces in cut.values() for p in pieces if p not in self.pieces})
        if fresh:
            ids = np.array(self.words.encode(" ".join(fresh), add_special_tokens=False).ids, dtype="<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(fresh):
                raise ValueError("the model does not end words with its suffix")
            raw, from_ = ids.tobytes(), 0
            for piece, to in zip(fresh, (at * 4).tolist()):
                self.pieces[piece] = raw[from_:to]
                from_ = to
        get = self.pieces.__getitem__
        for chunk, pieces in cut.items():
            self.chunks[chunk] = b"".join(map(get, pieces))
