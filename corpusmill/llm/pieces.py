"""Byte-level BPE encoding of whole texts through chunks that are encoded once and remembered.

A text's pre-tokens never cross a space that has a visible character on one of its sides, so the text is cut at such spaces and
each chunk (the space and what follows) is encoded by itself. Chunks repeat as words do; two bounded generations of them are kept
in each Python worker. The new chunks of many texts are encoded as a few long strings, for the same reason, and the ids are cut
apart by the bytes they stand for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GENERATION = 200_000  # entries of one generation of a worker's cache
TEXTS = 512  # encoded together, at most, if an encoder is not told otherwise
TEXT_CHARS = 4_000_000  # the same, in characters, or one longer text
BLOCK = 512  # chunks in one string
PLACES = 1 << 20  # chunks whose ids are put in place at once
LONGEST = 64  # longer chunks are encoded but not remembered

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space with white space before it and white space or the end after it: there a cut would change the pre-tokens.
_WIDE = re.compile(r"\s (?:\s|\Z)")
#: Letters and then ASCII marks (no apostrophe): pre-tokens end where the letters do. Fixed ranges that hold nothing but letters in any Unicode version.
_TAILED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ]++)([!-&(-/:-@\[-`{-~]+)")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Vocabulary:
    """The bytes of every id, the merges and the added tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, model = byte_letters(), data["model"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = [(self.ids[as_bytes(a)], self.ids[as_bytes(b)]) for a, b in pairs]
        self.width = 2 if max(self.bytes) < 2**16 else 4
        self.lengths = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            self.lengths[i] = len(b)


class Generations:
    """A bounded memory: what is asked for stays, the rest goes when a new generation begins."""

    def __init__(self, size: int = GENERATION) -> None:
        self.young, self.old, self.size = {}, {}, size

    def absent(self, keys: Iterable[str]) -> list[str]:
        """Those of the keys, none of them young, that the old generation lacks too; the others become young."""
        new = []
        for k in keys:
            v = self.old.get(k)
            if v is None:
                new.append(k)
            else:
                self.young[k] = v
        return new

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class TextEncoder:
    """Encodes texts to packed ids; `encode` gives the ids of whole strings, `lengths` the bytes that each id stands for."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], vocabulary: Vocabulary, generation: int = GENERATION, together: int = TEXTS, chars: int = TEXT_CHARS) -> None:
        self.together, self.chars = together, chars
        self.encode, self.lengths, self.kind = encode, vocabulary.lengths, f"<u{vocabulary.width}"
        self.added, self.chunks = list(vocabulary.added), Generations(generation)

    def _unusual(self, text: str) -> bool:
        """Chunks of the text cannot be told by spaces alone."""
        return "\0" in text or any(a in text for a in self.added) or _WIDE.search(text) is not None

    def _pack(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.kind).tobytes()

    def _block(self, keys: list[str], ids: np.ndarray) -> list[bytes]:
        """The values of the chunks that were encoded as one string."""
        ends = np.cumsum([len(k.encode()) + 1 for k in keys])
        cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * np.dtype(self.kind).itemsize
        packed, cuts = self._pack(ids), cuts.tolist()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts)]

    def _values(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of different chunks, each without its leading space, or after a NUL one without any."""
        remembered, known = self.chunks, self.chunks.young.get
        values = list(map(known, chunks))
        new = remembered.absent([k for k, v in zip(chunks, values) if v is None])
        tailed = {k: (m[1], "\0" + m[2]) for k in new if len(k) <= LONGEST and (m := _TAILED.fullmatch(k))}
        there = set(new)
        parts = remembered.absent({p for pair in tailed.values() for p in pair if p not in there and known(p) is None})
        blocks, single = [[]], []
        for k in [*(k for k in new if k not in tailed), *parts]:
            # chunks with white space at an end, the first of a text and very long ones stand alone
            if not k or len(k) > LONGEST or k[0] == "\0" or k[0].isspace() or k[-1].isspace():
                single.append(k)
            else:
                if len(blocks[-1]) == BLOCK:
                    blocks.append([])
                blocks[-1].append(k)
        encoded = self.encode([" " + " ".join(b) if b else "" for b in blocks] + [k[1:] if k[:1] == "\0" else " " + k for k in single])
        more = {}
        for b, ids in zip(blocks, encoded):
            remembered.young.update(zip(b, self._block(b, ids)))
        for k, ids in zip(single, encoded[len(blocks) :]):
            (remembered.young if len(k) <= LONGEST else more)[k] = self._pack(ids)
        remembered.young.update([(k, known(a) + known(b)) for k, (a, b) in tailed.items()])
        out = [(more[k] if k in more else known(k)) if v is None else v for k, v in zip(chunks, values)]
        remembered.turn()
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts whose chunks spaces tell apart: each different chunk is looked up once, and its ids are put at all its places."""
        cut = pc.split_pattern(pa.array(["\0" + t for t in texts], pa.large_string()), " ")
        places = cut.values.dictionary_encode()
        values = self._values(places.dictionary.to_pylist())
        sizes = np.array([len(v) for v in values], np.int64) // np.dtype(self.kind).itemsize
        packed, starts, at = np.frombuffer(b"".join(values), self.kind), np.cumsum(sizes) - sizes, places.indices.to_numpy()
        found, counts = [], []
        for i in range(0, len(at), PLACES):
            part = at[i : i + PLACES]
            n = sizes[part]
            found.append(packed[np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            counts.append(n)
        ids, ends = np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(counts))))[cut.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def some(self, texts: list[str]) -> list[bytes]:
        """For each text its packed ids."""
        plain, whole = {}, {}
        for i, text in enumerate(texts):
            if text:
                (whole if self._unusual(text) else plain)[i] = text
        out = [b""] * len(texts)
        if plain:
            for i, packed in zip(plain, self._plain(list(plain.values()))):
                out[i] = packed
        if whole:
            for i, ids in zip(whole, self.encode(list(whole.values()))):
                out[i] = self._pack(ids)
        return out

    def many(self, texts: list[str | None]) -> Iterable[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if len(held) == self.together or size > self.chars:
                yield from self.some(held)
                held, size = [], 0
        if held:
            yield from self.some(held)
