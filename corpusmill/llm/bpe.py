"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token exactly one token can end its encoding. An automaton over the vocabulary lists the tokens that are
suffixes of each prefix, longest first; a token is the prefix's last one if it may stand right after the last token of the
prefix that remains. Back-pointers then give the ids. The work is linear in the text, also for one endless word.

Many pre-tokens take each step together, as columns of arrays: prefixes of one length, their automaton states, the candidates for their
last tokens. Very long pre-tokens are walked one by one, by the same rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import common
from .pieces import LONGEST, PATTERN, Generations, TextEncoder, Vocabulary, tokenizer_path

PAIR_BITS = 20  # slots of the remembered pair tests of a worker
PIECES = 16_384  # pre-tokens that step together
PIECES_KEPT = 100_000  # entries of one generation of remembered pre-tokens
NEVER = 1 << 40  # later than every merge


class SuffixAutomaton:
    """By state: the longest token that is a suffix of what was read; by token: the next shorter suffix that is one."""

    def __init__(self, tokens: dict[bytes, int], size: int) -> None:
        children: list[dict[int, int]] = [{}]
        depth, parent, letter, token = [0], [0], [0], [-1]
        for word, i in tokens.items():
            node = 0
            for byte in word:
                child = children[node].get(byte)
                if child is None:
                    child = children[node][byte] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    letter.append(byte)
                    token.append(-1)
                node = child
            token[node] = i
        depth, parent, letter, token = (np.array(x, np.int32) for x in (depth, parent, letter, token))
        # a state without children goes where its suffix goes: it shares that state's row of the table
        inner = np.zeros(len(depth), bool)
        inner[parent] = True
        self.row = np.where(inner, np.cumsum(inner) - 1, 0).astype(np.int32)
        self.table, fail = np.zeros((int(inner.sum()), 256), np.int32), np.zeros(len(depth), np.int32)
        self.longest, self.shorter = token.copy(), np.full(size, -1, np.int32)
        below = np.nonzero(depth == 1)[0]
        self.table[0, letter[below]] = below
        for level in range(1, int(depth.max()) + 1):
            nodes = below
            if level > 1:
                fail[nodes] = self.table[self.row[fail[parent[nodes]]], letter[nodes]]
            own, other = token[nodes], self.longest[fail[nodes]]
            self.longest[nodes] = np.where(own >= 0, own, other)
            self.shorter[own[own >= 0]] = other[own >= 0]
            leaves, others = nodes[~inner[nodes]], nodes[inner[nodes]]
            self.row[leaves] = self.row[fail[leaves]]
            self.table[self.row[others]] = self.table[self.row[fail[others]]]
            below = np.nonzero(depth == level + 1)[0]
            self.table[self.row[parent[below]], letter[below]] = below

    def step(self, state, byte):
        return self.table[self.row[state], byte]


class PrefixBpe:
    def __init__(self, vocabulary: Vocabulary) -> None:
        n = len(vocabulary.lengths)
        self.length = np.where(np.isin(np.arange(n), list(vocabulary.ids.values())), vocabulary.lengths, 0).astype(np.int32)
        pair_rank: dict[int, int] = {}
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for rank, (a, b) in enumerate(vocabulary.merges):
            pair_rank.setdefault(a << 32 | b, rank)
            whole = vocabulary.ids[vocabulary.bytes[a] + vocabulary.bytes[b]]
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
        self.pair_keys = np.array(sorted(pair_rank), np.int64)
        self.pair_ranks = np.array([pair_rank[k] for k in self.pair_keys.tolist()], np.int64)
        self.automaton = SuffixAutomaton(vocabulary.ids, n)
        # sound: the token's own bytes encode as the token
        merged = np.nonzero(self.rank >= 0)[0]
        self.sound = self.length == 1
        apart = self._stay_apart(self.left[merged], self.right[merged], self.rank[merged])
        for i, ok in sorted(zip(merged.tolist(), apart.tolist()), key=lambda x: self.rank[x[0]]):
            self.sound[i] = ok and self.sound[self.left[i]] and self.sound[self.right[i]]
        # slots of remembered pair tests: the pair, shifted up one bit, and the answer
        self.tests = np.full(1 << PAIR_BITS, -1, np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER if there is none."""
        if not len(self.pair_keys):
            return np.full(len(left), NEVER)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def _stay_apart(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each pair: no merge joins the two before the merge with rank `limit`.

        Going back in time, whichever of the two touching tokens was formed last falls into its parts; two tokens that ever
        touch must not have a merge earlier than the one that used up one of them. Of equal merges the leftmost is first.
        """
        out, todo, strict = np.ones(len(left), bool), np.arange(len(left)), np.ones(len(left), bool)
        while len(todo):
            joined = self._joined(left, right)
            bad = (joined < limit) | (joined == limit) & ~strict & (joined < NEVER)
            out[todo[bad]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~bad & ((a >= 0) | (b >= 0))
            todo, left, right, a, b = todo[on], left[on], right[on], a[on], b[on]
            strict = a > b
            limit = np.maximum(a, b)
            left, right = np.where(strict, self.right[left], left), np.where(strict, right, self.left[right])
        return out

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair: the second may stand right after the first."""
        pair = left << 32 | right
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.tests[slot]
        out = (held & 1).astype(bool)
        new = np.nonzero(held >> 1 != pair)[0]
        if len(new):
            answer = self.sound[right[new]] & self._stay_apart(left[new], right[new], np.full(len(new), NEVER))
            out[new] = answer
            self.tests[slot[new]] = pair[new] << 1 | answer
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        step, longest, shorter, length, sound = self.automaton.step, self.automaton.longest, self.automaton.shorter, self.length, self.sound
        known: dict[int, bool] = {}
        last, state = [-1] * (len(piece) + 1), 0
        for end, byte in enumerate(piece, 1):
            state = step(state, byte)
            token = int(longest[state])
            while True:
                start = end - int(length[token])
                if start == 0:
                    fits = sound[token]
                else:
                    pair = last[start] << 32 | token
                    if pair not in known:
                        known[pair] = bool(self.follows(np.array([last[start]], np.int64), np.array([token], np.int64))[0])
                    fits = known[pair]
                if fits:
                    break
                token = int(shorter[token])
            last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= int(length[last[at]])
        return ids[::-1]

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        automaton, n = self.automaton, len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sorted_sizes = sizes[order]
        width = int(sorted_sizes[0]) if n else 0
        letters = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in order.tolist()]), np.uint8).reshape(n, width).T.copy()
        last = np.full((width + 1, n), -1, np.int64)  # by length of the prefix
        state = np.zeros(n, np.int32)
        active = np.searchsorted(-sorted_sizes, -np.arange(width), side="left")  # pieces with more than so many bytes
        flat = last.reshape(-1)
        for at, count in enumerate(active.tolist()):
            state = automaton.step(state[:count], letters[at, :count])
            todo, token = np.arange(count), automaton.longest[state].astype(np.int64)
            while len(todo):
                start = at + 1 - self.length[token]
                fits = self.sound[token]
                inner = np.nonzero(start > 0)[0]
                fits[inner] = self.follows(flat[start[inner] * n + todo[inner]], token[inner])
                last[at + 1, todo[fits]] = token[fits]
                todo, token = todo[~fits], automaton.shorter[token[~fits]].astype(np.int64)
        # back-pointers, all pieces a token at a time
        found, at, todo = [], sorted_sizes.copy(), np.arange(n)
        todo = todo[at > 0]
        while len(todo):
            token = flat[at[todo] * n + todo]
            found.append((todo, token))
            at[todo] -= self.length[token]
            todo = todo[at[todo] > 0]
        counts = np.zeros(n, np.int64)
        for todo, _ in found:
            counts[order[todo]] += 1
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if n else 0, np.int64)
        for step, (todo, token) in enumerate(found):
            out[ends[order[todo]] - 1 - step] = token
        return out, counts


class Codec:
    """Encodes a text to ids as the file's tokenizer does, and decodes ids."""

    def __init__(self, path: str) -> None:
        import regex

        vocabulary = Vocabulary(path)
        self.model, self.token_bytes, self.added = PrefixBpe(vocabulary), vocabulary.bytes, vocabulary.added
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kind, self.known = f"<u{vocabulary.width}", Generations(PIECES_KEPT)
        self.texts = TextEncoder(self._strings, vocabulary)
        self.decimal = np.array([f"{i}," for i in range(len(vocabulary.lengths))], "S")

    def _strings(self, strings: list[str]) -> list[np.ndarray]:
        """The ids of each string; the new pre-tokens of all are encoded together."""
        split = []
        for s in strings:
            pieces = []
            if self.special is not None and any(a in s for a in self.added):
                for k, part in enumerate(self.special.split(s)):  # every other part is an added token
                    pieces += ["\0" + part] if k % 2 else self.find(part)
            else:
                pieces = self.find(s)
            split.append(pieces)
        known = self.known
        absent = known.absent({p for pieces in split for p in pieces if p not in known.young})
        more = {p: np.array(self._one(p)).astype(self.kind).tobytes() for p in absent if len(p) > LONGEST or p[0] == "\0"}
        new = [p for p in absent if p not in more]
        for at in range(0, len(new), PIECES):
            part = new[at : at + PIECES]
            ids, counts = self.model.encode_many([p.encode() for p in part])
            packed = ids.astype(self.kind).tobytes()
            ends = (np.cumsum(counts) * np.dtype(self.kind).itemsize).tolist()
            known.young.update(zip(part, [packed[a:b] for a, b in zip([0, *ends], ends)]))
        if more:
            out = [b"".join([more[p] if p in more else known.young[p] for p in pieces]) for pieces in split]
        else:
            out = [b"".join(map(known.young.get, pieces)) for pieces in split]
        known.turn()
        return [np.frombuffer(b, self.kind).astype(np.int64) for b in out]

    def _one(self, piece: str) -> list[int]:
        """A long pre-token, or after a NUL an added token."""
        return [self.added[piece[1:]]] if piece[0] == "\0" and piece[1:] in self.added else self.model.encode(piece.encode())

    def many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for packed in self.texts.many(texts):
            yield np.frombuffer(packed, self.kind)

    def encode(self, text: str) -> list[int]:
        return next(self.many([text])).tolist()

    def spelled(self, ids: np.ndarray) -> bytes:
        """The decimal ids, joined by commas."""
        return self.decimal[ids].tobytes().translate(None, b"\0")[:-1]

    def decode(self, ids: list[int]) -> str:
        """Bytes that form no character become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The one of this Python worker."""
    return common.kept(f"bpe {path}", lambda: Codec(path))


def _added(df: DataFrame, name: str, kind: str) -> tuple[DataFrame, StructType, list[str]]:
    """`df` without a column of that name, and its schema and names with one at the end."""
    kept = df.drop(name)
    return kept, StructType([*kept.schema.fields, StructField(name, kind)]), [*kept.columns, name]


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Add the ids of each text. A null or empty text has none; a column that is called `ids_col` already is replaced. No shuffle."""
    path = path or tokenizer_path()
    kept, schema, names = _added(docs, ids_col, ArrayType(IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.tolist() for x in codec(path).many(batch.column(names.index(text_col)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names)

    return kept.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text of each row's ids (null: empty); a column that is called `out_col` already is replaced."""
    path = path or tokenizer_path()
    kept, schema, names = _added(encoded, out_col, StringType())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(i or []) for i in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return kept.mapInArrow(decode, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256.

    Each whole text (null: empty) is encoded and the ids are decoded again, both in one pass without a shuffle; a very long text costs
    in proportion to its length. Ids of repeated rows are computed for each; a null id stays null; other columns, whatever
    their names, play no part; an empty table gives an empty one.
    """
    path = path or tokenizer_path()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, counts, encoded, decoded = codec(path), [], [], []
            for ids in both.many(batch.column(1).to_pylist()):
                counts.append(len(ids))
                encoded.append(hashlib.sha256(both.spelled(ids)).hexdigest())
                decoded.append(hashlib.sha256(both.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    two = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return two.mapInArrow(digest, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs)
