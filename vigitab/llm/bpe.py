"""BPE encoding and decoding with a public byte-level vocabulary.

A piece's symbols are leaves of a segment tree whose values are the ranks of adjacent pairs (with the position, so that of equal ranks the
left one is smaller). The root is the next merge; a merge changes three leaves and the paths above them, and a piece is done when the root
holds no rank. Many pieces of like length are merged side by side, one tree to a row. No step shuffles, and the vocabulary, whose size is
fixed, is all that is broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, whole_text

#: The published split pattern of byte-level BPE (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_MERGE = np.iinfo(np.int64).max
PLACE_BITS = 32
#: Leaves of the trees merged side by side at once, and pieces remembered by one task.
TREE_CELLS, KNOWN_PIECES = 1 << 19, 100_000
#: Pieces of like length below which each is merged in a tree of its own, and the longest piece that is remembered.
FEW_PIECES, KNOWN_PIECE = 64, 256


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: printable bytes are themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Bytes of each id, ids of single bytes, merges as a sorted array of pairs, and special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in special}
        self.bytes_of |= {i: token.encode() for token, i in special.items()}
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, made = (np.array([ids[v] for v in part], dtype=np.int64) for part in zip(*((a, b, a + b) for a, b in pairs)))
        order = np.argsort(left << PLACE_BITS | right)
        self.pairs, self.rank, self.made = (left << PLACE_BITS | right)[order], order.astype(np.int64), made[order]
        self.merge_of = dict(zip(self.pairs.tolist(), self.rank.tolist()))
        self.made_by_rank = np.zeros(len(order), dtype=np.int64)
        self.made_by_rank[self.rank] = self.made
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair among the merges, and whether it is one."""
        key = left << PLACE_BITS | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return at, self.pairs[at] == key


def merge_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Ids of each piece as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    at = 0
    while at < len(order):
        width = 1 << max(1, int(size[order[at]] - 1).bit_length())
        stop = min(int(np.searchsorted(size[order], width, side="right")), at + max(1, TREE_CELLS // width))
        if stop - at < FEW_PIECES and width >= FEW_PIECES:
            for i in order[at:stop].tolist():
                out[i] = _merge_one(vocabulary, pieces[i], width)
        else:
            _merge_rows(vocabulary, pieces, order[at:stop], width, out)
        at = stop
    return out


def _merge_one(vocabulary: Vocabulary, piece: bytes, width: int) -> bytes:
    """Merge one piece of at most `width` bytes; a path is followed upwards only as far as its values change."""
    n, merge_of, made, low = len(piece), vocabulary.merge_of, vocabulary.made_by_rank.tolist(), (1 << PLACE_BITS) - 1
    token = vocabulary.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after, ahead = [*range(1, n), -1], [*range(-1, n - 1)]

    def value(i: int, j: int) -> int:
        rank = merge_of.get(token[i] << PLACE_BITS | token[j]) if i >= 0 <= j else None
        return NO_MERGE if rank is None else rank << PLACE_BITS | i

    tree = [NO_MERGE] * width + [value(i, i + 1) for i in range(n - 1)] + [NO_MERGE] * (width - n + 1)
    for at in range(width - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    while (root := tree[1]) != NO_MERGE:
        i = root & low
        j, h = after[i], ahead[i]
        k = after[j]
        token[i], token[j], after[i] = made[root >> PLACE_BITS], -1, k
        if k >= 0:
            ahead[k] = i
        changed = [(i, value(i, k)), (j, NO_MERGE)]
        if h >= 0:
            changed.append((h, value(h, i)))
        for leaf, new in changed:
            at = leaf + width
            tree[at] = new
            while at > 1:
                at >>= 1
                new = tree[2 * at] if tree[2 * at] < tree[2 * at + 1] else tree[2 * at + 1]
                if tree[at] == new:
                    break
                tree[at] = new
    return np.array([t for t in token if t >= 0], dtype="<u4").tobytes()


def _merge_rows(vocabulary: Vocabulary, pieces: list[bytes], chosen: np.ndarray, width: int, out: list[bytes]) -> None:
    """Merge pieces of at most `width` bytes, one row each. `width` is a power of two; leaf i of the tree is at width + i."""
    n = len(chosen)
    raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in chosen), dtype=np.uint8).reshape(n, width)
    size = np.array([len(pieces[i]) for i in chosen], dtype=np.int64)
    token = vocabulary.byte_ids[raw]
    after = np.where(np.arange(1, width + 1) < size[:, None], np.arange(1, width + 1), -1)
    ahead = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
    alive = np.arange(width) < size[:, None]
    tree = np.full((n, 2 * width), NO_MERGE, dtype=np.int64)
    place, known = vocabulary.find(token[:, :-1], token[:, 1:])
    known &= alive[:, 1:]
    tree[:, width : 2 * width - 1] = np.where(known, vocabulary.rank[place] << PLACE_BITS | np.arange(width - 1), NO_MERGE)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

    rows = np.flatnonzero(tree[:, 1] != NO_MERGE)
    low = (1 << PLACE_BITS) - 1
    while len(rows):
        i = tree[rows, 1] & low
        j = after[rows, i]
        place, _ = vocabulary.find(token[rows, i], token[rows, j])
        token[rows, i] = vocabulary.made[place]
        alive[rows, j] = False
        k = after[rows, j]
        after[rows, i] = k
        more = k >= 0
        ahead[rows[more], k[more]] = i[more]
        h = ahead[rows, i]
        tree[rows, width + j] = NO_MERGE
        tree[rows, width + i] = _pair_value(vocabulary, token, rows, i, k)
        has = h >= 0
        tree[rows[has], width + h[has]] = _pair_value(vocabulary, token, rows[has], h[has], i[has])
        for r, leaf in ((rows, width + j), (rows, width + i), (rows[has], width + h[has])):
            while len(r) and leaf[0] > 1:
                leaf = leaf >> 1
                tree[r, leaf] = np.minimum(tree[r, 2 * leaf], tree[r, 2 * leaf + 1])
        rows = rows[tree[rows, 1] != NO_MERGE]
    flat, counts = token[alive].astype("<u4").tobytes(), alive.sum(axis=1)
    ends = np.cumsum(counts) * 4
    for r, i in enumerate(chosen.tolist()):
        out[i] = flat[ends[r] - counts[r] * 4 : ends[r]]


def _pair_value(vocabulary: Vocabulary, token: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    place, known = vocabulary.find(token[rows, left], token[rows, np.maximum(right, 0)])
    return np.where(known & (right >= 0), vocabulary.rank[place] << PLACE_BITS | left, NO_MERGE)


class Coder:
    """Encoder and decoder of one task; remembers the ids of pieces it has met, up to KNOWN_PIECES, and then starts afresh."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.split = regex.compile(PIECES)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        known, special, cut = self.known, self.vocabulary.special, self.vocabulary.special_split
        texts_parts = [[t] if not cut or not any(s in t for s in special) else cut.split(t) for t in texts]
        pieces = [[p for part in parts for p in ([part] if part in special else self.split.findall(part))] for parts in texts_parts]
        new = list({p for own in pieces for p in own if p not in known and p not in special})
        known.update(zip(new, merge_pieces(self.vocabulary, [p.encode() for p in new])))
        known.update((s, np.array([i], dtype="<u4").tobytes()) for s, i in special.items())
        out = [b"".join(map(known.__getitem__, own)) for own in pieces]
        for p in new:
            if len(p) > KNOWN_PIECE:
                del known[p]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[list[str]]:
    """Texts in lists of at most about `most` characters, a longer text by itself."""
    held, n = [], 0
    for t in column:
        value = t.as_py()
        if held and n + len(value) > most:
            yield held
            held, n = [], 0
        held.append(value)
        n += len(value)
    if held:
        yield held


def encoded(docs: DataFrame, vocabulary_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append `out`, the text's token ids, to every row; a null text counts as empty and has no ids.

    The text of a special token becomes its id. `vocabulary_path` is read by the driver only. An existing column named `out` is replaced.
    """
    return _mapped(docs, vocabulary_path, text, [(out, "array<int>")], lambda coder, ids, texts, _: (np.frombuffer(i, dtype="<u4").astype(np.int32) for i in ids))


def round_trip(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Replace `text` by n_tokens, ids, and round_trip: whether decoding the ids gives the text back (null counts as empty).

    Encoder, decoder and comparison are one step over one copy of the text. Texts may be of any length; a row that repeats another gets
    the same values; an empty table stays empty. Other columns go along; those named like one of the three are replaced.
    """
    def rows(coder: Coder, ids: list[bytes], texts: list[str], what: str):
        if what == "round_trip":
            return (coder.decode(i) == t for i, t in zip(ids, texts))
        return (len(i) // 4 for i in ids) if what == "n_tokens" else (np.frombuffer(i, dtype="<u4").astype(np.int32) for i in ids)

    return _mapped(docs, vocabulary_path, text, [("n_tokens", "bigint"), ("ids", "array<int>"), ("round_trip", "boolean")], rows, drop=[text])


def decoded(docs: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the text of `ids`; null ids have a null text, unknown ids fail."""
    vocabulary, kept = _broadcast(docs.sparkSession, vocabulary_path), [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        for batch in batches:
            texts = [None if v.as_py() is None else coder.decode(np.array(v.as_py(), dtype="<u4").tobytes()) for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in kept)).schema) + f", `{out}` string"
    return map_batches(docs, run, schema)


def digests(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256 to every row: what was encoded, and what decoding it gives.

    A null text counts as empty: no tokens, and the digests of nothing. Texts and their unbroken runs may be of any length. Rows that
    repeat others get equal values; an empty table stays empty. Other columns go along; those named like one of the three are replaced.
    """
    def rows(coder: Coder, ids: list[bytes], texts: list[str], what: str):
        if what == "n_tokens":
            return (len(i) // 4 for i in ids)
        return (hashlib.sha256(i if what == "ids_sha256" else coder.decode(i).encode()).hexdigest() for i in ids)

    return _mapped(docs, vocabulary_path, text, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], rows)


def _broadcast(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(Vocabulary(f.read()))


def _mapped(docs: DataFrame, path: str, text: str, made: list[tuple[str, str]], values, drop: list[str] | None = None) -> DataFrame:
    vocabulary, names = _broadcast(docs.sparkSession, path), [n for n, _ in made]
    kept = [f for f in docs.schema.fields if f.name not in (*names, *(drop or []))]
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        for batch in batches:
            cells: dict[str, list] = {n: [] for n in names}
            for texts in slices(batch.column("__text")):
                ids = coder.encode_batch(texts)
                for n in names:
                    cells[n].extend(values(coder, ids, texts, n))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *(pa.array(cells[n], types[t]) for n, t in made)], [*(f.name for f in kept), *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` {t}" for n, t in made)])
    return map_batches(docs.select(*(F.col(f"`{f.name}`") for f in kept), whole_text(f"`{text}`").alias("__text")), run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir).select("doc_id", "text"), default_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
