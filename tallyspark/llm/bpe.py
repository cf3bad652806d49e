"""Operator 7: byte-level BPE encoding and decoding.

A piece of text (the pre-tokenizer's split) starts as one symbol per byte. A
segment tree stands over its adjacent pairs; a leaf holds the pair's merge rank
and its place in one integer, an inner node the smaller of its children, so the
root is the leftmost pair of the lowest rank. A merge changes three leaves, each
in logarithmic time, until the root says that no pair can be merged.

Vocabulary, merges, the split pattern's kind and the special tokens are read
from a tokenizer file whose path is a parameter; nothing of it is kept here.
Each worker keeps the ids of short pieces as packed bytes, in two generations of
up to ``cache`` pieces: a full one takes the older one's place.
Encoding and decoding are one narrow pass.

Defined cases: a null text is empty; an empty text has no tokens and decodes to
the empty string; the text of a special token becomes that token; repeated rows
give repeated rows; columns named like a result column are replaced. Bytes that
are no UTF-8 decode to U+FFFD, as the library does.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache
from operator import itemgetter

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_batches, table

#: Pieces a generation keeps unless its caller says otherwise; pieces of more bytes than this are encoded but not kept.
CACHE_PIECES, CACHE_BYTES = 300_000, 64
NONE = 1 << 62
PLACE = 32
# fixed value: the split of byte-level pre-tokenizers with use_regex
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str, cache: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model["type"] != "BPE" or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.start = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache = CACHE_PIECES if cache is None else cache

    def merge(self, ids: list[int]) -> list[int]:
        """Merge a piece's symbols with a segment tree over its adjacent pairs."""
        n = len(ids)
        if n < 2:
            return ids
        get = self.merges.get
        width = 1
        while width < n - 1:
            width *= 2
        tree = [NONE] * (2 * width)
        made = [0] * n
        for i in range(n - 1):
            found = get((ids[i], ids[i + 1]))
            if found:
                tree[width + i] = found[0] << PLACE | i
                made[i] = found[1]
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        while (root := tree[1]) != NONE:
            i = root & ((1 << PLACE) - 1)
            j = after[i]
            ids[i] = made[i]
            ids[j] = -1
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
            # the pairs that begin at j, at i and at the symbol before i change
            for k, right in ((j, n), (i, nxt), (before[i], i)):
                if k < 0 or k == n - 1:
                    continue
                value = NONE
                if right < n and (found := get((ids[k], ids[right]))):
                    made[k] = found[1]
                    value = found[0] << PLACE | k
                k += width
                if tree[k] == value:
                    continue
                tree[k] = value
                while k > 1:
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        """A piece's ids as packed little-endian 32-bit integers."""
        packed = self.older.get(text)
        if packed is None:
            raw = text.encode("utf-8", "surrogatepass")
            packed = array("I", self.merge(list(map(self.start.__getitem__, raw)))).tobytes()
            if len(raw) > CACHE_BYTES:
                return packed
        if len(self.kept) >= self.cache:
            self.kept, self.older = {}, self.kept
        self.kept[text] = packed
        return packed

    def _plain(self, text: str, out: list[bytes]) -> None:
        new = self.piece
        out.extend([self.kept.get(p) or new(p) for p in self.split.findall(text)])

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        if self.marks is None or not any(s in text for s in self.special):
            self._plain(text, out)
        else:
            for part in self.marks.split(text):
                if part in self.special:
                    out.append(self.special[part].to_bytes(4, "little"))
                elif part:
                    self._plain(part, out)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Bytes of the known ids, read as UTF-8; ids outside the vocabulary are skipped."""
        try:
            parts = itemgetter(*ids)(self.bytes_of) if ids else ()
        except KeyError:
            parts = [self.bytes_of[i] for i in ids if i in self.bytes_of]
        return (parts if isinstance(parts, bytes) else b"".join(parts)).decode("utf-8", "replace")


@lru_cache(4)
def load(path: str, cache: int | None = None) -> Bpe:
    return Bpe(path, cache)


def unpack(packed: bytes) -> list[int]:
    out = array("I")
    out.frombytes(packed)
    return out.tolist()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with token_ids."""
    path = path or default_path()

    @F.pandas_udf("array<long>")
    def ids(text: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([unpack(bpe.encode(t if isinstance(t, str) else "")) for t in text])

    return bounded_batches(docs).withColumn("token_ids", ids("text"))


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (with token_ids) with decoded; a null list decodes to the empty string."""
    path = path or default_path()

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([bpe.decode([] if x is None else list(map(int, x))) for x in ids], dtype=object)

    return bounded_batches(docs).withColumn("decoded", texts("token_ids"))


def digests(docs: DataFrame, path: str | None = None, cache: int | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass.

    A smaller ``cache`` takes less of a worker's memory and more of its time.
    """
    path = path or default_path()

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def both(text: pd.Series) -> pd.DataFrame:
        bpe = load(path, cache)
        rows = []
        for t in text:
            packed = bpe.encode(t if isinstance(t, str) else "")
            decoded = bpe.decode(unpack(packed))
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    kept = [F.col(c) for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return bounded_batches(docs).select(*kept, both("text").alias("__b")).select(*kept, "__b.n_tokens", "__b.ids_sha256", "__b.decoded_sha256")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
