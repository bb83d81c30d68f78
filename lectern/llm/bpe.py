"""Byte-level BPE encoding and decoding by tree concatenation.

A text of more than `leaf` characters is cut into halves down to leaves, wherever the cuts fall. Leaves are encoded in
parallel, and neighbours are joined bottom up: a window around each join is encoded anew and grown until both sides
agree with it. Agreement is exact. Outside of long pre-tokens it holds where the pre-tokenizer splits the text whatever
else it holds; inside one, a token sequence is BPE's own encoding of its bytes if and only if each adjacent pair encodes
to itself, so the pairs at the window's ends decide. Special tokens split a text before all that.

Nulls and empty texts give no tokens. Special tokens written out in a text become their ids, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import cut
from lectern.plans.stage import small_batches

#: Fixed value: the public pre-tokenizer pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 2048
#: Characters on either side of a cut that a window starts with; characters that the pre-tokenizer looks ahead.
WINDOW, LOOK = 32, 2
BLANKS = " \t\n\r\x0b\x0c"
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")  # of ASCII, without the apostrophe, which may begin a contraction


def splits(text: str, at: int) -> bool:
    """Whether the pre-tokenizer splits text before `at`, whatever stands further off.

    No pre-token goes on from a letter or digit to a blank or a mark, nor from a mark to a blank.
    """
    before, here = text[at - 1], text[at]
    return (here in BLANKS or here in MARKS) and (before.isalnum() and before.isascii() or before.isalpha() or here in BLANKS and before in MARKS)


def one_class(text: str) -> bool:
    """All letters, all ASCII digits, all blanks or all marks: the inside of one pre-token."""
    return text.isalpha() or (text.isascii() and (text.isdigit() or not text.strip(BLANKS) or MARKS.issuperset(text)))


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteBPE:
    def __init__(self, path: str, leaf: int = LEAF, threads: int = 2):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.leaf, self.threads = max(2, leaf), threads
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special_ids = special
        self.names = [str(i) for i in range(self.core.n_vocab)]
        self.size = [0] * self.core.n_vocab
        for token, i in ranks.items():
            self.size[i] = len(token)
        self._pool: ThreadPoolExecutor | None = None

    @property
    def pool(self) -> ThreadPoolExecutor:
        if self._pool is None:
            self._pool = ThreadPoolExecutor(self.threads)
        return self._pool

    def piece(self, data: bytes) -> list[int]:
        return self.core._encode_single_piece(data)

    def pair_holds(self, a: int, b: int) -> bool:
        return self.piece(self.core.decode_bytes([a, b])) == [a, b]

    def back(self, left: list[int], n: int) -> int | None:
        """Where the last n bytes of left begin, if a token begins there."""
        at = len(left)
        while n > 0:
            at -= 1
            n -= self.size[left[at]]
        return at if n == 0 else None

    def ahead(self, right: list[int], n: int) -> int | None:
        """Where the first n bytes of right end, if a token ends there."""
        at = 0
        while n > 0:
            n -= self.size[right[at]]
            at += 1
        return at if n == 0 else None

    def inside(self, left: list[int], right: list[int], most_left: int, most_right: int) -> list[int] | None:
        """The join of two sides of one pre-token: a window of tokens around it, grown until the pairs at both of its
        ends hold. It stays within the given bytes on either side, all of that pre-token; None if it would leave them."""
        width = 1
        while width < min(len(left), len(right)):
            a, b = len(left) - width, width
            if sum(self.size[i] for i in left[a - 1 :]) > most_left or sum(self.size[i] for i in right[: b + 1]) > most_right:
                return None
            mid = self.piece(self.core.decode_bytes(left[a:] + right[:b]))
            if self.pair_holds(left[a - 1], mid[0]) and self.pair_holds(mid[-1], right[b]):
                return left[:a] + mid + right[b:]
            width *= 2
        return None

    def join(self, text: str, lo: int, cut: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[lo:hi] from those of text[lo:cut] and text[cut:hi].

        A window of text around the cut is encoded anew between the nearest places on both sides where the
        pre-tokenizer splits whatever else the text holds; there both sides agree with the whole. Without such places
        the window grows, to the ends of both sides at most. Within one long pre-token, where there are none, tokens
        decide: a sequence of them is BPE's own if each adjacent pair encodes to itself.
        """
        width = WINDOW
        while True:
            a, b = max(lo, cut - width), min(hi, cut + width)
            i = next((k for k in range(cut, a, -1) if splits(text, k)), lo if a == lo else None)
            j = next((k for k in range(cut, b) if splits(text, k)), hi if b == hi else None)
            if i is not None and j is not None:
                x, y = self.back(left, len(text[i:cut].encode())), self.ahead(right, len(text[cut:j].encode()))
                if x is not None and y is not None:
                    return left[:x] + self.core.encode_ordinary(text[i:j]) + right[y:]
            elif a - LOOK > lo and b + LOOK < hi and one_class(text[a - LOOK : b + LOOK]):
                found = self.inside(left, right, len(text[a:cut].encode()), len(text[cut:b].encode()))
                if found is not None:
                    return found
            if a == lo and b == hi:
                return self.core.encode_ordinary(text[lo:hi])
            width *= 2

    def tree(self, text: str) -> list[int]:
        """A text without special tokens: halved down to leaves, which are encoded in parallel, and joined up the tree."""
        cuts = [0, len(text)]
        while cuts[1] > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in pairwise(cuts))})
        level = list(self.pool.map(lambda r: self.core.encode_ordinary(text[r[0] : r[1]]), pairwise(cuts)))
        while len(level) > 1:
            joined = [self.join(text, cuts[k], cuts[k + 1], cuts[k + 2], level[k], level[k + 1]) for k in range(0, len(level) - 1, 2)]
            odd = len(level) % 2
            level = joined + level[-1:] * odd
            cuts = cuts[::2] + cuts[-1:] * odd
        return level[0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf:
            return self.core.encode(text, allowed_special="all", disallowed_special=())
        parts = self.special.split(text) if self.special else [text]
        return [i for p in parts if p for i in ([self.special_ids[p]] if p in self.special_ids else self.tree(p))]

    def decode(self, ids: list[int]) -> str:
        return self.core.decode_bytes(ids).decode("utf-8", errors="replace")

    def listed(self, ids: list[int]) -> str:
        names = self.names
        return ",".join([names[i] for i in ids])


OUTPUTS = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


@lru_cache(maxsize=4)
def tokenizer(path: str, leaf: int = LEAF) -> ByteBPE:
    return ByteBPE(path, leaf)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), leaf: int = LEAF, ids: bool = True, byte_budget: int = 1 << 20) -> DataFrame:
    """Columns `keep` with n_tokens, ids_sha256, decoded_sha256, and with `ids` the token ids themselves.

    One narrow pass without a shuffle. A column to keep that is named like a result gives way to it. Null and empty texts give no tokens; repeated rows give repeated results;
    other columns of docs are not read.
    """
    where = path or default_vocabulary()
    small_batches(docs.sparkSession)
    keep = tuple(c for c in keep if c not in OUTPUTS)
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    extra = ", token_ids array<int>" if ids else ""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = f"{fields}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(where, leaf)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in cut(batch, "__text", byte_budget):
                tokens = [bpe.encode(t) for t in part.column("__text").to_pylist()]
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                cols += [
                    pa.array(map(len, tokens), pa.int64()),
                    pa.array([sha(bpe.listed(t).encode()) for t in tokens], pa.string()),
                    pa.array([sha(bpe.decode(t).encode()) for t in tokens], pa.string()),
                ]
                if ids:
                    cols.append(pa.array(tokens, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids])

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """`encoded` with the text of its token ids; null ids give null."""
    where = path or default_vocabulary()

    @F.pandas_udf("string")
    def text_of(col):  # noqa: ANN001, ANN202
        bpe = tokenizer(where)
        return col.map(lambda x: None if x is None else bpe.decode([int(i) for i in x]))

    return encoded.withColumn(out, text_of(F.col(ids)))


def op9_bpe_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, ids=False)
