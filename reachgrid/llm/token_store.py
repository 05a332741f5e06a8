"""Token ids of documents in ORC files.

The files hold one row per document in ascending doc_id. ORC writes the ids as
run-length encoded integers, keeps statistics of every stripe and row group,
and here also Bloom filters on doc_id, so that a reader takes stripes in
parallel and skips those that cannot hold a document it looks for.
"""

from __future__ import annotations

import json
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reachgrid.llm.texts import text_key
from reachgrid.llm.words import LOWER, SAME, U, bytes_of, slices, words_of

#: Bytes of text whose pieces are looked up together.
LOOKUP = 1 << 22
#: Pieces that a worker remembers.
REMEMBERED = 700_000
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
WRITE = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}

SPACES = np.isin(np.arange(256), [0x20, 0x0A])
#: Kind 1: ASCII letters and digits. Kind 2: ASCII punctuation, but for apostrophes, which start
#: contractions, and for the signs of special tokens. A tokenizer that splits letters from
#: punctuation always splits between the two kinds.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[b for b in range(0x21, 0x7F) if chr(b).isalnum()]] = 1
KINDS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = 2


#: The normaliser and the pre-tokeniser for which texts may be encoded piece by piece.
LOWER_CASING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Pieces that are put into one text to be encoded.
JOINED = 500
#: Characters below this are single letters, and stay so in lower case, but for one.
LATIN, DOTTED = "\u0250", "\u0130"


def by_pieces(path: str) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and splits letters from punctuation, so that pieces give its ids."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    normalizer, splitter, model = (given.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = splitter.get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": SPLITTING}, "behavior": "Removed", "invert": True}
    return (
        normalizer.get("normalizers") == LOWER_CASING
        and steps[0] == split
        and [s.get("type") for s in steps[1:]] == ["ByteLevel"]
        and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")
    )


class TextEncoder:
    """Encodes each text as a whole, for any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by row) of consecutive texts."""
        texts = [raw[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(ends[-1])), ends


class PieceEncoder(TextEncoder):
    """Encodes texts piece by piece, each distinct piece once.

    For tokenizers that lower-case, drop white space and never join letters or
    digits with punctuation, the ids of a text are those of its pieces in order.
    A slice of texts with the start of a special token is cut at spaces alone
    and keeps its case. Pieces are known by 64-bit hashes, in rising order.
    """

    def __init__(self, path: str):
        super().__init__(path)
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=U)
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.pool = np.zeros(0, dtype=np.int32)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of texts that are one word each: their last id closes a word."""
        parts = [self.tokenizer.encode(" ".join(texts[i : i + JOINED]), add_special_tokens=False).ids for i in range(0, len(texts), JOINED)]
        ids = np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=sum(map(len, parts)))
        ends = np.flatnonzero(self.closes[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Add pieces that are not known; *hashes* rise."""
        plain = np.fromiter((t.isalpha() and max(t) < LATIN and DOTTED not in t for t in texts), dtype=bool, count=len(texts))
        words, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, size = self._words([texts[i] for i in words])
        found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)]
        rest = np.fromiter((len(x) for x in found), dtype=np.int64, count=len(found))
        sizes = np.empty(len(texts), dtype=np.int64)
        sizes[words], sizes[others] = size, rest
        begin = np.empty(len(texts), dtype=np.int64)
        begin[words] = len(self.pool) + np.cumsum(size) - size
        begin[others] = len(self.pool) + len(ids) + np.cumsum(rest) - rest
        more = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(rest.sum()))
        self.pool = np.concatenate([self.pool, ids, more])
        at = np.searchsorted(self.known, hashes)
        self.known, self.begin, self.size = (np.insert(a, at, b) for a, b in ((self.known, hashes), (self.begin, begin), (self.size, sizes)))

    def __call__(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = b"<|" not in raw[bounds[0] : bounds[-1]].tobytes()
        fold, kinds = (LOWER, KINDS) if plain else (SAME, None)
        words = words_of(raw, bounds, SPACES, fold, kinds)
        if len(self.known) > REMEMBERED:
            self.clear()
        distinct, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            data = fold[words.raw].tobytes()
            self._learn(distinct[new], [data[a:b].decode() for a, b in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist())])
            at = np.searchsorted(self.known, distinct)
        begin, size = self.begin[at][which], self.size[at][which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return ids, total[words.first]


_encoders: dict[str, TextEncoder] = {}


def encoder_of(path: str) -> TextEncoder:
    """The encoder of a tokenizer file; a worker makes it once."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path) if by_pieces(path) else TextEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """SCHEMA rows in ascending doc_id (nulls last, then text hash), sorted in range partitions.

    start_in_part counts ids of earlier rows of the part. *tokenizer* is a path
    that every executor can open.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("_k1").asc(), F.col("_k2").asc()]
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")))
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("text", "doc_id")

    def encoded(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, so_far = TaskContext.get().partitionId(), 0
        encoder = encoder_of(tokenizer)
        for batch in batches:
            raw, bounds = bytes_of(batch.column(0))
            for i, j in slices(bounds, LOOKUP):
                ids, ends = encoder(raw, bounds[i : j + 1])
                n = np.diff(ends)
                # The end id goes behind the ids of each row.
                whole = np.insert(ids, ends[1:], end_id).astype(np.int32)
                cuts = np.concatenate([[0], np.cumsum(n + 1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(i, j - i),
                        pa.array(np.full(j - i, part, dtype=np.int32)),
                        pa.array(so_far + cuts[:-1]),
                        pa.array(n + 1),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(whole)),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                so_far += int(cuts[-1])

    return ranged.mapInArrow(encoded, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every whole text of *docs* (doc_id, text) and write the ids to ORC files in *path*.

    A null or empty text has the end id alone. A null doc_id sorts last; repeated
    rows each have a row. Other columns are ignored; no rows give empty files.
    Special tokens that occur in a text are encoded as the tokenizer does it.
    """
    encode(docs, tokenizer, end_id).write.mode("errorifexists").options(**WRITE).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; start counts the ids of all earlier documents.

    Stripes are read in parallel. A filter on doc_id reaches the files and skips
    stripes and row groups by their statistics and Bloom filters.
    """
    stored = spark.read.schema(SCHEMA).orc(path)
    ends = stored.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    # One row for each task that wrote.
    return stored.join(F.broadcast(bases), "part").select("doc_id", (F.col("start_in_part") + F.col("_base")).alias("start"), "n_tokens", "ids")


def ids_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents; files prune by statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(values: pa.Array) -> pa.Array:
        flat, ends = values.values.to_numpy(zero_copy_only=False).astype("<u4"), values.offsets.to_numpy()
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    return crc(ids)
