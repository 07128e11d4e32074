"""Byte-level BPE encoding and decoding over overlapping chunks.

``encode`` gives one row per document: ``doc_id`` and its token ``ids``, as encoding the whole text
at once would give.  A text of at most ``chunk`` characters is one piece.  A longer text is cut into
chunks of that length, each with ``overlap`` further characters of the text after it, and the chunks
are dealt over the cluster:

1. Each chunk is pre-tokenised on its own.  A pre-token counts as known only if two further
   characters were in sight, the farthest that the pattern looks ahead.
2. Neighbours are stitched: the first *firm* boundary in the overlap that both found is where they
   resynchronise.  From a common boundary on, the pattern finds the same pre-tokens in both.  A boundary is firm if a piece
   that ends there has the same pre-tokens as in the whole text, under any edition of Unicode: no white space stands before it (at
   the end of a piece the pattern would take a run of that whole), and either white space follows, or two characters of
   different classes meet that have been in Unicode since version 3.2 (later letters are unknown to some libraries).
3. The pieces between those points are encoded in parallel, and the ids joined in order.

Where two neighbours never agree firmly within the overlap (a run of letters longer than it, say), the
document is encoded in one piece, so the result is exact for every text.

``decode`` concatenates the bytes of the ids.

Cases: null and empty texts give no ids; repeated ``doc_id`` and null ``doc_id`` as in ``common``;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import documents, partitions, steps, table

CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Characters that the pattern may need to see after a pre-token to end it there.
AHEAD = 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Vocabulary:
    """Ranks and pattern, sent to the executors once; what is built from them is built once per worker."""

    _built: dict[str, tuple] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.pattern = pattern
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))
        self.name = f"{path} {hashlib.sha256(pattern.encode()).hexdigest()}"

    def _own(self) -> tuple:
        if self.name not in self._built:
            import regex
            import tiktoken

            ranks = self.ranks.value
            encoding = tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            self._built[self.name] = encoding.encode_ordinary, regex.compile(self.pattern), {i: t for t, i in ranks.items()}
        return self._built[self.name]

    def encode(self, piece: str) -> list[int]:
        return self._own()[0](piece)

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in self._own()[1].finditer(text)]

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self._own()[2].__getitem__, ids))


def character_class(c: str) -> str:
    """White space, a letter, a number, or any other; empty if libraries may disagree."""
    if c.isspace() and not "\x1c" <= c <= "\x1f":
        return "space"
    kind = unicodedata.ucd_3_2_0.category(c)
    return "" if kind == "Cn" else kind[0] if kind[0] in "LN" else "other"


def firm(text: str, at: int) -> bool:
    """Whether a pre-token that ends at ``at`` ends there for certain, and also if the text does."""
    before, after = character_class(text[at - 1]), character_class(text[at])
    if before == "space":
        return False
    return after == "space" or (before != after and "" not in (before, after) and text[at - 1] != "'")  # an apostrophe may begin "'s"


def chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``doc_id, k, at, text``: chunk k starts at character ``at``; its text ends in the overlap."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = range(0, max(1, len(text) - overlap), chunk)  # the last one reaches the end
                yield pa.RecordBatch.from_pydict({"doc_id": [doc_id] * len(at), "k": list(range(len(at))), "at": list(at), "text": [text[i : i + chunk + overlap] for i in at]}, SCHEMA)

    SCHEMA = pa.schema({"doc_id": pa.int64(), "k": pa.int32(), "at": pa.int64(), "text": pa.string()})
    return long.mapInArrow(cut, "doc_id long, k int, at long, text string")


def boundaries(cut: DataFrame, vocabulary: Vocabulary, chunk: int, overlap: int) -> DataFrame:
    """``doc_id, k, at, upto, head, tail``: the chunk's extent and the boundaries known in its first
    ``overlap`` characters and in those beyond ``chunk``, as positions in the document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            upto, head, tail = [], [], []
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ends = [0, *(e for e in vocabulary.ends(text) if e + AHEAD <= len(text))]
                upto.append(at + len(text))
                head.append([at + e for e in ends if e <= overlap and (not e or firm(text, e))])
                tail.append([at + e for e in ends if e >= chunk and firm(text, e)])
            kept = [batch.column(c) for c in ("doc_id", "k", "at")]
            found = [pa.array(upto, pa.int64()), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=["doc_id", "k", "at", "upto", "head", "tail"])

    return cut.mapInArrow(find, "doc_id long, k int, at long, upto long, head array<long>, tail array<long>")


def stitched(found: DataFrame) -> DataFrame:
    """``doc_id, k, start, upto, exact``: the piece of each chunk, between the points where it
    resynchronises with its neighbours; ``exact`` is false if some neighbours of the document don't."""
    in_order = Window.partitionBy("doc_id").orderBy("k")
    shared = F.array_min(F.array_intersect(F.lag("tail").over(in_order), "head"))
    found = found.withColumn("start", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(shared))
    lost = F.max(F.col("start").isNull()).over(Window.partitionBy("doc_id"))
    return found.select("doc_id", "k", "start", F.coalesce(F.lead("start").over(in_order), "upto").alias("upto"), (~lost).alias("exact"))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id long, ids array<int>`` for every document."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(spark, path, pattern)
    docs = documents(docs)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids = [vocabulary.encode(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("start", "upto", "at", "text")), strict=True)
            ids = [vocabulary.encode(text[start - at : upto - at]) for start, upto, at, text in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "k", "ids"])

    short = docs.where(F.length("text") <= chunk).mapInArrow(whole, "doc_id long, ids array<int>")
    long = docs.where(F.length("text") > chunk)
    dealt = chunks(long, chunk, overlap).repartition(partitions(spark), "doc_id", "k")
    cuts = stitched(boundaries(dealt, vocabulary, chunk, overlap))
    joined = (
        dealt.join(cuts.where("exact"), ["doc_id", "k"])
        .select("doc_id", "k", "start", "upto", "at", "text")
        .mapInArrow(piece, "doc_id long, k int, ids array<int>")
        .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .select("doc_id", F.flatten("parts.ids").alias("ids"))
    )
    apart = cuts.where(~F.col("exact")).select("doc_id").distinct()
    rest = long.join(apart, "doc_id", "left_semi").mapInArrow(whole, "doc_id long, ids array<int>")
    return short.unionByName(joined).unionByName(rest)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``bytes``, the concatenated bytes of ``ids``; null ids decode to no bytes."""
    vocabulary = Vocabulary(encoded.sparkSession, path, pattern)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = [vocabulary.bytes_of(ids or ()) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, ids array<int>, bytes binary")


def digest(decoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 of the ids, written in decimal and joined by commas, and of the bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digest(decode(encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern))
