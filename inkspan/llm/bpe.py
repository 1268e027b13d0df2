"""Byte-pair encoding and decoding of whole texts, by tree concatenation.

A text is cut in halves down to leaves, the leaves are encoded independently (leaves of long
documents in different tasks), and neighbours are joined pairwise: the tokens around a join are
encoded anew in a growing window until its outer tokens agree exactly with both sides.

Two kinds of join keep the result equal to encoding the whole text:

* between halves of a *text*, a window side has grown far enough when it ends where a visible ASCII
  character is followed by white space; the pre-tokeniser always cuts there, whatever stands around;
* between halves of one long *unsplit run* (a pre-token), when the window's first token is the left
  side's token and its last token is the right side's token: every neighbouring pair of tokens then
  comes from one correct encoding, and such a sequence is the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.words import column

PIECE_LEAF = 256  # bytes of an unsplit run encoded at once
TEXT_LEAF = 1 << 16  # characters of a document encoded in one task
CACHE = 100_000  # pre-tokens remembered per task; forgotten all at once when full
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_vocabulary(path):
    """(token bytes -> id, special string -> id) of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return ranks, special


class Codec:
    def __init__(self, vocabulary, piece_leaf=PIECE_LEAF):
        import regex
        import tiktoken

        ranks, self.special = vocabulary
        self.core = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN).findall
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.leaf, self.known = max(2, piece_leaf), {}

    def encode_run(self, raw: bytes) -> list[int]:
        """Tokens of one unsplit run."""
        if len(raw) <= self.leaf:
            return self.core._encode_single_piece(raw)
        level = [self.core._encode_single_piece(raw[i : i + self.leaf]) for i in range(0, len(raw), self.leaf)]
        while len(level) > 1:
            level = [self.join_runs(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join_runs(self, left, right):
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            window = self.core._encode_single_piece(self.raw(a) + self.raw(b))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def encode(self, text: str) -> list[int]:
        out, known, special = [], self.known, self.special
        for part in self.cut(text) if self.cut and any(s in text for s in special) else (text,):
            if part in special:
                out.append(special[part])
                continue
            for p in self.pieces(part):
                ids = known.get(p)
                if ids is None:
                    ids = self.encode_run(p.encode())
                    if len(known) >= CACHE:
                        known.clear()
                    if len(p) <= 64:
                        known[p] = ids
                out += ids
        return out

    def raw(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.raw(ids).decode("utf-8", "replace")

    def join_texts(self, left, right):
        """Tokens of a text from those of its halves."""
        k = 8
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            a = next((i for i in range(len(left) - 1, a, -1) if self._always_cut(left[i - 1], left[i])), 0 if a == 0 else -1)
            b = next((i for i in range(1, b) if self._always_cut(right[i - 1], right[i])), len(right) if b == len(right) else -1)
            if a >= 0 and b >= 0:
                return left[:a] + self.encode((self.raw(left[a:]) + self.raw(right[:b])).decode()) + right[b:]
            k *= 2

    def _always_cut(self, before, after):
        return 0x21 <= self.bytes_of[before][-1] <= 0x7E and self.bytes_of[after][0] in b" \t\n\r"

    def join_all(self, level):
        while len(level) > 1:
            level = [self.join_texts(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []


def _digest(codec, doc_ids, all_ids):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = list(all_ids)
    return pa.RecordBatch.from_arrays(
        [
            doc_ids, pa.array([len(i) for i in ids], pa.int64()), pa.array([sha(",".join(map(str, i))) for i in ids], pa.string()),
            pa.array([sha(codec.decode(i)) for i in ids], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _tokens(codec, doc_ids, all_ids):
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(list(all_ids), pa.list_(pa.int32()))], ["doc_id", "ids"])


def _encoded(docs, path, schema, finish, text_leaf, piece_leaf):
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(load_vocabulary(path))
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches):
        codec = Codec(sent.value, piece_leaf)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield finish(codec, column(part, "doc_id"), map(codec.encode, (t.as_py() for t in column(part, "text"))))

    def leaves(batches):
        codec = Codec(sent.value, piece_leaf)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids = [codec.encode(t.as_py()) for t in column(part, "piece")]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "row"), column(part, "at"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "row", "at", "ids"])

    def joined(table):
        codec = Codec(sent.value, piece_leaf)
        rows = table.sort_by("at")
        ids = codec.join_all([x.as_py() for x in rows.column("ids")])
        return pa.Table.from_batches([finish(codec, rows.column("doc_id").combine_chunks().slice(0, 1), [ids])])

    long = F.length("text") > text_leaf
    cuts = F.transform(F.sequence(F.lit(0), ((F.length("text") - 1) / text_leaf).cast("int")), lambda i: F.struct(i.alias("at"), F.substring("text", i * text_leaf + 1, F.lit(text_leaf)).alias("piece")))
    parts = docs.where(long).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.explode(cuts).alias("c")).select("doc_id", "row", "c.at", "c.piece")
    parts = parts.repartition("row", "at").mapInArrow(leaves, "doc_id bigint, row bigint, at int, ids array<int>")
    return docs.where(~long).mapInArrow(short, schema).unionByName(parts.groupBy("row").applyInArrow(joined, schema))


def encode(docs: DataFrame, path, text_leaf=TEXT_LEAF, piece_leaf=PIECE_LEAF) -> DataFrame:
    """(doc_id, ids array<int>) for every row; null and empty texts have no ids, repeated rows stay."""
    return _encoded(docs, path, "doc_id bigint, ids array<int>", _tokens, text_leaf, piece_leaf)


def decode(encoded: DataFrame, path) -> DataFrame:
    """(doc_id, text) from ids; special tokens are written out, broken UTF-8 becomes U+FFFD, null ids an empty text."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        codec = Codec(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [codec.decode(x.as_py() or []) for x in column(part, "ids")]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")


def tokenise(docs: DataFrame, path, text_leaf=TEXT_LEAF, piece_leaf=PIECE_LEAF) -> DataFrame:
    """``encode`` and ``round_trip`` in one pass: the ids beside their number and digests."""
    def both(codec, doc_ids, all_ids):
        ids = list(all_ids)
        d = _digest(codec, doc_ids, ids)
        return pa.RecordBatch.from_arrays([*d.columns, pa.array(ids, pa.list_(pa.int32()))], [*d.schema.names, "ids"])

    return _encoded(docs, path, DIGEST + ", ids array<int>", both, text_leaf, piece_leaf)


def round_trip(docs: DataFrame, path, text_leaf=TEXT_LEAF, piece_leaf=PIECE_LEAF) -> DataFrame:
    """Per row the number of tokens, a digest of the ids and one of the text decoded from them."""
    return _encoded(docs, path, DIGEST, _digest, text_leaf, piece_leaf)
