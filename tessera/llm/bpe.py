"""Byte-level BPE through sentencepiece: encode to token ids and decode back to bytes.

A rank file becomes a sentencepiece BPE model directly: every token is a piece whose bytes are
written as one printable character each, scored by its negative rank, with identity
normalisation.  Texts are split into pre-tokens by the tokenizer's pattern; each distinct
pre-token is encoded once per task (the cache is bounded).  A pre-token that is itself a token
takes that token's rank at once, as rank-based byte BPE does.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, pack, small_batches, unpack

#: Distinct pre-tokens that one task remembers.
CACHE = 150_000
#: Bytes of text that one output batch holds, unless a single text is longer.
BATCH_BYTES = 8 << 20


def byte_letters() -> list[str]:
    """A printable character for each byte, none of them white space (code points from 256 on)."""
    return [chr(0x100 + b) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank) in rank order."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def build_model(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model of a byte-level vocabulary; ids are ranks, then <unk>."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        piece = model.pieces.add()
        piece.piece, piece.score, piece.type = "".join([letters[b] for b in token]), float(-rank), pb.ModelProto.SentencePiece.NORMAL
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    trainer, norm = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size = pb.TrainerSpec.BPE, len(tokens) + 1
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(tokens), -1, -1, -1
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary, made once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=build_model(self.tokens))
        self.find = regex.compile(pattern).findall
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.whole.get(raw)
        ids = [rank] if rank is not None else self.pieces.encode("".join([self.letters[b] for b in raw]))
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        cache, out = self.cache, []
        if len(cache) > CACHE:
            cache.clear()
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self._encode_piece(piece)
                if len(piece) <= 64:
                    cache[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(packed).cast("I")])


def _append(batch: pa.RecordBatch, start: int, values: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.slice(start, len(values)).columns, pa.array(values, schema.field(len(schema) - 1).type)], schema=schema)


def _with_column(df: DataFrame, name: str, kind: T.DataType, source: str, make) -> DataFrame:
    """``df`` with a binary column made from ``source`` in Arrow batches of bounded size."""
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            at, held, out = 0, 0, []
            arrow = pa.schema([*batch.schema, pa.field(name, pa.binary())])
            for value in batch.column(batch.schema.get_field_index(source)):
                made = apply(value.as_py())
                out.append(made)
                held += len(made)
                if held >= BATCH_BYTES:
                    yield _append(batch, at, out, arrow)
                    at, held, out = at + len(out), 0, []
            if out:
                yield _append(batch, at, out, arrow)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids``: each whole text's token ids as packed little-endian uint32 (binary).

    Null text counts as empty and gives no tokens.  ``path`` must be readable by every executor.
    A column named like the new one is replaced; all others are kept.
    """
    names = docs.columns
    packed = pack(docs).withColumn("text", F.coalesce(F.col("row").getField(text_col), F.lit("")))

    def make():
        return held(Codec, path, pattern).encode

    done = _with_column(packed, "ids", T.BinaryType(), "text", make)
    return unpack(done, names, **{out_col: F.col("ids")})


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that packed ids stand for (null ids: no bytes)."""
    names = encoded.columns
    packed = pack(encoded).withColumn("ids", F.coalesce(F.col("row").getField(ids_col), F.lit(b"")))

    def make():
        return held(Codec, path, pattern).decode

    done = _with_column(packed, "out", T.BinaryType(), "ids", make)
    return unpack(done, names, **{out_col: F.col("out")})


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` without the text, with its packed ids as ``encode`` gives them and the bytes that ``decode`` makes of those ids.

    One Python worker a task does both with one codec, and texts do not come back from it.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(Codec, path, pattern)
        for batch in batches:
            rows, texts, at, size, ids = batch.column("row"), batch.column("text"), 0, 0, []
            arrow = pa.schema([batch.schema.field("row"), pa.field("ids", pa.binary()), pa.field("out", pa.binary())])
            for text in texts:
                ids.append(codec.encode(text.as_py()))
                size += len(ids[-1])
                if size >= BATCH_BYTES or at + len(ids) == batch.num_rows:
                    decoded = pa.array(map(codec.decode, ids), pa.binary())
                    yield pa.RecordBatch.from_arrays([rows.slice(at, len(ids)), pa.array(ids, pa.binary()), decoded], schema=arrow)
                    at, size, ids = at + len(ids), 0, []

    done = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("out", T.BinaryType())]))
    return unpack(done, names, **{ids_col: F.col("ids"), decoded_col: F.col("out")})


def digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> dict:
    return {
        "n_tokens": (F.octet_length(ids_col) / 4).cast("long"),
        "ids_sha256": F.sha2(F.col(ids_col), 256),
        "decoded_sha256": F.sha2(F.col(decoded_col), 256),
    }


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    vocabulary = default_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = round_trip(docs, *vocabulary)
    return both.select("doc_id", *[c.alias(n) for n, c in digests(both).items()])
