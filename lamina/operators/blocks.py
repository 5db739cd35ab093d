"""Losses of whole documents, without a row for each pair of words.

Documents are cut into blocks of about half a million words, kept as numbers. What blocks ask of the
corpus (how often does this word, this pair occur?) goes out by bucket, each question once a block and
packed, and comes back to the block in the order of the questions: a pair takes about three bytes on its
way, and texts and pairs are never joined. Words and pairs are compared as such, not by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scoring import LAMBDA
from .tables import drop, saved

#: Bytes of text in a block, about, and words in a corpus for each bucket (of which there are ``LEAST`` at least).
BLOCK = 3 << 20
BUCKET = 1 << 21
LEAST = 32
#: Blocks have megabytes: few are sent to Python at once.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers, byte by byte of their places, so that high bytes that hardly change take no room."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.Codec("zstd").compress(planes, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = pa.Codec("zstd").decompress(data[9:], n * width, asbytes=True) if n else b""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def packed_words(values: list[bytes]) -> bytes:
    """Words, which have no white space."""
    joined = b"\n".join(values)
    return len(joined).to_bytes(8, "little") + pa.Codec("zstd").compress(joined, asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], n, asbytes=True).split(b"\n") if n else []


def _bucket_of_words(own: list[bytes], buckets: int) -> np.ndarray:
    return (pd.util.hash_array(np.array(own, dtype=object), categorize=False) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order of places by bucket, and the slice of that order for each bucket there is."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return order, [(int(b), slice(int(i), int(j))) for b, i, j in zip(found, starts, np.append(starts, len(order))[1:], strict=True)]


def _back_in_place(answers: list[dict], order: np.ndarray, field: str) -> np.ndarray:
    """Answers of a block's buckets, in the order of its questions."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([unpacked(a[field]) for a in sorted(answers, key=lambda a: a["bucket"])])
    return out


def _sizes(lengths: pa.Array) -> np.ndarray:
    return pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Documents of about ``BLOCK`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        sentences = batch.column("sentences")
        upto = np.concatenate([[0], np.cumsum(_sizes(pc.binary_length(sentences.flatten())))])[np.concatenate([[0], np.cumsum(_sizes(pc.list_value_length(sentences)))])]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK - size, "right")) - 1)
            held.append(batch.slice(at, end - at))
            size, at = size + int(upto[end] - upto[at]), end
            if size >= BLOCK or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, sentences) as blocks: their documents and words as numbers."""
    cut = docs.select("doc_id", F.coalesce("sentences", F.array().cast("array<string>")).alias("sentences"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in enumerate(_cut(batches)):
            pa.default_memory_pool().release_unused()
            sentences = rows.column("sentences").combine_chunks()
            parts = pc.ascii_split_whitespace(pc.fill_null(sentences.flatten(), ""))  # white space as in ``words``
            tokens = parts.flatten()
            full = pc.binary_length(tokens).to_numpy(zero_copy_only=False) > 0
            lengths = np.bincount(np.repeat(np.arange(len(parts)), _sizes(pc.list_value_length(parts)))[full], minlength=len(parts))
            codes = tokens.filter(pa.array(full)).cast(pa.binary()).dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            n = np.bincount(code, minlength=len(codes.dictionary))
            order = np.argsort(-n, kind="stable")  # frequent words have small numbers, which pack well
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            yield pa.RecordBatch.from_pydict({
                "block": [TaskContext.get().partitionId() << 32 | number], "tokens": [len(code)], "ids": [rows.column("doc_id").to_pylist()],
                "sentences": [packed(_sizes(pc.list_value_length(sentences)))], "lengths": [packed(lengths)],
                "words": [packed_words(codes.dictionary.take(pa.array(order)).to_pylist())], "n": [packed(n[order])], "code": [packed(place[code])],
            }, schema=pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("ids", pa.list_(rows.column("doc_id").type)), *[(c, pa.binary()) for c in ("sentences", "lengths", "words", "n", "code")]]))

    return cut.mapInArrow(run, f"block long, tokens long, ids array<{kind}>, sentences binary, lengths binary, words binary, n binary, code binary")


def _rows(fields: dict[str, str], found: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(found, schema=pa.schema([(c, kinds[k]) for c, k in fields.items()]))


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{c} {k}" for c, k in fields.items())


def _known_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, id, n, vocabulary: number and count of a block's words of each bucket; ``vocabulary``: the
    different words of the bucket. A word's number is its rank by count in its bucket, times the buckets, plus its bucket."""
    asked = {"block": "long", "bucket": "long", "words": "binary", "n": "binary"}
    known = {"block": "long", "bucket": "long", "id": "binary", "n": "binary", "vocabulary": "long"}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, n = np.array(unpacked_words(row["words"]), dtype=object), unpacked(row["n"])
                if len(own):
                    order, parts = _by_bucket(_bucket_of_words(own, buckets))
                    yield _rows(asked, [{"block": row["block"], "bucket": b, "words": packed_words(own[order[x]].tolist()), "n": packed(n[order[x]])} for b, x in parts])

    def answer(table: pa.Table) -> pa.Table:
        questions = table.to_pylist()
        own = [unpacked_words(q["words"]) for q in questions]
        ends = np.cumsum([len(x) for x in own])[:-1]
        codes = pa.array([w for x in own for w in x], pa.binary()).dictionary_encode()
        code = codes.indices.to_numpy(zero_copy_only=False)
        n = np.zeros(len(codes.dictionary), np.int64)
        np.add.at(n, code, np.concatenate([unpacked(q["n"]) for q in questions]))
        id_ = np.empty(len(n), np.int64)
        id_[np.argsort(-n, kind="stable")] = np.arange(len(n)) * buckets + questions[0]["bucket"]
        if len(n) * buckets >= 1 << 32:
            raise ValueError("over four billion different words")
        found = zip(questions, np.split(id_[code], ends), np.split(n[code], ends), strict=True)
        return pa.Table.from_batches([_rows(known, [{"block": q["block"], "bucket": q["bucket"], "id": packed(i), "n": packed(k), "vocabulary": len(n)} for q, i, k in found])])

    questions = blocks.select("block", "words", "n").mapInArrow(ask, _ddl(asked))
    return questions.groupBy("bucket").applyInArrow(answer, _ddl(known))


class _Pairs:
    """The pairs of words within the documents of a block, each once, with the place of each."""

    def __init__(self, row: dict, buckets: int):
        own = unpacked_words(row["words"])
        order, _ = _by_bucket(_bucket_of_words(own, buckets)) if own else (np.zeros(0, np.int64), [])
        ids, self.of_word = (_back_in_place(row["known"], order, c) if own else order for c in ("id", "n"))
        self.code = unpacked(row["code"])
        self.sentences, self.lengths = unpacked(row["sentences"]), unpacked(row["lengths"])
        self.ends = np.cumsum(self.lengths)  # of sentences, in words
        of_docs = np.concatenate([[0], np.concatenate([[0], self.ends])[np.cumsum(self.sentences)]])
        first = np.zeros(len(self.code) + 1, bool)
        first[of_docs] = True
        self.at = np.flatnonzero(~first[:-1])  # of each pair's second word
        token = ids[self.code].astype(np.uint64)
        pairs = token[self.at - 1] << np.uint64(32) | token[self.at]
        self.pairs, place, self.inverse, self.n = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
        self.v, self.w = self.code[self.at[place] - 1], self.code[self.at[place]]  # in the block's own numbers
        second = self.pairs & np.uint64(0xFFFFFFFF)
        k = np.uint64(buckets)
        bucket = (((self.pairs >> np.uint64(32)) + second) % k).astype(np.int64)
        self.key = self.pairs - second + second // k  # in a bucket, the first word gives what the division drops
        self.order, self.parts = _by_bucket(bucket)


def _known_pairs(numbered: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, n: how often a block's pairs of each bucket are in the corpus."""
    asked = {"block": "long", "bucket": "long", "pairs": "binary", "n": "binary"}
    known = {"block": "long", "bucket": "long", "n": "binary"}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Pairs(row, buckets)
                for b, x in own.parts:
                    here = own.order[x]
                    yield _rows(asked, [{"block": row["block"], "bucket": b, "pairs": packed(np.diff(own.key[here], prepend=np.uint64(0))), "n": packed(own.n[here])}])

    def answer(table: pa.Table) -> pa.Table:
        questions = table.to_pylist()
        own = [np.cumsum(unpacked(q["pairs"]).astype(np.uint64), dtype=np.uint64) for q in questions]
        ends = np.cumsum([len(x) for x in own])[:-1]
        pairs, inverse = np.unique(np.concatenate(own), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, inverse, np.concatenate([unpacked(q["n"]) for q in questions]))
        return pa.Table.from_batches([_rows(known, [{"block": q["block"], "bucket": q["bucket"], "n": packed(k)} for q, k in zip(questions, np.split(n[inverse], ends), strict=True)])])

    return numbered.mapInArrow(ask, _ddl(asked)).groupBy("bucket").applyInArrow(answer, _ddl(known))


def _with_answers(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Blocks with all their answers; those without a question have none."""
    fields = [c for c in ("bucket", "id", "n") if c in answers.columns]
    return blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias(name)), "block", "left")


def document_loss(docs: DataFrame, then: Callable[[DataFrame], DataFrame] = lambda losses: losses) -> DataFrame:
    """doc_id, losses of docs (doc_id, sentences): what ``sentence_loss`` gives for each sentence, in order, under
    the model of these documents themselves. A row of docs is a document, whatever its doc_id. What ``then``
    makes of the losses is saved in their place; the tables on the way there go."""
    blocks = saved(_blocks(docs), BATCHES)
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(LEAST, tokens // BUCKET)
    kind = docs.schema["doc_id"].dataType.simpleString()

    answered = saved(_known_words(blocks, buckets), BATCHES)
    vocabulary = answered.groupBy("bucket").agg(F.first("vocabulary").alias("n")).agg(F.sum("n")).first()[0] or 0
    numbered = _with_answers(blocks, answered, "known")
    counted = saved(_known_pairs(numbered.select("block", "words", "sentences", "lengths", "code", "known"), buckets), BATCHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                own = _Pairs(row, buckets)
                n = _back_in_place(row["counted"], own.order, "n") if len(own.order) else own.n
                p = LAMBDA * n / own.of_word[own.v] + (1 - LAMBDA) * (own.of_word[own.w] + 1) / (tokens + vocabulary + 1)
                sentence = np.searchsorted(own.ends, own.at, "right")
                size = np.bincount(sentence, minlength=len(own.lengths))
                total = np.bincount(sentence, -np.log(p)[own.inverse], len(own.lengths))
                mean = pa.array(total / np.maximum(size, 1), mask=size == 0)
                offsets = np.concatenate([[0], np.cumsum(own.sentences)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), pa.ListArray.from_arrays(offsets, mean)], ["doc_id", "losses"])

    columns = ("ids", "words", "sentences", "lengths", "code", "known", "counted")
    found = _with_answers(numbered, counted, "counted").select(*columns).mapInArrow(run, f"doc_id {kind}, losses array<double>")
    out = saved(then(found.withColumn("losses", F.transform("losses", lambda x: F.round(x, 6)))), BATCHES)
    for table in (blocks, answered, counted):
        drop(table)
    return out
