"""Byte-level BPE encoding and decoding by a global shuffle of distinct words (operator 3).

1. ``split``: each task cuts its texts into pre-tokens. Per block of texts the occurrences become
   one position sequence (ranks of the block's distinct words, compressed), and the distinct words
   become packed rows keyed by (block, word bucket). Both go to a table in the shared folder.
2. The packed words are shuffled by bucket, so all occurrences of a word meet in one place, where it
   is encoded once. The number of buckets grows with the input, and the blocks with the buckets, up to
   MOST_BLOCK_BYTES, so that a packed row stays worth its head; the most frequent word costs one entry a block,
   however often it occurs.
3. The ids are shuffled back by block and every document is reassembled by position; decoding looks
   every id of the document up in the token-byte table.

Null and empty texts have no tokens and decode to nothing. Repeated rows are encoded row by row; the
key column may be null, of any type, and named freely. Very long texts make a block of their own. Words that tie in
frequency are ranked by first sight, which no id depends on. An empty table gives no rows; extra columns are dropped, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterloom.llm import common

BUCKETS = (64, 4096)  # at least and at most; one per BUCKET_BYTES of input in between
BUCKET_BYTES = 8 << 20
BLOCK_BYTES, MOST_BLOCK_BYTES = 24 << 20, 64 << 20


def pattern_for_regex(pattern: str) -> str:
    """The tokenizer's pattern with white space spelt as the Unicode property, as its own engine reads it."""
    return pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class Numbered(dict):
    """Word -> its number, in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _pack(*parts: bytes) -> bytes:
    import struct

    import zstandard

    how = zstandard.ZstdCompressionParameters.from_level(9, enable_ldm=True, window_log=25)
    return zstandard.ZstdCompressor(compression_params=how).compress(struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    import struct

    import zstandard

    raw = zstandard.ZstdDecompressor(max_window_size=1 << 26).decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    sizes, at, out = struct.unpack_from(f"<{n}I", raw, 4), 4 + 4 * n, []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


def _planes(values) -> bytes:
    """uint32 values as four byte planes, which compress far better than the values in a row."""
    import numpy as np

    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _split(docs: DataFrame, key: str, text: str, pattern: str, buckets: int, block_bytes: int) -> DataFrame:
    """Rows (block, bucket, blob): bucket -1 holds a block's documents, the others its distinct words."""
    from pyspark.sql import functions as F

    source = pattern_for_regex(pattern)

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import regex
        from pyspark import TaskContext

        find = regex.compile(source).findall
        base, made = TaskContext.get().partitionId() << 32, 0

        def flush(keys, seqs, numbered):
            nonlocal made
            block = base + made
            made += 1
            words = list(numbered)
            seq = np.concatenate(seqs) if seqs else np.empty(0, np.uint32)
            times = np.bincount(seq, minlength=len(words))
            order = np.argsort(-times, kind="stable")  # rank -> number
            rank = np.empty(len(words), np.uint32)
            # Words that occur once come last, in order of sight: one code stands for them all.
            rank[order] = np.minimum(np.arange(len(words), dtype=np.uint32), np.count_nonzero(times > 1))
            sizes = np.fromiter(map(len, seqs), np.uint32, len(seqs))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keys[0].schema) as w:
                for k in keys:
                    w.write_batch(k)
            raw = [words[i].encode() for i in order.tolist()]
            place = (np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % buckets).astype(np.uint16)
            rows = [(block, -1, _pack(sink.getvalue().to_pybytes(), sizes.tobytes(), _planes(rank[seq] if len(seq) else seq), (place & 255).astype(np.uint8).tobytes() + (place >> 8).astype(np.uint8).tobytes(), np.uint32(np.count_nonzero(times > 1)).tobytes()))]
            by = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[by], np.arange(buckets + 1))
            for b in range(buckets):
                at = by[ends[b] : ends[b + 1]]
                if len(at):
                    own = [raw[i] for i in at.tolist()]
                    rows.append((block, b, _pack(_planes(np.fromiter(map(len, own), np.uint32, len(own))), b"".join(own))))
            blocks, places, blobs = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "bucket", "blob"])

        keys, seqs, numbered, size = [], [], Numbered(), 0
        for batch in batches:
            texts, began = batch.column(1), 0
            for i in range(batch.num_rows):
                value = texts[i].as_py() or ""
                words = find(value)
                seqs.append(np.fromiter(map(numbered.__getitem__, words), np.uint32, len(words)))
                size += len(value)
                if size >= block_bytes:
                    keys.append(batch.select([0]).slice(began, i + 1 - began))
                    yield flush(keys, seqs, numbered)
                    keys, seqs, numbered, size, began = [], [], Numbered(), 0, i + 1
            if began < batch.num_rows:
                keys.append(batch.select([0]).slice(began))
        if seqs:
            yield flush(keys, seqs, numbered)

    return docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).mapInArrow(run, "block long, bucket int, blob binary")


def _ranks(raw: bytes) -> dict[bytes, int]:
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def _encode_words(words: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(block, bucket, blob of words) -> (block, bucket, blob of ids); each distinct word of a bucket is encoded once."""

    def run(batches):
        import itertools

        import numpy as np
        import pyarrow as pa
        import tiktoken

        encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=_ranks(ranks), special_tokens={})
        current, known = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, bucket, blob = (batch.column(c)[i].as_py() for c in range(3))
                if bucket != current:
                    current, known = bucket, {}
                sizes, raw = _unpack(blob)
                ends = np.cumsum(_from_planes(sizes)).tolist()
                ids = []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    word = raw[a:b]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = encoding.encode_ordinary(word.decode())
                    ids.append(found)
                counts = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_pack(_planes(counts), _planes(flat))], pa.binary())], names=["block", "bucket", "blob"])

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, blob binary")


def _reassemble(rows: DataFrame, ranks: bytes, key: str, key_type, digest: bool) -> DataFrame:
    from pyspark.sql import types as T

    more = [T.StructField("n_tokens", T.LongType())]
    more += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    schema = T.StructType([T.StructField(key, key_type), *more])

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        table = [b""] * (max(_ranks(ranks).values()) + 1)
        for token, i in _ranks(ranks).items():
            table[i] = token
        names = [str(i) for i in range(len(table))]

        def finish(docs, found):
            keys, sizes, planes, places, first_once = docs
            low, high = np.frombuffer(places, np.uint8).reshape(2, -1).astype(np.uint16)
            place = low | high << 8  # bucket of every word, in order of rank; within a bucket words keep that order
            by = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[by], np.arange(len(by) and int(place.max()) + 2))
            counts, starts = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
            flats, begun = [np.empty(0, np.uint32)], 0
            for bucket, c, flat in found:
                at = by[ends[bucket] : ends[bucket + 1]]
                counts[at] = c
                starts[at] = begun + np.cumsum(c) - c
                flats.append(flat)
                begun += len(flat)
            flat = np.concatenate(flats)
            seq = _from_planes(planes).copy()
            once = int(np.frombuffer(first_once, "<u4")[0])
            single = seq == once
            seq[single] = once + np.arange(np.count_nonzero(single), dtype=np.uint32)
            at = 0
            reader = pa.ipc.open_stream(keys)
            sizes = iter(np.frombuffer(sizes, np.uint32).tolist())
            for part in reader:
                out = [[] for _ in more]
                for _ in range(part.num_rows):
                    size = next(sizes)
                    own = seq[at : at + size]
                    at += size
                    c = counts[own]
                    total = int(c.sum())
                    ids = flat[np.repeat(starts[own] - np.cumsum(c) + c, c) + np.arange(total)]
                    listed = ids.tolist()
                    decoded = b"".join(map(table.__getitem__, listed))
                    out[0].append(total)
                    if digest:
                        out[1].append(hashlib.sha256(",".join(map(names.__getitem__, listed)).encode()).hexdigest())
                        out[2].append(hashlib.sha256(decoded).hexdigest())
                    else:
                        out[1].append(ids.astype(np.int32))
                        out[2].append(decoded)
                kinds = [pa.int64(), *([pa.string()] * 2 if digest else [pa.list_(pa.int32()), pa.binary()])]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out, kinds)], names=schema.names)

        current, docs, found = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                block, bucket, blob = (batch.column(c)[i].as_py() for c in range(3))
                if block != current:
                    if docs:
                        yield from finish(docs, found)
                    current, docs, found = block, None, []
                parts = _unpack(blob)
                if bucket < 0:
                    docs = parts
                else:
                    found.append((bucket, _from_planes(parts[0]).astype(np.int64), _from_planes(parts[1])))
        if docs:
            yield from finish(docs, found)

    return rows.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", digest: bool = False, buckets: int | None = None, block_bytes: int | None = None) -> DataFrame:
    """One row per document: its key, n_tokens, ids (array of int) and decoded (binary).

    With ``digest`` the last two are the SHA-256 of the decimal ids joined by commas and of the
    decoded bytes. ranks_path: a file of base64 tokens and ranks on the driver.
    """
    from pyspark.sql import functions as F

    ranks = common.file_bytes(ranks_path)
    if buckets is None:
        buckets = min(max(common.planned_bytes(docs) // BUCKET_BYTES, BUCKETS[0]), BUCKETS[1])
    if block_bytes is None:
        block_bytes = min(BLOCK_BYTES * max(1, buckets // 512), MOST_BLOCK_BYTES)
    kept = common.stash(_split(docs, key, text, pattern, buckets, block_bytes), "bpe-split")
    ids = _encode_words(kept.where(F.col("bucket") >= 0), ranks, pattern)
    return _reassemble(kept.where(F.col("bucket") < 0).unionByName(ids), ranks, key, docs.schema[key].dataType, digest)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: encodes and decodes all documents."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), common.tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
