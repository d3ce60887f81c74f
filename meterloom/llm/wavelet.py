"""Token ids in wavelet-matrix files (operator 10).

Documents are dealt by ranges of doc_id; each task writes its ids, in ascending doc_id order, to files
of about FILE_TOKENS ids. A file holds the documents' ids and lengths and one bit-plane per bit of the
vocabulary. A plane is stored in blocks of BLOCK bits, compressed one by one, with a directory of the
ones before each block and of each block's place. ``WaveletFile`` answers access, rank, count and select
(the place of the k-th occurrence) from the directories and one block a plane, without decoding the
sequence; it also decodes whole files plane by plane.

Files are values of a binary column of a table in the shared folder, so any storage that Spark
reaches will do and a lost executor's files are written again by the retried task.

Texts are encoded as the tokenizers library does where special tokens' strings are ordinary text. Null and empty
texts get the end id alone. Very long texts make a file of their own, longer than FILE_TOKENS. Repeated
doc_ids follow each other in the order of their texts, and rows that tie in both are alike; a null
doc_id comes first. An empty table gives no files and no rows. Extra columns are dropped, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm import common

FILE_TOKENS = 2 << 20
END_ID = 2
MAGIC = b"MLWM0002"
BLOCK = 1 << 15  # bits of a plane that are compressed together
#: Ranges of letters that make one pre-token with their neighbours (asked of the library before they are relied on).
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


def build(ids, doc_ids: bytes, lengths, levels: int = 16) -> bytes:
    """The bytes of one file: ids (1-d, below 2**levels), the documents' keys as given, and their lengths."""
    import struct

    import numpy as np
    import zstandard

    seq = np.ascontiguousarray(ids, np.uint16 if levels <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [doc_ids, pack(np.ascontiguousarray(lengths, "<u4").tobytes())]
    zeros = []
    for level in range(levels - 1, -1, -1):
        ones = (seq & seq.dtype.type(1 << level)) != 0
        raw, step = np.packbits(ones).tobytes(), BLOCK // 8
        blocks = [raw[i : i + step] for i in range(0, len(raw), step)]
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), BLOCK), dtype=np.int64))]) if blocks else np.zeros(1)
        blocks = [min(b, pack(b), key=len) for b in blocks]  # a block that doesn't shrink stays as it is
        ends = np.cumsum([0, *map(len, blocks)])
        parts += [np.stack([before, ends]).astype("<u4").tobytes(), b"".join(blocks)]
        high, low = np.flatnonzero(ones), np.flatnonzero(~ones)
        zeros.append(len(low))
        after = np.empty_like(seq)
        np.take(seq, low, out=after[: len(low)])
        np.take(seq, high, out=after[len(low) :])
        seq = after
    head = struct.pack(f"<8sQIB{levels}Q{len(parts)}Q", MAGIC, len(seq), len(lengths), levels, *zeros, *map(len, parts))
    return head + b"".join(parts)


class WaveletFile:
    """One file: the token sequence of its documents."""

    def __init__(self, raw: bytes):
        import struct

        import numpy as np

        magic, self.n, self.n_docs, self.levels = struct.unpack_from("<8sQIB", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        at = struct.calcsize("<8sQIB")
        numbers = struct.unpack_from(f"<{3 * self.levels + 2}Q", raw, at)
        self.zeros, sizes = numbers[: self.levels], numbers[self.levels :]
        at += 8 * len(numbers)
        parts = []
        for size in sizes:
            parts.append(raw[at : at + size])
            at += size
        self.doc_ids, self._lengths, self._data = parts[0], parts[1], parts[3::2]
        directories = [np.frombuffer(d, "<u4").reshape(2, -1).astype(np.int64) for d in parts[2::2]]
        self._ones, self._ends = [d[0] for d in directories], [d[1] for d in directories]
        self._step = BLOCK
        self._held: dict[tuple[int, int], object] = {}
        self._counts: dict[tuple[int, int], object] = {}

    @property
    def lengths(self):
        import numpy as np
        import zstandard

        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self._lengths), "<u4")

    def _block(self, level: int, block: int):
        """The bytes of one block of a plane; the blocks read stay in memory."""
        import numpy as np
        import zstandard

        found = self._held.get((level, block))
        if found is None:
            raw = self._data[level][self._ends[level][block] : self._ends[level][block + 1]]
            size = (min(self.n - block * BLOCK, BLOCK) + 7) // 8
            found = self._held[level, block] = np.frombuffer(raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        return found

    def _before(self, level: int, block: int):
        """Ones before each byte of a block, and in all of it."""
        import numpy as np

        found = self._counts.get((level, block))
        if found is None:
            found = self._counts[level, block] = np.concatenate([[0], np.cumsum(np.bitwise_count(self._block(level, block)), dtype=np.int64)])
        return found

    def load(self) -> WaveletFile:
        """Reads all planes at once: from then on each is one block, and many places are looked up without a loop."""
        import numpy as np

        if self._step == BLOCK and self.n > BLOCK:
            for level in range(self.levels):
                whole = np.concatenate([self._block(level, b) for b in range(len(self._ends[level]) - 1)])
                for b in range(len(self._ends[level]) - 1):
                    del self._held[level, b]
                self._held[level, 0] = whole
                self._ones[level] = self._ones[level][[0, -1]]
            self._counts.clear()
            self._step = self.n
        return self

    def _by_block(self, blocks):
        """(block, places in blocks) for every distinct block."""
        import numpy as np

        if not len(blocks) or blocks[0] == blocks.max() == blocks.min():
            if len(blocks):
                yield int(blocks[0]), slice(None)
            return
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        for part in np.split(order, cuts):
            yield int(blocks[part[0]]), part

    def _rank1(self, level: int, places):
        """Ones among the first bits of a plane, for an array of places."""
        import numpy as np

        blocks = places // self._step
        out = self._ones[level][blocks]
        for b, part in self._by_block(blocks):
            off = places[part] - b * self._step
            if off.any():
                raw = self._block(level, b)
                whole, rest = off >> 3, off & 7
                out[part] += self._before(level, b)[whole] + np.where(rest > 0, np.bitwise_count(raw[np.minimum(whole, len(raw) - 1)] >> (8 - rest).astype(np.uint8)), 0)
        return out

    def _bits(self, level: int, places):
        """The bits of a plane at an array of places."""
        import numpy as np

        out = np.empty(len(places), np.int64)
        for b, part in self._by_block(places // self._step):
            off = places[part] - b * self._step
            out[part] = self._block(level, b)[off >> 3] >> (7 - (off & 7)).astype(np.uint8) & 1
        return out

    def _select(self, level: int, bit: int, ks):
        """Places of the k-th (from 0) bits of a kind in a plane."""
        import numpy as np

        ones = self._ones[level]
        before = ones if bit else np.minimum(np.arange(len(ones)) * self._step, self.n) - ones
        blocks = np.searchsorted(before, ks, side="right") - 1
        out = np.empty(len(ks), np.int64)
        for b, part in self._by_block(blocks):
            inside, k = self._before(level, b), ks[part] - before[b]
            inside = inside if bit else 8 * np.arange(len(inside)) - inside
            at = np.searchsorted(inside, k, side="right") - 1
            bits = np.cumsum(np.unpackbits(self._block(level, b)[at]).reshape(-1, 8) == bit, axis=1)
            out[part] = b * self._step + 8 * at + (bits <= (k - inside[at])[:, None]).sum(axis=1)
        return out

    def access_many(self, places):
        """The ids at an array of places."""
        import numpy as np

        at = np.asarray(places, np.int64)
        value = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            ones, bit = self._rank1(level, at), self._bits(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            value = value << 1 | bit
        return value

    def _ranges(self, tokens, lo, hi):
        import numpy as np

        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            bit = tokens >> (self.levels - 1 - level) & 1 == 1
            lo, hi = np.where(bit, self.zeros[level] + a, lo - a), np.where(bit, self.zeros[level] + b, hi - b)
        return lo, hi

    def count_many(self, tokens, lo, hi):
        """Occurrences of each id among the places from lo to hi (excluded), for arrays of all three."""
        import numpy as np

        tokens = np.asarray(tokens, np.int64)
        a, b = self._ranges(tokens, np.asarray(lo, np.int64), np.asarray(hi, np.int64))
        return np.where(tokens >> self.levels == 0, b - a, 0)

    def select_many(self, tokens, ks):
        """Places of the k-th (from 0) occurrences of ids; IndexError where there are fewer."""
        import numpy as np

        tokens, ks = np.asarray(tokens, np.int64), np.asarray(ks, np.int64)
        lo, hi = self._ranges(tokens, np.zeros(len(tokens), np.int64), np.full(len(tokens), self.n, np.int64))
        if not ((tokens >> self.levels == 0) & (ks >= 0) & (ks < hi - lo)).all():
            raise IndexError("an id has fewer occurrences")
        at = lo + ks
        for level in range(self.levels - 1, -1, -1):
            bit = tokens >> (self.levels - 1 - level) & 1 == 1
            back = np.empty(len(at), np.int64)
            back[bit] = self._select(level, 1, at[bit] - self.zeros[level])
            back[~bit] = self._select(level, 0, at[~bit])
            at = back
        return at

    def access(self, i: int) -> int:
        """The id at place i."""
        return int(self.access_many([i])[0])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among the places lo to hi (excluded)."""
        return int(self.count_many([token], [lo], [self.n if hi is None else hi])[0])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id before place i."""
        return self.count(token, 0, i)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id; IndexError where there are fewer."""
        return int(self.select_many([token], [k])[0])

    def tokens(self):
        """The whole sequence, rebuilt from the last plane to the first."""
        import numpy as np

        kind = np.uint16 if self.levels <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            raw = [self._block(level, b) for b in range(-(-self.n // self._step))]
            ones = np.unpackbits(np.concatenate(raw) if raw else np.empty(0, np.uint8), count=self.n).view(bool)
            low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
            before = np.empty_like(seq)
            before[low] = seq[: len(low)]
            before[high] = seq[len(low) :] | kind(1 << (self.levels - 1 - level))
            seq = before
        return seq


class Irregular(Exception):
    """A blank or line feed of the text stands beside other white space."""


class Recent(dict):
    """A dict that keeps what has been used lately: at most twice `most` entries."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def trim(self):
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            self[key] = found
        return found


class Chunks(Recent):
    """What stands between two blanks -> its ids (as bytes), the blank before it included.

    A chunk that begins with a line feed had no blank before it.
    """

    def __init__(self, encode, tokenize, letters: dict[int, str], marks: str, bytes_of, most: int):
        import re

        super().__init__(most)
        self.encode, self.tokenize, self.letters, self.blank, self.marks, self.bytes_of = encode, tokenize, letters, letters[32], marks, bytes_of
        self.latin = re.compile(f"[{LATIN}]+").fullmatch
        self.tails: dict[str, bytes] = {}

    def make(self, chunk):
        feed = chunk[:1] == "\n"
        body = chunk[1:] if feed else chunk
        word = body.rstrip(self.marks)
        if self.latin(word):  # one pre-token
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = self.bytes_of([t.id for t in self.tokenize(spelt if feed else self.blank + spelt)])
            return (self._tail("\n") if feed else b"") + ids + (self._tail(body[len(word) :]) if len(word) < len(body) else b"")
        if not body or body[0].isspace() or body[-1].isspace():
            raise Irregular
        return self.encode(chunk if feed else " " + chunk)

    def _tail(self, marks: str) -> bytes:
        found = self.tails.get(marks)
        if found is None:
            found = self.encode(marks)
            if len(marks) <= 4:
                self.tails[marks] = found
        return found


class WordEncoder:
    """Encodes texts with the tokenizers library, giving it each distinct chunk once (while remembered).

    A text is cut where a blank or a line feed stands between two characters that are no white space.
    Whether the library's own pre-tokenizer always ends a pre-token there is asked of it at the start;
    where it doesn't, and for texts with strings of added tokens, the library gets the whole text.
    """

    CHUNKS = 650_000  # kept before the older half goes

    def __init__(self, model: str):
        import json
        import re

        import numpy as np
        from tokenizers import Tokenizer

        says, self.library = json.loads(model), Tokenizer.from_str(model)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = 2 if max(self.library.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4
        self.added = [t["content"] for t in says.get("added_tokens") or () if not t["special"]]
        self.kind, self.pairs = np.dtype(f"<u{self.size}"), None
        if self.size == 2:
            self.pairs = [bytes((i & 255, i >> 8)) for i in range(1 << 16)]
        self.cut = re.compile(r"(?<=\S)(?=[ \n]\S)").split
        found = self._probe(says)
        self.chunks = Chunks(self._library, self.library.model.tokenize, *found, self._bytes, self.CHUNKS) if found else None

    def _probe(self, says: dict) -> tuple[dict[int, str], str] | None:
        """How bytes are spelt, and the marks that the pre-tokenizer splits from a word before them; None where texts can't be cut."""
        if says.get("normalizer") or not self.library.pre_tokenizer or says["pre_tokenizer"]["type"] != "ByteLevel":
            return None
        pieces = lambda text: [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        for a in ("ab", "b,", "1", "é", "中", "'s", "…"):
            for b in ("cd", ".d", "2", "é", "中", "'s", "…"):
                if pieces(f"{a} {b}") != pieces(a) + pieces(f" {b}") or pieces(f"{a}\n{b}") != pieces(a) + pieces(f"\n{b}"):
                    return None
        every = "".join(chr(c) for a, b in zip(LATIN[::3], LATIN[2::3], strict=True) for c in range(ord(a), ord(b) + 1))
        if pieces(f" {every}") != [f" {every}"] or pieces(f"\n{every}") != ["\n", every]:
            return None
        spelt = self.library.pre_tokenizer.pre_tokenize_str(f" {every}")[0][0]
        letters = dict(zip(f" {every}".encode(), spelt, strict=False))
        if len(spelt) != len(f" {every}".encode()) or spelt.translate({ord(v): k for k, v in letters.items()}).encode("latin-1").decode() != f" {every}" or any(letters[ord(c)] != c for c in "azAZ"):
            return None
        return letters, "".join(m for m in ".,;:!?#$%&*()[]{}<>/|@^~+=\"" if all(pieces(f" {w}{m * n}") == [f" {w}", m * n] for w in ("ab", "é") for n in (1, 3)) and pieces(f"ab{m}.") == ["ab", f"{m}."])

    def _bytes(self, ids: list[int]) -> bytes:
        import numpy as np

        return b"".join([self.pairs[i] for i in ids]) if self.pairs and len(ids) < 50 else np.array(ids, self.kind).tobytes()

    def _library(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian numbers of `size` bytes."""
        if not text:
            return b""
        if self.chunks is None or any(a in text for a in self.added):
            return self._library(text)
        self.chunks.trim()
        parts = text.replace("\n", " \n").split(" ")
        first = parts[0]
        if first and not first[0].isspace() and not first[-1].isspace():
            try:
                rest = b"".join(map(self.chunks.__getitem__, parts[1:]))
                return self._library(first) + rest
            except Irregular:
                pass
        first, *rest = self.cut(text)
        return self._library(first) + b"".join([self._piece(x) for x in rest])

    def _piece(self, text: str) -> bytes:
        """A piece that begins with a blank or a line feed and a character that is no white space."""
        if text[-1].isspace() or text[0] == "\n":  # its last part goes on to the next safe place
            return self._library(text)
        return self.chunks[text[1:]]


def write_files(docs: DataFrame, model_path: str, path: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files to a table at `path` and returns it: part, chunk, first_key, n_docs, n_tokens, end_id, file."""
    model = common.file_bytes(model_path).decode()
    spark = docs.sparkSession
    ordered = docs.select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")).repartitionByRange("__key").sortWithinPartitions("__key", "__text")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = common.worker_memo(("wavelet-words", hash(model)), lambda: WordEncoder(model))
        end = np.array([end_id], encoder.kind).tobytes()
        part, chunk, keys, found, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal chunk
            sink = pa.BufferOutputStream()
            own = pa.array(keys, pa.int64())
            with pa.ipc.new_stream(sink, pa.schema([("key", pa.int64())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(pa.RecordBatch.from_arrays([own], names=["key"]))
            ids = np.frombuffer(b"".join(found), encoder.kind)
            lengths = np.fromiter((len(x) // encoder.size for x in found), np.uint32, len(found))
            row = [part], [chunk], [keys[0]], [len(keys)], [len(ids)], [end_id], [build(ids, sink.getvalue().to_pybytes(), lengths, 8 * encoder.size)]
            chunk += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=["part", "chunk", "first_key", "n_docs", "n_tokens", "end_id", "file"])

        for batch in batches:
            texts = batch.column(1)
            for i, k in enumerate(batch.column(0).to_pylist()):
                keys.append(k)
                found.append(encoder.encode(texts[i].as_py()) + end)
                size += len(found[-1]) // encoder.size
                if size >= file_tokens:
                    yield flush()
                    keys, found, size = [], [], 0
        if keys:
            yield flush()

    schema = "part int, chunk int, first_key long, n_docs long, n_tokens long, end_id long, file binary"
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_starts(files: DataFrame) -> DataFrame:
    """files with `start`: the ids in all files before it.

    The parts (one row per writing task, their only ordered table) are summed in order of their first keys;
    within a part a window runs over its few files.
    """
    from pyspark.sql import Window

    parts = files.groupBy("part").agg(F.min("first_key").alias("k"), F.sum("n_tokens").alias("n"), F.max(F.col("first_key").isNull()).alias("z"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(until(Window.orderBy(F.desc("z"), "k", "part"))), F.lit(0)).alias("__base"))
    before = F.sum("n_tokens").over(until(Window.partitionBy("part").orderBy("chunk")))
    starts = files.select("part", "chunk", "n_tokens").withColumn("__in", F.coalesce(before, F.lit(0)))
    starts = starts.join(base.hint("merge"), "part").select("part", "chunk", (F.col("__base") + F.col("__in")).alias("start"))
    return files.join(starts, ["part", "chunk"])


def read_documents(files: DataFrame) -> DataFrame:
    """Reads the files: key, start (ids of all documents before it), n_tokens, ids_crc32 per document.

    first_id (null where the end id stands alone) comes by access, n_first by counting it within the document,
    and end_place (of the end id, from the document's start) by rank and select.
    """

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                begun, file, end_id = batch.column(0)[i].as_py(), WaveletFile(batch.column(1)[i].as_py()).load(), batch.column(2)[i].as_py()
                keys = pa.ipc.open_stream(file.doc_ids).read_all().column(0).combine_chunks()
                lengths = file.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                view = memoryview(file.tokens().astype("<u4")).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                first = file.access_many(starts)
                often = file.count_many(first, starts, ends)
                end = np.full(len(ends), end_id, np.int64)
                place = file.select_many(end, file.count_many(end, np.zeros(len(ends), np.int64), ends) - 1) - starts
                alone = lengths == 1
                yield pa.RecordBatch.from_arrays([keys, pa.array(begun + starts), pa.array(lengths), pa.array(sums, pa.int64()), pa.array(first, mask=alone), pa.array(np.where(alone, 0, often)), pa.array(place)], names=["key", "start", "n_tokens", "ids_crc32", "first_id", "n_first", "end_place"])

    return files.select("start", "file", "end_id").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long, first_id long, n_first long, end_place long")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: encodes all documents, writes them as wavelet-matrix files and reads the files back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_files(docs, common.tokenizer_path("byte_bpe_50k.json"), common.shared_path(spark, "wavelet"))
    return read_documents(with_starts(files)).withColumnRenamed("key", "doc_id")
