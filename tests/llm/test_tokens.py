import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from meterloom.llm import byte_bpe, wavelet

ODD = ["", None, "a", "  two  spaces \n\n and\ttabs nbsp em ", "don't I'll''s !'s 's", "日本語 テスト ١٢٣ é̀ 👩‍👩‍👧", "x" * 5000, "\x1c\x1d\x85​|<|endoftext|>#", "the the the\n" * 40]


@pytest.fixture(scope="module")
def encoding():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def mixtures(n=300, seed=1):
    rng = random.Random(seed)
    alphabet = list("ab'sStT.,!12 \n\t\r\x0b\x1c\x1f\x85  　éßжह१٣½Ⅷ😀́‍_")
    return ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(n)]


def test_pattern_splits_as_the_libraries_do(encoding, library):
    find = regex.compile(byte_bpe.pattern_for_regex(P.PATTERN)).findall
    texts = mixtures() + [chr(c) + "a" + chr(c) + " " + chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    for text in texts:
        words = find(text)
        assert "".join(words) == text
        assert [i for w in words for i in encoding.encode_ordinary(w)] == encoding.encode_ordinary(text)
        assert [i for w in words for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_encode_equals_the_library_and_decodes(spark, sf_dir, encoding):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    texts = ODD + mixtures(80) + real + real[:3]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = {r.doc_id: r for r in byte_bpe.encode(docs, path, P.PATTERN, buckets=7, block_bytes=20_000).collect()}
    digests = {r.doc_id: r for r in byte_bpe.encode(docs, path, P.PATTERN, digest=True).collect()}
    assert len(rows) == len(digests) == len(texts)
    for i, t in enumerate(texts):
        want = encoding.encode_ordinary(t or "")
        assert rows[i].ids == want and rows[i].n_tokens == len(want)
        assert bytes(rows[i].decoded) == (t or "").encode()
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_empty_table_and_null_or_repeated_keys(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(None, "a b"), (7, "c"), (7, "c"), (7, None)], "doc_id long, text string")
    assert sorted(str(r.doc_id) + bytes(r.decoded).decode() for r in byte_bpe.encode(docs, path, P.PATTERN).collect()) == ["7", "7c", "7c", "Nonea b"]
    assert byte_bpe.encode(docs.limit(0), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_file_against_the_sequence(n, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 512)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.4, n), 50256).astype(np.uint16)
    for file in (wavelet.WaveletFile(wavelet.build(ids, b"keys", [n])), wavelet.WaveletFile(wavelet.build(ids, b"keys", [n])).load()):
        check_file(file, ids, n, rng)


def check_file(file, ids, n, rng):
    assert (file.tokens() == ids).all() and file.doc_ids == b"keys" and list(file.lengths) == [n]
    for i in rng.integers(0, n, 20) if n else []:
        token = int(ids[i])
        assert file.access(int(i)) == token
        assert file.rank(token, int(i)) == int((ids[:i] == token).sum())
        assert file.select(token, int((ids[:i] == token).sum())) == i
        assert file.count(token) == int((ids == token).sum())
    assert file.count(50256 + 9) == 0
    with pytest.raises(IndexError):
        file.select(50270, 0)


def test_access_reads_one_block_a_plane():
    ids = np.random.default_rng(5).integers(0, 50257, 300_000).astype(np.uint16)
    file = wavelet.WaveletFile(wavelet.build(ids, b"", [len(ids)]))
    assert file.access(200_000) == int(ids[200_000])
    assert len(file._held) <= 2 * file.levels  # a place and the next one
    check_many(file, ids)
    check_many(file.load(), ids)


def check_many(file, ids):
    places = np.arange(0, len(ids), 997)
    assert (file.access_many(places) == ids[places]).all()
    lo, hi = places[:-1], places[1:]
    assert file.count_many(ids[lo], lo, hi).tolist() == [int((ids[a:b] == ids[a]).sum()) for a, b in zip(lo, hi, strict=True)]
    assert (file.select_many(ids[places], [int((ids[:p] == ids[p]).sum()) for p in places]) == places).all()


def test_word_encoder_equals_the_library(library):
    with open(P.path("byte_bpe_50k.json")) as f:
        encoder = wavelet.WordEncoder(f.read())
    assert encoder.chunks is not None and encoder.chunks.marks
    rng = random.Random(2)
    words = ["the", "Word,", "e\u0301t\u00e9", "x1", "don't", "<|endoftext|>", "a<|endoftext|>b", "?!", "\u4e2d\u6587.", "1,000", "end.\n", "\nnew", "", "\t", "\u00a0", "y" * 100, "..", "...!"]
    texts = [t or "" for t in ODD] + mixtures(1500, 7) + [rng.choice([" ", " ", "\n"]).join(rng.choices(words, k=rng.randrange(12))) for _ in range(2000)]
    texts += [chr(c) + "a" + chr(c) + " " + chr(c) + "\n" + chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_vocabularies_get_whole_texts(library):
    import json

    with open(P.path("byte_bpe_50k.json")) as f:
        says = json.load(f)
    for change in ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}, {"normalizer": {"type": "Lowercase"}}):
        model = json.dumps(says | change)
        encoder, own = wavelet.WordEncoder(model), Tokenizer.from_str(model)
        own.encode_special_tokens = True
        assert encoder.chunks is None
        for text in [t or "" for t in ODD] + mixtures(100):
            assert np.frombuffer(encoder.encode(text), "<u2").tolist() == own.encode(text, add_special_tokens=False).ids


def test_wavelet_round_trip(spark, tmp_path, library):
    texts = ODD + mixtures(100)
    keys = random.Random(3).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(keys, texts, keys, strict=True)), "doc_id long, text string, start long").repartition(5)
    files = wavelet.write_files(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/w", file_tokens=300)
    rows = {r.key: r for r in wavelet.read_documents(wavelet.with_starts(files)).collect()}
    start = 0
    for k, t in sorted(zip(keys, texts, strict=True)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[k].start, rows[k].n_tokens) == (start, len(ids))
        assert rows[k].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (rows[k].first_id, rows[k].n_first) == ((ids[0], ids.count(ids[0])) if len(ids) > 1 else (None, 0))
        assert rows[k].end_place == len(ids) - 1
        start += len(ids)


def test_wavelet_long_text(spark, tmp_path, library):
    text = " ".join(f"word{i % 977}, again\n" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    rows = {r.key: r for r in wavelet.read_documents(wavelet.with_starts(wavelet.write_files(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/l", file_tokens=5000))).collect()}
    ids = [*library.encode(text, add_special_tokens=False).ids, 2]
    assert rows[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and rows[2].start == len(ids)


def test_wavelet_empty_table_and_repeated_keys(spark, tmp_path):
    docs = spark.createDataFrame([(None, "x"), (1, "b"), (1, "a")], "doc_id long, text string")
    files = wavelet.write_files(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/a")
    assert [(r.key, r.start) for r in sorted(wavelet.read_documents(wavelet.with_starts(files)).collect(), key=lambda r: r.start)] == [(None, 0), (1, 2), (1, 4)]
    files = wavelet.write_files(docs.limit(0), P.path("byte_bpe_50k.json"), f"file://{tmp_path}/b")
    assert wavelet.read_documents(wavelet.with_starts(files)).count() == 0
