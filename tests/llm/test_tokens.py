"""Token files, byte-level BPE and edit-aware counts against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from embercast.llm import bpe, edit_counts, token_files
from embercast.llm.arrays import work_folder
from embercast.llm.queries import WORD_BPE, op1_token_files, op2_byte_bpe, op5_edit_counts
from tests.llm.helpers import PATTERN, RANKS, documents, frame, tiktoken_encoding

PIECES = ["a", "B", "é", "H̱", "ß", "İ", "'s", "'", "!", ".", ",", "1", "½", "日本", "Σ", " ", "  ", "\n", " \n ", "　", "\x1c", "\x85", "<|endoftext|>", "the", "ª", "~", "word ", "..."]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_pack_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, n, np.uint32) for n in (0, 1, 63, 64, 65, 1000, 5000)]
    data = token_files.file_bytes([3, None, 5, 6, 7, 8, 9], ids, bits, block_ids=128)
    f = token_files.TokenFile(lambda at, n: data[at:at + n])
    flat = np.concatenate(ids)
    assert f.n_ids == len(flat) and f.bits == bits and f.present.tolist() == [True, False, True, True, True, True, True]
    assert (f.ids(0, len(flat)) == flat).all()
    for a, b in zip(f.starts[:-1], f.starts[1:]):
        assert (f.ids(int(a), int(b)) == flat[a:b]).all()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert (f.ids(a, b) == flat[a:b]).all()


def test_word_encoder_equals_library():
    encode, library, rng = token_files.WordEncoder(WORD_BPE, most=40), Tokenizer.from_file(WORD_BPE), random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        assert encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids, text


def expected_files(rows, end):
    library, start, out = Tokenizer.from_file(WORD_BPE), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    rows = documents()
    folder = work_folder(spark, "test-tokens")
    manifest = token_files.write(frame(spark, rows), folder, WORD_BPE, end_id=1, vocabulary=49_408, file_ids=2000, block_ids=256)
    got = token_files.digests(spark, manifest, folder, block=1500).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_files([r[:2] for r in rows], 1)
    assert manifest.count() > 3
    whole = {(r["doc_id"], r["start"]): r["ids"] for r in token_files.read(spark, manifest, folder).collect()}
    assert all(zlib.crc32(np.array(whole[r["doc_id"], r["start"]], "<u4").tobytes()) == r["ids_crc32"] for r in got)


def test_token_files_of_empty_table(spark):
    folder = work_folder(spark, "test-tokens")
    manifest = token_files.write(frame(spark, []), folder, WORD_BPE, end_id=1, vocabulary=49_408)
    assert token_files.digests(spark, manifest, folder).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_tree_encoding_equals_tiktoken(leaf):
    own, library, rng = bpe.encoding(RANKS, PATTERN), tiktoken_encoding(), random.Random(leaf)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        ids = library.encode_ordinary(text)
        assert bpe.encode_text(own, text, leaf=leaf) == ids, text
        assert bpe.decode_ids(own, ids, leaf=leaf) == text.encode()


def test_bpe_on_documents_with_clashing_columns(spark):
    rows, library = documents(), tiktoken_encoding()
    df = frame(spark, [(*r, "old", "old") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string")
    got = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert got.columns == df.columns
    found = sorted((str(r["doc_id"]), tuple(r["ids"]), bytes(r["decoded"])) for r in got.collect())
    assert found == sorted((str(r[0]), tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert bpe.decode(bpe.encode(frame(spark, []), RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_edits_equal_a_full_count():
    enc, rng = tiktoken_encoding(), random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        pieces = edit_counts.cut(text, rng.choice([3, 6, 12]))
        tree = edit_counts.CountTree(pieces, [len(enc.encode_ordinary(p)) for p in pieces])
        assert tree.total == len(enc.encode_ordinary(text))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 3)) // 2 * 2))
        edits = [(cuts[i], cuts[i + 1], "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 4)))) for i in range(0, len(cuts), 2)]
        edit_counts.edit(enc, tree, edits)
        for s, e, new in sorted(edits, reverse=True):
            text = text[:s] + new + text[e:]
        assert "".join(tree.pieces) == text and tree.total == len(enc.encode_ordinary(text)) == sum(tree.sums[tree.size:])


def test_edit_encodes_only_its_surroundings():
    enc = tiktoken_encoding()
    text = "some plain words of prose, over and over. " * 2000
    pieces = edit_counts.cut(text)
    tree = edit_counts.CountTree(pieces, [len(enc.encode_ordinary(p)) for p in pieces])
    edit_counts.edit(enc, tree, [(40_000, 40_010, "x")])
    assert 0 < tree.reencoded < 3 * edit_counts.SEGMENT


def test_recount_on_documents(spark):
    rows, library = documents(), tiktoken_encoding()
    df = edit_counts.private_edits(edit_counts.count(frame(spark, rows), RANKS, PATTERN), pattern="on|th", replacement="##")
    got = edit_counts.recount(df, RANKS, PATTERN).collect()
    import re

    want = sorted((str(r[0]), str(t := r[1] and re.sub("on|th", "##", r[1])), len(library.encode_ordinary(t or ""))) for r in rows)
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_tokens"]) for r in got) == want
    assert edit_counts.recount(edit_counts.private_edits(edit_counts.count(frame(spark, []), RANKS, PATTERN)), RANKS, PATTERN).count() == 0


def test_queries_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op1_token_files(spark, sf).collect()), key=lambda r: r[1]) == expected_files(docs, 1)
    library, text = tiktoken_encoding(), dict(docs)
    for r in op2_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(text[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()
    for r in op5_edit_counts(spark, sf).collect():
        after = edit_counts.PRIVATE.sub("[removed]", text[r["doc_id"]])
        assert (r["tokens_before"], r["tokens_after"], r["chars_after"]) == (len(library.encode_ordinary(text[r["doc_id"]])), len(library.encode_ordinary(after)), len(after))


def test_vocabulary_files_are_parameters():
    assert public_tokenizers.path("word_bpe_49k.json") == WORD_BPE
