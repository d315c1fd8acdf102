"""BPE against the tokenizers library, and the exact round trip."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from adflow.llm import bpe
from adflow.llm.queries import BPE_FILE

from .tables import awkward, documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_FILE)


def ids(text):
    return np.frombuffer(bpe.vocabulary(BPE_FILE).encode_batch([text])[0], np.int32).tolist()


def test_pieces_of_all_kinds(library):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "ing", "'s", "'S", "1", "23", "é", "日本", "한", "\u00a0", "\u2003", "!", "??", "<|endoftext|>",
             "\x1c", "\u0301", "ß", "A", "aaaa", "\U0001f600", "꟎", "\r\n", "ation", "  \n "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert ids(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_random_letters_and_one_long_word(library):
    rng = random.Random(2)
    for size in [*[rng.randint(0, 200) for _ in range(500)], 20_000]:
        text = "".join(rng.choice("aehinorst") for _ in range(size))
        assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_batches_of_texts_of_all_kinds(library, monkeypatch):
    rng = random.Random(5)
    parts = [" ", " ", " ", "  ", "\n", "a", "the", "The", "ing", "'s", "1", "é", "日本", "\u00a0", "!", ",", "$$$", "<|endoftext|>", "ation.\nIn"]
    texts = [None, "", " ", "x"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["one two, two. " * 20 + "end"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for cached in (bpe.CACHED, 50):
        monkeypatch.setattr(bpe, "CACHED", cached)
        own = bpe.Vocabulary(BPE_FILE)
        array = pa.array(["cut", *texts])[1:]
        got = [i for at in range(0, len(texts), 300) for i in own.encode_array(array.slice(at, 300)).to_pylist()]
        assert got == want
    assert own.encode_array(pa.array([], pa.string())).to_pylist() == []


def test_a_word_is_encoded_once_whatever_stands_after_it(monkeypatch):
    own, asked = bpe.Vocabulary(BPE_FILE), []
    encode_words = own.encode_words
    monkeypatch.setattr(own, "encode_words", lambda words: encode_words([asked.append(w) or w for w in words]))
    own.encode_batch(["so tallow tallow, tallow. (tallow) tallow!\nTallow"])
    own.encode_batch(["so tallow; tallow... tallow?"])
    assert asked.count(" tallow") == 1 and len(asked) == len(set(asked))


def test_slices_of_a_long_text(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    text = "some words  and blanks \n here, there. " * 40
    assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_decode_cuts_inside_a_character():
    own = bpe.vocabulary(BPE_FILE)
    some = ids("é日本")
    got = own.decode_batch(np.array(some[:-1] + some, np.int32), np.array([0, len(some) - 1, len(some) - 1, 2 * len(some) - 1]))
    assert got.to_pylist() == [own.decode(some[:-1]), "", "é日本"]
    assert got[0].as_py().endswith("\ufffd")


def test_operator_bears_awkward_rows(spark, library):
    rows = awkward(random.Random(3))
    docs = documents(spark, rows, clash=["ids", "decoded", "N_TOKENS"])
    got = bpe.decode(bpe.encode(docs, BPE_FILE), BPE_FILE).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["decoded"] == (r["text"] or "")
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    report = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"])
              for r in bpe.roundtrip_report(docs, BPE_FILE).collect()}
    for i, text, *_ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert (i, hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest(), len(want)) in report


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, BPE_FILE).orderBy("k").collect()] == ["", ""]
    assert bpe.roundtrip_report(documents(spark, []), BPE_FILE).count() == 0
