"""Cross-tokenizer alignment: plain loops over the two libraries' tokens, and the external count."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from adflow.llm import token_align as ta
from adflow.llm.bpe import byte_characters

from .tables import awkward, documents, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Per text: ids of both sides in groups."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    char = byte_characters()
    out = []
    for text in texts:
        groups = []
        if text:
            want = (" " + text).encode()
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            bytes_a = [bytes(char[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                       b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == want == b"".join(bytes_b):
                ends = [set(np.cumsum([len(t) for t in side]).tolist()) for side in (bytes_a, bytes_b)]
                cuts = sorted(ends[0] & ends[1])
                groups = [([], []) for _ in cuts]
                for side, (ids, tokens) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
                    at = g = 0
                    for i, t in zip(ids, tokens, strict=True):
                        at += len(t)
                        groups[g][side].append(i)
                        g += at == cuts[g]
        out.append(groups)
    return out


def report(ids, texts):
    held = brute(texts)
    linked = [Counter((x, y) for xs, ys in groups for x in xs for y in ys) for groups in held]
    count = Counter(p for own in linked for p in own)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for i, groups, own in zip(ids, held, linked, strict=True):
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        rows.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()),
                     sum(k for p, k in own.items() if count[p] == most[p[0]]), sum(k * count[p] for p, k in own.items()),
                     hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(rows, key=str), {(x, y, n, n == most[x]) for (x, y), n in count.items()}


def texts(rng):
    rows = awkward(rng)
    rows += [(300 + i, t, "aa", "s") for i, t in enumerate(
        ["<|endoftext|><s></s>", "▁ under", "a▁b", " lead", "two  blanks   three", "tab\tnew\nline\r\n", "日本語 テキスト 한국어",
         "😀 emoji 👩‍👩‍👧", "ﬁ ligature ½ Ⅻ", "\x00 nul", "\u0085 x", "don't we'll I'VE", "x" * 5000, " " * 3000 + "x", "́ combining",
         "".join(rng.choice("abcdefXYZ0189+/") for _ in range(6000)), " ".join(["same"] * 700)])]
    return rows + [(400 + i, rows[-2][1] if i % 3 else rows[-1][1], "bb", "t") for i in range(9)]


@pytest.mark.parametrize("most_links,fan_in", [(ta.LINKS, ta.FAN_IN), (3000, 2), (1, 3)])
def test_alignment_against_loops(spark, monkeypatch, most_links, fan_in):
    rows = texts(random.Random(4))
    if most_links == 1:
        rows = rows[:40]
    docs = documents(spark, rows, clash=["run", "radix", "n_a"])
    got = ta.align(docs, A, B, most_links=most_links, fan_in=fan_in)
    want, pairs = report([r[0] for r in rows], [r[1] for r in rows])
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.documents.columns == cols
    assert sorted([tuple(r) for r in got.documents.collect()], key=str) == want
    assert {tuple(r) for r in got.pairs.collect()} == pairs
    assert got.pairs.count() == len(pairs)


def test_empty_table(spark):
    got = ta.align(documents(spark, [(1, "x", "a", "s")]).limit(0), A, B)
    assert got.documents.count() == 0 and got.pairs.count() == 0


def test_long_groups_by_distinct_ids(monkeypatch):
    rng = random.Random(5)
    own = ta.encoders(A, B)
    some = [prose(rng, 50), "".join(rng.choice("ab01+/") for _ in range(400)), "", "y" * 900]
    usual = [ta._summed(*map(np.concatenate, zip(*ta.align_texts(some, own).links, strict=True)))]
    monkeypatch.setattr(ta, "DENSE", 2)
    monkeypatch.setattr(ta, "EXPANDED", 7)
    few = ta._summed(*map(np.concatenate, zip(*ta.align_texts(some, own).links, strict=True)))
    assert all((x == y).all() for x, y in zip(usual[0], few, strict=True))


@pytest.mark.parametrize("frame", [1, 3, 50])
def test_merge_of_runs(monkeypatch, frame):
    monkeypatch.setattr(ta, "FRAME", frame)
    rng = np.random.default_rng(6)
    runs, want = [], Counter()
    for _ in range(7):
        keys = np.sort(rng.integers(0, 40, rng.integers(0, 90))) << 13
        want.update(keys.tolist())
        frames = []
        for at in range(0, len(keys), frame):
            some, n = np.unique(keys[at:at + frame], return_counts=True)
            frames.append(ta._packed(ta._steps(some), n.astype(np.uint64)))
        runs.append(frames)
    parts = list(ta._in_frames(ta.merged(runs)))
    got = [(int(k), int(n)) for p, c in parts for k, n in zip(p, c, strict=True)]
    assert got == sorted(want.items())
    marked = [(int(k), int(n), bool(b)) for p in ta._by_side(iter(parts), 15) for k, n, b in zip(*p, strict=True)]
    most = Counter()
    for k, n in want.items():
        most[k >> 15] = max(most[k >> 15], n)
    assert marked == [(k, n, n == most[k >> 15]) for k, n in got]


def test_fast_library_equals_the_file():
    rng = random.Random(7)
    own = ta.encoders(A, B)
    assert own.fast is not None
    letters = [chr(i) for i in range(0x250)]
    for _ in range(300):
        text = "".join(rng.choice(letters) if rng.random() < 0.4 else rng.choice("ab 's\n1") for _ in range(80))
        assert own.ids_a(text).tolist() == own.library.encode(" " + text, add_special_tokens=False).ids
