"""Packing, token counts and byte-level BPE against the public libraries."""

import array
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from ninefold.llm import bpe, counts, packing
from ninefold.llm.common import rank_encoding, vocabulary, words_with_space


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def check_packing(rows, texts, tokenizer, capacity=1024):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) // 4 <= capacity
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for key, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[key], key=lambda r: (r["piece"], r["start"]))
        copies = sum(r["piece"] == 0 for r in mine)
        assert b"".join(r["ids"] for r in mine[::copies]) == array.array("I", ids).tobytes()
        assert [r["length"] for r in mine[::copies]][1:] == [capacity] * (len(mine) // copies - 1) or len(ids) <= capacity
    return bins


def test_packing_real(docs, tokenizer):
    rows = packing.pack_documents(docs).collect()
    bins = check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, tokenizer)
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.02 * -(-total // 1024) + 2


def test_packing_odd(odd_docs, tokenizer):
    rows = packing.pack_documents(odd_docs).collect()
    check_packing(rows, {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"]}, tokenizer)
    assert packing.pack_documents(odd_docs.limit(0)).count() == 0
    first = packing.op1_columns(packing.pack_documents(odd_docs)).filter("doc_id = 2").collect()
    assert [(r["length"], r["ids_crc32"]) for r in first] == [(1, zlib.crc32(array.array("I", [2]).tobytes()))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=200), st.integers(1, 6))
def test_best_fit_bins(lengths, open_bins):
    packer = packing.BestFit(16, open_bins)
    closed = [b for i, n in enumerate(lengths) if (b := packer.add(n, (i, n))) is not None]
    assert packer.open <= open_bins
    closed += packer.rest()
    assert sorted(i for b in closed for i, _ in b) == list(range(len(lengths)))
    assert all(sum(n for _, n in b) <= 16 for b in closed)


def test_best_fit_takes_the_tightest_bin():
    packer = packing.BestFit(10, 5)
    for n, name in ((4, "a"), (7, "b")):
        assert packer.add(n, name) is None
    assert packer.add(3, "c") == ["b", "c"]
    assert packer.add(6, "d") == ["a", "d"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_cut_words_encode_like_the_whole(text):
    words = words_with_space(text)
    ranks = rank_encoding(vocabulary("byte_bpe_50k.tiktoken"))
    if words is not None:
        assert [i for w in words for i in ranks.encode_ordinary(w)] == ranks.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x3FF, blacklist_categories=("Cs",)), max_size=80))
def test_splitter_is_the_public_pattern(text):
    import public_tokenizers
    import regex

    assert bpe._splitter()(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_bpe(docs, odd_docs):
    ranks = rank_encoding(vocabulary("byte_bpe_50k.tiktoken"))
    both = docs.select("doc_id", "text").limit(60).union(odd_docs.select("doc_id", "text"))
    texts = both.collect()
    found = bpe.encode_documents(both.selectExpr("doc_id", "text", "1 AS ids", "2 AS block")).collect()
    expected = [(r["doc_id"], array.array("I", ranks.encode_ordinary(r["text"] or "")).tobytes(), (r["text"] or "").encode()) for r in texts]
    assert sorted(map(repr, ((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in found))) == sorted(map(repr, expected))
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_long_words(spark, monkeypatch):
    """Words over the lengths at which they are cut, folded or left to the public encoder."""
    import random

    monkeypatch.setattr(bpe, "LONGEST", 300)
    r = random.Random(3)
    texts = ["x" * n for n in (63, 64, 65, 299, 300, 301, 5000)] + ["".join(r.choices("ACGT", k=n)) for n in (80, 290, 900)]
    texts += ["漢字仮名交じり文" * 40, "ДлинноеСловоБезПробелов" * 30, "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(2000)), "🙂" * 200, " " * 500 + "a", "!?" * 400, "é" * 333]
    ranks = rank_encoding(vocabulary("byte_bpe_50k.tiktoken"))
    found = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(found) == len(texts)
    for row in found:
        text = texts[row["doc_id"]]
        assert list(array.array("I", bytes(row["ids"]))) == ranks.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()


def test_words_fold_alike_in_small_blocks_and_parts(docs, monkeypatch):
    """Documents over many blocks and words over many parts come out as in one."""
    few = docs.select("doc_id", "text").limit(80).coalesce(1)
    whole = {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_documents(few).collect()}
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(bpe, "PART_BYTES", 9_000)
    assert whole == {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_documents(few).collect()}


def test_counts_match_the_public_unigram_model(docs, odd_docs):
    pieces = counts.unigram_vocabulary(vocabulary("piece_bpe_32k.model"))
    model = models.Unigram([("<unk>", 0.0), *pieces], 0, False)
    counter = counts.Counter(pieces)
    for r in docs.limit(40).collect():
        text = "".join(c for c in (r["text"] or "") if c in counter.known or c == " ")
        marked = counts.SPACE + text.replace(" ", counts.SPACE)
        assert counter(text) == (len(Tokenizer(model).encode(marked, add_special_tokens=False).ids) if text else 0)
    rows = {r["doc_id"]: r["n_tokens"] for r in counts.count_tokens(odd_docs).collect()}
    assert rows[1] == rows[2] == 0 and rows[6] > 3000 and len(rows) == 10
    assert counts.count_tokens(odd_docs.limit(0)).count() == 0


def brute(text, pieces):
    """Every path, best score first, then the one whose last pieces start first."""
    scores = dict(pieces)
    floor = min(scores.values()) - counts.UNKNOWN_PENALTY
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        top = None
        for start in range(end):
            word = text[start:end]
            options = [(scores[word], 1)] if word in scores else []
            if end - start == 1 and word not in scores:
                options.append((floor, len(word.encode())))
            for s, n in options:
                if top is None or best[start][0] + s > top[0]:
                    top = (best[start][0] + s, best[start][1] + n)
        best.append(top)
    return best[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé", max_size=14))
def test_counts_with_ties(text):
    pieces = [("a", -1.0), ("b", -1.0), ("c", -2.0), ("ab", -2.0), ("bc", -3.0), ("abc", -4.0), ("ca", -2.0), ("aa", -2.0)]
    assert counts.Counter(pieces).run(text) == brute(text, pieces)
