from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesframe.llm import bpe, urls
from llm_helpers import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["", " ", "  a", "a  ", "a \n b", "a\n b\n\n  c ", "x<|endoftext|> y <|endoftext|>", "I'll 's 12 3½",
       "é ñ ß ª\xa0b \u2003c", "中文 字 한국어", "a \uffffb \uffff0c", "\uffff", "\x00 \x1c \x85 \u200b",
       "tab\t \tb", "😀 👩‍👩‍👧 x", "A" * 5000, "<|endof text|>"]


def brute(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_words_give_the_ids_of_the_text(text):
    ids, sizes = bpe.WordIds(bpe.vocabulary(PATH)).encode([text, None, text])
    assert ids.tolist() == brute(text) * 2 and sizes.tolist() == [len(brute(text)), 0, len(brute(text))]
    assert bpe.vocabulary(PATH).decode(ids[: sizes[0]]).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'sdl,.!1é½\xa0\u3000\uffffab<|>endoftext中")), max_size=40))
def test_words_of_any_text(text):
    ids, _ = bpe.WordIds(bpe.vocabulary(PATH)).encode([text])
    assert ids.tolist() == brute(text)


def test_plain_characters_split_like_the_tokenizer():
    vocab, chars = bpe.vocabulary(PATH), [chr(c) for c in range(33, 592) if bpe._PLAIN.fullmatch(chr(c))]
    rng = random.Random(1)
    words = ["".join(rng.choices(chars, k=6)) for _ in range(5000)] + chars
    flat, counts = vocab.encode(words)
    assert [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])] == [brute(" " + w) for w in words]


def test_documents(spark):
    rng = random.Random(2)
    texts = ODD + [None] + [" ".join(rng.choices(["the", "The,", "naïve", "x\ny", "12"], k=rng.randint(1, 300)))
                            for _ in range(100)]
    docs = documents(spark, [(i % 50, t) for i, t in enumerate(texts)], {"ids": "x", "block": "y"})
    made = bpe.encode_documents(docs.repartition(5), PATH).collect()
    want = sorted((i % 50, brute(t), t or "") for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.ids, r.decoded) for r in made) == want
    assert bpe.encode_documents(documents(spark, []), PATH).collect() == []


def test_query_digests(spark):
    from seriesframe.llm.registered import op2_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    made = op2_bpe(spark, sf).collect()
    assert len(made) == len(texts)
    for r in made:
        ids = brute(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


RULES = [("block", "net", "/"), ("allow", "a.net", "/en/"), ("block", "com", ""), ("allow", "b.com", "/x"),
         ("allow", "b.com", "/x"), ("block", "b.com", "/x"), ("block", "", "/q")]


def plain(host, path):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in RULES
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


def test_urls_against_all_rules(spark):
    rng = random.Random(3)
    found = [None, "", "no scheme", "http://", "http://NET/", "x://a.NET/en/é?q#f", "http://net", "http://net.",
             "http://a.net/en", "u://b.com/xy/z", "http://É.com/", "a://b://c.net/", "http://x/y\nz"]
    for _ in range(400):
        host = ".".join(rng.choices(["a", "b", "net", "com", ""], k=rng.randint(1, 4)))
        found.append(f"http://{host}/" + "/".join(rng.choices(["en", "x", "", "xy", "q"], k=rng.randint(0, 3))))
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(found)], "page_id long, url string, host string, rule string")
    made = {r.page_id: r for r in urls.filter_urls(pages, [urls.Rule(*r) for r in RULES]).collect()}
    for i, url in enumerate(found):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (made[i].host, made[i].path) == (host, path), url
        assert (made[i].rule, made[i].verdict) == plain(host, path), url
    assert urls.filter_urls(pages.limit(0), []).collect() == []
