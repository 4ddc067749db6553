"""SentencePiece, token counts, licences and urls against the libraries and plain loops."""

import hashlib
import re

import public_tokenizers
import pytest

from hybridlake.llm import licenses, sentencepieces, token_counts, urls

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  ", "a \n b", "▁▁x▁ y", "\x00", "a" * 300 + "  " * 40 + "é漢字", "\tx <s> </s> <unk> ", "👩‍👩‍👧 ok"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(spark, documents, odd_docs, library):
    frame = documents.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = sentencepieces.encode_decode(frame, PIECES).collect()
    assert len(rows) == frame.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_eos=True) if "text" in r else None
        assert ids is None or (list(r["ids"]) == ids and r["decoded"] == library.decode(ids))


@pytest.mark.parametrize("text", ODD)
def test_odd_pieces_equal_the_library(text, library):
    assert sentencepieces.chunk_table(PIECES).encode(text) == library.encode(text, add_eos=True)


def test_sentencepiece_query(spark, sf, texts, library):
    from hybridlake.llm.queries import QUERIES

    for r in QUERIES["op2_sentencepiece"](spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_sentencepiece_keeps_columns_and_empty_tables(odd_docs):
    out = sentencepieces.encode_decode(odd_docs, PIECES)
    assert set(out.columns) == set(odd_docs.columns) - {"text"} | {"ids", "decoded"} | {"text"}
    assert sentencepieces.encode_decode(odd_docs.where("false"), PIECES).count() == 0
    assert [list(r["ids"]) for r in out.where("doc_id = 5").collect()] == [[2]]


def test_token_counts_equal_the_library(documents, odd_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    frame = documents.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    for r in token_counts.with_token_counts(frame, BYTES).collect():
        text = r["text"] or ""
        assert r["n_tokens"] == len(tokenizer.encode(text, add_special_tokens=False))
        assert r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    assert token_counts.with_token_counts(odd_docs, BYTES).columns[-3:] == ["n_bytes", "n_tokens", "over_limit"]
    assert token_counts.with_token_counts(odd_docs.where("false"), BYTES).count() == 0


@pytest.mark.parametrize("text", ODD + ["it's <|endoftext|> x<|endoftext|> y", "a \u2003 b\u0085 c \x1c d"])
def test_odd_token_counts_equal_the_library(text):
    from tokenizers import Tokenizer

    counted = token_counts.PieceCounts(BYTES).counts([text])
    assert counted == [len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False))]


def test_piece_model_counts(library):
    assert token_counts.PieceCounts(PIECES).counts(["a b", "", "x"]) == [len(library.encode(t)) for t in ("a b", "", "x")]


# --- licences -----------------------------------------------------------------------
def plain_licenses(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.split()]
              for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))


def test_licenses_equal_plain_loops(documents, odd_docs):
    frame = documents.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    for r in frame.select("text", licenses.scanned("text").alias("f")).select("text", "f.*").collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licenses(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("expression, freedom, labels", [
    ("MIT", 0.9, {"mit"}), ("mit or gpl-3.0", 0.9, {"mit", "gpl"}), ("mit and gpl-3.0", 0.4, {"mit", "gpl"}),
    ("gpl-2.0 with classpath-exception", 0.5, {"gpl"}), ("mit or gpl-3.0 and cc0-1.0", 0.9, {"mit", "gpl", "cc0"}),
    ("(mit or gpl-3.0) and lgpl-2.1", 0.5, {"mit", "gpl", "lgpl"}), ("mit or", 0.9, {"mit"}), ("(mit", 0.9, {"mit"}),
    ("mit some prose follows", 0.9, {"mit"}), ("gpl-2.0-or-later", 0.4, {"gpl"}),
])
def test_expressions(expression, freedom, labels):
    value = licenses.evaluate(expression.lower())
    assert value.freedom == pytest.approx(freedom) and value.labels == labels


@pytest.mark.parametrize("expression", ["", ")", "or mit", "()", "( or", "..."])
def test_no_expression(expression):
    assert licenses.evaluate(expression) is None


def test_tag_in_a_text(spark):
    text = "x\n# SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-4.0\nAll rights reserved"
    r = spark.createDataFrame([(text,)], "text string").select(licenses.scanned("text").alias("f")).select("f.*").first()
    assert r["labels"] == "apache,cc-by,mit,reserved" and r["base_labels"] == "cc-by,reserved" and r["score"] == 0.0
    assert r["expressions"] == ["(mit or apache-2.0) and cc-by-4.0"]


def test_long_identifiers_stay_apart():
    name = "a-rather-long-identifier-of-more-than-forty-characters"
    assert licenses.evaluate(f"{name}-1 and {name}-2").labels == {f"other:{name}-1", f"other:{name}-2"}


def test_many_tags_in_one_long_line(spark):
    text = "spdx-license-identifier: mit and then prose " * 20_000 + "spdx-license-identifier: gpl-3.0"
    r = spark.createDataFrame([(text,)], "text string").select(licenses.scanned("text").alias("f")).select("f.*").first()
    assert r["labels"] == "gpl,mit,other:then" and len(r["expressions"]) == 20_001
    assert set(r["expressions"]) == {"mit and then", "gpl-3.0"}


# --- urls -------------------------------------------------------------------------------
RULES = [("block", "net", "/"), ("allow", "a.net", "/en/"), ("block", "a.net", "/en/x"), ("allow", "b.net", ""), ("block", "b.net", "")]
URLS = ["http://a.net/en/xy", "http://A.NET/en/y?q", "http://z.a.net/en", "http://a.net", "http://ba.net/en/x", "b.net/x", None, "",
        "x://b.net:80/", "x://b.net#f/", "://net/", "http://.net/", "a://b://a.net/en/", "http://a.net/e"]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h.count("."), len(h + p), v == "block", h + p, v) for v, h, p in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("size", [200_000, 2])
def test_urls_equal_plain_loops(spark, monkeypatch, size):
    monkeypatch.setattr(urls, "RULES_PER_TRIE", size)
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    out = {r["page_id"]: tuple(r)[2:] for r in urls.judged(pages, RULES).select("page_id", "url", "host", "path", "rule", "verdict").collect()}
    assert out == {i: plain_verdict(u) for i, u in enumerate(URLS)}
    assert urls.judged(pages.where("false"), RULES).count() == 0
    assert {r["verdict"] for r in urls.judged(pages, []).collect()} == {"allow"}


def test_urls_beside_clashing_columns(spark):
    pages = spark.createDataFrame([(1, URLS[0], "x", 2)], "page_id long, url string, FOUND_RULE string, labels int")
    r = urls.judged(pages, RULES).first()
    assert (r["FOUND_RULE"], r["labels"], r["rule"], r["verdict"]) == ("x", 2, "a.net/en/x", "block")


def test_bad_rules():
    with pytest.raises(ValueError):
        urls.rule_trie([("deny", "a", "/")])
