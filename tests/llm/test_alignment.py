"""Cross-tokenizer alignment against the libraries on whole texts and loops over all token pairs."""

import hashlib
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hybridlake.llm import alignment as al
from hybridlake.llm.stored import stored

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "x\t y  \n", "tab\tand\x0bmore", "naïve café  über", "漢字 かな 한국어",
    "👩‍👩‍👧 emoji", "<|endoftext|> and </s> <s> <unk> <0x41>", "▁ marker ▁x", "nul \x00 in", " nbsp  em", "ﬁ ligature ½ ²",
    "it's they'll I'd 'tis", "1234567890 12,345.67", "https://a.b/c?d=e&f=g", "a" * 300, "word " * 400, "x y　 z", "é" * 50 + " \x1c \x85 end",
]


@pytest.fixture(scope="module")
def libraries():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """((id, start, end) of A, of B) of a whole text, or none where the bytes differ."""
    tokenizer, processor = libraries
    if not text:
        return [], []
    whole = (" " + text).encode()
    alphabet = al._byte_alphabet()
    ids = tokenizer.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(alphabet[c] for c in tokenizer.id_to_token(i))) for i in ids]
    b = [(i, bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace("▁", " ").encode())
         for i in processor.encode(text)]
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    out = []
    for side in (a, b):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(a, b):
    """(groups, links) by comparing byte ranges."""
    links, first = [], 0
    for i, s, e in a:
        while first < len(b) and b[first][2] <= s:
            first += 1
        j = first
        while j < len(b) and b[j][1] < e:
            links.append((i, b[j][0]))
            j += 1
    ends = {x[2] for x in a} & {x[2] for x in b}
    sides = []
    for side in (a, b):
        parts, held = [], []
        for i, _, e in side:
            held.append(str(i))
            if e in ends:
                parts.append(",".join(held))
                held = []
        sides.append(parts)
    groups = [f"{x}|{y}" for x, y in zip(*sides)]
    return groups, links


def check(libraries, rows, texts):
    """``rows`` are lists of output rows by text position; every column against the loops."""
    found = [brute(*tokens(libraries, t)) for t in texts]
    counts = Counter(p for _, links in found for p in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for r, t, (groups, links) in zip(rows, texts, found):
        a, b = tokens(libraries, t)
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (len(a), len(b), len(groups), len(links)), t
        assert r["count_sum"] == sum(counts[p] for p in links), t
        assert r["n_best"] == sum(counts[p] == most[p[1]] for p in links), t
        assert r["groups_sha256"] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""), t


def test_query_equals_loops(spark, sf, texts, libraries):
    rows = {r["doc_id"]: r for r in al.op11_alignment(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    check(libraries, [rows[i] for i in texts], list(texts.values()))


def full(docs, hot, **options):
    found = al.align(docs, A, B, **options)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    rows = found.withColumns({"groups_sha256": digest, "row_": F.monotonically_increasing_id()}).drop("groups")
    return al.with_link_counts(stored(rows, "t"), "row_", hot)


@pytest.mark.parametrize("hot", [0, 1, 40, al.HOT_PAIRS])
def test_odd_texts(spark, libraries, hot):
    """White space of all kinds, bytes that one side loses, special strings; the same for any number of broadcast pairs."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD + ODD[4:8])], "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in full(docs, hot).collect()}
    check(libraries, [rows[i] for i in range(len(rows))], ODD + ODD[4:8])


def test_odd_rows(spark, odd_docs, libraries):
    """NULL and repeated ids and clashing names; long texts in parts equal whole ones."""
    out = full(odd_docs, al.HOT_PAIRS)
    assert out.columns[:len(odd_docs.columns)] == odd_docs.columns
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    check(libraries, rows, [r["text"] for r in rows])
    clashing = odd_docs.withColumnsRenamed({"score": "Pairs", "row": "n_best", "ids": "groups"})
    assert full(clashing, 5).columns.count("n_best") == 1
    assert full(odd_docs.limit(0), 5).count() == 0


def test_long_texts_in_parts(libraries, monkeypatch):
    a, b = al.side(A), al.side(B)
    texts = ["one two  three four five six seven", None, "a b c d e f \x00 g h", "ünï cödé wörds änd möre", "x ▁ y z w v u"]
    whole = list(al.align_texts(al.Chunks(a, b), texts))
    monkeypatch.setattr(al, "STEP_CHUNKS", 2)
    parts = list(al.align_texts(al.Chunks(a, b), texts))
    for w, p in zip(whole, parts):
        assert (w.n_a, w.n_b, w.n_groups, w.n_links, w.groups) == (p.n_a, p.n_b, p.n_groups, p.n_links, p.groups)
        assert w.pairs.tolist() == p.pairs.tolist() and w.counts.tolist() == p.counts.tolist()
    assert whole[4].n_a == 0 and whole[0].n_a > 0
