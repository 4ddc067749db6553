"""Benchmark decontamination against plain loops."""

import hashlib
import re

import pytest
from pyspark.sql import types as T

from hybridlake.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    """(n_words, hit places, item ids) by comparing every window with every place."""
    doc, hit, ids = words(text), set(), set()
    places = {}
    for size in range(1, window + 1):
        for p in range(len(doc) - size + 1):
            places.setdefault(tuple(doc[p:p + size]), []).append(p)
    for item, t in items:
        w = words(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for p in places.get(tuple(w[i:i + size]), ()):
                hit |= set(range(p, p + size))
                ids.add("" if item is None else str(item))
    return len(doc), hit, sorted(ids)


def digest(ids):
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_query_equals_loops(spark, sf, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in dc.op13_decontamination(spark, sf).collect()}
    assert rows.keys() == texts.keys() and any(r["contaminated"] for r in rows.values())
    for i, text in texts.items():
        n, hit, ids = brute(text, items)
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            n, len(hit), len(ids), digest(ids), bool(hit))


ITEMS = [
    (1, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11"), (2, "ONE"), (3, None), (4, "... "), (None, "over the lazy dog"),
    (5, "a a a a a a a a a a a"), (5, "é ü"), (6, "by cc by"), (7, "one"),
    (8, "quick brown fox jumps over the lazy dog while the sun sets slowly over the quiet hills beyond us"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_words", [12, 25, dc.BLOCK_WORDS])
def test_odd_rows_and_blocks(spark, odd_docs, items, block_words):
    """Short items, items longer than a block, equal ids, NULLs, repeated rows; the same for every block size."""
    found = dc.contamination(odd_docs, items, block_words=block_words)
    assert found.columns == [*[c for c in odd_docs.columns if c != "n_words"], "n_words", "hits", "items"]
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        n, hit, ids = brute(r["text"], ITEMS)
        assert r["n_words"] == n and r["items"] == ids
        spans = [(s["start"], s["end"]) for s in r["hits"]]
        assert {i for s, e in spans for i in range(s, e)} == hit
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_removal_keeps_clean_rows(spark, odd_docs, items):
    kept = dc.decontaminated(odd_docs, items)
    assert kept.schema == odd_docs.schema
    clean = [r["text"] for r in odd_docs.collect() if not brute(r["text"], ITEMS)[1]]
    assert sorted(map(str, [r["text"] for r in kept.collect()])) == sorted(map(str, clean))


def test_empty_tables(spark, odd_docs, items):
    assert dc.contamination(odd_docs.limit(0), items).count() == 0
    rows = dc.contamination(odd_docs, items.limit(0)).collect()
    assert len(rows) == odd_docs.count() and all(r["hits"] == [] and r["items"] == [] for r in rows)


def test_longest_matches(spark, items):
    """Length and place of the longest common run, against all pairs of places."""
    docs = [(1, "say the quick brown fox jumps over the lazy dog while the sun sets now"), (2, "one fox"),
            (3, "the quick brown fox jumps over the lazy dog while the sun sets slowly here"), (None, "nothing here"), (4, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["item_id"]: r for r in dc.longest_matches(table, items).collect()}
    for item, text in ITEMS:
        w = words(text)
        best = None
        for d, t in docs:
            doc = words(t)
            for i in range(len(w)):
                for p in range(len(doc)):
                    n = 0
                    while i + n < len(w) and p + n < len(doc) and w[i + n] == doc[p + n]:
                        n += 1
                    if n >= min(10, len(w)) and (best is None or (-n, d, p, i) < best):
                        best = (-n, d, p, i)
        key = "" if item is None else str(item)
        if best:
            r = rows[key]
            assert (-r["words"], r["doc_id"], r["doc_start"], r["item_start"]) == best
        elif item != 5:
            assert key not in rows


def test_suffix_array_is_sorted():
    """Many copies and long shared runs: the array equals a plain sort of the suffixes."""
    block = dc.TestBlock([("x", [b"a", b"b", b"a", b"b", b"a", b"c"] * 9)], 3)
    shard = dc.Shard(["a b a b a c " * 30, None, "b a c a b", "a b z a b a b"] * 3, block)
    deep = [tuple(shard.words[p:p + block.deepest]) for p in shard.order]
    assert deep == sorted(deep) and len(deep) > 100
