"""Fingerprints, SimHash and substring dedup against plain loops."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hybridlake.llm import components, minhash, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- MinHash --------------------------------------------------------------------------------
def plain_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, [-ord(c) for c in r[1] or ""] + [1]))
    return [(a, b) for a, b in zip(order, order[1:] + order[:1])]


def check_pairs(rows, found):
    expected = sorted(
        (repr(a[0]), len(a[1] or ""), hashlib.sha256(minhash.edited_text(a[1] or "", b[1] or "").encode()).hexdigest())
        for a, b in plain_next(rows))
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == expected


def test_fingerprint_query(spark, sf, documents):
    from hybridlake.llm.queries import QUERIES

    found = QUERIES["op1_fingerprints"](spark, sf).collect()
    check_pairs([tuple(r) for r in documents.select("doc_id", "text").collect()], found)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    by_text = {}
    for r in found:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_fingerprints_of_odd_rows(odd_docs):
    few = odd_docs.select("doc_id", "text").dropDuplicates()
    found = minhash.with_next(few).withColumn("edited_sha256", F.sha2("edited", 256)).collect()
    check_pairs([tuple(r) for r in few.collect()], found)
    assert minhash.with_next(few.where("false")).count() == 0
    one = minhash.with_next(few.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    assert minhash.with_next(odd_docs).count() == odd_docs.count()


def test_likeness_estimates_jaccard():
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    signer = minhash.Signer()
    for cut in (0, 200, 600, 1200):
        other = words[cut:] + [f"v{i}" for i in range(cut)]
        a, b = set(signer.shingles(" ".join(words))), set(signer.shingles(" ".join(other)))
        estimate = minhash.likeness(signer.signature(" ".join(words)), signer.signature(" ".join(other)))
        assert estimate == pytest.approx(len(a & b) / len(a | b), abs=0.15)


def test_near_duplicates_by_bands(spark):
    rng = random.Random(5)
    base = [[f"t{k}w{rng.randrange(400)}" for _ in range(120)] for k in range(6)]
    rows, number = [], 0
    for words in base:
        for change in range(5):
            rows.append((number, " ".join(words[:60] + [f"c{change}"] + words[60:])))
            number += 1
    rows += [(100, rows[0][1]), (None, rows[0][1]), (101, None), (102, ""), (None, "alone")]
    found = {r["doc_id"]: (r["class_id"], r["component_id"]) for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null").collect()}
    shingles = minhash.Signer().shingles
    sets = {i: set(shingles(t)) for i, t in rows if i is not None}
    for i in range(30):
        for j in range(30):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            assert alike == (i // 5 == j // 5) and (found[i][1] == found[j][1]) == alike
    assert found[100] == (0, 0) and found[101] == found[102] == (101, 101)


# --- components -----------------------------------------------------------------------------------
def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    found = {r["vertex"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    expected = {x: root(x) for x in parent}
    assert {x: found.get(x, x) for x in expected} == expected
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- SimHash ---------------------------------------------------------------------------------------
def plain_simhash(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc ids with fingerprints → smallest id reachable over links of at most 3 bits."""
    values = sorted(set(prints.values()))
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin(a ^ b).count("1") <= 3 and root(a) != root(b):
                group[root(b)] = root(a)
    least = {}
    for i, v in prints.items():
        least[root(v)] = min(i, least.get(root(v), i))
    return {i: least[root(v)] for i, v in prints.items()}


def test_simhash_query(spark, sf, texts):
    from hybridlake.llm.queries import QUERIES

    prints = {i: plain_simhash(t) for i, t in texts.items()}
    rows = QUERIES["op5_simhash"](spark, sf).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(prints)


def test_simhash_links_are_complete(spark):
    """Fingerprints around a few centres, chains of links and random ones."""
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(values)[:20]:
        at = centre
        for _ in range(15):
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                at ^= 1 << bit
            values.add(at)
    prints = dict(enumerate(sorted(values)))
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in prints.values()], "fp long")
    roots = {r["vertex"]: r["root"] for r in components.components(simhash.linked(frame)).collect()}
    found = {}
    for i, v in prints.items():
        signed = int(np.uint64(v).view(np.int64))
        found.setdefault(roots.get(signed, signed), []).append(i)
    expected = {}
    for i, c in plain_components(prints).items():
        expected.setdefault(c, []).append(i)
    assert sorted(found.values()) == sorted(expected.values())


def test_representatives_keep_one_row_each(odd_docs):
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] or 0) for r in kept.collect())
    prints = {}
    for n, r in enumerate(odd_docs.collect()):
        prints[(r["doc_id"] if r["doc_id"] is not None else 10 ** 6, n)] = plain_simhash(r["text"])
    assert len(ids) == len(set(plain_components(prints).values()))
    assert 1 in ids and 2 not in ids
    assert simhash.representatives(odd_docs.where("false")).count() == 0


# --- substrings ---------------------------------------------------------------------------------------
def plain_substrings(rows):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        if i is not None:
            for s in range(len(w) - 12):
                key = tuple(w[s:s + 13])
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        if i is not None:
            for s in range(len(w) - 12):
                if first[tuple(w[s:s + 13])] < i:
                    gone.update(range(s, s + 13))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((repr(i), len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def result(frame):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest())
                  for r in frame.collect())


def test_substring_query(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    found = result(substrings.without_repeats(documents.select("doc_id", "text")))
    assert found == plain_substrings(rows) and any(n for _, _, n, _ in found)


@pytest.mark.parametrize("hot, most, cells, flush", [
    (200, 100, 1 << 18, 2_000_000), (2, 10 ** 6, 1 << 18, 50), (3, 10 ** 6, 1 << 16, 50), (2, 10, 1 << 16, 50)])
def test_substrings_of_odd_rows(odd_docs, monkeypatch, hot, most, cells, flush):
    """Also with hot windows looked up or joined, a sketch that is full, and many partial sketches."""
    monkeypatch.setattr(substrings, "MOST_HOT", most)
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "LEAST_CELLS", cells)
    monkeypatch.setattr(substrings, "MOST_CELLS", cells)
    monkeypatch.setattr(substrings, "FLUSH", flush)
    out = substrings.without_repeats(odd_docs)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(out) == plain_substrings(rows)
    assert substrings.without_repeats(odd_docs.where("false")).count() == 0
    assert set(out.columns) == set(odd_docs.columns) | {"n_removed", "kept"}
