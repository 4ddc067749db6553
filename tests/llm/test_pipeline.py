"""Every stage of the pipeline against plain loops, on odd rows and on the test table."""

import re
from collections import defaultdict

import corpus_pipeline as cp
import pytest
import sentencepiece
import public_tokenizers

from hybridlake.llm import simhash

SPACE = re.compile("[^\x20\x09-\x0d]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def groups_of(prints, bits=3):
    """Components over all pairs of fingerprints."""
    root = {p: p for p in set(prints)}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    different = sorted(root)
    for i, a in enumerate(different):
        for b in different[i + 1:]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= bits:
                root[find(b)] = find(a)
    return {p: find(p) for p in different}


def test_simhash_stage_keeps_the_first_of_each_group(spark, documents, texts):
    prints = {i: simhash.fingerprint_of(t, 3) for i, t in texts.items()}
    group = groups_of(list(prints.values()))
    least = defaultdict(list)
    for i, p in prints.items():
        least[group[p]].append(i)
    kept = cp.simhash_stage(spark, documents, None)
    assert kept.columns == documents.columns
    rows = by_id(kept)
    assert set(rows) == {min(ids) for ids in least.values()} and len(rows) < len(texts)
    assert all(rows[i]["text"] == texts[i] for i in rows)


def test_simhash_stage_on_odd_rows(spark, odd_docs):
    """One row of each group: equal ids and texts, NULL ids and texts, clashing names."""
    rows = cp.simhash_stage(spark, odd_docs, None).collect()
    found = odd_docs.collect()
    group = groups_of([simhash.fingerprint_of(r["text"], 3) for r in found])
    assert len(rows) == len(set(group.values()))
    assert {group[simhash.fingerprint_of(r["text"], 3)] for r in rows} == set(group.values())
    assert cp.simhash_stage(spark, odd_docs.limit(0), None).count() == 0


def windows(words):
    return [tuple(words[i:i + 13]) for i in range(len(words) - 12)]


def test_substring_stage_removes_what_an_earlier_document_holds(spark, documents, texts):
    first = {}
    for i in sorted(texts):
        for w in windows(SPACE.findall(texts[i] or "")):
            first.setdefault(w, i)
    rows = by_id(cp.substring_stage(spark, documents, None))
    assert rows.keys() == texts.keys()
    changed = 0
    for i, text in texts.items():
        words = SPACE.findall(text or "")
        gone = {p + j for p, w in enumerate(windows(words)) if first[w] < i for j in range(13)}
        left = " ".join(w for p, w in enumerate(words) if p not in gone) if gone else text
        assert rows[i]["text"] == left
        if gone:
            changed += 1
            assert rows[i]["n_chars"] == len(left)
    assert changed


def test_mixing_stage_takes_rows_of_every_source_near_its_target(spark, documents):
    rows, whole = cp.mixing_stage(spark, documents, None).collect(), documents.collect()
    size = lambda r: len(SPACE.findall(r["text"] or ""))
    of = defaultdict(int)
    taken = defaultdict(int)
    for r in whole:
        of[r["source"]] += size(r)
    copies = defaultdict(int)
    for r in rows:
        taken[r["source"]] += size(r)
        copies[r["doc_id"]] += 1
    weights = dict(zip(sorted(of, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(of)))
    total, target, open_ = sum(of.values()), {}, set(of)
    while open_:  # what passes three times its source is shared again
        rest = total - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * of[s]}
        target |= {s: 3.0 * of[s] for s in full} if full else share
        open_ = open_ - full if full else set()
    largest = max(map(size, whole))
    for s in of:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], largest), s
    assert max(copies.values()) <= 3
    assert cp.mixing_stage(spark, documents, None).columns == documents.columns


def test_sentencepiece_stage_equals_the_library(spark, odd_docs):
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in odd_docs.where("doc_id in (1, 4, 5, 6, 8, 9)").collect()}
    rows = by_id(cp.sentencepiece_stage(spark, odd_docs.where("doc_id in (1, 4, 5, 6, 8, 9)"), None))
    for i, text in texts.items():
        ids = processor.encode(text or "", add_eos=True)
        assert (rows[i]["n_tokens"], rows[i]["ids"], rows[i]["decoded"]) == (len(ids), ids, processor.decode(ids))


@pytest.mark.parametrize("stage", [cp.simhash_stage, cp.substring_stage, cp.mixing_stage, cp.sentencepiece_stage])
def test_stages_take_odd_and_empty_tables(spark, odd_docs, stage):
    assert stage(spark, odd_docs.limit(0), None).count() == 0
    assert stage(spark, odd_docs, None).count() > 0


def test_toxicity_stage_keeps_whole_rows_and_drops_toxic_ones(spark, sf, documents):
    """What goes is what the query marks; everything else stays as it is."""
    from hybridlake.llm.toxicity import op3_toxicity

    marked = {r["doc_id"] for r in op3_toxicity(spark, sf).where("predicted = 1").collect()}
    rows = by_id(cp.toxicity_stage(spark, documents, sf))
    whole = by_id(documents)
    assert set(rows) == set(whole) - marked and all(rows[i] == whole[i] for i in rows)
