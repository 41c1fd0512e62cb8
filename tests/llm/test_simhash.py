import random
import re

import xxhash

from aislemetrics.llm import simhash
from aislemetrics.llm.components import component_roots
from aislemetrics.llm.queries import QUERIES


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def brute_components(prints):
    """Smallest id reachable, by id, of fingerprints by id."""
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_whole_table(spark, folder, documents):
    prints = {i: brute_fingerprint(text) for i, text in documents.items()}
    groups = brute_components(prints)
    for row in QUERIES["op6_simhash_groups"](spark, folder).collect():
        assert (row.fingerprint, row.component_id) == (f"{prints[row.doc_id]:016x}", groups[row.doc_id])


def test_divided_buckets_give_the_same_components(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 150:  # a chain of near prints, many sharing two blocks
        seed = rng.choice(sorted(prints))
        for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
            seed ^= 1 << bit
        prints.add(seed)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    by_id = dict(enumerate(sorted(prints)))
    expected = brute_components(by_id)
    frame = spark.createDataFrame([(signed(p),) for p in by_id.values()], "fp long")
    ids = {signed(p): i for i, p in by_id.items()}
    for divide in (0, 3, 1_000):
        links = [(r.a, r.b) for r in simhash.close_links(frame, divide).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and a != b for a, b in links)
        pairs = spark.createDataFrame(links, "a long, b long")
        roots = {r.node: r.root for r in component_roots(pairs).collect()}
        found = {}
        for print_, i in ids.items():
            found.setdefault(roots.get(print_, print_), []).append(i)
        assert {i: min(group) for group in found.values() for i in group} == expected


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 200), (None, 3)]
    roots = {r.node: r.root for r in component_roots(spark.createDataFrame(edges + edges, "a long, b long")).collect()}
    groups = {}
    for node, root in roots.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(min, groups.values())) == [0, 100, 200] and sorted(map(len, groups.values())) == [1, 40, 61]
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r.fp == 0]
    assert {r.component_id for r in zero} == {1} and len(zero) == 4  # null and empty texts are one group
    lone = [r for r in rows if r.doc_id is None and r.fp]
    assert [r.component_id for r in lone] == [None]
    kept = simhash.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:4]) for r in kept.collect())[:2] == [(0, "mail"), (1, "")]
    assert kept.where("doc_id = 5").count() == 1
    assert kept.where("doc_id in (2, 3)").count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.first_of_each(no_docs).count() == 0


def test_columns_stay_as_they_are(odd_docs):
    kept = simhash.first_of_each(odd_docs)
    assert kept.dtypes == odd_docs.dtypes
    found, given = kept.collect(), odd_docs.collect()
    assert found and all(row in given for row in found)


def test_texts_are_shuffled_once(spark, odd_docs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.first_of_each(odd_docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # the texts, and the narrow rows of the choice


def test_very_long_text_in_runs(monkeypatch):
    text = " ".join(str(i * i) for i in range(3_000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_RUN", 100)
    assert simhash.fingerprint(text.encode()) == whole == signed(brute_fingerprint(text))
