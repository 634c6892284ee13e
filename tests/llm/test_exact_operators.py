"""Exact dedup, Merkle manifest and periodic runs against plain Python, and on awkward tables."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exactdedup, manifest, oracles, periodic, queries
from tests.test_oracles import compare

NEW = ("op11_exact_dedup", "op12_merkle_manifest", "op13_periodic_runs")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, data, name):
    compare(spark, data, name, queries.queries()[name], oracles.oracle_sql()[name])


# --- exact dedup


def test_trie_against_a_dictionary():
    rng = random.Random(5)
    for turn in range(120):
        trie, known = exactdedup.PatriciaTrie(rng.choice([300, 1000, 5000, 1 << 30])), {}
        for _ in range(rng.randint(0, 120)):
            key = bytes(rng.choices(b"ab", k=rng.choice([0, 1, 3, 8, 40, 200])))
            if known and rng.random() < 0.4:
                key = rng.choice(list(known))
                key = key[: rng.randint(0, len(key))] + bytes(rng.choices(b"ab", k=rng.randint(0, 5)))
            least, rows = rng.choice([None, *range(50)]), rng.randint(1, 3)
            trie.insert(key, least, rows)
            before, count = known.get(key, (None, 0))
            known[key] = (least if before is None else before if least is None else min(before, least), count + rows)
        found = list(trie.entries())
        assert len(found) == len(known), turn
        assert {k: (least, rows) for k, least, rows in found} == known


def test_trie_spills_and_forgets():
    trie = exactdedup.PatriciaTrie(20_000)
    for i in range(3000):
        trie.insert(f"{i % 1500:06d}".encode() * 20, i)
        assert trie.held <= 20_000 + 1000
    found = {key: (least, rows) for key, least, rows in trie.entries()}
    assert found == {f"{i:06d}".encode() * 20: (i, 2) for i in range(1500)}


def exact_twin(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 26, 2000])
def test_exact_duplicates(awkward, awkward_rows, limit):
    rows = [*awkward_rows]
    found = exactdedup.exact_duplicates(awkward, limit=limit)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == exact_twin(rows)


def test_exact_duplicates_blank_forms_nulls_and_nothing(spark, empty):
    rows = [(3, "a  b"), (2, "a\n\t b"), (4, "a b "), (None, "a b"), (None, "x"), (None, "x"), (5, None), (6, ""), (7, " "), (8, "a b")]
    found = exactdedup.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(map(tuple, found.collect()), key=str) == exact_twin(rows)
    assert exactdedup.exact_duplicates(empty).count() == 0


def test_a_hot_group_leaves_each_partition_once(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text").repartition(6)
    strings = exactdedup.exact_duplicates(docs)
    assert strings.where("group_size = 1000 and keep_id = 0").count() == 1000
    assert strings.where("group_size = 1 and kept").count() == 2000


# --- Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def paths(nodes):
    """The root of the nodes and for each the siblings (left, right) by level."""
    own, known = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, at in enumerate(own):
            start = at - at % 3
            known[k].append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + 3])))
            own[k] = at // 3
        nodes = [H("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], known


def manifest_twin(rows, shown):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: paths([key[2] for key, _ in sorted(trees[s], key=lambda t: t[0])]) for s in order}
    root, outer = paths([inner[s][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for (key, r), way in zip(sorted(trees[s], key=lambda t: t[0]), inner[s][1], strict=True):
            way = way + outer[place]
            value = leaf((*r[:4], shown(r)))
            for a, b in way:
                value = H(a + value + b)
            out.append((r[0], key[2], inner[s][0], root, H("".join(a + b for a, b in way)), value, value == root))
    return sorted(out, key=str)


def shown_text(r):
    return None if r[4] is None else r[4].replace("a", "") if (r[0] or 0) % 2 else r[4]


@pytest.mark.parametrize("step", [1, 2, 5])
def test_manifest(awkward, step):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in awkward.collect()]
    shown = F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 1, F.replace("text", F.lit("a"), F.lit(""))).otherwise(F.col("text"))
    found = manifest.merkle_manifest(awkward, shown, step=step)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == manifest_twin(rows, shown_text)


def test_manifest_of_one_row_one_source_and_nothing(spark, empty):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    for rows in ([(1, None, None, None, None)], [(1, "s", "en", 1, "a")], [(i, "s", "en", 1, "a") for i in range(4)], [(i, f"s{i}", None, 1, "a\nb") for i in range(10)]):
        found = manifest.merkle_manifest(spark.createDataFrame(rows, schema), F.replace("text", F.lit("\n"), F.lit("")), step=1)
        assert sorted(map(tuple, found.collect()), key=str) == manifest_twin(rows, lambda r: r[4] and r[4].replace("\n", ""))
    assert manifest.merkle_manifest(empty, F.col("text")).count() == 0


def test_levels_are_partitions_with_a_third_of_the_nodes(spark):
    leaves = spark.range(100).selectExpr("'t' as tree", "id as idx", "sha2(cast(id as string), 256) as node", "5 as depth")
    store = manifest.NodeStore(spark, 2)
    store.build(leaves)
    assert [store.level(k).count() for k in range(7)] == [100, 34, 12, 4, 2, 1, 0]
    assert store.roots().first().root == paths([H(str(i)) for i in range(100)])[0]
    assert "PartitionFilters: [isnotnull(level" in store.level(3)._jdf.queryExecution().toString()


# --- periodic runs


def runs_twin(x, least, times):
    found = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(2, 2), (6, 3)])
def test_runs_against_comparison_at_every_period(least, times):
    rng = random.Random(7)
    for _ in range(800):
        x = rng.choices(range(rng.choice([1, 2, 2, 3, 5])), k=rng.randint(0, 60))
        if len(x) > 4 and rng.random() < 0.5:
            a = rng.randrange(len(x))
            p = rng.randint(1, max(1, (len(x) - a) // 2))
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(len(x))]
        assert periodic.runs_of(x, least, times) == runs_twin(x, least, times), x


def test_squares_are_all_primitive_squares():
    rng = random.Random(9)
    for _ in range(200):
        x = rng.choices("ab", k=rng.randint(0, 40))
        want = {(i, h) for h in range(1, len(x) // 2 + 1) for i in range(len(x) - 2 * h + 1) if x[i : i + h] == x[i + h : i + 2 * h] and not any(h % d == 0 and x[i : i + d] * (h // d) == x[i : i + h] for d in range(1, h))}
        starts, halves = periodic.squares([ord(c) for c in x])
        found = list(zip(starts.tolist(), halves.tolist(), strict=True))
        assert len(found) == len(set(found)) and set(found) == want, x


def test_word_runs_that_need_no_tree_have_none():
    rng = random.Random(11)
    for _ in range(200):
        words = [b"%d" % rng.randrange(400) for _ in range(rng.randint(0, 200))]
        a, p = rng.randrange(len(words) + 1), rng.randint(1, 40)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        assert periodic.word_runs(words, 24, 3) == runs_twin(words, 24, 3)


def test_periodic_runs(spark, empty):
    texts = [None, "", " \t", "one", "la " * 24, "la " * 23, ("x y\n" * 12), "a b c " * 8 + "d", "é   " * 20, " ".join(map(str, range(50))) + " u v" * 20 + " w" * 30]
    texts += [" ".join(str(i % 700) for i in range(9000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "z " * 30)] * 2
    found = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(1)).repartition(3)).collect()
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = runs_twin(words, 24, 3)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in gone)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in found), key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(empty).count() == 0


def test_repeats_of_the_contract(spark):
    import zlib

    text = " ".join(f"w{i}" for i in range(97))
    docs = spark.range(200).selectExpr("id as doc_id", f"'{text}' as text")
    for r in docs.select("doc_id", queries._with_repeats(F.col("text")).alias("t")).collect():
        h, words = zlib.crc32(str(r.doc_id).encode()), text.split()
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert r.t.split() == words
