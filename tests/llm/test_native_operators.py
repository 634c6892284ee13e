"""Mixing, sharding, line dedup and personal data: brute force, awkward input, plans without Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup, mixing, pii, queries, sharding
from tests.test_oracles import compare

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op2_mix_sources", "op9_line_dedup"])
def test_query_equals_sql(spark, data, name):
    from tessera.llm.oracles import oracle_sql

    compare(spark, data, name, queries.queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", ["op2_mix_sources", "op4_pii", "op5_shard_documents", "op9_line_dedup"])
def test_no_python_in_the_plan(spark, data, name, capsys):
    queries.queries()[name](spark, data).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def filled(sizes, weights, budget, cap):
    """Clamp and reshare until nothing is above its cap."""
    want, full = budget * sum(sizes), set()
    target = dict.fromkeys(range(len(sizes)), 0.0)
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = want - sum(cap * sizes[i] for i in full)
        for i in free:
            target[i] = rest * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if target[i] > cap * sizes[i]]
        for i in over:
            target[i] = cap * sizes[i]
        if not over:
            return [target[i] for i in range(len(sizes))]
        full |= set(over)


def test_mixing_targets_and_takes(awkward, awkward_rows):
    out = mixing.mix_sources(awkward).collect()
    sizes = defaultdict(int)
    for _, text, _, source in awkward_rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(order, filled([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)))
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and r.taken in (r.size * k for k in (0, 1, 2))
        taken[r.source] += r.taken
    assert len(out) == len(awkward_rows)
    for s in order:
        largest = max([len((t or "").split()) for _, t, _, x in awkward_rows if x == s])
        assert abs(taken[s] - targets[s]) <= max(1, largest / 2)
    assert sorted((r.doc_id or -1, r.taken) for r in out) == sorted((r.doc_id or -1, r.taken) for r in mixing.mix_sources(awkward.repartition(5)).collect())


def test_one_row_is_turned_over_where_an_id_repeats(spark):
    """Rows of one doc_id share their place in the order; the last correction takes one of them, not all."""
    rows = [(7, "a b c d", "x")] * 9 + [(8, "a b", "x"), (9, "a b c d e f g", "x")]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(1,), budget=1.5).collect()
    assert abs(sum(r.taken for r in out) - 1.5 * 45) <= 1


def test_mixing_of_nothing(empty, spark):
    assert mixing.mix_sources(empty).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")
    r = mixing.mix_sources(one).first()
    assert (r.size, r.taken, r.target) == (0, 0, 0)


def test_shards_are_even_whole_and_gapless(awkward, awkward_rows, empty):
    out = sharding.shard_documents(awkward).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == len(awkward_rows) and max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    by_id = {r.doc_id: r for r in out}
    assert by_id[100].size == 1 and by_id[100].text_crc32 == 0 and by_id[104].size == 3
    assert len({by_id[i].shard for i in range(200, 205)}) == 1 and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    assert sharding.shard_documents(empty).count() == 0


def test_a_hot_group_fills_few_shards(spark):
    rows = [(i, "hot" if i < 400 else f"text {i}") for i in range(800)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    counts, hot = Counter(r.shard for r in out), Counter(r.shard for r in out if r.linked > 1)
    assert set(counts.values()) == {100} and sum(hot.values()) == 400 and len([s for s in hot if hot[s] == 100]) >= 1
    only = sharding.shard_documents(spark.createDataFrame([(i, "x") for i in range(20)], "doc_id bigint, text string")).collect()
    assert sorted(Counter(r.shard for r in only).values()) == [2, 2, 2, 2, 3, 3, 3, 3]


def test_groups_fill_the_fewest_shards(spark):
    """A hot group takes as many shards as it needs, a small one stays whole, with and without rows that have no link."""

    def shards_of(texts):
        out = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
        out = out.join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id").collect()
        assert len(out) == len(texts) and set(Counter(r.shard for r in out).values()) == {len(texts) // 8}
        assert all(sorted(r.slot for r in out if r.shard == s) == list(range(len(texts) // 8)) for s in range(8))
        found = defaultdict(set)
        for r in out:
            found[r.text].add(r.shard)
        return found

    found = shards_of(["hot"] * 800 + [f"four {i // 4}" for i in range(400)] + [f"text {i}" for i in range(1200)])
    assert len(found.pop("hot")) == 3 and {len(s) for s in found.values()} == {1}
    assert len(shards_of(["hot" if i < 400 else f"text {i}" for i in range(800)])["hot"]) == 4
    assert {len(s) for s in shards_of([f"four {i // 4}" for i in range(800)]).values()} == {1}
    found = shards_of([f"three {i // 3}" for i in range(1599)] + ["text"])
    assert sum(len(s) > 1 for s in found.values()) <= 7 and max(len(s) for s in found.values()) == 2


def start_cells(spark, sizes, shards, seed=3):
    """Cells of groups, each document in a random shard; shards are equally full up to the quotas that come with them."""
    rng = np.random.default_rng(seed)
    docs = [f"g{g}" for g, n in enumerate(sizes) for _ in range(n)]
    at = rng.permutation(np.arange(len(docs)) % shards)
    count = Counter(zip(docs, at.tolist(), strict=True))
    return spark.createDataFrame([(g, s, n) for (g, s), n in count.items()], "gid string, shard int, n bigint"), [int((at == s).sum()) for s in range(shards)]


def cut(cells):
    groups = defaultdict(list)
    for (g, _), n in cells.items():
        groups[g].append(n)
    return sum(sum(ns) ** 2 - sum(n * n for n in ns) for ns in groups.values()) // 2


def propagated_twin(spark, cells, quotas, bins, rounds=20):
    """The same rounds document by document in plain Python; only the hashes come from Spark."""
    state = {(r.gid, r.shard): r.n for r in cells.collect()}
    gids = cells.select("gid").distinct()
    own = {(r.gid, r.s): r.h for r in gids.select("gid", F.explode(F.array(*[F.lit(s) for s in range(len(quotas))])).alias("s")).select("gid", "s", F.xxhash64("gid", "s").alias("h")).collect()}
    turns = {(r.t, r.gid): r.h for r in gids.select("gid", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("t")).select("gid", "t", F.xxhash64("t", "gid").alias("h")).collect()}
    told = []
    for turn in range(rounds):
        told.append(cut(state))
        want = {}
        for g in {g for g, _ in state}:
            want[g] = max((n, own[g, s], s) for (of, s), n in state.items() if of == g)[2]
        asked = Counter()
        for (g, s), n in state.items():
            if s != want[g]:
                asked[s, want[g]] += n
        load = [sum(n for (_, s), n in state.items() if s == k) for k in range(len(quotas))]
        flows = sharding.allowed_flows(dict(asked), [q - n for q, n in zip(quotas, load, strict=True)])
        if not any(flows.values()):
            break
        for g, s in sorted((c for c in state if c[1] != want[c[0]]), key=lambda c: (turns[turn, c[0]] % bins, turns[turn, c[0]], c[0])):
            for _ in range(state[g, s]):
                if flows[s, want[g]] > 0:
                    flows[s, want[g]] -= 1
                    state[g, s] -= 1
                    state[g, want[g]] += 1
        state = {c: n for c, n in state.items() if n}
    return state, told


@pytest.mark.parametrize("slack", [0, 7])
def test_propagation_against_documents_one_by_one(spark, slack):
    cells, quotas = start_cells(spark, [2, 3, 5, 2, 9, 4, 4, 30, 17, 2, 6, 3, 3, 8, 2, 2, 12], 4)
    quotas = [q + slack for q in quotas]
    found, told = sharding.propagate(cells, quotas, bins=16)
    state, twin = propagated_twin(spark, cells, quotas, 16)
    assert {(r.gid, r.shard): r.n for r in found.collect()} == state
    assert told == twin and len(told) > 1 and all(a > b for a, b in zip(told, told[1:], strict=False))


def test_flows_keep_every_shard_within_its_quota():
    rng = np.random.default_rng(8)
    for _ in range(300):
        k = int(rng.integers(2, 6))
        asked = {(i, j): int(rng.integers(0, 9)) for i in range(k) for j in range(k) if i != j and rng.random() < 0.7}
        free = rng.integers(0, 4, k).tolist()
        flows = sharding.allowed_flows(asked, free)
        assert all(0 <= flows[c] <= n for c, n in asked.items())
        for s in range(k):
            assert sum(n for (_, to), n in flows.items() if to == s) - sum(n for (of, _), n in flows.items() if of == s) <= free[s]
    assert sharding.allowed_flows({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert sharding.allowed_flows({(0, 1): 5, (1, 2): 5, (2, 0): 4}, [0, 0, 0]) == {(0, 1): 4, (1, 2): 4, (2, 0): 4}


def test_propagation_runs_on_the_tables(spark, data, monkeypatch):
    """Rounds take place at the smallest size, and each cuts fewer links than the one before."""
    seen, place = [], sharding.place_groups
    monkeypatch.setattr(sharding, "place_groups", lambda *a: seen.append(place(*a)) or seen[-1])
    out = queries.op5_shard_documents(spark, data)
    told = seen[0][1]
    assert len(told) > 1 and all(a > b for a, b in zip(told, told[1:], strict=False))
    linked = out.where("linked > 1").groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n"))
    assert linked.where("n > 1").count() == 0


def key(line):
    return line.strip(BLANK).translate(LOWER)


def test_lines_against_brute_force(spark, awkward, awkward_rows, empty):
    common = [(1000 + i, f"Head {i}\n  SHARED line\n\nbody {i}\nshared LINE \t", "en", "x") for i in range(10)]
    rows = [*awkward_rows, *common]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("kept", F.lit(1)).withColumn("pos", F.lit(2))
    seen = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(i)
    gone = {k for k, ids in seen.items() if k and len(ids) >= 10}
    assert "shared line" in gone
    want = Counter()
    for i, text, *_ in rows:
        parts = (text or "").split("\n")
        left = [x for x in parts if key(x) not in gone]
        want[i, "\n".join(left), len(parts), len(parts) - len(left)] += 1
    out = linededup.dedup_lines(docs).select("doc_id", "line_dedup.*", F.col("pos"))
    assert Counter((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in out.collect()) == want
    assert linededup.dedup_lines(empty).count() == 0


def test_runs_compact_and_answer(spark, capsys):
    runs, schema = linededup.LineRuns(spark, enough=3), "line_hash bigint, line_check bigint, doc_id bigint"
    for b in range(5):
        rows = [(h, -h, 10 * b + d) for h in range(b, b + 3) for d in range(1 + (h == 4) * 3)]
        runs.add(spark.createDataFrame(rows + rows[:2], schema))
    assert [level is not None for level in runs.levels] == [True, False, True]
    fresh = runs.new_lines(spark.createDataFrame([(4, -4, 9), (4, 5, 9), (1, -1, 9), (99, -99, 9)], schema))
    assert sorted((r.line_hash, r.line_check) for r in fresh.collect()) == [(1, -1), (4, 5), (99, -99)]
    capsys.readouterr()
    runs.levels[2].join(runs.levels[0].hint("merge"), ["line_hash", "line_check"], "left_anti").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(r.line_hash for r in runs.at_least().collect()) == [2, 3, 4]
    assert linededup.LineRuns(spark, 1).at_least().count() == 0


def test_settled_lines_are_not_counted_again(spark):
    """A batch adds nothing for a line that a run holds often enough; the answer stays."""
    runs, schema = linededup.LineRuns(spark, enough=2), "line_hash bigint, line_check bigint, doc_id bigint"
    runs.add(spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 2, 1)], schema))
    runs.add(spark.createDataFrame([(1, 1, 3), (2, 2, 3), (3, 3, 3)], schema))
    assert {(r.line_hash, r.n_docs) for run in runs.runs() for r in run.collect()} == {(1, 2), (2, 2), (3, 1)}
    assert sorted(r.line_hash for r in runs.at_least().collect()) == [1, 2]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, span):
    d = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum((2 * x - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def spans(text):
    return sorted((m.start(), i, m.end()) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if valid(k, m.group()))


TEXTS = [
    "a@b.c_d@e.f x@y z@w.q.r", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "4111 1111-1111 1111 4111111111111112", "+1 (407) 555-7710. +12 +1234567890123456", "日本 é +49 (0)30 1234567 🎉 a@b.cc",
    "1" * 5000, "a" * 50000 + "@", "+" * 3000, "", None, "a.b@c-d.e-f..g@h.i", "0 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "1.2.3.4@5.6.7.8", "é a@b.cc 1.2.3.4 " * 3000,
]


def test_base_spans_against_brute_force(spark, awkward, awkward_rows, empty):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("pii", F.lit(1)).drop("pii")
    for df, texts in ((docs, dict(enumerate(TEXTS))), (awkward.drop("pii"), {r[0]: r[1] for r in awkward_rows})):
        for r in pii.find_personal_data(df).select("doc_id", "pii.*").collect():
            got = sorted((s.start, s.kind, s.end) for k in pii.KINDS for s in r[k])
            assert got == spans(texts[r.doc_id]), r.doc_id
            assert set(got) <= {tuple(s) for s in r.spans}
    assert pii.find_personal_data(empty).count() == 0


def test_method_adds_spans_in_context_and_leaves_prose_alone(spark):
    rows = [(1, "please call me at (212) 555-0142 tomorrow"), (2, "mail john.doe (at) example (dot) com"), (3, "ip 192[.]168[.]1[.]20 is down"), (4, "order 4785380592391385 of 2019-2020 and version 1.2.3"), (5, "we met at noon. then we left"), (6, 'token = "9f14a7029c8514dfe98aba92898d323168e199da"')]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", pii.span_list(F.col("pii.spans")).alias("s"), "pii.redacted").collect()}
    assert out[1].s == "phone:18:32" and out[1].redacted == "please call me at [phone] tomorrow" and out[2].s.startswith("email:5:") and out[3].s == "ip:3:21"
    assert [out[i].s for i in (4, 5, 6)] == ["", "", ""] and out[5].redacted == rows[4][1]
    assert out[6].redacted == 'token = "[secret]"'


#: Sentences in no context of the labelled table, with what they hold.
PLANTED = [
    ("Ring (212) 555-0142 if the door is shut", "(212) 555-0142"), ("(415) 555-0199", "(415) 555-0199"), ("Reception: 212-555-0142", "212-555-0142"), ("you reach us on 040 / 123 45 67 until five", "040 / 123 45 67"),
    ("my number is 020 7946 0958", "020 7946 0958"), ("phone 2024 (212) 555-0142", "(212) 555-0142"), ("Lena's cell 0171 234567 is off", "0171 234567"), ("he wrote (030) 1234-5678 on the wall", "(030) 1234-5678"),
    ("jane.doe [at] example [dot] com is hers", "jane.doe [at] example [dot] com"), ("ask bob(at)acme.com about it", "bob(at)acme.com"), ("questions go to info {at} shop {dot} de please", "info {at} shop {dot} de"), ("otto @ beispiel.org liest mit", "otto @ beispiel.org"),
    ("blocked 192[.]168[.]1[.]20 at noon", "192[.]168[.]1[.]20"), ("traffic from 2001:db8:85a3:0:0:8a2e rose", "2001:db8:85a3:0:0:8a2e"), ("gateway 10(.)20(.)0(.)17 answered", "10(.)20(.)0(.)17"),
    ("charged to 4111.1111.1111.1111 today", "4111.1111.1111.1111"), ("5500/0055/5555/5559 was refused", "5500/0055/5555/5559"),
]
#: Sentences that hold nothing.
CLEAN = [
    "order 4785380592391385 of 2019-2020 and version 1.2.3", "we met at noon. then we left", "the years 1999-2003 10 times over", "isbn 978-3-16-148410-0", "it took 12:30:45:10:20 to load", "page 123-456 78", "a price of $1 200 300 400",
    "section 1[.]2[.]3[.]4 of the law", "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "and then 9807915762804490 of them", "invoice 2345 678901", "they looked at home. dot by dot", "see chapter 10. 11. 12. 13", "2023-01-12 14 and 2024-02-13 15", "serial (212) 555-0142",
]


def test_method_finds_planted_spans_and_leaves_clean_text_alone(spark):
    rows = [(i, text) for i, (text, _) in enumerate(PLANTED)] + [(100 + i, text) for i, text in enumerate(CLEAN)]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "pii.*").collect()}
    found = [held in {text[s.start : s.end] for s in out[i].spans} for i, (text, held) in enumerate(PLANTED)]
    assert sum(found) >= 0.9 * len(PLANTED), [t for (t, _), ok in zip(PLANTED, found) if not ok]
    wrong = [text for i, text in enumerate(CLEAN) if out[100 + i].spans or out[100 + i].secrets]
    assert len(wrong) <= 1, wrong
    assert all(r.n_added == len(r.spans) for r in out.values())  # no sentence has a base span


def test_thresholds_hold_on_forms_and_contexts_not_taught(spark):
    """Precision and recall of each kind on rows of another draw, whose form or context taught nothing."""
    model = pii.train(spark)
    rows = spark.createDataFrame(pii._labelled(2, seed=77), "part int, kind int, label int, span string, left string, right string").where("part = 1")
    p = rows.select("label", "kind", model.probability(pii.span_features(*[F.col(c) for c in ("kind", "span", "left", "right")])).alias("p"))
    hit = F.col("p") >= F.element_at(F.array(*[F.lit(x) for x in model.least]), F.col("kind") + 1)
    right = F.sum(F.when(hit, F.col("label")).otherwise(0))
    for r in p.groupBy("kind").agg((right / F.sum(hit.cast("int"))).alias("precision"), (right / F.sum("label")).alias("recall")).collect():
        assert r.precision > 0.9 and r.recall > 0.6, r


def test_overlapping_readings_leave_one(spark):
    text = "my phone is (212) 555-0142 and token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).select("pii.*").first()
    assert [text[s.start : s.end] for s in r.spans] == ["(212) 555-0142"] and [text[s.start : s.end] for s in r.secrets] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert r.redacted == 'my phone is [phone] and token = "[secret]"' and r.n_added == 1


def test_columns_of_the_operators_own_names(awkward, empty):
    """Such a column of the input gives way; a repeated run and an empty table are no different."""
    found = linededup.dedup_lines(awkward)
    assert found.columns == [*[c for c in awkward.columns if c != "line_dedup"], "line_dedup"]
    assert found.select("line_dedup.n_lines").count() == awkward.count()
    assert linededup.dedup_lines(found.drop("text").withColumn("text", F.lit("a")), out="kept").select("kept.n_lines", "line_dedup.n_lines").count() == awkward.count()
    found = pii.find_personal_data(awkward)
    assert found.columns == [*[c for c in awkward.columns if c != "pii"], "pii"] and found.select("pii.n_added").count() == awkward.count()
    assert pii.find_personal_data(empty).count() == linededup.dedup_lines(empty).count() == 0


def test_long_secrets_and_addresses_are_found_whole(spark):
    rng = np.random.default_rng(3)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    texts = [f'token = "{"".join(rng.choice(letters, n))}7" and more' for n in (40, 900, 10_000)]
    texts += [f"mail me: {'a' * 100} (at) {'b' * 80}.{'c' * 30} (dot) com", "word" * 30_000 + "!"]
    rows = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).select("doc_id", "pii.*").collect()}
    for i in (0, 1, 2):
        assert [(s.start, s.end) for s in rows[i].secrets] == [(9, len(texts[i]) - 10)], i
        assert rows[i].redacted == 'token = "[secret]" and more'
    assert [(s.start, s.end) for s in rows[3].spans] == [(9, len(texts[3]))]
    assert not rows[4].spans and not rows[4].secrets


def test_pii_digest(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op4_pii(spark, data).collect():
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans(texts[r.doc_id]))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
        assert set(base.split(",")) - {""} <= set(r.spans.split(",")) and r.n_added == len(set(r.spans.split(",")) - set(base.split(",")) - {""})
