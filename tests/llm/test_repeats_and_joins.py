import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.samples import odd_documents
from veritab.llm import op2_decontamination as op2, op7_suffix_dedup as op7, op8_signature_join as op8
from veritab.llm.common import CLEANUP, stored
from veritab.llm.components import components


# --- op2 ---
def words(text):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        for s in range(max(len(w) - 10, 0) + 1 if w else 0):
            window = w[s: s + 10]
            for p in range(len(own) - len(window) + 1):
                if own[p: p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(str(item_id))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_is_exact(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "ÉTÉ", "x9"]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, line(rnd.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(25)] + [(30, None), (31, " .. "), (2, line(12))]
    texts = []
    for i in range(30):
        inner = (rnd.choice(items)[1] or "").upper() if i % 2 else ""
        texts.append((100 + i, f"{line(rnd.choice([0, 3, 40]))}, {inner}! {line(9)}"))
    texts += [(100, texts[0][1])]
    docs = odd_documents(spark, texts).repartition(3)
    got = op2.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = sorted(map(str, [(r.doc_id, *brute_hits(r.text, items)) for r in docs.collect()]))
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256)) for r in got) == expected
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert op2.contamination(odd_documents(spark).filter("false"), items).count() == 0
    assert not any(r.contaminated for r in op2.contamination(odd_documents(spark), items.filter("false")).collect())


def test_decontamination_runs_without_python(spark):
    plan = op2.contamination(odd_documents(spark), spark.createDataFrame([(1, "a b c")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# --- op7 ---
def brute_removed(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i: i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i: i + length]] > 1:
                gone[i: i + length] = True
        out.append((len(d), int(gone.sum()), int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)),
                    hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_merged_transforms_find_all_repeats():
    rnd = random.Random(3)
    for trial in range(12):
        base = [bytes(rnd.choice(b"ab" if trial % 3 == 0 else b"abcdefgh") for _ in range(rnd.choice([500, 900]))) for _ in range(3)]
        strings = []
        for _ in range(rnd.choice([1, 5, 15])):
            s = bytearray(rnd.choice(base) if rnd.random() < 0.7 else rnd.choice([b"a", b"ab", b"abc"]) * 300)
            for _ in range(rnd.choice([0, 1, 3])):
                s[rnd.randrange(len(s))] = rnd.choice(b"xyz")
            strings.append(bytes(s[rnd.choice([0, 0, 50, 130]):][: rnd.choice([10, 399, 400, 401, 2000])]))
        seen = Counter(s[i: i + 400] for s in strings for i in range(len(s) - 399))
        for s, found in zip(strings, op7.repeated(strings, 400, rnd.choice([600, 3000, 10**6])), strict=True):
            assert found.tolist() == [seen[s[i: i + 400]] > 1 for i in range(len(s) - 399)]


def test_suffixes_without_repeats_are_not_sorted(monkeypatch):
    """Strings under one smallest hash share less than a window: only their parts that may repeat are sorted and merged."""
    rnd = random.Random(5)
    fresh = lambda n: bytes(rnd.choices(b"abcdefghijklmnop ", k=n))
    line, long = fresh(390), fresh(700)
    strings = [fresh(3000) + line + fresh(3000) for _ in range(8)] + [fresh(2000) + long + fresh(2000) for _ in range(2)]
    sizes, shard = [], op7.Shard
    monkeypatch.setattr(op7, "Shard", lambda symbol, *a: sizes.append(len(symbol)) or shard(symbol, *a))
    found = op7.repeated(strings, 400, 2000)
    seen = Counter(s[i: i + 400] for s in strings for i in range(len(s) - 399))
    assert [f.tolist() for f in found] == [[seen[s[i: i + 400]] > 1 for i in range(len(s) - 399)] for s in strings]
    assert 1400 <= sum(sizes) <= 2000
    words = [np.frombuffer(s[: len(s) // 8 * 8], np.uint64) for s in (fresh(3000), fresh(2400))]
    words = [w.tobytes() for w in (words[0], np.concatenate((words[1], words[0][100:200])))]
    assert [np.flatnonzero(f).tolist() for f in op7.repeated(words, 51, unit=op7.WORDS)] == [[*range(100, 150)], [*range(300, 350)]]


def test_numbers_are_ordered_stably():
    rng = np.random.default_rng(4)
    for keys in (rng.integers(0, 9, 1000), rng.integers(0, 2**62, 1000), np.zeros(0, np.int64), np.full(5, 2**62)):
        order, ordered = op7.in_order(keys)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and ordered.tolist() == keys[order].tolist()


def test_runs_cover_each_window_once():
    texts = ["ab" * 500, "", None, "x" * 399, "é" * 300, "".join(random.Random(1).choices("abcdef", k=3000))]
    runs = op7.runs_of(pa.array(texts), pa.array(range(len(texts)))).to_pydict()
    for doc, text in enumerate(texts):
        n = max(len((text or "").encode()) - 399, 0)
        cover = np.zeros(n, int)
        for d, off, k in zip(runs["doc_id"], runs["off"], runs["n"], strict=True):
            if d == doc:
                cover[off: off + k] += 1
        assert (cover == 1).all()


def test_suffix_dedup_is_exact(spark):
    docs = odd_documents(spark).repartition(3)
    rows = docs.collect()
    expected = sorted(str((r.doc_id, *e)) for r, e in zip(rows, brute_removed([r.text for r in rows]), strict=True))
    got = op7.removal_digest(docs).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == expected
    assert op7.removal_digest(docs.filter("false")).count() == 0


def test_no_bucket_holds_a_hot_line(spark, monkeypatch):
    """A line in many surroundings, with some repeats among them, and one long run of its own."""
    rnd = random.Random(11)
    fresh = lambda n: "".join(rnd.choices("abcdefghijklmnop ", k=n))
    line, shared = fresh(180), fresh(260)
    texts = [fresh(500) + line + (shared if i % 10 == 0 else fresh(260)) + fresh(rnd.randrange(300)) for i in range(120)]
    texts += [texts[3], "ab" * 3000, "ab" * 2500 + line + fresh(300), None, ""]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = docs.collect()
    limit, held = 20_000, Counter()
    for run in op7.runs_of(pa.array([r.text for r in rows]), pa.array(range(len(rows)))).to_pylist():
        held[run["m"]] += run["n"] + 399
    assert max(held.values()) > limit  # the line alone is more than a bucket
    monkeypatch.setattr(op7, "BUCKET_BYTES", limit)
    monkeypatch.setattr(op7, "BATCH_WINDOWS", 1000)
    asked = []
    counted = op7.counted_windows
    monkeypatch.setattr(op7, "counted_windows", lambda hot, *a: asked.append(hot.groupBy("m").count().collect()) or counted(hot, *a))
    got = op7.removal_digest(docs).collect()
    expected = sorted(str((r.doc_id, *e)) for r, e in zip(rows, brute_removed([r.text for r in rows]), strict=True))
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == expected
    assert asked and max(r["count"] for r in asked[0]) > 100


def brute_passages(texts, words=51, length=400):
    """What is left of each text without passages of ``words`` words and strings of ``length`` bytes that occur elsewhere."""
    import re
    data = [(t or "").encode() for t in texts]
    own = [[(w.start(), w.end(), w.group()) for w in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    passage = lambda w, i: tuple(x[2] for x in w[i: i + words])
    seen = Counter(passage(w, i) for w in own for i in range(len(w) - words + 1))
    strings = Counter(d[i: i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d, w in zip(data, own, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(w) - words + 1):
            if seen[passage(w, i)] > 1:
                gone[w[i][0]: w[i + words - 1][1]] = True
        for i in range(len(d) - length + 1):
            if strings[d[i: i + length]] > 1:
                gone[i: i + length] = True
        out.append(np.frombuffer(d, np.uint8)[~gone].tobytes().decode(errors="ignore"))
    return out


def test_texts_are_shuffled_after_the_repeats_are_stored(spark):
    """What finds the repeats is no part of the last query, so its shuffle files don't lie beside those of the texts."""
    docs = spark.createDataFrame([(1, "ab " * 300), (2, "ab " * 300), (3, "x")], "doc_id long, text string")
    last = op7.removal_digest(docs)
    assert len(re.findall("(?:MergeJoin|HashJoin)", last._jdf.queryExecution().executedPlan().toString())) == 1
    assert [r.n_removed > 0 for r in last.orderBy("doc_id").collect()] == [True, True, False]


# --- op8 ---
def brute_groups(sets, need):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and need[1] * len(a & b) >= need[0] * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def near_sets(rnd, rng, n):
    base = [rng.integers(0, 2**63, rnd.choice([1, 2, 5, 9, 10, 19, 30, 60, 150]), np.uint64) for _ in range(rnd.choice([1, 3, 8]))]
    for _ in range(n):
        s = base[rnd.randrange(len(base))].copy()
        if k := int(len(s) * rnd.choice([0, 0.02, 0.05, 0.06, 0.1, 0.2])):
            s[rng.choice(len(s), k, False)] = rng.integers(0, 2**63, k, np.uint64)
        yield np.unique(s[: max(1, int(len(s) * rnd.choice([1, 1, 0.92])))])


def test_signature_tree_and_keys_lose_no_link():
    rnd, rng = random.Random(0), np.random.default_rng(0)
    for _ in range(25):
        sets = list(near_sets(rnd, rng, rnd.choice([2, 10, 50, 120])))
        plain = [set(s.tolist()) for s in sets]
        flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        for need in ((90, 100), (80, 100)):
            truth, got = brute_groups(plain, need), op8.join_sets(sets, need).tolist()
            parts = lambda x: {frozenset(np.flatnonzero(np.array(x) == v).tolist()) for v in set(x)}
            assert parts(truth) == parts(got)
            half = np.arange(len(sets)) % 2  # two blocks joined apart and across give the same groups
            links = [(i, f) for own in (half == 0, half == 1) for i, f in zip(np.flatnonzero(own), np.flatnonzero(own)[op8.join_sets(
                [s for s, o in zip(sets, own, strict=True) if o], need)] if own.any() else [], strict=True)]
            links += list(enumerate(op8.join_sets(sets, need, half).tolist()))
            root = list(range(len(sets)))
            for _ in range(len(sets)):
                for i, f in links:
                    root[i] = root[f] = min(root[i], root[f])
            assert parts(root) == parts(truth)
            whose, key = op8.keys_of(flat, starts, need)
            by = {}
            for w, k in zip(whose.tolist(), key.tolist(), strict=True):
                by.setdefault(w, set()).add(k)
            for i, a in enumerate(plain):
                for j, b in enumerate(plain[:i]):
                    assert need[1] * len(a & b) < need[0] * len(a | b) or by[i] & by[j]


def test_light_and_frequent_keys_are_left_out_without_losing_a_link():
    rnd, rng = random.Random(4), np.random.default_rng(4)
    for _ in range(15):
        sets = list(near_sets(rnd, rng, rnd.choice([10, 50, 120])))
        plain = [set(s.tolist()) for s in sets]
        flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        for need in ((90, 100), (80, 100)):
            whose, key, level = (x.tolist() for x in op8.class_keys(flat, starts, need))
            spare, count, own = op8.classes(need)[3], Counter(key), {}
            for w, k, at in zip(whose, key, level, strict=True):
                own.setdefault((w, at), []).append((-count[k], k))
            by = {}
            for (w, at), keys in own.items():
                by.setdefault(w, set()).update(k for _, k in sorted(keys)[spare[at]:])
            for i, a in enumerate(plain):
                for j, b in enumerate(plain[:i]):
                    assert need[1] * len(a & b) < need[0] * len(a | b) or by[i] & by[j]


def test_sets_of_a_key_are_counted_across_batches(monkeypatch):
    rng = np.random.default_rng(6)
    for many, size in ((1 << 14, 7), (5, 3), (2, 100), (4, 1)):
        monkeypatch.setattr(op8, "MANY", many)
        rows = sorted((int(x), int(a), int(x) % 3) for x, a in rng.integers(0, 12, (150, 2)) ** 2 if x < 100 or a < 9)
        columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "a", "level"])
        got = [tuple(r.values()) for b in op8.shared(batch.slice(i, size) for i in range(0, len(batch), size)) for r in b.to_pylist()]
        count = Counter(x for x, _, _ in set(rows))
        assert got == [(*r, min(count[r[0]], many)) for r in sorted(set(rows)) if count[r[0]] > 1]


def test_documents_with_a_passage_in_common_are_no_neighbourhood(spark, monkeypatch):
    rnd = random.Random(12)
    passages = [[f"p{p}x{i}" for i in range(45)] for p in range(3)]
    texts = [[f"d{i}x{k}" for k in range(rnd.randrange(100, 140))] + passages[i % 3] + passages[(i + i // 3) % 3][:20] for i in range(150)]
    texts += [texts[0][:60] + ["other"] + texts[0][61:], texts[1][:50] + texts[1][51:]]
    docs, rows, kept = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), {}, op8.stored
    monkeypatch.setattr(op8, "MOST_COMMON", 0)  # also where passages are too rare to be among the common tokens
    monkeypatch.setattr(op8, "stored", lambda df, label: rows.setdefault(label, kept(df, label)))
    groups = {r.doc_id: r.component_id for r in op8.near_duplicates(docs, 5, (80, 100)).collect()}
    assert groups == {**{i: i for i in range(150)}, 150: 0, 151: 1}
    assert rows["neighbourhoods"].count() == 4


def test_shuffle_files_go_when_a_step_is_stored(spark):
    blocks = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toString()))
    step = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    before, rows = blocks(), stored(step, "step")
    for _ in range(50):
        if not blocks() - before:
            break
        time.sleep(0.2)
    assert not blocks() - before and spark.conf.get(CLEANUP, None) is None
    assert rows.count() == step.count() == step.count() == 10


def test_jaccard_join_of_odd_documents(spark):
    import re
    docs = odd_documents(spark).repartition(3)
    rows = docs.collect()

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i: i + 3]) for i in range(max(len(w) - 3, 0) + 1)} if w else set()

    sets = [shingles(r.text) for r in rows]
    group = brute_groups(sets, (90, 100))
    expected = []
    for r, s, g in zip(rows, sets, group, strict=True):
        ids = [x.doc_id for x, h in zip(rows, group, strict=True) if h == g and x.doc_id is not None]
        expected.append(str((r.doc_id, len(s), (min(ids) if ids else None) if s else r.doc_id)))
    got = op8.near_duplicates(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(expected)
    assert op8.near_duplicates(docs.filter("false")).count() == 0


def test_large_neighbourhoods_are_split(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(40):
        own = base[:]
        own[rnd.randrange(150)] = f"x{i}"
        texts.append((i, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(op8, "BLOCK", 7)
    assert {r.component_id for r in op8.near_duplicates(docs).collect()} == {0}


def test_components_follow_long_paths(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_each_two_blocks_meet_once(spark):
    """One of them is held where they meet; a set travels to fewer units than there are blocks."""
    for n in (1, 2, 3, 8, 9, 16, 31):
        rows = spark.range(n).selectExpr("cast(id as int) block", f"{n} blocks").select("block", F.explode(op8.meetings()).alias("m")).select("block", "m.*").collect()
        units = {}
        for r in rows:
            units.setdefault((r.i, r.u), {})[r.d] = r.block
        assert sum(map(len, units.values())) == len(rows) and all(own[0] == i for (i, _), own in units.items())
        met = sorted(tuple(sorted((i, j))) for (i, _), own in units.items() for d, j in own.items() if d)
        assert met == [(i, j) for i in range(n) for j in range(i + 1, n)]
        assert {i for i, u in units if u == 0} == set(range(n))
        assert max(map(len, units.values())) <= op8.PASSED + 1 and len(rows) <= n * (0.5 * n + n / 8 + 1.5)


def test_many_blocks_lose_no_link(spark, monkeypatch):
    rnd = random.Random(80)
    base = [f"W{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        own = base[:]
        for _ in range(rnd.randrange(1, 4)):
            own[rnd.randrange(120)] = f"x{rnd.randrange(12)}"
        texts.append(" ".join(own))
    sets = [{tuple(w[i: i + 3]) for i in range(len(w) - 2)} for w in (t.lower().split() for t in texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = brute_groups(sets, (90, 100))
    assert 1 < len(set(wanted)) < 60
    monkeypatch.setattr(op8, "BLOCK", 4)
    assert [r.component_id for r in op8.near_duplicates(docs).orderBy("doc_id").collect()] == wanted
