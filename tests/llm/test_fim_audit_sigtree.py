"""Fill-in-the-middle, the filter audit and the Jaccard join against SQL and plain Python, with nulls, empties, repeats,
empty tables and columns of the operators' own names."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from coreloom.llm import audit, fim, queries, sigtree
from coreloom.llm.common import Scratch, rows_at_once

from ..oracle import compare
from .test_dedup import WORD, lower, near_copies

DOC = "doc_id long, text string, source string"
LABEL = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", ["op11_fim", "op12_filter_audit"])
def test_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


# --- fill in the middle

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": None, "char": r"(?s)."}


def units(text, unit):
    if not text:
        return []
    if unit == "word":  # a text's first unit has whatever is ahead of its second word
        at = [0] + [m.start() for m in WORD.finditer(text) if m.start() > 0]
        return [text[a:z] for a, z in zip(at, [*at[1:], len(text)])]
    return re.findall(UNITS[unit], text)


@pytest.mark.parametrize("unit", list(UNITS))
@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 16])
def test_cuts_of_any_chunk(unit, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("ab \n\té漢") for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["", "\n", "x", "a\n\n", " lead"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    draws = np.array([[rng.randrange(1 << 32) for _ in range(2)] for _ in texts])
    n, places = fim.cuts(data, offsets, draws, unit, chunk)
    for i, t in enumerate(texts):
        u = units(t, unit)
        assert n[i] == len(u) and "".join(u) == t
        assert places[i].tolist() == [len("".join(u[: d % (len(u) + 1)])) for d in draws[i].tolist()]


def brute_fim(doc_id, text):
    t, h = text or "", hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = units(t, "line")
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    if not t or re.search("<[PSM]>", t):
        return len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if h[3] % 100 < 50 else "psm", len(p), len(m), out


def test_fim_of_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", "\n", "\n\n\n", "no newline", "é\n漢字\n" * 9, "a <P> b", "ends <", "<\nS>\nx", "> <P\n>", "line\n" * 300_000, "x" * 2_000_000]
    texts += ["".join(rng.choice("ab<>\nPS") for _ in range(rng.randint(0, 60))) for _ in range(100)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5, texts[5], "s"), (None, "a\nb\nc", "s"), (None, "a\nb\nc", "s")]
    df = spark.createDataFrame(rows, DOC).withColumns({"n": F.lit("mine"), "form": F.lit(1), "_cuts": F.lit(2), "other": F.lit(3)})
    found = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text) and r.back == (r.text or "") and r.other == 3
    none = fim.transform(df, rate=0).groupBy("form").count().collect()
    assert [(r.form, r["count"]) for r in none] == [("plain", len(rows))]
    assert fim.transform(df.limit(0)).count() == 0


# --- filter audit


def brute_audit(rows, labels):
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", key(i)), key(i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": first[t] < key(i)}
        docs.append((s or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def test_audit_of_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "word " * 250, " ".join(f"w{i}" for i in range(300)), "A B C # d", "ABC DEF " * 120, " ".join(f"w{i % 40} |" for i in range(220)), "x" * 100_000]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(120)]
    rows += rows[:10] + [(5, "other text", "a"), (None, "word " * 250, "b"), (None, None, None), (None, None, "a"), (-7, "", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"mask": F.lit(1), "hash": F.lit("mine"), "part": F.lit(0), "n": F.lit(9)})
    s = Scratch(spark, "audit")
    found = audit.audit(audit.masks(docs, spark.createDataFrame(labels, LABEL).withColumn("text", F.lit("t")), s), s).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(found) == len(got) == 3 * 600 and got == brute_audit(rows, labels)
    s = Scratch(spark, "audit")
    assert audit.audit(audit.masks(docs.limit(0), spark.createDataFrame([], LABEL), s), s).count() == 0


# --- Jaccard join


def sets_of(text, k):
    w = WORD.findall(lower(text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_join(rows, k, percent):
    """(n_shingles, component) of each row, by all pairs."""
    sets = [sets_of(t, k) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            group[find(a)] = find(b)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def key(x):
    return tuple((v is None, v or 0) for v in x)


@pytest.mark.parametrize("k,percent", [(4, 85), (1, 60)])
def test_join_against_brute_force(spark, monkeypatch, k, percent):
    """Nodes of 64 sets, so that there are many, and a passage that a third of all texts share."""
    monkeypatch.setattr(sigtree, "BLOCK", 64)
    rng = random.Random(k)
    rows = [(i, t, "s") for i, t in near_copies(220, k)]
    passage = " ".join(f"common{i}" for i in range(40))
    rows += [(300 + i, passage + " " + " ".join(rng.choices("abcdefghijklmnop", k=rng.randint(0, 60))), "s") for i in range(110)]
    rows += [(i + 500, t, "s") for i, t, _ in rows[:20]] + rows[:5]
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, "one", "s"), (904, "One ", "s"), (905, "one two three", "s"), (None, rows[7][1], "s"), (None, "nobody else says this", "s"), (-4, rows[9][1].upper(), "s")]
    df = spark.createDataFrame(rows, DOC).withColumns({"set": F.lit(1), "size": F.lit("mine"), "component_id": F.lit(5)})
    got = sigtree.join(df, k, percent).collect()
    want = [(doc, *x) for (doc, *_), x in zip(rows, brute_join(rows, k, percent))]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_join_of_nothing_and_of_one_long_text(spark):
    assert sigtree.join(spark.createDataFrame([], DOC)).count() == 0
    long = " ".join(f"w{i * i % 9973}" for i in range(300_000))
    rows = [(1, long, "s"), (2, long + " end", "s"), (3, None, "s")]
    assert {r.doc_id: r.component_id for r in sigtree.join(spark.createDataFrame(rows, DOC)).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("percent", [50, 85])
def test_trees_leave_every_similar_pair(percent):
    """Dual traversal alone, each set its own class: no similar pair of a cell is pruned, and most others are."""
    rng = np.random.default_rng(percent)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate((s[: max(1, int(len(s) * f))], rng.integers(0, 1 << 63, 3, dtype=np.uint64)))) for s in sets for f in (0.7, 0.95, 1.0)]
    cell = np.sort(rng.integers(0, 3, len(sets)))
    size = np.array([len(s) for s in sets])
    order = np.lexsort((size, np.arange(len(sets)), cell))
    bits = np.stack([sigtree.bitmap(sets[i]).view(np.uint64) for i in order])
    tree = sigtree.Tree(cell[order], size[order], order.astype(np.int64), bits)
    a, b = sigtree.meet(tree, tree, percent)
    found = set(zip(order[a].tolist(), order[b].tolist()))
    half = len(sets) // 2
    left, right = (sigtree.Tree(cell[order[s]], size[order[s]], order[s].astype(np.int64), bits[s]) for s in (slice(0, half), slice(half, None)))
    p, q = sigtree.meet(left, right, percent)
    across = set(zip(order[p].tolist(), order[half + q].tolist()))
    n_similar = 0
    for x, y in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[x], sets[y]))
        if cell[x] == cell[y] and both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            n_similar += 1
            assert (x, y) in found or (y, x) in found
            if (np.flatnonzero(order == x)[0] < half) != (np.flatnonzero(order == y)[0] < half):
                assert (x, y) in across or (y, x) in across
    assert n_similar > 50 and len(found) < 0.2 * len(sets) ** 2 / 2


def test_a_large_group_of_near_copies(spark):
    """Each text differs from the base in another word; all are one class, by work in proportion to their number."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 200], f"x{i}", *base[i % 200 + 1 :]]), "s") for i in range(3000)]
    began = time.time()
    got = sigtree.join(spark.createDataFrame(rows, DOC).repartition(4)).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0] and time.time() - began < 120


@pytest.mark.parametrize("block", [16, 512])
def test_pairs_of_a_group_do_not_become_rows(spark, monkeypatch, block):
    """Copies of one text with one to four words changed, around the similarity at which they are linked: about a third of
    these have no link with most others, and thousands of pairs are linked. No table has more than a few rows for each text
    if its sets are one node or two; a unit of smaller nodes gives fewer links than it has sets."""
    monkeypatch.setattr(sigtree, "BLOCK", block)
    rng, written, put = random.Random(5), {}, Scratch.put
    base = [f"w{i}" for i in range(150)]

    def seen(self, name, df):
        out = put(self, name, df)
        written[name] = out.count()
        return out

    rows = []
    for i in range(600):
        words = base[:]
        for at in rng.sample(range(150), rng.choice([1, 2, 2, 3, 4])):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words), "s"))
    monkeypatch.setattr(Scratch, "put", seen)
    got = sigtree.join(spark.createDataFrame(rows, DOC).repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == [(doc, *x) for (doc, *_), x in zip(rows, brute_join(rows, 4, 85))]
    sets = [sets_of(t, 4) for _, t, _ in rows]
    n_similar = sum(100 * len(a & b) >= 85 * len(a | b) for a, b in itertools.combinations(sets, 2))
    most = max(n for name, n in written.items() if name not in ("met", "hopeful"))
    assert n_similar > 5000 and (block < len(rows) / 2 or most < 5 * len(rows))
    assert written["trees-links"] < written["hopeful"]


def test_links_of_a_unit_are_a_forest():
    """Of ten sets in three classes, of which all pairs but those with the last are similar, two links; none within a class."""
    common = np.arange(100, dtype=np.uint64)
    sets = [np.concatenate((common, np.array([200 + i], np.uint64))) for i in range(9)] + [common + np.uint64(1000)]
    a, b = np.triu_indices(10, 1)
    cls = np.array([0, 0, 0, 1, 1, 1, 2, 2, 2, 3])
    links = sigtree.forest(sets, cls, a, b, 85)
    assert len(links) == 2 and {frozenset((cls[x], cls[y])) for x, y in links} <= {frozenset(p) for p in ((0, 1), (0, 2), (1, 2))}
    assert sigtree.forest(sets, cls, a[:0], b[:0], 85) == []


def test_texts_go_to_python_a_few_at_a_time(spark, monkeypatch):
    """Each step of the join that hands whole texts to Python does so by ROWS rows; the session's own number is back afterwards."""
    key, found, put = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, Scratch.put

    def seen(self, name, df):
        found[name] = spark.conf.get(key)
        return put(self, name, df)

    def lengths(batches):
        for b in batches:
            yield b.assign(id=len(b))

    monkeypatch.setattr(Scratch, "put", seen)
    was = spark.conf.get(key)
    rows = [(i, " ".join(f"w{i // 3}-{k}" for k in range(60 - i % 3)), "s") for i in range(60)]
    got = sigtree.join(spark.createDataFrame(rows, DOC)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 3 * 3 for i in range(60)}
    assert {found[k] for k in ("rows", "heads-sets", "trees-sets")} == {str(sigtree.ROWS)} and spark.conf.get(key) == was
    with rows_at_once(spark, 7):
        assert spark.range(100).repartition(2).mapInPandas(lengths, "id long").agg(F.max("id")).first()[0] == 7
    with pytest.raises(ValueError), rows_at_once(spark, 7):
        raise ValueError
    assert spark.conf.get(key) == was


def test_a_row_is_read_again_once(spark, monkeypatch):
    """Tokens are dealt out by set only for the join, but for rows that repeat a doc_id and its text."""
    written, put = [], Scratch.put

    def seen(self, name, df):
        written.append(name)
        return put(self, name, df)

    monkeypatch.setattr(Scratch, "put", seen)
    texts = [" ".join(f"w{i // 2}-{k}" for k in range(60 - i % 2)) for i in range(20)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    want = {i: i // 2 * 2 for i in range(20)}
    assert {r.doc_id: r.component_id for r in sigtree.join(spark.createDataFrame(rows, DOC)).collect()} == want
    assert "heads-sets" in written and "heads-once" not in written
    got = sigtree.join(spark.createDataFrame(rows + rows[:4], DOC)).collect()
    assert len(got) == 24 and {r.doc_id: r.component_id for r in got} == want and "heads-once" in written
