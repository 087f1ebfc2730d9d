"""SimHash, line dedup and quality rules against plain Python, with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from coreloom.llm import linededup, quality, sigtree, simhash
from coreloom.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_fp(text, k):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, radius):
    """Smallest id reachable over fingerprints within the radius."""
    group = {f: {f} for f in fps}
    for a in list(group):
        for b in list(group):
            if a < b and (a ^ b).bit_count() <= radius and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[a]:
                    group[x] = group[a]
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            key = id(group[f])
            least[key] = min(least.get(key, i), i)
    return [least.get(id(group[f])) for f in fps]


def near_copies(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            t = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.randint(1, 300)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, "A b"), (None, "zz"), (5, "zz"), (5, "zz"), (n + 3, "ÀÉ Straße ABC")]


def test_fingerprints_and_components(spark):
    rows = near_copies(250, 1)
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "s") for r in rows], DOC)).collect()
    fps = {r: brute_fp(r[1], 3) for r in set(rows)}
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in got) == sorted((str(r[0]), fps[r]) for r in rows)
    want = dict(zip([(r[0], fps[r]) for r in rows], classes([r[0] for r in rows], [fps[r] for r in rows], 2)))
    assert all(r.component_id == want[r.doc_id, r.fp & (1 << 64) - 1] for r in got)


def test_no_link_is_lost_at_any_radius(spark, monkeypatch):
    rng = random.Random(3)
    fps = set()
    while len(fps) < 500:
        x = rng.choice(list(fps)) if fps and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    for radius, bucket in ((2, 2048), (2, 4), (6, 2048), (6, 4), (11, 2048)):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "WIDE_BUCKET", bucket)
        monkeypatch.setattr(simhash, "PAIRS", 1000)
        edges = simhash.links(df, radius, Scratch(spark, "t")).collect()
        pairs = [(e.a & (1 << 64) - 1, e.b & (1 << 64) - 1) for e in edges]
        want = classes(range(len(fps)), fps, radius)
        group = {x: x for x in fps}

        def root(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in pairs:
            group[max(root(a), root(b))] = min(root(a), root(b))
        got = [fps.index(root(x)) for x in fps]
        assert got == want


def test_one_of_each_similar_group_stays(spark):
    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)) for _ in range(12)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    rows += [(100 + i, t.replace(" ", "  ").upper(), "s") for i, t in enumerate(base[:4])]  # equal words
    rows += [(200 + i, t + " one more tail here", "s") for i, t in enumerate(base[4:8])]
    rows += [(0, base[0], "s"), (None, base[1], "s"), (300, None, "s"), (301, "", "s")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOC).withColumn("fp", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "source", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(12), 300]
    assert simhash.one_of_each(spark.createDataFrame([], DOC)).count() == 0


def shingle_set(text, k=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("block", [1024, 3])
def test_similar_texts_are_those_by_brute_force(spark, monkeypatch, block):
    """Pairs of Jaccard similarity 0.7 to 0.95, a group that only a chain holds together, short texts."""
    monkeypatch.setattr(sigtree, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, pairs = [], []
    for k in range(160):
        base = [word() for _ in range(104)]
        n = 4 + k % 24  # words of another tail: of 100 shingles each, 100 - n are shared
        texts += [" ".join(base), " ".join(base[:-n] + [word() for _ in range(n)])]
        pairs.append((100 - n) / (100 + n))
    chain = [word() for _ in range(150)]
    texts += [" ".join(chain[i : i + 104]) for i in range(0, 44, 7)]
    texts += ["one two three four five six", "zero two three four five six", "", None, "a", "b", "a b c d e a b c d e a b c d e a", "a b c d e a b c d e"]
    sets = [shingle_set(t) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if (not union or 10 * len(sets[a] & sets[b]) >= 8 * union) and group[a] != group[b]:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert min(pairs) < 0.7 and max(pairs) > 0.9
    kept = simhash.one_of_each(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOC)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(group))


def test_radius_of_similarity():
    assert simhash.radius_of(1.0, 64, 1) == 0 and simhash.radius_of(0.8, 256, 2) > 4 * simhash.radius_of(0.8, 64, 0)


def brute_lines(rows, least=10):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    docs = {i: (t or "").split("\n") for i, t in rows}
    first = {}
    for i, ls in docs.items():
        for x in ls:
            first[key(x)] = min(first.get(key(x), i), i)
    out = {}
    for i, ls in docs.items():
        kept = [x for x in ls if len(key(x)) < least or first[key(x)] == i]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("share", [8, 1000])
def test_line_dedup(spark, monkeypatch, share):
    monkeypatch.setattr(linededup, "HOT_SHARE", share)  # 1000: nearly every line is salted
    rng = random.Random(2)
    lines = ["Common line of text", " common LINE of text\t", "short", "", "ÉCOLE de ligne", "école de ligne"] + [f"own line number {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(lines, weights=[20, 9] + [2] * 4 + [1] * 30, k=rng.randint(1, 12)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (63, "y" * 50_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], DOC).withColumn("key", F.lit(1))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in linededup.apply(df, 10).collect()}
    assert got == brute_lines(rows)
    gone = {r.doc: r.gone for r in linededup.bitmaps(df, 10).collect()}
    for i, t in rows:
        places = {p for g in gone.get(i, []) for p in range(g.start, g.start + g.n)}
        assert "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in places) == got[i][2]
        assert all(a.start + a.n < b.start for a, b in zip(gone.get(i, []), gone.get(i, [])[1:]))  # runs are whole


def test_line_dedup_of_long_texts(spark):
    """White space within a line and very many runs cost time in proportion."""
    spaces = "left" + " " * 1_000_000 + "right"
    many = [f"own line of text number {i}" if i % 2 else "a line that is everywhere" for i in range(200_000)]
    rows = [(1, "a line that is everywhere", "s"), (2, spaces, "s"), (3, " " + spaces.upper() + "\t", "s"), (4, "\n".join(many), "s")]
    linededup.apply(spark.createDataFrame(rows[:1], DOC)).collect()
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in linededup.apply(spark.createDataFrame(rows, DOC)).collect()}
    assert time.time() - began < 30
    assert got[2] == (1, 0, spaces) and got[3] == (1, 1, "") and got[4] == (200_000, 100_000, "\n".join(many[1::2]))


def test_line_dedup_of_nothing(spark):
    assert linededup.apply(spark.createDataFrame([], DOC)).count() == 0
    rows = linededup.apply(spark.createDataFrame([(None, "a long enough line", "s"), (1, "a long enough line", "s")], DOC)).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: "a long enough line", None: ""}


def test_quality_counts(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)] + ["#", "$x&"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))).replace("w3 ", "w3\n") for _ in range(60)] + [None, "", "a b c d e f g h " * 9, "é" * 30_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOC).withColumns({"kept": F.lit(7), "words": F.lit(1)})
    for r in quality.judge(df).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        full = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        again = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_quality_drops_lines_then_documents(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) for i in range(6))
    prose = prose.replace("\n", ".\n") + "."
    menu = "Home | About | Contact | Shop | Login"
    rows = [(1, prose, "s"), (2, prose + "\n" + menu, "s"), (3, prose[:160] + ("\n" + menu) * 9 + "\nAll rights reserved", "s")]
    got = {r.doc_id: (r.kept, r.clean_text, r.n_lines_failed) for r in quality.judge(spark.createDataFrame(rows, DOC)).collect()}
    bad = ["Mentions légales", "LEER MÁS...", "Diese Seite verwendet Cookies, ja.", "of of of of of the the the the and and.", "Chapter One"]
    good = ["", "Yes.", "He said that that was so", "“Well”", "one two three four five six", "no: no, no."]
    fails = [r.f for r in spark.createDataFrame([(x,) for x in bad + good], "x string").select(quality.line_fails(F.col("x")).alias("f")).collect()]
    assert fails == [True] * len(bad) + [False] * len(good)
    assert got[1] == (True, prose, 0) and got[2] == (True, prose, 1) and got[3][0] is False
    assert hashlib.sha256(got[1][1].encode()).digest() == hashlib.sha256(prose.encode()).digest() and np.isfinite(got[3][2])


def test_shuffles_of_a_step_go_with_it(spark):
    """Near-dedup takes a step for each fingerprint; the disk is not to hold the shuffles of all."""
    def held():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {n for i in range(blocks.size()) if (n := blocks.apply(i).name()).startswith("shuffle_")}

    before, scratch = held(), Scratch(spark, "freed")
    for k in range(3):
        rows = scratch.put(f"step-{k}", spark.range(1000).repartition(5, "id").groupBy(F.col("id") % 7).count())
        assert len(rows.collect()) == 7
    until = time.time() + 20
    while time.time() < until and held() - before:  # files go a little later
        time.sleep(0.2)
    assert not held() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
