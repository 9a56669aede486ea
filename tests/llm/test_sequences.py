"""Brute force and edges of the prefix trie, of repeated text and of collocations."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


def trie_by_force(rows):
    conv = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    nodes, seqs = collections.defaultdict(list), {}
    own = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
        for k in range(len(seqs[c]) + 1):
            nodes[seqs[c][:k]].append(c)
    kids = collections.Counter(n[:-1] for n in nodes if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in nodes.items():
        for k in range(len(n) + 1):
            saved[n[:k]] += (len(m) - 1) * len(n[-1][1]) if n else 0
            leaves[n[:k]] += not kids[n]
    ends = {n: ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(n)))) for n, m in nodes.items()}
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in nodes.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_brute_force(spark, seed):
    from cellweave.llm.prefix_trie import conversation_trie

    draw = random.Random(seed)
    rows = [(draw.choice([0, 100]) + draw.randrange(40), draw.choice([None, *range(9)]), draw.choice([None, "user", "bot"]), draw.choice([None, "", "a", "héé", "a b"])) for _ in range(300)]
    rows += [(7, k, "user", "again") for k in range(500)] + [(108, k, "user", "again") for k in range(499)]  # long ones
    rows += rows[:20] + [(None, 1, "user", "lost"), (205, 0, "user", "alone"), (1 << 60, 0, "user", "far")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("x"), "node": F.lit(1), "piece": F.lit(2), "turns": F.lit(3)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that prefixes cross partitions
    try:
        got = conversation_trie(table).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == trie_by_force(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    from cellweave.llm.prefix_trie import conversation_trie, trie

    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    none = spark.createDataFrame([(5, []), (3, [])], "conv_id long, turns array<struct<place:int,name:string,chars:int>>")
    assert [tuple(r) for r in trie(none).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_extents_are_those_of_a_scan():
    from cellweave.llm.prefix_trie import extents, least_in, minima

    draw = np.random.default_rng(5)
    lcp = draw.integers(0, 4, 37)
    lcp[0] = 0
    at, depth = np.repeat(np.arange(37), 4), np.tile(np.arange(1, 5), 37)
    left, right = extents(minima(lcp), at, depth)
    for i, d, a, b in zip(at, depth, left, right, strict=True):
        x = y = int(i)
        while x > 0 and lcp[x] >= d:
            x -= 1
        while y + 1 < 37 and lcp[y + 1] >= d:
            y += 1
        assert (a, b) == (x, y)
    assert least_in(minima(lcp), left, right).tolist() == [min(lcp[a : b + 1]) for a, b in zip(left, right, strict=True)]


def repeats_by_force(rows, length=100):
    """rows: (order key, text bytes), without rows that are alike; text and remaining bytes by key."""
    seen, out = set(), {}
    for key, b in sorted(rows):
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                covered[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        out[key] = bytes(x for x, c in zip(b, covered, strict=True) if not c), sum(covered)
    return out


def planted_texts(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgé", k=draw.randint(2, 9)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(5)]
    texts = ["x" * 5000, "x" * 99, "x" * 100, "", None, "\0" * 400, passages[0][:100], "ab" * 300 + "é" * 200]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(draw.randint(1, 60))) for _ in range(3)]
        parts.insert(draw.randrange(3), draw.choice(passages))
        cut = draw.choice(passages)
        parts.append(cut[draw.randrange(80) :][: draw.randint(60, 200)])
        texts.append("".join(parts))
    texts += draw.choices(texts, k=10)
    texts += [t[: len(t) // 2] + "!" + t[len(t) // 2 :] for t in texts if t and len(t) > 300][:10]
    return texts


@pytest.mark.parametrize("unit,seen", [(2_000_000, 64), (300, 4)])
def test_repeats_match_brute_force(spark, monkeypatch, unit, seen):
    """At the usual size, and with many buckets and many anchors taken for frequent ones."""
    from cellweave.llm import packed
    from cellweave.llm import repeated_text as R

    monkeypatch.setattr(packed, "UNIT", unit)
    monkeypatch.setattr(R, "LEAST_SEEN", seen)
    monkeypatch.setattr(R, "SAMPLED", 1 if seen < 64 else 16)
    texts = planted_texts(3)
    draw = random.Random(4)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[20]), (None, texts[21] + "."), (None, None), (5, texts[22]), (9, texts[30]), (-3, texts[31])]
    draw.shuffle(rows)
    rows += rows[10:14]  # alike in all
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "tie", "part", "kind", "data", "spans", "kept", "id")})
    keys = {(r.doc_id, r.text): ((r.doc_id is not None, r.doc_id or 0, r.tie), (r.text or "").encode()) for r in table.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    force = repeats_by_force(set(keys.values()))
    want = collections.Counter()
    for row, n in collections.Counter(rows).items():
        kept, gone = force[keys[row][0]]
        b = keys[row][1]
        want[row[0], kept, gone] += 1
        want[row[0], b"" if len(b) >= 100 else b, len(b) if len(b) >= 100 else 0] += n - 1
    got = collections.Counter((r.doc_id, bytes(r.kept), sum(s.bytes for s in r.spans)) for r in R.remove_repeats(table).collect())
    assert got == +want


def test_repeats_of_nothing(spark):
    from cellweave.llm.repeated_text import remove_repeats

    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [(r.doc_id, r.spans, bytes(r.kept)) for r in remove_repeats(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, [], b"")]


def test_long_text_in_blocks(spark):
    from cellweave.llm.repeated_text import BLOCK, remove_repeats

    draw = random.Random(9)
    own = "".join(draw.choices("abcdefgh ", k=2 * BLOCK + 500))
    again = own[BLOCK - 300 : BLOCK + 300]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in remove_repeats(spark.createDataFrame([(1, own), (2, "--" + again + "--")], "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(2, 600)]}


def test_previous_factors_match_a_scan():
    from cellweave.llm.repeated_text import previous_factors, smaller

    draw = np.random.default_rng(2)
    place = draw.permutation(60)
    for step in (-1, 1):
        for i, to in enumerate(smaller(place, step)):
            before = [j for j in (range(i - 1, -1, -1) if step < 0 else range(i + 1, 60)) if place[j] < place[i]]
            assert to == (before[0] if before else -1)
    strings = draw.integers(97, 99, (60, 12), dtype=np.uint8)
    common = lambda a, b: next((k for k in range(12) if a[k] != b[k]), 12)
    want = [max((common(strings[i], strings[j]) for j in range(60) if place[j] < place[i]), default=0) for i in range(60)]
    assert previous_factors(strings, place).tolist() == want


def phrases_by_force(rows, least, longest=4):
    total, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^ \t]+", p)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    gone = {(lang, w[i : i + m]) for (lang, w), v in f.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * v >= 80 * f[lang, w[i : i + m]]}
    by = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and (lang, w) not in gone:
            s, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by[lang].append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, v in by.items() for i, (s, a, p, left, right) in enumerate(sorted(v)))


@pytest.mark.parametrize("bits", [27, 7])
def test_collocations_match_brute_force(spark, monkeypatch, bits):
    """With a filter that lets little through by chance, and with one that lets nearly all through."""
    from cellweave.llm import phrases as P

    draw = random.Random(6)
    words = ["ab", "Ab", "cd", "é", "ÉÉ", "x\x0by", "new", "york", " q", "日本"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "!"]) for _ in range(draw.randrange(80)))
    rows = [(draw.choice(["en", "de", None]), text()) for _ in range(150)] + [("en", None), (None, ""), ("en", "ab cd " * 400)] + [("fr", "only once")] + [("en", "new york city is big")] * 5
    table = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("n", "phrase", "f", "a", "rank", "score")})
    plain = P.frequent
    monkeypatch.setattr(P, "frequent", lambda docs, least, longest: plain(docs, least, longest, 8, bits))
    got = sorted(map(tuple, P.collocations(table, least=5).collect()))
    assert got == phrases_by_force(rows, 5)


def test_border_failures_are_followed_up(spark):
    """The sample holds no text with the phrase, so that every part of it is a failure first."""
    from cellweave.llm.phrases import SAMPLED, frequent

    rows = spark.range(400).select(F.concat(F.lit("far out here now. "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) != 0)
    got = {r.phrase: r.f for r in frequent(rows, 30).where("n > 0").collect()}
    n = rows.count()
    words = "far out here now".split()
    assert got == {" ".join(words[a:b]): n for a in range(4) for b in range(a + 1, 5)}


def test_collocations_of_nothing_and_long_text(spark):
    from cellweave.llm.phrases import BLOCK, collocations, frequent

    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    n = BLOCK // 8 + 5
    got = {r.phrase: r.f for r in frequent(spark.createDataFrame([("en", "aaa bbb." * n)], "lang string, text string")).collect()}
    assert got == {"": 2 * n, "aaa": n, "bbb": n, "aaa bbb": n}


def test_unrelated_sets_share_no_signature():
    """20,000 sets of 20 to 39 shingles without a common one: empty segments are no signature, so hardly any is held twice."""
    from cellweave.llm.jaccard_join import allocate, band, signatures

    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in draw.integers(20, 40, 20_000)]
    plan = allocate(dict(zip(*np.unique(band(np.array([len(s) for s in sets])), return_counts=True), strict=True)))
    sig, rec = signatures(sets, np.arange(len(sets)), plan)
    _, held = np.unique(np.stack([sig, rec["group"].astype(np.uint64)]), axis=1, return_counts=True)
    assert held.max() <= 3


@pytest.mark.parametrize("deletions", [False, True])
def test_linked_small_sets_share_a_kept_signature(deletions):
    """Every linked pair shares one after both have left out any of as many as they may, for sets of 1 to 24 shingles."""
    from cellweave.llm.jaccard_join import band, most_apart, signatures

    draw = np.random.default_rng(7)
    for size in range(1, 25):
        for _ in range(60):
            a = draw.integers(0, 1 << 63, size).astype(np.uint64)
            gone = int(draw.integers(0, size // 7 + 1))
            b = np.concatenate([a[gone:], draw.integers(0, 1 << 63, gone).astype(np.uint64)])
            sets = [np.unique(a), np.unique(b)]
            both = len(np.intersect1d(*sets))
            if 100 * both < 75 * (len(sets[0]) + len(sets[1]) - both):
                continue
            plan = {g: (((h + 2) // 2, 0, True) if deletions and h else (h + 1 + (h + 1) // 2, (h + 1) // 2, False)) for g in range(int(band(size)) + 2) for h in [most_apart(g)]}
            sig, rec = signatures(sets, np.arange(2), plan)
            keys = [{(int(r["group"]), int(s)): int(r["spare"]) for s, r in zip(sig, rec, strict=True) if r["set"] == k} for k in (0, 1)]
            # Each may leave out `spare` signatures of a group, so more than that must be common in one of the groups.
            common = collections.Counter(k[0] for k in keys[0].keys() & keys[1].keys())
            assert any(n > max(keys[0][k], keys[1][k]) for g, n in common.items() for k in [next(x for x in keys[0].keys() & keys[1].keys() if x[0] == g)]), size


def test_deduplicate_and_judge_keep_columns_of_any_name(spark):
    from cellweave.llm.jaccard_join import deduplicate
    from cellweave.llm.quality_rules import judge

    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "h", 7, "a"), (2, text, "h", 8, "b"), (3, "quite other words stand in this text here and there now", None, 9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, keep string")
    for a, b in (("_row", "_hit"), ("row.x", "_host"), ("Hit", "_w"), ("_keep", "_lines"), ("at", "root")):
        own = docs.withColumnRenamed("row", a).withColumnRenamed("keep", b)
        got = deduplicate(own)
        assert got.columns == own.columns and sorted(tuple(r)[3:] for r in got.collect()) == [(7, "a"), (9, "c")]
        if "." not in a:
            assert sorted((r[a], r[b], r.kept) for r in judge(own).collect()) == [(7, "a", True), (8, "b", True), (9, "c", True)]
