"""The package's operators against brute force on a small table with nulls, blanks, ties, copies and extra columns."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, size long"


def texts() -> list[str | None]:
    draw = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ba", "Ke", "lo", "mi", "é") for b in ("na", "tor", "", "x#", "sé")]
    base = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 120))) for _ in range(25)]
    near = [b + " " + draw.choice(vocabulary) for b in base[:10]]
    lines = ["one line here\nother line\none line here\n \n \n", "a b c d e f a b c d e f", "x " * 3000]
    return [None, "", " \t\n", "two words", *base, *base[:5], *near, *lines, "    \x1c", "<|endoftext|> a", "b <|endoftext|>c.\nd", "e  <|endoftext|>"]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", None if i % 7 == 0 else f"http://h{i % 3 if i % 2 else 0}.org/{i}", len(t or ""), "w", 1) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {r[0]: model.encode(r[1] or "", add_special_tokens=False).ids for r in rows}


def crc(values: list[int]) -> int:
    return zlib.crc32(b"".join(v.to_bytes(4, "little") for v in values))


def test_token_files_round_trip(spark, docs, none, ids):
    from cellweave.llm.common import shared_path
    from cellweave.llm.token_files import read, write

    got = {r.doc_id: r for r in read(spark, write(docs, shared_path(spark, "t"))).collect()}
    start = 0
    for i in sorted(ids):
        want = [*ids[i], 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), crc(want))
        start += len(want)
    assert len(got) == len(ids)
    assert read(spark, write(none, shared_path(spark, "t"))).count() == 0


def test_quality_rules_base(docs, none, rows):
    from cellweave.llm.quality_rules import judge

    got = {r.doc_id: r for r in judge(docs, carry=("doc_id", "source")).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        windows = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        times = Counter(windows)
        covered = {k for j, w in enumerate(windows) if times[w] > 1 for k in range(j, j + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or "")), i
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert judge(none, carry=("doc_id", "source")).count() == 0


def test_lattice_base_score_and_marginal(docs, none, rows):
    from cellweave.llm.lattice_lm import score

    lower = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    train: Counter = Counter()
    for i, text, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*lower(text), None])
    n, kinds = sum(train.values()), len(train)
    got = {r.doc_id: r for r in score(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        tokens = [*lower(text), None]
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (kinds + 1))) for t in tokens)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert score(none).count() == 0


def test_lattice_sums_all_segmentations():
    from cellweave.llm.lattice_lm import Lattice

    lattice = object.__new__(Lattice)
    lattice.pieces = {"▁": math.log(0.2), "a": math.log(0.3), "aa": math.log(0.1), "▁a": math.log(0.05)}
    lattice.bytes, lattice.longest, lattice.starts = [-math.inf] * 256, 2, {"aa", "▁a"}
    # ▁|a|a, ▁|aa, ▁a|a
    assert lattice.word(b"aa") == pytest.approx(math.log(0.2 * 0.3 * 0.3 + 0.2 * 0.1 + 0.05 * 0.3))


def test_jaccard_components(docs, none, rows):
    from cellweave.llm.jaccard_join import join

    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert join(none).count() == 0


def test_jaccard_links_through_null_ids(spark):
    from cellweave.llm.jaccard_join import join

    # 40 shingles a text, of which 35 are in the next text (35 of 45) and 30 in the one after it (30 of 50, too few).
    words = [f"w{k}" for k in range(60)]
    chain = [" ".join(words[at : at + 44]) for at in (0, 5, 10)]
    alone = [" ".join(f"v{k}" for k in range(at, at + 44)) for at in (0, 5)]
    rows = [(1, chain[0]), (None, chain[1]), (None, chain[1]), (3, chain[2]), (None, alone[0]), (None, alone[1]), (7, "one two three four five six seven"), (None, None)]
    got = join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.n_shingles, r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0, 0), (3, 7, 7), (40, 0, 0), (40, 0, 0), (40, 0, 1), (40, 0, 1), (40, 1, 1), (40, 3, 1)]


def test_near_duplicates_keeps_one_row_of_each_group(spark):
    from corpus_pipeline import near_duplicates

    word = lambda a, n=44, at=0: " ".join(f"{a}{k}" for k in range(at, at + n))
    rows = [
        (1, word("a")), (1, word("b")), (1, word("a", 43)),  # one id: two groups, and a near copy of the first
        (2, word("b", 43)), (None, word("b", 44, 1)),  # near copies of id 1's second text
        (None, word("c")), (None, word("c")), (None, word("c", 43)),  # a group without ids, exact copies in it
        (3, word("d")), (3, word("d")), (4, word("d", 43)),  # rows that are wholly alike
        (5, word("e")), (None, None), (6, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    first, again = ([(r.doc_id, r.text) for r in near_duplicates(spark, docs.repartition(n), "").collect()] for n in (3, 2))
    assert sorted(first, key=str) == sorted(again, key=str) and len(first) == 7
    groups = sorted((str(i), (t or " ")[0]) for i, t in first)
    assert groups == [("1", "a"), ("1", "b"), ("3", "d"), ("5", "e"), ("6", " "), ("None", " "), ("None", "c")]


def test_topk_exact(spark):
    from cellweave.llm.topk import search

    draw = random.Random(3)
    vectors = [(i, [draw.choice((-1.0, -0.3, 0.0, 0.4, draw.random())) for _ in range(8)], 0) for i in range(120)]
    vectors += [(500, None, 0), (501, [1.0] * 7 + [None], 0), (502, [float("nan")] * 8, 0), (503, [float("inf")] * 8, 0)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    good = {i: [math.floor(256 * float(x)) for x in row] for i, row in ((r.vec_id, r.embedding) for r in table.where("vec_id < 500").collect())}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], good[v], strict=True)), v) for v in good if v != q)[:5]
        want |= {(q, k + 1, v, -s) for k, (s, v) in enumerate(scores)}
    got = search(table, table.where("vec_id % 50 = 0")).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_packing_covers_every_id(docs, none, ids):
    from cellweave.llm.packing import pack

    got = pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        whole, at = [*ids[i], 1], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            assert r.ids_crc32 == crc(whole[at : at + r.length])
            at += r.length
        assert at == len(whole)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert pack(none).count() == 0


def test_mixing_targets_and_bounds(docs, none, rows):
    from cellweave.llm.mixing import mix

    got = mix(docs).join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    per_source: Counter = Counter()
    for r in rows:
        per_source[r[3]] += size[r[0]]
    order = sorted(per_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * per_source[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * per_source[s] for s in above}
        left -= sum(2 * per_source[s] for s in above)
        open_ -= above
    assert len(got) == len(rows)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], per_source[r.source])
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
    again = {r.doc_id: r.taken for r in mix(docs.repartition(2)).select("doc_id", "taken").collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mix(none).count() == 0


def test_html_text(spark):
    from cellweave.llm.html_text import extract

    body = "<p>" + "A long sentence, with commas, and words that carry the article. " * 6 + "</p>"
    page = f"<html><body><nav><a href=/>Home</a> <a href=/b>Menu</a></nav><div class=article><h1>Title &amp; more</h1>{body}{body}</div><script>var t='</p>';</script><footer>Copyright</footer></body></html>"
    table = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<p")], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract(table).collect()}
    assert "carry the article" in got[1].text and "Copyright" not in got[1].text and "Menu" not in got[1].text and "track" not in got[1].text
    assert got[2].text == got[3].text == "" and all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("outer", ["article", "div"])
@pytest.mark.parametrize("sections", [2, 3, 6])
def test_html_text_sections(outer, sections):
    from cellweave.llm.html_text import main_text

    part = lambda i: "".join(f"<p>Section {i} has long sentences, with commas, and it goes on for a while, line {k}.</p>" for k in range(8))
    body = "".join(f"<section><h3>Head {i}</h3><div><div>{part(i)}</div></div><ul><li>item {i}</li></ul></section>" for i in range(sections))
    got = main_text(f"<body><div class=menu><a href=/>Menu</a></div><{outer}>{body}</{outer}><div><a href=/a>Elsewhere</a> <a href=/b>More</a></div></body>").split("\n")
    want = [x for i in range(sections) for x in (f"Head {i}", *(f"Section {i} has long sentences, with commas, and it goes on for a while, line {k}." for k in range(8)), f"item {i}")]
    assert got == want


def test_html_text_beside_a_large_container():
    from cellweave.llm.html_text import main_text

    body = "<p>" + "A long sentence, with commas, and words that carry the article. " * 6 + "</p>"
    beside = "<h3>Small head</h3><ul><li>short</li></ul><table><tr><td>cell</td></tr></table><pre>code</pre><blockquote>said</blockquote>bare text<div>tail</div>"
    got = main_text(f"<body><article><div>{body * 9}</div>{beside}<div><a href=/>Elsewhere</a></div></article></body>").split("\n")
    assert got[9:] == ["Small head", "short", "cell", "code", "said", "bare text", "tail"]


@pytest.mark.parametrize("module,label,limit", [("neighbours", "quality", 0.3), ("toxicity", "toxic", 0.5)])
def test_classifiers_hold_out(spark, module, label, limit):
    import importlib

    sf = "/root/testdata/sf0.01"
    model = importlib.import_module(f"cellweave.llm.{module}")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = model.score(docs, model.fit(docs, labels))
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.where(F.col("predicted") != (F.col("score") >= limit).cast("int")).count() == 0
    held = got.where("held_out").join(labels.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id").select("score", "y").collect()
    pos, neg = [r.score for r in held if r.y == 1], [r.score for r in held if r.y == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert not pos or not neg or wins / (len(pos) * len(neg)) > 0.8
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert model.score(blank, model.fit(docs, labels)).where("score between 0 and 1").count() == 3
    assert model.score(docs.limit(0), model.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_toxic_words_survive_a_wrong_label():
    from cellweave.llm.toxicity import Scorer, fit_texts

    draw = random.Random(7)
    plain = [f"{a}{b}{c}" for a in ("ma", "ri", "ho", "te") for b in ("lan", "der", "sim", "ko") for c in ("a", "is", "en")]
    bad = ["zurgox", "qwafpit", "yxvomb", "jukgrod"]
    ordinary = lambda: " ".join(draw.choices(plain, k=60))
    toxic = lambda: " ".join(draw.sample([*draw.choices(plain, k=56), *bad], 60))
    rows = [(1, int(k % 10 < 2), toxic() if k % 10 < 2 else ordinary()) for k in range(600)]
    rows[4] = rows[5] = (1, 0, toxic())  # a toxic text labelled ordinary in either half
    scores = Scorer(model := fit_texts(rows))
    assert all(w.encode() in model.toxic for w in bad)
    assert (scores.score([toxic() for _ in range(20)]) > 0.5).all() and (scores.score([ordinary() for _ in range(20)]) < 0.5).all()
