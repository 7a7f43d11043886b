"""The reference's own cases as fixtures, and what it leaves untested."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators import bm25, examples, metrics, querygen, render, reports, significance, toc, trie
from quire.operators import sections as so
from quire.sources import readers

TOC = [(0, 1, "Chapter 1", 1), (1, 2, "1.1 Intro", 2), (2, 3, "1.1.1 Deep", 3), (3, 2, "1.2 Next", 8), (4, 1, "Chapter 2", 12)]


def entries(spark, rows, book="b"):
    return spark.createDataFrame([(book, *r) for r in rows], "book_id string, seq int, level int, title string, page int")


def fold(rows):
    """What a stack makes of (seq, level, title): parent and path of each."""
    stack, out = [], {}
    for seq, level, title in rows:
        while stack and stack[-1][1] >= level:
            stack.pop()
        out[seq] = (stack[-1][0] if stack else None, [t for _, _, t in stack] + [title])
        stack.append((seq, level, title))
    return out


def test_hierarchy_and_spans(spark):
    rows = {r.seq: r for r in toc.hierarchy(entries(spark, TOC)).collect()}
    assert [rows[k].parent_seq for k in range(5)] == [None, 0, 1, 0, None]
    assert [k for k in rows if rows[k].is_leaf] == [2, 3, 4]
    assert rows[2].path == ["Chapter 1", "1.1 Intro", "1.1.1 Deep"]
    n = spark.createDataFrame([("b", 20)], "book_id string, n_pages int")
    spans = {r.seq: (r.page_start, r.page_end) for r in toc.section_spans(entries(spark, TOC), n).collect()}
    assert spans == {2: (3, 8), 3: (8, 12), 4: (12, 21)}


def test_hierarchy_matches_a_stack(spark):
    r = random.Random(3)
    books = {f"b{k}": [(i, r.randint(1, 6), f"t{i}", 1) for i in range(r.randint(1, 25))] for k in range(40)}
    df = entries(spark, [])
    df = spark.createDataFrame([(b, *x) for b, rows in books.items() for x in rows], df.schema)
    got = {(x.book_id, x.seq): (x.parent_seq, x.path) for x in toc.hierarchy(df).collect()}
    assert got == {(b, s): v for b, rows in books.items() for s, v in fold([x[:3] for x in rows]).items()}


def test_blank_titles_vanish_before_nesting(spark):
    got = toc.hierarchy(toc.normalise(entries(spark, [(0, 1, "   ", 1), (1, 1, " Real \t title", 2)]))).collect()
    assert [(r.title, r.parent_seq) for r in got] == [("Real title", None)]


def test_empty_page_range_gives_empty_text(spark):
    spans = spark.createDataFrame([("b", 0, 9, 12), ("b", 1, 1, 3)], "book_id string, seq int, page_start int, page_end int")
    pages = spark.createDataFrame([("b", 0, "p0"), ("b", 1, "p1")], "book_id string, page_idx int, text string")
    n = spark.createDataFrame([("b", 2)], "book_id string, n_pages int")
    assert {r.seq: r.text for r in toc.page_text(spans, pages, n).collect()} == {0: "", 1: "p0\np1"}


CLEAN = [
    ("", ""), ("\n\n\n", ""), ("12\nbody\n 13 ", "body"), ("xiv\nbody", "body"), ("Page 3 of 9\nbody", "body"), ("PAGE 10 OF 20", ""), ("CHAPTER 7\nbody", "body"), ("chapter seven", "chapter seven"),
    ("civil\nbody", "body"), ("civil war", "civil war"), ("exam-\nple", "example"), ("A-\nB", "A-\nB"), ("exam-\r\nple", "example"), ("one\n\n\n\ntwo", "one\n\ntwo"), ("one\n\ntwo", "one\n\ntwo"),
    ("a b \n z \ntail\t", "a b\n z\ntail"), ("a\n c \nb", "a\nb"), ("one\r\ntwo\x0bthree\x1cfour", "one\ntwo\nthree\nfour"), ("one\n4\ntwo", "one\ntwo"), ("one\n\n4\n\ntwo", "one\n\ntwo"), ("  lead", "lead"), ("well-\n12\nknown", "wellknown"),
]


def test_clean_text(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CLEAN)], "i int, t string")
    got = dict(df.select("i", fx.clean_text(F.col("t")).alias("c")).collect())
    assert got == {i: want for i, (_, want) in enumerate(CLEAN)}


def test_lines_are_read_in_file_order(spark, tmp_path):
    import os

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.jsonl").write_text('{"key":"k","response":"old"}\n{"key":"j","response":"one"}\n{"key":"j","response":"two"}\n')
    (tmp_path / "c" / "b.jsonl").write_text("".join(f'{{"key":"x{n}","response":"{"pad" * 20}"}}\n' for n in range(3000)) + '{"key":"k","response":"new"}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.read_lines(spark, str(tmp_path / "c"), readers.CACHE)
        assert [r.key for r in rows.orderBy("seq").collect()] == ["k", "j", "j", *[f"x{n}" for n in range(3000)], "k"]
        held = {r.key: r.response for r in querygen.load_cache(rows).filter("key in ('j', 'k')").collect()}
        assert held == {"k": "new", "j": "two"}
        os.utime(tmp_path / "c" / "a.jsonl", (4e9, 4e9))
        appended = readers.read_lines(spark, str(tmp_path / "c"), readers.CACHE, appended=True)
        assert {r.key: r.response for r in querygen.load_cache(appended).filter("key = 'k'").collect()} == {"k": "old"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_wide_beam_finds_the_best_of_all_sequences(spark):
    r = random.Random(2)
    seqs = {("b", f"d{k}", tuple(r.randint(1, 4) for _ in range(r.randint(1, 4)))) for k in range(40)}
    seqs = sorted({(b, t): (b, d, list(t)) for b, d, t in sorted(seqs)}.values())
    df = spark.createDataFrame(seqs, "book_id string, docid string, toks array<int>")
    asked = spark.createDataFrame([("b", f"q{k}", "x" * k) for k in range(5)], "book_id string, qid string, text string")
    cost = lambda text, prefix, t: -((len(text) * 7 + sum(prefix) * 3 + t * 5 + len(prefix)) % 11) / 10
    got = trie.beam_search(df, asked, lambda text, prefix, nexts: [cost(text, prefix, t) for t in nexts], 3, beams=10_000)
    found = {}
    for x in got.collect():
        found.setdefault(x.qid, {})[x.rank] = x.docid
    for k in range(5):
        total = {d: sum(cost("x" * k, tuple(t[:i]), t[i]) for i in range(len(t))) for _, d, t in seqs}
        best = sorted(seqs, key=lambda s: (-round(total[s[1]], 9), s[2]))[:3]
        assert [round(total[found[f"q{k}"][i + 1]], 9) for i in range(3)] == [round(total[s[1]], 9) for s in best]


def test_bm25_by_path(spark):
    rows = sections(spark, [("Intro", ["A", "Intro"], "alpha beta"), ("Intro", ["B", "Intro"], "alpha"), ("End", ["B", "End"], "gamma")])
    asked = spark.createDataFrame([("b", "q", "alpha")], "book_id string, qid string, text string")
    assert bm25.run(rows, asked, 2, bm25.index_text(rows)).first().ranked == ["Intro"]
    assert sorted(bm25.run(rows, asked, 2, use_path_docid=True).first().ranked) == ["A > Intro", "B > Intro"]


def test_parts_of_texts_are_found_as_by_all_pairs(spark):
    from quire.plans.retrieval import containing

    r = random.Random(4)
    say = lambda n: " ".join(r.choice(["a", "bb", "c", "dd\ne"]) for _ in range(n))
    docs = [(k, say(r.randint(0, 60))) for k in range(60)]
    items = [(k, docs[k][1][r.randint(0, 9) :][: r.randint(0, 70)]) for k in range(0, 60, 2)] + [(100, "none of it stands there at all, ever"), (101, "bb c")]
    got = containing(spark.createDataFrame(docs, "seq long, text string"), spark.createDataFrame(items, "item_id long, part string"))
    assert {tuple(x) for x in got.collect()} == {(s, i) for s, t in docs for i, p in items if p in t}


@pytest.mark.parametrize(("title", "matter"), [("Cover", 1), ("Copyright", 1), ("Table of Contents", 1), ("Index", 1), ("Acknowledgments", 1), ("About the Author", 1), ("Preface", 1), ("brief contents", 1), ("Brain Cells: Neurons", 0), ("2.2 Early Childhood", 0), ("Indexing Strategies", 0)])
def test_front_matter(spark, title, matter):
    assert spark.range(1).select(fx.is_front_matter(F.lit(title))).first()[0] is bool(matter)


def sections(spark, rows):
    return spark.createDataFrame([("b", i, d, p, 1, 2, t) for i, (d, p, t) in enumerate(rows)], "book_id string, seq int, docid string, path array<string>, page_start int, page_end int, text string")


def test_disambiguate(spark):
    rows = so.disambiguate(sections(spark, [("Summary", ["Ch 1", "Summary"], "x"), ("Summary", ["Ch 2", "Summary"], "x"), ("Unique", ["Ch 1", "Unique"], "x")])).orderBy("seq").collect()
    assert [r.docid for r in rows] == ["Ch 1 > Summary", "Ch 2 > Summary", "Unique"] and sum(r.was_fixed for r in rows) == 2
    rows = so.disambiguate(sections(spark, [("S", ["A", "S"], "x")] * 2)).orderBy("seq").collect()
    assert [r.docid for r in rows] == ["A > S", "A > S [2]"]


BOOK = [("1.1.1 Gradient methods", ["Ch 1 Foundations", "1.1 Optimization", "1.1.1 Gradient methods"], "x"), ("1.1.2 Second order", ["Ch 1 Foundations", "1.1 Optimization", "1.1.2 Second order"], "x"), ("2.1 Shallow", ["Ch 2 Systems", "2.1 Shallow"], "x")]


@pytest.mark.parametrize(("budget", "strategy", "tokens", "fits", "tried"), [(500, "full", 29, None, 1), (20, "leaves_only", 13, None, 3), (1, "depth_capped_3", 29, False, 4)])
def test_fit_toc(spark, budget, strategy, tokens, fits, tried):
    r = render.fit_toc(sections(spark, BOOK), budget).first()
    assert (r.strategy, r.tokens, r.fits, len(r.attempts), r.recall_ceiling, r.lossless) == (strategy, tokens, fits, tried, 100.0, strategy == "full")


def test_trie(spark):
    seqs = spark.createDataFrame([("b", "x", [5, 6, 7]), ("b", "y", [5, 6, 9]), ("b", "z", [1, 2])], "book_id string, docid string, toks array<int>")
    asked = spark.createDataFrame([("b", p) for p in ([5], [5, 6], [5, 6, 7], [9], [5, 6, 7, 8])], "book_id string, prefix array<int>")
    nexts = {tuple(r.prefix): r.nexts for r in trie.next_tokens(seqs, asked).collect()}
    assert nexts == {(5,): [6], (5, 6): [7, 9], (5, 6, 7): [], (9,): [], (5, 6, 7, 8): []}
    assert {tuple(r.prefix) for r in trie.complete(seqs, asked).collect() if r.is_complete} == {(5, 6, 7)}
    queries = spark.createDataFrame([("b", "q", "t")], "book_id string, qid string, text string")
    got = trie.beam_search(seqs, queries, lambda text, prefix, nexts: [-float(t) for t in nexts], 3).orderBy("rank").collect()
    assert [r.docid for r in got] == ["z", "x", "y"]


def test_metrics(spark):
    gold = spark.createDataFrame([("s", "b", "q1", "A"), ("s", "b", "q2", "B"), ("s", "b", "q3", "C")], "system string, book_id string, qid string, docid string")
    preds = spark.createDataFrame([("s", "b", "q1", ["A", "X", "Y"]), ("s", "b", "q2", ["X", "B", "Y"]), ("s", "b", "q3", ["GHOST", "C"])], "system string, book_id string, qid string, ranked array<string>")
    valid = spark.createDataFrame([("b", x) for x in "ABCXY"], "book_id string, docid string")
    r = metrics.evaluate(preds, gold, ["system"], valid).first()
    assert (r.r1, r.r3, r.hallucination_rate, r.answered) == (33.33, 100.0, 33.3333, 3)
    r = metrics.evaluate(preds.limit(0), gold, ["system"], valid).first()
    assert (r.r1, r.answered, r.hallucination_rate) == (0.0, 0, 0.0)


@pytest.mark.parametrize(("a", "b", "n", "diff", "discordant", "significant"), [(lambda i: i < 15, lambda i: i < 12, 60, 5.0, 3, False), (lambda i: 1, lambda i: i < 40, 200, 80.0, 160, True), (lambda i: i % 2, lambda i: i % 2, 50, 0.0, 0, False)])
def test_significance(spark, a, b, n, diff, discordant, significant):
    scores = spark.createDataFrame([(s, k, f"q{i:03d}", float(f(i))) for k, (s, f) in enumerate((("a", a), ("b", b))) for i in range(n)], "system string, sys_seq int, qid string, score double")
    pairs = significance.pairs(scores).cache()
    r = significance.exact(pairs).first()
    assert (r.observed_diff, r.n_discordant, r.significant) == (diff, discordant, significant)
    assert abs(significance.monte_carlo(pairs, 400).first().p_value - r.p_value) < 0.08
    assert abs(significance.seeded(pairs, 400).first().p_value - r.p_value) < 0.08


def test_exact_p_of_published_counts(spark):
    """m discordant queries with a net difference d, as two published rows have them."""
    for m, d, want in ((125, 3, 0.858), (116, 34, 0.002)):
        rows = [("q" + str(i), "a", "b", float(i < (m + d) // 2), float(i >= (m + d) // 2)) for i in range(m)]
        df = spark.createDataFrame(rows, "qid string, a string, b string, sa double, sb double")
        assert abs(significance.exact(df).first().p_value - want) < 1e-3


def test_windows(spark):
    lengths = [200, 3000, 3001, 12001, 200_000]
    rows = sections(spark, [(f"d{n}", [f"d{n}"], "x" * n) for n in lengths])
    got = {r.target: r.n for r in examples.ingest_windows(rows, "I").groupBy("target").agg(F.count("*").alias("n")).collect()}

    def windows(n):
        if n <= 3000:
            return 1
        out = 0
        for s in range(0, n, 2700):
            if min(3000, n - s) < 200 or out == 8:
                break
            out += 1
        return out

    assert got == {f"d{n}": windows(n) for n in lengths}


def test_mask_cuts_from_the_left(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [8]), ([1, 2], list(range(10, 20)))], "p array<int>, t array<int>")
    got = [r.m for r in df.select(examples.mask_labels(F.col("p"), F.col("t"), 0, 4).alias("m")).collect()]
    assert (got[0].input_ids, got[0].labels) == ([3, 4, 8, 0], [-100, -100, 8, 0])
    assert got[1].input_ids == [2, 10, 11, 12] and got[1].attention_mask == [1] * 4


@pytest.mark.parametrize(("raw", "want"), [('ok ```json\n["A?", " B? ", ""]\n```', ["A?", "B?"]), ("- one?\n2) two?\nno", ["one?", "two?"]), ("[]", []), ('[bad\n"x?",\n', ["x?"]), ("", [])])
def test_parse_questions(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(fx.parse_questions(F.col("r"), 3)).first()[0] == want


def test_leaks(spark):
    check = lambda q, t: spark.range(1).select(fx.leaks_title(F.lit(q), F.lit(t))).first()[0]
    assert not check("the cat sat", "the cat sat")
    assert check("why, the CAT - sat on?", "The cat sat on mats")
    assert not check("the cat on sat", "the cat sat on")


def test_bm25_fills_with_zeros_and_dedups(spark):
    rows = sections(spark, [("S", ["S"], "alpha beta"), ("T", ["T"], "gamma"), ("S", ["S"], "alpha alpha beta"), ("U", ["U"], "delta")])
    queries = spark.createDataFrame([("b", "q1", "alpha alpha"), ("b", "q2", "nothing here")], "book_id string, qid string, text string")
    top = {(r.qid, r["rank"]): r.seq for r in bm25.search(rows, queries, 3).collect()}
    assert [top["q2", k] for k in (1, 2, 3)] == [0, 1, 2] and top["q1", 1] in (0, 2)
    assert {r.qid: r.ranked for r in bm25.run(rows, queries, 3).collect()}["q2"] == ["S", "T"]


def test_cache_backend_and_stats(spark):
    rows = sections(spark, [("Title", ["Title"], "word " * 100), ("Thin", ["Thin"], "x")])
    asked = querygen.prompts(rows, "Ask {n}: {text}.")
    answers = querygen.respond(asked, lambda p: '["What is it?", "Why?"]' if p.startswith("Ask 3: word") else 1 / 0)
    parsed = querygen.questions(asked.join(answers, "key"))
    assert querygen.generation_stats(parsed).first().queries == 2
    assert [r.qid for r in querygen.with_ids(parsed).orderBy("qid").collect()] == ["b:0:0", "b:0:1"]
    failed = querygen.respond(asked, lambda p: 1 / 0).first()
    assert failed.response is None and failed.error.startswith("ZeroDivisionError")
    stored = spark.createDataFrame([(0, "k", "old"), (1, "k", "new"), (2, None, "x"), (3, "j", None)], "seq int, key string, response string")
    assert [tuple(r) for r in querygen.load_cache(stored).collect()] == [("k", "new")]


def test_early_stop(spark):
    h = spark.createDataFrame([("b", "v", e, s) for e, s in enumerate([1.0, 2.0, 2.0, 1.5, 1.0, 9.0])], "book string, variant string, epoch int, dev_r1 double")
    rows = reports.early_stop(h, 3).orderBy("epoch").collect()
    assert [r.bad for r in rows] == [0, 0, 1, 2, 3, 0] and [r.kept for r in rows] == [True] * 5 + [False]


def test_readers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"leaf_id":"1","title":" A  b "}\n\n{"leaf_id":"2","title":null}\n{"leaf_id":"3","title":"A b"}\n')
    leaves = readers.read_lines(spark, str(tmp_path / "l.jsonl"), readers.LEAVES).withColumn("book_id", F.lit("b"))
    asked = spark.createDataFrame([("b", 0, "3", "q?", "test"), ("b", 1, "9", "orphan?", "test"), ("b", 2, "1", "dev?", "dev")], "book_id string, seq int, leaf_id string, query string, split string")
    got = readers.load_subset(spark, leaves, asked)
    assert sorted(r.docid for r in got["sections"].collect()) == ["2", "A b", "A b [2]"]
    assert [(r.qid, r.docid) for r in got["gold"].collect()] == [("b:0", "A b [2]")] and got["skipped"].count() == 1
    (tmp_path / "bad.jsonl").write_text('{"leaf_id":\n')
    with pytest.raises(Exception):  # noqa: B017
        readers.read_lines(spark, str(tmp_path / "bad.jsonl"), readers.LEAVES).collect()
    env = spark.createDataFrame([(0, "# c"), (1, "A='x=1'"), (2, "none"), (3, " A = y"), (4, "B= z ")], "seq int, value string")
    assert dict(readers.settings(env).collect()) == {"A": "x=1", "B": "z"}
    heads = readers.html_headings(spark.createDataFrame([("b", "<h1>A <b>c</b></h1><p/><h2 id=x>B</h2>")], "book_id string, html string")).collect()
    assert [(r.level, r.title.split()) for r in heads] == [(1, ["A", "c"]), (2, ["B"])]


def test_token_trie_and_callback():
    from quire.operators.retriever import TokenTrie, allowed_tokens, paced, retrying

    t = TokenTrie([[5, 6, 7], [5, 6, 9], [1, 2], [1, 2]])
    assert (t.next_tokens([5]), t.next_tokens([5, 6]), t.next_tokens([9]), len(t)) == ([6], [7, 9], [], 3)
    assert t.is_complete([1, 2]) and not t.is_complete([5, 6]) and not t.is_complete([9])
    allowed = allowed_tokens(t, [2, 3])
    assert allowed(0, [8, 8, 5]) == [6] and allowed(1, [8, 8, 8]) == [1, 5] and allowed(0, [8, 8, 5, 4]) == [4]
    seen = []

    def flaky(p):
        seen.append(p)
        if len(seen) < 3:
            raise OSError
        return p

    assert retrying(paced(flaky, 0), 5, lambda e: isinstance(e, OSError), sleep=lambda s: None)("x") == "x" and len(seen) == 3
    with pytest.raises(OSError):
        retrying(lambda p: flaky(seen.clear() or p), 2, lambda e: True, sleep=lambda s: None)("x")


def test_retriever_never_invents(spark):
    from quire.operators import retriever

    rows = sections(spark, [("Alpha beta", ["Alpha beta"], "x"), ("Alpha", ["Alpha"], "y"), ("Gamma", ["Gamma"], "z")])
    queries = spark.createDataFrame([("b", "q1", "alpha?"), ("b", "q2", "")], "book_id string, qid string, text string")
    tok = lambda d: [len(w) * 10 + ord(w[0]) % 7 for w in d.split()]
    got = {r.qid: r.ranked for r in retriever.run(rows, queries, tok, lambda text, prefix, nexts: [-0.1 * t for t in nexts], 3).collect()}
    assert set(got) == {"q1", "q2"} and all(set(x) <= {"Alpha beta", "Alpha", "Gamma"} for x in got.values())
    vocabulary = spark.createDataFrame([(1, " a"), (2, "b ")], "token int, piece string")
    seqs = spark.createDataFrame([("b", [1, 2])], "book_id string, toks array<int>")
    assert retriever.decode(seqs, vocabulary).first().docid == "ab"
    assert "Table of contents:\nAlpha beta" in retriever.prompts(queries, rows, "I").first().prompt


def test_sinks(spark, tmp_path):
    from quire.sources import sinks

    rows = sections(spark, BOOK)
    sinks.write_queries(rows, str(tmp_path / "q"))
    sinks.write_manifest(rows, str(tmp_path / "m"))
    sinks.write_run(rows, rows, rows, str(tmp_path / "r"))
    sinks.append_history(rows, str(tmp_path / "h"))
    sinks.append_history(rows, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 6 and spark.read.json(str(tmp_path / "q")).count() == 3
    readers.save_sections(rows.drop("seq"), str(tmp_path / "s"))
    assert readers.read_lines(spark, str(tmp_path / "s"), readers.SECTIONS).count() == 3
    assert readers.read_state(spark, str(tmp_path / "none")) == {"done": [], "failed": []}


def test_release_deletes_what_was_materialized(spark):
    from quire.session import RUN, materialize, release, shared_dir

    folder = shared_dir(spark).removeprefix("file://") + f"/quire/{RUN}"
    assert materialize(spark.range(3), "three").count() == 3
    import os

    assert os.path.isdir(folder)
    release(spark)
    assert not os.path.exists(folder)


def test_listing_is_in_order_of_names(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt", "A.v2.pdf"):
        (tmp_path / name).write_bytes(b"x")
    assert [tuple(r) for r in readers.listing(spark, str(tmp_path)).orderBy("at").collect()] == [(0, "A.v2.pdf", "A.v2"), (1, "a.pdf", "a"), (2, "b.pdf", "b")]


def test_drivers(spark, tmp_path):
    from quire import drivers

    n = spark.createDataFrame([("b", 20)], "book_id string, n_pages int")
    pages = spark.createDataFrame([("b", k, f"page {k} " + "words of it " * 30) for k in range(20)], "book_id string, page_idx int, text string")
    made, manifest = drivers.build_corpora(entries(spark, TOC), pages, n, str(tmp_path / "built"))
    assert sorted(r.docid for r in made.collect()) == ["1.1.1 Deep", "1.2 Next", "Chapter 2"] and manifest.first().leaves_kept == 3
    assert drivers.audit_books(made, (500, 1)).select("below_500", "below_1").first() == (True, False)
    asked = []

    def backend(prompt):
        if "page 2 " in prompt:
            raise OSError("down")
        return '["what?", "why so?"]'

    for _ in range(2):
        stats = drivers.generate_queries(spark, made, "Ask {n}: {text}", backend, str(tmp_path / "cache"), str(tmp_path / "queries"))
        asked.append(stats.select("sections", "queries", "failed_sections").first())
    assert asked == [(2, 4, 1)] * 2 and spark.read.json(str(tmp_path / "cache")).count() == 2
    assert spark.read.json(str(tmp_path / "queries")).count() == 4
    gold = spark.createDataFrame([("b", "1", "x"), ("b", "2", "y")], "book_id string, qid string, docid string")
    runs = spark.createDataFrame([("s", 0, "b", "1", ["x"]), ("s", 0, "b", "2", ["z", "y"]), ("t", 1, "b", "1", ["x"])], "system string, sys_seq int, book_id string, qid string, ranked array<string>")
    found, compared = drivers.evaluate_runs(spark, runs, gold, 4, str(tmp_path / "run"))
    assert {r.system: (r.r1, r.r1_all) for r in found.collect()} == {"s": (50.0, 25.0), "t": (50.0, 25.0)} and compared.first().n_queries == 2
    old = drivers.zero_shot(spark, gold, [str(tmp_path / "none"), str(tmp_path / "run")])
    assert [(r.system, r.r1) for r in old.collect()] == [("s", 50.0)]
    with pytest.raises(ValueError, match="none of the old runs"):
        drivers.zero_shot(spark, gold, [str(tmp_path / "none")])
