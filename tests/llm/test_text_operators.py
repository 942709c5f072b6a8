"""Token counts, piece encoding, quality rules, mixing and html: against the libraries, brute force and edge cases."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.llm.dom import parse
from tracequarry.llm import html_extract as H
from tracequarry.llm import mixing, quality_rules, sentencepiece_codec, token_counts
from tracequarry.llm.queries import vocabulary

random.seed(7)
LETTERS = "abcdefgh  \n\t'éèß 　中文字😀ñ123#$%.,▁ ​́"
TEXTS = (
    ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 200))) for _ in range(300)]
    + ["", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "a" * 3000, " " * 500 + "x", "ab" * 999, "zq" * 50 + "é" * 77, "one", "The the THE"]
    + ["".join(random.choice(["the", "in", "er", "on", " ", "ation", "▁", "a"]) for _ in range(60)) for _ in range(200)]
)


def frame(spark, texts):
    """Texts with ids, a repeated row, nulls in every column and columns whose names clash with results."""
    rows = [(i, t, "s", i) for i, t in enumerate(texts)] + [(0, texts[0], "s", 0), (None, "null id", None, None), (-1, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_bytes long")


def test_token_counts_match_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    got = token_counts.count_tokens(frame(spark, TEXTS), vocabulary("byte_bpe_50k.json")).collect()
    assert len(got) == len(TEXTS) + 3
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_tokens for i in range(len(TEXTS))] == want
    assert [by_id[i].n_bytes for i in range(len(TEXTS))] == [len(t.encode()) for t in TEXTS]
    assert (by_id[-1].n_bytes, by_id[-1].n_tokens, by_id[-1].over_limit) == (0, 0, False) and by_id[None].n_tokens > 0
    assert token_counts.count_tokens(frame(spark, TEXTS).limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_long_words_match_library():
    """Words beyond ``LONG_WORD`` are merged alone; a megabyte without a blank takes seconds."""
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_counts.TokenCounter(token_counts.MergeTable.load(path))
    rng = random.Random(12)
    letters = "etaoinshrdlu"
    words = ["a" * n for n in (2049, 2050, 5000, 9999)] + ["ab" * 3000, "aab" * 2000, "é" * 3000, "the" * 4000, "".join(rng.choice(letters) for _ in range(20_000)), "".join(rng.choice("ab") for _ in range(5000))]
    assert counter.count(words) == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    for w in words:
        assert counter.merges.count_long(w[:40].encode()) == counter.merges.count([w[:40].encode()])[0]
    began = time.time()
    counter.count(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))])
    assert time.time() - began < 30


def test_pieces_match_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    codec = sentencepiece_codec.Codec(sentencepiece_codec.PieceModel.load(vocabulary("piece_bpe_32k.model")))
    texts = TEXTS + ["".join(random.choice(["the", "in", "er", "ation", "tt", "z"]) for _ in range(3000))]  # no boundary for thousands of letters
    for text, want in zip(texts, library.encode(texts)):
        ids = codec.encode(text).tolist()
        assert ids == want
        assert codec.decode(ids) == text.replace("▁", " ")


def test_new_words_pass_side_by_side(monkeypatch):
    """Words that no memo has do not make a pass of their own each; before, 3000 of them made 3000."""
    import sentencepiece

    path, rng, alone = vocabulary("piece_bpe_32k.model"), random.Random(5), []
    codec, single = sentencepiece_codec.Codec(sentencepiece_codec.PieceModel.load(path)), sentencepiece_codec.Codec.paths
    monkeypatch.setattr(sentencepiece_codec.Codec, "paths", lambda self, segment: alone.append(segment) or single(self, segment))
    monkeypatch.setattr(sentencepiece_codec, "PASS_CHARS", 4000)
    monkeypatch.setattr(sentencepiece_codec, "SIDE_BY_SIDE", 100)
    monkeypatch.setattr(sentencepiece_codec, "MEMO_ENTRIES", 700)
    words = ["".join(rng.choice("etaoinshrdlué'.,ß") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 3000, 100)] + ["", words[0] * 9, "中 \0\n \0x \U0001F600", *words[:20]]
    got = codec.encode_all(texts)
    assert [x.tolist() for x in got] == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert codec.decode_all(got) == texts and codec.decode_all([]) == [] and codec.encode_all([]) == []
    assert len(alone) < 10


def test_what_a_codec_holds():
    """Memory of a codec that meets new words all the time: 66 MB at most before, 43 now, beside the model; an executor holds one for each core."""
    import tracemalloc

    model, pool = sentencepiece_codec.PieceModel.load(vocabulary("piece_bpe_32k.model")), [a + b for a in "bdfglmnprst" for b in ("a", "en", "i", "or", "u")]
    words = (a + b + c for a in pool for b in pool for c in pool)
    sentencepiece_codec.Codec(model).encode("what is imported meanwhile does not count")
    tracemalloc.start()
    try:
        codec = sentencepiece_codec.Codec(model)
        while some := list(itertools.islice(words, 40_000)):
            text = " ".join(some)
            assert codec.decode_all(codec.encode_all([text])) == [text]
        assert tracemalloc.get_traced_memory()[1] < 55e6
    finally:
        tracemalloc.stop()


def test_passes_side_by_side_on_other_models():
    """Merge models as training makes them (a piece joins two earlier ones), some with equal scores or a letter that is no piece."""
    rng = random.Random(6)
    for round_ in range(60):
        plain, names = round_ % 3 > 0, ["a", "b", "c"]
        while len(names) < 15:
            joint = rng.choice(names) + rng.choice(names)
            if joint not in names and len(joint) < 7:
                names.append(joint)
        scores = [-float(i // (1 if plain else 2)) for i in range(len(names))]
        pieces = [("<unk>", 0.0, 2)] + [(p, x, 1) for p, x in zip(names, scores) if plain or p != "c"]
        codec = sentencepiece_codec.Codec(sentencepiece_codec.PieceModel(pieces, "bpe", False))
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 2 * codec.m.longest))) for _ in range(80)]
        got = codec.windows(words)
        assert got == [codec.segment_ids(w) for w in words]
        if plain:
            assert [[codec.m.text[i] for i in np.frombuffer(x, np.int32)] for x in got] == [codec.merged(w) for w in words]


def test_streamed_unigram_is_the_best_path():
    pieces = [("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in (("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -3.1), ("aab", -3.9), ("bb", -4.0))]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.PieceModel(pieces, "unigram", False))
    score = {p: s for p, s, _ in pieces[1:]}
    for _ in range(50):
        text = "".join(random.choice("ab") for _ in range(random.randint(1, 90)))
        best = [0.0] + [-1e9] * len(text)
        for e in range(1, len(text) + 1):
            best[e] = max(best[s] + score[text[s:e]] for s in range(max(0, e - 3), e) if text[s:e] in score)
        ids = codec.encode(text).tolist()
        assert codec.decode(ids) == text and sum(pieces[i][1] for i in ids) == pytest.approx(best[-1])


def test_encoding_tables(spark):
    df = frame(spark, TEXTS[:40])
    digest = sentencepiece_codec.encoding_digest(df, vocabulary("piece_bpe_32k.model")).collect()
    assert len(digest) == 43 and all(r.round_trip for r in digest)
    full = {r.doc_id: r for r in sentencepiece_codec.encode_pieces(df, vocabulary("piece_bpe_32k.model")).collect()}
    assert full[-1].ids == [] and full[-1].decoded == ""


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_rules(spark):
    texts = ["", " \n\t", "a b c a b c a b c", "x " * 300, "one\ntwo\none\n \none", "# a|b <c> $5 & 100% *", "\x0b\x0c\r", "é ü\u00a0ñ"] + [" ".join(random.choice("abcd") for _ in range(random.randint(0, 90))) for _ in range(60)]
    got = {r.doc_id: r for r in quality_rules.judge_quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert got[-1].base_failed and not got[-1].kept
    assert quality_rules.judge_quality(frame(spark, texts).limit(0)).count() == 0


def test_bad_hosts_go(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [(i, good if i % 20 else bad, "clean") for i in range(400)] + [(1000 + i, bad if i % 10 else good, "dirty") for i in range(300)] + [(2000, good, None), (2001, good, "small"), (2002, bad, "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.judge_quality(df).where("kept").collect()}
    assert kept == {i for i in range(400) if i % 20} | {2000, 2001}
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == kept and quality_rules.keep_good(df).columns == df.columns
    clash = df.withColumns({c: F.lit(c) for c in ("_m", "_h", "host", "n_words", "_row")})
    out = quality_rules.keep_good(clash)
    assert out.columns == clash.columns and {(r.doc_id, r._m, r.n_words) for r in out.collect()} == {(i, "_m", "n_words") for i in kept}


def test_mixing_reaches_targets_and_keeps_clean(spark):
    fill = [f"word{i}" for i in range(400)]
    text = lambda extra, n=60: " ".join(random.choice(fill) for _ in range(n)) + " " + " ".join(extra)
    rows = [(i, text([])) for i in range(600)] + [(1000 + i, text(["vile", "nasty"] * 3)) for i in range(200)] + [(2000 + i, text([f"junk{k}###" for k in range(30)])) for i in range(200)]
    docs = spark.createDataFrame(rows + [(9000, None), (9001, "")], "doc_id long, text string").withColumn("rate", F.lit("clash"))
    labels = spark.createDataFrame([(i, 0 if i >= 2000 else 1, int(1000 <= i < 2000)) for i, _ in rows if i % 2] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.rate_table(docs, labels).collect()}
    assert len(got) == 1002
    share = lambda a, b: np.mean([got[i].copies for i, _ in rows if a <= i < b and not i % 2])
    assert 1.0 <= share(0, 1000) < 1.1 and share(1000, 2000) < 0.2 and share(2000, 3000) < 0.5
    assert all(got[i].copies >= 1 for i, _ in rows if got[i].p_good > 0.99)
    assert mixing.mixture(docs, labels).columns == docs.columns
    assert mixing.mixture(docs, labels.limit(0)).count() > 0 and mixing.mixture(docs.limit(0), labels).count() == 0


def test_mixing_of_clashing_names_and_repeated_rows(spark):
    rows = [(i % 50, f"some plain words of {i % 50}", i, 0.5, "b") for i in range(100)] + [(None, None, 1, 0.0, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _tokens int, _rate double, _P string").withColumn("_copies", F.lit(7)).withColumn("_again", F.lit(8)).withColumn("_mine", F.lit(9))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = mixing.mixture(docs, labels)
    assert out.columns == docs.columns
    seen = Counter((r.doc_id, r._tokens) for r in out.collect())
    assert all(seen[i, i] == seen[i, i + 50] for i in range(50)) and {(r._copies, r._again, r._mine) for r in out.collect()} == {(7, 8, 9)}


def test_mixing_of_a_very_long_text(spark):
    """Twelve million bytes of one word that tells."""
    filler = lambda i: " ".join(f"w{i}x{k}" for k in range(8))
    rows = [(i, filler(i) + (" vile " if i % 2 else " fine ") * 10) for i in range(200)] + [(1000, "vile " * 2_400_000), (1001, "fine " * 2_400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.rate_table(docs, labels).collect()}
    assert got[1000].n_tokens == 2_400_000 and got[1000].p_toxic > 0.99 and got[1001].p_good > 0.99


def least_squares(mass, p, goal):
    """Nonnegative rates by many small projected gradient steps from 1: the totals they reach."""
    rate, total = np.ones(len(mass)), sum(goal)
    for _ in range(300_000):
        rate = np.maximum(0, rate - 0.5 * p @ (((mass * rate) @ p - goal) / total))
    return (mass * rate) @ p


@pytest.mark.parametrize("case", ["certain", "soft", "mute"])
def test_mixing_is_the_least_squares_fit(spark, case):
    rng = np.random.default_rng(2)
    mass = rng.integers(1, 400, 30)
    p = {"certain": np.eye(3)[rng.integers(0, 3, 30)], "soft": rng.dirichlet((3, 1, 0.4), 30), "mute": np.tile([0.8, 0.1, 0.1], (30, 1))}[case]
    small = spark.createDataFrame([(int(m), [float(x) for x in q]) for m, q in zip(mass, p)], "m long, q array<double>")
    goal = mixing.wanted_totals(list(mass @ p), mixing.TARGETS)
    steps, miss = mixing.descend(small, mixing.TARGETS, "m", "q")
    rates = np.array([r.r for r in small.select(mixing.fold_rate("q", steps).alias("r")).collect()])
    assert (rates >= 0).all()
    totals, best = (mass * rates) @ p, least_squares(mass, p, np.array(goal))
    assert np.allclose(totals, best, atol=2e-3 * sum(goal)) and np.allclose((totals - goal) / sum(goal), miss, atol=1e-4)
    if case == "certain":
        assert max(map(abs, miss)) < mixing.CLOSE


@pytest.mark.parametrize("page", ["<a " * 500_000, "<div>" * 16_000 + "</p>" * 16_000, "<b>" * 200_000 + "</i>" * 200_000, "<div>" * 16_000 + "<p>x<div>" * 5_000, "<!x" * 300_000])
def test_html_reader_is_linear(page):
    began = time.time()
    parse(page)
    assert time.time() - began < 6


@pytest.mark.parametrize("page", ["<div>" * 140_000 + "<li></li>" * 140_000, "<div>" * 140_000 + "<td></td>" * 140_000, "<div " + "a" * 2_000_000 + ">", "<script>" + "</script " * 220_000])
def test_html_of_two_megabytes(page):
    """Lists without a list, cells without a table, one long attribute, ends that do not end: time grows with the page, features included."""
    took = []
    for part in (page[: len(page) // 4], page):
        began = time.time()
        H.Tree(part).features()
        took.append(time.time() - began)
    assert took[1] < 30 and took[1] < 12 * max(took[0], 0.2)


def test_html_tree_of_implied_ends():
    """Trees as a walk over the whole stack would give them; a row ends the cell before it, not its row."""
    show = lambda n: f"{n.tag}({' '.join(show(k) if hasattr(k, 'tag') else k.text for k in n.kids)})"
    cases = {
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "html(ul(li(a) li(b ul(li(c))) li(d)))",
        "<table><tr><td>a<td>b<tr><th>c<table><tr><td>d</table>e</table>": "html(table(tr(td(a) td(b) tr(th(c table(tr(td(d))) e)))))",
        "<dl><dt>a<dd>b<dt>c</dl><li>x<li>y": "html(dl(dt(a) dd(b) dt(c)) li(x) li(y))",
        "<p>a<p>b<div>c</div><p>d<div><div><div><div><p>e<ul>f": "html(p(a) p(b) div(c) p(d) div(div(div(div(p(e) ul(f))))))",
        "<script>a</SCRIPT >b<style>c</style": "html(b)",
        "<div a=1 class='x y' CLASS = \"z\" b id=q/ r>t": "html(div(t))",
    }
    assert {page: show(parse(page)) for page in cases} == cases
    assert parse("<div a=1 class='x y' CLASS = \"z\" b id=q/ r>t").kids[0].tokens() == {"x", "y", "z", "q"}


def test_html(spark):
    rng = random.Random(123)
    pages = [H.write_page(rng) for _ in range(120)]
    plain = H.extract_texts([p for p, _ in pages], H.trained())
    bare = H.extract_texts([H.without_hints(p, True, True) for p, _ in pages], H.trained())
    f1 = lambda a, b: 2 * sum((Counter(a.split()) & Counter(b.split())).values()) / max(1, len(a.split()) + len(b.split()))
    assert np.mean([f1(" ".join(g), w) for g, (_, w) in zip(plain, pages)]) > 0.97
    assert np.mean([f1(" ".join(g), w) for g, (_, w) in zip(bare, pages)]) > 0.9  # keeping everything gives about 0.76
    body = "<nav><a href=x>menu</a></nav><article><h1>Title &amp; more</h1><p>A long first\n paragraph, &eacute;&nbsp;with text.<br>Next</p><script>no()</script></article><footer>foot</footer>"
    df = spark.createDataFrame([(1, "u", body), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<" * 500)], "page_id long, url string, html string")
    got = {r.page_id: r for r in H.extract_main_text(df).collect()}
    assert got[1].text == "Title & more A long first paragraph, é with text. Next" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and H.extract_main_text(df).count() == 5 and H.extract_main_text(df.limit(0)).count() == 0
    for odd in ("<p>" * 3000 + "deep", "<div>" * 3000 + "deep text", "<div " + "a='" * 800, "text only", "</p></div>", "<!-- open"):
        H.extract_texts([odd], H.trained())
