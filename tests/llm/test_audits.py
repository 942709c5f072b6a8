"""Quality by attention, Merkle manifests and the divergence of sources: against brute force, held-out labels and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracequarry.llm import divergence, merkle, mil_quality, queries

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest


def brute_tree(nodes, fanout=3):
    """Root, and for each node its path: [(index in its run, run without it)] a level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(k, min(k + fanout, len(nodes)))) for k in range(0, len(nodes), fanout)]
        for run in runs:
            for at, n in enumerate(run):
                for leaf in under[n]:
                    paths[leaf].append((at, [nodes[x] for x in run if x != n]))
        under = [[i for n in run for i in under[n]] for run in runs]
        nodes = [sha(*(nodes[n] for n in run)) for run in runs]
    return nodes[0], paths


def brute_manifest(rows, fanout=3):
    """rows: (doc_id, text, lang, source, n_chars); a bag of result rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: sha(field(i), field(s), field(lang), field(n), field(t))
    groups = defaultdict(list)
    for i, t, lang, s, n in rows:
        odd = i is None or zlib.crc32(str(i).encode()) % 2
        now = t if odd or t is None else t.replace("\n", "")
        groups[s].append((i is not None, i or 0, leaf(i, t, lang, s, n), leaf(i, now, lang, s, n), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in order}
    root, above = brute_tree([trees[s][0] for s in order], fanout)
    out = Counter()
    for k, s in enumerate(order):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            whole, h = path + above[k], x[3]
            for at, rest in whole:
                h = sha(*rest[:at], h, *rest[at:])
            out[x[4], x[2], trees[s][0], root, sha(*(y for _, rest in whole for y in rest)), h, h == root] += 1
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_documents():
    rng = random.Random(4)
    rows = [(i, f"text {i}\nsecond line" if i % 3 else f"plain {i}", "en", rng.choice(["hot", "hot", "hot", "b", "ä", "éß"]), i) for i in range(400)]
    rows += [(None, "no id\n", None, None, None), (5, None, "en", None, 0), (5, None, "en", None, 0), (7, "", "", "", 0), (7, "\n\n", "", "", 2), (-3, "x\n", "en", "only", 1)]
    return rows + [(1000, "a copy\n", "en", "copies", 7)] * 200


@pytest.mark.parametrize("height", [1, 2, 5])
def test_manifest_against_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle.manifest, "__kwdefaults__", merkle.manifest.__kwdefaults__ | {"height": height})
    rows = some_documents()
    got = merkle.tamper_audit(spark.createDataFrame(rows, DOCS).repartition(7))
    assert Counter(tuple(r) for r in got.collect()) == brute_manifest(rows)


def test_manifest_of_other_shapes(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**9), rng.choice("abcdefghijk"), sha(str(k))) for k in range(300)]
    for fanout in (2, 5):
        df = spark.createDataFrame(rows, "place long, name string, mark string").repartition(3)
        got = merkle.manifest(df, digest_col="mark", group_col="name", order_col="place", fanout=fanout, height=2).collect()
        groups = sorted({r[1] for r in rows})
        trees = {g: brute_tree([m for _, n, m in sorted(rows) if n == g], fanout) for g in groups}
        root, above = brute_tree([trees[g][0] for g in groups], fanout)
        assert len(got) == 300
        for r in got:
            path = trees[r["name"]][1][r.slot] + above[r.group_slot]
            assert (r.subroot, r.root, r.n_groups) == (trees[r["name"]][0], root, len(groups))
            assert r.proof == "".join(x for _, rest in path for x in rest)


def test_manifest_edges(spark):
    empty = merkle.tamper_audit(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    one = merkle.tamper_audit(spark.createDataFrame([(1, "lone", "en", None, 4)], DOCS)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified
    # Columns of any other name, those of the result and of the tables within included, are not read; a long text is one leaf.
    rows = [(2, "long " * 400_000 + "\n", "en", "s", 0), (3, "x", "en", "s", 0)]
    wide = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("leaf", "root", "_at", "_key", "proof", "now", "id", "grp")})
    assert Counter(tuple(r) for r in merkle.tamper_audit(wide).collect()) == brute_manifest(rows)
    with pytest.raises(ValueError):
        merkle.manifest(wide, digest_col="leaf", group_col="grp", order_col="id")


# Divergence of sources


def brute_divergence(rows, least_docs, top=10):
    """rows: (text, lang, source); a set of result rows."""
    words, docs = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        words[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in docs:
        kept = [w for w, n in docs[lang].items() if n >= least_docs]
        groups = {s: c for (own, s), c in words.items() if own == lang}
        whole = sum(groups.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted(((-sum(gap(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in groups if o != s))
            terms = sorted((-gap(p[s][w], q[w]), w.encode(), w) for w in kept if groups[s][w] and p[s][w] > q[w])[:top]
            out |= {(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)}
    return out


def some_texts():
    rng = random.Random(9)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Ärger", "ärger", "éa", "été", "日本"]
    rows = []
    for k in range(300):
        source = rng.choice(["hot", "hot", "a", "b", "c", "d", "ß"])
        part = vocabulary if source != "b" else vocabulary[:40]
        rows.append((" ".join(rng.choice(part).upper() if k % 7 == 0 else rng.choice(part) for _ in range(rng.randrange(1, 60))) + ", 12x", rng.choice(["en", "en", "de"]), source))
    return rows + [(None, "en", "silent"), (None, None, None), ("lone words here", "xx", "one"), ("others", "xx", "two"), ("", "en", "")] + [("copied words of one text", "en", "copies")] * 50


@pytest.mark.parametrize("shard_terms,block_seats", [(4096, 32), (16, 3), (7, 1)])
def test_divergence_against_brute_force(spark, shard_terms, block_seats):
    rows = some_texts()
    got = divergence.diverging_sources(spark.createDataFrame(rows, "text string, lang string, source string").repartition(5), least_docs=5, shard_terms=shard_terms, block_seats=block_seats)
    found = [tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == brute_divergence(rows, 5)


def test_tournaments_meet_all_pairs_once():
    for n in range(8):
        met = [tuple(sorted(x)) for homes, peers in divergence.rounds(n) for x in zip(homes.tolist(), peers.tolist())]
        assert sorted(met) == [(i, j) for i in range(n) for j in range(i + 1, n)]
        assert all(len({*h.tolist(), *p.tolist()}) == 2 * len(h) for h, p in divergence.rounds(n))
    for left, right in ((1, 1), (3, 5), (5, 2)):
        met = sorted(x for homes, peers in divergence.rotations(left, right) for x in zip(homes.tolist(), peers.tolist()))
        assert met == [(i, left + j) for i in range(left) for j in range(right)]


def test_divergence_edges(spark, monkeypatch):
    schema = "text string, lang string, source string"
    assert divergence.diverging_sources(spark.createDataFrame([], schema)).count() == 0
    rows = [("word " * 400_000 + "end", "en", "a"), ("word", "en", "b")] * 5
    wide = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("term", "n", "docs", "seat", "share", "rank", "LANGUAGE")})
    assert {tuple(r) for r in divergence.diverging_sources(wide).collect()} == brute_divergence(rows, 10)
    # Small pieces and a small store of counts change nothing.
    monkeypatch.setattr(divergence, "PIECE", 7)
    pieces = [w.decode() for part in divergence.terms_of("Ab cd,ÉF  9gh ".encode() * 3) for w in part]
    assert pieces == ["ab", "cd", "Éf", "gh"] * 3


def test_shares_are_exact_beyond_doubles(spark):
    n, total, kept = 9 * 10**17 + 7, 9 * 10**17 + 11, 3
    df = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


# Quality by attention


def test_attention_slopes():
    rng = np.random.default_rng(0)
    x, first, label, weight = rng.standard_normal((11, 6)), np.array([0, 3, 4, 9]), np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 1, 3])
    p = mil_quality.start(6, 5, 1)
    _, slopes = mil_quality.loss_and_slopes(p, x, first, label, weight, 0.01)
    for name, w in p.items():
        for at in np.ndindex(w.shape):
            values = []
            for step in (1e-5, -1e-5):
                w[at] += step
                values.append(mil_quality.loss_and_slopes(p, x, first, label, weight, 0.01)[0])
                w[at] -= step
            assert abs((values[0] - values[1]) / 2e-5 - slopes[name][at]) < 1e-6, name


def brute_score(model, raw):
    """One text's score by plain softmax over all its passages."""
    _, x = next(iter(mil_quality.bags(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))))
    h, a = model.encode(model.scaled(x.astype(float)))
    a = np.exp(a - a.max())
    z = (a / a.sum()) @ h @ model.params["out"] + model.params["out0"][0]
    return 1 / (1 + np.exp(-z))


def test_running_softmax_and_bags(monkeypatch):
    rng = np.random.default_rng(2)
    model = mil_quality.Attention(np.zeros(mil_quality.N_FEATURES), np.ones(mil_quality.N_FEATURES), mil_quality.start(mil_quality.N_FEATURES, 8, 5))
    texts = [bytes(rng.choice(np.frombuffer(b"abc DEF\n,.#5\xc3\xa9", np.uint8), n)) for n in (0, 1, 700, 1024, 1025, 70_000, 300_000, 0)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    want = [brute_score(model, t) for t in texts]
    assert np.allclose(model.score(raw, offsets), want, atol=1e-12)
    monkeypatch.setattr(mil_quality, "CHUNK", 1 << 16)  # several stretches a text
    assert np.allclose(model.score(raw, offsets), want, atol=1e-12)


def test_features_of_a_passage():
    def of(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return next(iter(mil_quality.bags(raw, np.array([0, len(raw)]))))[1][0]

    x = of("one two one two one two")
    assert abs(x[-1] - 1) < 1e-6 and abs(x[-2] - 2 / 6) < 1e-6 and abs(x[-5] - 6 / 23) < 1e-6 and abs(x[-4] - 3 / 8) < 1e-6
    assert of("a b c d e f")[-1] == 0 and not of("").any()
    assert abs(of("Ab 1!")[: mil_quality.N_KINDS**2].sum() - 1) < 1e-6


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_mil_quality"](spark, sf).toPandas()
    assert len(got) == got.doc_id.nunique() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    seen = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    seen = seen[seen.held_out]
    assert (seen.predicted == seen.quality).mean() >= 0.97


def test_quality_edges(spark):
    schema, labelled = "doc_id long, text string", "doc_id long, quality int"
    good, bad = "These are plain words, one after another, as people write them.", "#$% | && ** | $$ ## | %%"
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(200)] + [(None, good), (None, None), (300, ""), (301, None), (5, good), (5, good), (302, good * 20_000)]
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(0) for c in ("id", "score", "held_out", "label", "x")})
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 0), (9, 1), (None, 1), (11, None), (999, 1)], labelled)
    got = mil_quality.score_quality(docs, marks).toPandas()
    assert len(got) == len(rows) and got.score.notna().all() and got[got.doc_id.isna()].held_out.eq(False).all()
    assert got[got.doc_id == 302].predicted.eq(1).all() and got[got.doc_id == 4].predicted.eq(0).all()
    assert got[got.doc_id.isin([300, 301])].score.nunique() == 1 and got[got.doc_id == 5].score.nunique() == 1
    assert mil_quality.score_quality(docs, marks).toPandas().sort_values(["doc_id", "score"]).score.tolist() == got.sort_values(["doc_id", "score"]).score.tolist()
    assert mil_quality.score_quality(docs.limit(0), marks).count() == 0
    assert {r.score for r in mil_quality.score_quality(docs, marks.limit(0)).collect()} == {0.5}
    only = mil_quality.score_quality(docs, marks.where("quality = 1")).toPandas()
    assert only.predicted.eq(1).all()


@pytest.mark.parametrize("name", ["op11_mil_quality", "op12_merkle_manifest", "op13_source_divergence"])
def test_columns_of_the_contract(spark, name):
    want = {
        "op11_mil_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
        "op12_merkle_manifest": [("doc_id", "bigint"), ("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")],
        "op13_source_divergence": [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")],
    }
    assert queries.QUERIES[name](spark, SF).dtypes == want[name]
