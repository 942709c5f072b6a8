"""The whole pipeline over planted documents beside brute force of its first three stages, and over an empty table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_group_operators import brute_jaccard, brute_repeats
from test_text_operators import brute_quality

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of an operator's own that a table may have as well.
CLASHES = ("_m", "_row", "_h", "host", "component", "klass", "n_words", "keep", "rate", "shingle", "anchor", "node", "one", "ids")


def planted():
    rng = random.Random(21)
    pool = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("n", "r", "st", "l")]
    write = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    rows = [(i, write(rng.randrange(60, 140)), "en", f"s{i % 3}") for i in range(60)]
    base = rows[0][1].split()
    for i in range(4):  # near copies: one word in a hundred differs, so five-word shingles agree in more than 0.8
        own = list(base)
        own[rng.randrange(len(own))] = f"edit{i}"
        rows.append((100 + i, " ".join(own), "en", "s1"))
    rows += [(200 + i, rows[5][1], "en", "s2") for i in range(3)]  # exact copies
    passage = write(60)  # well beyond 200 bytes, in documents that are otherwise apart
    rows += [(300 + i, f"{write(70)} {passage} {write(70)}", "en", "s0") for i in range(3)]
    rows += [(400, "too short", "en", "s0"), (401, "ab cd ef " * 60, "en", "s1"), (402, "", "en", "s1"), (403, None, "en", "s2"), (None, write(90), None, None), (500, write(90), None, "s0"), (500, write(80), "en", "s0")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture
def folder(spark, tmp_path):
    def made(rows):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in CLASHES})
        df.write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(r[0], 1, 0) for r in rows[:40]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return made


def test_run_against_brute_force(spark, folder):
    rows = planted()
    got = corpus_pipeline.run(spark, folder(rows)).collect()
    good = []
    for r in rows:
        n_words, _, _, _, repeated = brute_quality(r[1])
        if n_words >= 50 and 100 * repeated <= 50 * n_words:
            good.append(r)
    numbered = {k: r for k, r in enumerate(sorted(good, key=lambda r: (r[0] is None, r[0] or 0)))}
    components = brute_jaccard([(k, r[1]) for k, r in numbered.items()], 5, 80)
    kept = [r for k, r in numbered.items() if components[k][1] == k]
    masks = brute_repeats([r[1].encode() for r in kept])
    texts = {}
    for r, mask in zip(kept, masks):
        texts.setdefault(r[0], []).append(np.frombuffer(r[1].encode(), np.uint8)[~mask].tobytes().decode())
    assert {100, 101, 102, 103, 200, 201, 202, 400, 401, 402, 403}.isdisjoint(texts) and sum(m.any() for m in masks) == 3
    # Mixing takes no clean document away here: none is toxic, so rates are 1 for all, but for the draw of at most one row in twenty.
    assert len(got) >= 0.95 * len(kept) and len({r.doc_id for r in got}) >= 0.95 * len(texts)
    for r in got:
        assert r.decoded in texts[r.doc_id]
    assert len(got) <= len(kept)


def test_run_over_an_empty_table(spark, folder):
    out = corpus_pipeline.run(spark, folder([]))
    assert out.count() == 0 and "doc_id" in out.columns
