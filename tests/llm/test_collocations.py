import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from affinityloom.llm import collocations

from .brute import LOW


def best_phrases(docs, least, per_lang, percent=100):
    """Plain counting of all phrases: docs are (lang, text)."""
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {k: a for k, a in f.items() if a >= least}
    rows = []
    for (lang, p), a in f.items():
        if len(p) < 2 or any(x[0] == lang and len(x[1]) > len(p) and 100 * f[x] >= percent * a and
                             any(x[1][i:i + len(p)] == p for i in range(len(x[1]))) for x in f):
            continue
        l, r, score = min(((f[lang, p[:k]], f[lang, p[k:]], 1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]])) for k in range(1, len(p))),
                          key=lambda c: c[2])
        rows.append((lang, " ".join(p), a, l, r, total[lang], score))
    out = []
    for lang in total:
        mine = sorted((x for x in rows if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:per_lang]
        out += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def phrases():
    """Few words in a hot order, pieces of every kind, nulls, two langs and words that are spelled alike but for case."""
    rng = random.Random(8)
    vocabulary = ["der", "Die", "das", "Éa", "ÉA", "東京", "x y", "und", "O'Neil", "-", "\x1c"]
    docs = []
    for i in range(400):
        w = [rng.choice(vocabulary[: rng.randint(2, 11)]) + rng.choice(["", "", "", ".", ",", "\n", "!?"]) for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice(["de", "de", "fr", None]), " ".join(w)))
    fixed = "a passage of more than five words stays together"
    return docs + [(None, None), ("fr", ""), ("xx", " \t\n.")] + [("de", fixed + rng.choice([".", " end."])) for _ in range(70)]


@pytest.fixture
def table(spark):
    return lambda docs: spark.createDataFrame(
        [(i, t, lang, "s", 1, 2) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n long, w1 int")


@pytest.mark.parametrize("least,per_lang,pointers", [(20, 2000, 1 << 19), (60, 5, 7), (3, 60, 400)])
def test_equals_plain_counts(table, phrases, monkeypatch, least, per_lang, pointers):
    monkeypatch.setattr(collocations, "TASK_WORDS", pointers)
    docs = phrases if least > 3 else phrases[::9]
    want = best_phrases(docs, least, per_lang)
    assert len(want) > 10
    assert got(collocations.collocations(table(docs), least, per_lang)) == want


def test_sql_on_the_smallest_table(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(db.execute(collocations.SQL).fetchall())
    assert want and got(collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == want


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(1)
    keys = rng.integers(-2, 4, (500, 5))
    for k in range(1, 5):
        keys[keys[:, k - 1] == 0, k] = 0
    weights = rng.integers(1, 9, 500)
    want = Counter()
    for row, n in zip(keys.tolist(), weights.tolist()):
        row = row[:row.index(0)] if 0 in row else row
        want.update({tuple(row[:k]): n for k in range(3, len(row) + 1)})
    found = {tuple(keys[r, :k].tolist()): n for r, k, n in collocations.sorted_counts(keys, weights, np.zeros(500, bool), 30)}
    assert found == {p: n for p, n in want.items() if n >= 30} and found


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    phrases = spark.createDataFrame([("en", [1], big), ("en", [2], 3), ("en", [1, 2], 3)], "lang string, words array<bigint>, a bigint")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n bigint")
    (row,) = collocations.scored(phrases, totals).collect()
    assert row["score"] == 1000 * 3 * 9 * big // (big * 3) and (row["l"], row["r"]) == (big, 3)


def test_empty(frame):
    assert collocations.collocations(frame([])).collect() == []
