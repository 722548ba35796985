import random
import re
import zlib
from collections import Counter

import pytest

from affinityloom.llm import spelling

from .brute import LOW


def counted(docs, slip=199):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def variants(n):
    letters = sorted({c for w in n for c in w})
    out = {}
    for w in n:
        edits = {w[:k] + w[k + 1:] for k in range(len(w))}
        edits |= {w[:k] + c + w[k + d:] for k in range(len(w) + 1) for c in letters for d in (0, 1)}
        near = [v for v in edits if v in n and one_edit(v, w)]
        form = min(near, key=lambda v: (-n[v], v)) if near else None
        if form is not None and n[form] < 5 * n[w]:
            form = None
        out[w] = (form, n[w], len(near))
    result = {}
    for w, (form, c, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        result[w] = (form, root, c, k, n[form] if form else None)
    return result


def by_word(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("region_words", [4096, 3])
def test_whole_table(frame, rows, region_words):
    want = variants(counted(rows))
    assert len(want) > 500 and any(v[0] for v in want.values())
    assert by_word(spelling.spelling_variants(frame(rows), region_words=region_words)) == want


@pytest.mark.parametrize("region_words", [4096, 2])
def test_many_near_words(frame, region_words):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(900)}
    docs = [(i, " ".join([w] * rng.choice((5, 6, 30, 160, 900)))) for i, w in enumerate(sorted(words))]
    want = variants(counted(docs))
    assert sum(v[3] for v in want.values()) > 3000 and len({v[1] for v in want.values() if v[0] != v[1] and v[0]}) > 3
    assert by_word(spelling.spelling_variants(frame(docs), region_words=region_words)) == want


def test_odd_texts_null_ids_and_extra_columns(spark, odd):
    docs = [(None if i == 3 else i, t) for i, t in odd for _ in range(3)]
    made = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n long, region string")
    assert by_word(spelling.spelling_variants(made)) == variants(counted(docs))


def test_empty(frame):
    assert spelling.spelling_variants(frame([])).collect() == []
