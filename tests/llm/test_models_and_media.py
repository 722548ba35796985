import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict

import pytest

from affinityloom.llm import kneser_ney, media
from affinityloom.llm.common import scratch_path

from . import brute


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def discounts(n):
    if not (n[1] and n[2] and n[3]):
        return 0.5, 0.75, 0.9
    y = n[1] / (n[1] + 2 * n[2])
    made = 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]
    return tuple(min(max(d, 0.01), k + 0.99) for k, d in enumerate(made))


def model(pairs):
    import re

    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.LOW)), 0]
    grams = Counter()
    for i, t in pairs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w = tok(t)
            grams.update(zip([1, *w], w))
    c, held, after = Counter(), Counter(), defaultdict(list)
    for (v, w), n in grams.items():
        c[w] += n
        held[w] += 1
        after[v].append(n)
    high, low = discounts(Counter(grams.values())), discounts(Counter(held.values()))
    total, types = sum(c.values()), len(c)

    def cut(n, d):
        return n - d[min(n, 3) - 1] if n else 0

    rest = sum(n - cut(n, low) for n in held.values()) / len(grams)
    out = {}
    for i, t in pairs:
        w = tok(t)
        p = 0.0
        for v, x in zip([1, *w], w):
            lower = cut(held[x], low) / len(grams) + rest / (types + 1)
            if v in after:
                n = sum(after[v])
                lower = cut(grams[v, x], high) / n + sum(k - cut(k, high) for k in after[v]) / n * lower
            p += math.log10(lower)
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), total, base, p)
    return out


@pytest.mark.parametrize("which", ["rows", "odd"])
def test_kneser_ney(frame, request, which):
    pairs = request.getfixturevalue(which)
    got = by_id(kneser_ney.lm_digest(frame(pairs)), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = model(pairs)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-9)


@pytest.mark.parametrize("which", ["rows", "odd"])
def test_media(frame, request, which):
    pairs = request.getfixturevalue(which)
    got = by_id(media.media_digest(frame(pairs)), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "error")
    for i, t in pairs:
        data = (t or "").encode()
        full = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert got.pop(i) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(full) + 44, None)
    assert not got


def test_small_ranges_and_broken_members(spark, frame, odd):
    folder = scratch_path(spark, "archives")
    media.write_archives(frame(odd).coalesce(1), folder)
    spark.dataSource.register(media.ArchiveSource)
    small = spark.read.format("media_archive").option("rangeBytes", "300").load(folder)
    assert small.count() == len(odd) and small.where("error is not null").count() == 0
    path = folder.removeprefix("file:") + "/part-000000-00000.zip"
    data = bytearray(open(path, "rb").read())
    data[120] ^= 255
    open(path, "wb").write(data)
    rows = media.with_features(media.read_archives(spark, folder)).collect()
    assert len(rows) == len(odd) and sum(r["error"] is not None for r in rows) == 1
    assert all(json.loads(r["feature"]) for r in rows if r["error"] is None)


def test_kneser_ney_stores_its_bigrams_once(frame, rows, monkeypatch):
    names = []
    plain = kneser_ney.stored
    monkeypatch.setattr(kneser_ney, "stored", lambda df, name: names.append(name) or plain(df, name))
    assert kneser_ney.lm_digest(frame(rows)).count() == len(rows)
    assert names == ["bigrams", "vocabulary"]
