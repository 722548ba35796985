from collections import Counter

import numpy as np
import pytest

from affinityloom.llm import classifiers


def grams(text):
    data = b" " + (text or "").encode().lower() + b" "
    return {data[i:i + n] for n in classifiers.GRAMS for i in range(len(data) - n + 1)}


@pytest.mark.parametrize("chunk", [1 << 24, 20000])
def test_ratios_are_of_exact_counts(spark, rows, odd, monkeypatch, chunk):
    """Kept features and their ratios equal a count of the n-grams themselves, also over many chunks."""
    monkeypatch.setattr(classifiers, "CHUNK", chunk, raising=False)
    labelled = [(t, int(i % 7 == 0)) for i, t in [*rows[:80], *odd]]
    counts = Counter(), Counter()
    for text, label in labelled:
        counts[label].update(grams(text))
    p = sum(k for _, k in labelled)
    n = len(labelled) - p
    found = []
    for g in counts[0].keys() | counts[1].keys():
        neg, pos = counts[0][g], counts[1][g]
        if neg + pos >= 2:
            ratio = np.log((pos + 1) / (p + 2)) - np.log((neg + 1) / (n + 2))
            found.append((abs(ratio) * np.sqrt(pos + neg), ratio))
    want = sorted(found, key=lambda x: -x[0])[:classifiers.KEPT_GRAMS]
    hashes, ratios = classifiers.log_count_ratios(spark.createDataFrame(labelled, "text string, label int"))
    assert len(found) > len(want) == len(set(hashes.tolist()))
    assert np.sort(ratios) == pytest.approx(np.sort([r for _, r in want]))


def test_unlike_grams_share_no_weight(spark):
    texts = [(f"bad{i} awful{i} x", 1) for i in range(20)] + [(f"good{i} fine{i} x", 0) for i in range(20)]
    labelled = spark.createDataFrame(texts, "text string, label int")
    hashes, _ = classifiers.log_count_ratios(labelled)
    held = [set(classifiers.Grams(hashes).hashes[classifiers.Grams(hashes).places(t.encode())].tolist()) for t in ("bad awful", "0123456789")]
    assert held[0] and not held[1]


def test_a_task_holds_few_grams_at_once():
    """Several tasks share an executor: one's buffer of hashes, sorted, cut and packed, stays at tens of MB."""
    assert classifiers.CHUNK * 8 <= 32 << 20
