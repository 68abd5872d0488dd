"""Near copies share dozens of large index groups; operator 5 takes those of one leader as one and loses no link."""

from __future__ import annotations

import random

from pricewell.llm import jaccard


def variants(n: int) -> list[tuple[int, str]]:
    """Copies of one text with 1 to 13 other words: of 4-word sets those with 8 changes together link at 80 percent, so some stay apart."""
    rng, out = random.Random(5), []
    for i in range(n):
        words = [f"w{j}" for j in range(300)]
        for at in rng.sample(range(300), rng.randint(1, 13)):
            words[at] = f"x{i}_{at}"
        out.append((i, " ".join(words)))
    return out


def brute(rows: list[tuple[int, str]]) -> list[tuple[int, int]]:
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    least = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = {i: low if c == high else c for i, c in least.items()}
    return sorted(least.items())


def test_groups_of_one_leader_are_one(spark):
    rows = variants(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    large = jaccard.Join(docs, 4, 80).groups()[1]
    assert jaccard.RARE < large.select("key").distinct().count() <= 150
    assert large.count() == large.select("lead", "key").distinct().count()
    expected = brute(rows)
    assert 1 < len({c for _, c in expected}) < 150
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.join(docs, 4, 80).collect()) == expected
