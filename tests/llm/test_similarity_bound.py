"""Near duplicates at the bound of 0.8: all pairs at it are linked, none below."""

from marlstone.llm import simhash


def unit(k, n):
    return [f"w{k}_{i}" for i in range(n)]


def test_links_at_the_bound_and_not_below(spark):
    docs, want = [], {}
    for k in range(60):
        for at, (n, shared) in enumerate([(8, 8), (19, 16), (24, 22), (100, 86)]):
            # shingles: 4 of 5, 12 of 15 or more, 20 of 20 + 1, and a long pair that parts below 0.8
            a, b = 8 * k + 2 * at, 8 * k + 2 * at + 1
            words = unit(a, n)
            other = words + ["tail"] if shared == n else words[:shared] + unit(b, 2 if n < 100 else 13)
            docs += [(a, " ".join(words)), (b, " ".join(other))]
            sets = [set(zip(*(w[i:] for i in range(5)))) for w in (words, other)]
            alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            want[a], want[b] = a, a if alike >= 0.8 else b
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want
    assert 0 < sum(i != c for i, c in want.items()) < len(want) / 2
