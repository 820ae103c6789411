"""Near duplicates of a whole table by an inverted index, against the forest."""
from collections import defaultdict

from fixtures import shingle_set

from firmground.llm.queries import QUERIES


def components(texts, share=0.75):
    """The smallest id reachable from each id, over all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in texts}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    index, seen = defaultdict(list), {}
    for i in sorted(sets):
        s = sets[i]
        if not s:
            continue
        if s in seen:
            up[find(i)] = find(seen[s])
            continue
        seen[s] = i
        common = defaultdict(int)
        for g in s:
            for j in index[g]:
                common[j] += 1
            index[g].append(i)
        for j, n in common.items():
            if n >= share * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op7_minhash_near_dedup"](spark, folder).collect()
    root = components(texts)
    assert {r.doc_id: r.component_id for r in got} == root
    assert all(r.n_shingles == len(shingle_set(t)) for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(texts)))
