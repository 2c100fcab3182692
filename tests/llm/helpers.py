"""Small tables and brute-force versions the operators are held against."""

import collections
import json
import random

from pyspark.sql import types as T

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def documents(spark, texts, ids=None, extra=()):
    """A documents table of the given texts; ``extra`` names clashing columns."""
    ids = range(len(texts)) if ids is None else ids
    schema = T.StructType(DOCS.fields + [T.StructField(c, T.StringType()) for c in extra])
    rows = [(i, t, "en", "s", None if t is None else len(t), *["x"] * len(extra))
            for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, schema)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD_TEXTS = [None, "", " \n\t ", "a", "a" * 3000, "word " * 3000, "ñandú 日本語 \u0085x",
             "<|endoftext|> a <|endoftext|>", "\x01 \x01 a\x01b", "!!! ... ---", "same", "same"]


class Groups:
    """Union-find for expectations."""

    def __init__(self):
        self.parent = {}

    def root(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text, words=5):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    if len(w) < words:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1))


def near_duplicates(rows, percent=75):
    """{index: smallest index linked} over texts, by comparing all pairs that
    share a shingle."""
    sets = [shingles(t) for t in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = collections.Counter()
    for own in holders.values():
        for x, i in enumerate(own):
            for j in own[x + 1:]:
                common[i, j] += 1
    groups = Groups()
    for (i, j), o in common.items():
        if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
            groups.join(i, j)
    return [groups.root(i) for i in range(len(rows))], sets


def without_repeats(rows, length=50):
    """{(id, text): words kept} for rows in id order, by remembering every run."""
    seen, out = set(), {}
    for doc_id, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            run = tuple(w[i:i + length])
            if run in seen:
                gone[i:i + length] = [True] * length
            seen.add(run)
        out[doc_id] = [x.decode() for x, g in zip(w, gone) if not g]
    return out


def read_json(path):
    with open(path) as f:
        return json.load(f)
