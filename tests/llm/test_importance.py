"""op12: importance resampling against a plain version, and odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import ODD_TEXTS, documents, prose
from tidepool.llm import importance
from tidepool.llm.importance import GramTable, gram_batches, importance_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, longest=2):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10000


def plain(docs, target, percent=25, min_words=20):
    s = Counter(bucket(g) for _, t in docs for g in grams(t))
    t = Counter(bucket(g) for x in target for g in grams(x))
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000)
                                          / ((s[b] + 1) * (all_t + 10000))))

    out = []
    for i, text in docs:
        g = [gain(bucket(x)) for x in grams(text)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words(text)), len(g), weight, score, None])
    able = sorted((r for r in out if r[1] >= min_words),
                  key=lambda r: (-r[4], r[0] is not None, r[0] or 0, -r[3], r[2]))
    for place, r in enumerate(able[:percent * len(able) // 100], start=1):
        r[5] = place
    return sorted(map(str, out))


def shown(df):
    return sorted(str([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]])
                  for r in df.collect())


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("table_words", [50, 200_000])
def test_resample_equals_plain_version(spark, monkeypatch, table_words):
    monkeypatch.setattr(importance, "TABLE_WORDS", table_words)
    rng = random.Random(5)
    texts = [" ".join(prose(rng, rng.choice([5, 19, 20, 60, 200]))) for _ in range(80)]
    texts += ODD_TEXTS + [texts[3], texts[3], "É École ÉCOLE " * 12, "A-b_c.D " * 9]
    ids = [*range(len(texts) - 3), 3, None, None]  # repeated rows, a repeated id, null ids
    wanted = [" ".join(prose(rng, 30, 50)), texts[0], None, ""]
    docs = documents(spark, texts, ids=ids, extra=["score", "rank", "n_words"]).repartition(3)
    got = importance_resample(docs, target(spark, wanted))
    assert shown(got) == plain(list(zip(ids, texts)), wanted)


def test_empty_tables(spark):
    docs = documents(spark, [" ".join(prose(random.Random(1), 40))] * 9 + [None])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert shown(importance_resample(docs, target(spark, []))) == plain(rows, [])
    assert importance_resample(documents(spark, []), target(spark, ["a b"])).collect() == []


def test_equal_keys_of_other_bytes_get_places_of_their_own(monkeypatch):
    import xxhash
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    rng = random.Random(2)
    own = [b"x" * rng.randrange(1, 40) + rng.choice([b"a", b"b", b"cd", b"", b" q"])
           for _ in range(3000)]
    table = GramTable(own, 97)
    place = {}
    for g, slot in zip(own, table.slot.tolist()):
        assert place.setdefault(g, slot) == slot
    assert len(set(place.values())) == len(place)
    for g, n in Counter(own).items():
        assert table.count[place[g]] == n and table.bucket[place[g]] == zlib.crc32(g) % 97
    counts = table.bucket_counts(97)
    assert counts.sum() == len(own) and counts[zlib.crc32(own[0]) % 97] > 0


def test_very_long_text_goes_on_in_the_next_batch(monkeypatch):
    import tidepool.llm.common as common
    monkeypatch.setattr(common, "LONG_CHARS", 50)
    monkeypatch.setattr(importance, "TABLE_WORDS", 7)
    rng = random.Random(4)
    texts = ["a b", " ".join(prose(rng, 100)), "c", " ".join(prose(rng, 41)), ""]
    for longest in (1, 2, 3):
        found = [Counter() for _ in texts]
        for own, owners, sizes, _ in gram_batches(pa.array(texts), longest):
            at = np.cumsum([0, *sizes])
            for owner, a, b in zip(owners, at, at[1:]):
                found[owner].update(g.decode() for g in own[a:b])
        assert found == [Counter(grams(t, longest)) for t in texts]
