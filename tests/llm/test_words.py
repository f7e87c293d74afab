"""Word tries and anagram hashing against plain Python, with odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillframe.llm import anagrams, word_tries

SCHEMA = "doc_id long, text string"


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    vocabulary = [f"Word{k}" for k in range(120)] + ["naïve", "ÉTÉ", "été", "日本", "😀", "a", "x" * 900]
    texts = [rnd.choice([" ", ", ", "\n", " -- "]).join(rnd.choices(vocabulary, k=rnd.randint(1, 80))) for _ in range(120)]
    texts += [None, "", " .,\n", "one", "\x00\x7f", texts[0], "target " * 30]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, None), (-7, texts[6])]


TARGET = ["word1 WORD2 word3 naïve été", "target word1", None, "", "日本 word1 word2"]


def plain_scores(corpus, longest, buckets=10_000, min_words=20, percent=10):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
        return len(w), [" ".join(w[k : k + n]) for k in range(len(w)) for n in range(1, longest + 1) if k + n <= len(w)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in corpus for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in TARGET for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for k, text in corpus:
        n, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[5] = place
    return sorted(((r[0], *r[2:]) for r in rows), key=repr)


@pytest.mark.parametrize("longest, trie_bytes, block", [(1, 1 << 26, 1 << 20), (2, 3000, 1 << 20), (3, 1 << 26, 1 << 20)])
def test_scores_equal_plain_python(spark, monkeypatch, corpus, longest, trie_bytes, block):
    monkeypatch.setattr(word_tries, "TRIE_BYTES", trie_bytes)
    docs = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = word_tries.scores(docs, target, longest=longest).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain_scores(corpus, longest)


def test_runs_over_the_borders_of_blocks(monkeypatch):
    monkeypatch.setattr(word_tries, "BLOCK_BYTES", 7)
    text = "Aa bb, cc dd ee ff gg a hh aa bb".encode()
    words = "aa bb cc dd ee ff gg a hh aa bb".split()
    assert [w.decode() for b in word_tries.word_blocks(text) for w in b] == words
    for longest in (1, 2, 3, 20):
        trie, n = word_tries.WordTrie(longest, lambda crc: 0), 0
        for nodes, more in trie.walk(text):
            n += more
            for node in nodes:
                node[2] += 1
        truth = collections.Counter(zlib.crc32(" ".join(words[k : k + m]).encode()) for k in range(len(words)) for m in range(1, longest + 1) if k + m <= len(words))
        got, levels = collections.Counter(), [trie.top]
        while levels:
            for children, crc, count in levels.pop().values():
                got[crc] += count
                levels += [children] if children else []
        assert n == len(words) and got == truth
        assert trie.counts(1 << 10).sum() == sum(truth.values())


def test_drawn_documents_keep_their_columns(spark, corpus):
    clash = ("__words", "__features", "__id", "__place", "c0", "c1", "rank", "score")
    docs = spark.createDataFrame(corpus, SCHEMA).withColumns({c: F.lit("mine") for c in clash})
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = word_tries.draw(docs, target, percent=30)
    assert out.columns == [*docs.columns, "__score"]
    truth = collections.Counter((r[0], r[3]) for r in plain_scores(corpus, 1, percent=30) if r[4])
    rows = out.collect()
    assert collections.Counter((r.doc_id, r["__score"]) for r in rows) == truth and all(r.rank == r.c1 == "mine" for r in rows)
    assert word_tries.draw(docs, target, percent=0).count() == 0


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], SCHEMA)
    empty = spark.createDataFrame([], "text string")
    rows = word_tries.scores(docs, empty).collect()
    assert sorted((r.doc_id or 0, r.n_features) for r in rows) == [(0, 0), (1, 2), (1, 2)] and all(r["rank"] is None for r in rows)
    assert word_tries.scores(docs.limit(0), empty).count() == 0
    same = spark.createDataFrame([(k // 2, "word " * 25) for k in range(40)], SCHEMA)
    ranks = sorted(r["rank"] for r in word_tries.scores(same, empty, percent=50).collect() if r["rank"])
    assert ranks == list(range(1, 21))


def plain_variants(rows, thin=97, min_chars=5, min_n=3, factor=2):
    words = collections.Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if thin and h % thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= min_chars and n >= min_n}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    out = {}
    for w, n in words.items():
        around = [x for x in words if x != w and near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        strong = best is not None and words[best] >= factor * n
        out[w] = [w, best if strong else None, w, n, len(around), words[best] if strong else None]
    for w, row in out.items():
        while out[row[2]][1] is not None:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


def _columns(rows):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows)


def test_variants_equal_plain_python(spark):
    rnd = random.Random(4)
    stems = ["".join(rnd.choices("abcé", k=rnd.randint(4, 7))) for _ in range(60)] + ["ÀÉcole", "école", "ecole", "aaaaa", "aaaaaa", "aaaaaaa", "ab" * 3000, "ab" * 2999 + "a"]
    pool = []
    for k, w in enumerate(stems):
        pool += [w] * (3 * 2 ** (k % 5))
        for _ in range(3):
            at = rnd.randrange(len(w))
            pool += [rnd.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1 :]])] * rnd.randint(1, 5)
    rnd.shuffle(pool)
    rows = [(k, rnd.choice([" ", "-", ", 7 "]).join(pool[k * 20 : k * 20 + 20])) for k in range(len(pool) // 20 + 1)]
    rows += [(None, None), (5, ""), (None, "Aaaaa aaaAa"), (5, rows[5][1]), (5, "× ÷ 12")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string")
    for thin in (97, 3, 0):
        assert _columns(anagrams.variants(docs, thin=thin).collect()) == plain_variants(rows, thin)
    assert anagrams.variants(docs.limit(0)).count() == 0


def test_roots_follow_long_chains(spark):
    words = [("abcde" + "f" * k, 2**k) for k in range(20)]
    rows = anagrams.group_variants(spark.createDataFrame(words, "word string, n long")).collect()
    assert {r.root for r in rows} == {words[-1][0]} and sum(r.form is None for r in rows) == 1


def test_keys_tell_letters_apart(spark):
    words = ["abc", "cab", "abd", "", "é", "\U0001f600\U0001f601", "ÿ" * 5000]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", anagrams.anagram_key(F.col("w")).alias("k")).collect()
    key = {r.w: r.k for r in rows}
    assert key["abc"] == key["cab"] == 97**5 + 98**5 + 99**5 != key["abd"] and key["é"] == 233**5 and key["ÿ" * 5000] == 5000 * 255**5 % anagrams.MODULUS


def test_words_that_are_anagrams_but_for_a_letter_do_not_meet(spark):
    """All orders of six letters: each word has at most a few partners with a half in common, of 720 of its key."""
    import itertools

    rows = [("".join(p) + x, 3) for p in itertools.permutations("abcdef") for x in "gh"]
    words = spark.createDataFrame(rows, "word string, n long")
    pairs = anagrams.near_pairs(words)
    assert pairs.count() == 720
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
