"""Operators on documents against brute force, with nulls, empty and odd texts, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import decontaminate, graph, kernels, line_dedup, near_dedup, packing, pii, quality, rules, url_filter
from quillframe.storage import written

SCHEMA = "doc_id long, text string, __doc string, key string, name string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{k}x{k % 7}" for k in range(400)] + ["É", "naïve", "😀"]
    line = "A shared Line that is long enough to count as one of them"
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 120))) for _ in range(60)]
    texts += [" ".join(w if rnd.random() > 0.02 else "edit" for w in t.split(" ")) for t in texts[:30]] + texts[:5]
    texts += [f"{t}\n  {line.upper() if k % 2 else line}\t\nend {k}" for k, t in enumerate(texts[:8])]
    texts += [None, "", " \n\t", "one", "one two", "one two", "x" * 5000, "\n\n", "a\u00a0b"]
    return list(enumerate(texts)) + [(3, texts[3]), (None, "nobody's text"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in corpus], SCHEMA)


def test_kernels_cut_and_hash_words_alike(corpus):
    import pyarrow as pa

    texts = [t for _, t in corpus]
    seen = {}
    for lo, _, raw, at in kernels.text_chunks(pa.array(texts, pa.string()), 2000):
        starts, ends, first = kernels.word_spans(raw, at)
        hashes = kernels.span_hashes(raw, starts, ends)
        for d in range(len(at) - 1):
            own = [bytes(raw[s:e]).decode() for s, e in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])]
            assert own == words(texts[lo + d])
            for w, h in zip(own, hashes[first[d] : first[d + 1]]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def _components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_dedup_equals_all_pairs(docs, corpus):
    sets = {}
    for i, t in corpus:
        if i is not None:
            w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    expected = _components(sets, 85)
    got = near_dedup.groups(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} - {None} == set(expected.values())


def test_near_dedup_takes_ids_of_any_size(spark):
    text = " ".join(f"word{k}" for k in range(60))
    ids = [-(2**63), -5, 0, 2**62, 2**62 + 1, 2**63 - 1]
    rows = [(i, f"{text} tail{k % 2}") for k, i in enumerate(ids)] + [(2**63 - 2, "something else altogether")] + [(None, f"{text} tail0"), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.groups(d).filter("doc_id is not null").collect()}
    assert got == {i: (ids[0], i == ids[0]) for i in ids} | {2**63 - 2: (2**63 - 2, True)}
    assert sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_copies(d).collect()), key=repr) == sorted([rows[0], *rows[6:]], key=repr)
    assert near_dedup.groups(d.limit(0)).count() == 0 and near_dedup.groups(d.filter("doc_id is null")).count() == 2


def test_near_dedup_plans_stay_small(spark, monkeypatch):
    """The driver plans each table anew after each of its stages; with a column for each word of a sketch that filled its heap."""
    texts = [" ".join(f"w{d % 20}x{k if k < 200 - (0, 5, 40)[d // 20] else -d}" for k in range(200)) for d in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = []

    def measured(df, *partition_by):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, *partition_by)

    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    monkeypatch.setattr(near_dedup, "written", measured)
    monkeypatch.setattr(graph, "written", measured)
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.groups(docs).collect()}
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    words = [t.split() for t in texts]
    sets = [{tuple(w[n : n + 5]) for n in range(len(w) - 4)} for w in words]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert got == dict(enumerate(root)) and len(set(root)) == 40
    assert max(sizes) < 8_500 and sum(sizes) < 28_000, sorted(sizes)


def test_sketch_bound_holds_for_linked_sets():
    random_ = np.random.default_rng(1)
    for size in (20, 300, 3000):
        base = random_.integers(0, 1 << 63, size, np.uint64)
        other = np.concatenate([base[: int(size * 0.93)], random_.integers(0, 1 << 63, int(size * 0.05), np.uint64)])
        sets = [np.unique(base), np.unique(other)]
        bounds = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        _, _, sketch = near_dedup.Signer(1, 1)(np.concatenate(sets), bounds)
        far, can = near_dedup.sketch_far(np.array([float(len(sets[0]))]), np.array([float(len(sets[1]))]), 85)
        assert can[0] and np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= far[0]


def _line_truth(corpus):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    holders = collections.defaultdict(set)
    for i, t in corpus:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in corpus:
        kept = [x for x in (t or "").split("\n") if not (len(holders[key(x)]) >= 5 and (-1 if i is None else i) < max(holders[key(x)]))]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2)])
def test_line_dedup_does_not_depend_on_batches(docs, corpus, batches, fanout):
    got = line_dedup.digests(docs, batches=batches, fanout=fanout).collect()
    assert sorted(map(tuple, got), key=repr) == _line_truth(corpus)


def test_line_runs_are_opened_again_by_a_later_job(spark, tmp_path):
    line = lambda n: f"line number {n} is long enough to be counted here"
    first = [(k, "\n".join(line(n) for n in range(5) if k % (n + 1) == 0)) for k in range(8)]
    later = [(100 + k, "\n".join([line(0), line(4), line(9)])) for k in range(6)]
    folder = f"file://{tmp_path}/runs"
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(first), batches=2, fanout=2, runs_dir=folder).collect()}
    assert not any(t.name.startswith("line_runs_") for t in spark.catalog.listTables())  # a later job has not seen the first one's tables
    two = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(later), batches=2, fanout=2, runs_dir=folder).collect()}
    count = lambda docs, n: sum(line(n) in t for _, t in docs)
    common = [n for n in range(10) if count(first, n) >= 5]
    assert common == [0] and {k for k, t in one.items() if line(0) in t} == {7}
    # line 0 has its holder in the first job, line 4 had two documents there and keeps the larger one as its holder, line 9 is new
    assert {k for k, t in two.items() if line(0) in t} == set() and {k for k, t in two.items() if line(4) in t} == set() and {k for k, t in two.items() if line(9) in t} == {105}
    batch = spark.range(10).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("__line"), F.lit(1).alias("__docs"))
    plan = line_dedup.LineRuns(spark, folder, 2)
    joined = batch.groupBy("__line").agg(F.sum("__docs")).join(plan.scan(plan.live).hint("merge"), "__line", "left")._jdf.queryExecution().executedPlan().toString()
    assert joined.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in joined
    plan.close()


@pytest.mark.parametrize("partitions", ["1", "4", "7"])
@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_count_each_line_once_over_all_batches(spark, fanout, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        runs, truth = line_dedup.LineRuns(spark, fanout=fanout), {}
        for k in range(7):  # falling ids; line n is in every (n % 5 + 1)-th batch
            own = {n: 100 - 10 * k - n % 3 for n in range(40) if k % (n % 5 + 1) == 0}
            for n, doc in own.items():
                docs, holder = truth.get(n, (0, doc))
                truth[n] = docs + 2, holder
            runs.add(spark.createDataFrame([(b"line %d" % n, 2, doc) for n, doc in own.items()], runs.COLUMNS))
        assert len(runs.levels) > 1 and len(runs.live) > 1
        got = runs.totals()
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
        assert len(rows) == len(truth) and {bytes(r[0]): (r[1], r[2]) for r in rows} == {b"line %d" % n: v for n, v in truth.items()}
        assert "Exchange" not in plan and "Union" not in plan
        runs.drop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("batches, fanout", [(1, 3), (2, 2), (4, 2), (4, 3), (8, 2)])
def test_lines_that_documents_of_all_batches_share(spark, batches, fanout):
    rnd = random.Random(3)
    line = lambda n: f"shared line number {n:03} that is long enough to be counted"
    held = {}
    for n in range(60):  # exactly 3 to 7 documents anywhere among 200; some of them twice in a document
        for k in rnd.sample(range(200), 3 + n % 5):
            held.setdefault(k, []).extend([n] * (1 + n % 2))
    for n, ids in enumerate(([0, 1, 2, 198, 199], [0, 60, 120, 180], [5, 65, 66, 125, 185, 199])):
        for k in ids:
            held.setdefault(k, []).append(100 + n)
    rows = [(k, "\n".join([f"own {k}", *(line(n).upper() if k % 2 else f"  {line(n)}\t" for n in held.get(k, []))])) for k in range(200)]
    got = line_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, fanout=fanout).collect()
    assert sorted(map(tuple, got), key=repr) == _line_truth(rows)


def test_a_job_that_dies_leaves_the_saved_runs_as_they_were(spark, tmp_path):
    rows = [(k, f"a line that many documents share, all of them {k % 2}") for k in range(12)]
    folder = f"file://{tmp_path}/runs"
    line_dedup.lost_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=1, fanout=2, runs_dir=folder)
    saved = sorted(map(tuple, (first := line_dedup.LineRuns(spark, folder, 2)).totals().collect()))
    first.add(spark.createDataFrame([(b"new", 1, 1)], first.COLUMNS))  # merges with the saved run; never saved
    first.close()
    again = line_dedup.LineRuns(spark, folder, 2)
    assert sorted(map(tuple, again.totals().collect())) == saved
    again.close()


def test_line_dedup_keeps_columns(docs, corpus):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sum("A SHARED LINE" in (r.text or "").upper() for r in out.collect()) == 1


@pytest.fixture(scope="module")
def tokenized():
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: np.append(np.array(fresh.encode(t or "", add_special_tokens=False).ids, np.uint32), np.uint32(2)).astype("<u4")


def test_packing_places_every_token_once(spark, docs, corpus, tokenized):
    odd = [(700, "ends<|endoftext|>here"), (701, "<|endoftext|>"), (702, "<|endoftext|> é 字 <|endoftext|" * 30)]
    got = packing.pack(docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")), capacity=64).collect()
    assert 50256 in tokenized(odd[0][1])
    texts = {i: t for i, t in [*corpus, *odd] if i is not None and i != 3}
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, t in texts.items():
        ids = tokenized(t)
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own) and all(r.length == 64 for r in own[1:])
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.05 * -(-total // 64) + 1


def test_best_two_fit_uses_every_length():
    rnd = random.Random(2)
    for _ in range(20):
        lengths = collections.Counter(rnd.randint(1, 50) for _ in range(300))
        patterns = packing.best_two_fit(dict(lengths), 50)
        used = collections.Counter()
        for p, n in patterns:
            assert sum(p) <= 50
            for x in p:
                used[x] += n
        assert used == lengths


def test_encoders_agree(tokenized):
    rnd = random.Random(3)
    chars = [chr(k) for k in range(0x180)] + ["€", "…", "’", "—", "字", "😀", "\u2028", "<|endoftext|>", "<|"]
    encode = packing.Encoder.shared()
    for _ in range(500):
        t = "".join(rnd.choices(chars, k=rnd.randint(0, 30)))
        assert np.array_equal(encode(t), tokenized(t)[:-1]), repr(t)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _base_spans(text):
    out = []
    luhn = lambda s: sum((int(c) * (1 + k % 2)) // 10 + (int(c) * (1 + k % 2)) % 10 for k, c in enumerate(s[::-1])) % 10 == 0
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_pii_base_and_bootstrapping(spark):
    rnd = random.Random(1)
    parts = ["1", "2", "4041894974608795", "0", "255", "256", ".", "..", "@", "a", "b.c", "-", " ", "  ", "+", "(", "é", "_", "%", "\n", "😀", "x@y.zz", "1.2.3.4", "+1 (988) 555-2485"]
    rows = [(k, "".join(rnd.choices(parts, k=rnd.randint(0, 40)))) for k in range(300)] + [(300, None), (301, ""), (302, "1 " * 20000), (303, "a@b" + ".c" * 20000), (7, "again 1.2.3.4"), (None, "x@y.zz")]
    got = pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = sorted(((str(i), hashlib.sha256(_base_spans(t).encode()).hexdigest()) for i, t in rows))
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == expected
    told = [(k, f"my account number: user{k}@mail.example.com then") for k in range(20)] + [(99, "my account number: QX-99812-77 then")]
    found = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert found[99] == "email:19:30"
    told = [(k, f"call 1234567 or Tel +1 (988) 555-{2000 + k} now") for k in range(20)] + [(97, "Tel 0301 2345678 now"), (98, "id 77-1234 Tel 030-2345678, 99"), (96, "x" * 5000 + " Tel 030 23 45 678."), (95, "2345678 0301"), (94, None), (93, "")]
    d = spark.createDataFrame(told, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("__text", "key", "base", "seen", "kind")})
    found = {r.doc_id: r.spans for r in pii.digests(d).collect()}
    assert [found[k] for k in (97, 98, 96, 95, 94, 93)] == ["phone:4:16", "phone:15:26", "phone:5005:5018", "", "", ""]
    assert pii.digests(d.limit(0)).count() == 0


def test_pii_patterns_equal_brute_force(spark):
    """Patterns, instances and their scores in dictionaries, from the added spans' definition."""
    rnd = random.Random(31)
    leads = ["mail to", "write", "account", "call", "server at", "ref", "see page"]
    rows = []
    for k in range(250):
        said = []
        for _ in range(rnd.randint(1, 6)):
            lead = rnd.choice(leads)
            kind = {"mail to": "email", "write": rnd.choice(("email", "id")), "account": rnd.choice(("email", "id")), "call": rnd.choice(("phone", "id")), "server at": rnd.choice(("ip", "id")), "ref": "id", "see page": "id"}[lead] if rnd.random() < 0.9 else "id"
            n = rnd.randint(0, 60)
            tail = {"email": "soon", "ip": "up", "phone": "now"}.get(kind, "etc") if rnd.random() < 0.7 else "etc"
            said.append(f"{lead} {dict(email=f'u{n}@m.org', phone=f'+49 170 55{n:05}', ip=f'10.0.{n}.7', id=f'N{n:05}K')[kind]} {tail}")
        rows.append((k, " so ".join(said)))
    got = {r.doc_id: (r.base, r.added) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = []  # doc, start, end, hit, kind, pattern
    for k, t in rows:
        base = [(s[0], s[1], s[2], t[s[0] : s[2]]) for s in got[k][0]]
        for m in re.finditer(r"[^ ]+", t):
            if re.fullmatch(r"N\d{5}K", m[0]):
                base.append((m.start(), None, m.end(), m[0]))
        for start, kind, end, hit in base:
            before, after = t[max(0, start - 64) : start].lower().split(), t[end : end + 64].lower().split()
            shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", hit)))
            own = [f"l {' '.join(before[-n:])}" for n in (1, 2) if len(before) >= n] + [f"s {' '.join(before[-n:])} _ {shape}" for n in (1, 2) if len(before) >= n]
            own += [f"b {before[-1]} _ {after[0]}"] * bool(before and after) + [f"r {after[0]}"] * bool(after)
            seen += [(k, start, end, hit, kind, p) for p in own]
    edges = {(p, h): kind for _, _, _, h, kind, p in seen}
    counts = collections.Counter((p, kind) for (p, h), kind in edges.items() if kind is not None)
    support = {x for x, n in counts.items() if n >= 5}
    usable = {p for p, _ in support}
    edges = {(p, h): kind for (p, h), kind in edges.items() if p in usable}
    instances = collections.Counter(p for p, _ in edges)
    scores = {(h, kind): 1.0 for (_, h), kind in edges.items() if kind is not None}
    seeds = dict(scores)
    for _ in range(3):
        trust = {(p, kind): sum(s for (h, kk), s in scores.items() if kk == kind and (p, h) in edges) / instances[p] for p, kind in support}
        best = collections.defaultdict(float)
        for (p, h), kind in edges.items():
            if kind is None:
                for (pp, kk), x in trust.items():
                    if pp == p:
                        best[h, kk, p[0] == "r"] = max(best[h, kk, p[0] == "r"], x)
        lost = collections.defaultdict(lambda: 1.0)
        for (h, kk, _), x in best.items():
            lost[h, kk] *= max(1e-9, 1 - x)
        found = {x: 1 - v for x, v in lost.items()}
        scores = seeds | found
    want = collections.defaultdict(set)
    for k, start, end, hit, kind, p in seen:
        for kk in range(4):
            if kind is None and trust.get((p, kk), 0) >= 0.8 and found.get((hit, kk), 0) >= 0.8:
                want[k].add((start, kk, end))
    assert sum(map(len, want.values())) > 10
    assert {k: sorted(tuple(s) for s in added) for k, (_, added) in got.items()} == {k: sorted(want[k]) for k, _ in rows}


def _planted_identifiers():
    """Texts with seeds and with identifiers that base rules don't see, in contexts before and behind; the spans that should be added; other numbers in contexts of their own."""
    rnd = random.Random(77)
    filler = [f"wort{k}" for k in range(500)]
    prose = lambda n: " ".join(rnd.choices(filler, k=n))
    seeds = {"email": lambda n: f"user{n}@mail{n % 9}.org", "phone": lambda n: f"+49 170 55{n:05}", "ip": lambda n: f"10.{n % 200}.3.{n % 250}"}
    hidden = {"email": lambda n: f"user{n}@intranet", "phone": lambda n: f"0170-55{n:05}", "ip": lambda n: f"fe80::{n:04}:a{n % 10}"}
    before = {"email": ["write to", "her mail:", "(contact"], "phone": ["call me", "Tel.", "mobile ="], "ip": ["host", "from address", "ping"]}
    behind = {"email": ["is my mailbox"], "phone": ["rings at home"], "ip": ["answered slowly"]}
    rows, wanted = [], set()
    for k in range(600):
        text = prose(rnd.randint(3, 20))
        for _ in range(rnd.randint(0, 3)):
            kind = rnd.choice(list(seeds))
            shown = rnd.random() < 0.85
            said = (seeds if shown else hidden)[kind](rnd.randint(0, 9999))
            if rnd.random() < 0.75:
                text += f" {rnd.choice(before[kind])} "
                at = len(text)
                text += f"{said} {prose(rnd.randint(3, 8))}"
            else:
                text += " "
                at = len(text)
                text += f"{said} {rnd.choice(behind[kind])} {prose(4)}"
            if not shown:
                wanted.add((k, f"{kind}:{at}:{at + len(said)}"))
        for _ in range(rnd.randint(0, 2)):
            text += f" {rnd.choice(['order no', 'page', 'in the year', 'total of'])} {rnd.choice(['', 'X-', '9-'])}{rnd.randint(10000, 9999999)} {prose(3)}"
        rows.append((k, text))
    return rows, wanted


def test_pii_finds_planted_identifiers_and_little_else(spark):
    rows, wanted = _planted_identifiers()
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("added")).alias("spans")).collect()
    got = {(r.doc_id, x) for r in found for x in r.spans.split(",") if x}
    precision, recall = len(got & wanted) / len(got), len(got & wanted) / len(wanted)
    assert len(wanted) > 100 and precision >= 0.95 and recall >= 0.9


def test_pii_adds_nothing_that_a_base_rule_dropped(spark):
    rnd = random.Random(5)
    luhn = lambda s: sum((int(c) * (1 + k % 2)) // 10 + (int(c) * (1 + k % 2)) % 10 for k, c in enumerate(s[::-1])) % 10 == 0
    cards = [s for s in (f"{rnd.randint(10**15, 10**16 - 1)}" for _ in range(2000)) if luhn(s)][:60]
    rows = [(k, f"pay with card {c} today") for k, c in enumerate(cards)] + [(100 + k, f"at host 10.1.2.{k} now") for k in range(40)]
    rows += [(500, f"pay with card {cards[0][:-1]}{(int(cards[0][-1]) + 1) % 10} today"), (501, "at host 10.1.2.999 now"), (502, "pay with card 4041-KLMN today")]
    found = {r.doc_id: [tuple(x) for x in r.added] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[500] == [] and found[501] == [] and found[502] == [(14, 2, 23)]


def test_pii_context_words(spark):
    """Words of punctuation only don't count, on either side; contexts end where CONTEXT_CHARS end."""
    texts = ['token = "12345-678" , then', "a\nb -- 12345678 !! ( next one", "12345678", "x " * 60 + "12345678 " + "y" * 80, "11111111 22222222 33333333"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = pii._occurrences(pii.base_spans(rows, "text")).selectExpr("doc_id", "explode(__seen) as s").select("doc_id", "s.*").collect()
    got = {(r.doc_id, r.hit): (r.words, r.after, r["shape"]) for r in seen}
    assert got[0, "12345-678"] == (["token"], ["then"], "99999-999") and got[1, "12345678"] == (["a", "b"], ["next", "one"], "99999999")
    assert got[2, "12345678"][:2] == ([], []) and got[3, "12345678"][:2] == (["x", "x"], ["y" * 63])
    assert (4, "11111111 22222222 33333333") in got


def test_quality_classifier_and_rules(spark):
    rnd = random.Random(4)
    good = [" ".join(rnd.choices([f"plain{k}" for k in range(150)], k=120)) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in t.split(" ")) for t in good[:60]]
    insulted = [t + " blockhead" * 1 + " " + t for t in good[:80]]
    rows = [(k, t) for k, t in enumerate(good + bad + insulted)] + [(1000, None), (1001, ""), (0, good[0]), (None, good[1])]
    labels = [(k, int(not 300 <= k < 360), int(k >= 360)) for k in range(0, 440)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.keep_good(d, y)
    assert kept.columns == d.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert not any(300 <= (i or 0) < 360 for i in ids)
    assert sum(i is not None and i < 300 for i in ids) > 290 and sum(i is not None and 360 <= i < 440 for i in ids) < 8
    assert quality.keep_good(d, y.limit(0)).count() == len(rows) and quality.keep_good(d.limit(0), y).count() == 0
    judged = {r.doc_id: r for r in rules.judge(d, y).collect()}
    assert sum(judged[k].kept for k in range(300)) > 290 and not any(judged[k].kept for k in range(300, 360)) and judged[1000].base_failed


def _shape(word, before, one, two):
    last = next((n for n, chars in enumerate((".,", "!?", "#$%&*", "|", "0123456789", ")]}\"'>", ";:-_/\\"), 1) if word[-1] in chars), 0)
    capitals = len(word) > 1 and word[0].isupper() and word[1].isupper()
    return (last, capitals, word.lower().rstrip(".,") == one, word.lower().rstrip(".,") == two, min(len(word) // 6, 3))


def test_importance_weights_equal_brute_force(spark):
    """Counts of both models in dictionaries, and sums of log ratios word by word."""
    rnd = random.Random(12)
    plain = [f"plain{k}" for k in range(60)]
    texts = [" ".join(rnd.choices(plain, k=rnd.randint(1, 200))) for _ in range(150)]
    texts += [" ".join(w + "!!" if rnd.random() < 0.5 else "blockhead" for w in t.split(" ")) for t in texts[:40]] + ["", "Plain1. PLAIN2, plain2"]
    labels = [(k, int(k < 150), 0) for k in range(0, 190, 2)]
    d = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.resample(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), length=50).collect()}
    grams = {}
    for k, t in enumerate(texts):
        seen, own, shapes = [], [], []
        for w in words(t):
            shapes.append(_shape(w, None, seen[-1] if seen else None, seen[-2] if len(seen) > 1 else None))
            seen.append(w.lower().rstrip(".,"))
        grams[k] = [seen, list(zip([None, *shapes[:-1]], shapes))]
    held = {r.doc_id for r in d.filter(F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0).collect()}
    good = {k for k, q, _ in labels if q and k not in held}
    total = [0.0] * len(texts)
    for part in (0, 1):
        raw = collections.Counter(g for own in grams.values() for g in own[part])
        target = collections.Counter(g for k in good for g in grams[k][part])
        share = sum(target.values()) / sum(raw.values())
        often = sorted((g for g in raw if raw[g] * share >= 20), key=lambda g: target[g] / raw[g])
        weight, half = 0, sum(raw[g] for g in often) / 2
        for g in often:
            weight += raw[g]
            if weight >= half:
                typical = target[g] / raw[g]
                break
        for k, own in grams.items():
            for g in own[part]:
                e = raw[g] * typical
                ratio = np.log((target[g] + 0.3) / (e + 0.3))
                total[k] += np.sign(ratio) * max(0, abs(ratio) - 4.5 / np.sqrt(e + 1)) * 50 / max(50, len(own[part]))
    assert len(got) == len(texts) + 1 and got[None]["__weight"] == 0
    for k in range(len(texts)):
        assert got[k]["__weight"] == pytest.approx(total[k], abs=1e-3), k
    noise = {r.doc_id: -np.log(-np.log(((r.h % 2**64 >> 11) + 0.5) / 2**53)) for r in d.select("doc_id", F.xxhash64(F.lit("gumbel"), "doc_id").alias("h")).collect()}
    key = {k: r["__weight"] + noise[k] for k, r in got.items()}
    judged = sorted((key[k], q) for k, q, _ in labels if k in held)
    cuts = [judged[0][0] - 1, *((a[0] + b[0]) / 2 for a, b in zip(judged, judged[1:])), judged[-1][0] + 1]
    cut = min(cuts, key=lambda c: sum((x >= c) != q for x, q in judged))
    assert {k for k, r in got.items() if r["__kept"]} == {k for k in got if key[k] >= cut}
    assert max(r["__weight"] for k, r in got.items() if k is not None and 150 <= k < 190) < min(r["__weight"] for k, r in got.items() if k is None or k < 150)
    ten = quality.resample(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=10, temperature=1e9).filter("__kept").collect()
    assert len(ten) == 10  # weights hardly count at this temperature


def test_learned_rules_equal_their_thresholds(spark):
    rnd = np.random.default_rng(5)
    table = {f: rnd.random(600).round(2) for f in rules.FEATURES}
    bad = (table["symbols"] > 0.8) | (table["upper"] > 0.7) & (table["repeats"] < 0.4) | (table["mean_word"] > 0.95)
    learned = rules.learn(table, bad)
    assert len(learned) >= 3 and rules.learn(table, bad & False) == [] and rules.learn({f: v[:0] for f, v in table.items()}, bad[:0]) == []
    ratio = {"symbols": "n_symbols", "repeats": "n_repeat_words", "same": "n_same", "dup_lines": "n_dup_lines"}
    stats = [(k, 100, 50, *(int(100 * table[f][k]) for f in ratio), int(50 * table["upper"][k])) for k in range(600)]
    d = spark.createDataFrame(stats, "id long, n_words long, word_chars long, " + ", ".join(f"{c} long" for c in ratio.values()) + ", n_upper long")
    got = {r.id: r.rule for r in d.select("id", rules.expression(learned).alias("rule")).collect()}
    for row in stats:
        own = dict(zip(d.columns, row))
        value = {"mean_word": 0.5, "upper": own["n_upper"] / 50} | {f: own[c] / 100 for f, c in ratio.items()}
        holds = lambda t: value[t.feature] >= t.value if t.above else value[t.feature] <= t.value  # noqa: E731, B023
        assert got[row[0]] == next((n for n, rule in enumerate(learned, 1) if all(map(holds, rule))), 0)


def test_rules_on_an_empty_table_and_one_without_labels(spark):
    d = spark.createDataFrame([(1, None), (None, "a b"), (2, "word " * 60)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("quality", "n_words", "rule")})
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.base_failed, r.kept) for r in rules.judge(d, y).collect()} == {(1, True, False), (None, True, False), (2, True, False)}
    assert rules.judge(d.limit(0), y).count() == 0


def test_best_cut_has_the_fewest_errors():
    rnd = np.random.default_rng(6)
    for n in range(1, 40):
        keys, good = rnd.integers(-9, 9, n) * 10, rnd.random(n) < 0.6
        cut = quality.best_cut(keys, good)
        if good.all() or not good.any():
            assert cut is None
        else:
            errors = lambda c: int(((keys >= c) != good).sum())
            assert errors(cut) == min(map(errors, range(-200, 200)))
    assert quality.best_cut(np.array([-900, 10]), np.array([False, True])) == -445


def test_kth_largest(spark):
    values = [5, 5, -3, 2**62, -(2**63), 0, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [quality.kth_largest(df, "v", k) for k in range(1, 9)] == [*sorted(values, reverse=True), None]


def test_rule_statistics(spark, corpus):
    texts = [*corpus, (500, "a b c a b c\na b c a b c\n\n#x# <y>"), (501, "x y\nx y\nx y\n")]
    got = {}
    for r in rules.statistics(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:6])
    for i, t in texts:
        if i is None:
            continue
        w = words(t)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines, seen = 0, set()
        for x in (t or "").split("\n"):
            if words(x):
                lines += x in seen
                seen.add(x)
        assert (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), lines, len(covered)) in got[i]


def test_decontamination_finds_copies_and_paraphrases(spark):
    rnd = random.Random(6)
    vocabulary = [f"word{k}" for k in range(3000)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=30)) + ". " + " ".join(rnd.choices(vocabulary, k=6)) + ".") for k in range(20)] + [(99, None), (98, "")]
    clean = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(5, 300)))) for k in range(200)]
    filler = lambda: " ".join(rnd.choices(vocabulary, k=60))
    exact = [(1000 + k, f"{filler()} {items[k][1]} {filler()}") for k in range(10)]
    changed = [(2000 + k, f"{filler()} {' '.join(w for n, w in enumerate(items[k][1].split()) if n % 9 != 4)} {filler()}") for k in range(10)]
    d = spark.createDataFrame([*clean, *exact, *changed, (1, None), (2, "")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    assert got == {(i, i % 1000) for i, _ in [*exact, *changed]}
    assert decontaminate.drop_leaks(d, b).count() == 202 and decontaminate.leaks(d, b.limit(0)).count() == 0


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_leaks_equal_all_pairs(spark):
    """Cosines, candidates, coverage and answers of all windows of all documents with all items, in plain loops over the same latent space."""
    rnd = random.Random(12)
    vocabulary = [f"w{k}" for k in range(160)]
    prose = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(k, prose(rnd.choice((4, 9, 15, 16, 17, 30, 45))) + ". " + prose(rnd.randint(1, 6)) + ".") for k in range(14)] + [(50, ""), (51, None)]
    docs = [(k, prose(rnd.randint(0, 70))) for k in range(50)]
    for k, (n, t) in enumerate(items[:14] * 3):
        said = t.split()
        kept = [w for w in said if rnd.random() > (0.0, 0.15, 0.35)[k // 14]]
        docs.append((100 + k, f"{prose(rnd.randint(0, 30))} {' '.join(kept)} {prose(rnd.randint(0, 30))}"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.cosine, r.coverage, r.has_answer) for r in decontaminate.leaks(d, b).collect()}

    found, passages = decontaminate.passage_frequencies(d.select("text"), 16)
    idf = np.append(np.log(max(passages, 1) / np.maximum(found, 1)) + 1e-3, 0).astype(np.float32)
    vectors = decontaminate.latent_space(d.select("text").union(b.select("text")), idf, 16, 64).astype(float)
    import pyarrow as pa

    def cut(text):
        own = words((text or "").lower())
        terms = [int(t) for _, _, w, _ in decontaminate._words(pa.array([text or ""])) for t in decontaminate._term(w)]
        return own, terms

    def starts(n, size, step):
        return [k * step for k in range(1 - (-max(n - size, 0) // step))] if n else []

    unit = lambda terms: (lambda v: v / (np.linalg.norm(v) + 1e-9))(vectors[terms].sum(0))
    sure, maybe = {}, set()
    for n, text in items:
        own, terms = cut(text)
        answer = words(re.split(r"(?<=[.!?])\s+", (text or "").strip())[-1].lower())
        passes = [(16, starts(len(own), 16, 8), 8)] + ([(len(own), [0], 1)] if 0 < len(own) < 16 else [])
        for i, t in docs:
            mine, mine_terms = cut(t)
            for size, at, step in passes:
                targets = [unit(terms[k : k + size]) for k in at]
                places = starts(len(mine), size, step) if size == 16 else [k for k in range(len(mine)) if k + size <= len(mine) or k == 0]
                for p in places:
                    window = mine_terms[p : p + size]
                    cosine = max((float(unit(window) @ x) for x in targets), default=0)
                    whole, shared = idf[window].sum(), sum(idf[x] for x in window if x in set(terms))
                    if cosine < 0.498 or shared < 0.399 * whole:
                        continue
                    around = mine[max(0, p - len(own)) : p + size + len(own)]
                    v = (_subsequence(own, around) / len(own), 2 * _subsequence(answer, around) >= len(answer))
                    if cosine < 0.502 or shared < 0.401 * whole:  # too near a bound to tell
                        maybe.add((i, n))
                    else:
                        sure[i, n] = max(v, sure.get((i, n), (0.0, False)))
    leak = {x: v for x, v in sure.items() if v[0] >= 0.8 or v[0] >= 0.6 and v[1]}
    assert {x for x in leak if x not in maybe} == {x for x in got if x not in maybe} and len(leak) > 30
    assert all(got[x][1] == pytest.approx(v[0]) and got[x][2] == v[1] for x, v in leak.items() if x not in maybe)
    assert any(v[0] < 0.8 for v in leak.values()) and len(sure) > len(leak)


def test_decontamination_recall_of_paraphrases(spark):
    """Benchmark items of the given tables, changed in six ways between words of other documents."""
    sf, rnd = "/root/testdata/sf0.01", random.Random(3)
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in bench.collect() if r.text and len(r.text.split()) >= 10][:100]
    pool = [w for r in docs.limit(300).collect() for w in words(r.text)]
    every = lambda n: lambda t: [rnd.choice(pool) if k % n == 2 else w for k, w in enumerate(t)]
    kinds = {
        "exact": (lambda t: t, 1.0),
        "every fifth word replaced": (every(5), 0.9),
        "every third word replaced": (every(3), 0.8),
        "a fifth of the words left out": (lambda t: [w for w in t if rnd.random() > 0.2], 0.9),
        "a quarter more words": (lambda t: [x for w in t for x in ([w, rnd.choice(pool)] if rnd.random() < 0.25 else [w])], 0.9),
        "neighbours exchanged": (lambda t: [t[k ^ 1] if k % 4 < 2 and k ^ 1 < len(t) else w for k, w in enumerate(t)], 0.9),
    }
    fill = lambda: rnd.choices(pool, k=rnd.randint(20, 150))
    rows = [(10**6 * n + k, " ".join([*fill(), *change(t), *fill()])) for n, (change, _) in enumerate(kinds.values(), 1) for k, (_, t) in enumerate(items)]
    rows += [(10**9 + k, " ".join(fill())) for k in range(300)]
    got = {}
    for r in decontaminate.leaks(docs.union(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    assert not any(i >= 10**9 for i in got)
    for n, (name, (_, least)) in enumerate(kinds.items(), 1):
        assert sum(i in got.get(10**6 * n + k, ()) for k, (i, _) in enumerate(items)) >= least * len(items), name


def test_decontamination_searches_a_benchmark_of_many_blocks_whole(spark, monkeypatch):
    rnd = random.Random(16)
    vocabulary = [f"word{k}" for k in range(3000)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=40))) for k in range(20_001)]
    taken = [0, 9_999, 19_999, 20_000]
    d = spark.createDataFrame([(k, f"before {items[k][1]} after") for k in taken], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()) == [(k, k) for k in taken]
    small = b.filter(F.col("item_id").isin(taken + [5, 6]))
    once = sorted(map(tuple, decontaminate.leaks(d, small).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    assert sorted((r[0], r[1], r[3], r[4]) for r in decontaminate.leaks(d, small).collect()) == [(r[0], r[1], r[3], r[4]) for r in once]
    assert decontaminate.drop_leaks(d, small).count() == 0


def test_decontamination_finds_exact_copies_of_short_items(spark):
    rnd = random.Random(17)
    vocabulary = [f"word{k}" for k in range(3000)]
    items = [(n, " ".join(f"item{n}x{k}" for k in range(n))) for n in range(1, 16)]
    filler = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    copies = [(100 * place + n, f"{filler(60 + place)} {t} {filler(60)}".strip()) for n, t in items for place in range(1, 9)]
    copies += [(n, t) for n, t in items] + [(1000 + n, f"{t} {filler(40)}") for n, t in items] + [(1100 + n, f"{filler(40)} {t}") for n, t in items]
    clean = [(5000 + k, filler(rnd.randint(1, 100))) for k in range(100)]
    d = spark.createDataFrame([*copies, *clean], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted((i, i % 100) for i, _ in copies)


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_decontamination_fits_items_that_the_sample_lacks(spark, ids):
    rnd = random.Random(18)
    vocabulary = [f"word{k}" for k in range(300)]
    filler = lambda: " ".join(rnd.choices(vocabulary, k=60))
    items = [(n, " ".join(f"item{n}x{k}" for k in range(40))) for n in range(6)]
    texts = [f"{filler()} {t} {filler()}" for _, t in items] + [filler() for _ in range(600)]
    d = spark.createDataFrame([({"null": None, "one": 7, "own": k}[ids], t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string"), fit_docs=30).collect()
    assert sorted(r.item_id for r in got) == list(range(6))


def test_latent_space_is_of_all_rows(spark, monkeypatch):
    """Its directions are those of a dense product over all rows, with repeated ones, those without an id and nulls; leaks takes such a fit of more than 20,000 rows."""
    rnd = random.Random(19)
    vocabulary = [f"word{k}" for k in range(120)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 40))) for _ in range(90)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts + texts[:30]], "text string").repartition(5)
    found, passages = decontaminate.passage_frequencies(rows, 16)
    idf = np.append(np.log(passages / np.maximum(found, 1)) + 1e-3, 0).astype(np.float32)
    import pyarrow as pa

    a = []
    for t in texts + texts[:30]:
        terms = [int(x) for _, _, w, _ in decontaminate._words(pa.array([t or ""])) for x in decontaminate._term(w)]
        for k in range(0, len(terms), 16):
            a.append(np.bincount(terms[k : k + 16], minlength=decontaminate.TERMS) * idf[:-1])
            a[-1] /= np.sqrt((idf[terms[k : k + 16]] ** 2).sum())
    a = np.array(a)
    assert len(a) == passages
    product = a.T @ (a @ np.random.default_rng(7).standard_normal((decontaminate.TERMS + 1, 72), np.float32)[:-1])
    left, values, _ = np.linalg.svd(product, full_matrices=False)
    want = left[:, :64] / np.sqrt(values[:64]) * idf[:-1, None]
    got = decontaminate.latent_space(rows, idf, 16, 64)
    seen = np.flatnonzero(found)
    assert not got[-1].any() and np.allclose(got[seen] @ got[seen].T, want[seen] @ want[seen].T, rtol=1e-2, atol=1e-3 * np.abs(want[seen] @ want[seen].T).max())

    fits = []
    whole = decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda t, *how: fits.append(t.count()) or whole(t, *how))
    many = spark.range(25_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 12_000).alias("doc_id"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("word"), F.col("id") % 120)).alias("text"))
    item = " ".join(f"item{k}" for k in range(20))
    got = decontaminate.leaks(many.union(spark.createDataFrame([(30_000, item)], "doc_id long, text string")), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.coverage) for r in got.collect()] == [(30_000, 1, 1.0)] and fits == [25_002]


def test_cosine_is_of_the_best_window(spark):
    """Two whole copies: the first settles the coverage, the second alone starts where a window does."""
    item = " ".join(f"item{k}" for k in range(32))
    noise = [f"noise{k}" for k in range(48)]
    d = spark.createDataFrame([(7, " ".join([*noise[:4], item, *noise[4:], item]))], "doc_id long, text string")
    (got,) = decontaminate.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert (got.doc_id, got.item_id, got.coverage, got.has_answer) == (7, 1, 1.0, True) and got.cosine == pytest.approx(1, abs=1e-5)


def test_blocks_of_items_hold_all_within_bounds(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    rows = [(k, " ".join("x" * n) if n else None, None) for k, n in enumerate([1, 1, 1, 1, 5, 5, 20, 0, 10, 2])]
    blocks = list(decontaminate.item_blocks(iter(rows)))
    assert [[r[0] for r in b] for b in blocks] == [[0, 1, 2], [3, 4], [5], [6], [7, 8], [9]] and list(decontaminate.item_blocks([])) == [[]]


def test_common_subsequence_of_long_items(monkeypatch):
    rnd = random.Random(9)
    cases = [[rnd.choices("abcdefgh", k=rnd.randint(1, 90)) for _ in range(2)] for _ in range(50)]
    masked = [decontaminate.common_subsequence(decontaminate.bits_of(a), len(a), b) for a, b in cases]
    monkeypatch.setattr(decontaminate, "MASKED_WORDS", 0)
    assert masked == [decontaminate.common_subsequence(decontaminate.bits_of(a), len(a), b) for a, b in cases]


def test_common_subsequence():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = (rnd.choices("abcd", k=rnd.randint(0, 12)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate.bits_of(a), len(a), b) == table[-1][-1]


def test_url_rules(spark):
    urls = ["http://a.example.org/es/x", "http://example.org/es", "HTTP://EXAMPLE.ORG/en/14?q", "https://b.org/z", "http://c.com/fr/", "http://c.com/de/x#y", "http://c.com?x=/de/", "no scheme", None, "http://cheap-pills.net/", "http://notcheap-pillsy.net/", "http://x.net/a://b", "http://com/fr/", "http://b.org/" + "x/" * 50_000]
    d = spark.createDataFrame([(k, u, "h", "mine") for k, u in enumerate(urls)] + [(3, urls[3], "h", "mine")], "page_id long, url string, host string, token string")
    rows = url_filter.judge(d).orderBy("page_id").collect()
    assert len(rows) == len(urls) + 1 and {r.token for r in rows} == {"mine"} and tuple(rows[3]) == tuple(rows.pop(4))
    assert [r.rule for r in rows] == ["example.org/es/", "org/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None, "com/fr/", "org/"]
    assert [r.verdict for r in rows[2:]] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert rows[6].host == "c.com" and rows[6].path == "" and rows[11].path == "/a://b"
    assert url_filter.judge(d.limit(0)).count() == 0 and {r.verdict for r in url_filter.judge(d, []).collect()} == {"allow"}


def test_url_index_equals_every_rule_on_every_url(spark):
    rnd = random.Random(21)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "x-y") for b in ("one", "two", "spam-farm", "three") for c in ("org", "com")] + ["org", "casino.net"]
    urls = [f"http://{rnd.choice(hosts)}/{'/'.join(rnd.choices(['en', 'de', 'a1', '7', ''], k=rnd.randint(0, 4)))}" for _ in range(300)]
    rules_ = [url_filter.site_rule(f"{rnd.choice(hosts[:8])[rnd.choice((0, 2)):].lstrip('.')}/{rnd.choice(['', 'en', 'de/', 'e', 'a1/7'])}", rnd.choice(("allow", "block"))) for _ in range(40)]
    rules_ += [url_filter.host_pattern(w) for w in ("spam-farm", "casino", "y", "absent")] + [url_filter.Rule("any seven", "block", "7$", ())]
    for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules_).collect():
        text = r.host + r.path
        fits = [(x.site, len(x.name), -k, x) for k, x in enumerate(rules_) if re.search(x.regex, text)]
        best = max(fits, key=lambda f: f[:3])[3] if fits else None
        assert (r.rule or r.pattern, r.verdict) == ((best.name, best.verdict) if best else (None, "allow")), text
