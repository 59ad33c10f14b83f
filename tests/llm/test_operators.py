"""The training-data operators against brute force, and on null, empty, repeated and odd rows."""

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark.storage import Workspace
from strataspark.llm import ann, decontam, html_text, license_scan, mixing, near_dedup, pii, quality, sharding, substring_dedup, textkit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (4, "one", "en", "a", 3), (5, "one", "en", "a", 3), (5, "one", "en", "a", 3), (None, "one", "en", "a", 3), (None, None, None, None, None),
    (6, "Éa ß 漢字 \U0001f600 x\x00y", "fr", "b", 12), (7, "the mit license and GENERAL public-license", "en", "b", 40),
]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return [f"w{int(k)}" for k in rng.zipf(1.3, n) % vocabulary]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def copies(spark):
    """Originals, exact and near copies, and passages shared by several documents."""
    rng = np.random.default_rng(4)
    rows, passage = [], prose(rng, 40)
    for i in range(60):
        base = prose(rng, int(rng.integers(5, 200)))
        if i % 5 == 0:
            base = base[:20] + passage + base[20:]
        rows.append(base)
        for k in range(int(rng.integers(0, 4))):
            own = list(base)
            for _ in range(k * 2):
                own[int(rng.integers(len(own)))] = f"e{int(rng.integers(50))}"
            rows.append(own)
    order = rng.permutation(len(rows))
    return [(int(i), " ".join(rows[i]), "en", f"s{i % 3}", 0) for i in order] + [(5000 + r[0], *r[1:]) for r in ODD[:5]]


def test_words_and_hashes_do_not_depend_on_cuts(monkeypatch):
    texts = ["a bb  ccc", "", "ddd", "x" * 700 + " y", "é\n\tß"]
    data, offsets = textkit.utf8(pa.array(texts))
    hasher = textkit.ByteHash(1, False)
    whole = textkit.Words(data, offsets, textkit.SPACES, hasher)
    assert [data[s:e].tobytes().decode() for s, e in zip(whole.starts, whole.ends, strict=True)] == [w for t in texts for w in words(t)]
    monkeypatch.setattr(textkit, "SEGMENT_BYTES", 8)
    cut = textkit.Words(data, offsets, textkit.SPACES, hasher)
    assert np.array_equal(whole.hashes, cut.hashes) and np.array_equal(whole.ptr, cut.ptr)
    sliced, off = textkit.utf8(pa.array(["zz", None, "q"]).slice(1))
    assert off.tolist() == [0, 0, 1] and sliced.tobytes() == b"q"


def shingles(text, k):
    own = words(lower(text))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} or ({tuple(own)} if own else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, copies, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.NearDuplicates(k, 80).run(spark.createDataFrame(copies, DOCS)).collect()}
    sets = {d[0]: shingles(d[1], k) for d in copies}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_large_group_of_near_copies(spark, monkeypatch):
    """Buckets beyond SMALL_BUCKET take the rare-shingle join; every link that joins components is found."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(int(rng.integers(2, 12))):
            own[int(rng.integers(100))] = f"b{int(rng.integers(100))}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    got = {r.doc_id: r.component_id for r in near_dedup.NearDuplicates(2, 80).run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t, 2) for i, t in rows}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp


@pytest.mark.parametrize("edits", [9, 10])
def test_strays_of_a_group_list_few_pairs(spark, monkeypatch, edits):
    """60 near copies and 60 texts too far from all of them: no sketches are fetched for the pairs between."""
    rng, rows = np.random.default_rng(4), []
    for i in range(120):
        own = [f"b{k}" for k in range(100)]
        for k in rng.choice(50, edits if i % 2 else 1, replace=False):
            own[2 * int(k)] = f"e{i}x{k}"
        rows.append((i, " ".join(own)))
    seen, candidates = [], near_dedup.NearDuplicates._candidates
    monkeypatch.setattr(near_dedup.NearDuplicates, "_candidates", lambda self, pairs, reps: [seen.append(pairs.count()), candidates(self, pairs, reps)][1])
    got = {r.doc_id: r.component_id for r in near_dedup.NearDuplicates(2, 80).run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i % 2 else 0 for i in range(120)}
    assert seen[1] <= 60  # 671 with 9 edits before parities were compared


def test_members_of_a_group_are_not_compared_with_each_other(spark, monkeypatch):
    """150 near copies, 4 strays of theirs and a text linked to one member only: what meets on a shingle is a stray and a document."""
    rng, rows = np.random.default_rng(12), []
    for i in range(154):
        own = [f"b{k}" for k in range(100)]
        for k in rng.choice(50, 9 if i >= 150 else 3, replace=False):
            own[2 * int(k)] = f"e{i}x{k}"
        rows.append((i, own))
    late = [f"l{k}" if k in (4, 17, 30, 43) else w for k, w in enumerate(rows[7][1])]
    rows.append((154, late))
    rows = [(i, " ".join(own)) for i, own in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    met, join = [], type(frame).join

    def spy(self, other, on=None, how=None):
        if isinstance(on, str) and on == "g":
            met.append(join(self.select("g"), other.select("g"), "g").count())
        return join(self, other, on, how)

    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(type(frame), "join", spy)
    got = {r.doc_id: r.component_id for r in near_dedup.NearDuplicates(2, 80).run(frame).collect()}
    sets = {i: shingles(t, 2) for i, t in rows}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp
    assert met and sum(met) <= 5 * len(rows) * 20  # 139,021 before; 1,327 since


@pytest.mark.parametrize("size", [5, 9, 45, 180, 900, 9000])
def test_parities_keep_links(spark, size):
    """Pairs at exactly 80 per cent pass; those at 60 per cent don't, up to 180 shingles."""
    rng = np.random.default_rng(size)
    for passes in (True, False):
        # equal sets of n with a common part of 8 / 9 (80 per cent) or 3 / 4 (60 per cent)
        n = 9 * max(size // 9, 1) if passes else 4 * max(size // 4, 1)
        common = n * 8 // 9 if passes else n * 3 // 4
        pool = rng.integers(0, 2**63, (200, 2 * n - common)).astype(np.uint64)
        sets = [pool[:, :n], np.hstack([pool[:, :common], pool[:, n:]])]
        a, b = (near_dedup.parities(np.concatenate(x), np.arange(201) * n).view(np.int64) for x in sets)
        names = [f"p{i}{e}" for e in ("", "1") for i in range(near_dedup.PARITIES)]
        frame = spark.createDataFrame([(n, n, *map(int, x), *map(int, y)) for x, y in zip(a, b, strict=True)], ", ".join(f"{c} long" for c in ("size", "size1", *names)))
        kept = frame.where(near_dedup._may_link(80, "1")).count()
        assert kept == 200 if passes else kept < 10 or size > 180


def test_near_duplicates_of_odd_rows(spark, odd):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_dedup.NearDuplicates(2, 80).run(odd).collect()))
    assert got == [(0, 0, 0), (0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 4, 6), (7, 5, 7)]
    assert near_dedup.NearDuplicates().run(odd.limit(0)).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = pool[:3000], pool[500:3500]
    regs = near_dedup.registers(np.concatenate([np.unique(a), np.unique(b), np.unique(np.r_[a, b])]), np.array([0, 3000, 6000, 9500]))
    assert np.array_equal(np.maximum(regs[0], regs[1]), regs[2])  # sketches merge
    j = near_dedup.estimate(regs[:1], regs[1:2], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(j - 2500 / 3500) < 0.15


@pytest.mark.parametrize("size", [9, 45, 180, 900])
def test_links_at_the_threshold_meet(size):
    """Of 3,000 pairs whose similarity is exactly 80 per cent, all share a band and none is estimated away."""
    rng = np.random.default_rng(size)
    common, own = 8 * size // 9, size // 9  # intersection / union = 8 / 10
    pool = rng.integers(0, 2**63, (3000, common + 2 * own)).astype(np.uint64)
    regs = [near_dedup.registers(np.concatenate(x), np.arange(3001) * (common + own)) for x in (pool[:, : common + own], np.hstack([pool[:, :common], pool[:, common + own :]]))]
    bands = near_dedup._bands(near_dedup.ROWS, near_dedup.BANDS, near_dedup.REGISTERS)
    same = (regs[0] == regs[1])[:, bands].all(2).any(1)
    n = np.full(3000, float(common + own))
    close = near_dedup.estimate(*regs, n, n) >= 0.8 - near_dedup.MARGIN
    assert same.all() and close.all()


def brute_repeats(rows):
    seen, out = {}, {}
    own = {i: words(t) for i, t in rows}
    for i in sorted(own):
        gone = set()
        for s in range(len(own[i]) - 19):
            w = tuple(own[i][s : s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.setdefault(w, (i, s))
        out[i] = (len(own[i]), len(gone), " ".join(x for k, x in enumerate(own[i]) if k not in gone))
    return out


@pytest.mark.parametrize(("batches", "told"), [(1, 1 << 26), (4, 1 << 26), (3, -1)])
def test_repeats(spark, copies, batches, told, monkeypatch):
    """In one batch and in several with compaction; fingerprints told by bitmap or by a join."""
    monkeypatch.setattr(substring_dedup, "MOST_AGAIN", told)
    frame = spark.createDataFrame([*copies, (900, " ".join(["ab"] * 70), "en", "s", 0)], DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(frame, batches, max_runs=2).collect()}
    assert got == brute_repeats([(r.doc_id, r.text) for r in frame.collect()])


def test_runs_are_sorted_and_compacted(spark, copies):
    index = substring_dedup.FingerprintIndex(spark, max_runs=2, buckets=3)
    own = substring_dedup.keyed(spark.createDataFrame(copies, DOCS))
    for k in range(3):
        index.add(own.where(f"doc_id % 3 = {k}"))
    assert index.compactions == 1 and len(index.runs) == 2
    for path in spark.table(index.runs[0]).inputFiles():
        g = [r.g for r in spark.read.parquet(path).collect()]
        assert g == sorted(set(g))
    joined = index._joined(index.runs[1])
    assert joined.count() > 0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    index.close()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_repeats_of_odd_rows(odd):
    rows = substring_dedup.remove_repeats(odd, 2, digest=True).collect()
    assert len(rows) == len(ODD) and all(r.n_removed == 0 for r in rows)
    assert {r.kept_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert substring_dedup.remove_repeats(odd.limit(0), 2).count() == 0


def test_licenses_of_odd_rows(odd):
    got = {r.doc_id: r for r in license_scan.scan_licenses(odd).collect() if r.doc_id}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert (got[7].n_words, got[7].n_base, got[7].first_word, got[7].last_word, got[7].base_labels) == (7, 2, 1, 4, "gpl,mit")
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_license_templates(spark):
    notice = license_scan.TEMPLATES[0][1]
    rows = [(1, "x " * 90 + notice.upper() + " y" * 90), (2, " ".join(notice.split()[:10])), (3, "K" + notice), (4, " ".join(reversed(notice.split())))]
    got = {r.doc_id: (r.labels, r.n_base) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 0), 2: ("", 0), 3: ("mit", 0), 4: ("mit", 0)}


def test_surrogates(spark):
    text = "Mr. John Smith <John.Smith@mail.example.org> or JOHN.SMITH@MAIL.EXAMPLE.ORG, +1 (499) 555-6503, +1 499 555 6503, 4012 8888 8888 1881, 129.38.82.176"
    frame = spark.createDataFrame([(1, text), (2, "call +1 (499) 555-6503"), (3, None), (4, ""), (None, "a@b.io")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(frame, b"key").collect()}
    found = pii.detect(got[1].text)
    assert [x[2] for x in found] == [x[2] for x in pii.detect(text)] and got[1].n_entities == 7
    assert got[1].text.startswith("Mr. ") and len(got[1].text.split("@")[0]) > 0
    forms = [x[3] for x in found]
    assert forms[1] == forms[2] and forms[3] == forms[4] and forms[3] == pii.detect(got[2].text)[0][3]
    assert not set(forms) & {x[3] for x in pii.detect(text)}
    assert pii.luhn(next(x[3] for x in found if x[2] == "card"))
    assert got[3].text is None and got[4].text == "" and got[None].n_entities == 1
    assert pii.replace_entities(frame.limit(0), b"key").count() == 0


def replaced(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.replace_entities(frame, b"k").collect(), key=lambda r: r.doc_id)]


def test_names_are_coreferent(spark):
    one, two, three, four = replaced(
        spark,
        ["Mr John Smith called. John Smith left. Dr John Smith and Mr Smith; Smith.", "Dr. Anna Schmidt and Frau Anna Schmidt", "Mr O'Brien, Mr Robin McDonald, Herr Łukasz Nowak.", "Prof Robin McDonald"],
    )
    m = re.fullmatch(r"Mr (\S+ (\S+)) called\. (\S+ \S+) left\. Dr (\S+ \S+) and Mr (\S+); (\S+)\.", one)
    assert m and m[1] == m[3] == m[4] and m[2] == m[5] == m[6] and "Smith" not in one and "John" not in one
    m = re.fullmatch(r"Dr\. (\S+ \S+) and Frau (\S+ \S+)", two)
    assert m[1] == m[2] and m[1].split()[0] in pii._GIVEN["latin", "f"]
    assert not re.search("Brien|McDonald|Nowak|Robin", three)
    same = re.search("Mr (\\S+ \\S+),", three)[1]
    assert four == f"Prof {same}" and same.split()[0] in pii._GIVEN["latin", "m"]


def test_long_secrets(spark):
    texts = ["key = 1", 'token="' + "aB3" * 300 + '"', "hash " + "0a" * 200, "c" * 100 + " 12"]
    out = replaced(spark, texts)
    assert out[0] == texts[0] and out[3] == texts[3]
    assert len(out[1]) == len(texts[1]) and "aB3aB3aB3" not in out[1] and len(out[2]) == len(texts[2]) and "0a0a0a" not in out[2]


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Short addresses and many who share a surname force redraws, told by broadcast or by a join; brute force counts."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"user {a}@{b}.io, Mr {n.title()} Smith" for a in letters[:13] for b, n in zip(letters, ["Ab" + c for c in letters], strict=True)]
    find = lambda t: re.findall(r"\S+@[\w.]+", t) + re.findall(r"Mr (\S+ \S+)", t)
    assert any(pii.surrogate(b"k", "email", f"{a}@{b}.io") in " ".join(texts) for a in letters[:13] for b in letters)
    out = replaced(spark, texts)
    pairs = {(x, y) for t, u in zip(texts, out, strict=True) for x, y in zip(find(t), find(u), strict=True)}
    olds, news = {x for x, _ in pairs}, {y for _, y in pairs}
    assert len(olds) == len(news) == len(pairs) == 13 * 26 + 26 and not olds & news
    monkeypatch.setattr(pii, "BROADCAST_TOLD", -1)
    assert replaced(spark, texts) == out


def test_exhausted_spaces_end(spark, monkeypatch):
    """More private addresses, and short numbers, than their ranges have room for others."""
    rows = [("ip", f"192.168.{a}.{b}") for a in range(1, 133) for b in range(1, 251)] + [("phone", f"{n:05d}") for n in range(10000, 100000, 1)]
    frame = spark.createDataFrame([(*r, "n") for r in rows], "kind string, form string, gender string")
    monkeypatch.setattr(pii, "TRIES", 8)
    got = pii.surrogates(frame, b"k", Workspace(spark, "t")).collect()
    assert len({(r.kind, r.drawn) for r in got}) == len(got) == len(rows) and all(r.form != r.drawn for r in got)
    assert all(r.drawn.startswith(("192.168.", "10.")) for r in got if r.kind == "ip")


def test_shards(spark, odd):
    frame = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(3).alias("Slot"))
    rows = sharding.shard_rows(frame, 16, seed=1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(r.doc_id for r in rows) == list(range(1003)) and "_Slot" in rows[0].asDict()
    assert {len(v) for v in by.values()} == {62, 63} and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(frame.repartition(7), 16, seed=1).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert sharding.shard_rows(odd, 4).count() == len(ODD) and sharding.shard_rows(odd.limit(0), 4).count() == 0


def test_copies_of_a_row_spread_over_shards(spark):
    frame = spark.range(2000).select((F.col("id") % 40).alias("doc_id"), F.lit("t").alias("text"))
    rows = sorted(tuple(r) for r in sharding.shard_rows(frame, 16, seed=1).select("shard", "slot", "doc_id").collect())
    assert np.bincount([r[2] for r in rows]).tolist() == [50] * 40
    assert min(len({s for s, _, d in rows if d == doc}) for doc in range(40)) >= 10
    assert np.mean([a[2] == b[2] for a, b in zip(rows, rows[1:])]) < 0.1
    assert rows == sorted(tuple(r) for r in sharding.shard_rows(frame.repartition(7), 16, seed=1).select("shard", "slot", "doc_id").collect())


def test_rows_that_repeat_beyond_a_part(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 100)
    frame = spark.range(3000).select(F.when(F.col("id") < 2000, -1).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("h"))
    rows = sorted(tuple(r) for r in sharding.shard_rows(frame, 8, seed=2).select("shard", "slot", "doc_id").collect())
    assert sorted(r[2] for r in rows) == [-1] * 2000 + list(range(2000, 3000))
    assert [r[:2] for r in rows] == [(s, k) for s in range(8) for k in range(375)]
    assert all(abs(sum(d == -1 for s, _, d in rows if s == shard) - 250) < 50 for shard in range(8))
    assert rows == sorted(tuple(r) for r in sharding.shard_rows(frame.repartition(5), 8, seed=2).select("shard", "slot", "doc_id").collect())


def test_communication_matrix():
    m = np.array(sharding.communication_matrix([5, 0, 100, 7], [30, 41, 41], 3))
    assert m.sum(1).tolist() == [5, 0, 100, 7] and m.sum(0).tolist() == [30, 41, 41]
    rng = np.random.Generator(np.random.Philox(1))
    draws = np.array([sharding.draw(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(draws.mean() - 6) < 0.15 and abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert 0 <= sharding.draw(rng, 10**11, 10**11, 10**9) <= 10**9


def test_mixing(spark, odd):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") < 4000, "big").when(F.col("id") < 5990, "small").alias("source"))
    rows = mixing.mix_sources(frame, {"big": 1, "small": 3, "": 0}, seed=2, with_copy=True).collect()
    n = {s: sum(r.source == s for r in rows) for s in ("big", "small", None)}
    assert abs(n["big"] - 1500) < 150 and abs(n["small"] - 4500) < 250 and n[None] == 0
    counts = np.bincount(np.bincount([r.doc_id for r in rows if r.source == "small"], minlength=5990)[4000:5990])
    rate = 4500 / 1990
    assert abs(counts[0] / 1990 - np.exp(-rate)) < 0.03
    assert mixing.mix_sources(odd).columns == odd.columns and mixing.mix_sources(odd.limit(0)).count() == 0
    clash = odd.withColumns({"_n": F.lit(7), "_row": F.lit("r"), "rate": F.lit(1), "score": F.lit(2), "_key": F.lit(3)})
    assert {(r["_n"], r["_row"], r["rate"]) for r in mixing.mix_sources(clash).collect()} <= {(7, "r", 1)}
    large = mixing.mix_sources(spark.createDataFrame([(1, "x", "a"), (2, "y" * 4999, "b")], "doc_id long, text string, source string"), {"a": 1, "b": 0}).count()
    assert abs(large - 2501) < 300  # a rate beyond PART_RATE


def test_main_text():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>A &amp; B</h1><p>First   <b>para</b>\ngraph.<p>Second&nbsp;one.<div class=ad>Buy</div><form>Name</form><script>x<y</script><section id='comments'><p>Nice!</p></section></article>"
        "<aside>Side</aside><footer>&copy; x</footer>"
    )
    assert html_text.main_text(page) == "A & B\nFirst para graph.\nSecond one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("a < b & c") == "a < b & c"
    long = "word " * 40
    plain = f"<body><div>Menu</div><div><a href=x>{long}</a></div><div>{long}</div><div>{long}</div><div></div><div>short</div></body>"
    assert html_text.main_text(plain).count("word") >= 80 and "Menu" not in html_text.main_text(plain)


def brute_kept(sizes, headings):
    """Surges and dives by their definition, on blocks without markup."""
    kept, i = set(), 0
    window = lambda k: sum(sizes[k : k + 3])
    while i < len(sizes):
        if window(i) > 86:
            i = next(j for j in range(i, i + 3) if sizes[j] * 3 > 86 or headings[j])
            end = next(j for j in range(i, len(sizes)) if window(j + 1) < 43)
            kept |= set(range(i, end + 1))
            i = end
        i += 1
    return kept


def test_line_blocks_without_markup():
    rng = np.random.default_rng(12)
    for _ in range(200):
        sizes = [int(rng.choice([3, 12, 30, 60, 200])) for _ in range(int(rng.integers(1, 25)))]
        headings = [bool(rng.random() < 0.15) for _ in sizes]
        texts = [f"{k:02d}" + "x" * (n - 2) for k, n in enumerate(sizes)]
        page = "".join(f"<h2>{t}</h2>" if h else f"<div>{t}</div>" for t, h in zip(texts, headings, strict=True))
        want = brute_kept(sizes, headings)
        if want:
            assert html_text.main_text(page) == "\n".join(texts[k] for k in sorted(want))
        else:
            assert html_text.main_text(page) == "\n".join(texts)


def test_surge_dive_and_names():
    long = "word " * 40
    blocks = lambda page: html_text.main_text(page).split("\n")
    assert len(blocks(f"<p>{long}</p>" + "<p>short</p>" * 30)) == 1
    assert blocks(f"<div>Menu</div><h1>Big headline</h1><p>By A. B.</p><p>{long}</p><div class='site-footer'>{long}</div><p>{long}</p>")[:2] == ["Big headline", "By A. B."]
    assert blocks("<article><p class='share price'>x</p><p class='ad hoc'>y</p><div class='cookie-notice'>N</div><div class='share-price'>z</div><p>w <math>a+b</math></p></article><div>out</div>") == ["x", "y", "z", "w a+b"]
    assert blocks(f"<article><p>in</p></article><div>{long}</div>") == ["in"]


@pytest.mark.parametrize("page", ["<i>" * 40000 + "</b>" * 40000, '<a "' * 40000, "<div>" + "<i>" * 40000 + "<p>x</p>" * 40000, "<!" * 80000, "<a href='x" * 40000 + ">" * 40000, "<nav>" * 20000 + "<article>x</article>" * 20000, "<p>" + "long text &amp; " * 200000])
def test_odd_and_long_pages_take_linear_time(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 10


def test_pages_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2)], "page_id long, url string, html string, text int")
    assert {(r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(frame).collect()} == {(1, "", 0), (None, "", 0)}


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in held]) >= 0.95
    x = np.random.default_rng(0).random((4, quality.INPUTS)).astype(np.float32)
    pairs = [sum(float(model.v[i] @ model.v[j]) * row[i] * row[j] for i in range(40) for j in range(i)) for row in x[:, :40]]
    small = np.zeros_like(x)
    small[:, :40] = x[:, :40]
    assert np.allclose(model.logits(small) - model.bias - small @ model.w, pairs, atol=1e-4)


def test_quality_of_odd_rows(spark, odd):
    model = quality.train(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {round(r.score, 3) for r in quality.score(odd, model).collect()} == {0.5}
    assert quality.keep_good(odd, model, 0.7).count() == 0 and quality.keep_good(odd, model, 0.5).columns == odd.columns
    one = quality.train(odd, spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int"))
    assert quality.score(odd.limit(0), one).count() == 0


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(last[j + 1] + 1, now[-1] + 1, last[j] + (x != y)))
        last = now
    return min(last)


def test_leaks(spark):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"i{int(k)}" for k in rng.integers(0, 3000, n))) for i, n in enumerate([3, 12, 25, 40, 60])] + [(7, None), (8, "..."), (None, "a b")]
    docs = []
    for i in range(60):
        own = [f"i{int(k)}" for k in rng.integers(0, 3000, int(rng.integers(10, 120)))]
        if i % 2:
            leak = items[i % 5][1].split()
            for _ in range(int(rng.integers(0, 6))):
                at, kind = int(rng.integers(len(leak))), int(rng.integers(3))
                leak[at : at + 1] = [[], ["zz"], [leak[at], "yy"]][kind] or ([] if len(leak) > 1 else leak)
            at = int(rng.integers(len(own)))
            own[at:at] = leak
        docs.append((i, " ".join(own).title() + "!"))
    frame = spark.createDataFrame([*docs, (100, None), (101, ""), (None, items[3][1])], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.find_leaks(frame, table).collect()}
    want = {}
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for d, text in [*docs, (None, items[3][1])]:
        own = token(text)
        for i, item in items[:5]:
            item = token(item)
            k = decontam.allowed_edits(len(item), 0.15)
            best = min((edits(item, own[s : s + len(item) + k]) for s in range(len(own))), default=99)
            if best <= k:
                want[d, i] = best
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert all(got[x] >= want[x] for x in got)
    assert all(x in got for x in want if want[x] == 0)
    clean = {r.doc_id for r in decontam.drop_leaks(frame, table).collect()}
    assert clean == ({d for d, _ in docs} | {100, 101, None}) - {d for d, _ in got}
    assert decontam.find_leaks(frame, table.limit(0)).count() == 0 and decontam.find_leaks(frame.limit(0), table).count() == 0


@pytest.mark.parametrize("n", [7, 9, 14, 20, 40, 60])
def test_recall_of_leaks_with_all_edits(n):
    """Items with as many edits as are allowed, among others that share their stem, in long and short texts."""
    rng = np.random.default_rng(n)
    k = decontam.allowed_edits(n, 0.15)
    assert k == int(0.15 * n) and (k + 1) * decontam.piece_length(n, k) <= n
    stem = ["which", "of", "the"]
    items = [" ".join([*stem, *(f"w{int(x)}" for x in rng.integers(0, 5000, n - 3))]) for _ in range(150)]
    block = decontam.Items(list(range(150)), items, 0.15, decontam.repetitions(0.99))
    found = 0
    for i, item in enumerate(items):
        own = item.split()
        for at in rng.choice(n, k, replace=False):
            own[at] = ["", "zz", f"{own[at]} yy"][int(rng.integers(3))]
        text = " ".join(["x of the"] * int(rng.integers(0, 30)) + own + ["which of the end"])
        found += any(x == i for _, x, _, _ in block.matches(decontam._words(*textkit.utf8(pa.array([text])))))
    assert found >= 0.99 * 150


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 12))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    odd_rows = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0]), (1080, [None] * 12), (None, [1.0] * 12)]
    frame = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.NeighbourGraph(frame, 20).search(frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(700), -scores))[:20]
        hits += len(set(best.tolist()) & {v for v, _, _ in found})
        assert [r for _, _, r in found] == list(range(1, 21))
        assert all(abs(s - x[v] @ x[q]) < 1e-9 for v, s, _ in found)
    assert hits >= 0.95 * 20 * len(got)
    few = spark.createDataFrame(rows[:3], frame.schema)
    assert ann.NeighbourGraph(few, 20).search(few).count() == 6
    assert ann.NeighbourGraph(frame.limit(0), 20).search(frame).count() == 0


def test_neighbours_of_tight_clusters(spark, monkeypatch):
    for name, value in (("MOST_LEAVES", 1), ("CELL", 16), ("TREES", 3)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(1, 24)) + 0.05 * rng.normal(size=(900, 24)), rng.normal(size=(600, 24))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    frame = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    want = np.argsort(-scores, 1)[:, :20]
    found = {r.id: set(r.ids) for r in ann.NeighbourGraph(frame).graph.select("id", "ids").collect()}
    assert np.mean([len(found[i] & set(want[i].tolist())) / 20 for i in range(len(x))]) > 0.9


def test_recall_beyond_the_beam(spark):
    """A table of many times what a query expands, without any structure to follow."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(5000, 40)).astype(np.float32)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(5000), "embedding": pa.array(list(x))}))
    found = {r.query_id: set(r.found) for r in ann.NeighbourGraph(frame).search(frame.where("vec_id % 20 = 0")).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect()}
    scores = x[::20].astype(np.float64) @ x.T.astype(np.float64)
    scores[np.arange(250), np.arange(0, 5000, 20)] = -np.inf
    want = np.argsort(-scores, 1)[:, :20]
    assert np.mean([len(found[20 * i] & set(want[i].tolist())) / 20 for i in range(250)]) > 0.95


def test_quantised_vectors():
    x = np.random.default_rng(3).normal(size=64) * 7
    raw, scale = ann.quantised(x)
    assert np.abs(np.frombuffer(raw, np.int16) * scale - x).max() <= scale * 0.51
    assert ann.quantised(np.full(3, 1e-300))[0] == bytes(6)
    assert np.isfinite(ann.quantised(np.array([1e300, 0.0]))[1])


def test_very_long_texts(spark):
    """A text of 400,000 words beside its copy, a near copy and a short one, through every operator that reads texts."""
    rng = np.random.default_rng(11)
    own = [f"w{int(k)}" for k in rng.integers(0, 200_000, 400_000)]
    own[200_000:200_002] = ["MIT", "license"]
    own[399_000] = "someone@mail.example.org"
    near = list(own)
    near[5:50_000:5000] = ["changed"] * 10
    item = " ".join(own[300_000:300_030])
    frame = spark.createDataFrame([(1, " ".join(own), "a"), (2, " ".join(own), "a"), (3, " ".join(near), "a"), (4, "short", "b")], "doc_id long, text string, source string").repartition(4)
    scan = {r.doc_id: r for r in license_scan.scan_licenses(frame).collect()}
    # the address makes four words: someone, mail, example, org
    assert (scan[1].n_words, scan[1].n_base, scan[1].first_word) == (400_003, 1, 200_000)
    groups = {r.doc_id: r.component_id for r in near_dedup.NearDuplicates(5, 80).run(frame).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4}
    gone = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame, 2, digest=True).collect()}
    assert gone[1] == gone[4] == 0 and gone[2] == 400_000 and gone[3] == 400_000 - 10 - 5  # the first five words are in no window without a changed one
    names = {r.doc_id: r for r in pii.replace_entities(frame, b"k").collect()}
    assert names[1].n_entities == 1 and names[1].text == names[2].text and "someone@" not in names[1].text
    leaks = {r.doc_id: r.first_word for r in decontam.find_leaks(frame, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert leaks == {1: 300_000, 2: 300_000, 3: 300_000}
    assert sharding.shard_rows(frame, 2).count() == 4 and mixing.mix_sources(frame, {"a": 1, "b": 1}).where("doc_id < 4 and length(text) < 1000000").isEmpty()
    model = quality.train(frame, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"))
    assert quality.score(frame, model).count() == 4
    page = "<article>" + "".join(f"<p>{' '.join(own[i : i + 50])}</p>" for i in range(0, 400_000, 50)) + "</article>"
    assert html_text.main_text(page).split() == own
