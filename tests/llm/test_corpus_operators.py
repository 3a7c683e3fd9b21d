"""Substring dedup, Jaccard join, decontamination, WARC, pipeline."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import jaccard_join, warc
from codeloom.llm.components import components
from codeloom.llm.decontamination import decontaminate
from codeloom.llm.substring_dedup import remove_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def digests(df):
    kept = F.coalesce(F.sha2("kept", 256), F.lower(F.hex("digest")))
    return Counter((r[0], r.n_words, r.n_removed, r.kept) for r in df.withColumn("kept", kept).collect())


# Substring dedup


def removed_brute(rows):
    first = {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        w = WORD.findall(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    out = Counter()
    for i, t in rows:
        w, gone = WORD.findall(t), set()
        for j in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        out[(i, len(w), len(gone), sha(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def test_repeats(docs, plain, nothing):
    assert digests(remove_repeats(docs)) == removed_brute(plain)
    assert remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_random_documents(spark, seed):
    """Few words, so passages of all lengths meet at all offsets."""
    r = random.Random(seed)
    pool = [[r.choice("abcdefghijkl") * r.randint(1, 3) for _ in range(r.randint(40, 400))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            w += p[a : a + r.randint(20, 130)] + ["z"] * r.choice([0, 0, 1, 60])
        rows.append((r.choice([i, i, 5]), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(remove_repeats(df)) == removed_brute(rows)


# Jaccard join


def test_prefix_is_shortened_to_the_target():
    assert jaccard_join.prefix_length(28, 8, 0.8, 0.9999) == 5
    assert jaccard_join.prefix_length(28, 8, 0.8, 0.5) == 8
    assert jaccard_join.prefix_length(1, 8, 0.8, 0.9999) == 1


def linked_brute(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = WORD.findall(text)
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and len(a & b) >= t * len(a | b):
                links[i].add(j)
                top[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = Counter()
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in members[find(i)] if rows[j][0] is not None]
        out[(key, min(ids, default=None), len(links[i]), len({sets[j] for j in links[i]} - {sets[i]}))] += 1
    return out


def links_of(df):
    return Counter((r.doc_id, r.class_id, r.n_links, r.n_linked_sets) for r in df.collect())


def test_links(docs, plain, nothing):
    assert links_of(jaccard_join.jaccard_classes(docs)) == linked_brute(plain)
    assert jaccard_join.jaccard_classes(nothing).count() == 0


def test_a_large_group_is_verified_in_blocks(spark, monkeypatch):
    """Chains of copies with one more change each, over several small blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    r, rows = random.Random(2), []
    w = [f"w{r.randrange(10**6)}" for _ in range(120)]
    for i in range(70):
        w[r.randrange(len(w))] = f"n{i}"
        rows += [(100 * i + c, " ".join(w)) for c in range(1 + i % 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert links_of(jaccard_join.jaccard_classes(df)) == linked_brute(rows)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in top.items() if any(k in e and e[0] != e[1] for e in edges)}


# Benchmark decontamination


def test_decontamination(spark, docs, plain, nothing):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(fold))
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = dict(plain)
    long = split(texts[0])
    items = [(1, " ".join(long[5:40]).upper()), (2, " ".join(long[30:42])), (3, "ONE, two-three!"), (4, "one"), (5, None), (6, "?! "), (1, " ".join(long[60:69]))]
    items += [(7, "same line here same line here"), (12, "word " * 13), (None, " ".join(split(texts[8])[3:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = split(t or "")
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add("" if i is None else str(i))
    want = Counter()
    for i, t in plain:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= own
        want[(i, len(w), len(hit), ",".join(sorted(found)), bool(hit))] += 1
    got = decontaminate(docs, bench)
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got.collect()) == want
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(nothing, bench).count() == 0


# WARC


@pytest.fixture()
def pages(spark):
    rows = [(5, "http://a/\r\nX: y", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (4, None, None), (9, "u", ""), (1, "v", "WARC/1.1\r\n\r\nx\r\n\r\n")]
    rows += [(20, "w", "y" * 3_000_000), (21, "w", "y" * 3_000_000), (None, "n", "<p>é</p>"), (30, "z", "plain"), (30, "z", "plain")]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "page_id long, url string, html string, __key int")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, pages, tmp_path, compression):
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, compression=compression)
    rows = warc.read_warc(spark, path).collect()
    plain = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, b in plain:
        if i is not None:
            first[b] = min(i, first.get(b, i))
    want = Counter()
    for i, b in plain:
        again = i != first[b]
        code = "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        want[("" if i is None else str(i), "revisit" if again else "response", code, len(b), None if again else b, f"<urn:page:{first[b]}>" if again else None)] += 1
    page = lambda r: r.record_id[len("<urn:page:") : -1]
    assert Counter((page(r), r.record_type, r.payload_digest, r.payload_length, r.payload and bytes(r.payload) if r.payload is None else bytes(r.payload), r.refers_to) for r in rows) == want
    assert {r.target_uri for r in rows if page(r) == "5"} == {"http://a/%20X:%20y"}


def test_predicates_are_decided_by_headers(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, least=5)
    read = warc.read_warc(spark, path)
    assert read.where("record_type = 'revisit'").count() == 3
    assert read.where("target_uri IN ('http://b', 'v')").count() == 2
    assert read.where("record_type = 'response' AND payload_length < 9").count() == 4
    assert all(r.payload is None for r in warc.read_warc(spark, path, payloads=False).collect())
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and reader.wanted == [("warc-type", frozenset(["revisit"]))]


def test_archive_of_nothing(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


# Pipeline


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    read = spark.read.parquet
    docs = read(f"{folder}/documents.parquet")
    before = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES, (None, linked, clean, hidden, None)):
        after = corpus_pipeline.staged(stage(spark, before, folder), "test")
        if check:
            assert after.columns == docs.columns
            check(before.toPandas(), after.toPandas(), read(f"{folder}/benchmark.parquet").toPandas())
        assert 0 < after.select("doc_id").distinct().count() <= before.count(), name
        before = after
    assert corpus_pipeline.run(spark, folder).count() == before.count()


def linked(before, after, _):
    rows = list(zip(before.doc_id, before.text))
    assert set(after.doc_id) == {k[1] for k in linked_brute(rows)} and after.doc_id.is_unique


def clean(before, after, bench):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    windows = {tuple(w[j : j + 10]) for w in map(split, bench.text) for j in range(len(w) - 9)}
    holds = lambda w: any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9))
    assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text) if not holds(split(t))}


def hidden(before, after, _):
    assert len(before) == len(after)
    assert not after.text.str.contains(r"token = \"[0-9a-f]{20}").any()
    same = before.set_index("doc_id").text == after.set_index("doc_id").text
    assert (after.set_index("doc_id").text[~same].str.contains("[secret]", regex=False)).all()


def test_pipeline_stages_take_odd_rows(spark, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    folder, rows = "/root/testdata/sf0.001", docs.select(*columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), folder).count() == 0
        assert stage(spark, rows, folder).count() >= 0
    kept = corpus_pipeline.near_duplicates(spark, rows, folder)
    assert Counter(r.doc_id for r in kept.collect()).most_common(1)[0][1] == 1


def test_classes_that_share_an_id_keep_one_row_each(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (2, f"{one} more"), (1, two), (3, f"{two} more"), (1, three), (1, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, one), (1, two), (1, three), (1, ""), (4, "")])
