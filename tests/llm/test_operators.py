"""The operators against brute force, on planted cases and on awkward tables."""
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import edits, exact_dedup, line_dedup, media, minhash, mixing, sharding, suffix_dedup, toxicity, unit_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba de ki lo mu na pe ri so tu va xe zo ga hi".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    passage = prose(rng, 120)
    texts = [prose(rng, rng.randint(3, 300)) for _ in range(25)]
    base = prose(rng, 260)
    near = []
    for _ in range(12):
        w = base.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = prose(rng, 1)
        near.append(" ".join(w))
    texts += [base] * 5 + near + [prose(rng, 40) + " " + passage + "\n" + prose(rng, 30) for _ in range(6)]
    texts += ["", None, " \n\t", "one", "One", "one two", "é" * 900, "z" * 3000, "line\n" * 40, base.upper()]
    line = prose(rng, 60).split()
    for _ in range(5):
        w = list(line)
        w[rng.randrange(60)] += "q"
        texts.append(prose(rng, 20) + "\n" + " ".join(w) + "\n" + prose(rng, 15))
    return [(i, t, "en", "s%d" % (i % 3), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def find(links, ids):
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        comp[b] = a
    return {i: root(i) for i in ids}


def test_media(docs, empty):
    got = rows(media.store_media(docs))
    for i, t, *_ in corpus():
        raw = (t or "").encode()
        pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert media.store_media(empty).count() == 0


def test_media_of_many_chunks(spark):
    rng = random.Random(2)
    body = prose(rng, 40000)
    table = spark.createDataFrame([(1, body), (2, prose(rng, 50) + body), (3, body), (4, body + "tail")], "doc_id long, text string")
    got = rows(media.store_media(table))
    assert got[1]["payload_sha256"] == got[3]["payload_sha256"] and got[1]["media_sha256"] == got[3]["media_sha256"]
    assert int(re.search(r"chunks=(\d+)", got[1]["feature"])[1]) > 5
    lists = rows(media.manifests(table))
    assert len(set(map(bytes, lists[1]["chunks"])) & set(map(bytes, lists[2]["chunks"]))) > 2


def test_media_of_odd_tables(spark):
    table = [(1, "a" * 70, 5), (1, "b", 6), (None, "a" * 70, 7), (2, None, 8), (3, "", 9), (4, "é" * 40000, 1)]
    docs = spark.createDataFrame(table, "doc_id long, text string, media_id int")
    got = sorted((str(r.doc_id), r.payload_sha256, r.n_bytes) for r in media.store_media(docs).collect())
    pay = lambda t: (t or "").encode() + b"\0" * (max(64, -(-len((t or "").encode()) // 64) * 64) - len((t or "").encode()))
    assert got == sorted((str(i), hashlib.sha256(pay(t)).hexdigest(), len((t or "").encode())) for i, t, _ in table)


def test_media_are_kept_and_read(spark, docs, tmp_path):
    media.write_media(docs, f"file://{tmp_path}/m")
    back = rows(media.read_media(spark, f"file://{tmp_path}/m"))
    assert {i: r["text"] for i, r in back.items()} == {i: t or "" for i, t, *_ in corpus()}
    some = media.read_media(spark, f"file://{tmp_path}/m", spark.createDataFrame([(3,), (4,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in some) == [3, 4]
    chunks = spark.read.parquet(f"file://{tmp_path}/m/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_exact(docs, empty, spark):
    got = rows(exact_dedup.exact_dedup(docs))
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(lower(t), []).append(i)
    for i, t, *_ in corpus():
        g = groups[lower(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256(lower(t).encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    again = spark.createDataFrame([(None, "a"), (None, "A"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.kept, r.group_size) for r in exact_dedup.exact_dedup(again).collect()) == [(False, True, 4)] * 2 + [(True, False, 4)] * 2


def test_sharding(docs, empty, spark):
    got = rows(sharding.shard(docs, limit=2000))
    assert len(got) == len(corpus())
    load, size = Counter(), {}
    for i, t, *_ in corpus():
        r = got[i]
        bits = format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b")
        assert bits.startswith(r["shard"]) and len(r["shard"]) == r["depth"] and r["bytes"] == len((t or "").encode())
        load[r["shard"]] += r["bytes"]
        size[r["shard"]] = r["shard_bytes"], r["shard_docs"]
    assert all(b == load[s] and (b <= 2000 or n == 1) for s, (b, n) in size.items())
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for s in names:
        if s:
            parent = s[:-1]
            assert sum(load[x] for x in names if x.startswith(parent)) > 2000
    assert sharding.shard(empty).count() == 0
    twice = spark.createDataFrame([(1, "x" * 50), (1, "y" * 50), (None, None)], "doc_id long, text string")
    assert sharding.shard(twice, limit=60).count() == 3


def test_mixing(docs, empty, spark):
    got = mixing.mix_sources(docs, fraction=0.5).collect()
    assert len(got) == len(corpus()) and all(0 <= r.p <= 1 for r in got)
    cells = {}
    for r in got:
        cells[r.source, r.lang, r.topic] = r.weight
    assert abs(sum(cells.values()) - 1) < 1e-6
    odd = spark.createDataFrame([(1, None, None, None), (None, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    assert mixing.mix_sources(odd).count() == 2 and mixing.mix_sources(empty).count() == 0


def test_sample_follows_the_targets(spark):
    rng = random.Random(12)
    table = [(i, prose(rng, rng.randint(5, 60)), rng.choice(["en"] * 8 + ["de", "fr"]), rng.choice(["big"] * 20 + ["a", "b", "c"]), rng.choice("xxxxxy"), 7, 0.5) for i in range(6000)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, topic string, _tokens int, p double")
    report = mixing.marginals(docs).collect()
    assert all(abs(r.target - r.realised) < 0.005 for r in report) and max(abs(r.target - r.natural) for r in report) > 0.05
    kept = mixing.sample_documents(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert all(r._tokens == 7 and r.p == 0.5 for r in kept)
    total = sum(len(r.text.split()) for r in kept)
    for r in report:
        have = sum(len(x.text.split()) for x in kept if x[r.dimension] == r.value) / total
        assert abs(have - r.target) < 0.05, (r, have)


def test_raking_meets_its_targets(spark):
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", 10 + 7 * a + 5 * b * c) for a in range(3) for b in range(2) for c in range(2)], "source string, lang string, topic string, tokens long")
    want = {d: spark.createDataFrame(v, f"{d} string, _share double") for d, v in (("source", [("s0", 0.5), ("s1", 0.3), ("s2", 0.2)]), ("lang", [("l0", 0.7), ("l1", 0.3)]), ("topic", [("t0", 0.4), ("t1", 0.6)]))}
    out = mixing.rake(cells, rounds=20, targets=want)
    for d, t in want.items():
        shares = {r[0]: r[1] for r in out.groupBy(d).agg({"w": "sum"}).collect()}
        assert all(abs(shares[r[0]] - r[1]) < 1e-6 for r in t.collect())


def check_suffixes(table, docs):
    """table: (doc_id, text); rows with a null doc_id count for nothing."""
    raws = [(i, (t or "").encode()) for i, t in table]
    seen = Counter(b[k : k + 400] for i, b in raws if i is not None for k in range(len(b) - 399))
    want = []
    for i, b in raws:
        gone = bytearray(len(b))
        for s in range(len(b) - 399 if i is not None else 0):
            if seen[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((str(i), len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest(), any(gone)))
    got = suffix_dedup.remove_spans(docs, suffix_dedup.repeated_spans(docs)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.repeats) for r in got) == sorted(want)
    assert any(w[5] for w in want)


def test_suffixes(docs, empty):
    check_suffixes([(i, t) for i, t, *_ in corpus()], docs)
    assert suffix_dedup.remove_spans(empty, suffix_dedup.repeated_spans(empty)).count() == 0


def test_suffixes_of_odd_tables(spark, monkeypatch):
    rng = random.Random(17)
    a, b, c = prose(rng, 150), prose(rng, 120), prose(rng, 200)
    table = [(1, a + b), (1, c), (1, c), (2, "x" * 50 + a), (None, b + c), (3, "é" * 700), (4, b[:450]), (5, None), (6, ""), (-7, "q" + c[100:700] + "z" * 500), (1 << 40, prose(rng, 3000) + a[:420] + prose(rng, 10)), (8, c[:399])]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns({"tkey": F.lit("x"), "at": F.lit(1), "start": F.lit(2)})
    check_suffixes(table, docs)
    monkeypatch.setattr(suffix_dedup, "REACH", 700)
    check_suffixes(table, docs)


def test_suffixes_of_hot_grams(docs, monkeypatch):
    want = rows(suffix_dedup.remove_spans(docs, suffix_dedup.repeated_spans(docs)))
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "SLICE", 2)
    assert rows(suffix_dedup.remove_spans(docs, suffix_dedup.repeated_spans(docs))) == want


def check_passages(table, docs):
    """table: (doc_id, text); 51 words in a row that two rows have, each row a document of its own."""
    sets = [set() if i is None else {tuple(w[k : k + 51]) for k in range(len(w) - 50)} for i, t in table for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")]]
    seen = Counter(x for s in sets for x in s)
    want = sorted((str(i), len((t or "").encode()), any(seen[x] > 1 for x in s)) for (i, t), s in zip(table, sets, strict=True))
    got = suffix_dedup.remove_spans(docs, suffix_dedup.repeated_spans(docs), passages=suffix_dedup.shared_passages(docs)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.shares_passage) for r in got) == want
    return {i for i, _, x in want if x}, {str(r.doc_id) for r in got if r.repeats}


def test_passages_shorter_than_400_bytes(spark, monkeypatch):
    rng = random.Random(23)
    short = lambda n: " ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n))
    p, q, once, twin = short(51), short(70), short(60), short(80)
    table = [(1, short(90) + " " + p + " " + short(20)), (2, p.replace(" ", "\n\t")), (3, short(5) + "x" + p), (4, q), (5, short(30) + "\n" + q[20:] + " end"), (6, once + "\n" + once), (7, twin), (7, twin), (8, short(50)), (9, p.upper())]
    table += [(10, None), (11, ""), (None, p), (12, short(4000) + " " + "w" * 3000 + " " + q), (12, short(200)), (13, "same " * 300), (14, "same " * 60), (15, short(50) + " " + p.rsplit(" ", 1)[0])]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns({"tkey": F.lit("x"), "at": F.lit(1), "passage": F.lit(2)})
    shared, long = check_passages(table, docs)
    assert shared == {"1", "2", "4", "5", "7", "12", "13", "14"} and not shared <= long
    monkeypatch.setattr(suffix_dedup, "REACH", 700)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 30)
    assert check_passages(table, docs)[0] == shared


def test_passages_by_brute_force(docs, empty):
    shared, _ = check_passages([(i, t) for i, t, *_ in corpus()], docs)
    assert shared
    assert suffix_dedup.shared_passages(empty).count() == 0


def test_passages_of_nearly_equal_texts(spark):
    rng = random.Random(29)
    base, table = prose(rng, 200).split(), []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(2, 8)):
            w[rng.randrange(200)] = "q%d" % i
        table.append((i, " ".join(w[rng.randrange(60) :])))
    table += [(100 + i, " ".join(prose(rng, 9).split() + base[k : k + n])) for i, (k, n) in enumerate([(0, 50), (0, 51), (100, 30), (140, 52), (149, 51)])]
    check_passages(table, spark.createDataFrame(table, "doc_id long, text string"))


def test_passages_that_differ_at_an_end(spark):
    w = prose(random.Random(37), 50)
    table = [(i, w + " last" + c) for i, c in enumerate("abcd")] + [(10 + i, c + "first " + w) for i, c in enumerate("abcd")] + [(20, "efirst " + w + " "), (21, "laste " + w)]
    assert check_passages(table, spark.createDataFrame(table, "doc_id long, text string").coalesce(1))[0] == set()
    table += [(30, "laste\n" + w)]
    assert check_passages(table, spark.createDataFrame(table, "doc_id long, text string").coalesce(1))[0] == {"21", "30"}


def test_suffix_query_names_documents_that_share_passages(spark, tmp_path):
    rng = random.Random(31)
    p = " ".join(rng.choice(SYLLABLES) for _ in range(55))
    spark.createDataFrame([(1, "one " + p), (2, p + " two"), (3, prose(rng, 100))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.repeats, r.shares_passage) for r in suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, False, True), 2: (0, False, True), 3: (0, False, False)}


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_near(table, k, num, den):
    sets = {i: shingles(t, k) for i, t, *_ in table}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return sets, find(links, ids)


def test_minhash(docs, empty, spark):
    for k, num in ((3, 85), (5, 80)):
        got = rows(minhash.near_groups(docs, k, num))
        sets, comp = brute_near(corpus(), k, num, 100)
        for i in sets:
            assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), comp[i], comp[i] == i)
    assert minhash.near_groups(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (2, "A b c")], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in minhash.near_groups(odd).collect()) == sorted(map(str, [(None, None, True), (5, 2, False), (5, 2, False), (2, 2, True)]))


def test_near_dedup_keeps_one_of_each_group(docs):
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    comp = brute_near(corpus(), 5, 80, 100)[1]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in comp.items() if i == c)


def normal_line(line):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", lower(line)))


def brute_lines(table):
    """Places of lines to remove, by edit distance alone."""
    place, first = {}, {}
    for i, t in sorted((x for x in table if x[0] is not None), key=lambda x: (x[0], x[1] or "")):
        for n, line in enumerate((t or "").split("\n")):
            w = normal_line(line)
            if w:
                place[i, n, t] = w
    for p in sorted(place, key=lambda p: p[:2]):
        first.setdefault(place[p], p)
    names, links = list(first), []
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            most = int(max(len(a), len(b)) * 0.2 + 1e-9)
            if abs(len(a) - len(b)) <= most and edits.distance(a, b) <= most:  # held against the textbook in test_edits
                links.append((names.index(a), names.index(b)))
    comp = find(links, range(len(names)))
    keeper = {}
    for p in sorted(place, key=lambda p: p[:2]):
        keeper.setdefault(comp[names.index(place[p])], p)
    return {p for p, w in place.items() if keeper[comp[names.index(w)]] != p}


def check_lines(table, docs):
    want = brute_lines(table)
    got = line_dedup.cut(docs.select("doc_id", "text"), line_dedup.removed_lines(docs)).collect()
    assert len(got) == len(table)
    left = sorted((str(i), "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n, t) not in want)) for i, t in table)
    assert sorted((str(r.c0), r.c1 or "") for r in got) == left
    assert sum(r._n_removed for r in got) == sum((i, n, t) in want for i, t in table for n in range(len((t or "").split("\n"))))
    return want


def test_lines(docs, empty, monkeypatch):
    table = [(i, t) for i, t, *_ in corpus()]
    want = check_lines(table, docs)
    assert len(want) > 60
    monkeypatch.setattr(line_dedup, "MANY", 3)
    assert check_lines(table, docs) == want
    assert line_dedup.removed_lines(empty).count() == 0
    assert line_dedup.without_repeated_lines(empty).count() == 0


def test_lines_of_odd_tables(spark):
    rng = random.Random(9)
    long = prose(rng, 6000)
    near = long.split()
    near[1000] += "x"
    a = prose(rng, 20)
    table = [(0, a), (1, a), (1, a + "\nalone in its row"), (1, None), (None, a), (1 << 40, a.upper()), (-3, "12 345\nTotal: 99"), (5, "87 912\nTotal, 13"),
             (6, long), (7, " ".join(near)), (8, "Home page\n\nnext"), (9, "home  page\n"), (10, "menu"), (11, "menus"), (1, a)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    check_lines([t for t in table if t != (1, a)], docs.filter("doc_id is null or doc_id <> 1 or text is null or text like '%alone%'"))
    got = line_dedup.cut(docs, line_dedup.removed_lines(docs)).collect()
    by = {}
    for r in got:
        by.setdefault(r.c0, []).append(r.c1)
    assert by[-3] == ["12 345\nTotal: 99"] and by[5] == ["87 912\nTotal, 13"] and by[7] == [""] and by[None] == [a] and by[1 << 40] == [""]
    assert sorted(map(str, by[1])) == sorted(["", "", "alone in its row", "None"])
    clash = docs.withColumns({"_lines": F.lit(7), "_gone": F.lit("x"), "keys": F.lit(1)})
    kept = line_dedup.without_repeated_lines(clash)
    assert kept.columns == clash.columns and all(r._lines == 7 and r._gone == "x" for r in kept.collect())


def brute_units(table):
    """For each row its text less what repeats, by plain Python; and the words it shares."""
    pattern = re.compile(unit_dedup.SENTENCE)
    norm = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", lower(t)))
    units = []
    for i, t in table:
        at = 0
        for n, line in enumerate((t or "").split("\n")):
            parts = pattern.findall(line)
            cuts = [(i, at, 0, t, n, -1, line)] if norm(line) else []
            pos = at
            for k, p in enumerate(parts):
                if len(parts) > 1 and len(norm(p).split()) >= unit_dedup.SENTENCE_WORDS:
                    cuts.append((i, pos, 1, t, n, k, p))
                pos += len(p.encode())
            units += cuts
            at += len(line.encode()) + 1
    first, count = {}, Counter(norm(u[6]) for u in units)
    for u in sorted(units, key=lambda u: (u[0], u[1], 1 - u[2], u[3] or "")):
        first.setdefault(norm(u[6]), u)
    gone = {(u[0], u[3], u[4], u[5]) for u in units if first[norm(u[6])] != u}
    out = []
    for i, t in table:
        left = []
        for n, line in enumerate((t or "").split("\n")):
            if (i, t, n, -1) not in gone:
                left.append("".join(p for k, p in enumerate(pattern.findall(line)) if (i, t, n, k) not in gone))
        own = [u for u in units if (u[0], u[3]) == (i, t) and count[norm(u[6])] > 1 and len(norm(u[6]).split()) >= unit_dedup.SENTENCE_WORDS]
        wide = {u[4] for u in units if (u[0], u[3]) == (i, t) and u[5] < 0 and count[norm(u[6])] > 1}
        out.append((i, "\n".join(left), sum(len(norm(u[6]).split()) for u in own if u[5] < 0 or u[4] not in wide)))
    return out


def check_units(table, docs):
    got = unit_dedup.cut(docs.select("doc_id", "text"), unit_dedup.marked(docs)).collect()
    want = brute_units(table)
    assert sorted((str(r.c0), r.c1 or "", r._shared) for r in got) == sorted((str(i), t, s) for i, t, s in want)
    for r in got:
        assert r._units >= 1 and r._bytes == sum(s.end - s.start for s in r._spans)
    return got


def test_units(docs, empty):
    check_units([(i, t) for i, t, *_ in corpus()], docs)
    assert unit_dedup.cut(empty, unit_dedup.marked(empty)).count() == 0


def test_units_of_odd_tables(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 9) + "." for _ in range(3))
    table = [(1, f"Menu\n\nHome  page\nmenu"), (2, "home page\n\nMENU\nnew"), (3, None), (4, f"{a} {b} tail\n{c}"), (5, f"Head {a.upper()} {b}\n{b}"), (5, f"{c} other. {a} one two three\nmenu"),
             (6, f"x! y? {a}{b}... z"), (7, ("word " * 30 + ". ") * 50), (-1, f"{a}  {c}"), (8, "...\n!?\n   \n\t"), (9, "...")]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns({"_units": F.lit(1), "_gone": F.lit(2), "c0": F.lit(3)})
    check_units(table, docs)
    more = docs.unionByName(spark.createDataFrame([(None, a + "\nmenu", 1, 2, 3)], docs.schema))
    got = unit_dedup.cut(more.select("doc_id", "text"), unit_dedup.marked(more)).filter("c0 is null").collect()
    assert [r.c1 for r in got] == [a + "\nmenu"]


def toxic_table(spark, n=1500):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        bad, poor = rng.random() < 0.2, rng.random() < 0.2
        w = prose(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(2, 5) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "Slurrix,", "vexolt", "mirefang."]))
        w += ["click", "here", "buynow"] if poor else []
        docs.append((i, " ".join(w), 1.0))
        labels.append((i, int(not poor), int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, p_toxic double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_toxicity_on_held_out_documents(spark):
    docs, labels, truth = toxic_table(spark)
    chain = toxicity.train(docs, labels.filter("doc_id < 1000"))
    got = toxicity.score(docs.select("doc_id", "text"), chain).filter("doc_id >= 1000").collect()
    right = sum((r.p_toxic > toxicity.THRESHOLD) == bool(truth[r.doc_id]) for r in got)
    assert right / len(got) > 0.97
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("p_toxic = 1.0").count() == kept.count()


def test_toxicity_without_labels_or_text(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(docs, labels).count() == docs.count()
    full = toxic_table(spark, 300)
    assert toxicity.without_toxic(empty, full[1]).count() == 0
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0)], "doc_id long, text string, p_toxic double")
    chain = toxicity.train(full[0], full[1])
    assert toxicity.score(odd.select("doc_id", "text"), chain).count() == 3
