"""Each operator against a brute-force version on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsq.llm import chunks, classifier, decontam, lm, neardup, pii, suffix, tokens
from tsq.llm.common import bitmap_of, read_documents, slots

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return read_documents(spark, SF).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_near_duplicates(docs, texts):
    """Classes are the components of exact shingle similarity at 0.8."""
    sets, rep, cls = {}, {}, {}
    for d, t in sorted(texts.items()):
        cls[d] = rep.setdefault(t, d)
        w = WORD.findall(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(set(cls.values()))
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in neardup.duplicate_classes(docs).collect()}
    assert got == {d: find(c) for d, c in cls.items()}


def crowded():
    """(id, text) rows of variants of one template, most pairs at 0.74 to 0.79, partners at 0.82, and their classes."""
    rng = random.Random(4)
    base, n = [f"w{i}" for i in range(400)], 150
    rows = []
    for i in range(2 * n):
        at = [6 * x for x in rng.sample(range(1, 66), 6)]
        if i >= n:
            both = rows[i - n][1][:2]
            at = both + [x for x in at if x not in both][:4]
        words = list(base)
        for k, x in enumerate(at):
            words[x] = f"shared{i % n}x{k}" if k < 2 else f"own{i}x{k}"
        rows.append((i, at, " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(396)} for w in (t.split() for _, _, t in rows)]
    links = {(j, i) for i in range(2 * n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = list(range(2 * n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, i in sorted(links):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    assert {(i, i + n) for i in range(n)} <= links and len({find(i) for i in range(2 * n)}) > n // 4
    return [(i, t) for i, _, t in rows], {i: find(i) for i in range(2 * n)}


@pytest.mark.parametrize(("small", "block"), [(16, 512), (2, 8)])
def test_links_in_large_buckets(spark, monkeypatch, small, block):
    """Variants of one template: most pairs at 0.74 to 0.79, partners at 0.82, which large buckets hide among the others."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    rows, want = crowded()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.duplicate_classes(df).collect()} == want


@pytest.mark.parametrize("partitions", [1, 23])
def test_classes_do_not_depend_on_partitions(spark, partitions):
    rows, want = crowded()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        assert {r["doc_id"]: r["class_id"] for r in neardup.duplicate_classes(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_document_a_class(spark):
    """Unlike texts under one id all stay; of near copies without ids one stays."""
    rng = random.Random(7)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(3)]
    one, two, near = (" ".join(x) for x in words)
    rows = [(1, one), (1, two), (None, near), (None, near + " more"), (None, near)]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in got if r["doc_id"] == 1) == sorted([one, two])
    assert len([r for r in got if r["doc_id"] is None]) == 1 and len(got) == 3


def test_signature_agreement_is_weighted_similarity():
    """Two weighted sets agree on coordinates as often as their weighted Jaccard similarity says."""
    values = np.arange(1, 41, dtype=np.uint64) * np.uint64(7919)
    a, b = np.linspace(0.5, 6, 40), np.linspace(4, 1, 40)
    sig = neardup.dart_minhash(np.concatenate([values, values]), np.array([0, 40, 80]), 4000, np.concatenate([a, b]))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4000)


def test_decontamination_equals_alignment(spark):
    def least_edits(window, text):
        before = [0] * (len(text) + 1)
        for i, c in enumerate(window):
            now = [i + 1]
            for j, x in enumerate(text):
                now.append(min(before[j] + (c != x), before[j + 1] + 1, now[j] + 1))
            before = now
        return min(before)

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    items = [(i, word(rng.choice([30, 64, 100, 150]))) for i in range(4)]
    made = []
    for k in range(60):
        x = list(rng.choice(items)[1])
        for _ in range(rng.randrange(7)):
            p, o = rng.randrange(len(x)), rng.random()
            x[p : p + (o < 0.66)] = ["z"] if o < 0.33 else [] if o < 0.66 else ["y"]
        made.append((k, word(rng.choice([0, 5, 90])) + "".join(x) + word(rng.choice([0, 7, 60]))))
    index = decontam.Index(items)
    plain = lambda t: "".join(map(chr, decontam.normalise(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32), np.array([0, len(t)]))[0]))
    want = {(k, int(i)) for k, t in made for i, w, e in zip(index.item, index.windows, index.edits, strict=True) if least_edits("".join(map(chr, w)), plain(t)) <= e}
    docs, bench = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_leaks(docs, bench, block_chars=150).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    # stretches of few hits give the same rows
    assert sorted(decontam.find_leaks(docs, bench, block_chars=150, hits=40).collect()) == sorted(found)
    assert decontam.find_leaks(docs, bench.where("false")).collect() == [] and decontam.drop_leaks(docs, bench.where("false")).count() == len(made)


def test_long_runs_of_one_character(spark):
    """A megabyte of one character against an item of it neither takes the memory of all hits nor long."""
    import resource

    index = decontam.Index([(1, "-" * 400), (2, "ab" * 200)])
    codes = np.full(1_000_000, ord("-"), dtype=np.uint32)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    doc, win, start, end, edits = index.search(codes, np.array([0, len(codes)]))
    assert set(index.item[win].tolist()) == {0} and (int(edits.min()), int(start[edits == 0].min())) == (0, 0)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # KB


def removed(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        n = sum(g and not p for g, p in zip(gone, [0, *gone], strict=False))
        out[d] = (len(b), sum(gone), n, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_repeated_strings(spark, docs, texts, hot):
    rng = random.Random(1)
    parts = ["".join(rng.choice("abc é") for _ in range(n)) for n in (99, 100, 130, 300)]
    rows = [(i, "".join(rng.choice([rng.choice(parts), "xyz" * rng.randrange(80), rng.choice(parts)[9:]]) for _ in range(rng.randrange(5)))) for i in range(60)]
    for df, have in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (docs, list(texts.items()))):
        assert {r[0]: tuple(r)[1:] for r in suffix.remove_repeats(df, hot=hot).collect()} == removed(have)


def test_chunk_dedup(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(60) for _ in range(10)]
    rows = [(i, text(50) + " " + passage[i % 10] + " " + text(50)) for i in range(40)] + [(i, text(120)) for i in range(40, 60)]
    rows += [(60, rows[0][1]), (61, "inserted " + rows[1][1])]
    got = {r["doc_id"]: r for r in chunks.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_repeated"] > 60 for i in range(40)) and all(got[i]["n_removed"] > 60 for i in range(10, 40))
    assert all(got[i]["n_repeated"] == got[i]["n_removed"] == 0 for i in range(40, 60)) and all(got[i]["n_removed"] == 0 for i in range(2, 10))
    assert got[60]["n_removed"] == got[60]["n_bytes"] and got[61]["n_removed"] > 0.9 * got[61]["n_bytes"]
    data = np.frombuffer(rows[0][1].encode(), dtype=np.uint8)
    cuts = chunks.cut_points(data, np.array([0, len(data)]))
    h, slow = 0, [0]
    for i, b in enumerate(data.tolist()):
        h = (2 * h + int(chunks._GEAR[b])) % 65536
        if i + 1 >= chunks.REACH and h >> (16 - chunks.MASK_BITS) == 0:
            slow.append(i + 1)
    assert {*slow, len(data)} <= {*cuts.tolist()}


@pytest.mark.parametrize("hot", [chunks.HOT, 1])
def test_chunk_dedup_equals_brute_force(spark, hot, monkeypatch):
    """Owners, runs, floors and counts of chunks against dictionaries; the file layout changes nothing."""
    monkeypatch.setattr(chunks, "HOT", hot)
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = [text(n) for n in (4, 9, 20, 60)]
    rows = [(rng.randrange(30), text(rng.randrange(30)) + " " + rng.choice(passage) + " " + text(rng.randrange(30))) for _ in range(40)]
    rows += [(None, rows[0][1]), (50, rows[1][1]), (51, ""), (52, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    tagged = [(r["doc_id"], r["tag"], (r["text"] or "").encode()) for r in df.collect()]
    rank = lambda r: (2**63 - 1 if r[0] is None else r[0], r[1])
    pieces, owner, often = {}, {}, Counter()
    for k in sorted(range(len(tagged)), key=lambda k: rank(tagged[k])):
        data = np.frombuffer(tagged[k][2], dtype=np.uint8)
        cuts = chunks.cut_points(data, np.array([0, len(data)])).tolist() if len(data) else [0]
        pieces[k] = [(a, b, tagged[k][2][a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        for a, _, x in pieces[k]:
            owner.setdefault(x, (k, a))
            often[x] += 1
    want = []
    for k, (d, _, data) in enumerate(tagged):
        run, total = [], Counter(n_chunks=len(pieces[k]))
        for piece in [*pieces[k], None]:
            if piece is not None and often[piece[2]] > 1:
                run.append(piece)
            elif run:
                size, stretch = run[-1][1] - run[0][0], 0
                long = min(chunks.MIN_RUN, len(data))
                total["n_repeated" if size >= long else "n_short"] += size
                for a, b, x in [*run, (0, 0, None)]:
                    if x is not None and owner[x] != (k, a):
                        stretch += b - a
                    else:
                        total["n_removed"] += stretch if size >= long and stretch >= long else 0
                        stretch = 0
                run = []
        want.append((str(d), len(data), *(total[c] for c in ("n_chunks", "n_repeated", "n_removed", "n_short"))))
    for parts in (1, 5):
        got = chunks.dedup_chunks(df.select("doc_id", "text").repartition(parts)).collect()
        assert sorted((str(r["doc_id"]), *r[1:6]) for r in got) == sorted(want)


def test_chunk_spans_and_kept_text(spark):
    """Spans add up to the counts, removed bytes occur in an earlier text, and what is kept is the text without them."""
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdeéß世\U0001f600") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = [text(60) for _ in range(4)]
    rows = [(i, text(30) + " " + passage[i % 4] + " " + text(30)) for i in range(16)] + [(16, passage[0]), (17, ""), (18, None)]
    rows += [(19, rows[2][1]), (19, rows[2][1]), (None, rows[3][1])]
    got = chunks.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep_text=True).collect()
    texts = Counter((r["doc_id"], r["n_bytes"]) for r in got)
    assert texts == Counter((d, len((t or "").encode())) for d, t in rows)
    by = dict(rows)
    for r in got:
        data = (by[r["doc_id"]] or "").encode()
        before = [(t or "").encode() for d, t in rows if r["doc_id"] is None or (d is not None and d < r["doc_id"])]
        before += [data] if r["doc_id"] == 19 else []
        kept, at = b"", 0
        for a, b in r["removed"]:
            assert at <= a < b and any(data[a:b] in x for x in before) and any(s <= a and b <= e for s, e in r["repeated"])
            kept, at = kept + data[at:a], b
        assert r["kept"].encode() == kept + data[at:]
        assert r["n_removed"] == sum(b - a for a, b in r["removed"]) == len(data) - len(r["kept"].encode())
        assert r["n_repeated"] == sum(b - a for a, b in r["repeated"])
    assert sum(r["n_removed"] > 0 for r in got) >= 14 and [r["kept"] for r in got if r["doc_id"] is None] == [""]


def test_token_counts(spark, docs, texts):
    counts = tokens.Counts(open(tokens.VOCABULARY, "rb").read())
    full = lambda t: len(counts.encoding.encode_ordinary(t))
    for r in tokens.op10_token_counts(spark, SF).collect():
        t = texts[r["doc_id"]]
        third = len(t) // 3
        edited = t[:third] + "edit" + t[third + 8 :]
        edited = edited[: 2 * third] + " and so on" + edited[2 * third :]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"]) == (full(t), full(edited), len(edited))
    rng = random.Random(5)
    for _ in range(300):
        x = "".join(rng.choice("a 'vesl\n!1") for _ in range(rng.choice([0, 1, 5, 60, 900])))
        tree, _n = tokens.Tree.build(x, counts)
        for _ in range(4):
            s = rng.randrange(-2, len(x) + 3)
            x, _n = tree.edit(x, s, s + rng.choice([0, 1, 5, 100]), rng.choice(["", " ", "'", "ve", "'ll x", "\n\n", "word " * 200]), counts)
            assert (tree.tokens[1], tree.chars[1]) == (full(x), len(x))


def test_edits_are_local(spark):
    """A small edit encodes its leaf and the boundary anew, not the text."""
    counts = tokens.Counts(open(tokens.VOCABULARY, "rb").read())
    text = "some words of a long text and more of them " * 3000
    tree, n = tokens.Tree.build(text, counts)
    assert n > 20_000
    for place in (0, 5000, 64_000, len(text) - 3):
        text, again = tree.edit(text, place, place + 2, "xyz", counts)
        assert 0 < again < 2000
    df = spark.createDataFrame([(1, text, "x", "y", "z")], "doc_id long, text string, reencoded string, Tree_Chars string, more string")
    edits = F.array(F.struct(F.lit(10).alias("start"), F.lit(12).alias("end"), F.lit("q").alias("put")))
    row = tokens.apply_edits(tokens.build_trees(df).withColumn("edits", edits), "edits").first()
    assert 0 < row["reencoded"] < 2000 and row["more"] == "z" and row["tree_chars"][1] == len(text) - 1


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base(spark):
    rng = random.Random(2)
    bits = ["a", "b.c", "@", ".", "-", "1", "12", "255", "256", "+", "+1", "(", "555", " ", "4111111111111111", "4111-1111 1111 1111", "\U0001f600", "x@y.z", "1.2.3.4", "+1 (980) 555-2833", "980-555-2833", "", "\n", "_"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(1500)] + [(9000, "1 " * 20000), (9001, "a." * 9000 + "@" + "b." * 9000)]
    got = {r["doc_id"]: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        found = base_spans(t)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)
        r = got[d]
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x == j for _, x, _ in found) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_added_spans(spark):
    """The method adds planted data outside the base patterns, and hardly anything else."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))

    def card():
        d = "4" + digits(14)
        s = sum(v - 9 * (v > 9) for v in (int(c) * (2 - i % 2) for i, c in enumerate(reversed(d))))
        return d + str(-s % 10)

    dotted = lambda c: ".".join(c[i : i + 4] for i in range(0, 16, 4))
    good = {
        "secret": lambda: (f'token = "{hexed(40)}"', 9, 1),
        "email": lambda: (f"mail {name()} [at] {name()} [dot] com", 5, 0),
        "phone": lambda: (f"call ({rng.randrange(200, 999)}) {digits(3)}-{digits(4)}", 5, 0),
        "card": lambda: (f"visa card {dotted(card())}", 10, 0),
    }
    bad = [lambda: f"build {name()}-{digits(2)}/{name()}_{name()}/{name()}", lambda: f"part {dotted('0' + digits(15))}", lambda: f"ratio 0{digits(3)} {digits(5)}", lambda: "meet at noon dot the line"]
    rows, want = [], {}
    for i in range(600):
        kind = rng.choice([*good, "none", "none"])
        if kind == "none":
            rows.append((i, f"{name()} {rng.choice(bad)()} {name()}"))
        else:
            text, skip, end = good[kind]()
            rows.append((i, f"{name()} {text} {name()}"))
            want[i] = f"{kind}:{7 + skip}:{7 + len(text) - end}"
    got = {r["doc_id"]: r for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {(i, x) for i, r in got.items() for x in filter(None, r["spans"].split(","))}
    right = added & set(want.items())
    assert len(right) > 0.9 * len(want) and len(right) > 0.95 * len(added), (len(right), len(want), len(added))
    assert sum(r[f"n_{k}"] for r in got.values() for k in pii.BASE_KINDS) == 0


def test_many_spans(spark):
    """Places and masks of thousands of matches in one text."""
    text = " ".join(f"u{i}@x.org" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    weights = {k: [-9.0, 0, 0, 0, 0] for k in range(len(pii.KINDS))}
    spans = pii.find_spans(df, weights=weights).first()["spans"].split(",")
    assert spans == [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[^ ]+", text)]
    assert pii.mask_text(df, weights=weights).first()["text"] == " ".join(["[EMAIL]"] * 3000)


def test_labelers_are_weighed():
    """A labeler that agrees with the others is trusted more than one that votes at random."""
    counts = [(3, (True, True, False), True, 400), (3, (True, True, True), True, 400), (3, (False, False, False), False, 400), (3, (False, False, True), False, 400), (3, (False, True, False), True, 30)]
    prior, rates = pii.estimate(counts)[3]
    assert rates[1][0] > 0.9 and rates[1][1] < 0.3 and abs(rates[2][0] - rates[2][1]) < 0.1 and 0.4 < prior < 0.6
    w = pii.train_classifier(counts, {**{k: (0.5, rates) for k in range(len(pii.KINDS))}, 3: (prior, rates)})[3]
    assert w[1] > 1 and abs(w[3]) < 0.5


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = classifier.score_quality(read_documents(spark, sf), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got["predicted"] == got["quality"]).mean() > 0.93


def test_classifier_equals_plain_loops(spark):
    """Features, updates and scores against a word-by-word version over dictionaries."""
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["good", "Prose", "spam!!", "buy", "now", "now", "é"]) for _ in range(rng.randrange(12))) for i in range(60)}
    labels = [(i, i % 2) for i in range(0, 60, 1) if i % 5]
    bits = 10
    unit = lambda w: int(classifier.span_hashes(np.frombuffer(w, dtype=np.uint8), np.array([0]), np.array([len(w)]))[0])

    def plain(text):
        found = [m.encode() for m in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\u0080-\U0010ffff \t\n\v\f\r]+", text)]
        h = [unit(w.lower()) for w in found]
        out = Counter(x >> (64 - bits) for x in h)
        for a, b in zip(h, h[1:], strict=False):
            pair = classifier.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], dtype=np.uint64))[0]
            out[int(pair) >> (64 - bits)] += 1
            if a == b:
                out[int(classifier._TWICE) >> (64 - bits)] += 1
        return {k: math.sqrt(n / max(1, len(h))) for k, n in out.items()}

    import zlib

    chosen = sorted((i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    examples = [({**plain(texts[i]), -1: 1.0}, y) for i, y in chosen]
    good = sum(y for _, y in examples) / len(examples)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= 0.02 else -(z[k] - math.copysign(0.02, z[k])) / ((1 + math.sqrt(n[k])) / 0.3 + 0.1)

    order = np.random.default_rng(7)
    for _ in range(classifier.EPOCHS):
        for k in order.permutation(len(examples)):
            x, y = examples[k]
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v * (0.5 / good if y else 0.5 / (1 - good))
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / 0.3 * w[f]
                n[f] += g * g
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = classifier.score_quality(df, spark.createDataFrame(labels, "doc_id long, quality int"), bits=bits).collect()
    for r in got:
        want = 1 / (1 + math.exp(-sum(weight(f) * v for f, v in {**plain(texts[r["doc_id"]]), -1: 1.0}.items())))
        assert math.isclose(r["score"], want, rel_tol=1e-7) and r["predicted"] == (r["score"] >= 0.7)
    none = classifier.score_quality(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_language_model(spark, docs, texts):
    import zlib

    got = {r["doc_id"]: r for r in lm.score_texts(docs, rounds=1, top=50).collect()}
    wide = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, rounds=1).collect()}
    train = {d: lm.split_words(t.encode()) for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10}
    c = Counter(w for ws in train.values() for w in ws)
    n, v = sum(c.values()) + len(train), len(c) + 1
    for d, t in texts.items():
        ws = lm.split_words(t.encode())
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws) + 1, sum(w in c for w in ws) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], wide[d], rel_tol=1e-7) and r["score"] < 0


def test_lattice_sums_all_segmentations():
    raw = {"▁": 1.0, "▁a": 2.0, "▁ab": 3.0, "a": 1.0, "b": 1.0, "ab": 0.5, "<0xC3>": 0.1, "<0xA9>": 0.2}
    w = lm.normalised(raw, 1.0)
    assert math.isclose(sum(map(math.exp, w.values())), 1.0)
    lattice = lm.Lattice(w)

    def every(word):
        return 1.0 if not word else sum(math.exp(w[word[:j]]) * every(word[j:]) for j in range(1, len(word) + 1) if word[:j] in w)

    for word in ("a", "ab", "ba", "abab", "aab"):
        assert math.isclose(lattice.log_prob(word), math.log(every("▁" + word)), rel_tol=1e-12)
    assert math.isclose(lattice.log_prob("é"), w["▁"] + w["<0xC3>"] + w["<0xA9>"], rel_tol=1e-12)
    words = ["a", "ab", "ba", "abab", "aab", "ab" * 30, "aéb"]
    assert np.allclose(lm.Batch(w).run(words), [lattice.log_prob(x) for x in words])
    one, two = {}, {}
    lm.Batch(w).run(words, np.array([1.0, 2, 3, 4, 5, 6, 7]), one)
    for x, k in zip(words, (1, 2, 3, 4, 5, 6, 7), strict=True):
        lattice.expect(x, k, two)
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)


def test_lattice_score_end_to_end(spark):
    """Scores equal a plain implementation: ranks, one round of EM over the training words, sum over all segmentations."""
    import zlib

    import sentencepiece

    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["The", "cat", "sätze", "wandering", "é世x", "ok!"]) for _ in range(rng.randrange(6)))
    rows = [(i, text()) for i in range(40)] + [(90, None), (None, "one more")]
    sp = sentencepiece.SentencePieceProcessor(model_file=lm.VOCABULARY)
    raw = {}
    for i in range(sp.vocab_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i) or "▁" in p[1:]):
            raw[p] = 1 / ((32000 if sp.is_byte(i) else min(32000, max(0.0, -sp.get_score(i)))) + 2.7)

    def paths(word, w):
        """(pieces, probability) of every segmentation."""
        if not word:
            return [([], 1.0)]
        heads = [[word[:j]] for j in range(1, len(word) + 1) if word[:j] in w]
        heads += [] if word[0] in w else [[f"<0x{b:02X}>" for b in word[0].encode()]]
        return [(h + t, math.prod(w[x] for x in h) * p) for h in heads for t, p in paths(word[max(1, len(h[0]) if len(h) == 1 and h[0][0] != "<" else 1) :], w)]

    def shares(x, ends):
        total = sum(x.values()) + ends
        return {k: v / total for k, v in x.items()}, ends / total

    train = [t or "" for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 10]
    w, _ = shares(raw, 0.5)
    seen = Counter()
    for t in train:
        for word in t.lower().split():
            every = paths("▁" + word, w)
            total = sum(p for _, p in every)
            for pieces, p in every:
                for x in pieces:
                    seen[x] += p / total
    w, end = shares({k: seen[k] + lm.SMOOTH for k in raw}, len(train) + 0.5)
    want = sorted(math.log10(end) + sum(math.log10(sum(p for _, p in paths("▁" + x, w))) for x in (t or "").lower().split()) for _, t in rows)
    for top in (2, 1000):
        got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1, top=top).collect()
        assert np.allclose(sorted(r["score"] for r in got), want, rtol=1e-9)


def rejected(t):
    """The quality rules word by word."""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    chars = sum(map(len, w))
    return (
        len(w) < 50 or 100 * len(again) > 50 * len(w) or sum(c in "#*$%&|<>" for c in t) * 10 > len(w) or (len(lines) - len(set(lines))) * 2 > len(lines)
        or chars * 2 < len(w) * 5 or chars > len(w) * 14 or sum(c.isupper() for c in t) * 2 > chars or t.count("!!") * 10 > len(w) * 2
    )


def test_stages_equal_brute_force(spark, docs, texts):
    """What each stage keeps of its own input, and the texts it leaves."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, t in texts.items() if not rejected(t)}
    classes = defaultdict(list)
    for r in neardup.duplicate_classes(docs).collect():
        classes[r["class_id"]].append(r["doc_id"])
    one = stages["near dedup"](spark, docs, SF)
    assert one.columns == docs.columns and {r["doc_id"]: r["text"] for r in one.collect()} == {min(x): texts[min(x)] for x in classes.values()}
    leaks = {r["doc_id"] for r in decontam.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    clean = stages["decontamination"](spark, docs, SF)
    assert leaks and clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == texts.keys() - leaks
    masked = {r["doc_id"]: r["text"] for r in stages["personal data"](spark, docs, SF).collect()}
    for r in pii.find_spans(docs).collect():
        t, out, at = texts[r["doc_id"]], "", 0
        for kind, a, b in (x.split(":") for x in filter(None, r["spans"].split(","))):
            if int(a) >= at:
                out += t[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert masked[r["doc_id"]] == out + t[at:]


def test_stages_with_odd_rows(spark):
    """Null, empty, repeated and clashing rows pass every stage, and so does an empty table."""
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, None, None, 1, "a", "b"), (1, text, "en", "s", 1, "a", "b"), (None, text + " more", "en", "s", None, "a", "b"), (2, None, "en", "s", 0, "a", "b"), (3, "", "en", "s", 0, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_row` string, label string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF).collect()
        assert len(out) == {"quality rules": 3, "near dedup": 2}.get(name, 5), name
        assert stage(spark, df.where("false"), SF).collect() == []


def test_mask_and_pipeline(spark):
    import corpus_pipeline

    docs = read_documents(spark, "/root/testdata/sf0.001")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = {r["doc_id"] for r in out}
    assert 0 < len(ids) < docs.count() and len(ids) == len(out)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    for rows in by.values():
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"] + 0.5) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_bitmap_comes_in_few_jobs(spark):
    """However many partitions the shuffle has; the driver keeps what it knows of each job."""
    values = spark.range(0, 70_000, 1, 4).select(F.xxhash64("id").alias("tag"))
    tags = np.array([r["tag"] for r in values.collect()]).view(np.uint64)
    want = np.zeros(1 << 21, dtype=bool)
    for slot in slots(tags, len(want)):
        want[slot] = True
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.sparkContext.setJobGroup("bitmap", "")
        assert (bitmap_of(values, len(tags)) == np.packbits(want)).all()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert 0 < len(jobs) <= 10
