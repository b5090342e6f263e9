"""Jaccard join, suffix dedup and decontamination against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import components, decontaminate, ngrams, suffixes
from siltstone.llm.components import connected
from tests.llm.conftest import edge, texts, words
from tests.oracle import DATA, assert_same

A = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    """For each row: size of its set and smallest id of its component; a null id is smallest."""
    low = lambda i: -(10**30) if i is None else i
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**30), low(doc_id))
    null = lambda v: None if v == -(10**30) else v
    return [(d, len(sets[i]), null(least[find(i)])) for i, (d, _) in enumerate(rows)]


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("blocks", [24, 0])
def test_jaccard(spark, docs, monkeypatch, blocks):
    monkeypatch.setattr(ngrams, "HOT_BLOCKS", blocks)
    got = ngrams.jaccard_report(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert multiset(got) == multiset(brute_components(texts()))


def hardly_linked(rng):
    """A cluster that shares boilerplate: texts of common and own words, a few of which link."""
    common = words(rng, 60).split(" ")
    rows = []
    for i in range(120):
        w = common[: 20 + i % 40] + words(rng, 2 + i % 30).split(" ")
        rows.append((1000 + i, " ".join(w)))
        if i % 6 == 0:
            w[-1] = "edit"
            rows.append((2000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("span", [4, 1])
def test_jaccard_over_several_blocks(spark, monkeypatch, span):
    monkeypatch.setattr(ngrams, "BLOCK", 4)
    monkeypatch.setattr(ngrams, "SPAN", span)
    monkeypatch.setattr(ngrams, "FEW", 3)
    rows = [r for r in texts() if r[0] is not None and r[0] not in (11,)] + hardly_linked(random.Random(2))
    d = edge(spark, rows).repartition(4)
    found = ngrams.candidates(d)
    assert found.any_wide
    got = ngrams.jaccard_report(d).collect()
    want = brute_components(rows)
    assert multiset(got) == multiset(want)
    got = ngrams.jaccard_links(d).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert multiset(got) == multiset([(*c, n) for c, n in zip(want, brute_links(rows), strict=True)])


def test_cells_that_share_nothing_do_not_meet(spark, monkeypatch):
    """A chain of texts, each of which shares words with the next one only: pairs of cells grow with the chain, not with its square."""
    monkeypatch.setattr(ngrams, "BLOCK", 4)
    monkeypatch.setattr(ngrams, "SPAN", 1)
    rng, pairs = random.Random(4), []
    for n in (60, 120):
        parts = [words(rng, 30) for _ in range(n + 1)]
        d = edge(spark, [(i, f"{parts[i]} {parts[i + 1]}") for i in range(n)])
        monkeypatch.setattr(ngrams, "HEAD", 0.98)
        found = ngrams.candidates(d, percent=30)
        assert found.any_wide
        cells = found.held().select("token", "cell").distinct()
        pairs.append(cells.alias("a").join(cells.alias("b"), "token").where("a.cell < b.cell").select("a.cell", "b.cell").distinct().count())
        assert ngrams.jaccard_report(d, percent=30).agg({"component_id": "max"}).first()[0] == 0
    assert pairs[0] <= 60 and pairs[1] <= 2.5 * pairs[0]


def test_a_long_text_in_pieces(monkeypatch):
    import numpy as np

    raw = ("  " + words(random.Random(1), 3000) + " ").encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    whole = ngrams.shingles(data, off)
    monkeypatch.setattr(ngrams, "PIECE", 100)
    cut = ngrams.shingles(data, off)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    short = np.frombuffer(b"x" * 300 + b" y z" + b" " * 300, np.uint8)
    assert len(ngrams.shingles(short, np.array([0, len(short)]))[0]) == 1


def brute_links(rows):
    """For each row: with how many other rows it links."""
    sets = [shingle_set(t) for _, t in rows]
    linked = lambda a, b: a and 100 * len(a & b) >= 80 * len(a | b)
    return [sum(bool(linked(a, b)) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]


@pytest.mark.parametrize("block", [4, 256])
def test_links_of_each_document(spark, docs, monkeypatch, block):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    got = ngrams.jaccard_links(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    want = [(*c, n) for c, n in zip(brute_components(texts()), brute_links(texts()), strict=True)]
    assert multiset(got) == multiset(want) and sum(r.n_links for r in got) > 100


def test_links_same_as_sql(spark):
    from siltstone.llm import queries

    assert_same(queries.op6_jaccard_links(spark, f"{DATA}/sf0.001"), f"{DATA}/sf0.001", queries.oracle_sql()["op6_jaccard_links"])


def kept_rows(rows):
    """How many rows stay for each group: one of each component, and all rows without words."""
    sets = [shingle_set(t) for _, t in rows]
    comps = brute_classes(rows)
    return sum(not x for x in sets) + len({c for c, x in zip(comps, sets, strict=True) if x})


def brute_classes(rows):
    """The component of each row, as the least index of its rows."""
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_drop_near_duplicates(spark, docs):
    kept = ngrams.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == kept_rows(texts())
    label = dict(zip(texts(), brute_classes(texts()), strict=True))
    used = [label[r] for r in got if shingle_set(r[1])]
    assert len(used) == len(set(used))
    low = lambda i: -1 if i is None else i
    for r in got:
        if shingle_set(r[1]):
            assert low(r[0]) == min(low(i) for (i, t), c in label.items() if c == label[r])


def test_rows_without_id_and_with_repeated_ids_are_not_lost(spark):
    rng = random.Random(8)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    near = a[:150] + "#" + a[151:]
    rows = [(1, a), (5, a), (5, b), (None, near), (None, c), (None, d), (5, b), (None, None), (None, None), (7, "")]
    table = spark.createDataFrame([(i, t, 777, 1, "k") for i, t in rows], "doc_id long, text string, _id int, _H int, _again string")
    got = ngrams.drop_near_duplicates(table)
    assert got.columns == table.columns
    assert multiset((r.doc_id, r.text) for r in got.collect()) == multiset([(None, near), (5, b), (None, c), (None, d), (None, None), (None, None), (7, "")])
    assert {(r._id, r._H, r._again) for r in got.collect()} == {(777, 1, "k")}


def test_jaccard_empty(empty):
    assert ngrams.jaccard_report(empty).count() == 0 and ngrams.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("finish", [0, 2_000_000])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(components, "FINISH", finish)
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if i is not None and first[raw[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("blocks, group, piece", [(32, 200_000, 4 << 20), (0, 200_000, 4 << 20), (32, 2, 4 << 20), (32, 200_000, 300)])
def test_repeats(spark, docs, monkeypatch, blocks, group, piece):
    """Also with all anchors hot, with those of more than two entries hot, and with texts cut into pieces."""
    for name, value in (("HOT_BLOCKS", blocks), ("HOT_GROUP", group), ("PIECE", piece)):
        monkeypatch.setattr(suffixes, name, value)
    got = suffixes.repeats_report(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert multiset(got) == multiset(brute_repeats(texts()))


def removed_in_process(rows, length=50, hot_group=4000):
    """The passes one after another, without Spark: removed positions of each document, by the pass that decided them."""
    import pyarrow as pa

    def sorted_by_fragment(batches):
        return pa.Table.from_batches(batches).sort_by("fragment").combine_chunks().to_batches()

    def positions(batches):
        out = collections.defaultdict(set)
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == suffixes.SPANS:
                    x = memoryview(r["body"]).cast("i").tolist()
                    for a, z in zip(x[::2], x[1::2], strict=True):
                        out[r["doc_id"]] |= set(range(a, z))
        return out

    ids, strings = zip(*rows, strict=True)
    table = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(strings), pa.array([0] * len(ids), pa.int64())], ["doc_id", "text", "tag"])
    settled = list(suffixes._settle(hot_group)(iter(sorted_by_fragment(list(suffixes._entries(3, length)(iter(table.slice(k, 9) for k in range(0, len(rows), 9))))))))
    opened = collections.defaultdict(list)
    for b in settled:
        for r in b.to_pylist():
            if r["kind"] in (suffixes.OPENED, suffixes.HOT):
                opened[r["doc_id"]].append(r["body"])
    text = dict(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(list(opened), pa.int64()), pa.array([0] * len(opened), pa.int64()), pa.array([text[i] for i in opened]), pa.array(list(opened.values()), pa.list_(pa.binary()))], ["doc_id", "tag", "text", "body"])
    spelled = list(suffixes._spell(length)(iter([batch])))
    return positions(settled), positions(suffixes._radix(length)(iter(sorted_by_fragment(spelled))))


def brute_positions(rows, length=50):
    first, out = {}, collections.defaultdict(set)
    for i, t in rows:
        raw = t.encode()
        for p in range(len(raw) - length + 1):
            first[raw[p : p + length]] = min(first.get(raw[p : p + length], i), i)
    for i, t in rows:
        raw = t.encode()
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                out[i] |= set(range(p, p + length))
    return out


@pytest.mark.parametrize("bits, windows", [(64, 1 << 19), (64, 40), (20, 1 << 19), (0, 1 << 19), (0, 500)])
def test_bytes_decide_whatever_the_hashes_say(monkeypatch, bits, windows):
    """Hashes that collide route more together and settle nothing: of anchors only `bits` bits are left, of runs none. So it is with windows taken a few at a time."""
    import numpy as np

    monkeypatch.setattr(suffixes, "WINDOWS", windows)
    plain = suffixes.anchors

    def blunt(data, off, length=50):
        m, u, row, at, n = plain(data, off, length)
        keep = np.uint64(((1 << bits) - 1) << (64 - bits))
        return m & keep, u if bits == 64 else u * np.uint64(0), row, at, n

    monkeypatch.setattr(suffixes, "anchors", blunt)
    rows = [(i, t) for i, t in texts() if i is not None and t is not None and i not in (11, 123) and len(t) < 4000]
    local, radix = removed_in_process(rows)
    want = brute_positions(rows)
    assert {i: local[i] | radix[i] for i in set(local) | set(radix)} == want
    by_digits = sum(len(radix[i] - local[i]) for i in radix)
    assert by_digits > 0.2 * sum(map(len, want.values()))  # the others were compared byte by byte within their blocks of nine


def test_texts_of_a_repeated_id_are_apart(spark):
    rng = random.Random(9)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    edit = a[:150] + "#" + a[151:]
    rows = [(1, a), (5, a), (5, b), (5, b[::-1][: len(a)].ljust(len(a), "z")), (2, c), (7, c + " tail"), (7, d), (7, c[:90] + "!" + c[91:]), (8, edit), (8, "short"), (9, d)]
    got = suffixes.repeats_report(edge(spark, rows).repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert multiset(got) == multiset(brute_repeats(rows))
    assert {b, d} <= {r.text for r in suffixes.remove_repeats(edge(spark, rows)).where("doc_id IN (5, 7)").collect()}


def test_columns_of_any_name(spark):
    shared = "a passage that is long enough to be found in both of these texts"
    rows = [(1, f"first {shared}", 777, 1, 2, "b", 3), (2, f"second {shared} end", 778, 1, 2, "b", 3), (2, "other", 779, 1, 2, "b", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _id int, _TAG int, _twice int, _body string, _key int")
    out = suffixes.remove_repeats(table)
    assert out.columns == table.columns
    assert multiset(out.drop("text").collect()) == multiset(table.drop("text").collect())
    assert {r.text for r in out.collect()} == {f"first {shared}", "second" + " end", "other"}
    bench = spark.createDataFrame([(1, "first a passage")], "item_id long, text string")
    for mode, n in (("document", 2), ("span", 3)):
        clean = decontaminate.decontaminate(table, bench, mode=mode)
        assert clean.columns == table.columns and multiset(clean.drop("text").collect()) <= multiset(table.drop("text").collect()) and clean.count() == n
    with pytest.raises(ValueError):
        decontaminate.hits(table.withColumn("items", F.lit(1)), bench, keep=("items",))


def test_remove_repeats(spark, docs, empty):
    out = suffixes.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("doc_id IN (0, 1, 3)").collect()} == {None, "", "one two"}
    assert all(n == 0 for n in [r.n_removed for r in suffixes.repeats_report(out.where("doc_id <> 11")).collect()])
    assert suffixes.repeats_report(empty).count() == 0 and suffixes.remove_repeats(empty).count() == 0


def test_characters_are_not_cut(spark):
    shared = "é" * 30
    rows = [(1, "ab" + shared), (2, "xyz" + shared + "ñ")]
    assert {r.doc_id: r.text for r in suffixes.remove_repeats(edge(spark, rows)).collect()} == {1: "ab" + shared, 2: "xyz"}


BENCH = [(1, None), (2, ""), (3, "?!"), (4, "one two"), (5, " ".join(f"w{i}" for i in range(14))), (6, "W3 w4 W5 w6 w7 w8 w9 w10 w11 w12"), (7, "日本語 です"), (10, "one two")]


def brute_hits(rows, width=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A))
    windows = collections.defaultdict(set)
    for i, t in BENCH:
        w = cut(t)
        for p in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[p : p + width])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, items = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    items |= windows[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def leaky():
    run = " ".join(f"w{i}" for i in range(14))
    return [*texts(), (200, f"start, {run}; end"), (201, f"w2 {run[6:]} tail"), (202, run.upper() + " " + run), (203, " ".join(f"w{i}" for i in range(9))), (204, "é日本語,です")]


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination(spark, monkeypatch, most):
    """Also with more windows than are broadcast."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    d = edge(spark, leaky()).repartition(3)
    got = decontaminate.digest(decontaminate.hits(d, bench)).collect()
    assert multiset(got) == multiset(brute_hits(leaky()))
    clean = decontaminate.decontaminate(d, bench)
    assert clean.columns == d.columns
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter(i for i, _, n, *_ in brute_hits(leaky()) if not n)
    spans = decontaminate.decontaminate(d, bench, mode="span")
    assert spans.count() == d.count() and spans.columns == d.columns
    assert spans.where("doc_id = 200").first().text == "start; end"
    same = {r.doc_id: r.text for r in spans.where("doc_id IN (0, 1, 5, 10)").collect()}
    assert same == {i: t for i, t in texts() if i in (0, 1, 5, 10)}


def test_decontamination_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(docs, none).where("size(positions) > 0").count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.hits(empty, spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_decontamination_is_native(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    plan = decontaminate.hits(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 10, 100])
def test_what_a_link_may_lack(n):
    import numpy as np

    assert ngrams.missing(np.array([n]))[0] == n - -(-80 * n // 100)


def template_pages(rng, n, share=0.85, size=200):
    """Pages of which a template is the given share, and all else their own."""
    common = words(rng, int(size * share)).split(" ")
    return [(i, " ".join([*common, *words(rng, size - len(common)).split(" ")])) for i in range(n)]


def test_template_pages_do_not_meet(spark, monkeypatch):
    """A template that isn't enough for a link brings no pages together: there are no clusters to compare."""
    monkeypatch.setattr(ngrams, "BLOCK", 4)
    monkeypatch.setattr(ngrams, "SPAN", 1)
    rows = template_pages(random.Random(6), 60)
    rows += [(100 + i, t + " end") for i, t in rows[:5]]  # and some that link
    d = edge(spark, rows).repartition(3)
    assert ngrams.candidates(d).placed.count() == 10
    assert multiset(ngrams.jaccard_report(d).collect()) == multiset(brute_components(rows))


@pytest.mark.parametrize("share", [0.8, 0.88, 0.9])
def test_template_pages_of_many_sizes(spark, monkeypatch, share):
    """Around the share from which pages link: sizes differ, some hold the template strongly and some don't."""
    monkeypatch.setattr(ngrams, "BLOCK", 4)
    monkeypatch.setattr(ngrams, "SPAN", 1)
    monkeypatch.setattr(ngrams, "FEW", 3)
    rng = random.Random(7)
    common = words(rng, 90).split(" ")
    rows = [(i, " ".join([*common[rng.randint(0, 4) :], *words(rng, rng.randint(1, int(2 * 90 * (1 - share) / share))).split(" ")])) for i in range(90)]
    d = edge(spark, rows).repartition(3)
    want = brute_components(rows)
    assert multiset(ngrams.jaccard_report(d).collect()) == multiset(want)
    got = ngrams.jaccard_links(d).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert multiset(got) == multiset([(*c, n) for c, n in zip(want, brute_links(rows), strict=True)])


def test_anchors_of_parts_are_those_of_the_block(monkeypatch):
    """The anchors of a block are found some texts at a time, and are the same."""
    import numpy as np

    raw = [t.encode() for i, t in texts() if t is not None]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = suffixes.anchors(data, off)
    for part in (1, 500, 1 << 30):
        monkeypatch.setattr(suffixes, "PART", part)
        assert all((a == b).all() for a, b in zip(suffixes._anchors_by_parts(data, off, 50), whole, strict=True))


def test_texts_meet_their_open_entries_once(spark, monkeypatch):
    """With hot anchors too, texts are compressed and shuffled twice: to be spelled out and to be cut."""
    sent = []
    plain = suffixes._compressed
    monkeypatch.setattr(suffixes, "_compressed", lambda docs: sent.append(1) or plain(docs))
    monkeypatch.setattr(suffixes, "HOT_GROUP", 3)
    monkeypatch.setattr(suffixes, "_settle", lambda hot_group, settle=suffixes._settle: settle(3))
    rng = random.Random(12)
    shared = words(rng, 40)
    rows = [(i, words(rng, 20) + shared + words(rng, 20)) for i in range(12)] + [(100 + i, t[3:]) for i, t in enumerate([words(rng, 50)] * 2)]
    got = suffixes.repeats_report(edge(spark, rows).repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert multiset(got) == multiset(brute_repeats(rows)) and len(sent) == 2


def test_words_are_tried_one_by_one_in_generated_code(spark, docs):
    """Words that start no window go where they are generated, not in a lambda over all of a document's places."""
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    plan = decontaminate.hits(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "sequence(0, (size(_w" not in plan
