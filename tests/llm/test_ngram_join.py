import random
import re
from collections import defaultdict

import numpy as np
import pytest

from strideframe.llm import ngram_join as join
from strideframe.llm.queries import op6_ngram_join

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, num=85, den=100, n=4):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        own = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}
        sets[doc] = own
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = sorted(sets)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_whole_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert result(op6_ngram_join(spark, small)) == brute(rows)


@pytest.mark.parametrize(("num", "den", "n", "chunk"), [(85, 100, 4, 512), (80, 100, 5, 4), (1, 2, 2, 512)])
def test_near_copies_of_all_sizes(docs, num, den, n, chunk):
    rng = random.Random(num + chunk)
    rows = []
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 14, 16, 18, 22, 40, 90]:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for k in range(7):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + size // 12) if k < 4 else rng.randrange(0, 2 + size // 5)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            if k % 3 == 2:
                copy = copy[: rng.randrange(max(1, size - 3), size + 1)]
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(len(rows) + k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(k))) for k in range(30)]
    assert result(join.link_documents(docs(rows), num=num, den=den, n=n, chunk=chunk)) == brute(rows, num, den, n)


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (5, "A  b\nC"), (4, "a b c"), (6, "a b c d"), (7, "É b c"), (8, "é b c"), (9, "a\x0bb\x0cc"), (10, "x " * 3000), (11, "X " * 9000)]
    got = result(join.link_documents(docs([*rows, (None, "a b c"), (4, "a b c")])))
    expected = brute(rows)
    assert got == expected and got[9] == (1, 4) and got[1] == (0, 1) and got[8] == (1, 8) and got[11] == (1, 10)
    assert join.link_documents(docs([])).count() == 0


def test_an_id_with_two_texts_links_them(docs):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "f g h i j"), (3, "f g h i j")]
    got = {(r["doc_id"], r["component_id"]) for r in join.link_documents(docs(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_one_stays(docs):
    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (9, None), (8, ""), (5, "z"), (5, "z"), (None, "q")]
    kept = join.drop_near_duplicates(docs(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "5", "8", "9", "None"] and kept.columns == ["doc_id", "text", "score", "node", "spans"]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def smallest(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    for plain in (1_000_000, 5):
        found = {r["id"]: r["component"] for r in join.components(spark.createDataFrame(edges, "a long, b long"), plain=plain).collect()}
        assert found == {x: smallest(x) for x in near if smallest(x) != x}
    assert join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 20).astype(np.uint64))))
        x, y = (np.frombuffer(join._sketch(s, join.sketch_bits(len(s))), np.uint8)[None, :] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(join._fold(x, width) ^ join._fold(y, width)).sum() <= len(np.setxor1d(a, b))


def test_the_boundary_is_where_subsets_get_dear():
    assert 6 <= join.choose_boundary(85, 100) <= 20


def parts_meet(rows, items, most):
    """Whether all ids of different subs of a group are in one item, on both sides or in a single one."""
    by = defaultdict(lambda: (set(), set()))
    for item, side, id_ in items:
        by[item][side].add(id_)
    met = set()
    for one, two in by.values():
        met |= {frozenset((a, b)) for a in one for b in (two or one)}
    groups = defaultdict(list)
    for group, sub, id_ in rows:
        groups[group].append((sub, id_))
    return all(frozenset((a, b)) in met for g in groups.values() for x, a in g for y, b in g if x != y)


def test_what_stays_apart_meets(spark):
    rng = random.Random(8)
    rows = [(1, 7, k) for k in range(90)] + [(2, rng.randrange(100, 108), k) for k in range(200, 330)] + [(3, 50, k) for k in range(400, 440)] + [(3, 51, 500)] + [(4, k, k) for k in range(600, 640)]
    found = join.cross_parts(spark.createDataFrame(rows, "group long, sub long, id long"), 8).collect()
    items = [(r["item"], r["side"], r["id"]) for r in found]
    assert parts_meet(rows, items, 8)
    assert not any(id_ < 90 for *_, id_ in items)  # a group of one sub has no work
    assert sum(400 <= id_ <= 500 for *_, id_ in items) < 60  # one sub and a single id: in proportion to the group


def test_work_grows_with_a_group_of_near_copies(docs, spark, monkeypatch):
    """3,000 near copies of one text: rows that are compared, and pairs of parts, in proportion to them."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    made = {}
    for size in (600, 3000):
        rows = []
        for k in range(size):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"v{k}"
            rows.append((k, " ".join(copy)))
        rows += [(size + k, " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))) for k in range(50)]
        counted = []
        def stage(df, name, real=join.stage, counted=counted):
            out = real(df, name)
            if name in ("cross", "items", "dealt", "likely", "across", "large"):
                counted.append((name, out.count()))
            return out

        monkeypatch.setattr(join, "stage", stage)
        got = result(join.link_documents(docs(rows)))
        monkeypatch.undo()
        assert all(got[k][1] == 0 for k in range(size)) and all(got[size + k][1] == size + k for k in range(50))
        made[size] = sum(n for _, n in counted)
    assert made[3000] < 7 * made[600]


def test_both_ways_of_reading_again_agree(docs):
    rng = random.Random(10)
    rows = [(k, " ".join(f"w{j if rng.random() < 0.97 else rng.randrange(10**6)}" for j in range(50 * (k % 5), 50 * (k % 5) + 40))) for k in range(120)]
    one = result(join.link_documents(docs(rows), broadcast_ids=0, chunk=8))
    assert one == result(join.link_documents(docs(rows))) == brute(rows)


def test_both_ways_of_dropping_agree(docs):
    rng = random.Random(11)
    rows = [(k % 90, " ".join(f"w{j if rng.random() < 0.97 else rng.randrange(10**6)}" for j in range(50 * (k % 5), 50 * (k % 5) + 40))) for k in range(120)]
    rows += [rows[3], rows[4], (None, rows[5][1]), (200, None), (200, "")]
    kept = lambda **options: sorted((str(r["doc_id"]), r["text"] or "") for r in join.drop_near_duplicates(docs(rows), **options).collect())
    assert kept(broadcast_ids=0) == kept() and len(kept()) < len(rows)


def test_rows_that_repeat_give_a_row_each(docs):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (6, None), (6, None), (7, "a b c d e")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join.link_documents(docs(rows)).collect())
    assert got == [(5, 2, 5)] * 3 + [(6, 0, 6)] * 2 + [(7, 2, 5)]


def test_texts_of_repeated_ids_are_judged_each(docs):
    one, two = "a b c d e f g", "h i j k l m n"
    kept = join.drop_near_duplicates(docs([(1, one), (2, one), (2, two)]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, one), (2, two)]
    kept = join.drop_near_duplicates(docs([(None, one), (None, one), (3, one), (None, two), (None, two), (4, ""), (4, "")]))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("3", one), ("4", ""), ("4", ""), ("None", one), ("None", one), ("None", two), ("None", two)]
