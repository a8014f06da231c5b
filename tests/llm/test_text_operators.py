import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strideframe.llm import chat, decontamination, langid, licenses, queries, secrets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute_hits(documents, items, n=13):
    windows = defaultdict(set)
    for item, text in items:
        own = words(text)
        size = min(n, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            windows[tuple(own[k : k + size])].add(str(item))
    out = []
    for doc, text in documents:
        own = words(text)
        hit, found = [False] * len(own), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if (w := tuple(own[k : k + size])) in windows:
                    found |= windows[w]
                    hit[k : k + size] = [True] * size
        out.append((doc, len(own), sum(hit), sorted(found)))
    return sorted(out, key=str)


def test_benchmark_of_whole_tables(spark, small):
    documents, items = ([(r[0], r["text"]) for r in spark.read.parquet(f"{small}/{n}.parquet").collect()] for n in ("documents", "benchmark"))
    found = {r["doc_id"]: r for r in queries.op8_decontamination(spark, small).collect()}
    for doc, n, hit, own in brute_hits(documents, items):
        r = found[doc]
        assert tuple(r)[1:4] == (n, hit, len(own)) and r["items_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest() and r["contaminated"] == (hit > 0 and 20 * hit >= n)


ITEMS_WITHOUT_ID = [(None, "two three"), (None, "one two three"), (1, "two three")]
ITEMS = [(1, "one two three"), (2, "Two, three"), (10, "ä b c d e f g h i j k l m n o"), (11, None), (12, "!!"), (2, "two three")]
TEXTS = [(1, "zero one TWO three two_three"), (2, None), (3, ""), (4, "ä b c d e f g h i j k l m n"), (5, "b c d e f g h i j k l m"), (6, "two three " * 30), (6, "two three " * 30), (None, "two"), (7, "x " * 500 + "two three")]


def test_benchmark_of_odd_rows(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for shard in (2_000_000, 3):
        got = decontamination.benchmark_hits(docs(TEXTS), bench, shard_words=shard)
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=str) == brute_hits(TEXTS, ITEMS)
    clean = decontamination.remove_contaminated(docs(TEXTS), bench)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["2", "3", "5", "7", "None"] and clean.columns == docs([]).columns
    assert decontamination.remove_contaminated(docs(TEXTS), bench.limit(0)).count() == len(TEXTS)
    assert decontamination.benchmark_hits(docs([]), bench).count() == 0


def test_items_without_an_id_hit_and_are_one_null(spark, docs):
    bench = spark.createDataFrame(ITEMS_WITHOUT_ID, "item_id long, text string")
    for shard in (2_000_000, 3):
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.benchmark_hits(docs([(1, "one two three"), (2, "two")]), bench, shard_words=shard).collect()}
        assert got == {1: (3, [None, "1"]), 2: (0, [])}


def test_one_shard_at_a_time(spark, docs):
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(5)], "item_id long, text string")
    out = decontamination.benchmark_hits(docs([(1, "a1 b1 c1 a4 b4 c4")]), bench, shard_words=3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the others are written
    assert out.first()["items"] == ["1", "4"]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_secrets_of_the_whole_table(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op7_secrets(spark, small).collect():
        own = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for k, *_ in own) for n in ("assign", "access", "hex")]


def test_secrets_of_odd_rows(docs):
    texts = ["", None, "É" * 5 + " toKEN='abcdefgh' Password: x api_key=12345678 toſen=abcdefgh", "AKIA" + "Z" * 12 + " AKIA" + "Z" * 11, "0" * 31 + " " + "a" * 33 + "secret:" + "f" * 40, "ſecret=abcdefghij passwd ==x"]
    got = secrets.scan_secrets(docs(enumerate(texts))).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert [(s["kind"], s["start"], s["end"]) for s in r["secret_spans"]] == brute_spans(text or "")
    assert secrets.scan_secrets(docs([])).count() == 0


def test_weak_parts_count_together_only():
    key = "aB3dE5gH7jK9mN1pQ3sT5"
    alone, pair, far = f"use {key} now", f"client_id=acme host=db.example.org key {key}", f"client_id=acme host=db.example.org {'x ' * 400} {key}"
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.scan_text(t)]
    assert kinds(alone) == [] and kinds(pair) == ["id_part", "secret_part"] and kinds(far) == []
    assert kinds(f"AKIA{'A' * 16} at https://x.example.org/ and {key}") == ["access", "secret_part"]
    assert kinds("login=joe mail joe@example.org") == []


def test_masks(docs):
    rows = [(1, "token=abcdefgh12 x"), (2, None), (3, "plain"), (4, "secret:" + "f" * 40)]
    got = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs(rows)).collect()}
    assert got == {1: "[SECRET] x", 2: None, 3: "plain", 4: "[SECRET]"}


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", "<|im_end|>\\|<\\|"), (1, 1, "assistant", "a\\<|im_start|>"), (1, 1, "assistant", None), (1, 2, "user", "tail"), (2, 0, "user", "only"), (3, 0, None, "x"), (None, 5, "assistant", "é😀"), (3, 0, None, "x")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.chat_examples(frame)).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
    first = chat.chat_examples(frame).where("conv_id = 1").orderBy("example").collect()
    assert [e["n_turns"] for e in first] == [2, 3, 4] and [e["loss_end"] - e["loss_start"] for e in first] == [0, len(chat.escape("a\\<|im_start|>")), 0]
    assert all(e["text"].count("<|im_start|>") == e["n_turns"] for e in first)
    assert chat.read_back(chat.chat_examples(frame.limit(0))).count() == 0


def test_roles_with_line_breaks_and_escapes(spark):
    turns = [("us\ner", "hi"), ("a\\nb", "x\\ny\nz"), ("\n", ""), ("assistant", "\\n<|im_end|>\n")]
    frame = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    examples = chat.chat_examples(frame).collect()
    assert chat.parse_turns(examples[-1]["text"]) == turns
    whole = chat.read_back(chat.chat_examples(frame)).first()
    assert whole["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest() and whole["loss_chars"] == len(turns[-1][1])


def test_chat_of_the_whole_table_matches_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    twin = con.sql(queries.OP9_SQL)
    ours = queries.op9_chat(spark, small)
    assert sorted(map(tuple, ours.select(twin.columns).collect())) == sorted(twin.fetchall())


def test_language_of_held_out_rows(spark, small):
    documents = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op10_language(spark, small).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in out) >= 0.97 * len(out)


def grams_of(text, n=4):
    """Plainly: n-grams of letters with blanks at borders only; a text of short words as a whole."""
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
    joined = " " + " ".join(letters.split()) + " "
    if not letters.strip():
        return []
    found = [joined[k : k + n] for k in range(len(joined) - n + 1)]
    return [g for g in found if " " not in g[1:-1]] or [joined]


def test_language_filter_is_near_exact_sets(spark, small):
    """Exact sets of n-grams, made plainly, against the bit-sliced filter with its correction, also when the filter is crowded."""
    rows = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r["text"] is not None]
    counts = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts[r["lang"]].update(grams_of(r["text"]))
    rate = {lang: {g: k / sum(c.values()) for g, k in c.items()} for lang, c in counts.items()}
    most = defaultdict(float)
    for c in rate.values():
        for g, x in c.items():
            most[g] = max(most[g], x)
    kept = {lang: {g for g, x in c.items() if x >= 0.2 * most[g]} for lang, c in rate.items()}
    train = spark.read.parquet(f"{small}/documents.parquet").where(~langid.held_out())
    model = langid.fit(train, sample=10**9)
    made = langid.Grams(4)
    own = {lang: np.unique(np.concatenate([made.of(r["text"]) for r in rows if r["lang"] == lang])) for lang in kept}
    crowded = langid.LanguageFilter.build(own, 2, 2)
    assert model.languages == sorted(kept) and crowded.passes.max() > 0.01
    for r in rows:
        found = grams_of(r["text"])
        if not found:
            continue
        exact = {lang: sum(g in kept[lang] for g in found) / len(found) for lang in kept}
        lang, score = model.predict(made.of(r["text"]))
        assert len(made.of(r["text"])) == len(found) and exact[lang] >= max(exact.values()) - 0.02
        if len(set(found)) >= 200:  # a false positive counts as often as its n-gram occurs
            assert abs(score - exact[lang]) < 0.02
            hashes = made.of(r["text"])
            true = np.array([np.isin(hashes, own[x]).mean() for x in crowded.languages])
            assert np.abs(crowded.shares(hashes) - true).max() < 0.2


def test_texts_of_no_language_are_rejected_and_others_stay(spark, docs, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(table.where(~langid.held_out()))
    rng = random.Random(2)
    noise = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(n))
    bad = ["Съешь ещё этих мягких французских булок, да выпей чаю. " * k for k in (1, 50)] + [noise(30), noise(3000), "漢字仮名交じり文を書くのは難しいことではない" * 5, None, "12 34"]
    clean = [r["text"] for r in table.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    got = langid.identify(docs(enumerate(bad + clean)), model).select("doc_id", langid.is_rejected(0.35).alias("gone")).collect()
    assert {r["doc_id"] for r in got if r["gone"]} == set(range(len(bad)))


def test_languages_of_any_number(spark):
    rows = [(i, chr(0x4E00 + i) * 20, f"l{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert [r["lang_pred"] for r in langid.identify(frame, model).orderBy("doc_id").collect()] == [r[2] for r in rows]
    with pytest.raises(ValueError, match="more than 100 languages"):
        langid.fit(frame, most_languages=100)


def test_language_of_odd_rows(spark, docs, small):
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "123 !! \n"), (4, "der und die"), (4, "der und die"), (None, "é"), (5, "the and of " * 5000)]
    got = langid.identify(docs(rows), model).collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, False, False, False, False]
    assert langid.identify(docs([]), model).count() == 0
    none = langid.fit(spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in langid.identify(docs(rows), none).collect()] == ["und"] * len(rows)


def test_licenses_of_odd_rows(docs):
    mit, apache = "Released under the MIT License.", "licensed under the apache license version 2.0"
    rows = [(1, None), (2, ""), (3, f"Text here. {mit} More text follows, at length."), (4, f"{mit}\n{mit}\n{apache}"), (5, "license"), (6, "released under the license of others entirely"), (3, mit), (7, "x " * 20_000 + "\n" + apache)]
    got = sorted((r["doc_id"], r["license"], r["n_units"]) for r in licenses.scan_licenses(docs(rows)).collect())
    assert [g[:2] for g in got] == [(3, "MIT"), (3, "MIT"), (4, "Apache-2.0"), (4, "MIT"), (7, "Apache-2.0")]
    assert licenses.scan_licenses(docs([])).count() == 0


def test_licenses_match_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    twin = con.sql(queries.OP4_SQL)
    assert sorted(map(tuple, queries.op4_licenses(spark, small).select(twin.columns).collect())) == sorted(twin.fetchall())


def test_anchors_miss_no_unit_that_could_pass():
    found = licenses.anchors(licenses.TEMPLATES, 0.8)
    for _, text in licenses.TEMPLATES:
        grams = licenses.bigrams_of(text)
        need = math.ceil(len(grams) * 0.8 / 1.2 - 1e-9)
        without = set(grams) - set(found)
        assert len(without) < need
