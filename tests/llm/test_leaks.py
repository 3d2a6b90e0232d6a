"""Problem 7: exact runs against brute force, recall with edits, and both ways of joining."""

from __future__ import annotations

import random

import numpy as np

from sonarmill.llm import leaks, words


def _texts(seed, n_docs=60, n_items=12):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(20, 60)))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        body = [draw.choice(vocabulary) for _ in range(draw.randrange(5, 120))]
        if draw.random() < 0.6:
            source = draw.choice(items)[1].split()
            n = draw.choice([10, 11, 12, 13, 20])
            start = draw.randrange(0, len(source) - min(n, len(source)) + 1)
            body[len(body) // 2 : len(body) // 2] = source[start : start + n]
        docs.append((i, " ".join(w.upper() if draw.random() < 0.2 else w for w in body)))
    return docs + [(900, None), (901, ""), (902, docs[0][1]), (902, docs[0][1]), (None, docs[0][1])], items + [(50, None), (51, "w1 w2"), (52, items[0][1])]


def _brute(docs, items, window=12):
    runs = lambda t: {tuple(w[i : i + window]) for w in [words.words(t)] for i in range(len(w) - window + 1)}
    held = [(k, runs(t)) for k, t in items if t]
    return sorted({(d, k) for d, t in docs if t and d is not None for k, r in held if runs(t) & r})


def test_words():
    assert words.words("Ｃａｆé  naïve­ly a​b “x_y” ½ İ") == ["cafe", "naively", "ab", "x", "y", "1", "2", "i"]
    assert words.words(None) == [] and words.words("...") == []
    for text in ("Ａ½ é", "été Größe ИЙ й ﬁn", "İstanbul naïve x\u200by", "e\u0301a ℃ ㎏ ª"):  # word by word or as a whole
        assert words.words(text) == words._WORD.findall(words.normal(text))


def test_runs_of_twelve_words_against_brute_force(spark):
    docs, items = _texts(3)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumnRenamed("text", "text")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    expected = _brute(docs, items)
    assert len(expected) > 10
    for chars in (leaks.ITEM_CHARS, 10):  # broadcast, and joined by a shuffle
        got = leaks.found_passages(d, i, item_chars=chars).select("doc_id", "item_id").distinct().collect()
        assert sorted(tuple(r) for r in got) == expected
    assert leaks.found_passages(d.where("false"), i).count() == 0 and leaks.found_passages(d, i.where("false")).count() == 0


def test_given_documents_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/eval_items.parquet").select("item_id", "text").collect()]
    from sonarmill.llm.leaks_queries import p7_found

    assert sorted(tuple(r) for r in p7_found(spark, folder).collect()) == _brute(docs, items)


def _exact(docs, items, window=12):
    """All places within one word edit, without LSH: every pair of windows that share an intact half is compared."""
    half = window // 2
    held = {}
    texts = {k: words.words(t) for k, t in items}
    for k, w in texts.items():
        for q in range(len(w) - half + 1):
            held.setdefault(tuple(w[q : q + half]), []).append((k, q))
    out = set()
    for d, text in docs:
        w = words.words(text)
        tried = set()
        for p in range(len(w) - half + 1):
            for k, q in held.get(tuple(w[p : p + half]), ()):
                for part in (0, half):
                    tried.update((k, p - part + moved, q - part) for moved in (-1, 0, 1))
        for k, at, start in tried:
            if at >= 0 and 0 <= start <= len(texts[k]) - window and at < len(w) - window + 2 and leaks.edit_distance(texts[k][start : start + window], w[at : at + window + 1] + [""], 1, True) <= 1:
                out.add((d, k, at, start))
    return out


def test_recall_on_the_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    d, i = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "eval_items"))
    expected = _exact([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in i.select("item_id", "text").collect()])
    found = {tuple(r)[:4] for r in leaks.found_passages(d, i, edits=1, free_end=True).collect()}
    pairs = lambda places: {p[:2] for p in places}
    assert found <= expected and len(found) >= 0.95 * len(expected) > 1000
    assert len(pairs(found)) >= 0.99 * len(pairs(expected)) > 100


def test_recall_with_an_edit(spark):
    draw = random.Random(5)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(12))) for i in range(300)]
    docs = []
    for i, text in items:
        body = text.split()
        at, kind = draw.randrange(1, 11), draw.randrange(3)
        if kind == 0:
            body[at] = "other"
        elif kind == 1:
            body.insert(at, "other")
        else:
            del body[at]
        docs.append((i, " ".join(["before"] * 3 + body + ["after"] * 3)))
    met = leaks.found_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), edits=2)
    pairs = {tuple(r) for r in met.select("doc_id", "item_id").distinct().collect()}
    assert pairs <= {(i, i) for i in range(300)} and len(pairs) >= 0.93 * 300
    for r in met.collect():
        a, b = docs[r["doc_id"]][1].split()[r["doc_start"] :][:12], items[r["item_id"]][1].split()[r["item_start"] :][:12]
        assert leaks.edit_distance(a, b, 2) == r["edits"] <= 2


def _leaked(draw, i):
    """An item, and documents that hold it with a word more or less in every eleven, or but for one word at their end."""
    item = [f"v{draw.randrange(3000)}" for _ in range(21)]
    return " ".join(item), [
        ["before"] * 3 + item[:10] + ["other"] + item[10:20] + ["after"] * 3,
        ["before"] * 3 + item[:10] + item[11:] + ["after"] * 3,
        item[:10] + item[11:],  # nothing before or after it
    ]


def test_words_inserted_and_dropped_in_the_middle(spark, tmp_path):
    from sonarmill.llm import leaks_queries

    draw = random.Random(7)
    texts = [_leaked(draw, i) for i in range(100)]
    items = [(i, "set", text) for i, (text, _) in enumerate(texts)]
    docs = [(3 * i + k, " ".join(body)) for i, (_, bodies) in enumerate(texts) for k, body in enumerate(bodies)]
    spark.createDataFrame(items, "item_id bigint, test_set string, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = leaks_queries.p7_leaks(spark, str(tmp_path)).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs <= {(d, d // 3) for d, _ in docs} and {r["least_edits"] for r in got} == {1}
    for k in range(3):
        assert sum(d % 3 == k for d, _ in pairs) >= 0.95 * 100
    d, i = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "eval_items"))
    met = [sorted(tuple(r) for r in leaks.found_passages(d, i, edits=1, item_chars=chars, free_end=True).collect()) for chars in (leaks.ITEM_CHARS, 10)]
    assert met[0] == met[1] and {r[:2] for r in met[0]} == pairs


def test_free_end():
    a = list("abcdef")
    assert leaks.edit_distance(a, list("abcxdefg"), 1, True) == 1  # inserted
    assert leaks.edit_distance(a, list("abdefg"), 1, True) == 1 and leaks.edit_distance(a, list("abdefg"), 1) == 2  # dropped
    assert leaks.edit_distance(a, list("abcdefg"), 1, True) == 0 and leaks.edit_distance(a, list("abcde"), 1, True) == 1
    assert leaks.edit_distance(a, list("abxdyf"), 1, True) == 2


def test_edit_distances_of_many():
    draw = np.random.default_rng(4)
    a, b = draw.integers(0, 4, (400, 6)), draw.integers(0, 4, (400, 7))
    b[:200, :6] = a[:200]
    for i in range(200):  # a word replaced, inserted or dropped in half of them
        at = i % 7
        b[i] = np.insert(np.delete(np.append(b[i], 9), [at] if i % 3 else []), at, 8 if i % 3 != 2 else 7)[:7] if i % 4 else np.delete(np.append(b[i], 5), at)
    for free_end, right, most in ((True, b, 9), (True, b, 1), (False, b[:, :6], 9), (False, b[:, :6], 1)):
        assert leaks.edit_distances(a, right, most, free_end).tolist() == [min(most + 1, leaks.edit_distance(x, y, most, free_end)) for x, y in zip(a.tolist(), right.tolist(), strict=True)]


def test_edit_distance_and_tables():
    assert leaks.edit_distance(list("abcd"), list("abcd"), 1) == 0
    assert leaks.edit_distance(list("abcd"), list("abxd"), 1) == 1
    assert leaks.edit_distance(list("abcd"), list("bcda"), 1) == 2
    assert leaks.edit_distance(list("kitten"), list("sitting"), 3) == 3
    assert leaks.tables_for(0.95, 0) == 1 and 1 < leaks.tables_for(0.9, 1) <= leaks.tables_for(0.99, 1)


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "x y " * 250_000 + "a b c d e f g h i j k l")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, "A, b; c d e f g h i j k l!")], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.found_passages(docs, items).select("doc_id", "item_id", "doc_start").collect()] == [(1, 5, 500_000)]
