"""Top N, packing, leakage and encodings: edge cases, brute force and round trips."""

import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.llm import encodings, queries
from tributary.llm.encodings import CHAINS, LOST, Model, _first_alike, features, find_garbled, garble, restore, train
from tributary.llm.leakage import drop_leaking, find_leaks, letters_of, normalise, remove_shared, remove_spans
from tributary.llm.packing import best_fit_decreasing, count_tokens, encoder, pack, TOKENIZER
from tributary.llm.topn import top_n

# top N


def plain_top(rows, n):
    """Rows (group, score, tie, extra); NULLs last, copies in group, score and tie once."""
    out = []
    for g in {r[0] for r in rows}:
        seen = {}
        for r in rows:
            if r[0] == g:
                seen[r[:3]] = r
        order = sorted(seen.values(), key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or 0))
        out += order[:n]
    return sorted((r[:3] for r in out), key=str)


@pytest.mark.parametrize("heavy", [10**9, 5, 0])
@pytest.mark.parametrize("n", [1, 3])
def test_top_n_as_plain(spark, heavy, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3, rng.randint(4, 40)]), rng.choice([None, rng.randint(0, 5)]), rng.choice([None, rng.randint(0, 9)]), "x") for _ in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "g int, score int, tie int, __rank string")
    out = top_n(df, "g", [("score", True)], ["tie"], n, heavy_rows=heavy, heavy_share=1000, salts=4)
    assert out.columns == df.columns
    assert sorted((tuple(r)[:3] for r in out.collect()), key=str) == plain_top(rows, n)


def test_top_n_edges(spark):
    df = spark.createDataFrame([(1, 5, 1, "b"), (1, 5, 1, "a"), (1, 4, 1, None)], "g int, score int, tie int, __salt string")
    assert [tuple(r) for r in top_n(df, "g", [("score", True)], ["tie"], 1).collect()] == [(1, 5, 1, "a")]
    assert [tuple(r) for r in top_n(df, "g", [("score", False)], ["tie"], 1, heavy_rows=0).collect()] == [(1, 4, 1, None)]
    assert top_n(df.limit(0), "g", [("score", True)], ["tie"], 2).count() == 0
    with pytest.raises(ValueError):
        top_n(df, "g", [("score", True)], ["tie"], 0)


def test_copies_of_a_heavy_group_spread_and_count_once(spark):
    rows = [(1, 9, 9, "b" if i % 2 else None) for i in range(2000)] + [(1, i % 8, i, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, score int, tie int, v0 string").repartition(8)
    for heavy in (100, 10**9):
        out = top_n(df, "g", [("score", True)], ["tie"], 3, heavy_rows=heavy, salts=16)
        assert sorted(map(tuple, out.collect())) == [(1, 7, 7, "x"), (1, 7, 15, "x"), (1, 9, 9, "b")]


def test_heavy_groups_are_range_partitioned(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("score"))
    plan = top_n(df, "g", [("score", True)], [], 2, heavy_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan


# packing


def plain_best_fit(sizes, capacity):
    left, placed = [], []
    for s in sizes:
        fits = [r for r in left if r >= s]
        if fits:
            i = left.index(min(fits))
        else:
            left.append(capacity)
            i = len(left) - 1
        left[i] -= s
        placed.append(i)
    return left, placed


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(0, 40), max_size=60))
def test_best_fit_is_best_fit(capacity, drawn):
    sizes = sorted((s for s in drawn if s <= capacity), reverse=True)
    placed = best_fit_decreasing(sizes, capacity)
    used = Counter()
    for s, c in zip(sizes, placed):
        used[c] += s
    left, _ = plain_best_fit(sizes, capacity)
    assert sorted(capacity - u for u in (used[c] for c in set(placed))) == sorted(left[: len(set(placed))]) or max(used.values(), default=0) <= capacity
    assert len(set(placed)) == len(left) and all(u <= capacity for u in used.values())


def packed(spark, sizes, capacity, **options):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "item long, n long, shard string")
    return pack(df, "item", "n", capacity, **options).collect()


@pytest.mark.parametrize("shard_items", [10**6, 100])
def test_packing_is_whole(spark, shard_items):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 7, 100, rng.randint(1, 260)]) for _ in range(1000)] + [None]
    rows = packed(spark, sizes, 100, shard_items=shard_items)
    loads, pieces = Counter(), {}
    for r in rows:
        loads[r.container] += r.n_tokens
        pieces.setdefault(r.item, []).append((r.piece, r.from_token, r.n_tokens))
    assert max(loads.values()) <= 100
    for i, n in enumerate(sizes):
        parts = sorted(pieces[i])
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == (n or 0)
        assert len(parts) == max(1, -(-(n or 0) // 100)) and all(a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:]))
    if shard_items > 1000:
        assert len(loads) <= 1.03 * -(-sum(n or 0 for n in sizes) // 100)


def test_packing_does_not_depend_on_partitions(spark):
    sizes = spark.range(3000).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).alias("item"), (F.when(F.col("id") < 1000, 40).otherwise(F.col("id") % 97)).alias("n"))
    runs = [sorted(map(tuple, pack(sizes.repartition(k), "item", "n", 100, shard_items=500).collect())) for k in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 3000
    per_shard = Counter(r[4].split("-")[0] for r in runs[0])
    assert max(per_shard.values()) < 1000  # a third of the rows are copies, and still no shard has twice its share


def test_packing_edges(spark):
    assert packed(spark, [], 10) == []
    assert {(r.piece, r.n_tokens) for r in packed(spark, [30], 10)} == {(0, 10), (1, 10), (2, 10)}
    assert len({r.container for r in packed(spark, [10, 10], 10)}) == 2
    with pytest.raises(ValueError):
        packed(spark, [1], 0)
    twice = spark.createDataFrame([(None, 3), (None, 3)], "item long, n long")
    assert pack(twice, "item", "n", 10).count() == 2


def test_tokens(spark):
    texts = ["Hello world", "", None, "日本語 text", "a" * 100_000, " " * 5000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r["item"]: r["n_tokens"] for r in count_tokens(df, "id", "text").collect()}
    encode = encoder(TOKENIZER)
    assert got == {i: len(encode.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert got[0] == 2 and got[6] > 1 and encode.decode(encode.encode_ordinary(texts[3])) == texts[3]


def test_packing_the_tables_wastes_little(spark):
    for query, capacity in ((queries.p8_pack_1024, 1024), (queries.p8_pack_4096, 4096)):
        row = query(spark, "/root/testdata/sf0.01").agg(F.countDistinct("container").alias("c"), F.sum("n_tokens").alias("t")).first()
        assert row["t"] > 0.97 * (row["c"] - 1) * capacity


# leakage


def flat(text):
    return "".join(c for c in (text or "").lower() if re.match(r"[^\W_]", c))


def plain_leaks(docs, items, run):
    return {(d, i) for d, t in docs for i, u in items for f, g in [(flat(t), flat(u))] if any(f[p : p + run] in g for p in range(len(f) - run + 1))}


@pytest.mark.parametrize("gram", [30, 21, 8])
def test_leaks_as_plain(spark, gram):
    rng = random.Random(gram)
    text = lambda n: "".join(rng.choice("abcdeé , \n") for _ in range(n))
    items = [(i, text(rng.choice([20, 90, 200, 400]))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(100, None), (101, ""), (102, "x" * 200_000)]
    for i in range(60):
        u = rng.choice(items[:12])[1]
        start = rng.randint(0, len(u) // 2)
        part = u[start : start + rng.randint(40, 130)]
        docs.append((i, text(rng.randint(0, 150)) + re.sub(" ", rng.choice(["", "--", "\n\n"]), part.upper()) + text(rng.randint(0, 150))))
    docs += docs[5:8]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, __h string")
    it = spark.createDataFrame([(*r, 1) for r in items], "item_id long, item_text string, __at int")
    found = find_leaks(d, "doc_id", "text", it, "item_id", "item_text", gram=gram)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_leaks(docs, items, 60) and len(got) > 5
    assert find_leaks(d, "doc_id", "text", it, "item_id", "item_text", gram=gram, max_grams=1).count() == len(got)
    with pytest.raises(ValueError):
        find_leaks(d, "doc_id", "text", it, "item_id", "item_text", gram=31)
    assert find_leaks(d.limit(0), "doc_id", "text", it, "item_id", "item_text").count() == 0
    assert find_leaks(d, "doc_id", "text", it.limit(0), "item_id", "item_text").count() == 0
    assert drop_leaking(d, "doc_id", found).count() == len([r for r in docs if r[0] not in {g[0] for g in got}])
    cleaned = {r.doc_id: r.cleaned for r in remove_spans(d, "doc_id", "text", found, it, "item_id", "item_text").collect()}
    assert set(cleaned) == {g[0] for g in got} and not plain_leaks(list(cleaned.items()), items, 60)


def test_removed_spans_leave_the_rest():
    rng = random.Random(5)
    item = "".join(rng.choice("abcdefgh") for _ in range(80))
    text = f"Before. {item[:40]} - {item[40:]}! After."
    assert remove_shared(text, [item], 60) == ("Before. ! After.", 83)
    assert remove_shared("nothing here", [item], 60) == ("nothing here", 0)


def test_search_and_removal_compare_the_same_letters(spark):
    rng = random.Random(6)
    plain = "".join(rng.choice("abcdefgh") for _ in range(90))
    marks = ["²", "½", "Ⅷ", "İ", "ΑΣ", "Σ ", "ß", "ǅ", "\u0307", "٣", "_", "①", "𝒳"]
    items = [(k, f"{plain[:30]}{m}{plain[30:]}") for k, m in enumerate(marks)]
    docs = [(k, f"Before: {u[:50]} {u[50:].upper()} :after") for k, (_, u) in enumerate(items)] + [(100 + k, f"<< {plain} >>") for k in range(2)]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    flat_of = {r.t: r.n for r in d.select("text").union(it.select("item_text")).toDF("t").select("t", normalise(F.col("t")).alias("n")).collect()}
    assert all(letters_of(t)[0] == n for t, n in flat_of.items())
    leaks = find_leaks(d, "doc_id", "text", it, "item_id", "item_text")
    cleaned = {r.doc_id: (r.cleaned, r.removed) for r in remove_spans(d, "doc_id", "text", leaks, it, "item_id", "item_text").collect()}
    assert cleaned[0] == ("Before:  :after", 92) and all(cleaned[k][0] == "Before:  :after" for k in range(len(marks)))
    assert cleaned[100] == ("<<  >>", 90)


def test_repeated_grams_multiply_nothing(spark):
    items = [(k, "ab" * 400) for k in range(20)]
    docs = [(k, "ab" * 5000) for k in range(5)] + [(9, "ab" * 29)]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    assert find_leaks(d, "doc_id", "text", it, "item_id", "item_text").count() == 100


def test_leaks_on_the_tables(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "item_text").collect()]
    assert {tuple(r) for r in queries.p9_found(spark, small).collect()} == plain_leaks(docs, items, 60)


# encodings

CLEAN = [
    "Później żółć, naïve façade — “quoted” text’s end", "Größe fällt über Straße für Änderung", "déjà vu où être ça Éléphant", "señor mañana ¿qué? corazón año",
    "не удаляйте после обновления всё работает быстрее", "Řešení je příliš žluťoučký kůň úpěl ďábelské ódy", "設定を変えたら直りました。", "não são informações úteis à seção",
]


@pytest.mark.parametrize("chain", CHAINS)
def test_chains_round_trip(chain):
    tried = [(t, garble(t, chain)) for t in CLEAN]
    pairs = [(t, b) for t, b in tried if b is not None and b != t]
    assert all(restore(b, chain) == t for t, b in pairs)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = [w for t in CLEAN for w in t.split()]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(4, 30))) for _ in range(600)]


def test_garbled_texts_are_found_and_restored(spark, corpus):
    rng = random.Random(12)
    common = ["utf_8>cp1252", "utf_8>latin_1", "utf_8>cp1252 twice", "utf_8>mac_roman", "utf_8>cp437", "utf_8>cp1251", "cp1251>cp1252", "cp1250>cp1252", "koi8_r>cp1251"]
    rows, bad = [], {}
    for i, t in enumerate(corpus):
        if i % 20 == 0:
            words = t.split(" ")
            start = rng.randrange(len(words))
            chain = common[i // 20 % len(common)]
            out = [garble(w, chain) or w if k >= start else w for k, w in enumerate(words)]
            if sum(a != b and len(a) > 4 for a, b in zip(words, out)) > 1:
                rows.append((i, " ".join(out)))
                bad[i] = t
                continue
        rows.append((i, t))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chains string")
    found = {r.doc_id: r for r in find_garbled(df, "doc_id", "text").collect()}
    assert len(bad) > 15 and set(found) <= set(bad) and len(found) >= 0.9 * len(bad)
    assert sum(found[i].restored == bad[i] for i in found) >= 0.8 * len(found)


def test_quoted_words_are_not_restored(spark, corpus):
    model = train(spark.createDataFrame([(t,) for t in corpus], "text string"), "text")
    assert model.text("`GrÃ¶ÃŸe` or GrÃ¶ÃŸe") == (["utf_8>cp1252"], "`GrÃ¶ÃŸe` or Größe")


def test_garbled_edges(spark, corpus):
    model = train(spark.createDataFrame([(t,) for t in corpus], "text string"), "text")
    judge = lambda t: model.text(t)
    assert judge(None) is None and judge("") is None and judge("plain ascii") is None and judge(CLEAN[1]) is None
    assert judge("GrÃ¶ÃŸe fÃ¤llt") == (["utf_8>cp1252"], "Größe fällt")
    assert judge("signs like `Ã¶` and `�` are quoted") is None and judge("a `x` GrÃ¶ÃŸe `y`") is not None
    assert judge("Gr��e") == ([LOST], "Gr��e")
    long = "fällt " * 50_000
    assert judge(long) is None and judge(long + "fÃ¤llt")[1] == long + "fällt"
    assert judge("x" * 3_000_000 + "9" * 1_000_000) is None and judge("x1" * 500_000 + " fÃ¤llt " + "ä" * 200_000) is not None
    rows = spark.createDataFrame([(1, "GrÃ¶ÃŸe"), (1, "GrÃ¶ÃŸe"), (None, "fÃ¤llt"), (2, None)], "doc_id long, text string")
    assert find_garbled(rows, "doc_id", "text", model).count() == 3
    assert find_garbled(rows.limit(0), "doc_id", "text").count() == 0
    assert Model.from_state(model.state()).text("GrÃ¶ÃŸe") is not None


def test_all_words_of_all_texts_are_counted(spark):
    letters = F.translate(F.format_string("%05d", "id"), "0123456789", "abcdefghij")
    docs = spark.range(45_000, numPartitions=4).select(F.concat(F.lit("naïve `quötes` "), letters, F.lit("ß")).alias("t"))
    model = train(docs, "t")
    assert len(model.cores) == 45_001 and model.cores["naïve"] == 45_000 and set(model.cores.values()) == {1, 45_000}
    words = Counter({"Größe,": 3, "naïve": 2, "日本": 1})
    counts, chars = encodings._tally(spark.createDataFrame(list(words.items()), "w string, n long").repartition(3))
    assert chars == sum((Counter({c: k * n for c, k in Counter(w).items()}) for w, n in words.items()), Counter())
    for k, chain in enumerate([None, *CHAINS]):
        bad = {w: w if chain is None else garble(w, chain) for w in words}
        want = Counter(b for w, n in words.items() if bad[w] and (k == 0 or bad[w] != w) for b in features(bad[w]).tolist() for _ in range(n))
        assert {int(b): n for b, n in enumerate(counts[k].tolist()) if n} == want


def test_words_are_judged_in_tables_as_by_the_model(spark, corpus):
    rng = random.Random(13)
    bad = [" ".join((garble(w, chain) or w) if rng.random() < 0.5 else w for w in t.split()) for t in corpus[:90] for chain in ("utf_8>cp1252", "cp1250>cp1252", "koi8_r>cp1251")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus + bad + ["Gr\ufffde", "`Ã¶` Gr\ufffd\ufffde fÃ¤llt", "x" * 70 + "fÃ¤llt"])], "doc_id long, text string")
    model = train(df, "text")
    want = {r.doc_id: found for r in df.collect() if (found := model.text(r.text))}
    got = {r.doc_id: (sorted(r.chains + [LOST] * r.lost), r.restored) for r in find_garbled(df, "doc_id", "text", model).collect()}
    assert got == {i: (sorted(chains), back) for i, (chains, back) in want.items()} and len(got) > 200


def test_lost_characters_are_told_apart_from_chains(spark, corpus):
    model = train(spark.createDataFrame([(t,) for t in corpus], "text string"), "text")
    rows = spark.createDataFrame([(1, "Gr\ufffd\ufffde"), (2, "GrÃ¶ÃŸe fÃ¤llt"), (3, "Gr\ufffd\ufffde fÃ¤llt über")], "doc_id long, text string")
    got = {r.doc_id: (r.chains, r.lost, r.restored) for r in find_garbled(rows, "doc_id", "text", model).collect()}
    assert got == {1: ([], True, "Gr\ufffd\ufffde"), 2: (["utf_8>cp1252"], False, "Größe fällt"), 3: (["utf_8>cp1252"], True, "Gr\ufffd\ufffde fällt über")}


def test_chains_that_agree_have_one_name():
    words = {(garble(w, "iso8859_2>latin_1"), w) for w in ("příliš", "žluťoučký")}
    assert all(restore(bad, "iso8859_2>cp1252") == w for bad, w in words)
    assert _first_alike("iso8859_2>latin_1", words) == "iso8859_2>cp1252" and _first_alike(LOST, set()) == LOST


@pytest.fixture(scope="module")
def held_out(spark):
    """A model of one half of the posts, and clean posts of the other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = train(docs.where("doc_id % 2 = 0"), "text")
    return model, [r.text for r in docs.where("doc_id % 2 = 1").collect() if model.text(r.text) is None and not r.text.isascii()]


def restored_exactly(held_out, chain):
    """Posts of which words outside quotes were garbled: how many, how many were found, and how many restored exactly."""
    model, clean = held_out
    tried = found = right = 0
    for text in clean:
        words = re.split("([ \\t\\n\\r]+)", re.sub("`[^`]*`", "", text))
        bad = "".join(w if w.isascii() else garble(w, chain) or w for w in words)
        if bad != "".join(words):
            back = model.text(bad)
            tried, found, right = tried + 1, found + (back is not None), right + (back is not None and back[1] == "".join(words))
    return tried, found, right


@pytest.mark.parametrize("chain", ["utf_8>cp1252", "utf_8>latin_1", "utf_8>cp1252 twice", "utf_8>mac_roman", "utf_8>cp437"])
def test_restoration_is_exact_on_held_out_posts(held_out, chain):
    tried, _, right = restored_exactly(held_out, chain)
    assert tried > 50 and right >= 0.9 * tried


@pytest.mark.parametrize("chain", ["euc_jp>cp1252", "cp1252>cp437", "cp1252>mac_roman", "mac_roman>cp1252"])
def test_posts_found_through_other_chains_are_restored_whole(held_out, chain):
    tried, found, right = restored_exactly(held_out, chain)
    assert tried > 30 and found >= 0.6 * tried and right >= 0.9 * found


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = train(docs.where("doc_id % 2 = 0"), "text")
    clean = [r.text for r in docs.where("doc_id % 2 = 1").collect() if model.text(r.text) is None and not r.text.isascii()]
    hits = tries = 0
    for chain in ("utf_8>cp1252", "utf_8>cp1252 twice", "utf_8>mac_roman", "utf_8>cp437"):
        for t in clean:
            parts = t.split("\n\n")
            bad = [garble(p, chain) for p in parts[-1:]]
            if bad[0] is not None and re.sub("`[^`]*`", "", bad[0]) != re.sub("`[^`]*`", "", parts[-1]):
                tries += 1
                hits += model.text("\n\n".join([*parts[:-1], *bad])) is not None
    assert tries > 100 and hits >= 0.97 * tries
