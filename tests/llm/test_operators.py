"""Operators on small tables against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spoorline.llm import chat, decontaminate, html_text, langid, packing, secret_scan, suffix_tree, toxicity
from spoorline.llm.embed_dedup import embedding_groups, passes_for
from spoorline.llm.ngram_join import jaccard_groups, signatures
from spoorline.llm.tables import crc_part

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# names that operators use inside, to clash with
EXTRA = "row string, __id string, __text string, uid string, n string, found string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, rows):
    """Documents ``(doc_id, text)`` with columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], f"doc_id long, text string, {EXTRA}")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def varied(rng, base, changes):
    words = base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "w%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_ngram_join_equals_all_pairs(spark, k, num):
    rng = random.Random(k)
    base = " ".join("b%d" % i for i in range(120))
    texts = [varied(rng, base, rng.randrange(6)) for _ in range(30)]
    chain = base
    for _ in range(15):
        chain = varied(rng, chain, 1)
        texts.append(chain)
    texts += [" ".join("t%d" % rng.randrange(50) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    texts += [None, "", " \t\n", "one", "ONE", "two words", "two  words", base, base, base.upper()]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in jaccard_groups(documents(spark, rows), k, num, 100).collect()}
    sets = {}
    for i, t in rows:
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert len(links) > 20
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_keeps_repeated_rows_and_null_ids(spark):
    docs = documents(spark, [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, "x y z"), (3, None)])
    rows = jaccard_groups(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, -1), (-1, 5), (3, 3), (5, 5), (5, 5)]
    assert len({r["group"] for r in rows if r["group"] is not None}) == 2
    assert jaccard_groups(docs.limit(0)).count() == 0


def test_ngram_join_of_a_large_class_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr("spoorline.llm.ngram_join.BLOCK_SETS", 16)
    rng = random.Random(9)
    base = " ".join("b%d" % i for i in range(80))
    rows = [(i, varied(rng, base, 1 + i % 2)) for i in range(70)]
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(78)} for i, t in rows}
    want = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(documents(spark, rows)).collect()}
    assert got == want


def test_ngram_join_keeps_unlike_texts_of_shared_words_apart(spark):
    # every word is in some nine texts, but no two texts are alike
    rng = random.Random(4)
    rows = [(i, " ".join("w%d" % j for j in rng.sample(range(2000), 60))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " end") for i in range(5)]
    got = jaccard_groups(documents(spark, rows), 1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 300 if i >= 300 else i for i, _ in rows}
    assert sum(r["group"] is not None for r in got) < 40


@pytest.mark.parametrize("num", [50, 80, 90])
def test_sets_within_the_similarity_share_a_signature(num):
    rng = np.random.default_rng(num)
    tried = 0
    for _ in range(2000):
        n = int(rng.integers(1, 60))
        tokens = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64) * np.uint64(2)
        differ = int(rng.integers(0, n + 1))
        less = int(rng.integers(0, differ + 1))
        x, y = np.unique(tokens[:n]), np.unique(np.r_[tokens[less:n], tokens[n : n + differ - less]])
        if len(y) and 100 * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y)):
            tried += 1
            assert len(np.intersect1d(signatures(x, num, 100), signatures(y, num, 100)))
    assert tried > 200


def test_embedding_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows, centers = [], rng.standard_normal((6, 64))
    for i in range(240):
        noise = [0.0, 1e-9, 0.02, 0.3][i % 4]
        rows.append((i, (centers[i % 6] + noise * rng.standard_normal(64)).astype(np.float32).tolist(), i % 6 // 3))
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [None] + [1.0] * 63, 0), (904, rows[0][1], None), (905, rows[0][1], 0), (906, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    rows = [(*r, "x") for r in rows]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")).collect()

    def usable(v, label):
        return v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / np.sqrt((a @ a) * (b @ b))

    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][2] == rows[b][2] and len(rows[a][1] or []) == len(rows[b][1] or [])
             and usable(*rows[a][1:3]) and usable(*rows[b][1:3]) and cosine(rows[a][1], rows[b][1]) >= 0.93]
    degree = Counter(x for link in links for x in link)
    root = components(range(len(rows)), links)
    want = sorted((rows[i][0], degree[i], min(rows[j][0] for j in root if root[j] == root[i])) for i in root)
    assert len(links) > 300
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embedding_recall_with_many_vectors_per_label(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((1500, 64))
    other = base[:300] + 0.35 * rng.standard_normal((300, 64))
    everything = np.vstack([base, other])
    unit = everything / np.linalg.norm(everything, axis=1)[:, None]
    want = int((np.triu(unit @ unit.T, 1) >= 0.93).sum())
    got = embedding_groups(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(everything)], "vec_id long, embedding array<double>, label int"))
    assert want > 100 and got.agg(F.sum("n_links")).first()[0] / 2 >= 0.9 * want
    assert passes_for(10**9, 0.93) > passes_for(10**4, 0.93)


def test_suffix_tree_base_is_exact_and_the_score_beats_it(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "MAX_WORDS", 5)
    rng = random.Random(3)
    after = {"the": "wandering", "wandering": "of", "of": "Ringing", "Ringing": "the"}
    rows = []
    for i in range(60):
        words = ["the"]
        while len(words) < 60:
            words.append(after.get(words[-1], "of") if rng.random() < 0.8 else "wander%d" % rng.randrange(40))
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "unheard of\tthe " * 200), (1002, "The  OF"), (None, "the")]
    docs = documents(spark, rows).withColumn("held_out", crc_part(F.col("doc_id"), 5) == 1)
    model, words = suffix_tree.learn(docs.where("not held_out").select("text"))
    got = suffix_tree.score(docs, model, words, ["doc_id", "held_out", "text"]).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: WORD.findall(lowered(t)) + ["\n"]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total = sum(counts.values())
    bottom = total + 0.5 * (len(counts) + 1)
    assert len(got) == len(rows)
    for r in got:
        own = tokens(r["text"])
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(w in counts for w in own))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / bottom) for w in own), abs=1e-6)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    model, words = suffix_tree.learn(docs.limit(0).select("text"))
    blank = {r["doc_id"]: r for r in suffix_tree.score(docs, model, words, ["doc_id"]).collect()}
    assert blank[1000]["base_score"] == 0.0 and blank[1000]["train_tokens"] == 0 and blank[1000]["n_known"] == 0


def test_suffix_tree_scores_do_not_depend_on_the_states_that_are_sent(spark, monkeypatch):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdet") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(80))) for i in range(80)] + [(1000, None), (1001, ""), (1002, "zzz abc " + stems[0])]
    docs = documents(spark, rows)
    train = docs.where("doc_id % 5 <> 1").select("text")
    model, joined = suffix_tree.learn(train)
    scores = lambda m, j: {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, m, j, ["doc_id"]).collect()}
    want, n_states = scores(model, joined), len(model.states)
    assert joined.far is None and n_states > 100
    monkeypatch.setattr(suffix_tree, "MAX_STATES", 8)
    model, joined = suffix_tree.learn(train)
    assert len(model.states) < n_states // 2
    assert scores(model, joined) == pytest.approx(want, abs=1e-3)


def test_decontamination_equals_comparing_all_windows(spark):
    rng = random.Random(4)
    vocabulary = ["v%d" % i for i in range(300)] + ["the", "of"] * 40
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 18, 33, 60])))) for i in range(25)] + [(98, ""), (99, None), (3, "a second text of one id here")]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(120))]
        if d % 3 == 0:
            item = items[rng.randrange(25)][1].split()
            if d % 2 and len(item) > 30:
                item[rng.choice([0, -1, len(item) // 2])] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in item]
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "the " * 500), (902, items[4][1])]
    got = decontaminate.find_items(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    bare = lambda t: [w for w in (re.sub(r"^[^A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff]+$", "", x) for x in lowered(t).split()) if w]
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    known = [(i, bare(t)) for i, t in items if t]
    spread = Counter(s for _, w in known for s in shingles(w))
    similar = lambda a, b: sum(min(a[s], b[s]) / max(spread[s], 1) for s in a | b) / sum(max(a[s], b[s]) / max(spread[s], 1) for s in a | b)
    want = Counter()
    for d, t in docs:
        w = bare(t)
        for i in {i for i, _ in known}:
            if any(similar(shingles(x), shingles(w[a : a + len(x)])) >= 0.8 for j, x in known if j == i and w for a in range(max(1, len(w) - len(x) + 1))):
                want[d, i] += 1
    found = Counter((r["doc_id"], f["item_id"]) for r in got for f in r["found"])
    assert len(got) == len(docs) and sum(want.values()) > 15
    assert set(found) == set(want)
    left = decontaminate.drop_holders(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), ["doc_id", "text"])
    dirty = {d for d, _ in want}
    kept = [r["doc_id"] for r in left.collect()]
    assert sorted(kept) == sorted([d for d, _ in docs if d not in dirty] + ([902] if 902 in dirty else []))
    assert decontaminate.find_items(documents(spark, docs), spark.createDataFrame([], "item_id long, text string"), ["doc_id"]).where("size(found) > 0").count() == 0


def test_decontamination_finds_near_copies_of_repeated_and_template_items(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda mark, n: ["%s%d" % (mark, rng.randrange(10**6)) for _ in range(n)]
    near = lambda words, at: " ".join(text("lead", 20) + words[:at] + ["changed"] + words[at + 1 :] + text("tail", 20))
    once, twice, five = text("a", 60), text("b", 60), text("c", 60)
    start, end = text("d", 24), text("e", 24)
    siblings = [start + text("f", 12) + end for _ in range(5)]
    items = [(1, once), (2, twice), (3, twice), *[(4 + i, five) for i in range(5)], *[(10 + i, s) for i, s in enumerate(siblings)]]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    docs = [(0, near(once, 30)), (1, near(twice, 30)), (2, near(five, 30)), (3, near(siblings[0], 8)), (4, near(siblings[1], 30)), (5, " ".join(start + text("g", 12) + end))]
    want = {0: [1], 1: [2, 3], 2: [4, 5, 6, 7, 8], 3: [10], 4: [11], 5: []}

    def found():
        out = {}
        for r in decontaminate.find_items(documents(spark, docs), table, ["doc_id"]).collect():
            out.setdefault(r["doc_id"], []).extend((f["item_id"], round(f["similarity"], 9)) for f in r["found"])
        return {d: sorted(x) for d, x in out.items()}

    whole = found()
    assert {d: [i for i, _ in x] for d, x in whole.items()} == want
    monkeypatch.setattr(decontaminate, "PART_WORDS", 200)
    assert found() == whole


def test_secret_scan_digests_and_redaction(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"text é password={key(18)} more and {key(40)} end") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "nothing here, not 1234567890123456"), (103, "bare " + key(24) + " in text"), (103, "bare")]
    docs = documents(spark, rows)
    scanned = secret_scan.scan(docs, secret_scan.learn(docs), ["doc_id", "text"])
    spans = secret_scan.merged(F.col("base"), F.col("added"))
    got = scanned.select("doc_id", "text", secret_scan.text_of(F.col("base")).alias("base"), secret_scan.text_of(spans).alias("spans"), secret_scan.redact(F.col("text"), spans).alias("clean")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = secret_scan.base_spans(r["text"] or "")
        assert r["base"] == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b, _ in want)
        assert set(r["base"].split(",")) <= set(r["spans"].split(",")) or not r["base"]
    by_id = {(r["doc_id"], r["text"]): r for r in got}
    assert by_id[102, rows[62][1]]["spans"] == "" and by_id[103, "bare"]["clean"] == "bare"
    assert by_id[103, rows[63][1]]["clean"] == "bare [secret] in text"
    assert by_id[0, rows[0][1]]["clean"] == "text é [secret] more and [secret] end"
    assert secret_scan.scan(docs.limit(0), secret_scan.learn(docs.limit(0)), ["doc_id"]).count() == 0


def test_html_query_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "x"), (1, "<p>a<p>b", "x"), (2, None, "x"), (3, "", "x")], "page_id long, html string, row string")
    got = html_text.page_text(pages, ["page_id"]).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(1, "a\n\nb"), (1, "a\n\nb"), (2, ""), (3, "")]
    assert html_text.page_text(pages.limit(0), ["page_id"]).count() == 0


def test_packing_round_trip(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("Word%d's été" % rng.randrange(300) for _ in range(rng.randrange(200)))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "long " * 5000), (902, "long"), (None, "no id")]
    path = public_tokenizers.path("word_bpe_49k.json")
    for shard in (2000, 10**6):
        got = packing.pack(documents(spark, rows), path, 256, 1, shard).collect()
        tokenizer = Tokenizer.from_file(path)
        want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
        texts, by_sequence = {}, {}
        for r in got:
            assert len(r["ids"]) == 4 * r["length"]
            texts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        rebuilt = Counter((i, tuple(x for _, ids in sorted(p) for x in ids)) for (i, _), p in texts.items())
        assert rebuilt == want
        for spans in by_sequence.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 256
    assert packing.pack(documents(spark, []), path).count() == 0


def test_language_learns_and_rejects(spark):
    rng = random.Random(7)
    parts = {"aa": "th er on an re he in ed".split(), "bb": "che ung keit lich ein ver".split(), "cc": "ción mente ado ñ ar os".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    text = lambda lang: " ".join(word(lang) for _ in range(80))
    rows = [(i, text(lang), lang, "x") for i, lang in enumerate(["aa", "bb", "cc"] * 30)] + [(900, None, "aa", "x"), (901, "", None, "x"), (902, "123 !!", "bb", "x"), (903, text("cc"), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string")
    model = langid.learn(docs.where("doc_id % 3 <> 99 and doc_id < 60"))
    got = {r["row"]["doc_id"]: r for r in langid.identify(docs, model, ["doc_id", "lang"]).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:90]) and got[903]["lang_pred"] == "cc"
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.identify(docs, langid.learn(docs.limit(0)), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_bloom_filter_answers_all_languages_that_hold_a_gram(spark):
    docs = spark.createDataFrame([(1, "hello hello hello", "aa"), (2, "hello hello hello world world world", "bb")], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    keys, _ = langid.grams(np.frombuffer(b"hello", np.uint8), np.array([0, 5]))
    spots = [((keys.astype(np.uint64) * np.uint64(m) & np.uint64(0xFFFFFFFF)) >> np.uint64(12)).astype(int) for m in langid.MULTIPLIERS]
    masks = model.slices[0][spots[0]] & model.slices[0][spots[1]] & model.slices[0][spots[2]]
    assert (masks == 3).all() and sorted(model.langs) == ["aa", "bb"]


def test_toxicity_learns_from_texts_and_finds_broken_up_words(spark):
    rng = random.Random(8)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(["idiot", "moron", "scumbag"])
            words[rng.randrange(60)] = rng.choice(["idiot", "moron", "scumbag"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    plain = " ".join(word() for _ in range(40))
    fresh = [(900, plain + " You I.D.I.O.T " + plain), (901, plain + " m o r o n " + plain), (902, plain), (903, None), (904, ""), (904, "")]
    docs = documents(spark, rows + fresh)
    known = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs.where("doc_id % 4 <> 2"), known.where("doc_id % 4 <> 2"))
    got = [(r["row"]["doc_id"], r["score"]) for r in toxicity.score(docs, model, ["doc_id"]).collect()]
    scores = dict(got)
    held = [(scores[i], i % 5 == 0) for i in range(2, 400, 4)]
    assert sum((s >= 0.3) == t for s, t in held) >= 0.95 * len(held)
    assert scores[900] >= 0.3 and scores[901] >= 0.3 and scores[902] < 0.3 and scores[903] < 0.3
    assert len(got) == len(rows) + len(fresh) and all(0 <= s <= 1 for _, s in got)
    blind = toxicity.learn(docs.limit(0), known.limit(0))
    assert len({r["score"] for r in toxicity.score(docs, blind, ["doc_id"]).collect()}) == 1


def test_toxicity_leaves_texts_without_a_label_where_they_are(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(7, "again"), (None, "no id"), (8, None)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(0, 40)] + [(5000, 1)], "doc_id long, toxic int")
    found = toxicity.with_labels(docs, known)
    want = sorted([(i, f"text {i}", i % 2) for i in range(40)] + [(7, "again", 1)])
    assert sorted((r.doc_id, r.text, r.toxic) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin" not in plan
    passed = docs.where("text is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("__key")).mapInArrow(
        toxicity._in_filter(spark.sparkContext.broadcast(toxicity.active_bits(known.select(F.xxhash64("doc_id").alias("__key"))))), "doc_id long, text string")
    assert 41 <= passed.count() < 400


def test_toxicity_covers_a_rare_insult_at_every_size(spark, monkeypatch):
    common = ["_IDIOT_", "_MORON_", "_SCUMBAG_"]
    rows = [(i, common) for i in range(1000)] + [(1000 + i, ["_WEASEL_", "_IDIOT_"]) for i in range(5)]
    held = spark.createDataFrame(rows, "doc long, keys array<string>")
    assert set(toxicity.cover_all(held)) == {*common, "_WEASEL_"}
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 50)
    assert set(toxicity.cover_all(held)) == {*common, "_WEASEL_"}
    rng = random.Random(8)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    plain = lambda: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(30))
    texts = [(i, plain() + (" You idiot" if i < 1500 else "")) for i in range(3500)] + [(5000 + i, plain() + " zyxquv") for i in range(12)]
    labels = spark.createDataFrame([(i, int(i < 1500 or i >= 5000)) for i, _ in texts], "doc_id long, toxic int")
    docs = documents(spark, texts + [(6000, plain() + " zyxquv"), (6001, plain())])
    scores = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels), ["doc_id"]).collect()}
    assert scores[6000] >= 0.3 > scores[6001]


def test_transcripts_recover_roles_over_chunks(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(2, 7)):
            role = "user" if turn % 2 == 0 else "assistant"
            text = "What about %d?" % rng.randrange(99) if role == "user" else "\n".join("It is a longer line of an answer, number %d, with more words in it." % rng.randrange(99) for _ in range(3))
            rows.append((conv, turn, role, text, "x"))
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string")
    lines = chat.plain_transcripts(conversations)
    model = chat.learn(lines.where("conv_id % 4 <> 2"))
    bare = lines.select("conv_id", F.struct("turn", "line_no").alias("at"), "line")
    truth = {}
    for r in sorted(lines.collect(), key=lambda r: (r["conv_id"], r["turn"], r["line_no"])):
        truth.setdefault(r["conv_id"], []).append(r["role"])
    results = []
    for size in (4096, 3):
        monkeypatch.setattr(chat, "CHUNK_LINES", size)
        recovered = chat.recover_lines(bare, model)
        results.append(sorted((r["conv_id"], r["pos"], r["role"], r["opens"], r["line"]) for r in recovered.collect()))
        turns = chat.canonical_turns(chat.recover_lines(bare, model)).collect()
        assert sum(t["n_lines"] for t in turns) == sum(map(len, truth.values()))
        assert all(t["rendered"].startswith(f"<|{t['role']}|>\n") for t in turns)
    assert results[0] == results[1]
    right = sum(truth[c][p] == role for c, p, role, _, _ in results[0] if c % 4 == 2)
    assert right >= 0.9 * sum(len(v) for c, v in truth.items() if c % 4 == 2)


def test_transcripts_with_nulls_and_ties(spark):
    lines = spark.createDataFrame([(None, 1, "User: a"), (None, 2, None), (7, 1, "same"), (7, 1, "same"), (7, None, "")], "conv_id long, at long, line string")
    model = chat.learn(spark.createDataFrame([], "conv_id long, turn long, line_no int, role string, line string"))
    got = chat.canonical_turns(chat.recover_lines(lines, model)).collect()
    assert sum(r["n_lines"] for r in got) == 5 and {r["conv_id"] for r in got} == {None, 7}
    assert chat.canonical_turns(chat.recover_lines(lines.limit(0), model)).count() == 0
