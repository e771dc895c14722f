"""Fill-in-middle cuts, WARC archives and source divergence against plain versions on small inputs."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.llm import divergence, fim, warc
from spoorline.session import stage

LINES = re.compile(r"[^\n]*\n|[^\n]+")


# fill-in-middle


def plain_fim(i, text, seed=7):
    text = text or ""
    units = LINES.findall(text)
    h = [int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in fim.MARKS):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_cuts_equal_plain_cuts(spark):
    rng = random.Random(1)
    piece = lambda: "".join(rng.choice("ab\n\né漢😀 <>PS") for _ in range(rng.randrange(0, 40)))
    rows = [(i, piece()) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "\n\n"), (504, "no end"), (505, "a<M>b\nc\n"), (506, "<S\n>P>\n<"), (None, "x\ny\n"), (7, "same\ntext"), (7, "same\ntext")]
    rows += [(600, "".join(f"zeile é {k}\n" for k in range(60_000))), (601, "x" * 300_000), (602, "\n" * 100_000 + "e")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, output string")
    for block in (4096, 3):
        small = docs if block > 100 else docs.where("coalesce(doc_id, 0) < 600")
        out = fim.rearrange(small, ["doc_id", "text", "output"], seed=7, block=block)
        got = out.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
        assert len(got) == small.count()
        for r in got:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"])
            assert r["back"] == (r["text"] or "")
    assert fim.rearrange(docs.limit(0), ["doc_id"]).count() == 0


def test_every_cut_of_a_block_tree():
    text = "aé\n\n漢字\nlast".encode()
    for block in (1, 2, 5, 64):
        tree = fim.BlockTree(np.frombuffer(text, np.uint8), block=block)
        units = LINES.findall(text.decode())
        assert tree.units == len(units) and tree.chars == len(text.decode())
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert tree.cut(k) == (len(head.encode()), len(head))


def test_rates_marks_and_units(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(300)], "doc_id long, text string")
    forms = Counter(r["form"] for r in fim.rearrange(docs, ["doc_id"], rate=50, spm_rate=0, unit_end=" ").collect())
    assert set(forms) == {"plain", "psm"} and 100 < forms["plain"] < 200
    with pytest.raises(ValueError):
        fim.rearrange(docs, ["doc_id"], marks=("<a<", "<S>", "<M>"))


# archives


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "same " * 60, "<p>" + "möre " * 50
    rows = [
        (5, "http://www.Example.com/b?q=1#x", big), (3, "https://example.com:443/a", big), (9, "http://a.b.example.com:8080/", big),
        (1, "http://example.com/", "short"), (2, "http://example.com/2", "short"), (4, None, None), (6, "no url at\tall\n", other), (7, "", other), (8, "http://[::1]/x", ""),
        (None, "http://example.com/n", big), (10, "http://example.com/a", "z" * 400_000), (11, "http://example.com/a", other), (11, "http://example.com/a", other), (6, "no url at\tall\n", other),
    ]
    rows += [(100 + i, f"http://host{i % 7}.org/{i}", f"page {i} " * (i % 40)) for i in range(300)]
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, kind string").repartition(5)


def read_all(spark, pages, root, **bounds):
    captures = warc.write(pages, root, "page_id", "url", "html", archive_bytes=20_000)
    index = warc.build_index(captures, root, **bounds)
    hits = warc.lookup(spark, index, pages.select("page_id", "url").distinct(), ["page_id"], id_column="page_id")
    return index, warc.fetch(hits, root)


def test_records_come_back_whole(spark, pages, tmp_path):
    with stage(spark):
        index, read = read_all(spark, pages, str(tmp_path), block_entries=4, file_blocks=3)
        rows = [r.asDict() for r in warc.resolve(read, "payload").select("row.page_id", "kind", "digest", "refers_to", "payload").collect()]
    given = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    least = {}
    for i, html in given:
        if i is not None and len(html) >= 100:
            least[html] = min(i, least.get(html, i))
    want = Counter()
    for i, html in given:
        first = least.get(html)
        again = first is not None and i != first
        want[(i, hashlib.sha256(html).hexdigest(), "revisit" if again else "response", str(first) if again else None, html)] += 1
    assert Counter((r["page_id"], r["digest"], r["kind"], r["refers_to"], bytes(r["payload"])) for r in rows) == want
    assert len(index.files) > 3 and sorted(index.first) == index.first
    # any reader of gzip finds whole records in the archives
    kinds = Counter()
    for path in (tmp_path / "archive").iterdir():
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            length = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[length : length + 4] == b"\r\n\r\n"
            kinds[re.search(rb"WARC-Type: (\w+)", head)[1].decode()] += 1
            data = rest[length + 4 :]
    assert kinds["response"] + kinds["revisit"] == len(given) and kinds["revisit"] == sum(n for k, n in want.items() if k[2] == "revisit")


def test_lookups_by_url_and_by_domain(spark, pages, tmp_path):
    with stage(spark):
        index, _ = read_all(spark, pages, str(tmp_path), block_entries=2, file_blocks=2)
        asked = spark.createDataFrame([(1, "HTTPS://example.com:443/a"), (2, "http://nobody.net/"), (3, None)], "q int, url string")
        found = warc.lookup(spark, index, asked, ["q"]).select("row.q", "key").collect()
        assert Counter(r["q"] for r in found) == {1: 4, 3: 2}
        below = spark.createDataFrame([(1, "com,example"), (2, "org,host3)"), (3, "")], "q int, key string")
        found = Counter(r["q"] for r in warc.lookup(spark, index, below, ["q"], url_column="key", prefix=True).select("row.q").collect())
        assert found == {1: 9, 2: 43, 3: pages.count()}


def test_url_keys(spark):
    urls = ["http://User@www.Example.com:80/A?b=C#d", "//x.y:81", "https://h", "plain text", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example,www)/A?b=C", "y,x:81)/", "h)/", "plain%20text", ""]


def test_no_pages(spark, pages, tmp_path):
    with stage(spark):
        index, read = read_all(spark, pages.limit(0), str(tmp_path))
        assert index.files == [] and read.count() == 0
        assert warc.lookup(spark, index, pages, ["page_id"]).count() == 0


# divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, held, own = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(lower))
        held[lang].update(set(terms))
        own[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        mates = [s for g, s in groups if g == lang]

        def share(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p = share(own[lang, source])
        pairs = []
        for s in mates:
            if s != source:
                q = share(own[lang, s])
                pairs.append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), s))
        q = share(sum((own[lang, s] for s in mates), Counter()))
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if own[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def divergence_rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    stems = ["a", "Abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "straße", "漢字漢字漢字", "é", "x" * 70, "x" * 71, "İß"]
    word = lambda: rng.choice(stems) + rng.choice(["", "", "s", "z" * rng.randrange(1, 30)])
    rows = [(" ".join(word() for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None]), rng.choice("abcd")) for _ in range(120)]
    rows += [(None, "en", "e"), ("", "fr", "only"), ("123 _!", "fr", "b"), ("twice twice", "en", None), ("twice", "en", None), ("twice", "en", None), ("many " * 5000 + "m" * 40_000, "en", "a")] * 1
    rows += [("rare\x00rare2RARE", "es", "q")] * 2 + [("three", "es", "q"), ("three", "es", "r"), ("Three", "es", "r")]
    return rows


def test_divergence_equals_plain_counting(spark, mixed, monkeypatch):
    docs = spark.createDataFrame([(*r, 1) for r in mixed], "text string, lang string, source string, value int").repartition(3)
    want = plain_audit(mixed)
    assert {r[2] for r in want} == {"pair", "term"}
    with stage(spark):
        assert divergence_rows(divergence.audit(docs)) == want
        monkeypatch.setattr(divergence, "CHUNK_BYTES", 200)
        monkeypatch.setattr(divergence, "FLUSH_ROWS", 10)
        assert divergence_rows(divergence.audit(docs, top=3)) == plain_audit(mixed, top=3)


def test_divergence_without_kept_terms_or_rows(spark):
    docs = spark.createDataFrame([("a b", "en", "x"), ("a", "en", "y"), (None, None, None)], "text string, lang string, source string")
    with stage(spark):
        assert divergence_rows(divergence.audit(docs)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
        assert divergence.audit(docs.limit(0)).count() == 0


def test_the_filter_never_loses_a_prefix(spark):
    rows = [("en", bytes([i, 200, 7])) for i in range(200)] + [("de", b"abc")]
    with stage(spark):
        passed = divergence.live_filter(spark.createDataFrame(rows, "lang string, prefix binary"))
    assert passed(divergence._hashes(["en", "de"], np.array([0] * 200 + [1]), [p for _, p in rows])).all()
    assert not passed(divergence._hashes(["en", "de"], np.array([1]), [rows[0][1]])).any()


# packing: special tokens of the vocabulary in the text


def test_special_tokens_in_texts_are_what_the_tokenizer_makes_of_them(spark):
    from tokenizers import Tokenizer

    from spoorline.llm import packing
    from spoorline.llm.queries import tokenizer_path

    texts = [
        "a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y z", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "<|end of text|>", "a<|endoftext|", "<| plain |>",
        "word<|startoftext|>'s don't", "\n<|endoftext|>\n", "é<|endoftext|>漢", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = Tokenizer.from_file(tokenizer_path())
    got = {}
    for r in packing.pack(docs, tokenizer_path()).collect():
        got.setdefault(r["doc_id"], {})[r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    for i, text in enumerate(texts):
        assert sum((got[i][k] for k in sorted(got[i])), []) == whole.encode(text or "", add_special_tokens=False).ids + [1], text
    assert sum((got[0][k] for k in sorted(got[0])), []) == [320, 49407, 321, 1]
