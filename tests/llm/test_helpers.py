"""Helpers without Spark, against plain Python."""

import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoorline.llm import chat, decontaminate, html_text, langid, packing, secret_scan, suffix_tree, toxicity
from spoorline.llm.textops import Words, flat, pieces, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n.éÉ中", max_size=30)), max_size=8)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@given(texts)
@settings(max_examples=200, deadline=None)
def test_words_and_shingles(rows):
    column = pa.array(rows, pa.string())
    words = Words(*flat(column))
    want = [WORD.findall(lowered(t)) for t in rows]
    assert words.counts().tolist() == [len(w) for w in want]
    flat_want = [w for ws in want for w in ws]
    assert len(set(words.hash.tolist())) == len(set(flat_want))
    names = dict(zip(words.hash.tolist(), flat_want))
    assert [names[h] for h in words.hash.tolist()] == flat_want
    for k in (1, 3, 5):
        for got, own in zip(shingles(words, k), want):
            sets = {tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()
            assert len(got) == len(sets) and (np.diff(got.astype(object)) > 0).all()


def test_chunks_cover_all_rows_and_slices_keep_their_place():
    column = pa.array(["a b", None, "", "c" * 50, "d e f"], pa.string())
    _, offsets = flat(column)
    assert [r for i, j in pieces(offsets, 10) for r in range(i, j)] == list(range(5))
    assert Words(*flat(column.slice(3))).counts().tolist() == [1, 3]


@pytest.fixture(scope="module")
def encoder():
    return packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_word_ids_equal_the_tokenizer(encoder, rows):
    ids, counts = encoder(pa.array(rows, pa.string()), 1)
    at = 0
    for text, n in zip(rows, counts):
        assert ids[at : at + n].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [1]
        at += n


@given(st.lists(st.integers(1, 90), min_size=1, max_size=80), st.sampled_from([8, 16, 30]))
@settings(max_examples=100, deadline=None)
def test_plan_covers_every_token_once_and_fills_sequences_gaplessly(lengths, window):
    plan = packing.plan(np.array(lengths), window)
    covered = [[] for _ in lengths]
    placed: dict[int, list] = {}
    for d, s, n, q, o in zip(*(plan[c].tolist() for c in ("doc", "start", "length", "sequence", "offset"))):
        covered[d] += range(s, s + n)
        placed.setdefault(q, []).append((o, n))
    assert [sorted(c) for c in covered] == [list(range(n)) for n in lengths]
    for spans in placed.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= window


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 30)) * (rng.random((12, 30)) < 0.3), rng.random(12) * 10
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-5 and abs(slope[x > 1e-9]).max(initial=0) < 1e-4


def test_packing_wastes_little():
    lengths = np.random.default_rng(2).integers(1, 6000, 5000)
    plan = packing.plan(lengths, 2048)
    total = np.bincount(plan["sequence"], plan["length"])
    padding = sum(2048 - t for t in total if int(t) & (int(t) - 1))
    assert padding / total.sum() < 0.01
    assert len(plan["doc"]) < 1.5 * (lengths // 2048 + 1).sum()


@pytest.mark.parametrize("source, want", [
    ("", ""),
    ("a  b\n c", "a b c"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>x", "- a\n- b\n  3. c\n  4. d\n\nx"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1<tr><td colspan=2>all of it</table>", "Name    N\nlonger  1\nall of it"),
    ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a  b\n   c"),
    ("<title>no</title><body>yes<script>var a='</p>'</script><style>x</style><!-- no -->", "yes"),
    ("<p hidden>no</p><p style='display : none'>no</p><p>yes</p><template>no</template>", "yes"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("a &lt; b &amp; c&nbsp;d", "a < b & c d"),
    ("<b>bo</b>ld <i> it</i>", "bold it"),
    ("1 < 2 and <3", "1 < 2 and <3"),
    ("<a title='x>y'>z</a>", "z"),
    ("<details><summary>s</summary>inside</details><details open><summary>t</summary>seen</details>", "s\nt\nseen"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ("<table>outside<tr><td>cell</table>", "outside\n\ncell"),
    ("</p>x</div></td>", "x"),
])
def test_rendering(source, want):
    assert html_text.render(source) == want


def test_rendering_of_deep_and_broken_pages_ends():
    assert html_text.render("<div>" * 20_000 + "x") == "x"
    assert html_text.render("<b " + '"' * 3000 + "x").startswith("<b")
    assert html_text.render("<table><tr><td>" * 200 + "x").strip() == "x"


def test_base_spans_drop_short_matches_but_use_up_their_text():
    text = 'Password = "abcdefgh" token:short api_key=\'AKIA' + "A1" * 8 + "' " + "ab12" * 8 + " " + "abcdef01" * 3
    spans = secret_scan.base_spans(text)
    assert [(k, text[a:b]) for a, k, b, _ in spans] == [
        (0, 'Password = "abcdefgh'), (0, "api_key='AKIA" + "A1" * 8), (1, "AKIA" + "A1" * 8), (2, "ab12" * 8)]
    assert secret_scan.base_spans("tokenK=abcdefghi Key") == []


def test_inferred_automaton_prefers_its_format():
    rng = np.random.default_rng(0)
    keys = ["sk-" + "".join(rng.choice(list("0123456789abcdef"), 24)) for _ in range(200)]
    plain = ["user.%03d@mail%d.example.com" % (i, i % 7) for i in range(200)]
    model = secret_scan.fit({"hex": keys}, plain)
    fresh = "sk-" + "".join(rng.choice(list("0123456789abcdef"), 24))
    assert model.odds(fresh)[0] > secret_scan.ODDS > model.odds("user.999@mail3.example.com")[0]
    total = sum(10 ** p for _, p in model.automata["hex"].steps[0].values())
    assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("size, row_bytes", [(5, 64), (255, 64), (256, 128), (700, 128)])
def test_window_prints_equal_counting_every_bit(size, row_bytes):
    hashes = np.random.default_rng(size).integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    sums, at = decontaminate.bit_sums(hashes, size), np.array([0, 3, 200])
    assert sums.nbytes == row_bytes * 901
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    want = [np.packbits(bits[a : a + size].sum(axis=0) > size // 2).view(np.uint64)[0] for a in at]
    assert decontaminate.prints(sums, at, size).tolist() == want


def test_bare_words_lose_outer_marks_only():
    texts = ["(One) two-three, -- 'four'", "", "--", "... five", "six ."]
    words = decontaminate.BareWords(*flat(pa.array(texts)))
    got = [[bytes(words.low[a:b]).decode() for a, b in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.first[:-1], words.first[1:])]
    assert got == [["one", "two-three", "four"], [], [], ["five"], ["six"]]


def test_hamming_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 2**63, 200).astype(np.uint64)
    index = decontaminate.BlockIndex(own, np.arange(200), np.zeros(200, int))
    found = []
    for i in range(200):
        flips = rng.choice(64, rng.integers(0, 12), replace=False)
        found.append(own[i] ^ np.uint64(sum(1 << int(f) for f in flips)))
    found = np.array(found)
    rows, hits = index.near(found)
    want = {(r, h) for r in range(200) for h in range(200) if bin(int(found[r] ^ own[h])).count("1") <= decontaminate.RADIUS}
    assert set(zip(rows.tolist(), hits.tolist())) == want


def test_smoothed_tree_is_a_distribution():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 3000).astype(np.uint64)
    levels, keys, counts = [], [], []
    for d in range(3):
        key = np.zeros(len(data) - 2, np.uint64)
        for i in range(d + 1):
            key = (key << np.uint64(8)) | data[2 - d + i : len(data) - d + i]
        k, n = np.unique(key, return_counts=True)
        levels.append(np.full(len(k), d)), keys.append(k), counts.append(n)
    entries, entry_logs, states, state_logs = suffix_tree.smooth(*map(np.concatenate, (levels, keys, counts)))
    tables = suffix_tree.Table(entries, entry_logs), suffix_tree.Table(states, state_logs)
    for context in (0x6162, 0x6364, 0x7A7A, 0x0A0A):
        all_next = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** suffix_tree.tree_logs(*tables, all_next, 2)).sum() - 1) < 1e-9


def test_word_logs_look_every_context_up_once(monkeypatch):
    rng = np.random.default_rng(3)
    lines = [" ".join(rng.choice(["one", "two", "three", "fourteen"], rng.integers(0, 30))) for _ in range(40)]
    data, offsets = flat(pa.array(lines))
    words = Words(data, offsets)
    keys, begin, last = suffix_tree.stream(words, offsets, 2)
    entries, states = (suffix_tree.Table(np.zeros(0, np.uint64), np.zeros(0)) for _ in range(2))
    far, asked = np.packbits(rng.random(1 << suffix_tree.FILTER_BITS) < 0.5, bitorder="little"), []
    plain_logs, plain_far = suffix_tree.tree_logs, suffix_tree.far_bytes
    monkeypatch.setattr(suffix_tree, "tree_logs", lambda e, s, k, d: asked.append(k) or plain_logs(e, s, k, d) - (k % np.uint64(97)).astype(float))
    monkeypatch.setattr(suffix_tree, "far_bytes", lambda k, f, d: asked.append(k) or plain_far(k, f, d))
    sums, word, byte, log = suffix_tree.word_logs(keys, begin, last, words.counts(), entries, states, 2, far)
    assert [len(np.unique(k)) for k in asked] == [len(k) for k in asked]
    # the same byte by byte
    want_sums, want_far, n = [], [], 0
    for a, b, count in zip(begin, last, words.counts()):
        total = 0.0
        for key in keys[a:b] if count else []:
            one = -np.log10(256) - float(key % np.uint64(97))
            total += one
            if plain_far(np.array([key]), far, 2)[0]:
                want_far.append((n, int(key), one))
            if int(key) & 255 in (32, suffix_tree.END):
                want_sums.append(total)
                total, n = 0.0, n + 1
    assert np.allclose(sums, want_sums) and len(sums) == int(words.counts().sum())
    assert [(w, k) for w, k, _ in want_far] == list(zip(word.tolist(), byte.tolist())) and np.allclose(log, [x for _, _, x in want_far])


def test_table_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(5).integers(0, 2**60, 5000).astype(np.uint64))
    table = suffix_tree.Table(keys[::2], np.arange(len(keys[::2]), dtype=float))
    hit, value = table.get(keys)
    assert hit[::2].all() and not hit[1::2].any() and (value[::2] == np.arange(len(keys[::2]))).all()


@given(texts)
@settings(max_examples=100, deadline=None)
def test_streams_hold_the_tokens(rows):
    data, offsets = flat(pa.array(rows, pa.string()))
    words = Words(data, offsets)
    keys, begin, last = suffix_tree.stream(words, offsets, 2)
    for text, a, b in zip(rows, begin, last):
        want = " ".join(WORD.findall(lowered(text))).encode() + b"\n"
        assert bytes((keys[a:b] & np.uint64(255)).astype(np.uint8)) == want
        assert int(keys[a] >> np.uint64(8)) == 0x0A0A


@given(texts)
@settings(max_examples=100, deadline=None)
def test_grams_stay_inside_their_text(rows):
    data, offsets = flat(pa.array(rows, pa.string()))
    keys, first = langid.grams(data, offsets)
    for i, text in enumerate(rows):
        raw = b"  " + re.sub(rb"[^a-z\x80-\xff]", b" ", lowered(text).encode()) + b"  "
        want = [raw[k : k + 4] for k in range(len(raw) - 3) if raw[k + 1] != 32 and raw[k + 2] != 32]
        assert [int(x).to_bytes(4, "big") for x in keys[first[i] : first[i + 1]]] == want


def test_word_pieces_join_single_letters_and_cover_long_words():
    data, offsets = flat(pa.array(["An i.d.i.o.t, i d i o t! 12", "", "x" * 40], pa.string()))
    symbols, ends, first = toxicity.word_pieces(data, offsets)
    begin = np.r_[0, ends]
    own = ["".join(chr(96 + c) if c < 27 else "|" for c in symbols[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    assert own[:3] == ["|an|", "|idiot|", "|idiot|"] and first.tolist() == [0, 3, 3, len(own)]
    assert sum(p.count("x") for p in own[3:]) >= 40 and max(map(len, own)) <= toxicity.PIECE


def test_kernel_machine_tolerates_gaps_and_insertions():
    rng = np.random.default_rng(6)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    edge = bytes([toxicity.EDGE])
    code = lambda w: edge + bytes(ord(c) - 96 for c in w) + edge
    clean = sorted({"".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(3000)})
    bad = ["idiot", "moron", "scumbag", "pathetic"]
    weights, bias = toxicity.fit_kernel([code(w) for w in bad], [code(w) for w in clean])

    def margin(words):
        raw = [code(w) for w in words]
        return toxicity.margins(weights, bias, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(w) for w in raw]))

    assert margin(bad).min() > 0 and margin(["idxiot", "morron", "pathxetic"]).min() > margin(clean).max()


def test_cover_prefers_words_of_many_texts():
    pairs = {"_bad_": {1, 2, 3, 4}, "p_ba": {1, 2, 3, 4}, "_copy_": {1, 2, 3}, "_worse_": {5, 6, 7}, "_rare_": {4}}
    assert toxicity.cover(pairs, 3, 1) == ["p_ba", "_worse_"]
    assert toxicity.cover(pairs, 3, 2) == ["p_ba", "_worse_", "_copy_"]
    assert toxicity.cover({}, 3) == []


@pytest.mark.parametrize("line, want", [
    ("User: hi", ("user", 6)), ("**A:** yes", ("assistant", 7)), ("<|system|>", ("system", 10)), ("### Human: x", ("user", 11)),
    ("[assistant] ok", ("assistant", 12)), ("Bob Smith: hello", ("other", 0)), ("plain text: no", ("none", 0)), ("", ("none", 0))])
def test_speaker_marks(line, want):
    assert chat.speaker(line) == want


def test_chunked_decoding_equals_decoding_in_one_piece():
    rng = np.random.default_rng(7)
    n = len(chat.STATES)
    step = rng.random((n, n))
    start = np.array([1.0 if opens else 0.0 for _, opens in chat.STATES])
    with np.errstate(divide="ignore"):
        model = chat.Model(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [])
    emissions = [np.log(rng.random(n)) for _ in range(25)]
    whole = chat.viterbi(model, emissions, None, None)
    matrices = []
    for c in range(0, 25, 7):
        best = np.tile(model.start + emissions[c], (n, 1)) if c == 0 else model.step + emissions[c]
        for e in emissions[c + 1 : c + 7]:
            best = (best[:, :, None] + model.step[None]).max(axis=1) + e
        matrices.append(best)
    rows = pa.RecordBatch.from_pylist([{"conv": "=1", "chunk": i, "best": m.ravel().tolist()} for i, m in enumerate(matrices)])
    borders = {r["chunk"]: r for b in chat._borders([rows]) for r in b.to_pylist()}
    joined = [s for i, c in enumerate(range(0, 25, 7)) for s in chat.viterbi(model, emissions[c : c + 7], None if i == 0 else borders[i]["enter"], borders[i]["leave"])]
    assert joined == whole
