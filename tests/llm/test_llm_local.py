"""The operators' numpy and Python parts against brute force, without Spark."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tarnlake.llm import bpe, chat, fingerprint, html, lm, neardup, quality, toxicity, warc
from tarnlake.llm.common import pieces, utf8
from tarnlake.llm.words import shingles, words

TEXTS = st.text(alphabet=" \t\n\x0bABcdé日🎉'.<|\\", max_size=60)


def flat(texts):
    return utf8(pa.array(texts, pa.string()))


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=8))
def test_words(texts):
    w = words(*flat(texts))
    split = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(w.offsets).tolist() == [len(x) for x in split]
    seen = {}
    for word, h in zip((x for s in split for x in s), w.hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    h, at = shingles(w, 5)
    assert np.diff(at).tolist() == [len(x) - 4 if len(x) >= 5 else min(len(x), 1) for x in split]


def test_long_words_and_pieces():
    w = words(*flat(["x" * 5000, "x" * 4999 + "y", "x" * 5000]))
    assert w.hashes[0] == w.hashes[2] != w.hashes[1]
    assert list(pieces(np.array([0, 4, 9, 9, 30, 31]), 10)) == [(0, 3), (3, 4), (4, 5)]


# --- BPE


@pytest.fixture(scope="module")
def both():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return bpe.ByteBpe(bpe.read_vocabulary(path)), Tokenizer.from_file(path)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab 'strevlmdAé日🎉́\n\t!0٠\xad　", max_size=40), min_size=1, max_size=5))
def test_bpe_as_the_library_does(both, texts):
    ours, library = both
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and ours.decimal(ids).decode() == ",".join(map(str, want))
        assert ours.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_special_tokens_and_long_runs(both):
    ours, library = both
    texts = ["", "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", "a" * 3000, "ab" * 2000 + " ", "日本" * 900, "x" * 1100 + " " * 900 + "q"]
    assert [x.tolist() for x in ours.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ours.decode(np.array([ours.single[0xFF]])) == "�".encode()


@pytest.mark.parametrize("rows", [[], [b""], ["\u00e9".encode() * 20, b"", b"abc"], [b"x"] * 30])
def test_bpe_texts_are_joined_in_runs(monkeypatch, rows):
    """Runs of CHUNK bytes make the same column as all rows at once."""
    monkeypatch.setattr(bpe, "CHUNK", 8)
    got = bpe.joined_texts(iter(rows))
    assert got.type == "string" and got.to_pylist() == [x.decode() for x in rows]


def test_bpe_merges_long_runs_as_short_ones(both, monkeypatch):
    """Runs of any length take the same rounds: the bound between batches changes no id."""
    ours, library = both
    rng = random.Random(31)
    texts = ["".join(rng.choices(alphabet, k=n)) for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("0123456789", 9_000), ("=-+/", 4_000), ("aé日🎉", 3_000), ("etaoin", 1024), ("ab", 1025))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for bound in (0, 1024, 1 << 40):
        monkeypatch.setattr(bpe, "LONG", bound)
        ours.known.clear()
        assert [x.tolist() for x in ours.encode(texts)] == want


# --- chat


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|x|>\\"]), st.text(alphabet="<|\\im_endstart>\n a", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    text, spans = chat.Template(chat.TEMPLATE).render(messages)
    assert chat.parse_turns(text) == turns
    assert [chat.unguard(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    parts = list(chat.Template(chat.TEMPLATE).parts(iter(messages), part=20))
    assert "".join("".join(p.texts) for p in parts) == text


def test_template_language():
    t = chat.Template("{% set x = 'a' ~ 1 %}{{ x }}{% for m in messages %}{% if loop.first and not m.skip %}[{{ m['role'] | upper }}]{% elif loop.last %}end{% else %}{{ loop.index0 + 1 }}{% endif %}{% endfor %}{# no #}{{ missing }}")
    assert t.render([{"role": "u"}, {"role": "v"}, {"role": "w"}])[0] == "a1[U]2end"
    assert chat.fold(chat.parse("{% if 1 == 1 %}a{{ 'b' | upper }}{% else %}c{% endif %}d")) == (chat.Output(chat.Const("aBd")),)
    for bad in ("{% for x %}", "{{ a.b( }}", "{{ x | nope }}", "{% if a %}", "{{ }}", "{% import os %}", "{{ ''.__class__ | nope }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    assert chat.Template("{{ messages.__class__ }}").render([])[0] == ""


# --- WARC


def test_warc_normaliser():
    plain = b"".join(warc.serialise(k, u, p, r, "2024-01-01T00:00:00Z") for k, u, p, r in [(1, "http://a/\r\nX: y", b"one", None), (2, None, b"", None), (None, "http://b", "é\r\n\r\n".encode() * 9, None), (3, "http://c", b"one", 1)])
    mono = warc.member(plain[:50], 6) + warc.member(plain[50:], 1)  # several members read as one stream
    for part in (1, 1 << 20):
        records = [warc.fetch(data, at, n) for data, index in warc.normalise(mono, part=part) for _, at, n in index]
        assert [r.headers["warc-type"] for r in records] == ["response"] * 3 + ["revisit"]
        assert [warc.key_of(r.headers["warc-record-id"]) for r in records] == [1, 2, None, 3] and warc.key_of(records[3].headers["warc-refers-to"]) == 1
        assert records[2].block.endswith(b"\r\n\r\n") and len([r for r in records if "x" in r.headers]) == 0
    with pytest.raises(ValueError):
        list(warc.normalise(mono[:-30]))


# --- HTML


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 7)
        s = [rng.choice([0, rng.random() * 3]) for _ in range(n)]
        k = [0 if x else rng.random() * 3 for x in s]
        ties = [(a, b, rng.random() * 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda x: sum(s[i] for i in range(n) if not x[i]) + sum(k[i] for i in range(n) if x[i]) + sum(w for a, b, w in ties if x[a] != x[b])  # noqa: E731, B023
        assert cost(html.minimum_cut(s, k, ties)) == pytest.approx(min(map(cost, itertools.product([0, 1], repeat=n))))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies on this site. Please accept all of them.</div><main><article><header><h1>Title &amp; more</h1></header><!-- no -->
<p>First  para with <b>bo</b>ld words and a <a href=y>link</a> in&nbsp;it.<br>Line.<p>Unclosed one.</p><div class="ad">Buy now! Really good things to buy here today.</div>
<ul><li>One item<li>Two</ul><form>Mail <input></form><script>var x = "<p>no</p>";</script><p>Last one &lt;b&gt; here.</p></article></main>
<section id="comments"><h2>Comments</h2><article class="comment"><p>Reader says this is a great article and I agree entirely.</p></article></section>
<aside><p>Sidebar text that is quite long, in fact several words long.</p></aside><footer>&copy; 2024 x</footer></body></html><p cut="""


def test_html():
    assert html.extract(PAGE) == "Title & more First para with bold words and a link in it. Line. Unclosed one. One item Two Last one <b> here."
    assert [html.extract(x) for x in (None, "", "  ", "<p>", "<div")] == [""] * 5
    assert html.extract("<article><p>Plain text of a page that ends &am") == "Plain text of a page that ends &am"


SENTENCE = "The town hall said on Monday that the bridge stays closed until the end of the month, since the river is high. "


def test_html_quotes_and_class_names():
    text = (SENTENCE * 2).strip()
    for page in (
        f"<article><p title=it's>{text}</p><p>Next \"one\" isn't lost.</p></article>",
        f'<div class="feedback-loops"><p>{text}</p><p>Next "one" isn\'t lost.</p></div>',
        f'<div class="post-ad-free-story"><p>{text}</p><p>Next "one" isn\'t lost.</p></div>',
        f"<article><p data-x='a>b' title=\"it's\">{text}</p><p>Next \"one\" isn't lost.</p></article>",
    ):
        assert html.extract(page) == text + ' Next "one" isn\'t lost.'
    for name in ("ad-container", "cookie-notice", "comments-area", "site-footer", "sidebar-left", "related_items"):
        assert html.extract(f'<article><p>{text}</p><div class="{name}"><p>{SENTENCE}</p></div><p>Last one here.</p></article>') == text + " Last one here."


def test_html_cut_decides_what_words_leave_open():
    """Without the smoothness edges short lines of a story are lost and a stray sentence among links is taken."""
    story = [SENTENCE.strip(), "No.", "Why", SENTENCE.strip(), "Because", SENTENCE.strip()]
    links = "".join(f"<div><a href=/{k}>Some place {k}</a></div>" for k in range(4))
    page = f"<body><div>{links}<div>More of this for you</div>{links}</div><div>{''.join(f'<div>{x}</div>' for x in story)}</div><div>{links}</div></body>"
    found, nodes = html.blocks(page)
    alone = [x > 0 for x, _ in (html.costs(b, nodes[b.node], False) for b in found)]
    cut = html.labels(found, nodes)
    want = [b.text in story for b in found]
    assert cut == want and alone != want and html.extract(page) == " ".join(story)
    assert sum(a != w for a, w in zip(alone, want, strict=True)) >= 3


def test_html_takes_time_in_proportion():
    import time

    text = SENTENCE * 9000
    pages = ["<div>" * 40_000 + "</p></b></table>" * 20_000 + "<p>x", "<b><table>" + "<div>" * 30_000 + "</b>" * 60_000, "<span>" * 40_000 + "<p>a</p>" * 20_000, f"<article><p>{text}</p></article>", "<p>a word</p><a href=x>b</a>" * 30_000, '<p title="' * 40_000]
    for page in pages:
        began = time.process_time()
        html.extract(page)
        assert time.process_time() - began < 8
    assert html.extract(pages[3]) == text.strip()


# --- fingerprints


def test_fingerprints():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400))
    other = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400))
    a, b, c, d, e, f = fingerprint.sketches([text, other, text, "", "short", text[:1000] + other[1000:]])
    assert fingerprint.shown(a) == fingerprint.shown(c) and fingerprint.likeness(a, c) == 1 and fingerprint.likeness(a, b) < 0.1
    assert fingerprint.likeness(d, d) == 1 and fingerprint.likeness(d, e) == 0 and fingerprint.likeness(e, e) == 1
    assert abs(fingerprint.likeness(a, f) - 1000 / len(text)) < 0.25
    back = fingerprint.read(fingerprint.shown(a))
    assert back[2] == len(text) and np.array_equal(back[0], a[0]) and np.array_equal(back[1], a[1])


def test_short_texts_have_fingerprints():
    short, other = "a short text of words that goes on", "quite another one here, in a line"
    a, b, c = fingerprint.sketches([short, short[:23] + other[:11], other])
    assert fingerprint.likeness(a, b) > 0.3 > fingerprint.likeness(a, c)


def brute_anchors(text):
    """By definition: hashes of the inner runs are those of the operator, all else is spelled out."""
    inner, whole = fingerprint.INNER, fingerprint.ANCHOR
    h = (np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    size = 1
    while size < inner:
        h, size = fingerprint.twice(h, size), 2 * size
    out = []
    for i in range(len(text) - whole + 1):
        runs = h[i : i + whole - inner + 1].tolist()
        if min(runs) in (runs[0], runs[-1]):
            out.append((i, text[i : i + whole]))
    return out


def brute_likeness(x, y):
    """The longest common run of matches between the k-th occurrences, by dynamic programming."""
    def numbered(found):
        seen, out = {}, []
        for i, run in found:
            seen[run] = seen.get(run, 0) + 1
            out.append((run, seen[run]))
        return out

    a, b = numbered(x), numbered(y)
    best = [0] * (len(b) + 1)
    for u in a:
        before = 0
        for j, v in enumerate(b):
            before, best[j + 1] = best[j + 1], max(best[j + 1], best[j], before + 1 if u == v else 0)
    return 2 * best[-1] / (len(a) + len(b))


def test_fingerprints_against_brute_force():
    rng = random.Random(14)
    texts = ["".join(rng.choices("abc ", k=rng.choice([12, 60, 119, 120, 400]))) for _ in range(30)]
    texts += [t + "x" for t in texts[:6]] + [texts[0] * 3, texts[1][60:] + texts[1][:60], "a" * 90]
    sketches = fingerprint.sketches(texts)
    brute = [brute_anchors(t) for t in texts]
    hashes = {}
    for s, found, t in zip(sketches, brute, texts, strict=True):
        if found:
            assert s[1].tolist() == [i for i, _ in found]
            for h, (_, run) in zip(s[0].tolist(), found, strict=True):
                assert hashes.setdefault(run, h) == h
        back = fingerprint.read(fingerprint.shown(s))
        assert back[2] == s[2] == len(t) and np.array_equal(back[0], s[0]) and np.array_equal(back[1], s[1])
    assert len(set(hashes.values())) == len(hashes)
    for i, j in itertools.product(range(len(texts)), repeat=2):
        if brute[i] and brute[j]:
            assert fingerprint.likeness(sketches[i], sketches[j]) == pytest.approx(brute_likeness(brute[i], brute[j]))


def test_likeness_has_no_steps_in_length():
    """A character more changes little at any length, and a shared passage shows however long the texts are."""
    rng = random.Random(15)
    letters = "".join(rng.choices("abcdefgh ", k=30_000))
    for n in (29, 30, 64, 119, 120, 2000):
        a, b = fingerprint.sketches([letters[:n], letters[: n + 1]])
        assert fingerprint.likeness(a, b) > 0.7
    other = "".join(rng.choices("abcdefgh ", k=30_000))
    a, b = fingerprint.sketches([letters, other[:9000] + letters[100:500] + other[9000:]])
    assert fingerprint.likeness(a, b) > 0.005


def test_syncmers_are_context_free():
    """Anchors of a text are those of each longer text around it."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefgh ", k=300))
    inner, outer = fingerprint.sketches([text, "xyz " * 3 + text + " end"])
    found = set(zip(outer[0].tolist(), outer[1].tolist(), strict=True))
    assert all((h, p + 12) in found for h, p in zip(inner[0].tolist(), inner[1].tolist(), strict=True)) and len(inner[0]) > 50


# --- near duplicates


def test_probminhash():
    rng = np.random.default_rng(0)
    a = [f"w{i}" for i in rng.integers(0, 500, 300)]
    b = list(a)
    for k in (5, 90, 200):
        b[k] = "edit"
    texts = [" ".join(a), " ".join(b), " ".join(a[:80] * 2 + a[80:160]), " ".join(a[:80] + a[80:160] * 2), "A  b\nc", "a b c", "", None]
    h, w, at = neardup.weights(*flat(texts))
    sig = neardup.signatures(h, w, at)
    part = lambda i: slice(at[i], at[i + 1])
    for i, j in ((0, 1), (2, 3), (0, 4)):
        p = {k: v / w[part(i)].sum() for k, v in zip(h[part(i)], w[part(i)], strict=True)}
        q = {k: v / w[part(j)].sum() for k, v in zip(h[part(j)], w[part(j)], strict=True)}
        brute = sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in {*p, *q}) for d in {*p} & {*q})
        assert neardup.probability_jaccard(h[part(i)], w[part(i)], h[part(j)], w[part(j)]) == pytest.approx(brute)
        assert abs((sig[i] == sig[j]).mean() - brute) < 0.15
        assert neardup.similarity(h[part(i)], h[part(j)]) == pytest.approx(len({*p} & {*q}) / len({*p, *q}))
    assert (sig[4] == sig[5]).all() and not sig[6].any() and not sig[7].any()


def test_unequal_repeats_keep_candidates_likely():
    """Whatever the repeats are, texts at 0.8 have a probability Jaccard similarity that shares a band with 0.998."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(5, 200))
        both, own = int(0.8 * n) or 1, n - (int(0.8 * n) or 1)
        low, high = 1.0, 1 + neardup.EXTRA
        x, y = (rng.choice([low, high], n) for _ in range(2))
        a, b = np.arange(both + own // 2), np.append(np.arange(both), np.arange(n, n + own - own // 2))
        p = neardup.probability_jaccard(a, x[: len(a)], b, y[: len(b)])
        share = both / (both + own)
        assert p > 0.74 / 0.8 * share and 1 - (1 - 0.74**neardup.ROWS) ** neardup.BANDS > 0.998
    texts = ["x " * 400 + "a b c d e f", "x " * 9 + "a b c d e f"]
    _, w, _ = neardup.weights(*flat(texts))
    assert w.min() == 1 and w.max() <= 1 + neardup.EXTRA


# --- language model


def test_seating_follows_the_exact_conditional():
    rng = np.random.default_rng(1)
    d, strength, base, others, c = 0.6, 2.0, 0.1, 5, 6
    stirling = lm.log_stirling(d)
    want = np.array([math.exp(stirling[c, t] + sum(math.log(strength + d * (others + i)) for i in range(t)) + t * math.log(base)) for t in range(1, c + 1)])
    got = lm.seat(np.full(20000, c), np.full(20000, base), np.full(20000, others), strength, d, stirling, rng)
    assert np.allclose(np.bincount(got, minlength=c + 1)[1:] / 20000, want / want.sum(), atol=0.02)
    # Stirling numbers by their recursion over set partitions: S(3, 2) = (1 - d) + (2 - d - d) ...
    assert math.exp(stirling[3, 2]) == pytest.approx((1 - d) + (2 - 2 * d))
    many = lm.seat(np.array([1, 1000, 100_000]), np.full(3, 1e-3), np.zeros(3), 1.0, d, stirling, rng)
    assert many[0] == 1 and 1 <= many[1] <= many[2] < 100_000


def test_seating_of_many_customers_is_close_to_exact():
    """With the exact part cut to 64 customers, the mean of tables of up to 512 stays near the exact one."""
    rng = np.random.default_rng(2)
    for d in (0.3, 0.7):
        exact, short = lm.log_stirling(d), lm.log_stirling(d, 64)
        for c in (100, 512):
            for base in (1e-4, 1e-2, 0.3):
                args = np.full(4000, c), np.full(4000, base), np.full(4000, 20), 5.0, d
                a, b = (lm.seat(*args, table, rng).mean() for table in (exact, short))
                assert abs(a - b) < 0.1 * a + 0.1


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_open_pairs_against_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(neardup, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    n, t = 160, 0.8
    group, second, label = rng.integers(0, 9, n), rng.random(n) < 0.5, rng.integers(-3, 3, n)
    alone = group % 3 == 0
    second &= ~alone
    order = np.lexsort((label, second, group))
    group, alone, second, label = (x[order] for x in (group, alone, second, label))
    group = np.unique(group, return_inverse=True)[1]
    rows = np.stack([rng.integers(20, 40, n), rng.integers(0, 8, n), rng.integers(0, 8, n), rng.integers(1, 10, n)]).astype(np.int32)
    brute = set()
    for i in range(n):
        for j in range(n):
            if group[i] == group[j] and label[i] != label[j] and (i < j if alone[i] else not second[i] and second[j]):
                (size, more, less, rank), (size_, more_, less_, rank_) = rows[:, i].tolist(), rows[:, j].tolist()
                most, longer = (1 - t) / (1 + t) * (size + size_) + 1e-6, more + less - more_ - less_
                if abs(more - more_) + abs(less - less_) <= most and rank <= (longer + most) / 2 + 1 and rank_ <= (most - longer) / 2 + 1:
                    brute.add((i, j))
    got = [(int(i), int(j)) for x, y in neardup.open_pairs(group, alone, second, label, rows, t) for i, j in zip(x, y, strict=True)]
    assert len(got) == len(set(got)) and set(got) == brute and len(brute) > 100


def test_grouping_is_the_same_by_either_sort(monkeypatch):
    rng = np.random.default_rng(6)
    word, room, doc = rng.integers(0, 9, 400).astype(np.uint64), rng.integers(0, 5, 400), np.sort(rng.integers(0, 7, 400))
    none = np.zeros(0, np.uint64)
    short = {b: [x.tolist() for x in a] for b, a in lm.grouped(word, room, doc, none, 4)}
    entries = [(b, w, r, d, t) for b, (distinct, sizes, rooms, docs, times) in short.items() for w, r, d, t in zip(np.repeat(distinct, sizes).tolist(), rooms, docs, times, strict=True)]
    import collections

    assert collections.Counter({(w, r, d): t for _, w, r, d, t in entries}) == collections.Counter(zip(word.tolist(), room.tolist(), doc.tolist(), strict=True))
    monkeypatch.setattr(lm, "RESTAURANTS", 1 << 60)
    assert {b: [x.tolist() for x in a] for b, a in lm.grouped(word, room, doc, none, 4)} == short


def test_tokens():
    word, room, doc = lm.tokens(*flat(["A b", None, "a"]))
    assert doc.tolist() == [0, 0, 0, 1, 2, 2] and word[0] == word[4] and word[2] == word[3] == word[5] == lm.END
    assert room[0] == room[3] == room[4]  # all begin a text
    assert [a.tolist() for a in lm.unpack(lm.pack(np.arange(3), np.zeros(0)))] == [[0, 1, 2], []]


# --- classifiers


def test_quality_features():
    x = quality.features(*flat(["ABC def. 12", "a a a b a b", "", "| % |"]))
    assert x[0, 0] == pytest.approx(0.5) and x[0, 2] == pytest.approx(2 / 9) and x[1, 4] == pytest.approx(2 / 6) and x[1, 5] == pytest.approx(3 / 6)
    assert not x[2].any() and x[3, 1] == 1 and x[3, 3] == 1
    y = (np.arange(200) % 2).astype(float)
    m = quality.fit(np.column_stack([y + 0.001 * (np.arange(200) % 3), *[np.zeros(200)] * 8]), y)
    assert ((m.of(np.column_stack([y, *[np.zeros(200)] * 8])) > 0) == (y > 0.5)).all()
    assert quality.fit(np.zeros((3, 9)), np.ones(3)).of(np.zeros((1, 9)))[0] == 0


def test_toxicity_learns_words_and_beginnings():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("aeiourstlnd", k=rng.randint(2, 7)))
    vocabulary = [word() for _ in range(300)]
    texts, y = [], []
    for i in range(500):
        t = rng.choices(vocabulary, k=rng.randint(5, 60))
        y.append(int(i % 5 == 0))
        if y[-1]:
            t[rng.randrange(len(t))] = rng.choice(["grumpf", "zxq" + word(), "the zxq" + word()])
        texts.append(" ".join(t))
    y, apart = np.array(y), np.arange(500) % 4 == 1
    m = toxicity.fit(texts, y, apart)
    more = [" ".join(rng.choices(vocabulary, k=500) + [w] + rng.choices(vocabulary, k=500)) for w in ("grumpf", "zxqnewone", "plain")]
    s = m.scores(*flat([*more, "", None]))
    assert s[0] > 0.5 and s[1] > 0.5 and (s[2:] < 0.5).all() and s[3] == s[4]
    assert (m.scores(*flat(texts))[apart] >= 0.5).tolist() == [bool(v) for v in y[apart]]
    assert toxicity.fit([], np.zeros(0, int), np.zeros(0, bool)).scores(*flat(["x"]))[0] < 0.5
    assert toxicity.tell(*[*np.unique(words(*flat(["der und nicht", "le les et", "xx"])).hashes, return_inverse=True)], np.array([0, 3, 6, 7]), np.arange(3)).tolist() == [0, 3, 4]


def brute_pooled(m, rows, inverse):
    """Each filter's largest value over all places, one place at a time."""
    embedded = [m.embedding[rows[i]].mean(0) for i in inverse]
    out = np.zeros((len(toxicity.WIDTHS), toxicity.FILTERS))
    for a, width in enumerate(toxicity.WIDTHS):
        values = [sum(embedded[p + k] @ m.filters[toxicity.OFFSETS.index((width, k))] for k in range(width) if p + k < len(embedded)) for p in range(len(embedded))]
        out[a] = np.max(values, 0)
    return out


def random_cnn(rng):
    widths, filters, dim = len(toxicity.WIDTHS), toxicity.FILTERS, toxicity.DIM
    return toxicity.Cnn(rng.normal(0, 1, (toxicity.BUCKETS, dim)).astype(np.float32), rng.normal(0, 1, (len(toxicity.OFFSETS), dim, filters)).astype(np.float32), rng.normal(0, 1, (widths, filters)).astype(np.float32), rng.normal(0, 1, (widths, filters)).astype(np.float32), -0.3, np.arange(len(toxicity.LANGUAGES)) / 10)


def test_toxicity_forward_pass_by_brute_force():
    rng = np.random.default_rng(8)
    m = random_cnn(rng)
    texts = ["one", "the cat and the dog", "", None, "der hund und die katze ist nicht da", " ".join(f"w{i}" for i in rng.integers(0, 40, 300))]
    got = m.scores(*flat(texts))
    for t, s in zip(texts, got, strict=True):
        w = words(*flat([t]))
        logit = m.base
        if len(w.hashes):
            _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            pooled = brute_pooled(m, toxicity.features(w, first), inverse)
            logit += (np.maximum(pooled + m.bias, 0) * m.out).sum()
        said = (t or "").lower().split()
        hits = [sum(x in v.split() for x in said) for v in toxicity.FUNCTION_WORDS.values()]
        language = int(np.argmax(hits)) if max(hits) else len(hits)
        assert s == pytest.approx(1 / (1 + math.exp(-np.clip(logit - m.shift[language], -30, 30))), rel=1e-4)


def test_toxicity_thresholds_by_brute_force():
    """Each language's shift has the largest F1 over all thresholds."""
    rng = np.random.default_rng(9)
    m = random_cnn(rng)
    language, y = rng.integers(0, 3, 400), rng.integers(0, 2, 400)
    logit = y + rng.normal(0, 1.2, 400) + language
    toxicity.calibrate(m, language, 1 - y, y, logit, logit)
    for part, shift in [(language == k, m.shift[k]) for k in range(3)] + [(language >= 0, m.shift[3])]:
        f1 = lambda least: 2 * (y[part] * (logit[part] >= least)).sum() / ((logit[part] >= least).sum() + y[part].sum())  # noqa: E731, B023
        assert f1(shift) == pytest.approx(max(f1(x) for x in logit[part]))
